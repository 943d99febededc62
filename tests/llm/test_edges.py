"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import pytest

pytest.importorskip("strandline.llm")
from strandline.llm import decontaminate, html_text, imatch, langid, line_dedup, minhash_forest, secrets, sentencepiece_lattice, substring_dedup, toxicity  # noqa: E402
from strandline.llm.queries import SENTENCEPIECE_MODEL  # noqa: E402

from .fixtures import prose  # noqa: E402

#: Names that operators use inside.
CLASHING = ["tkey", "h", "g", "n", "s", "k1", "k2", "spans", "paths", "base", "weak", "component_id", "kept", "host", "open", "score", "rep", "term", "df", "lines", "spots", "grp", "chunks", "gone", "range", "guest", "sl_gone", "sl_lines", "sl_removed", "sl_row", "sl_text", "ids_", "edits", "covered", "grams"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHING)


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, *["x"] * len(CLASHING)) for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    text = prose(1, 80)
    rows = [(None, None, None), (None, text, "en"), (1, text, "en"), (1, text, "en"), (2, text, None), (3, None, "en"), (4, "", "de"), (5, "x", "en"), (6, prose(2, 40_000), "en"), (7, "\n\n\n\n", "en"), (7, "other text", "en")]
    return _docs(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return _docs(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1), (6, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, prose(1, 30)), (1, prose(1, 30)), (None, "x"), (2, None), (3, ""), (4, "absent words here entirely")], "item_id bigint, text string")


OPERATORS = {
    "op1": lambda d, labels, bench: sentencepiece_lattice.encoding_digests(d, SENTENCEPIECE_MODEL),
    "op2": lambda d, labels, bench: substring_dedup.remove_repeats(d),
    "op3": lambda d, labels, bench: toxicity.score_toxicity(d, labels),
    "op4": lambda d, labels, bench: secrets.scan_secrets(d),
    "op5": lambda d, labels, bench: langid.identify_languages(d),
    "op7": lambda d, labels, bench: line_dedup.dedup_lines(d),
    "op9": lambda d, labels, bench: imatch.fingerprint_documents(d),
    "op10": lambda d, labels, bench: minhash_forest.near_duplicates(d, 2),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(name, odd, none, labels, benchmark):
    assert sorted(str(r.doc_id) for r in OPERATORS[name](odd, labels, benchmark).collect()) == sorted(str(r.doc_id) for r in odd.collect())
    assert OPERATORS[name](none, labels.limit(0), benchmark.limit(0)).count() == 0


def test_defined_results(odd, labels):
    encoded = {(r.doc_id, r.n_chars): r for r in OPERATORS["op1"](odd, labels, None).collect()}
    assert encoded[3, 0].n_tokens == 0 and all(r.round_trip for r in encoded.values())
    removed = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.remove_repeats(odd).collect()}
    assert removed[1, 80] == 0 and removed[2, 80] == 80 and removed[None, 80] == 0 and removed[3, 0] == 0
    assert {r.score for r in toxicity.score_toxicity(odd, labels).collect()} == {1.0}  # one learnable label, toxic
    languages = {(r.doc_id, r.lang_pred) for r in langid.identify_languages(odd).collect()}
    assert {(3, "und"), (4, "und"), (7, "und"), (2, "en"), (None, "und"), (None, "en")} <= languages
    groups = {(r.doc_id, r.n_shingles > 9): (r.component_id, r.kept) for r in minhash_forest.near_duplicates(odd, 2).collect()}
    assert groups[1, True] == (1, True) and groups[2, True] == (1, False) and groups[3, False] == (3, True) and groups[None, True] == (None, True)
    prints = {}
    for r in imatch.fingerprint_documents(odd).collect():
        prints.setdefault(r.n_chars, set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in prints.values())


def test_leaks_of_odd_rows(odd, none, benchmark):
    hits = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.find_leaks(odd, benchmark).collect()}
    assert hits == {(None, 1, 0), (1, 1, 0), (2, 1, 0)}
    assert decontaminate.find_leaks(none, benchmark).count() == 0
    assert decontaminate.find_leaks(odd, benchmark.limit(0)).count() == 0
    assert decontaminate.drop_leaks(odd, benchmark).count() == odd.count() - 4


def test_pages_of_odd_rows(spark):
    pages = spark.createDataFrame(
        [(1, "http://h/x", None, "a"), (1, "http://h/x", None, "a"), (None, None, "", "b"), (2, "no url", "plain &amp; text", "c"), (3, "http://h/y", "<article><p>a<p>b" + " w" * 100_000, "d"), (4, "http://h/z", "<nav>menu</nav", "e")],
        "page_id bigint, url string, html string, host string",
    )
    found = sorted((r.page_id or 0, r.text[:10], r.n_chars) for r in html_text.extract_text(pages).collect())
    assert found == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "plain & te", 12), (3, "a\nb w w w ", 200_003), (4, "", 0)]
    assert html_text.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("number", range(5))
def test_pipeline_stages(spark, odd, none, labels, benchmark, tmp_path, number):
    pipeline = pytest.importorskip("corpus_pipeline")
    labels.where("toxic = 0").write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    _, stage = pipeline.STAGES[number]
    out = stage(spark, odd, str(tmp_path))
    assert out.columns[: len(odd.columns)] == odd.columns and (number == 4 or len(out.columns) == len(odd.columns))
    kept = [r.doc_id for r in out.collect()]
    assert {3, 4, 5, 6, 7} <= set(kept)
    assert stage(spark, none, str(tmp_path)).count() == 0
