"""The corpus operators as driver queries over ``documents``, ``pages`` and ``benchmark``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where the public tokenizer file lies; read on the driver only.
SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.sentencepiece_lattice import encoding_digests

    return encoding_digests(_table(spark, sf_dir, "documents"), SENTENCEPIECE_MODEL)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), window=50, keep_text=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("tkey")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.secrets import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.langid import identify_languages

    return identify_languages(_table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.html_text import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from strandline.llm.line_dedup import dedup_lines

    kept = dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.imatch import fingerprint_documents

    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.minhash_forest import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the secret scan: the base kinds' numbers."""
    return op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def imatch_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the fingerprints: the texts they are taken of."""
    return op9_imatch_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    parts = {f.__name__: f for f in (secret_base_counts, imatch_edited_texts)}
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | parts


_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _either_case(name: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)


_ASSIGN = f"""({"|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SQL = {
    "secret_base_counts": f"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '{_ASSIGN}', 2), lambda x: length(x) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex FROM documents""",
    "imatch_edited_texts": """WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents), n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) after FROM d)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(left(t, length(t) - length(t) // 4) || left(after, length(t) // 4)) AS edited_sha256 FROM n""",
    "op2_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} words FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(words[p + 1:p + 50], ' ')) h FROM (SELECT doc_id, words, unnest(range(len(words) - 49)) p FROM w WHERE len(words) >= 50)),
firsts AS (SELECT h, min(doc_id) d0 FROM win GROUP BY h),
covered AS (SELECT DISTINCT doc_id, p + o AS place FROM (SELECT win.doc_id, p FROM win JOIN firsts USING (h) WHERE win.doc_id > d0), range(50) r(o)),
one AS (SELECT doc_id, unnest(words) word, unnest(range(len(words))) place FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) k FROM one ANTI JOIN covered USING (doc_id, place) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) n FROM covered GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)""",
    "op7_line_dedup": """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) ls FROM documents),
win AS (SELECT doc_id, p, ls[p + 1:p + 3] k FROM (SELECT doc_id, ls, unnest(range(len(ls) - 2)) p FROM l WHERE len(ls) >= 3)),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) n FROM win),
covered AS (SELECT DISTINCT doc_id, p + o AS place FROM ranked, range(3) r(o) WHERE n > 1),
one AS (SELECT doc_id, unnest(ls) line, unnest(range(len(ls))) place FROM l),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY place) k FROM one ANTI JOIN covered USING (doc_id, place) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) n FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)""",
    # candidates by prefix filter (two sets at 80 % share one of the rarest fifth of their shingles), links on whole sets, then closure
    "op10_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} words FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(words) > 1 THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) ELSE words END) s FROM w)),
n AS (SELECT doc_id, count(*) n FROM sh GROUP BY doc_id),
df AS (SELECT s, count(*) f FROM sh GROUP BY s),
pre AS (SELECT doc_id, s FROM (SELECT doc_id, s, n.n, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) r FROM sh JOIN df USING (s) JOIN n USING (doc_id)) WHERE r <= n - (80 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.doc_id x, b.doc_id y FROM pre a JOIN pre b ON a.s = b.s AND a.doc_id < b.doc_id),
shared AS (SELECT x, y, count(*) k FROM cand JOIN sh a ON a.doc_id = x JOIN sh b ON b.doc_id = y AND a.s = b.s GROUP BY x, y),
links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
pairs AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x, y FROM pairs UNION SELECT r.x, b.y FROM reach r JOIN pairs b ON r.y = b.x),
comp AS (SELECT x doc_id, least(x, min(y)) c FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    """Only for what SQL expresses over whole tables; the others are tested against brute force."""
    return dict(_SQL)
