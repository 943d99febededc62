"""Operators against hand-made values, closed forms and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.tokens import last_class, token_forms
from strandline.operators import alignment as A
from strandline.operators import encoding as E
from strandline.operators import geometry as G
from strandline.operators import inference as I
from strandline.operators import metrics as M
from strandline.operators import sets as S
from strandline.operators import timeseries as T


def _column(frame, key, value):
    return {r[key]: r[value] for r in frame.collect()}


def test_holm_and_benjamini_hochberg(spark):
    rows = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.005)], "k int, p double")
    assert {k: round(v, 9) for k, v in _column(I.holm(rows, "p", []), "k", "p_holm").items()} == {3: 0.02, 0: 0.03, 2: 0.06, 1: 0.06}
    assert {k: round(v, 9) for k, v in _column(I.benjamini_hochberg(rows, "p", []), "k", "q_fdr").items()} == {3: 0.02, 0: 0.02, 2: 0.04, 1: 0.04}
    floor = spark.createDataFrame([(i, 1 / 10001) for i in range(6)] + [(6 + i, 0.9) for i in range(6)], "k int, p double")
    adjusted = _column(I.holm(floor, "p", []), "k", "p_holm")
    assert all(math.isclose(adjusted[i], 12 / 10001) for i in range(6)) and adjusted[9] == 1.0


def test_layer_order_permutation_is_exact_for_few_layers():
    rho, p = I.layer_order_p(np.array([1.0, 2, 3]), np.array([0.1, 0.2, 0.9]), 10, np.random.default_rng(0))
    assert math.isclose(rho, 1.0) and math.isclose(p, 3 / 7)
    assert math.isnan(I.layer_order_p(np.array([1.0, 1, 1]), np.array([1.0, 2, 3]), 10, np.random.default_rng(0))[0])


def test_sign_flip_and_bootstrap():
    values = np.array([0.3, 0.1, 0.5, -0.2, 0.4])
    exact = I.sign_flip_p(values, 0, np.random.default_rng(0), exact_up_to=16)
    flips = [np.dot(f, values) for f in itertools.product((1, -1), repeat=5)]
    assert exact == (1 + sum(f >= values.sum() - 1e-12 for f in flips)) / 33
    assert abs(I.sign_flip_p(values, 20_000, np.random.default_rng(0)) - sum(f >= values.sum() - 1e-12 for f in flips) / 32) < 0.02
    low, high = I.bootstrap_interval(values, 5000, np.random.default_rng(0))
    assert low < values.mean() < high and low >= values.min()


def test_resampling_does_not_depend_on_other_groups(spark):
    rows = spark.createDataFrame([(g, float(v)) for g in range(3) for v in range(6)], "g int, v double")
    every = {r.g: r for r in I.resampled(rows, ["g"], "v", 200, 200).collect()}
    alone = I.resampled(rows.where("g = 1"), ["g"], "v", 200, 200).first()
    assert every[1] == alone


def test_spearman_with_ties(spark):
    rows = spark.createDataFrame([(0, x, y) for x, y in ((1.0, 2.0), (2.0, 2.0), (2.0, 5.0), (4.0, 1.0))] + [(1, 3.0, 1.0), (1, 3.0, 2.0)], "g int, x double, y double")
    rho = _column(I.spearman(rows, "x", "y", ["g"]), "g", "rho")
    assert math.isclose(rho[0], I.spearman_of(np.array([1, 2, 2, 4.0]), np.array([2, 2, 5, 1.0])), abs_tol=1e-9) and rho[1] == 0.0


def test_group_results_hold_no_layerless_rows(spark):
    m = spark.createDataFrame([("s1", "raw", 0.5, 0.1, 0.1, 0.01), ("s2", "raw", None, 9.0, 9.0, 9.0)], "subject string, condition string, layer_depth double, r double, z double, r2 double")
    out = M.group_results(m, ["condition"]).collect()
    assert [(r.mean_z, r.se_z, r.n_subjects) for r in out] == [(0.1, 0.0, 1)]
    assert [r.ok for r in m.select(M.mid_layer().alias("ok")).collect()] == [True, None]


def test_derangement_has_no_fixed_point(spark):
    rows = spark.createDataFrame([(lang, i, i % 3) for lang in range(3) for i in range(20)], "lang int, triplet bigint, section int")
    out = G.derangement(rows, ["lang", "section"], "triplet", 12).collect()
    assert len(out) == 60 * 12 and all(r.triplet != r.permuted for r in out)
    for key, group in itertools.groupby(sorted(out, key=lambda r: (r.lang, r.section, r.shuffle)), key=lambda r: (r.lang, r.section, r.shuffle)):
        group = list(group)
        assert sorted(r.triplet for r in group) == sorted(r.permuted for r in group), key
    with pytest.raises(Exception, match="no derangement"):
        G.derangement(spark.createDataFrame([(0, 1, 1)], "lang int, triplet bigint, section int"), ["lang", "section"], "triplet", 1).collect()


def test_retrieval_blocks_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(lang, t, 0, rng.normal(size=4).tolist()) for lang in range(3) for t in range(23)]
    v = spark.createDataFrame(rows, "lang int, triplet bigint, layer int, vec array<double>")
    got = {(r.direction, r.triplet): r.best for r in G.nearest_translation(v, ["layer"], block=5).collect()}
    side = {lang: np.array([r[3] for r in rows if r[0] == lang]) for lang in range(3)}
    for a, b in itertools.permutations(range(3), 2):
        best = (side[a] @ side[b].T).argmax(1)
        assert [got[f"{a}>{b}", t] for t in range(23)] == best.tolist()


def test_retrieval_sends_a_vector_to_few_blocks(spark):
    """However many triplets: eight blocks of the two other languages; equal vectors give the least id."""
    rng = np.random.default_rng(8)
    rows = [(lang, t, 0, rng.normal(size=4).tolist() if t != 90 else [9.0, 9.0, 9.0, 9.0]) for lang in range(3) for t in range(100)]
    rows = [(lang, t, layer, [9.0] * 4 if t in (40, 90) else vec) for lang, t, layer, vec in rows]
    v = spark.createDataFrame(rows, "lang int, triplet bigint, layer int, vec array<double>")
    out = G.nearest_translation(v, ["layer"], block=2)
    assert "sequence(0, 7" in out._jdf.queryExecution().analyzed().toString()
    got = {(r.direction, r.triplet): r.best for r in out.collect()}
    side = {lang: np.array([r[3] for r in rows if r[0] == lang]) for lang in range(3)}
    assert got == {(f"{a}>{b}", t): int(x) for a, b in itertools.permutations(range(3), 2) for t, x in enumerate((side[a] @ side[b].T).argmax(1))}


def _sections(seed, sizes):
    rng = np.random.default_rng(seed)
    return [A.Section(["w" * rng.integers(3, 30) + rng.choice([".", "?"]) for _ in range(n)], rng.normal(size=(n, 6))) for n in sizes]


def test_pairwise_path_is_cheapest():
    for seed in range(5):
        a, b = _sections(seed, (5, 6))

        def every(i, j, a=a, b=b):
            if (i, j) == (5, 6):
                yield 0.0
            for p, q in itertools.product((1, 2), repeat=2):
                if i + p <= 5 and j + q <= 6:
                    step = A.span_cost(a.span(i, p), b.span(j, q))[0]
                    yield from (step + rest for rest in every(i + p, j + q))

        blocks = A.align_pair(a, b)
        total = sum(A.span_cost(a.span(s[0], n[0]), b.span(s[1], n[1]))[0] for s, n in blocks)
        assert math.isclose(total, min(every(0, 0)))
    with pytest.raises(A.Unreachable):
        A.align_pair(*_sections(0, (1, 3)))


def test_triplets_cover_every_sentence():
    sources = set()
    for seed in range(12):
        sides = _sections(seed, (7, 8, 6))
        triplets, conflicts, unresolved = A.merge_paths(sides, A.align_pair(sides[0], sides[1]), A.align_pair(sides[0], sides[2]))
        for k, size in enumerate((7, 8, 6)):
            assert [t.start[k] for t in triplets] == list(np.cumsum([0, *(t.length[k] for t in triplets)])[:-1]) and sum(t.length[k] for t in triplets) == size
        sources |= {t.source for t in triplets}
        assert bool(conflicts) == any(t.source != "pairwise_agree" for t in triplets) and unresolved == sum(t.source == "needs_fix" for t in triplets)
    assert {"pairwise_agree", "tri_repair"} <= sources


def test_token_forms_and_alignment():
    assert token_forms(["de", "les"], "fr") >= {"des", "de les", "deles"} and "ecole" in token_forms(["École"]) and token_forms([" "]) == set()
    assert A.align_tokens(["I", "don't", "know", "."], ["i", "dont", "know"]) == ([(0, 0), (1, 1), (2, 2), None], "approx")
    assert A.align_tokens(["ice", "cream", "van"], ["icecream", "van"]) == ([(0, 0), (0, 0), (1, 1)], "exact")
    assert A.align_tokens(["a", "b", "c"], ["a", "x", "y", "b", "c"])[0] == [(0, 0), (3, 3), (4, 4)]
    assert [last_class(t) for t in ("So? ", "no!", "yes.", "are？", "well…", "", "x")] == ["question", "exclamation", "declarative", "none", "pause", "none", "none"]


def test_token_groups_are_spelled_once(spark, monkeypatch):
    words, used = ["the", "cat's", "out", ".", "é", "x", "y"], []
    times = ["the", "cats", "z", "out", "e", "q", "y"]
    want = A.align_tokens(words, times)
    assert want == ([(0, 0), (1, 1), (3, 3), None, (4, 4), None, (6, 6)], "approx")
    whole = A.forms_of
    monkeypatch.setattr(A, "forms_of", lambda t, language="": used.append(tuple(t)) or whole(t, language))
    assert A.align_tokens(words, times) == want and max(map(used.count, used)) <= 2 and A.align_tokens(["a"] * 9, ["a"] * 9)[1] == "exact"
    assert ("a",) not in used
    rows = spark.createDataFrame([(s, i, t) for s in (1, 2, 3) for i, t in enumerate(words)] + [(3, 9, " ")], "section bigint, idx int, token string")
    timed = spark.createDataFrame([(s, i, t, float(i), i + 0.5) for s in (2, 3, 4) for i, t in enumerate(times)], "section bigint, idx int, token string, onset double, offset double")
    got = {(r.section, r.idx): (r.onset, r.offset, r.status) for r in A.align_token_sections(rows, timed).collect()}
    assert got == {(s, i): ((float(f[0]), f[1] + 0.5, "approx") if f and s > 1 else (None, None, "approx")) for s in (1, 2, 3) for i, f in enumerate(want[0])}


def test_sentence_takes_its_rows():
    assert A.consume_sentence(["the", "dog", "barks"], ["the", "dog", "barks", "loud"]) == 3
    assert A.consume_sentence(["ice", "cream"], ["icecream", "now"]) == 1
    assert A.consume_sentence([], ["x"]) == 0
    with pytest.raises(ValueError, match="does not fit"):
        A.consume_sentence(["a", "b", "c", "d", "e", "f", "g", "h"], ["z"] * 8)


def _whole_search(tree, rows):
    """The end of a sentence by every cell, without a shortcut or a limit on the way."""
    n = len(tree)
    most = min(len(rows), max(n + 8, 2 * n))
    score = {(0, 0): (0, 0)}
    for i in range(n + 1):
        for j in range(most + 1):
            cost, minus = score.get((i, j), (math.inf, 0))
            steps = [(1, 0, cost + 1, minus), (0, 1, cost + 1, minus)] + [(a, b, cost, minus - max(a, b)) for a in range(1, min(4, n - i) + 1) for b in range(1, min(4, most - j) + 1) if token_forms(tree[i : i + a]) & token_forms(rows[j : j + b])]
            for a, b, c, m in steps:
                score[i + a, j + b] = min((c, m), score.get((i + a, j + b), (math.inf, 0)))
    best = min((score[n, j][0], abs(j - n), score[n, j][1], j) for j in range(1, most + 1))
    return best[3] if best[0] <= max(3.0, 0.25 * n) else None


def test_sentence_search_leaves_out_only_what_cannot_win(monkeypatch):
    rng = np.random.default_rng(5)
    ends = set()
    for _ in range(150):
        tree = [str(w) for w in rng.choice(["a", "b", "ab", "c-d", "cd", "é", "."], rng.integers(1, 7))]
        rows = [w for w in tree if rng.random() > 0.2] + [str(w) for w in rng.choice(["a", "b", "e", "cd"], rng.integers(1, 5))]
        try:
            found = A.consume_sentence(["x", *tree], ["y", "x", *rows], start=1)
        except ValueError:
            found = None
        assert found == _whole_search(["x", *tree], ["x", *rows]), (tree, rows)
        ends.add(found)
    assert None in ends and len(ends) > 4
    used = []
    monkeypatch.setattr(A, "forms_of", lambda *a: used.append(a) or set())
    assert A.consume_sentence(["The", "dog", "barks"], ["the", "dog", "barks", "loud"]) == 3 and not used


def test_sections_in_a_stream(spark):
    """Sections longer than a batch, on one side alone and without times."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        words = spark.createDataFrame([(s, i, f"w{i}", float(i) if i != 3 else None, i + 0.5) for s in range(9) for i in range(20)] + [(50, 0, "alone", 0.0, 1.0)], "section bigint, idx int, token string, onset double, offset double")
        trees = spark.createDataFrame([(s, k, [f"w{i}" for i in range(k * 10, k * 10 + 10)]) for s in range(9) for k in range(2)], "section bigint, sentence int, tokens array<string>")
        found = sorted(tuple(r) for r in A.sentence_spans(words, trees).collect())
        assert found == [(s, k, " ".join(f"w{i}" for i in range(k * 10, k * 10 + 10)), k * 10.0, k * 10 + 9.5, 10) for s in range(9) for k in range(2)]
        with pytest.raises(Exception, match="no rows left"):
            A.sentence_spans(words, trees.unionByName(spark.createDataFrame([(99, 0, ["w"])], trees.schema))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_encoding_against_closed_form():
    rng = np.random.default_rng(0)
    runs = np.repeat(np.arange(4), 20)
    x, z = rng.normal(size=(80, 3)), np.column_stack([np.ones(80), np.arange(80) % 20])
    y = np.column_stack([x @ [1.0, 0, 0] + 0.1 * rng.normal(size=80), rng.normal(size=80)])
    r, zz, r2 = E.encode(x, y, z, runs)
    assert r[0] > 0.95 and r2[0] > 0.9 and abs(r[1]) < 0.5 and np.allclose(np.tanh(zz), r)
    train = runs != 0
    fold = E.Fold(x, y, z, train)
    keep = np.linalg.lstsq(z[train], np.column_stack([x, y])[train], rcond=None)[0]
    rest = np.column_stack([x, y]) - z @ keep
    xs = (rest[:, :3] - rest[train, :3].mean(0)) / rest[train, :3].std(0)
    for alpha in (0.01, 10.0):
        beta = np.linalg.solve(xs[train].T @ xs[train] + alpha * np.eye(3), xs[train].T @ rest[train, 3:])
        assert np.allclose(fold.predict(x[~train], z[~train], alpha), xs[~train] @ beta)
    with pytest.raises(ValueError, match="three runs"):
        E.encode(x, y, z, runs % 2)


def test_encoding_of_many_scans_holds_few_rows(spark, monkeypatch):
    """A fit meets fewer than two rows for each column of a run, however many scans, and finds what all scans give; what is constant says nothing."""
    rng = np.random.default_rng(3)
    runs = np.repeat([1, 2, 3, 5], [700, 500, 600, 9])
    n = len(runs)
    z = np.column_stack([np.ones(n), np.cos(np.arange(n) / 40)])
    groups = {}
    for key, width in (("a", 3), (None, 5)):
        x = np.column_stack([rng.normal(3.0, 2.0, size=(n, width)), np.full(n, 7.1)])
        y = np.column_stack([x[:, 0] - 0.4 * x[:, 1] + rng.normal(size=n), rng.normal(size=n), np.full(n, 5.3), np.where(runs == 2, 0.3, x[:, 1])])
        groups[key] = (x, y, E.encode(x, y, z, runs))
    still = rng.normal(size=(n, 2))
    groups["none"] = (np.full((n, 2), 7.1), still, (np.zeros(2),) * 3)
    rows = spark.createDataFrame([(key, int(runs[i]), i, x[i].tolist(), z[i].tolist(), y[i].tolist()) for key, (x, y, _) in groups.items() for i in range(n)], "k string, run int, scan int, x array<double>, nuisance array<double>, y array<double>").repartition(3)
    encode = E.encode

    def few(x, y, z, runs, **more):
        if len(x) > 4 * 2 * (1 + x.shape[1] + z.shape[1] + y.shape[1]):
            raise ValueError(f"{len(x)} rows at once")
        return encode(x, y, z, runs, **more)

    monkeypatch.setattr(E, "encode", few)
    monkeypatch.setattr(E, "HELD", 20_000, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        for given in (lambda: rows, lambda: E.condensed(rows, ["k"])):
            found = {(f.k, f.position): (f.r, f.z, f.r2) for f in E.encode_groups(given(), ["k"], None).collect()}
            assert len(found) == 10
            for key, (_, y, want) in groups.items():
                got = np.array([found[key, t] for t in range(y.shape[1])]).T
                assert np.allclose(got[:2], want[:2], atol=1e-9)
                if key != "none":
                    assert np.allclose(got[2], want[2], atol=1e-9) and (got[:, 2] == 0).all() and got[0, 0] > 0.5
        assert E.condensed(rows, ["k"]).count() < rows.count() / 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_grids_against_numpy(spark):
    rng = np.random.default_rng(1)
    t, v = np.sort(rng.uniform(0, 9.9, 12)), rng.normal(size=12)
    hz, n = 2.0, 20
    s = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, v, strict=True)], "k int, t double, v double")
    line = np.interp(np.arange(n) / hz, t, v, left=0, right=0)
    got = np.zeros(n)
    for r in T.interpolated(s, ["k"], "t", "v", hz, n).collect():
        got[r.bin] = r.x
    assert np.allclose(got, line)
    series = np.zeros(n)
    np.add.at(series, np.clip(np.round(t * hz), 0, n - 1).astype(int), 1)
    impulses = T.impulses(s, ["k"], "t", hz, n)
    assert {r.bin: r.x for r in impulses.collect()} == {i: x for i, x in enumerate(series) if x}
    kernel = [0.5, 0.3, -0.1]
    want = np.convolve(series, kernel)[np.round(np.arange(5) * 2.0 * hz).astype(int)]
    found = np.zeros(5)
    for r in T.convolved_at_scans(impulses, ["k"], kernel, hz, 2.0, 5).collect():
        found[r.scan] = r.y
    assert np.allclose(found, want)
    assert math.isclose(sum(T.double_gamma(10.0)), 1.0)


def test_sets(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string"), spark.createDataFrame([(2, "b"), (3, "b")], "k int, v string")
    assert sorted(tuple(r) for r in S.replace_by_key(old, new, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "b")]
    with pytest.raises(ValueError, match="duplicate"):
        S.require_unique(old.union(old), ["k"])
    with pytest.raises(ValueError, match="several"):
        S.require_one(old)
    with pytest.raises(Exception, match="scan counts differ"):
        S.consistent_counts(spark.createDataFrame([(1, 5), (1, 6)], "run int, scans int"), "run", "scans").collect()
    wide = S.padded(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>"), "v")
    assert sorted(r.v for r in wide.collect()) == [[1.0, 0.0], [1.0, 2.0]]


def test_iqr_outliers(spark):
    rows = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)], "x double")
    assert [r.x for r in I.iqr_outliers(rows, "x", []).where(F.col("is_outlier")).collect()] == [100.0]


def test_layer_permutation_draws(spark, monkeypatch):
    """The query leaves the operator's 10,000 draws as they are."""
    import inspect

    from strandline.operators import inference
    from strandline.plans import inference as plans

    used, whole = [], inference.layer_coupling
    monkeypatch.setattr(plans, "_curves", lambda spark, sf_dir: spark.createDataFrame([("en", k, float(k), float(k * k % 7)) for k in range(12)], "lang string, layer int, x double, y double"))
    monkeypatch.setattr(inference, "layer_coupling", lambda *a, **b: used.append((bound := inspect.signature(whole).bind(*a, **b)).apply_defaults() or bound.arguments["draws"]) or whole(*a, **b))
    assert plans.layer_permutation(spark, "").first().n == 12 and used == [10_000]
