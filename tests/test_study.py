"""The study's pipeline against NumPy, its resumption, and the checks of loads and merges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import names as N
from strandline.operators import encoding as E
from strandline.operators import guards as C
from strandline.operators import study as D
from strandline.operators import timeseries as T
from strandline.operators.alignment import Section, cost_between, span_cost
from strandline.sources import readers as R

KERNEL = [0.1, 0.4, 0.3, 0.2]
RUNS, SCANS = 3, 14


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(4)
    spans = [(0, r, 10 * r + i, 3.0 * i, 3.0 * i + 2.5) for r in range(RUNS) for i in range(8)]
    vectors = {t: rng.normal(size=5) for *_, t, _, _ in [(s[0], s[1], s[2], 0, 0) for s in spans]}
    features = [(0, c, 1, 0, t, (v * k).tolist()) for c, k in (("shared", 1.0), ("specific", -0.5)) for t, v in vectors.items()]
    frame = [(0, r, s, 1.0, s / SCANS, float(np.sin(s)), float(np.cos(s * 2))) for r in range(RUNS) for s in range(SCANS)]
    return (
        spark.createDataFrame(spans, "lang int, run int, triplet int, onset double, offset double"),
        spark.createDataFrame(features, "lang int, condition string, layer int, shuffle int, triplet int, vec array<double>"),
        spark.createDataFrame(frame, "lang int, run int, scan int, intercept double, trend double, rms double, pitch double"),
        spans, vectors,
    )


def _dense(spans, vectors):
    """Designs of every run by loops: boxcars, convolution, samples, product."""
    out = {}
    for r in range(RUNS):
        basis = np.zeros((SCANS, len(vectors)))
        for k, t in enumerate(vectors):
            for _, run, triplet, a, b in spans:
                if (run, triplet) == (r, t):
                    box = np.zeros(40)
                    box[int(np.floor(a)) : int(np.ceil(b))] = 1
                    full = np.convolve(box, KERNEL)
                    basis[:, k] = [full[2 * s] if 2 * s < len(full) else 0 for s in range(SCANS)]
        out[r] = basis @ np.stack(list(vectors.values()))
    return out


def _designs(parts):
    spans, features = parts[:2]
    weights = D.sentence_weights(spans, ["lang", "run"], "triplet", KERNEL, 1.0, 40, 2.0, SCANS)
    return D.design(weights, features, "lang", ["run"], "triplet", ["condition", "layer", "shuffle"], SCANS)


def _targets(spark):
    rng = np.random.default_rng(9)
    y = rng.normal(size=(RUNS, SCANS, 2, 3))
    rows = [(0, r, s, u, v, float(y[r, s, u, v])) for r in range(RUNS) for s in range(SCANS) for u in range(2) for v in range(3)]
    return y, spark.createDataFrame(rows, "lang int, run int, scan int, subject int, roi int, value double")


def test_design(parts):
    want = _dense(parts[3], parts[4])
    rows = _designs(parts).where("condition = 'shared'").collect()
    assert len(rows) == RUNS * SCANS
    for r in rows:
        assert np.allclose(r.x, want[r.run][r.scan])


def test_metrics_equal_a_direct_fit(spark, parts):
    """Units side by side in chunks of four give what each alone gives."""
    want, (y, targets) = _dense(parts[3], parts[4]), _targets(spark)
    frame = parts[2]
    found = D.study_metrics(_designs(parts), frame, targets, "lang", "run", ["subject", "roi"], size=4).collect()
    assert len(found) == 3 * 6 and {r.layer for r in found if r.condition == "acoustic_only"} == {None}
    table = {(r["run"], r["scan"]): r for r in frame.collect()}
    keys = [(r, s) for r in range(RUNS) for s in range(SCANS)]
    z = np.array([[table[k][c] for c in ("intercept", "pitch", "rms", "trend")] for k in keys])
    x = np.concatenate([want[r] for r in range(RUNS)])
    runs = np.array([r for r, _ in keys])
    flat = y.reshape(RUNS * SCANS, 6)
    for condition, xs, zs in (("shared", x, z), ("specific", -0.5 * x, z), ("acoustic_only", z[:, [2, 1]], z[:, [0, 3]])):
        r, zz, r2 = E.encode(xs, flat, zs, runs)
        for row in (f for f in found if f.condition == condition):
            k = row.subject * 3 + row.roi
            assert np.allclose([row.r, row.z, row.r2], [r[k], zz[k], r2[k]], atol=1e-8)


def test_study_resumes(spark, parts, tmp_path):
    _, targets = _targets(spark)
    designs, path = _designs(parts), f"{tmp_path}/metrics"
    D.run_study(designs.where("condition = 'shared'"), parts[2], targets, path, {"layers": [1]})
    first = spark.read.parquet(path).count()
    D.run_study(designs, parts[2], targets, path, {"layers": [1]})
    rows = spark.read.parquet(path)
    assert first == 6 and rows.count() == 12 and rows.select("condition", "subject", "roi").distinct().count() == 12
    with pytest.raises(ValueError, match="other settings"):
        D.run_study(designs, parts[2], targets, path, {"layers": [2]})


def test_fir_and_nuisance_modes(parts):
    rows = D.fir_design(_designs(parts), ["lang", "condition", "layer", "shuffle", "run"], 3).where("condition = 'shared' and run = 1").orderBy("scan").collect()
    dense = _dense(parts[3], parts[4])[1]
    assert np.allclose(rows[0].x, [*dense[0], *[0] * 10]) and np.allclose(rows[5].x, np.concatenate([dense[5], dense[4], dense[3]]))
    sizes = {m: len(D.nuisance_vector(parts[2], ["lang", "run"], m).first().nuisance) for m in D.MODES}
    assert sizes == {"full": 4, "no_acoustic": 2, "no_pitch": 3}


def test_cells_and_summary(spark):
    deltas = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", -1.0), ("b", -2.0)], "cell string, delta double")
    found = D.cells(deltas, ["cell"], "delta", 200).withColumn("setting", F.lit("s"))
    by = {r.cell: r for r in found.collect()}
    assert by["a"].positive and not by["b"].positive and by["a"].mean == 2.5 and by["a"].n == 4 and by["a"].ci_low <= 2.5 <= by["a"].ci_high
    assert tuple(D.robustness_summary(found).first()) == ("s", 2, 1, "b")


def test_convolution_at_any_step(spark):
    """Convolution by reached scans equals a dense one, also where scans fall between bins."""
    rng = np.random.default_rng(2)
    bins = sorted(rng.choice(60, 20, replace=False).tolist())
    series = spark.createDataFrame([(0, b, float(b % 7)) for b in bins], "k int, bin int, x double")
    for hz, tr, n in ((2.0, 1.7, 16), (1.0, 0.4, 90), (0.5, 30.0, 3)):
        got = {r.scan: r.y for r in T.convolved_at_scans(series, ["k"], KERNEL, hz, tr, n).collect()}
        x = np.zeros(64)
        x[bins] = [b % 7 for b in bins]
        full = np.convolve(x, KERNEL)
        for s in range(n):
            at = int(np.round(s * tr * hz))  # halves to even
            assert abs(got.get(s, 0.0) - (full[at] if at < len(full) else 0.0)) < 1e-12


def test_tables_of_span_costs():
    rng = np.random.default_rng(1)
    a, b = (Section([f"{'x' * int(k)}{'.?'[int(k) % 2]}" for k in rng.integers(1, 30, n)], rng.normal(size=(n, 6))) for n in (5, 4))
    for p, q in ((1, 1), (1, 2), (2, 1), (2, 2), (3, 2)):
        for i in range(5 - p + 1):
            for j in range(4 - q + 1):
                assert np.allclose(cost_between(a, i, p, b, j, q), span_cost(a.span(i, p), b.span(j, q)))


def test_checked_loads(spark):
    rows = spark.createDataFrame([("xlmr", 1, "a"), ("xlmr", 2, "b"), ("nllb_encoder", 1, "c")], "model string, k int, v string")
    assert C.of_model(rows, "xlmr").count() == 2
    for call in (lambda: C.of_model(rows, "other"), lambda: C.runs_of_subject(rows, "k", 9, "v"), lambda: C.usable_first(rows, F.lit(True), "k", 4), lambda: C.merge_chunks([rows, rows], ["model", "k"]), lambda: C.merge_chunks([rows], ["k", "model"], "xlmr"), lambda: C.require_complete(rows, ["model"], "k", [1, 2])):
        with pytest.raises(ValueError):
            call()
    assert C.require_complete(rows.where("model = 'xlmr'"), ["model"], "k", [1, 2]).count() == 2
    with pytest.raises(Exception, match="no name"):
        C.joined_with_dimension(rows, spark.createDataFrame([(1, "one")], "k int, name string"), ["k"], "name").collect()
    triplets = spark.createDataFrame([("direct",)] * 99 + [("needs_fix",)], "source string")
    assert C.require_resolved(triplets).count() == 100
    with pytest.raises(ValueError, match="unresolved"):
        C.require_resolved(triplets.limit(0).unionAll(triplets.where("source = 'needs_fix'")))
    with pytest.raises(ValueError, match="labelled"):
        C.regions_of(C.voxel_places(spark.createDataFrame([(1, 0)], "v int, label int"), "v", (1, 2, 3), [(1.0, 0, 0, 0)] * 3), "label")


def test_names():
    assert N.split_option(" a, b,,a ") == ("a", "b", "a") and N.split_option(None) == ()
    assert N.model_name("NLLB") == "nllb_encoder" and N.checked_names(["raw", "raw"], N.CONDITIONS, "condition") == ["raw"]
    for call in (lambda: N.model_name("x"), lambda: N.checked_names([], N.CONDITIONS, "condition")):
        with pytest.raises(ValueError):
            call()


def test_two_vectors_of_one_triplet_raise(spark):
    from strandline.operators import geometry as G

    rows = [(k, 0, [1.0, 0.0]) for k in range(3)] + [(1, 0, [0.0, 1.0])]
    with pytest.raises(Exception, match="two vectors"):
        G.side_by_side(spark.createDataFrame(rows, "lang int, triplet int, vec array<double>"), []).collect()


def test_csv_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('n,t\n1,"two\nlines, ""q"""\n2,\n'.encode("utf-16"))
    assert [tuple(r) for r in R.read_decoded_csv(spark, str(tmp_path / "a.csv")).orderBy("n").collect()] == [(1, 'two\nlines, "q"'), (2, None)]
    assert [tuple(r) for r in R.read_decoded_csv(spark, str(tmp_path / "a.csv"), "n string, t string").orderBy("n").collect()] == [("1", 'two\nlines, "q"'), ("2", None)]


def test_a_spread_of_exactly_the_limit_is_masked(spark, tmp_path):
    """Whatever the order of its rows; a spread just over it is not."""
    from strandline.plans import guards

    tie = [13, 42, 32, 11, 21, 42, 7, 25, 32, 34, 22, 40, 48, 7, 33, 28, 25, 36, 31, 44, 44, 5, 17, 5, 1]
    rows = [(k, float(q)) for k in range(25) for q in tie[k:] + tie[:k]] + [(99, float(q)) for q in [*tie[:-1], 0]]
    spark.createDataFrame(rows, "l_partkey bigint, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in [*range(25), 99, 100]], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    found = {r.voxel: (r.is_masked, r.value) for r in guards.masked_scatter(spark, str(tmp_path)).collect()}
    assert found == {**dict.fromkeys([*range(25), 100], (True, 0.0)), 99: (False, 25.76)}


def test_nuisance_frame_holds_a_series_a_row(spark):
    """Columns equal dense convolutions, a series without regressors or name has zeros, and nothing is grouped by scan."""
    bins = [(0, 1, 2.0), (0, 5, 1.0), (0, 15, 4.0), (1, 0, 3.0)]
    grid, every = spark.createDataFrame([*bins, (None, 3, 5.0)], "k int, bin int, x double"), spark.createDataFrame([(0,), (1,), (2,), (None,), (0,)], "k int")
    out = T.nuisance_frame(every, ["k"], {"a": grid, "b": grid.where("k = 1")}, KERNEL, 1.0, 2.0, 8)
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "pivotfirst" not in plan and "join" not in plan
    rows = {(r.k, r.scan): r for r in out.collect()}
    assert sorted(rows, key=str) == sorted([(k, s) for k in (0, 1, 2, None) for s in range(8)], key=str)
    for k in (0, 1, 2, None):
        x = np.zeros(16)
        for _, b, v in (c for c in bins if c[0] == k):
            x[b] = v
        want = np.convolve(x, KERNEL)[:16:2]
        assert np.allclose([rows[k, s].a for s in range(8)], want) and np.allclose([rows[k, s].b for s in range(8)], want * (k == 1))
        assert [round(rows[k, s].linear_trend * 7) for s in range(8)] == list(range(-7, 8, 2))


def test_vectors_are_summed_before_bins_become_rows(spark):
    rows = [(0, 0, 2, [1.0, 2.0]), (0, 2, 3, [0.5, -1.0]), (1, 5, 5, [3.0, None])]
    frame = spark.createDataFrame(rows, "k int, sl_first int, sl_last int, vec array<double>")
    out = T.summed_over_bins(frame, ["k"], "vec", 6)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.index("Generate") < plan.index("Aggregate")  # bins come after the only grouping
    assert {(r.k, r.bin): r.x for r in out.collect()} == {(0, 0): [1, 2], (0, 1): [1, 2], (0, 2): [1.5, 1], (0, 3): [0.5, -1], (1, 5): [3, None]}


def test_designs_are_added_up_over_batches(spark, parts):
    """No task gets the whole of a feature table: batches of three sentences give the dense design."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = _designs(parts)
        assert "CoGroup" not in out._jdf.queryExecution().optimizedPlan().toString()
        want = _dense(parts[3], parts[4])
        rows = out.collect()
        assert len(rows) == 2 * RUNS * SCANS
        for r in rows:
            assert np.allclose(r.x, want[r.run][r.scan] * (1.0 if r.condition == "shared" else -0.5))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
