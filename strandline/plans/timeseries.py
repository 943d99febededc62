"""Time-series queries: ``events`` as irregular series, a day a run, on a half-hour grid with hourly scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.catalog import query
from strandline.functions.numbers import shown
from strandline.operators import timeseries as T
from strandline.plans import views

HZ, BINS, TR, SCANS = 1 / 1800, 48, 3600.0, 24
KERNEL = [0.05, 0.3, 0.35, 0.2, 0.1, -0.05]
KEYS = ["subject", "day"]
_W = f"WITH {views.SAMPLE_SQL}"
_H = f"{HZ!r}::DOUBLE"
_BIN = f"least(greatest(round_even(t * {_H}, 0), 0), {BINS - 1})::INT"
_IMPULSE = f"im AS (SELECT subject, day, {_BIN} AS bin, count(*)::DOUBLE AS x FROM sa GROUP BY ALL)"


@query(f"{_W}, {_IMPULSE} SELECT subject, day, bin, x FROM im")
def impulse_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.impulses(views.samples(spark, sf_dir), KEYS, "t", HZ, BINS)


_FIRST = f"least(greatest(floor(t * {_H}), 0), {BINS - 1})::BIGINT"


@query(f"""{_W}, f AS (SELECT subject, day, {_FIRST} a, t, value FROM sa), l AS (SELECT subject, day, a, least(greatest(ceil((t + value * 20) * {_H}), a + 1), {BINS})::BIGINT b FROM f)
SELECT DISTINCT subject, day, unnest(range(a, b))::INT AS bin, 1.0::DOUBLE AS x FROM l""")
def boxcar_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.boxcar(views.samples(spark, sf_dir), KEYS, F.col("t"), F.col("t") + F.col("value") * 20, HZ, BINS)


_INTERP = f"""s1 AS (SELECT subject, day, t, max(value) v FROM sa GROUP BY ALL), s2 AS (SELECT *, lead(t) OVER w t2, lead(v) OVER w v2 FROM s1 WINDOW w AS (PARTITION BY subject, day ORDER BY t)),
s3 AS (SELECT *, greatest(ceil(t * {_H}), 0)::BIGINT a, least(CASE WHEN t2 IS NULL THEN floor(t * {_H}) ELSE ceil(t2 * {_H}) - 1 END, {BINS - 1})::BIGINT b FROM s2),
ip AS (SELECT subject, day, bin::INT AS bin, v + CASE WHEN t2 IS NULL THEN 0 ELSE (bin / {_H} - t) / (t2 - t) * (v2 - v) END x FROM (SELECT *, unnest(range(a, b + 1)) bin FROM s3 WHERE a <= b))"""


@query(f"{_W}, {_INTERP} SELECT subject, day, bin, round(x, 6) + 0.0 AS x FROM ip")
def interp_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.interpolated(views.samples(spark, sf_dir), KEYS, "t", "value", HZ, BINS).select(*KEYS, "bin", shown("x").alias("x"))


_SCAN = f"sn AS (SELECT k::INT AS scan, round_even(k * {TR} * {_H}, 0)::INT AS pos FROM range({SCANS}) r(k))"


def _convolution_sql(series: str) -> str:
    return f"SELECT subject, day, scan, round(sum(x * h), 6) + 0.0 AS y FROM (SELECT *, unnest({KERNEL}::DOUBLE[]) h, bin + unnest(range({len(KERNEL)})) AS pos FROM {series}) c JOIN sn USING (pos) GROUP BY ALL"


@query(f"{_W}, {_IMPULSE}, {_SCAN} {_convolution_sql('im')}")
def hrf_convolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = T.impulses(views.samples(spark, sf_dir), KEYS, "t", HZ, BINS)
    return T.convolved_at_scans(series, KEYS, KERNEL, HZ, TR, SCANS).select(*KEYS, "scan", shown("y").alias("y"))


@query(f"{_W}, {_INTERP}, {_SCAN} {_convolution_sql('ip')}")
def continuous_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = T.interpolated(views.samples(spark, sf_dir), KEYS, "t", "value", HZ, BINS)
    return T.convolved_at_scans(series, KEYS, KERNEL, HZ, TR, SCANS).select(*KEYS, "scan", shown("y").alias("y"))


@query(f"SELECT s.k::INT AS scan, h.k::INT AS k, round(cos(pi() * (s.k + 0.5) * h.k / {SCANS}), 6) + 0.0 AS basis FROM range({SCANS}) s(k), range(1, 5) h(k)")
def highpass_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = spark.range(SCANS).select(F.col("id").cast("int").alias("scan"))
    return T.highpass(scans, "scan", F.lit(SCANS), TR, 2 * SCANS * TR / 4).select("scan", "k", shown("basis").alias("basis"))


@query(f"SELECT k::INT AS scan, 1.0::DOUBLE AS intercept, round(-1 + 2 * k / {SCANS - 1}.0::DOUBLE, 6) + 0.0 AS linear_trend FROM range({SCANS}) r(k)")
def nuisance_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(SCANS).select(F.col("id").cast("int").alias("scan"), F.lit(1.0).alias("intercept"), shown(-1 + 2 * F.col("id") / F.lit(SCANS - 1.0)).alias("linear_trend"))


_COUNTS = f"ct AS (SELECT subject, day, least(floor(t / {TR}), {SCANS - 1})::INT scan, count(*)::DOUBLE x, avg(value) v FROM sa GROUP BY ALL)"


def _by_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = F.least(F.floor(F.col("t") / TR), F.lit(SCANS - 1)).cast("int")
    return views.samples(spark, sf_dir).groupBy(*KEYS, scan.alias("scan")).agg(F.count("*").cast("double").alias("x"), F.avg("value").alias("v"))


@query(f"""{_W}, {_COUNTS} SELECT subject, day, scan, x AS lag0, coalesce(lag(x, 1) OVER w, 0) AS lag1, coalesce(lag(x, 2) OVER w, 0) AS lag2, coalesce(lag(x, 3) OVER w, 0) AS lag3 FROM ct WINDOW w AS (PARTITION BY subject, day ORDER BY scan)""")
def fir_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lagged(_by_scan(spark, sf_dir), KEYS, "scan", "x", 4).select(*KEYS, "scan", "lag0", "lag1", "lag2", "lag3")


@query(f"""{_W}, {_COUNTS} SELECT subject, day, scan, round(CASE WHEN stddev_pop(v) OVER w > 1e-6 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w ELSE 0 END, 6) + 0.0 AS z FROM ct WINDOW w AS (PARTITION BY subject, day)""")
def zscore_within_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.zscored(_by_scan(spark, sf_dir), KEYS, "v").select(*KEYS, "scan", shown("z").alias("z"))


@query(f"{_W} SELECT subject, day, least(greatest(round_even(t / {TR}, 0), 0), {SCANS - 1})::INT AS scan, count(*) AS onsets FROM sa GROUP BY ALL")
def nearest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir).groupBy(*KEYS, T.grid_bin(F.col("t"), 1 / TR, SCANS).alias("scan")).agg(F.count("*").alias("onsets"))


@query(f"""WITH {views.SPAN_SQL}, d AS (SELECT "offset" - onset x FROM sp) SELECT least(floor(x / 0.5) + 1, 30)::BIGINT AS bin, count(*) AS n FROM d WHERE x BETWEEN 0 AND 15 GROUP BY ALL""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.spans(spark, sf_dir).select((F.col("offset") - F.col("onset")).alias("x"))
    return d.select(T.histogram_bin(F.col("x"), 0.0, 15.0, 30).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


@query(f"""WITH {views.SPAN_SQL}, f AS (SELECT section, idx, onset, "offset", least(greatest(floor(onset * 2), 0), 79)::BIGINT a FROM sp), g AS (SELECT section, idx, a, least(greatest(ceil("offset" * 2), a + 1), 80)::BIGINT b FROM f)
SELECT section, idx, a::INT AS first_bin, (b - 1)::INT AS last_bin, b - a AS n_bins FROM g""")
def sentence_basis_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = T.interval_bins(views.spans(spark, sf_dir), F.col("onset"), F.col("offset"), 2.0, 80)
    return bins.groupBy("section", "idx").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.count("*").alias("n_bins"))


@query(f"""WITH {views.SPAN_SQL}, {views.VEC_SQL}, f AS (SELECT section, idx, least(greatest(floor(onset * 2), 0), 79)::BIGINT a, "offset" FROM sp), g AS (SELECT section, idx, a, least(greatest(ceil("offset" * 2), a + 1), 80)::BIGINT b FROM f),
c AS (SELECT section, idx, unnest(range(a, b)) AS bin FROM g), k AS (SELECT count(DISTINCT triplet) s FROM v), j AS (SELECT section, bin, (section + idx) % (SELECT s FROM k) triplet FROM c)
SELECT section, bin::INT AS bin, lang, place::INT AS place, round(sum(x), 6) + 0.0 AS x FROM (SELECT section, bin, lang, unnest(vec) x, unnest(range(len(vec))) place FROM j JOIN v USING (triplet)) GROUP BY ALL""")
def sentence_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of each sentence joined with the sentence's vectors in all languages, summed over the sentences of a bin at every place."""
    v = views.vectors(spark, sf_dir)
    size = F.broadcast(v.agg(F.count_distinct("triplet").alias("s")))
    spans = views.spans(spark, sf_dir).join(size).withColumn("triplet", (F.col("section") + F.col("idx")) % F.col("s"))
    spans = T.interval_ends(spans, F.col("onset"), F.col("offset"), 2.0, 80).select("section", "sl_first", "sl_last", "triplet")
    rows = T.summed_over_bins(spans.join(v, "triplet"), ["section", "lang"], "vec", 80)
    return rows.select("section", "bin", "lang", F.posexplode("x").alias("place", "x")).select("section", "bin", "lang", "place", shown("x").alias("x"))


_BOX = f"""bf AS (SELECT subject, day, {_FIRST} a, t, value FROM sa), bl AS (SELECT subject, day, a, least(greatest(ceil((t + value * 20) * {_H}), a + 1), {BINS})::BIGINT b FROM bf),
bx AS (SELECT DISTINCT subject, day, unnest(range(a, b))::INT AS bin, 1.0::DOUBLE AS x FROM bl)"""


def _column_sql(series: str, name: str) -> str:
    return f"{name} AS (SELECT subject, day, scan, sum(x * h) AS y FROM (SELECT *, unnest({KERNEL}::DOUBLE[]) h, bin + unnest(range({len(KERNEL)})) AS pos FROM {series}) c JOIN sn USING (pos) GROUP BY ALL)"


@query(f"""{_W}, {_IMPULSE}, {_INTERP}, {_BOX}, {_SCAN}, {_column_sql('im', 'c1')}, {_column_sql('ip', 'c2')}, {_column_sql('bx', 'c3')}, g AS (SELECT DISTINCT subject, day FROM sa)
SELECT g.subject, g.day, sn.scan, 1.0::DOUBLE AS intercept, round(-1 + 2 * sn.scan / {SCANS - 1}.0::DOUBLE, 6) + 0.0 AS linear_trend,
  round(coalesce(c1.y, 0), 6) + 0.0 AS word_rate, round(coalesce(c2.y, 0), 6) + 0.0 AS intensity, round(coalesce(c3.y, 0), 6) + 0.0 AS block
FROM g, sn LEFT JOIN c1 ON c1.subject = g.subject AND c1.day = g.day AND c1.scan = sn.scan LEFT JOIN c2 ON c2.subject = g.subject AND c2.day = g.day AND c2.scan = sn.scan
LEFT JOIN c3 ON c3.subject = g.subject AND c3.day = g.day AND c3.scan = sn.scan""")
def nuisance_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.by_series(views.samples(spark, sf_dir), KEYS)
    parts = {
        "word_rate": T.impulses(s, KEYS, "t", HZ, BINS), "intensity": T.interpolated(s, KEYS, "t", "value", HZ, BINS),
        "block": T.boxcar(s, KEYS, F.col("t"), F.col("t") + F.col("value") * 20, HZ, BINS),
    }
    out = T.nuisance_frame(s, KEYS, parts, KERNEL, HZ, TR, SCANS)
    return out.select(*KEYS, "scan", "intercept", *[shown(c).alias(c) for c in ("linear_trend", "word_rate", "intensity", "block")])
