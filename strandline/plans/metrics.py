"""Metric-table queries over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.catalog import query
from strandline.functions.numbers import shown
from strandline.operators import metrics as M
from strandline.plans import views

_M = f"WITH {views.METRIC_SQL}"
_MID = "layer_depth BETWEEN 0.33 AND 0.83"
_WIDE = ", ".join(f"avg(z) FILTER (condition = '{c}') AS {c}" for c in M.CONDITIONS)
_DELTAS = f"dl AS (SELECT subject, lang, roi_family, avg(z) FILTER (condition = 'shared') - avg(z) FILTER (condition = 'specific') delta FROM m WHERE {_MID} GROUP BY ALL HAVING delta IS NOT NULL)"
_R = "round({0}, 6) + 0.0 AS {1}"


def _shown(df: DataFrame, keys: list[str], *values: str) -> DataFrame:
    return df.select(*keys, *[shown(v).alias(v) for v in values])


@query(f"""{_M} SELECT lang, layer, roi, condition, {_R.format("avg(r)", "mean_r")}, {_R.format("avg(z)", "mean_z")}, {_R.format("coalesce(stddev_samp(z) / sqrt(count(z)), 0)", "se_z")},
  {_R.format("avg(r2)", "mean_r2")}, count(DISTINCT subject) AS n_subjects FROM m WHERE layer_depth IS NOT NULL GROUP BY ALL""")
def group_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.group_results(views.metrics(spark, sf_dir), ["lang", "layer", "layer_depth", "roi", "condition"])
    return _shown(out, ["lang", "layer", "roi", "condition", "n_subjects"], "mean_r", "mean_z", "se_z", "mean_r2")


@query(f"{_M} SELECT lang, condition, {_R.format('avg(z)', 'mean_z')}, count(*) AS n FROM m WHERE {_MID} GROUP BY ALL")
def mid_layer_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.metrics(spark, sf_dir).where(M.mid_layer()).groupBy("lang", "condition").agg(shown(F.avg("z")).alias("mean_z"), F.count("*").alias("n"))


@query(f"{_M} SELECT subject, lang, {', '.join(_R.format(f'avg(z) FILTER (condition = {c!r})', c) for c in M.CONDITIONS)} FROM m GROUP BY ALL")
def condition_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(M.condition_means(views.metrics(spark, sf_dir), ["subject", "lang"]), ["subject", "lang"], *M.CONDITIONS)


@query(f"{_M}, {_DELTAS} SELECT lang, roi_family, {_R.format('avg(delta)', 'mean_delta')}, count(*) AS n FROM dl GROUP BY ALL")
def family_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.subject_deltas(views.metrics(spark, sf_dir)).groupBy("lang", "roi_family").agg(shown(F.avg("delta")).alias("mean_delta"), F.count("*").alias("n"))


@query(f"""{_M}, c AS (SELECT lang, layer, roi, avg(z) cell FROM m WHERE roi_family = 'semantic' GROUP BY ALL)
SELECT lang, {_R.format("avg(cell)", "mean_of_means")}, count(*) AS n_cells FROM c GROUP BY lang""")
def two_level_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metrics(spark, sf_dir).where("roi_family = 'semantic'")
    return _shown(M.two_level_mean(m, ["lang"], ["layer", "roi"], "z"), ["lang", "n_cells"], "mean_of_means")


@query(f"""{_M}, {_DELTAS} SELECT s.subject, s.lang, {_R.format("s.delta", "semantic")}, {_R.format("a.delta", "auditory")}, {_R.format("s.delta - a.delta", "difference")}
FROM dl s JOIN dl a ON s.subject = a.subject AND s.lang = a.lang AND s.roi_family = 'semantic' AND a.roi_family = 'auditory'""")
def semantic_minus_auditory(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.semantic_minus_auditory(M.subject_deltas(views.metrics(spark, sf_dir)))
    return _shown(out, ["subject", "lang"], "semantic", "auditory", "difference")


@query(f"""{_M}, {_DELTAS} SELECT lang, roi_family, {_R.format("avg(delta)", "mean")}, {_R.format("coalesce(stddev_samp(delta) / sqrt(count(*)), 0)", "se")},
  {_R.format("CASE WHEN coalesce(stddev_samp(delta), 0) <= 1e-12 THEN 0 ELSE avg(delta) / stddev_samp(delta) END", "dz")}, count(*) AS n FROM dl GROUP BY ALL""")
def effect_size_dz(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.effects(M.subject_deltas(views.metrics(spark, sf_dir)), ["lang", "roi_family"], "delta")
    return _shown(out, ["lang", "roi_family", "n"], "mean", "se", "dz")


_LAYER_DELTA = f"ld AS (SELECT lang, layer, avg(z) FILTER (condition = 'shared') - avg(z) FILTER (condition = 'specific') delta FROM m WHERE {_MID} AND roi_family = 'semantic' GROUP BY ALL)"


@query(f"{_M}, {_LAYER_DELTA} SELECT lang, layer, {_R.format('delta', 'delta')} FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY delta DESC, layer) k FROM ld) WHERE k = 1")
def representative_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metrics(spark, sf_dir).where(M.mid_layer()).where("roi_family = 'semantic'")
    best = M.best_row(M.with_delta(M.condition_means(m, ["lang", "layer"])), ["lang"], [F.desc("delta"), F.asc("layer")])
    return _shown(best, ["lang", "layer"], "delta")


@query(f"""{_M}, p AS (SELECT roi, lang, subject, avg(z) v FROM m GROUP BY ALL), n AS (SELECT greatest(1, ceil(0.9 * max(c)))::BIGINT need FROM (SELECT count(DISTINCT subject) c FROM m GROUP BY lang))
SELECT roi, lang, count(*) AS coverage, CASE WHEN count(*) >= max(need) THEN round(avg(v), 6) + 0.0 END AS covered_mean FROM p, n GROUP BY roi, lang""")
def coverage_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metrics(spark, sf_dir)
    subjects = m.groupBy("lang").agg(F.count_distinct("subject").alias("n")).agg(F.max("n")).first()[0] or 0
    return _shown(M.covered_means(m, ["roi", "lang"], subjects, 0.9, "z"), ["roi", "lang", "coverage"], "covered_mean")


@query(f"""{_M}, g AS (SELECT lang, layer, layer_depth, condition, avg(z) z FROM m GROUP BY ALL), b AS (SELECT lang, avg(z) baseline FROM g WHERE layer_depth IS NULL GROUP BY lang)
SELECT lang, layer, condition, {_R.format("z", "z")}, {_R.format("baseline", "baseline")}, {_R.format("z - baseline", "over_baseline")} FROM g LEFT JOIN b USING (lang) WHERE layer_depth IS NOT NULL""")
def acoustic_baseline_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.metrics(spark, sf_dir).groupBy("lang", "layer", "layer_depth", "condition").agg(F.avg("z").alias("z"))
    return _shown(M.with_baseline(g, ["lang"], "z", F.col("layer_depth").isNull()), ["lang", "layer", "condition"], "z", "baseline", "over_baseline")


@query(f"""{_M}, g AS (SELECT lang, layer, roi, {_WIDE} FROM m WHERE layer_depth IS NOT NULL GROUP BY ALL), b AS (SELECT lang, avg(z) base FROM m WHERE layer_depth IS NULL GROUP BY lang)
SELECT lang, bool_or(raw > base) AS raw_over_acoustic, bool_or(shared > mismatched_shared) AS shared_over_mismatched FROM g JOIN b USING (lang) GROUP BY lang""")
def stage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metrics(spark, sf_dir)
    base = m.where("layer_depth is null").groupBy("lang").agg(F.avg("z").alias("base"))
    wide = M.condition_means(m.where("layer_depth is not null"), ["lang", "layer", "roi"]).join(F.broadcast(base), "lang")
    return wide.groupBy("lang").agg(F.bool_or(F.col("raw") > F.col("base")).alias("raw_over_acoustic"), F.bool_or(F.col("shared") > F.col("mismatched_shared")).alias("shared_over_mismatched"))


@query(f"""{_M} SELECT subject, lang, roi, metric, {_R.format("avg(v)", "value")} FROM (SELECT subject, lang, roi, unnest(['r', 'z', 'r2']) metric, unnest([r, z, r2]) v FROM m) GROUP BY ALL""")
def metric_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = views.metrics(spark, sf_dir).unpivot(["subject", "lang", "roi"], ["r", "z", "r2"], "metric", "v")
    return long.groupBy("subject", "lang", "roi", "metric").agg(shown(F.avg("v")).alias("value"))


@query(f"""{_M}, s AS (SELECT lang, subject, count(DISTINCT layer) n_layers, count(*) n_rows FROM m GROUP BY ALL)
SELECT lang, count(*) AS n_subjects, round(median(n_rows), 2) AS median_rows, round(median(n_layers), 2) AS median_layers, round(sum(n_rows) * 2 / 60.0::DOUBLE, 4) AS minutes FROM s GROUP BY lang""")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.metrics(spark, sf_dir).groupBy("lang", "subject").agg(F.count_distinct("layer").alias("n_layers"), F.count("*").alias("n_rows"))
    return s.groupBy("lang").agg(
        F.count("*").alias("n_subjects"), F.round(F.median("n_rows"), 2).alias("median_rows"), F.round(F.median("n_layers"), 2).alias("median_layers"), F.round(F.sum("n_rows") * 2 / F.lit(60.0), 4).alias("minutes")
    )


@query(f"""{_M} SELECT condition, count(DISTINCT layer) AS n_layers, max(layer) AS last_layer, count(DISTINCT roi) AS n_rois, {_R.format("avg(z)", "mean_z")}, {_R.format("min(z)", "min_z")}, {_R.format("max(z)", "max_z")} FROM m GROUP BY condition""")
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.metrics(spark, sf_dir).groupBy("condition").agg(
        F.count_distinct("layer").alias("n_layers"), F.max("layer").alias("last_layer"), F.count_distinct("roi").alias("n_rois"), shown(F.avg("z")).alias("mean_z"), shown(F.min("z")).alias("min_z"), shown(F.max("z")).alias("max_z")
    )


@query(f"""{_M}, g AS (SELECT lang, roi, roi_family, {_WIDE} FROM m WHERE {_MID} GROUP BY ALL)
SELECT lang, roi_family, count(*) AS n_rois, sum((shared > mismatched_shared)::INT)::BIGINT AS n_positive, string_agg(roi::VARCHAR, ',' ORDER BY roi) FILTER (shared <= mismatched_shared) AS failures FROM g GROUP BY ALL""")
def sign_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = M.condition_means(views.metrics(spark, sf_dir).where(M.mid_layer()), ["lang", "roi", "roi_family"])
    failed = F.when(F.col("shared") <= F.col("mismatched_shared"), F.col("roi"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(failed)), lambda x: x.cast("string")), ",")
    return wide.groupBy("lang", "roi_family").agg(F.count("*").alias("n_rois"), F.sum((F.col("shared") > F.col("mismatched_shared")).cast("long")).alias("n_positive"), F.nullif(listed, F.lit("")).alias("failures"))
