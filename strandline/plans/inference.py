"""Inference queries over ``events``; resampling ones are seeded by group and have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.catalog import query
from strandline.functions.numbers import safe_corr, shown
from strandline.operators import inference as I
from strandline.operators import metrics as M
from strandline.plans import views
from strandline.plans.metrics import _DELTAS, _LAYER_DELTA, _M, _MID

#: A p for each (lang, roi): a smooth function of the mean, so that both engines agree.
_P = f"pv AS (SELECT lang, roi, round(1 / (1 + exp(20 * avg(z))), 9) p FROM m WHERE {_MID} GROUP BY ALL)"


def _p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.metrics(spark, sf_dir).where(M.mid_layer()).groupBy("lang", "roi").agg(F.avg("z").alias("z"))
    return g.select("lang", "roi", F.round(1 / (1 + F.exp(20 * F.col("z"))), 9).alias("p"))


@query(f"""{_M}, {_P}, s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) * p step FROM pv)
SELECT lang, roi, p, round(least(max(step) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING), 1), 8) AS p_holm FROM s""")
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.holm(_p_values(spark, sf_dir), "p", []).select("lang", "roi", "p", F.round("p_holm", 8).alias("p_holm"))


@query(f"""{_M}, {_P}, s AS (SELECT *, p * count(*) OVER (PARTITION BY lang) / row_number() OVER (PARTITION BY lang ORDER BY p) step FROM pv)
SELECT lang, roi, p, round(least(min(step) OVER (PARTITION BY lang ORDER BY p DESC RANGE UNBOUNDED PRECEDING), 1), 8) AS q_fdr FROM s""")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.benjamini_hochberg(_p_values(spark, sf_dir), "p", ["lang"]).select("lang", "roi", "p", F.round("q_fdr", 8).alias("q_fdr"))


_CURVES = "cv AS (SELECT lang, layer, round(avg(z) FILTER (roi_family = 'semantic'), 9) x, round(avg(z) FILTER (roi_family = 'auditory'), 9) y FROM m WHERE layer_depth IS NOT NULL GROUP BY ALL)"


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metrics(spark, sf_dir).where("layer_depth is not null")
    return m.groupBy("lang", "layer").agg(F.round(F.avg(F.when(F.col("roi_family") == "semantic", F.col("z"))), 9).alias("x"), F.round(F.avg(F.when(F.col("roi_family") == "auditory", F.col("z"))), 9).alias("y"))


@query(f"""{_M}, {_CURVES}, rk AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2.0::DOUBLE a, rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2.0::DOUBLE b FROM cv)
SELECT lang, round(CASE WHEN var_pop(a) <= 0 OR var_pop(b) <= 0 THEN 0 ELSE least(greatest(corr(a, b), -0.999999), 0.999999) END, 6) + 0.0 AS rho, count(*) AS n FROM rk GROUP BY lang""")
def spearman_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.spearman(_curves(spark, sf_dir), "x", "y", ["lang"]).select("lang", shown("rho").alias("rho"), "n")


@query(f"{_M} SELECT lang, condition, round(avg(atanh(least(greatest(r, -0.999999), 0.999999))), 6) + 0.0 AS mean_z, round(tanh(avg(atanh(least(greatest(r, -0.999999), 0.999999)))), 6) + 0.0 AS mean_r FROM m GROUP BY ALL")
def fisher_z_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.fisher_mean(views.metrics(spark, sf_dir), ["lang", "condition"], "r").select("lang", "condition", shown("mean_z").alias("mean_z"), shown("mean_r").alias("mean_r"))


@query(f"{_M} SELECT lang, roi, round(CASE WHEN coalesce(var_pop(z), 0) <= 0 OR coalesce(var_pop(layer), 0) <= 0 THEN 0 ELSE least(greatest(corr(z, layer), -0.999999), 0.999999) END, 6) + 0.0 AS r, count(*) AS n FROM m GROUP BY ALL")
def pearson_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metrics(spark, sf_dir).withColumn("x", F.col("layer").cast("double"))
    return m.groupBy("lang", "roi").agg(shown(safe_corr("z", "x")).alias("r"), F.count("*").alias("n"))


@query(f"""{_M}, q AS (SELECT lang, quantile_cont(z, 0.25) a, quantile_cont(z, 0.75) b FROM m GROUP BY lang)
SELECT lang, condition, count(*) AS n, sum((z < a - 1.5 * (b - a) OR z > b + 1.5 * (b - a))::INT)::BIGINT AS n_outliers FROM m JOIN q USING (lang) GROUP BY ALL""")
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = I.iqr_outliers(views.metrics(spark, sf_dir), "z", ["lang"])
    return flagged.groupBy("lang", "condition").agg(F.count("*").alias("n"), F.sum(F.col("is_outlier").cast("long")).alias("n_outliers"))


@query(f"{_M} SELECT lang, round(regr_slope(z, layer_depth), 6) + 0.0 AS slope, round(regr_intercept(z, layer_depth), 6) + 0.0 AS intercept FROM m WHERE layer_depth IS NOT NULL GROUP BY lang")
def ols_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metrics(spark, sf_dir).where("layer_depth is not null")
    return m.groupBy("lang").agg(shown(F.regr_slope("z", "layer_depth")).alias("slope"), shown(F.regr_intercept("z", "layer_depth")).alias("intercept"))


@query(f"""{_M}, f AS (SELECT lang, roi, z y, avg(z) OVER (PARTITION BY lang, roi, layer) fitted FROM m)
SELECT lang, roi, round(CASE WHEN sum(y * y) - sum(y) * sum(y) / count(*) <= 0 THEN 0 ELSE 1 - sum((y - fitted) * (y - fitted)) / (sum(y * y) - sum(y) * sum(y) / count(*)) END, 6) + 0.0 AS r2, count(*) AS n FROM f GROUP BY ALL""")
def pooled_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metrics(spark, sf_dir)
    fitted = m.groupBy("lang", "roi", "layer").agg(F.avg("z").alias("fitted"))
    return I.pooled_r2(m.join(fitted, ["lang", "roi", "layer"]), "z", "fitted", ["lang", "roi"]).select("lang", "roi", shown("r2").alias("r2"), "n")


@query(f"""{_M}, {_CURVES}, {_LAYER_DELTA} SELECT lang, layer, round(x, 6) + 0.0 AS geometry, round(delta, 6) + 0.0 AS brain FROM cv JOIN ld USING (lang, layer)""")
def coupling_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metrics(spark, sf_dir).where(M.mid_layer()).where("roi_family = 'semantic'")
    brain = M.with_delta(M.condition_means(m, ["lang", "layer"])).select("lang", "layer", "delta")
    return _curves(spark, sf_dir).join(brain, ["lang", "layer"]).select("lang", "layer", shown("x").alias("geometry"), shown("delta").alias("brain"))


@query()
def sign_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = M.subject_deltas(views.metrics(spark, sf_dir))
    return I.resampled(deltas, ["lang", "roi_family"], "delta").select("lang", "roi_family", "n", shown("mean").alias("mean"), shown("p_perm").alias("p_perm"))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = M.subject_deltas(views.metrics(spark, sf_dir))
    return I.resampled(deltas, ["lang", "roi_family"], "delta").select("lang", "roi_family", "n", shown("ci_low").alias("ci_low"), shown("ci_high").alias("ci_high"))


@query()
def layer_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.layer_coupling(_curves(spark, sf_dir), ["lang"], "layer", "x", "y").select("lang", "n", shown("rho").alias("rho"), shown("p_perm").alias("p_perm"))


@query()
def confirmatory_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both hypotheses of every language (the shared part helps; more so in semantic regions), Holm over all rows."""
    deltas = M.subject_deltas(views.metrics(spark, sf_dir))
    first = deltas.where("roi_family = 'semantic'").select("lang", F.lit("H1").alias("hypothesis"), F.col("delta").alias("value"))
    second = M.semantic_minus_auditory(deltas).select("lang", F.lit("H2").alias("hypothesis"), F.col("difference").alias("value"))
    values = first.unionByName(second)
    out = I.resampled(values, ["lang", "hypothesis"], "value").join(M.effects(values, ["lang", "hypothesis"], "value").drop("mean", "n"), ["lang", "hypothesis"])
    out = I.holm(out, "p_perm", [])
    return out.select("lang", "hypothesis", "n", *[shown(c).alias(c) for c in ("mean", "se", "dz", "p_perm", "ci_low", "ci_high", "p_holm")])


@query()
def roi_condition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's condition means over the middle band, shared - specific with its p, and q within the language."""
    m = views.metrics(spark, sf_dir).where(M.mid_layer())
    subject = M.with_delta(M.condition_means(m, ["subject", "lang", "roi"]))
    tested = I.resampled(subject.where("delta is not null"), ["lang", "roi"], "delta", bootstraps=1).select("lang", "roi", "n", "mean", "p_perm")
    means = subject.groupBy("lang", "roi").agg(*[F.avg(c).alias(c) for c in M.CONDITIONS])
    out = I.benjamini_hochberg(means.join(tested, ["lang", "roi"]), "p_perm", ["lang"])
    return out.select("lang", "roi", "n", *[shown(c).alias(c) for c in (*M.CONDITIONS, "mean", "p_perm", "q_fdr")])


@query(f"{_M}, {_DELTAS} SELECT lang, roi_family, count(*) AS n, sum((delta > 0)::INT)::BIGINT AS n_positive FROM dl GROUP BY ALL")
def delta_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.subject_deltas(views.metrics(spark, sf_dir)).groupBy("lang", "roi_family").agg(F.count("*").alias("n"), F.sum((F.col("delta") > 0).cast("long")).alias("n_positive"))
