"""The data frames behind the study's figures, over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.catalog import query
from strandline.functions.numbers import shown
from strandline.operators import metrics as M
from strandline.plans import views
from strandline.plans.metrics import _DELTAS, _M, _MID


@query(f"{_M} SELECT condition, layer, round(layer_depth, 6) AS layer_depth, round(avg(z), 6) + 0.0 AS z, count(*) AS n FROM m WHERE layer_depth IS NOT NULL GROUP BY condition, layer, layer_depth")
def metric_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metrics(spark, sf_dir).where("layer_depth is not null")
    return m.groupBy("condition", "layer", "layer_depth").agg(shown(F.avg("z")).alias("z"), F.count("*").alias("n")).withColumn("layer_depth", F.round("layer_depth", 6))


@query(f"""{_M}, {_DELTAS}, l AS (SELECT unnest([2, 0, 1]) lang, unnest([0, 1, 2]) place) SELECT l.place::INT AS place, l.lang, roi_family, round(avg(delta), 6) + 0.0 AS mean FROM l LEFT JOIN dl ON dl.lang = l.lang GROUP BY ALL""")
def effects_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects reindexed to a fixed order of languages; one without data keeps its place."""
    listed = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "place int, lang int")
    means = M.subject_deltas(views.metrics(spark, sf_dir)).groupBy("lang", "roi_family").agg(shown(F.avg("delta")).alias("mean"))
    return listed.join(means, "lang", "left").select("place", "lang", "roi_family", "mean")


@query(f"{_M} SELECT roi, layer, condition, round(avg(z), 6) + 0.0 AS z FROM m WHERE roi IN (0, 8) AND layer_depth IS NOT NULL GROUP BY ALL")
def layer_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metrics(spark, sf_dir).where(F.col("roi").isin(0, 8) & F.col("layer_depth").isNotNull())
    return m.groupBy("roi", "layer", "condition").agg(shown(F.avg("z")).alias("z"))


@query(f"{_M} SELECT roi, condition, round(avg(z), 6) + 0.0 AS z FROM m WHERE {_MID} AND roi IN (0, 1, 2, 8, 9, 14) AND condition <> 'full' GROUP BY ALL")
def region_condition_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = ["raw", "shared", "specific", "mismatched_shared"]
    m = views.metrics(spark, sf_dir).where(M.mid_layer() & F.col("roi").isin(0, 1, 2, 8, 9, 14))
    long = M.condition_means(m, ["roi"]).select("roi", *four).unpivot(["roi"], four, "condition", "z")
    return long.where("z is not null").select("roi", "condition", shown("z").alias("z"))


@query(f"""{_M}, g AS (SELECT roi, avg(z) FILTER (condition = 'shared') v, avg(z) FILTER (condition = 'shared') - avg(z) FILTER (condition = 'specific') d FROM m GROUP BY roi)
SELECT round(greatest(max(v), 0.05), 6) AS value_limit, round(greatest(max(abs(d)), 0.03), 6) AS delta_limit, round(quantile_cont(v, 0.99) FILTER (v > 0), 6) AS p99 FROM g""")
def colour_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = M.with_delta(M.condition_means(views.metrics(spark, sf_dir), ["roi"]))
    p99 = F.percentile(F.when(F.col("shared") > 0, F.col("shared")), F.lit(0.99))
    return g.agg(F.round(F.greatest(F.max("shared"), F.lit(0.05)), 6).alias("value_limit"), F.round(F.greatest(F.max(F.abs("delta")), F.lit(0.03)), 6).alias("delta_limit"), F.round(p99, 6).alias("p99"))


@query(f"""{_M}, {_DELTAS} SELECT roi_family, round(avg(delta) FILTER (lang = 0), 6) + 0.0 AS lang0, round(avg(delta) FILTER (lang = 1), 6) + 0.0 AS lang1, round(avg(delta) FILTER (lang = 2), 6) + 0.0 AS lang2 FROM dl GROUP BY roi_family""")
def heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = M.subject_deltas(views.metrics(spark, sf_dir)).groupBy("roi_family").pivot("lang", [0, 1, 2]).agg(F.avg("delta"))
    return wide.select("roi_family", *[shown(F.col(str(k))).alias(f"lang{k}") for k in range(3)])


@query(f"""{_M}, g AS (SELECT roi, round(avg(z), 6) + 0.0 AS value FROM m GROUP BY roi) SELECT p_partkey AS voxel, (p_partkey % 20)::INT AS roi, value FROM part LEFT JOIN g ON g.roi = p_partkey % 20""")
def region_to_voxel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's value at each of its voxels; voxels of no region are null."""
    g = views.metrics(spark, sf_dir).groupBy("roi").agg(shown(F.avg("z")).alias("value"))
    voxels = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("voxel"), (F.col("p_partkey") % 20).cast("int").alias("roi"))
    return voxels.join(F.broadcast(g), "roi", "left").select("voxel", "roi", "value")


@query("""WITH v AS (SELECT l_partkey voxel, l_linenumber run, count(*) n, stddev_pop(l_quantity) sd FROM lineitem GROUP BY ALL) SELECT voxel, count(*) AS n_runs, bool_and(sd > 1e-6) AS valid FROM v GROUP BY voxel""")
def valid_voxel_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels that vary in every run they have."""
    v = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("voxel"), "l_linenumber").agg(F.stddev_pop("l_quantity").alias("sd"))
    return v.groupBy("voxel").agg(F.count("*").alias("n_runs"), F.bool_and(F.col("sd") > 1e-6).alias("valid"))


@query("""WITH z AS (SELECT l_partkey voxel, l_linenumber run, l_orderkey scan, l_quantity q, avg(l_quantity) OVER w m, stddev_pop(l_quantity) OVER w sd FROM lineitem WINDOW w AS (PARTITION BY l_partkey, l_linenumber))
SELECT (voxel % 18)::INT AS roi, run, count(*) AS n, round(avg((q - m) / sd), 6) + 0.0 AS mean_z, round(max((q - m) / sd), 6) + 0.0 AS max_z FROM z WHERE sd > 1e-6 GROUP BY ALL""")
def region_mean_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_partkey", "l_linenumber")
    z = views.table(spark, sf_dir, "lineitem").withColumn("sd", F.stddev_pop("l_quantity").over(w)).withColumn("m", F.avg("l_quantity").over(w)).where("sd > 1e-6")
    z = z.withColumn("z", (F.col("l_quantity") - F.col("m")) / F.col("sd"))
    return z.groupBy((F.col("l_partkey") % 18).cast("int").alias("roi"), F.col("l_linenumber").alias("run")).agg(F.count("*").alias("n"), shown(F.avg("z")).alias("mean_z"), shown(F.max("z")).alias("max_z"))


@query("SELECT (p_partkey % 10)::INT AS label, CASE WHEN p_size % 2 = 0 THEN 'L' ELSE 'R' END AS hemisphere, count(*) AS n_voxels FROM part WHERE p_partkey % 10 <> 0 GROUP BY ALL")
def atlas_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part").where("p_partkey % 10 <> 0")
    return p.groupBy((F.col("p_partkey") % 10).cast("int").alias("label"), F.when(F.col("p_size") % 2 == 0, "L").otherwise("R").alias("hemisphere")).agg(F.count("*").alias("n_voxels"))
