"""Aggregates of long metric tables: subject, lang, layer, layer_depth, roi, roi_family, condition, z, r, r2.

``layer_depth`` is null for rows without a layer; grouping by it drops those
rows, as a data-frame library that ignores missing keys would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.numbers import effect_size, standard_error

MID = (0.33, 0.83)
CONDITIONS = ["raw", "shared", "specific", "full", "mismatched_shared"]


def mid_layer(depth: Column | None = None) -> Column:
    """The middle band, both ends included; a null depth is outside."""
    return (F.col("layer_depth") if depth is None else depth).between(*MID)


def group_results(m: DataFrame, keys: list[str]) -> DataFrame:
    """Means of r, z, r2, standard error of z and number of subjects in one pass."""
    grouped = m.where(F.col("layer_depth").isNotNull()).groupBy(*keys)
    return grouped.agg(F.avg("r").alias("mean_r"), F.avg("z").alias("mean_z"), standard_error("z").alias("se_z"), F.avg("r2").alias("mean_r2"), F.count_distinct("subject").alias("n_subjects"))


def condition_means(m: DataFrame, keys: list[str], value: str = "z") -> DataFrame:
    """One column for each condition, the mean of its rows; null where it has none."""
    return m.groupBy(*keys).pivot("condition", CONDITIONS).agg(F.avg(value))


def with_delta(wide: DataFrame, a: str = "shared", b: str = "specific") -> DataFrame:
    return wide.withColumn("delta", F.col(a) - F.col(b))


def two_level_mean(m: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """Mean over cells of the cells' means (cells count equally, whatever they hold)."""
    cells = m.groupBy(*outer, *inner).agg(F.avg(value).alias("cell"))
    return cells.groupBy(*outer).agg(F.avg("cell").alias("mean_of_means"), F.count("*").alias("n_cells"))


def subject_deltas(m: DataFrame) -> DataFrame:
    """subject, lang, roi_family, delta = shared - specific over the middle band."""
    return with_delta(condition_means(m.where(mid_layer()), ["subject", "lang", "roi_family"])).where("delta is not null").select("subject", "lang", "roi_family", "delta")


def semantic_minus_auditory(deltas: DataFrame) -> DataFrame:
    """One row a subject that has both families: a pivot instead of a self-join."""
    wide = deltas.groupBy("subject", "lang").pivot("roi_family", ["semantic", "auditory"]).agg(F.avg("delta"))
    return wide.where("semantic is not null and auditory is not null").withColumn("difference", F.col("semantic") - F.col("auditory"))


def effects(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, standard error, Cohen's dz and count."""
    return values.groupBy(*keys).agg(F.avg(value).alias("mean"), standard_error(value).alias("se"), effect_size(value).alias("dz"), F.count("*").alias("n"))


def best_row(rows: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("place = 1").drop("place")


def covered_means(m: DataFrame, cell: list[str], subjects: int, fraction: float, value: str) -> DataFrame:
    """Mean of a cell's subject means, null under a coverage of ceil(fraction * subjects)."""
    need = max(1, int(-(-fraction * subjects // 1)))
    per = m.groupBy(*cell, "subject").agg(F.avg(value).alias("v"))
    return per.groupBy(*cell).agg(F.count("*").alias("coverage"), F.avg("v").alias("v")).select(*cell, "coverage", F.when(F.col("coverage") >= need, F.col("v")).alias("covered_mean"))


def with_baseline(rows: DataFrame, keys: list[str], value: str, baseline: Column) -> DataFrame:
    """Every row with the mean of its group's baseline rows, and the difference."""
    base = rows.where(baseline).groupBy(*keys).agg(F.avg(value).alias("baseline"))
    return rows.where(~baseline).join(base, keys, "left").withColumn("over_baseline", F.col(value) - F.col("baseline"))
