"""Set operations, upserts, guards and progress over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key ``new`` does not have, and all rows of ``new`` (missing columns are null)."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def keep_last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order (descending columns first)."""
    return rows.withColumn("sl_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("sl_n = 1").drop("sl_n")


def duplicated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; raises when a key has more than one."""
    if duplicated_keys(rows, keys).limit(1).count():
        raise ValueError(f"duplicate rows for the key {', '.join(keys)}")
    return rows


def require_one(rows: DataFrame, what: str = "row") -> DataFrame:
    """The rows; raises unless there is exactly one."""
    if (n := len(rows.limit(2).take(2))) != 1:
        raise ValueError(f"expected one {what}, found {'none' if not n else 'several'}")
    return rows


def included_subjects(runs: DataFrame, template: DataFrame, subject: str, run: str, scans: str, tolerance: int = 1) -> DataFrame:
    """included: every run of the template present, all exact or just one off by at most ``tolerance``."""
    expected = F.broadcast(template.select(run, F.col(scans).alias("sl_expected")))
    need = template.count()
    joined = runs.join(expected, run).withColumn("sl_off", F.abs(F.col(scans) - F.col("sl_expected")))
    out = joined.groupBy(subject).agg(F.count_distinct(run).alias("n_runs"), F.count_if(F.col("sl_off") != 0).alias("n_off"), F.max("sl_off").alias("max_off"))
    return out.withColumn("included", (F.col("n_runs") == need) & ((F.col("n_off") == 0) | ((F.col("n_off") == 1) & (F.col("max_off") <= tolerance))))


def consistent_counts(rows: DataFrame, run: str, scans: str) -> DataFrame:
    """run, the count all subjects share; raises on use when subjects differ."""
    both = rows.groupBy(run).agg(F.min(scans).alias(scans), F.max(scans).alias("sl_most"))
    return both.withColumn("sl_ok", F.assert_true(F.col(scans) == F.col("sl_most"), F.lit("scan counts differ"))).where("sl_ok is null").drop("sl_most", "sl_ok")


def progress(wanted: DataFrame, done: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """status of each wanted key: not_started, partial or complete."""
    counted = done.groupBy(*keys).agg(F.count("*").alias("n_done"))
    n = F.coalesce("n_done", F.lit(0))
    status = F.when(n == 0, "not_started").when(n < expected, "partial").otherwise("complete")
    return wanted.join(counted, keys, "left").withColumns({"n_done": n, "status": status})


def aligned_union(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union by column name; a column that a frame lacks is 0 there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.fillna(0, [c for c in out.columns if c not in keys])


def padded(rows: DataFrame, vector: str) -> DataFrame:
    """Vectors extended with zeros to the longest one's length."""
    widest = F.broadcast(rows.agg(F.max(F.size(vector)).alias("sl_w")))
    return rows.join(widest).withColumn(vector, F.concat(vector, F.array_repeat(F.lit(0.0), (F.col("sl_w") - F.size(vector)).cast("int")))).drop("sl_w")
