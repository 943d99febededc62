"""Writers: contracts checked on write, key-replacing upserts, tables for people, resumable chunks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Table contracts, by name.
CONTRACTS = {
    "run_manifest": "subject_id string, language string, task_name string, original_run_label int, canonical_run_index int, n_volumes int, filepath string, space string, is_preproc boolean",
    "sentence_spans": "section bigint, sentence int, text string, onset double, offset double, n_words int",
    "vectors": "model string, language string, layer int, triplet_id bigint, vec array<float>",
    "features": "model string, language string, condition string, layer_index int, shuffle_index int, triplet_id bigint, vec array<double>",
    "permutations": "language string, shuffle int, section int, triplet_id bigint, permuted_triplet_id bigint",
    "subject_metrics": "subject bigint, language string, model string, layer int, layer_depth double, roi string, roi_family string, condition string, metric_name string, value double",
}


def empty(spark: SparkSession, contract: str) -> DataFrame:
    """A table of no rows with the contract's columns."""
    return spark.createDataFrame([], CONTRACTS[contract])


def checked(rows: DataFrame, contract: str) -> DataFrame:
    """The contract's columns in its order and types; raises if one is missing or of another kind."""
    want = T._parse_datatype_string(CONTRACTS[contract])
    have = dict(rows.dtypes)
    missing = [f.name for f in want if f.name not in have]
    if missing:
        raise ValueError(f"{contract} lacks {', '.join(missing)}")
    wrong = [f.name for f in want if have[f.name] != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"{contract} has other types in {', '.join(wrong)}")
    return rows.select(*[f.name for f in want])


def write_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that the rows touch (an upsert by the partition key)."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_table(rows: DataFrame, path: str, separator: str = ",") -> None:
    """One CSV (or TSV) file with a header, for a result people read; the rows are few."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def tagged(path: str, tag: str | None) -> str:
    """name__tag.ext"""
    if not tag:
        return path
    head, dot, end = path.rpartition(".")
    return f"{head}__{tag}.{end}" if dot and "/" not in end else f"{path}__{tag}"


def settings_row(spark: SparkSession, settings: dict) -> DataFrame:
    return spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "settings string")


def finished(spark: SparkSession, path: str, settings: dict, keys: list[str]) -> DataFrame | None:
    """Keys that a chunk table already holds, None when it does not exist; raises when it was made with other settings."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    made = spark.read.schema("settings string").json(f"{path}.settings")
    if [json.loads(r.settings) for r in made.collect()] != [settings]:
        raise ValueError("the existing chunk was made with other settings")
    return spark.read.parquet(path).select(*keys).distinct()


def append_missing(wanted: DataFrame, make, path: str, settings: dict, keys: list[str]) -> None:
    """Compute ``make(todo)`` for the wanted keys that the chunk table lacks and append it; safe to run again."""
    spark = wanted.sparkSession
    done = finished(spark, path, settings, keys)
    todo = wanted if done is None else wanted.join(done, keys, "left_anti")
    if done is None:
        settings_row(spark, settings).write.mode("overwrite").json(f"{path}.settings")
    make(todo).write.mode("append").parquet(path)


def exactly_one(rows: DataFrame, **key) -> DataFrame:
    """The rows of a key, checked to be there once (null means is null)."""
    for k, v in key.items():
        rows = rows.where(F.col(k).isNull() if v is None else F.col(k) == v)
    from strandline.operators.sets import require_one

    return require_one(rows, f"row for {key}")
