"""Writers and file readers round trip: tables go out in the study's formats and come back."""

from __future__ import annotations

import gzip
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.catalog import query
from strandline.sources import readers as R
from strandline.sources import sinks as K
from strandline.sources.scratch import put, scratch
from strandline.plans import views


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 2 THEN 'new' ELSE 'old' END AS origin, n_regionkey FROM nation")
def partition_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table partitioned by key; writing one key's rows again replaces these only."""
    path = scratch(spark)
    n = views.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    K.write_partitions(n.withColumn("origin", F.lit("old")), path, ["n_regionkey"])
    K.write_partitions(n.where("n_regionkey = 2").withColumn("origin", F.lit("new")), path, ["n_regionkey"])
    return spark.read.parquet(path).select("n_nationkey", "n_name", "origin", "n_regionkey")


@query("SELECT r_regionkey, r_name, s.k AS sep FROM region, (SELECT unnest(['comma', 'tab']) k) s")
def table_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV and TSV with a header, under a tagged name."""
    out = None
    for name, sep in (("comma", ","), ("tab", "\t")):
        path = K.tagged(f"{scratch(spark)}.csv", name)
        K.write_table(views.table(spark, sf_dir, "region"), path, sep)
        back = spark.read.option("header", True).option("sep", sep).schema("r_regionkey int, r_name string").csv(path).withColumn("sep", F.lit(name))
        out = back if out is None else out.unionByName(back)
    return out


@query("SELECT c_custkey, c_nationkey FROM customer")
def resumable_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk table filled in two runs with the same settings: what is there is not made again."""
    path, c = scratch(spark), views.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    K.append_missing(c.where("c_custkey % 3 = 0").select("c_custkey"), lambda todo: c.join(todo, "c_custkey", "left_semi"), path, {"v": 1}, ["c_custkey"])
    K.append_missing(c.select("c_custkey"), lambda todo: c.join(todo, "c_custkey", "left_semi"), path, {"v": 1}, ["c_custkey"])
    return spark.read.parquet(path)


@query("SELECT vec_id AS triplet_id, label AS layer_index, round(list_sum(embedding::DOUBLE[]), 5) + 0.0 AS total FROM embeddings WHERE label = (SELECT min(label) FROM embeddings)")
def manifest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written layer by layer with a manifest; one layer is found by its manifest row, which must be there once."""
    path, e = scratch(spark), views.table(spark, sf_dir, "embeddings")
    least = e.agg(F.min("label")).first()[0]
    K.write_partitions(e.select(F.col("vec_id").alias("triplet_id"), F.col("label").alias("layer_index"), F.transform("embedding", lambda x: x.cast("double")).alias("vec")), path, ["layer_index"])
    manifest = e.select(F.col("label").alias("layer_index"), F.lit(None).cast("int").alias("shuffle_index")).distinct().withColumn("path", F.concat(F.lit(f"{path}/layer_index="), F.col("layer_index").cast("string")))
    row = K.exactly_one(manifest, layer_index=least, shuffle_index=None).first()
    rows = spark.read.parquet(row["path"])
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return rows.select("triplet_id", F.lit(least).alias("layer_index"), (F.round(total, 5) + 0.0).alias("total"))


@query("SELECT n_name || 'é' AS text, count(*) AS n FROM nation GROUP BY ALL")
def encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each nation, in four encodings by turns."""
    path, codes = scratch(spark), ["utf-8-sig", "utf-16", "utf-8", "latin-1"]
    for r in views.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():
        put(spark, f"{path}/{r.n_nationkey}.txt", f"{r.n_name}é".encode(codes[r.n_nationkey % 4]))
    return R.read_texts(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey::BIGINT AS key, n_name || ', \"' || chr(10) || 'é' AS name, n_regionkey + 0.5::DOUBLE AS half FROM nation")
def encoded_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files in two encodings whose quoted fields hold commas, quotes and line breaks; types are inferred."""
    path = scratch(spark)
    rows = views.table(spark, sf_dir, "nation").collect()
    for k, code in enumerate(("utf-16", "utf-8")):
        lines = [f'{r.n_nationkey},"{r.n_name}, ""\né",{r.n_regionkey + 0.5}' for r in rows if r.n_nationkey % 2 == k]
        put(spark, f"{path}/{k}.csv", "\n".join(["key,name,half", *lines, ""]).encode(code))
    return R.read_decoded_csv(spark, path)


@query("SELECT n_regionkey AS region, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS sentence, ['a', lower(n_name), 'b'] AS tokens FROM nation")
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed trees, one a line, blank lines between: their leaves in order."""
    path = scratch(spark)
    for key, part in views.table(spark, sf_dir, "nation").orderBy("n_nationkey").toPandas().groupby("n_regionkey"):
        put(spark, f"{path}/{key}.txt", "\n\n".join(f"(S (X a) (NP (N {name.lower()})) (Y b))" for name in part["n_name"]).encode())
    trees = R.read_trees(spark, path)
    return trees.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("int").alias("region"), "sentence", "tokens")


@query("SELECT n_nationkey AS file, n_nationkey + 3 AS n_volumes, ((n_regionkey + 1) * 6)::BIGINT AS n_voxels FROM nation")
def volume_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes in both byte orders, packed and plain: sizes from their headers."""
    path = scratch(spark)
    for r in views.table(spark, sf_dir, "nation").collect():
        order, content = "<>"[r.n_nationkey % 2], bytearray(352)
        struct.pack_into(f"{order}i", content, 0, 348)
        struct.pack_into(f"{order}8h", content, 40, 4, r.n_regionkey + 1, 2, 3, r.n_nationkey + 3, 1, 1, 1)
        struct.pack_into(f"{order}h", content, 70, 16)
        put(spark, f"{path}/{r.n_nationkey}.nii", gzip.compress(bytes(content)) if r.n_nationkey % 3 else bytes(content))
    return R.read_nifti_headers(spark, path).select(F.regexp_extract("path", r"(\d+)\.nii$", 1).cast("int").alias("file"), "n_volumes", "n_voxels")
