"""Encoding queries: ``embeddings`` as features of a language's scans, runs of nine sections, targets mixed from the features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.catalog import query
from strandline.functions import vectors as V
from strandline.functions.numbers import shown
from strandline.operators import encoding as E
from strandline.operators import geometry as G
from strandline.plans import views
from strandline.plans.geometry import _permutations

PLAIN, SHUFFLES = ("raw", "shared", "specific", "full"), 5


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, layer, condition, shuffle, run, scan, x, nuisance, y: three targets that depend on the shared part more and more."""
    parts = G.decompose(views.layer_vectors(spark, sf_dir), ["layer"])
    rows = parts.withColumn("run", (F.col("triplet") % 9 + 1).cast("int")).withColumn("scan", F.floor(F.col("triplet") / 9).cast("int"))
    noise = V.dot(F.slice("raw", 1, 4), F.slice("specific", 5, 4))
    y = F.array(*[F.col("shared")[k] * k + F.col("specific")[k] * 0.3 + noise for k in range(3)])
    nuisance = F.array(F.lit(1.0), F.col("scan") / 100.0, F.cos(F.pi() * (F.col("scan") + 0.5) / 40))
    rows = rows.withColumn("y", y).withColumn("nuisance", nuisance)
    plain = F.create_map(*[x for c in PLAIN for x in (F.lit(c), F.col(c))])
    kept = rows.select("lang", "layer", F.explode(plain).alias("condition", "x"), F.lit(0).alias("shuffle"), "run", "scan", "nuisance", "y")
    shared = parts.select("lang", "layer", F.col("triplet").alias("permuted"), F.col("shared").alias("x"))
    moved = _permutations(spark, sf_dir, SHUFFLES).join(shared, ["lang", "permuted"]).select("lang", "layer", "triplet", F.lit("mismatched_shared").alias("condition"), "shuffle", "x")
    return kept.unionByName(moved.join(rows.select("lang", "layer", "triplet", "run", "scan", "nuisance", "y"), ["lang", "layer", "triplet"]).drop("triplet"))


@query()
def ridge_encode_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every condition; those of mismatched vectors are means over the shuffles."""
    group = ["lang", "layer", "condition", "shuffle"]
    out = E.encode_groups(E.condensed(_scans(spark, sf_dir), group), group, ["t0", "t1", "t2"])
    keys = ["lang", "layer", "condition", "target"]
    return E.shuffle_average(out, keys).select(*keys, *[shown(c, 4).alias(c) for c in ("r", "z", "r2")])


_M = f"WITH {views.METRIC_SQL}"


@query(f"""{_M} SELECT lang, roi, condition, round(tanh(avg(atanh(least(greatest(r, -0.999999), 0.999999)))), 6) + 0.0 AS r, round(avg(z), 6) + 0.0 AS z, round(avg(r2), 6) + 0.0 AS r2 FROM m GROUP BY ALL""")
def shuffle_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.shuffle_average(views.metrics(spark, sf_dir), ["lang", "roi", "condition"]).select("lang", "roi", "condition", *[shown(c).alias(c) for c in ("r", "z", "r2")])


@query("SELECT k::INT AS place, round(pow(10, -2 + 8 * k / 14.0::DOUBLE), 6) AS alpha FROM range(15) t(k)")
def alpha_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(15).select(F.col("id").cast("int").alias("place"), F.round(F.pow(F.lit(10.0), -2 + 8 * F.col("id") / F.lit(14.0)), 6).alias("alpha"))
