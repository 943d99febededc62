"""Views of the driver's tables that stand in for the study's objects, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import vectors as V

LAYERS, WIDTH = 4, 16
CONDITIONS = {"view": "raw", "click": "shared", "signup": "specific", "purchase": "full", "error": "mismatched_shared"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang (0..2), triplet, vec: whole embeddings of complete triplets."""
    e = table(spark, sf_dir, "embeddings")
    complete = F.broadcast(e.agg(F.floor(F.count("*") / 3).alias("s")))
    v = e.select((F.col("vec_id") % 3).cast("int").alias("lang"), F.floor(F.col("vec_id") / 3).alias("triplet"), V.as_double(F.col("embedding")).alias("vec"))
    return v.join(complete, F.col("triplet") < F.col("s")).drop("s")


def layer_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, triplet, layer (0..3), vec: slices of 16, normalised."""
    layers = F.explode(F.sequence(F.lit(0), F.lit(LAYERS - 1)))
    v = vectors(spark, sf_dir).select("lang", "triplet", "vec", layers.alias("layer"))
    return v.select("lang", "triplet", "layer", V.normalised(F.slice("vec", F.col("layer") * WIDTH + 1, WIDTH)).alias("vec"))


def family(roi: Column) -> Column:
    return F.when(roi < 8, "semantic").when(roi < 14, "auditory").otherwise("control")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, lang, layer, layer_depth, roi, roi_family, condition, z, r, r2: one row an event; depth is null for the layerless rows (layer 12)."""
    e = table(spark, sf_dir, "events")
    mapped = F.create_map(*[F.lit(x) for kv in CONDITIONS.items() for x in kv])
    layer, roi = F.col("event_id") % 13, F.col("event_id") % 18
    z = F.col("value") / 487.31 - 0.1
    return e.select(
        F.col("user_id").alias("subject"), (F.col("user_id") % 3).cast("int").alias("lang"), layer.cast("int").alias("layer"),
        F.when(layer < 12, layer / F.lit(11.0)).alias("layer_depth"), roi.cast("int").alias("roi"), family(roi).alias("roi_family"),
        mapped[F.col("event_type")].alias("condition"), z.alias("z"), F.tanh(z).alias("r"), (F.tanh(z) * F.tanh(z)).alias("r2"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """section, idx (0-based), role, text, onset, offset (seconds): a turn is a sentence, a conversation a section."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("section"), F.col("turn").cast("int").alias("idx"), "role", "text",
        (F.col("turn") * 4.0).alias("onset"), (F.col("turn") * 4.0 + 1.0 + F.length("text") / 100).alias("offset"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, run (day of 2024-01 mod 9), t (seconds from the run's first midnight), value: irregular samples."""
    e = table(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', cast(ts as timestamp_ntz))")
    day = F.floor(micros / 86_400_000_000)
    return e.select(F.col("user_id").alias("subject"), (day % 9).cast("int").alias("run"), day.alias("day"), (micros / 1e6 - day * 86400).alias("t"), "value", "event_id", "event_type")


VEC_SQL = "v AS (SELECT (vec_id % 3)::INT lang, vec_id // 3 triplet, embedding::DOUBLE[] vec FROM embeddings WHERE vec_id // 3 < (SELECT count(*) // 3 FROM embeddings))"
LAYER_SQL = VEC_SQL + """,
sl AS (SELECT lang, triplet, k::INT layer, vec[16*k+1:16*k+16] s FROM v, range(4) t(k)),
lv AS (SELECT lang, triplet, layer, list_transform(s, lambda x: x / greatest(sqrt(list_inner_product(s, s)), 1e-12)) vec FROM sl)"""
METRIC_SQL = """m AS (SELECT user_id subject, (user_id % 3)::INT lang, (event_id % 13)::INT layer,
  CASE WHEN event_id % 13 < 12 THEN (event_id % 13) / 11.0::DOUBLE END layer_depth, (event_id % 18)::INT roi,
  CASE WHEN event_id % 18 < 8 THEN 'semantic' WHEN event_id % 18 < 14 THEN 'auditory' ELSE 'control' END roi_family,
  CASE event_type WHEN 'view' THEN 'raw' WHEN 'click' THEN 'shared' WHEN 'signup' THEN 'specific' WHEN 'purchase' THEN 'full' ELSE 'mismatched_shared' END condition,
  value / 487.31 - 0.1 z, tanh(value / 487.31 - 0.1) r, tanh(value / 487.31 - 0.1) * tanh(value / 487.31 - 0.1) r2 FROM events)"""
SPAN_SQL = "sp AS (SELECT conv_id section, turn::INT idx, role, text, turn * 4.0::DOUBLE onset, turn * 4.0::DOUBLE + 1.0 + length(text) / 100 \"offset\" FROM conversations)"
SAMPLE_SQL = """sa AS (SELECT user_id subject, (day % 9)::INT run, day, us / 1e6 - day * 86400 t, value, event_id, event_type
  FROM (SELECT *, us // 86400000000 AS day FROM (SELECT *, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') us FROM events)))"""
PAIRS = [(0, 1), (0, 2), (1, 2)]
