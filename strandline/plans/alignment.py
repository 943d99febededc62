"""Alignment queries: a conversation is a section, its turns are dealt to three sides; vectors come from ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.catalog import query
from strandline.functions.numbers import shown
from strandline.operators import alignment as A
from strandline.operators import text as T
from strandline.plans import views
from strandline.plans.text_order import _PUNCT
from strandline.sources.scratch import scratch


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a sentence of each side, with that side's vector; side 1 lacks the last turn of sections of four or more."""
    c = views.table(spark, sf_dir, "conversations").withColumn("n", F.count("*").over(Window.partitionBy("conv_id"))).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(2))))
    c = c.where(~((F.col("side") == 1) & (F.col("n") >= 4) & (F.col("turn") == F.col("n") - 1)))
    e = views.table(spark, sf_dir, "embeddings")
    size = F.broadcast(e.agg(F.count("*").alias("s")))
    keyed = c.join(size).withColumn("vec_id", (F.col("conv_id") * 7 + F.col("turn") + F.col("side") % 2) % F.col("s"))
    v = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return keyed.join(v, "vec_id").select(F.col("conv_id").alias("section"), "side", F.col("turn").cast("int").alias("idx"), "text", "vec")


@query(f"""WITH k AS (SELECT conv_id, turn, text, (conv_id * 7 + turn) % (SELECT count(*) FROM embeddings) AS vec_id FROM conversations),
c AS (SELECT conv_id, turn, length(trim(text)) chars, {_PUNCT} punct, embedding::DOUBLE[] vec FROM k JOIN embeddings USING (vec_id))
SELECT a.conv_id, a.turn, round((1.0 * (1 - least(greatest(list_inner_product(a.vec, b.vec), -1), 1)) + 0.25 * abs(ln((a.chars + 1) / (b.chars + 1))) + 0.10 * (a.punct <> b.punct)::INT) * (1 + 1) / 2 + 0.10 * 0, 6) + 0.0 AS cost
FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def pair_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.trim("text")).alias("chars"), T.punct_class(F.col("text")).alias("punct"))
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    size = F.broadcast(e.agg(F.count("*").alias("s")))
    c = c.join(size).withColumn("vec_id", (F.col("conv_id") * 7 + F.col("turn")) % F.col("s")).join(e, "vec_id")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.withColumns({"chars2": F.lead("chars").over(w), "punct2": F.lead("punct").over(w), "vec2": F.lead("vec").over(w)}).where("chars2 is not null")
    cost = A.pair_cost(A.cosine_of(F.col("vec"), F.col("vec2")), T.log_ratio(F.col("chars"), F.col("chars2")), F.col("punct") != F.col("punct2"), F.lit(1), F.lit(1))
    return pairs.select("conv_id", "turn", shown(cost).alias("cost"))


@query()
def pairwise_dp_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.align_pairs(_sentences(spark, sf_dir)).withColumn("cost", shown("cost"))


@query()
def triplet_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = A.align_sections(_sentences(spark, sf_dir)), scratch(spark)
    rows.write.parquet(path)  # read twice below, aligned once
    rows = spark.read.parquet(path)
    flagged = A.flag_ratio_outliers(rows.withColumn("note", F.lit("")), ["char_ratio1", "char_ratio2"])
    return flagged.select("section", "triplet", "start0", "start1", "start2", "pattern", "source", shown("mean_similarity").alias("mean_similarity"), shown("max_cost").alias("max_cost"), "needs_review", "note")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is a section of its own here."""
    c = views.table(spark, sf_dir, "conversations")
    tokens = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return c.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("section"), F.posexplode(tokens).alias("idx", "token"))


@query()
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each turn with intervals that lack every eleventh word and have marks split off."""
    words = _words(spark, sf_dir)
    timed = words.where("idx % 11 <> 10").select("section", "idx", F.regexp_replace("token", "[.,]$", "").alias("token"), (F.col("idx") * 0.5).alias("onset"), (F.col("idx") * 0.5 + 0.4).alias("offset"))
    return A.align_token_sections(words, timed)


@query()
def sentence_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of eight words as trees, cut back out of each turn's timed words."""
    words = _words(spark, sf_dir).select("section", "idx", "token", (F.col("idx") * 0.5).alias("onset"), (F.col("idx") * 0.5 + 0.4).alias("offset"))
    trees = words.groupBy("section", F.floor(F.col("idx") / 8).cast("int").alias("sentence")).agg(F.sort_array(F.collect_list(F.struct("idx", "token"))).alias("t"))
    return A.sentence_spans(words, trees.select("section", "sentence", F.col("t.token").alias("tokens")))
