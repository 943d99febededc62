"""Line dedup over overlapping windows of three lines, in DataFrame operations only.

A window is three consecutive lines (split at \\n) of one document, as a 128-bit
hash. The first occurrence of a window is the least (doc_id, position); every
later one covers its lines, in the same or another document. Covered positions
are merged and removed; windows are judged on the input.

Defined results: null text stays null and has no line; a text of under three
lines is untouched; rows equal in doc_id and text are one document; a row with
null doc_id is returned untouched and covers nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import stored

WINDOW = 3


def _windows(lines: Column) -> Column:
    """array of (pos, k1, k2), one for each window."""
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    starts = F.when(F.size(lines) >= WINDOW, F.sequence(F.lit(0), F.size(lines) - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        F.arrays_zip(
            starts.alias("pos"), hashed.alias("x"), F.slice(hashed, 2, F.greatest(F.size(lines), F.lit(1))).alias("y"), F.slice(hashed, 3, F.greatest(F.size(lines), F.lit(1))).alias("z")
        ),
        lambda w: F.struct(w["pos"].alias("pos"), F.xxhash64(w["x"]["a"], w["y"]["a"], w["z"]["a"]).alias("k1"), F.xxhash64(F.lit(2), w["x"]["b"], w["y"]["b"], w["z"]["b"]).alias("k2")),
    )


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, spots): the starts of the windows of each document that occurred before."""
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("tkey"), F.split("text", "\n", -1).alias("lines"))
    seen = texts.where(F.size("lines") >= WINDOW).select("doc_id", "tkey", F.explode(_windows(F.col("lines"))).alias("w")).select("doc_id", "tkey", "w.*").where("pos is not null")
    first = seen.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tkey", "pos")).alias("first")).where("n > 1").drop("n")
    first, _ = stored(first)  # the join then reads two plain exchanges, which Spark can split where a window is very common
    later = seen.join(first, ["k1", "k2"]).where(F.struct("doc_id", "tkey", "pos") > F.col("first"))
    return later.groupBy("doc_id", "tkey").agg(F.collect_set("pos").alias("spots"))


def dedup_lines(docs: DataFrame, lines_as: str = "n_lines", removed_as: str = "n_removed") -> DataFrame:
    """The rows of ``docs`` with ``text`` and ``n_chars`` as they are after removal, and the numbers of lines and of removed ones (long).

    ``lines_as``, ``removed_as``: names of those columns; columns of ``docs`` that have them are replaced.
    """
    columns = docs.columns
    others = [docs[c] for c in columns if c not in ("doc_id", "text")]  # the text is shuffled once
    base = docs.select("doc_id", "text", F.struct(F.lit(0).alias("sl_none"), *others).alias("sl_row")).withColumn("tkey", F.xxhash64("text"))
    joined = base.join(repeated_windows(docs), ["doc_id", "tkey"], "left")
    lines = F.split("text", "\n", -1)
    covered = F.flatten(F.transform("spots", lambda p: F.array(p, p + 1, p + 2)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    joined = joined.withColumn("sl_lines", lines).withColumn("sl_stay", F.when(F.col("spots").isNotNull(), stay))
    kept = F.array_join(F.transform("sl_stay", lambda i: F.element_at("sl_lines", i + 1)), "\n")
    joined = joined.withColumn("sl_text", F.when(F.col("sl_stay").isNull(), F.col("text")).otherwise(kept))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("sl_lines")).cast("bigint")
    n_removed = F.coalesce(F.size("sl_lines") - F.when(F.col("sl_stay").isNotNull(), F.size("sl_stay")), F.lit(0)).cast("bigint")
    joined = joined.withColumns({"sl_n_lines": n_lines, "sl_n_removed": n_removed})
    fresh = {"doc_id": F.col("doc_id"), "text": F.col("sl_text"), "n_chars": F.length("sl_text").cast("bigint")}
    kept_columns = [fresh[c].alias(c) if c in fresh else F.col("sl_row")[c].alias(c) for c in columns if c not in (lines_as, removed_as)]
    return joined.select(*kept_columns, F.col("sl_n_lines").alias(lines_as), F.col("sl_n_removed").alias(removed_as))
