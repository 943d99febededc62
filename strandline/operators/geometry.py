"""Vector geometry across languages: shared and specific parts, shifts, retrieval, energy.

Frames hold one vector a row with its group columns (a model's layer, say),
``lang`` and ``triplet``; languages number few, triplets and groups many.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import vectors as V


def side_by_side(vectors: DataFrame, group: list[str], languages: int = 3) -> DataFrame:
    """One row a triplet with columns v0, v1, ...: one shuffle instead of self-joins. Two vectors of one language and triplet raise when they are read."""
    # the aggregate's buffer holds at most one vector for each language
    of = [F.max(F.when(F.col("lang") == k, F.col("vec"))).alias(f"v{k}") for k in range(languages)]
    n = [F.count_if(F.col("lang") == k).alias(f"sl_n{k}") for k in range(languages)]
    wide = vectors.groupBy(*group, "triplet").agg(*of, *n)
    twice = lambda k: F.raise_error(F.concat(F.lit(f"two vectors of language {k} for triplet "), F.col("triplet").cast("string")))
    checked = [F.when(F.col(f"sl_n{k}") > 1, twice(k).cast(dict(wide.dtypes)[f"v{k}"])).otherwise(F.col(f"v{k}")).alias(f"v{k}") for k in range(languages)]
    return wide.select(*group, "triplet", *checked)


def shared_part(vectors: DataFrame, group: list[str]) -> DataFrame:
    """For each language: raw, and shared = the normalised mean of the other two languages' vectors."""
    wide = side_by_side(vectors, group)
    each = [F.struct(F.lit(k).alias("lang"), F.col(f"v{k}").alias("raw"), V.half_sum(F.col(f"v{(k + 1) % 3}"), F.col(f"v{(k + 2) % 3}")).alias("mean")) for k in range(3)]
    rows = wide.select(*group, "triplet", F.explode(F.array(*each)).alias("x")).select(*group, "triplet", "x.*")
    return rows.withColumn("shared", V.normalised(F.col("mean"))).drop("mean")


def decompose(vectors: DataFrame, group: list[str]) -> DataFrame:
    """raw, shared, specific (orthogonal to shared, normalised) and full = [shared; specific]."""
    rows = shared_part(vectors, group).withColumn("specific", V.normalised(V.orthogonal_residual(F.col("raw"), F.col("shared"))))
    return rows.withColumn("full", F.concat("shared", "specific"))



def derangement(rows: DataFrame, section: list[str], order: str, shuffles: int) -> DataFrame:
    """permuted: the id each row takes its vector from, within its section, for each shuffle. Sections of one row raise."""
    from pyspark.sql import Window

    w = Window.partitionBy(*section)
    placed = rows.withColumn("at", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    placed = placed.withColumn("ok", F.assert_true(F.col("n") > 1, F.lit("a section of one row has no derangement"))).where("ok is null").drop("ok")
    many = placed.withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))))
    turn = F.lit(1) + (F.col("shuffle") + F.col("lang") * 7) % (F.col("n") - 1)
    many = many.withColumn("to", (F.col("at") + turn) % F.col("n"))
    target = placed.select(*section, F.col("at").alias("to"), F.col(order).alias("permuted"))
    return many.join(target, [*section, "to"]).drop("at", "n", "to")


def pairs_of(wide: DataFrame, group: list[str]) -> DataFrame:
    """left, right vectors of the language pairs 0-1, 0-2, 1-2."""
    each = [F.struct(F.lit(f"{a}-{b}").alias("pair"), F.col(f"v{a}").alias("left"), F.col(f"v{b}").alias("right")) for a, b in ((0, 1), (0, 2), (1, 2))]
    return wide.select(*group, "triplet", F.explode(F.array(*each)).alias("x")).select(*group, "triplet", "x.*")


def same_and_shifted(vectors: DataFrame, group: list[str]) -> DataFrame:
    """pair, mean cosine of the same triplet, of the right side shifted by one (circular), and their difference."""
    pairs = pairs_of(side_by_side(vectors, group), group)
    size = F.broadcast(vectors.agg(F.count_distinct("triplet").alias("s")))
    moved = pairs.join(size).select(*group, "pair", ((F.col("triplet") + 1) % F.col("s")).alias("triplet"), F.col("right").alias("other"))
    both = pairs.join(moved, [*group, "pair", "triplet"])
    means = both.groupBy(*group, "pair").agg(F.avg(V.dot(F.col("left"), F.col("right"))).alias("same"), F.avg(V.dot(F.col("left"), F.col("other"))).alias("shifted"))
    return means.withColumn("cas", F.col("same") - F.col("shifted"))


def _best_in_block(key: tuple, frame: pd.DataFrame, step: int = 512) -> pd.DataFrame:
    """Both directions of a block pair from one matrix of scores, ``step`` rows of it at a time."""
    frame = frame.sort_values(["side", "triplet"])
    left, right = frame[frame["side"] == 0], frame[frame["side"] == 1]
    head = list(frame.columns[: len(key) - 4])
    if not len(left) or not len(right):
        return pd.DataFrame(columns=[*head, "direction", "triplet", "best", "score"])
    a, b, ids, others = np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy()).T, left["triplet"].to_numpy(), right["triplet"].to_numpy()
    at, top = np.empty(len(a), int), np.empty(len(a))
    back, high = np.zeros(len(others), int), np.full(len(others), -np.inf)
    for i in range(0, len(a), step):
        score = a[i : i + step] @ b
        at[i : i + step] = score.argmax(1)
        top[i : i + step] = score.max(1)
        found = score.argmax(0)
        best = score[found, np.arange(len(others))]
        more = best > high  # the least id of equals stays
        back[more], high[more] = found[more] + i, best[more]
    one, two = key[-4:-2]
    out = pd.DataFrame({"direction": [f"{one}>{two}"] * len(ids) + [f"{two}>{one}"] * len(others), "triplet": np.concatenate([ids, others]), "best": np.concatenate([others[at], ids[back]]), "score": np.concatenate([top, high])})
    for place, name in enumerate(head):
        out.insert(place, name, key[place])
    return out


def nearest_translation(vectors: DataFrame, group: list[str], block: int = 2048, most: int = 8, widest: int = 131_072) -> DataFrame:
    """For each ordered language pair and triplet: the triplet whose right vector has the greatest dot (the least id of equals).

    Matrix products of block against block, both directions from one; a vector goes to every block of the other side. Blocks hold
    ``block`` triplets and grow with the input so that there are ``most`` of them (what is sent grows as the input does), up to ``widest``
    triplets (what a task holds is bounded).
    """
    n = (vectors.agg(F.max("triplet")).first()[0] or 0) + 1
    block = max(block, min(widest, -(-n // most)))
    blocks = max(1, -(-n // block))
    own = F.floor(F.col("triplet") / block).cast("int")
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(3) for b in range(a + 1, 3)])
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    spread = vectors.withColumn("d", F.explode(pairs)).where("lang = d.a or lang = d.b").withColumn("other", every)
    spread = spread.select(
        *group, F.col("d.a").alias("a"), F.col("d.b").alias("b"), F.when(F.col("lang") == F.col("d.a"), own).otherwise(F.col("other")).alias("i"),
        F.when(F.col("lang") == F.col("d.a"), F.col("other")).otherwise(own).alias("j"), (F.col("lang") == F.col("d.b")).cast("int").alias("side"), "triplet", "vec",
    )
    kinds = dict(vectors.dtypes)
    schema = ", ".join([*(f"{g} {kinds[g]}" for g in group), "direction string", "triplet bigint", "best bigint", "score double"])
    keys = [*group, "a", "b", "i", "j"]
    # dealt in as many parts as the session shuffles into: a block pair is small, its product is not
    dealt = spread.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    best = dealt.groupBy(*keys).applyInPandas(lambda key, frame: _best_in_block(key, frame), schema)
    return best.groupBy(*group, "direction", "triplet").agg(F.max_by("best", F.struct(F.col("score"), -F.col("best"))).alias("best"))


def retrieval_r1(vectors: DataFrame, group: list[str]) -> DataFrame:
    """Share of triplets whose nearest translation is their own."""
    return nearest_translation(vectors, group).groupBy(*group, "direction").agg(F.avg((F.col("best") == F.col("triplet")).cast("double")).alias("r1"))


def specificity_energy(parts: DataFrame, group: list[str]) -> DataFrame:
    """Mean over rows of |residual|^2 / (|shared|^2 + |residual|^2), by group and language."""
    rest = V.orthogonal_residual(F.col("raw"), F.col("shared"))
    rows = parts.withColumn("rest", rest)
    energy = V.dot(F.col("rest"), F.col("rest")) / F.greatest(V.dot(F.col("shared"), F.col("shared")) + V.dot(F.col("rest"), F.col("rest")), F.lit(1e-12))
    return rows.groupBy(*group, "lang").agg(F.avg(energy).alias("energy"))
