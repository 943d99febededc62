"""Connected components of an edge table by alternating star contractions.

Each step is one aggregation and one equi-join on node ids: no node's neighbours
are ever gathered in one place, and a hub with a third of all edges is split by
Spark's skew join. Every step is written to the shared folder, and deleted when
the next one is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import forget, stored


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, list[str]]:
    """Contract (u > v) edges: every neighbour of a node is tied to the least of them instead. Also the paths of what was stored.

    The least neighbours are stored, so that the join reads two plain exchanges and Spark can split a hub.
    """
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least, least_path = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    tied = both.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    out, path = stored(out.where("u > v").distinct())
    return out, [least_path, path]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; the component is the least node id reachable.

    Self loops and null ends are ignored; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now, path = stored(now)
    old = [path]
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = print_of(now)
    while seen[0]:  # every round that changes something brings nodes nearer to their least one, so this ends
        middle, first = _star(now, True)
        now, second = _star(middle, False)
        for p in [*old, *first, second[0]]:
            forget(spark, p)
        old, new = second[1:], print_of(now)
        if tuple(new) == tuple(seen):
            break
        seen = new
    found, _ = stored(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select("v", "v").distinct()))
    forget(spark, old[0])
    return found
