"""Geometry queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.catalog import query
from strandline.functions import vectors as V
from strandline.functions.numbers import shown
from strandline.operators import geometry as G
from strandline.plans import views

_DOT = "list_inner_product"
_WEIGHT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: i * {0}[i]))"
_PAIR = "pr AS (SELECT a.layer, a.lang || '-' || b.lang AS pair, a.triplet, a.vec lft, b.vec rgt FROM lv a JOIN lv b ON a.layer = b.layer AND a.triplet = b.triplet AND a.lang < b.lang)"
#: raw, shared and the orthogonal residual of every (layer, triplet, lang)
_PARTS = f"""mn AS (SELECT a.layer, a.triplet, a.lang, a.vec raw, list_transform(range(1, 17), lambda i: (b.vec[i] + c.vec[i]) / 2) mean
  FROM lv a JOIN lv b ON a.layer = b.layer AND a.triplet = b.triplet AND b.lang = (a.lang + 1) % 3 JOIN lv c ON a.layer = c.layer AND a.triplet = c.triplet AND c.lang = (a.lang + 2) % 3),
sh AS (SELECT layer, triplet, lang, raw, list_transform(mean, lambda x: x / greatest(sqrt({_DOT}(mean, mean)), 1e-12)) shared FROM mn),
df AS (SELECT *, list_transform(range(1, 17), lambda i: raw[i] - shared[i]) d FROM sh),
rs AS (SELECT *, list_transform(range(1, 17), lambda i: d[i] - {_DOT}(shared, d) / ({_DOT}(shared, shared) + 1e-8) * shared[i]) rest FROM df),
sc AS (SELECT *, list_transform(rest, lambda x: x / greatest(sqrt({_DOT}(rest, rest)), 1e-12)) specific FROM rs)"""


@query(f"""WITH {views.VEC_SQL}, lv AS (SELECT 0 layer, * FROM v), {_PAIR}, n AS (SELECT count(DISTINCT triplet) s FROM v)
SELECT a.pair, round(avg({_DOT}(a.lft, a.rgt)), 6) + 0.0 AS same, round(avg({_DOT}(a.lft, b.rgt)), 6) + 0.0 AS shifted,
  round(avg({_DOT}(a.lft, a.rgt)) - avg({_DOT}(a.lft, b.rgt)), 6) + 0.0 AS cas
FROM pr a, n JOIN pr b ON a.pair = b.pair AND a.triplet = (b.triplet + 1) % n.s GROUP BY a.pair""")
def geometry_same_vs_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.same_and_shifted(views.vectors(spark, sf_dir).withColumn("layer", F.lit(0)), ["layer"])
    return out.select("pair", shown("same").alias("same"), shown("shifted").alias("shifted"), shown("cas").alias("cas"))


@query(f"""WITH {views.LAYER_SQL}, {_PAIR}, n AS (SELECT count(DISTINCT triplet) s FROM v)
SELECT a.layer, a.pair, round(avg({_DOT}(a.lft, a.rgt)), 6) + 0.0 AS same, round(avg({_DOT}(a.lft, b.rgt)), 6) + 0.0 AS shifted
FROM pr a, n JOIN pr b ON a.pair = b.pair AND a.layer = b.layer AND a.triplet = (b.triplet + 1) % n.s GROUP BY a.layer, a.pair""")
def geometry_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.same_and_shifted(views.layer_vectors(spark, sf_dir), ["layer"])
    return out.select("layer", "pair", shown("same").alias("same"), shown("shifted").alias("shifted"))


@query(f"WITH {views.LAYER_SQL} SELECT lang, triplet, layer, round({_WEIGHT.format('vec')}, 6) + 0.0 AS weighted, round({_DOT}(vec, vec), 6) + 0.0 AS norm2 FROM lv")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.layer_vectors(spark, sf_dir)
    return v.select("lang", "triplet", "layer", shown(V.weighted(F.col("vec"))).alias("weighted"), shown(V.dot(F.col("vec"), F.col("vec"))).alias("norm2"))


@query(f"WITH {views.LAYER_SQL}, {_PARTS} SELECT layer, triplet, lang, round({_WEIGHT.format('shared')}, 6) + 0.0 AS weighted FROM sh")
def decompose_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shared_part(views.layer_vectors(spark, sf_dir), ["layer"]).select("layer", "triplet", "lang", shown(V.weighted(F.col("shared"))).alias("weighted"))


@query(f"WITH {views.LAYER_SQL}, {_PARTS} SELECT layer, triplet, lang, round({_WEIGHT.format('specific')}, 5) + 0.0 AS weighted FROM sc")
def decompose_specific_orthogonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.decompose(views.layer_vectors(spark, sf_dir), ["layer"]).select("layer", "triplet", "lang", shown(V.weighted(F.col("specific")), 5).alias("weighted"))


@query(f"WITH {views.LAYER_SQL}, {_PARTS}, fl AS (SELECT layer, triplet, lang, list_concat(shared, specific) f FROM sc) SELECT layer, triplet, lang, len(f)::INT AS width, round({_WEIGHT.format('f')}, 5) + 0.0 AS weighted FROM fl")
def decompose_full_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.decompose(views.layer_vectors(spark, sf_dir), ["layer"])
    return rows.select("layer", "triplet", "lang", F.size("full").alias("width"), shown(V.weighted(F.col("full")), 5).alias("weighted"))


@query(f"""WITH {views.LAYER_SQL}, {_PARTS} SELECT layer, lang, round(avg({_DOT}(shared, specific)), 6) + 0.0 AS mean_dot, max(abs({_DOT}(shared, specific))) < 1e-6 AS orthogonal,
  round(avg(sqrt({_DOT}(shared, shared))), 6) AS shared_norm, round(avg(sqrt({_DOT}(specific, specific))), 6) AS specific_norm FROM sc GROUP BY layer, lang""")
def orthogonality_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.decompose(views.layer_vectors(spark, sf_dir), ["layer"])
    inner = V.dot(F.col("shared"), F.col("specific"))
    return rows.groupBy("layer", "lang").agg(
        shown(F.avg(inner)).alias("mean_dot"), (F.max(F.abs(inner)) < 1e-6).alias("orthogonal"), shown(F.avg(V.norm(F.col("shared")))).alias("shared_norm"), shown(F.avg(V.norm(F.col("specific")))).alias("specific_norm")
    )


_DERANGE = """pl AS (SELECT lang, triplet, triplet % 9 + 1 section, row_number() OVER w - 1 AS at, count(*) OVER (PARTITION BY lang, triplet % 9 + 1) n FROM v WINDOW w AS (PARTITION BY lang, triplet % 9 + 1 ORDER BY triplet)),
pm AS (SELECT a.lang, a.section, s.k AS shuffle, a.triplet, b.triplet AS permuted FROM pl a, range(5) s(k) JOIN pl b ON a.lang = b.lang AND a.section = b.section AND b.at = (a.at + 1 + (s.k + a.lang * 7) % (a.n - 1)) % a.n)"""


def _permutations(spark: SparkSession, sf_dir: str, shuffles: int) -> DataFrame:
    rows = views.vectors(spark, sf_dir).select("lang", "triplet", (F.col("triplet") % 9 + 1).alias("section"))
    return G.derangement(rows, ["lang", "section"], "triplet", shuffles)


@query(f"WITH {views.VEC_SQL}, {_DERANGE} SELECT lang, section, shuffle::INT AS shuffle, triplet, permuted FROM pm")
def mismatched_derangement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _permutations(spark, sf_dir, 5).select("lang", "section", "shuffle", "triplet", "permuted")


@query(f"WITH {views.VEC_SQL}, {_DERANGE} SELECT lang, shuffle::INT AS shuffle, count(*) AS n_rows, sum((triplet = permuted)::INT)::BIGINT AS fixed_points FROM pm GROUP BY lang, shuffle")
def derangement_fixed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _permutations(spark, sf_dir, 5).groupBy("lang", "shuffle").agg(F.count("*").alias("n_rows"), F.sum((F.col("triplet") == F.col("permuted")).cast("long")).alias("fixed_points"))


@query(f"""WITH {views.LAYER_SQL}, {_PARTS}, {_DERANGE} SELECT s.layer, s.lang, p.shuffle::INT AS shuffle, p.triplet, round({_WEIGHT.format('s.shared')}, 6) + 0.0 AS weighted
FROM pm p JOIN sh s ON s.lang = p.lang AND s.triplet = p.permuted""")
def mismatched_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = G.shared_part(views.layer_vectors(spark, sf_dir), ["layer"]).select("layer", "lang", F.col("triplet").alias("permuted"), "shared")
    taken = _permutations(spark, sf_dir, 5).join(shared, ["lang", "permuted"])
    return taken.select("layer", "lang", "shuffle", "triplet", shown(V.weighted(F.col("shared"))).alias("weighted"))


@query(f"""WITH {views.LAYER_SQL}, sim AS (SELECT a.layer, a.lang || '>' || b.lang AS direction, a.triplet, b.triplet other, {_DOT}(a.vec, b.vec) s FROM lv a JOIN lv b ON a.layer = b.layer AND a.lang <> b.lang),
best AS (SELECT layer, direction, triplet, other, row_number() OVER (PARTITION BY layer, direction, triplet ORDER BY s DESC, other) k FROM sim)
SELECT layer, direction, round(avg((triplet = other)::INT), 6) + 0.0 AS r1 FROM best WHERE k = 1 GROUP BY layer, direction""")
def retrieval_r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.retrieval_r1(views.layer_vectors(spark, sf_dir), ["layer"]).select("layer", "direction", shown("r1").alias("r1"))


@query(f"WITH {views.LAYER_SQL}, {_PARTS} SELECT layer, lang, round(avg({_DOT}(rest, rest) / greatest({_DOT}(shared, shared) + {_DOT}(rest, rest), 1e-12)), 6) AS energy FROM rs GROUP BY layer, lang")
def specificity_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = G.shared_part(views.layer_vectors(spark, sf_dir), ["layer"])
    return G.specificity_energy(parts, ["layer"]).select("layer", "lang", shown("energy").alias("energy"))


@query(f"""WITH {views.LAYER_SQL}, {_PARTS}, {_PAIR}, n AS (SELECT count(DISTINCT triplet) s FROM v),
pm AS (SELECT a.layer, a.pair, avg({_DOT}(a.lft, a.rgt)) same, avg({_DOT}(a.lft, b.rgt)) shifted FROM pr a, n JOIN pr b ON a.pair = b.pair AND a.layer = b.layer AND a.triplet = (b.triplet + 1) % n.s GROUP BY a.layer, a.pair),
en AS (SELECT layer, lang, avg({_DOT}(rest, rest) / greatest({_DOT}(shared, shared) + {_DOT}(rest, rest), 1e-12)) energy FROM rs GROUP BY layer, lang)
SELECT p.layer, round(p.a, 6) + 0.0 AS align_mean, round(p.c, 6) + 0.0 AS cas, round(e.e, 6) + 0.0 AS specificity
FROM (SELECT layer, avg(same) a, avg(same - shifted) c FROM pm GROUP BY layer) p JOIN (SELECT layer, avg(energy) e FROM en GROUP BY layer) e USING (layer)""")
def geometry_metrics_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.layer_vectors(spark, sf_dir)
    pairs = G.same_and_shifted(v, ["layer"]).groupBy("layer").agg(F.avg("same").alias("align_mean"), F.avg("cas").alias("cas"))
    energy = G.specificity_energy(G.shared_part(v, ["layer"]), ["layer"]).groupBy("layer").agg(F.avg("energy").alias("specificity"))
    return pairs.join(energy, "layer").select("layer", *[shown(c).alias(c) for c in ("align_mean", "cas", "specificity")])
