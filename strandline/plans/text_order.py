"""Text and ordering queries over ``conversations`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.catalog import query
from strandline.functions.numbers import shown
from strandline.operators import text as T
from strandline.plans import views

_LAST = r"regexp_extract(text, '(\S)\s*$', 1)"
_PUNCT = f"CASE WHEN {_LAST} = '?' THEN 'question' WHEN {_LAST} = '!' THEN 'exclamation' WHEN {_LAST} IN ('.', '。') THEN 'declarative' WHEN {_LAST} IN (';', ':', '；', '：', '…') THEN 'pause' ELSE 'none' END"
_S = f"WITH {views.SPAN_SQL}"


@query(f"SELECT conv_id, turn, {_PUNCT} AS punct FROM conversations")
def punct_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.punct_class(F.col("text")).alias("punct"))


@query(f"SELECT role, {_PUNCT} AS punct, count(*) AS n FROM conversations GROUP BY ALL")
def punct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "conversations").groupBy("role", T.punct_class(F.col("text")).alias("punct")).agg(F.count("*").alias("n"))


@query("""SELECT a.conv_id, a.turn, round(abs(ln((length(a.text) + 1) / (length(b.text) + 1))), 6) + 0.0 AS log_ratio FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def char_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "conversations")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = c.withColumn("after", after).where("after is not null")
    return pairs.select("conv_id", "turn", shown(T.log_ratio(F.length("text"), F.length("after"))).alias("log_ratio"))


@query(r"""WITH w AS (SELECT lang, t, count(*) n FROM (SELECT lang, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) t FROM documents) GROUP BY ALL), n AS (SELECT lang, lower(t) a, strip_accents(lower(t)) b, n FROM w)
SELECT lang, a AS token, b AS folded, len(list_filter(list_distinct([a, translate(a, '''-', ''), b, translate(b, '''-', '')]), lambda x: x <> ''))::INT AS n_forms, sum(n)::BIGINT AS n FROM n GROUP BY lang, a, b""")
def canonical_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the whole texts; each spelling of a language is normalised once."""
    words = views.table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("t"))
    rows = words.groupBy("lang", "t").agg(F.count("*").alias("n")).withColumn("token", T.normal_tokens("t")).withColumn("folded", T.folded("token"))
    counted = rows.groupBy("lang", "token", "folded").agg(F.sum("n").alias("n"))
    return counted.select("lang", "token", "folded", F.size(T.canonical_forms(F.col("token"), F.col("folded"))).alias("n_forms"), "n")


@query(r"""WITH c AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]+')[1:2], lambda x: lower(x)) p FROM conversations), q AS (SELECT conv_id, turn, p, list_transform(p, lambda x: translate(x, '''-', '')) b FROM c)
SELECT conv_id, turn, list_sort(list_filter(list_distinct([array_to_string(p, ' '), array_to_string(p, ''), array_to_string(b, ' '), array_to_string(b, '')]), lambda x: x <> '')) AS forms FROM q""")
def group_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of a group of two tokens (each turn's first two)."""
    tokens = F.transform(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), 1, 2), F.lower)
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_sort(T.group_forms(tokens)).alias("forms"))


@query(f"{_S} SELECT section, idx, string_agg(text, ' ' ORDER BY idx) OVER (PARTITION BY section ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS context FROM sp")
def prev_k_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.previous_context(views.spans(spark, sf_dir), ["section"], "idx", "text", 2).select("section", "idx", "context")


@query(f"""{_S}, x AS (SELECT section, idx, text, onset, "offset", lead(text) OVER w nt, lead("offset") OVER w nf FROM sp WINDOW w AS (PARTITION BY section ORDER BY idx))
SELECT section, idx AS start, 1 AS length, round(onset, 6) AS onset, round("offset", 6) AS "offset", length(trim(text)) AS n_chars FROM x
UNION ALL SELECT section, idx, 2, round(onset, 6), round(nf, 6), length(concat_ws(' ', nullif(trim(text), ''), nullif(trim(nt), ''))) FROM x WHERE nf IS NOT NULL""")
def span_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = T.span_candidates(views.spans(spark, sf_dir), ["section"], "idx", "text")
    return spans.select("section", "start", "length", F.round("onset", 6).alias("onset"), F.round("offset", 6).alias("offset"), F.length("text").cast("bigint").alias("n_chars"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS run_index FROM orders")
def row_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("run_index"))


_PATTERN = "concat_ws('-', l_linenumber % 2 + 1, l_partkey % 2 + 1, l_suppkey % 2 + 1)"


@query(f"WITH p AS (SELECT {_PATTERN} pattern FROM lineitem), f AS (SELECT unnest(['1-1-1','1-1-2','1-2-1','1-2-2','2-1-1','2-1-2','2-2-1','2-2-2','3-1-1']) pattern) SELECT f.pattern, count(p.pattern) AS n FROM f LEFT JOIN p USING (pattern) GROUP BY f.pattern")
def merge_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: (F.col(c) % 2 + 1).cast("string")
    counted = views.table(spark, sf_dir, "lineitem").groupBy(F.concat_ws("-", part("l_linenumber"), part("l_partkey"), part("l_suppkey")).alias("pattern")).agg(F.count("*").alias("n"))
    listed = spark.createDataFrame([(f"{a}-{b}-{c}",) for a in (1, 2) for b in (1, 2) for c in (1, 2)] + [("3-1-1",)], "pattern string")
    return listed.join(counted, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH r AS (SELECT o_orderkey k, o_totalprice s, o_orderstatus sec, o_orderpriority pat, o_totalprice > 400000 f, (o_orderkey * 2654435761) % 4294967296 draw FROM orders),
t AS (SELECT k, 0 stratum, p FROM (SELECT k, f, row_number() OVER (ORDER BY f DESC, draw, k) p FROM r) WHERE f AND p <= 50
 UNION ALL SELECT k, 1, p FROM (SELECT k, row_number() OVER (ORDER BY s, k) p FROM r) WHERE p <= 20
 UNION ALL SELECT k, 2, p FROM (SELECT k, row_number() OVER (ORDER BY s DESC, k) p FROM r) WHERE p <= 20
 UNION ALL SELECT k, 3, p FROM (SELECT k, row_number() OVER (PARTITION BY sec ORDER BY draw, k) p FROM r) WHERE p <= 2
 UNION ALL SELECT k, 4, p FROM (SELECT k, row_number() OVER (PARTITION BY pat ORDER BY draw, k) p FROM r) WHERE p <= 2
 UNION ALL SELECT k, 5, p FROM (SELECT k, row_number() OVER (ORDER BY draw, k) p FROM r) WHERE p <= 100),
o AS (SELECT k, stratum, p, row_number() OVER (PARTITION BY k ORDER BY stratum, p) n FROM t)
SELECT k AS o_orderkey, stratum, p::INT AS place FROM o WHERE n = 1 ORDER BY stratum, p, k LIMIT 100""")
def stratified_review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders").withColumn("flagged", F.col("o_totalprice") > 400000)
    return T.review_sample(orders, "o_orderkey", "flagged", "o_totalprice", "o_orderstatus", "o_orderpriority")


@query("""WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS n_chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) k FROM conversations),
b AS (SELECT conv_id, turn, n_chars, k, n_chars held, 0 batch FROM o WHERE k = 1
 UNION ALL SELECT o.conv_id, o.turn, o.n_chars, o.k, CASE WHEN b.held > 0 AND b.held + o.n_chars > 2048 THEN o.n_chars ELSE b.held + o.n_chars END, CASE WHEN b.held > 0 AND b.held + o.n_chars > 2048 THEN b.batch + 1 ELSE b.batch END FROM b JOIN o ON o.conv_id = b.conv_id AND o.k = b.k + 1)
SELECT conv_id, turn, n_chars, batch FROM b""")
def token_budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "conversations").withColumn("n_chars", F.length("text").cast("bigint"))
    return T.budget_batches(c, ["conv_id"], "turn", "n_chars", 2048)


@query("""SELECT conv_id, count(*) AS n_turns, min(turn) AS first_turn, max(turn) AS last_turn, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id""")
def section_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("n_chars"))
