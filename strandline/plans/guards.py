"""Checked loads, merges, status rules and atlas rows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.catalog import query
from strandline.functions import names as N
from strandline.functions.numbers import shown
from strandline.operators import guards as C
from strandline.operators import sets as S
from strandline.operators import text as T
from strandline.plans import views
from strandline.plans.sets import _RUNS, _runs

_M = f"WITH {views.METRIC_SQL}"


@query(f"{_M} SELECT layer, condition, list_sort(array_agg(DISTINCT lang))::INT[] AS members, count(DISTINCT lang) = 3 AS complete FROM m GROUP BY ALL")
def language_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.complete_groups(views.metrics(spark, sf_dir), ["layer", "condition"], "lang", [0, 1, 2])


@query("SELECT page_id, url FROM pages WHERE split_part(url, '/', 4) IN ('en', 'fr')")
def prefix_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", r"^\w+://[^/]*", "")
    return views.table(spark, sf_dir, "pages").where(N.path_included(path, ["en", "fr"])).select("page_id", "url")


@query(f"{_M} SELECT subject, lang, layer, roi, round(z, 6) + 0.0 AS z FROM m WHERE condition = 'shared'")
def rows_of_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C.of_model(views.metrics(spark, sf_dir), "shared", "metrics", "condition")
    return m.select("subject", "lang", "layer", "roi", shown("z").alias("z"))


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def runs_of_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return C.runs_of_subject(o, "o_custkey", o.agg(F.min("o_custkey")).first()[0], "o_orderkey")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def first_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_run(views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("""WITH f AS (SELECT DISTINCT user_id % 3 lang, event_id % 13 layer, event_type c FROM events)
SELECT lang, layer, max('/v/' || lang || '/' || layer || '/' || c) FILTER (c = 'click') AS shared, max('/v/' || lang || '/' || layer || '/' || c) FILTER (c = 'signup') AS specific FROM f GROUP BY ALL""")
def files_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("lang"), (F.col("event_id") % 13).alias("layer"), F.col("event_type").alias("c")).distinct()
    manifest = e.withColumn("path", F.concat_ws("/", F.lit("/v"), "lang", "layer", "c"))
    found = C.files_by_condition(manifest, ["lang", "layer"], "c", "path")
    return found.select("lang", "layer", F.try_element_at("files", F.lit("click")).alias("shared"), F.try_element_at("files", F.lit("signup")).alias("specific"))


_SIM, _COST = ["l_discount * 8", "1 - l_tax * 4", "l_quantity / 50"], ["l_quantity / 40", "l_tax * 10", "l_discount * 12"]
_LEN = ["l_linenumber % 2 + 1", "l_partkey % 2 + 1", "l_suppkey % 2 + 1"]
_SOURCE = "CASE WHEN l_orderkey % 50 = 0 THEN 'needs_fix' ELSE 'direct' END"


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, [{', '.join(_SIM)}]::DOUBLE[] s, [{', '.join(_COST)}]::DOUBLE[] c, [l_returnflag, l_linestatus, l_returnflag] k, [{', '.join(_LEN)}] n, {_SOURCE} f FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round((s[1] + s[2] + s[3]) / 3, 6) + 0.0 AS mean_similarity, round(list_max(c), 6) + 0.0 AS max_cost, len(list_distinct(k)) > 1 AS classes_differ,
  list_min(s) < 0.35 OR (s[1] + s[2] + s[3]) / 3 < 0.40 OR list_max(c) > 1.25 OR len(list_distinct(k)) > 1 OR len(list_filter(n, lambda x: x = 2)) > 1 OR f = 'needs_fix' AS needs_review FROM t""")
def review_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand in for triplets: three similarities, costs, classes and lengths each."""
    line = views.table(spark, sf_dir, "lineitem")
    s, c, n = ([F.expr(x) for x in part] for part in (_SIM, _COST, _LEN))
    classes = [F.col(x) for x in ("l_returnflag", "l_linestatus", "l_returnflag")]
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", shown((s[0] + s[1] + s[2]) / 3).alias("mean_similarity"), shown(F.greatest(*c)).alias("max_cost"),
        (F.size(F.array_distinct(F.array(*classes))) > 1).alias("classes_differ"), C.review_flag(s, c, classes, n, F.expr(_SOURCE)).alias("needs_review"),
    )


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'F' THEN 'review' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def masked_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = (F.col("o_totalprice") > 300000) & (F.col("o_orderstatus") == "F")
    return views.table(spark, sf_dir, "orders").select("o_orderkey", C.masked_update(mask, "o_orderpriority", F.lit("review")).alias("o_orderpriority"))


@query(f"{_M} SELECT lang, condition, CASE WHEN lang = 1 THEN 'nllb_encoder' ELSE 'xlmr' END AS model, count(*) AS n FROM m WHERE condition IN ('shared', 'specific') GROUP BY ALL")
def named_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions as an option names them, checked; model names in one spelling."""
    wanted = N.checked_names(N.split_option("shared, specific,,shared"), N.CONDITIONS, "condition")
    m = views.metrics(spark, sf_dir).where(F.col("condition").isin(*wanted))
    return m.groupBy("lang", "condition", N.model_column(F.when(F.col("lang") == 1, " NLLB").otherwise("xlmr")).alias("model")).agg(F.count("*").alias("n"))


_AFFINE = [(-4.0, 0.0, 0.5, 20.0), (0.0, 4.0, 0.0, -126.0), (0.25, 0.0, 4.0, -72.0)]
_PLACED = "pl AS (SELECT *, -4.0::DOUBLE * i + 0.5 * k + 20 x, 4.0::DOUBLE * j - 126 y, 0.25::DOUBLE * i + 4 * k - 72 z FROM (SELECT p_partkey voxel, p_partkey % 10 AS label, p_partkey // 144 i, p_partkey // 12 % 12 j, p_partkey % 12 k FROM part))"
_REGIONS = f"{_PLACED}, rg AS (SELECT label, CASE WHEN x < 0 THEN 'L' ELSE 'R' END hemisphere, count(*) n_voxels, avg(x) x, avg(y) y, avg(z) z FROM pl WHERE label > 0 GROUP BY ALL)"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("voxel"), (F.col("p_partkey") % 10).alias("label"))
    return C.voxel_places(v, "voxel", (0, 12, 12), _AFFINE)


@query(f"WITH {_REGIONS} SELECT (dense_rank() OVER (ORDER BY label, hemisphere) - 1)::INT AS region, label, hemisphere, n_voxels, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM rg")
def atlas_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by label and hemisphere, hemispheres by the affine's x."""
    return C.regions_of(_placed(spark, sf_dir), "label").select("region", "label", "hemisphere", "n_voxels", *[shown(a).alias(a) for a in "xyz"])


@query(f"""WITH {_REGIONS}, nr AS (SELECT label, hemisphere, (dense_rank() OVER (ORDER BY label, hemisphere) - 1)::INT region FROM rg), vx AS (SELECT voxel, label, CASE WHEN x < 0 THEN 'L' ELSE 'R' END hemisphere FROM pl)
SELECT region, count(*) AS n_voxels, min(voxel) AS first_voxel, sum(voxel * k)::BIGINT AS checksum FROM (SELECT region, voxel, row_number() OVER (PARTITION BY region ORDER BY voxel) k FROM vx JOIN nr USING (label, hemisphere) WHERE region < 8) GROUP BY region""")
def semantic_voxel_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _placed(spark, sf_dir)
    regions = C.regions_of(placed, "label").where("region < 8").select("label", "hemisphere", "region")
    lists = C.voxels_of_regions(placed.select("voxel", "label", "hemisphere"), regions, ["label", "hemisphere"], "voxel")
    checksum = F.aggregate(F.transform("voxels", lambda v, i: v * (i + 1)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return lists.select("region", F.size("voxels").cast("bigint").alias("n_voxels"), F.element_at("voxels", 1).alias("first_voxel"), checksum.alias("checksum"))


@query(f"{_M}, g AS (SELECT roi, round(avg(z), 6) + 0.0 AS value FROM m GROUP BY roi) SELECT p_partkey AS voxel, (p_partkey % 18)::INT AS roi, value FROM part JOIN g ON g.roi = p_partkey % 18")
def labelled_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled voxel finds its region's value; one that did not would raise."""
    g = views.metrics(spark, sf_dir).groupBy("roi").agg(shown(F.avg("z")).alias("value"))
    voxels = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("voxel"), (F.col("p_partkey") % 18).cast("int").alias("roi"))
    return C.joined_with_dimension(voxels, g, ["roi"], "value").select("voxel", "roi", "value")


@query("""WITH v AS (SELECT l_partkey voxel, avg(l_quantity) value, stddev_pop(l_quantity) sd FROM lineitem GROUP BY ALL)
SELECT p_partkey AS voxel, v.voxel IS NULL AS is_masked, round(coalesce(value, 0), 6) + 0.0 AS value FROM part LEFT JOIN (SELECT * FROM v WHERE sd > 14) v ON v.voxel = p_partkey""")
def masked_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("voxel"))
    q = F.col("l_quantity")
    v = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("voxel")).agg(F.avg(q).alias("value"), F.count(q).alias("n"), F.sum(q).alias("s"), F.sum(q * q).alias("s2"))
    # sd > 14 from sums that are whole numbers: a computed sd of exactly 14 is over or under it by the order of the rows
    v = v.where("n * s2 - s * s > 196.0D * n * n")
    out = C.scattered(grid, v.select("voxel", "value"), "voxel", "value")
    return out.select("voxel", F.isnan("value").alias("is_masked"), shown(F.nanvl("value", F.lit(0.0))).alias("value"))


@query("SELECT user_id % 3 AS lang, least(count(DISTINCT user_id), 20) AS expected FROM events GROUP BY 1")
def expected_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").withColumn("lang", F.col("user_id") % 3)
    return C.expected_members(e, ["lang"], "user_id", 20)


@query(f"""WITH {_RUNS}, j AS (SELECT subject, run, abs(scans - expected) off FROM rn JOIN tp USING (run)),
s AS (SELECT subject, count(DISTINCT run) = (SELECT count(*) FROM tp) AND (sum((off <> 0)::INT) = 0 OR (sum((off <> 0)::INT) = 1 AND max(off) <= 3)) included FROM j GROUP BY subject)
SELECT subject % 3 AS lang, count(*) AS n_subjects, sum(included::INT)::BIGINT AS n_included, sum((NOT included)::INT)::BIGINT AS n_excluded FROM s GROUP BY 1""")
def inclusion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    template = runs.groupBy("run").agg(F.rint(F.median("scans")).cast("bigint").alias("scans"))
    subjects = S.included_subjects(runs, template, "subject", "run", "scans", tolerance=3).withColumn("lang", F.col("subject") % 3)
    return C.inclusion_counts(subjects, "lang", "included")


@query(f"{_M} SELECT roi, layer, n, row_number() OVER (PARTITION BY roi ORDER BY layer_depth ASC NULLS FIRST, layer)::INT AS place FROM (SELECT roi, layer, layer_depth, count(*) n FROM m GROUP BY ALL)")
def nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.metrics(spark, sf_dir).groupBy("roi", "layer", "layer_depth").agg(F.count("*").alias("n"))
    w = Window.partitionBy("roi").orderBy(F.asc_nulls_first("layer_depth"), "layer")
    return g.select("roi", "layer", "n", F.row_number().over(w).alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IS NOT NULL ORDER BY o_orderkey LIMIT 100")
def pilot_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 usable rows: the cap is the operator."""
    usable = (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isNotNull()
    return C.usable_first(views.table(spark, sf_dir, "orders"), usable, "o_orderkey", 100).select("o_orderkey", "o_totalprice")


@query("SELECT page_id, row_number() OVER (ORDER BY CASE WHEN url LIKE '%/fr/%' THEN 0 WHEN url LIKE '%?%' THEN 1 WHEN url LIKE '%#%' THEN 2 ELSE 3 END, url, page_id)::INT AS place FROM pages")
def file_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in the order they are fetched in; a listing is small, so one partition orders it."""
    w = Window.orderBy(C.priority(F.col("url"), ["/fr/", "?", "#"]), "url", "page_id")
    return views.table(spark, sf_dir, "pages").select("page_id", F.row_number().over(w).alias("place"))


@query(f"{_M}, g AS (SELECT subject, lang, roi, condition, avg(z) z FROM m GROUP BY ALL) SELECT subject, lang, roi, condition, round(z, 6) + 0.0 AS z FROM g")
def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four chunks of subjects, put together again and checked for keys that come twice."""
    g = views.metrics(spark, sf_dir).groupBy("subject", "lang", "roi", "condition").agg(shown(F.avg("z")).alias("z")).withColumn("model", F.lit("xlmr"))
    chunks = [g.where(F.col("subject") % 4 == k) for k in range(4)]
    return C.merge_chunks(chunks, ["subject", "lang", "roi", "condition"], "xlmr").drop("model")


@query("""WITH a AS (SELECT o_custkey k, count(*) n, 0 c FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT o_custkey k, count(*) n, 1 c FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
SELECT k, n FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, n FROM b""")
def chunk_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda s: views.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return C.merge_latest([part("F"), part("O")], ["k"])


@query("SELECT c_custkey, c_mktsegment FROM customer")
def present_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.present(views.table(spark, sf_dir, "customer"), ["c_custkey", "no_such", "c_mktsegment"])


@query("SELECT doc_id, coalesce(nullif(trim(source), ''), lang) AS token FROM documents")
def lemma_or_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", T.lemma_or_word(F.col("source"), F.col("lang")).alias("token"))


@query("""WITH g AS (SELECT c_custkey k, count(o_orderkey) done, c_custkey % 2 = 0 merged FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT k, done, CASE WHEN done = 0 THEN 'run' WHEN done < 10 THEN 'resume' WHEN NOT merged THEN 'merge' ELSE 'nothing' END AS step FROM g""")
def next_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    counts = S.progress(wanted, views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"], 10)
    return counts.select("k", F.col("n_done").alias("done"), C.next_step(F.col("n_done"), F.lit(10), F.col("k") % 2 == 0).alias("step"))


@query(f"{_M}, g AS (SELECT lang, roi, avg(z) z FROM m GROUP BY ALL) SELECT a.lang, a.roi, round(a.z - b.z, 6) + 0.0 AS over_mean FROM g a JOIN (SELECT lang, avg(z) z FROM g GROUP BY lang) b USING (lang)")
def memoised_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table used twice is computed once and kept."""
    held = C.Memo()
    make = lambda: views.metrics(spark, sf_dir).groupBy("lang", "roi").agg(F.avg("z").alias("z"))
    mean = held.get("g", make).groupBy("lang").agg(F.avg("z").alias("mean"))
    return held.get("g", make).join(F.broadcast(mean), "lang").select("lang", "roi", shown(F.col("z") - F.col("mean")).alias("over_mean"))


@query("SELECT l.code, 'onset_' || l.code AS onset, 'offset_' || l.code AS \"offset\", l.code = 'en' AS picture FROM (SELECT unnest(['en', 'fr', 'zh']) code) l")
def language_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in N.TIMELINES.items()], "code string, onset string, offset string, picture boolean")


@query("""WITH w AS (SELECT conv_id, turn, i, t[i] token FROM (SELECT conv_id, turn, t, unnest(range(1, len(t) + 1)) i FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') t FROM conversations)))
SELECT token, regexp_full_match(token, '[-.?!,:;"'']+') AS soft, count(*) AS n FROM w GROUP BY ALL""")
def punctuation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = views.table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).select("token", T.soft_token(F.col("token")).alias("soft"), "n")
