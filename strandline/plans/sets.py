"""Set, upsert and guard queries over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.catalog import query
from strandline.operators import sets as S
from strandline.plans import views

_OLD = "old AS (SELECT o_custkey k, o_orderkey id, 'old' origin FROM orders WHERE o_orderstatus = 'F')"
_NEW = "new AS (SELECT o_custkey k, o_orderkey id, 'new' origin FROM orders WHERE o_orderstatus = 'P')"


def _status(spark: SparkSession, sf_dir: str, status: str, origin: str) -> DataFrame:
    return views.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.lit(origin).alias("origin"))


@query(f"WITH {_OLD}, {_NEW} SELECT k, id, origin FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT k, id, origin FROM new")
def union_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.replace_by_key(_status(spark, sf_dir, "F", "old"), _status(spark, sf_dir, "P", "new"), ["k"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) n FROM orders) WHERE n = 1")
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = S.keep_last(views.table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return last.select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    included = _status(spark, sf_dir, "P", "x").select(F.col("k").alias("c_custkey"))
    return views.table(spark, sf_dir, "customer").join(included, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _status(spark, sf_dir, "P", "x").select(F.col("k").alias("c_custkey"))
    return views.table(spark, sf_dir, "customer").join(done, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


_RUNS = "rn AS (SELECT user_id subject, (event_id % 3)::INT run, count(*) scans FROM events GROUP BY ALL), tp AS (SELECT run, median(scans)::BIGINT expected FROM rn GROUP BY run)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("subject"), (F.col("event_id") % 3).cast("int").alias("run")).agg(F.count("*").alias("scans"))


@query(f"""WITH {_RUNS}, j AS (SELECT subject, run, abs(scans - expected) off FROM rn JOIN tp USING (run))
SELECT subject, count(DISTINCT run) AS n_runs, sum((off <> 0)::INT)::BIGINT AS n_off, max(off) AS max_off,
  count(DISTINCT run) = (SELECT count(*) FROM tp) AND (sum((off <> 0)::INT) = 0 OR (sum((off <> 0)::INT) = 1 AND max(off) <= 3)) AS included FROM j GROUP BY subject""")
def inclusion_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    template = runs.groupBy("run").agg(F.rint(F.median("scans")).cast("bigint").alias("scans"))
    return S.included_subjects(runs, template, "subject", "run", "scans", tolerance=3)


@query("SELECT l_linenumber AS run, count(DISTINCT l_returnflag) AS scans FROM lineitem GROUP BY l_linenumber")
def scan_count_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = views.table(spark, sf_dir, "lineitem").groupBy("l_linestatus", F.col("l_linenumber").alias("run")).agg(F.lit(None).cast("int").alias("x"))
    flags = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("run")).agg(F.count_distinct("l_returnflag").alias("scans"))
    return S.consistent_counts(counts.join(flags, "run"), "run", "scans").select("run", "scans")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.duplicated_keys(views.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT c_custkey, c_nationkey, coalesce(n, 0) AS n_done, CASE WHEN coalesce(n, 0) = 0 THEN 'not_started' WHEN n < 10 THEN 'partial' ELSE 'complete' END AS status
FROM customer LEFT JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def progress_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = views.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    done = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return S.progress(wanted, done, ["c_custkey"], 10)


@query("""WITH e AS (SELECT user_id % 3 lang, event_type condition, count(*) n, count(DISTINCT user_id) s FROM events GROUP BY ALL), x AS (SELECT user_id % 3 lang, count(DISTINCT user_id) expected FROM events GROUP BY ALL)
SELECT condition, sum(n)::BIGINT AS n_rows, bool_and(s = expected) AS complete FROM e JOIN x USING (lang) GROUP BY condition""")
def condition_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").withColumn("lang", F.col("user_id") % 3)
    expected = e.groupBy("lang").agg(F.count_distinct("user_id").alias("expected"))
    cells = e.groupBy("lang", F.col("event_type").alias("condition")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("s"))
    return cells.join(F.broadcast(expected), "lang").groupBy("condition").agg(F.sum("n").alias("n_rows"), F.bool_and(F.col("s") == F.col("expected")).alias("complete"))


@query("""SELECT run, k, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2, coalesce(c3, 0) AS c3 FROM (
 SELECT 1 AS run, o_orderkey k, o_totalprice c1, 1.0::DOUBLE c2, NULL::DOUBLE c3 FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, o_orderkey, o_totalprice, NULL, 2.0 FROM orders WHERE o_orderstatus = 'O')""")
def column_union_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    part = lambda status, run: o.where(F.col("o_orderstatus") == status).select(F.lit(run).alias("run"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("c1"))
    return S.aligned_union([part("F", 1).withColumn("c2", F.lit(1.0)), part("O", 2).withColumn("c3", F.lit(2.0))], ["run", "k"])


@query("""WITH g AS (SELECT o_custkey, count(*) n FROM orders GROUP BY o_custkey) SELECT o_custkey, n AS own_width, (SELECT max(n) FROM g) AS width FROM g""")
def pad_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("own_width"), F.collect_list("o_totalprice").alias("v"))
    return S.padded(g, "v").select("o_custkey", "own_width", F.size("v").cast("bigint").alias("width"))


@query("""SELECT n_name, r_name, coalesce(n, 0) AS n_customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) n FROM customer GROUP BY ALL) ON c_nationkey = n_nationkey""")
def dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: views.table(spark, sf_dir, n)
    counts = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_customers"))
    # two dimension tables of fixed size
    places = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return places.join(counts, "n_nationkey", "left").select("n_name", "r_name", F.coalesce("n_customers", F.lit(0)).alias("n_customers"))


@query("SELECT o_custkey, list_sort(list_intersect(array_agg(DISTINCT o_orderstatus), ['F', 'O']))::VARCHAR[] AS known, len(list_filter(['F', 'O', 'P'], lambda x: NOT list_contains(array_agg(DISTINCT o_orderstatus), x)))::INT AS n_missing FROM orders GROUP BY o_custkey")
def status_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = views.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    fixed = lambda *x: F.array(*[F.lit(v) for v in x])
    return got.select("o_custkey", F.array_sort(F.array_intersect("s", fixed("F", "O"))).alias("known"), F.size(F.array_except(fixed("F", "O", "P"), "s")).alias("n_missing"))


@query("SELECT user_id, event_id, event_type FROM events WHERE coalesce(nullif(event_type, 'view'), '') <> 'error'")
def null_safe_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.nullif(F.col("event_type"), F.lit("view"))
    return views.table(spark, sf_dir, "events").where(~kind.eqNullSafe("error")).select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM (SELECT *, dense_rank() OVER (ORDER BY o_custkey) d FROM orders WHERE o_orderstatus = 'P') WHERE d <= 5")
def first_n_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap is the operator: rows of the five least customer keys."""
    o = views.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    first = o.select("o_custkey").distinct().orderBy("o_custkey").limit(5)
    return o.join(F.broadcast(first), "o_custkey", "left_semi").select("o_orderkey", "o_orderpriority", "o_totalprice")
