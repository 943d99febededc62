"""Irregular text scans, on ``pages`` as stand-ins for annotation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.catalog import query
from strandline.plans import views

_ANCHOR = r'<a href="([^"]*)">([^<]*)</a>'


@query(r"""WITH x AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) a, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) b FROM pages)
SELECT page_id, (i - 1)::INT AS idx, a[i] AS href, trim(b[i]) AS label FROM (SELECT page_id, a, b, unnest(range(1, len(a) + 1)) i FROM x) WHERE trim(b[i]) <> ''""")
def interval_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated two-field records inside one text: both fields by pattern, zipped and exploded, blank ones dropped."""
    parts = [F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(k)).alias(n) for k, n in ((1, "a"), (2, "b"))]
    rows = views.table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.arrays_zip(*parts)).alias("idx", "x"))
    return rows.select("page_id", "idx", F.col("x.a").alias("href"), F.trim("x.b").alias("label")).where("label <> ''")


@query(r"""SELECT page_id, regexp_extract(url, '^(\w+)://([^/?#]+)', 1) AS scheme, regexp_extract(url, '^(\w+)://([^/?#]+)', 2) AS host, regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang FROM pages""")
def name_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed columns out of a name, as run listings take them from file names."""
    part = lambda k: F.regexp_extract("url", r"^(\w+)://([^/?#]+)", k)
    return views.table(spark, sf_dir, "pages").select("page_id", part(1).alias("scheme"), part(2).alias("host"), F.regexp_extract("url", "/(en|fr|de|es)/", 1).alias("lang"))


@query(r"""WITH f AS (SELECT regexp_extract(url, '://([^/?#]+)', 1) host, CASE WHEN url LIKE '%?%' THEN 'query' WHEN url LIKE '%#%' THEN 'anchor' ELSE 'plain' END kind FROM pages)
SELECT host, count(*) FILTER (kind = 'query') AS query, count(*) FILTER (kind = 'anchor') AS anchor, count(*) FILTER (kind = 'plain') AS plain FROM f GROUP BY host""")
def presence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("url").contains("?"), "query").when(F.col("url").contains("#"), "anchor").otherwise("plain")
    rows = views.table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"), kind.alias("kind"))
    return rows.groupBy("host").pivot("kind", ["query", "anchor", "plain"]).agg(F.count(F.lit(1))).fillna(0)


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
