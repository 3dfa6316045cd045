"""Entity-resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import resolve as R
from ..sources.readers import table
from .base import Catalog

catalog = Catalog()
query = catalog.query

HOST = r"regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]+)', 1)), '^www\.', '')"
PATH = "regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?[^/?#]+(/[^?#]*)', 1)), '/+$', '')"
#: Names for trigram tests: hosts without dots.
NAMES = f"n AS (SELECT DISTINCT regexp_replace({HOST}, '[^a-z0-9]+', '', 'g') AS name FROM pages)"
GRAMS = "g AS (SELECT DISTINCT name, ('  ' || name || ' ')[i:i + 2] AS gram FROM (SELECT name, unnest(range(1, len(name) + 2)) AS i FROM n)), z AS (SELECT name, count(*) AS n FROM g GROUP BY name)"


def names(spark, d):
    return table(spark, d, "pages", "url").select(F.regexp_replace(T.url_host("url"), "[^a-z0-9]+", "").alias("name")).distinct()


SIM = f"""{NAMES}, {GRAMS}, c AS (SELECT a.name AS a, b.name AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.name < b.name GROUP BY 1, 2),
s AS (SELECT a, b, c / (x.n + y.n - c) AS sim FROM c JOIN z x ON x.name = a JOIN z y ON y.name = b WHERE c / (x.n + y.n - c) >= 0.6)"""


@query(f"WITH {SIM} SELECT a, b, round(sim, 6) AS sim FROM s")
def trigram_jaccard_pairs(spark, d):
    return R.name_pairs(names(spark, d)).select("a", "b", F.round("sim", 6).alias("sim"))


def keyed_pages(spark, d):
    return table(spark, d, "pages", "page_id", "url").select(F.col("page_id").alias("rid"), F.array(T.norm_url("url")).alias("url_keys"))


URL_PAIRS = f"k AS (SELECT page_id AS rid, {HOST} || {PATH} AS key FROM pages), m AS (SELECT key, min(rid) AS a FROM k GROUP BY key), up AS (SELECT DISTINCT a, rid AS b FROM k JOIN m USING (key) WHERE rid <> a)"


@query(f"WITH {URL_PAIRS} SELECT a, b FROM up")
def url_xref_pairs(spark, d):
    """Pages with the same address key, each with the smallest of its group."""
    return R.url_pairs(keyed_pages(spark, d))


@query(f"WITH {SIM}, p AS (SELECT a, b, sim, left(a, 1) = left(b, 1) AS url_xref FROM s) SELECT a, b, url_xref, CASE WHEN url_xref THEN 'same' WHEN row_number() OVER (PARTITION BY url_xref ORDER BY sim DESC, a, b) <= 8 THEN 'ask' ELSE 'ignored' END AS verdict FROM p")
def merge_decisions(spark, d):
    pairs = R.name_pairs(names(spark, d)).withColumn("url_xref", F.col("a").substr(1, 1) == F.col("b").substr(1, 1))
    return R.decide(pairs).select("a", "b", "url_xref", "verdict")


LINKS = f"""e AS (SELECT page_id AS x, min(page_id) OVER (PARTITION BY {HOST}) AS y FROM pages UNION ALL SELECT min(page_id) OVER (PARTITION BY {PATH}), page_id FROM pages WHERE {PATH} <> ''),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r AS (SELECT page_id AS id, page_id AS top FROM pages UNION SELECT b.y, r.top FROM r JOIN b ON b.x = r.id WHERE r.top < b.y)"""


def page_edges(spark, d):
    pages = table(spark, d, "pages", "page_id", "url").select("page_id", T.url_host("url").alias("host"), T.url_path("url").alias("path"))
    stars = [pages.where("path <> ''" if k == "path" else "true").select(F.col("page_id").alias("a"), k) for k in ("host", "path")]
    both = [s.join(s.groupBy(k).agg(F.min("a").alias("b")), k).select("a", "b") for s, k in zip(stars, ("host", "path"), strict=True)]
    return pages.select(F.col("page_id").alias("id")), both[0].unionByName(both[1]).where("a <> b")


@query(f"WITH RECURSIVE {LINKS} SELECT id, min(top) AS component FROM r GROUP BY id")
def components(spark, d):
    """Pages connected by host or path."""
    return R.components(*page_edges(spark, d))


@query("SELECT page_id, 'e' || left(sha1('web:' || page_id), 7) AS eid FROM pages")
def eid_sha1(spark, d):
    return table(spark, d, "pages", "page_id").select("page_id", T.entity_id(F.concat(F.lit("web:"), F.col("page_id").cast("string"))).alias("eid"))


SOURCES = ["github", "devpost", "yc", "hn", "web", "arxiv"]
RELIABILITY_SQL = "CASE " + " ".join(f"WHEN field = '{f}' AND source = '{s}' THEN {p}" for f, by in R.RELIABILITY.items() for s, p in by.items()) + " ELSE 0.5 END"
SRC = "[" + ", ".join(f"'{s}'" for s in SOURCES) + "]"
VALUES = f"""v AS (SELECT doc_id // 4 AS eid, doc_id AS rid, {SRC}[1 + doc_id % 6] AS source, (doc_id % 17) / 17.0 AS sim, 'year' AS field, CASE WHEN doc_id % 5 > 0 THEN CAST(2000 + doc_id % 9 AS VARCHAR) END AS value FROM documents
UNION ALL SELECT doc_id // 4, doc_id, {SRC}[1 + doc_id % 6], (doc_id % 17) / 17.0, 'status', CASE WHEN doc_id % 3 = 0 THEN 'live' ELSE 'gone' END FROM documents)"""


def observations(spark, d):
    rows = table(spark, d, "documents", "doc_id").select(
        F.floor(F.col("doc_id") / 4).alias("eid"), F.col("doc_id").alias("rid"), F.element_at(F.array(*(F.lit(s) for s in SOURCES)), (1 + F.col("doc_id") % 6).cast("int")).alias("source"), ((F.col("doc_id") % 17) / 17.0).alias("sim")
    )
    year = rows.withColumns({"field": F.lit("year"), "value": F.when(F.col("rid") % 5 > 0, (2000 + F.col("rid") % 9).cast("string"))})
    return year.unionByName(rows.withColumns({"field": F.lit("status"), "value": F.when(F.col("rid") % 3 == 0, "live").otherwise("gone")}))


@query(f"""WITH {VALUES}, r AS (SELECT *, {RELIABILITY_SQL} AS reliability FROM v WHERE value IS NOT NULL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eid, field ORDER BY reliability DESC, sim DESC, rid) AS n FROM r) WHERE n = 1),
s AS (SELECT eid, field, count(DISTINCT value) AS n_values, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM r GROUP BY 1, 2)
SELECT eid, field, value, source, CAST(reliability AS DOUBLE) AS reliability, n_values, sources FROM b JOIN s USING (eid, field)""")
def field_fusion(spark, d):
    return R.fuse(observations(spark, d)).withColumn("sources", F.array_join("sources", ","))


@query("""WITH r AS (SELECT doc_id // 4 AS eid, 2000 + (doc_id * 7) % 4 AS year, DATE '2020-01-01' + CAST((doc_id * 131) % 700 AS INT) AS date, CASE WHEN doc_id % 3 = 0 THEN 'live' WHEN doc_id % 3 = 1 THEN 'gone' ELSE 'unknown' END AS status FROM documents),
g AS (SELECT eid, max(year) - min(year) AS y, max(date) - min(date) AS dd, bool_or(status = 'live') AND bool_or(status = 'gone') AS s FROM r GROUP BY eid)
SELECT eid, 'year' AS kind FROM g WHERE y > 1 UNION ALL SELECT eid, 'date' FROM g WHERE dd > 365 UNION ALL SELECT eid, 'status' FROM g WHERE s""")
def conflicts(spark, d):
    rows = table(spark, d, "documents", "doc_id").select(
        F.floor(F.col("doc_id") / 4).alias("eid"), (2000 + (F.col("doc_id") * 7) % 4).alias("year"), F.date_add(F.lit("2020-01-01").cast("date"), ((F.col("doc_id") * 131) % 700).cast("int")).alias("date"),
        F.when(F.col("doc_id") % 3 == 0, "live").when(F.col("doc_id") % 3 == 1, "gone").otherwise("unknown").alias("status"),
    )
    return R.conflicts(rows)


@query(f"""WITH {VALUES}, n AS (SELECT DISTINCT eid, rid, source FROM v) SELECT eid, min_by(rid, (list_position(['yc', 'devpost', 'github', 'hn', 'web', 'arxiv'], source), rid)) AS rid FROM n GROUP BY eid""")
def canonical_record(spark, d):
    """The record that names an entity, by priority of its source."""
    order = F.array(*(F.lit(s) for s in ("yc", "devpost", "github", "hn", "web", "arxiv")))
    rows = observations(spark, d).select("eid", "rid", "source").distinct()
    return rows.groupBy("eid").agg(F.min_by("rid", F.struct(F.array_position(order, F.col("source")), "rid")).alias("rid"))


@query(f"WITH {SIM}, e AS (SELECT name, 'e' || left(sha1(regexp_replace(name, '^(blog|www|m)', '')), 7) AS eid FROM n) SELECT DISTINCT least(x.eid, y.eid) AS a, greatest(x.eid, y.eid) AS b FROM s JOIN e x ON x.name = s.a JOIN e y ON y.name = s.b WHERE x.eid <> y.eid")
def possible_same_as(spark, d):
    """Open links between different entities."""
    entity = names(spark, d).select("name", T.entity_id(F.regexp_replace("name", "^(blog|www|m)", "")).alias("eid"))
    a, b = (entity.select(F.col("name").alias(x), F.col("eid").alias(f"e{x}")) for x in "ab")
    links = R.name_pairs(names(spark, d)).join(a, "a").join(b, "b").where("ea <> eb")
    return links.select(F.least("ea", "eb").alias("a"), F.greatest("ea", "eb").alias("b")).distinct()


@query(f"WITH p AS (SELECT page_id, {HOST} AS host FROM pages), h AS (SELECT host, min(page_id) AS home, count(*) AS pages FROM p GROUP BY host) SELECT page_id, host, home, pages, page_id = home AS is_home FROM p JOIN h USING (host)")
def fold_hosts(spark, d):
    """One home page per host, to which the host's other pages link."""
    pages = table(spark, d, "pages", "page_id", "url").select("page_id", T.url_host("url").alias("host"))
    homes = pages.groupBy("host").agg(F.min("page_id").alias("home"), F.count(F.lit(1)).alias("pages"))
    return pages.join(homes, "host").select("page_id", "host", "home", "pages", (F.col("page_id") == F.col("home")).alias("is_home"))


@query("SELECT doc_id // 4 AS eid, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY 1")
def grouped_union(spark, d):
    rows = table(spark, d, "documents", "doc_id", "source", "lang").groupBy(F.floor(F.col("doc_id") / 4).alias("eid"))
    return rows.agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))
