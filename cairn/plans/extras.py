"""Smaller operators: substitutions, picks, tolerant parsing, badges, ledgers, roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats as S
from ..functions import text as T
from ..operators.graph import badges
from ..sources.readers import dimension, table
from .base import TOKENS, Catalog, sql_list

catalog = Catalog()
query = catalog.query

WARES = {"ring": "ring", "widget": "widget", "bolt": "fastener", "nut": "fastener", "screw": "fastener", "gear": "gear", "red": "red", "blue": "blue"}
WARES_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in WARES.items()) + "}"


@query(f"""SELECT p_partkey, CASE WHEN p_type <> 'ECONOMY' THEN lower(p_type) WHEN len(f) > 0 THEN array_to_string(f, ',') ELSE '' END AS tech, CASE WHEN p_type <> 'ECONOMY' THEN 'source' WHEN len(f) > 0 THEN 'imputed' END AS provenance
FROM (SELECT p_partkey, p_type, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(p_name), '[a-z]+'), lambda w: map_contains({WARES_SQL}, w)), lambda w: {WARES_SQL}[w]))) AS f FROM part)""")
def extract_tech(spark, d):
    """Terms by the ladder of provenance: a structured list, a block of text, then prose; here of parts, by a map of wares."""
    listed = F.when(F.col("p_type") != "ECONOMY", F.array("p_type"))
    found = T.extract_terms(listed, F.lit(None).cast("string"), F.col("p_name"), WARES)
    return table(spark, d, "part", "p_partkey", "p_name", "p_type").select("p_partkey", found.alias("x")).select("p_partkey", F.array_join(F.array_sort("x.terms"), ",").alias("tech"), "x.provenance")


@query(f"SELECT doc_id, CASE WHEN len({TOKENS}) < 8 THEN source ELSE 'pitch' END AS scored FROM documents")
def short_pitch_substitution(spark, d):
    """Pitches of fewer than eight content words are scored by their write-up instead."""
    short = F.size(T.tokens("text")) < 8
    return table(spark, d, "documents", "doc_id", "text", "source").select("doc_id", F.when(short, F.coalesce("source", F.lit("pitch"))).otherwise("pitch").alias("scored"))


@query("WITH k AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages) SELECT page_id FROM k WHERE host NOT IN (SELECT host FROM k WHERE page_id < 3)")
def self_exclusion(spark, d):
    """Hits on the author's own hosts are dropped."""
    hosts = table(spark, d, "pages", "page_id", "url").select("page_id", T.url_host("url").alias("host"))
    return hosts.join(hosts.where("page_id < 3").select("host").distinct(), "host", "left_anti").select("page_id")


HOST = r"regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]+)', 1)), '^www\\.', '')"


@query(f"SELECT page_id, CASE WHEN {HOST} LIKE 'm.%' THEN 'https://site.io/' || page_id ELSE url END AS site FROM pages")
def product_site(spark, d):
    """First link that isn't on a host for code, videos or documents, or below one."""
    links = F.array(F.lit("https://github.com/a/b"), F.lit("https://docs.google.com/x"), F.when(T.url_host("url").startswith("m."), F.concat(F.lit("https://demo.vercel.app/"), F.col("page_id").cast("string"))).otherwise(F.col("url")), F.concat(F.lit("https://site.io/"), F.col("page_id").cast("string")))
    return table(spark, d, "pages", "page_id", "url").select("page_id", F.coalesce(T.product_site(links), F.lit("")).alias("site"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN CAST(json_extract(props, '$.k') AS INT) ELSE -1 END AS score, CASE event_type WHEN 'click' THEN 'a,b' WHEN 'view' THEN 'c' ELSE '' END AS tags FROM events""")
def tolerant_json(spark, d):
    """JSON inside model text; a list may come as one value."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    answer = (
        F.when(kind == "click", F.concat(F.lit('Sure! {"score": '), k, F.lit(', "tags": ["a", "b"]} done'))).when(kind == "view", F.concat(F.lit('```json\n{"score": '), k, F.lit(', "tags": "c"}\n```')))
        .when(kind == "purchase", F.concat(F.lit('{"score": '), k, F.lit("}"))).when(kind == "error", "no json").otherwise('{"score": "x"')
    )
    body = F.regexp_extract("answer", r"\{[\s\S]*\}", 0)
    many, single = F.from_json(body, "score int, tags array<string>"), F.from_json(body, "score int, tags string")
    tags = F.coalesce(F.array_join(many["tags"], ","), single["tags"], F.lit(""))
    return table(spark, d, "events", "event_id", "event_type", "props").withColumn("answer", answer).select("event_id", F.coalesce(single["score"], F.lit(-1)).alias("score"), tags.alias("tags"))


@query("SELECT event_id, round(CASE WHEN s >= 1 THEN s - 1 WHEN s > 0 THEN ln(s) ELSE -1 END, 5) AS raw, round(1 / (1 + exp(-(s - 0.156) * ln(9) / (0.365 - 0.156))), 6) AS match FROM (SELECT event_id, value / 60 - 0.2 AS s FROM events)")
def rerank_scores(spark, d):
    """Raw reranker scores from their positive form, and the scale on which users read them."""
    s = F.col("value") / 60 - 0.2
    return table(spark, d, "events", "event_id", "value").select("event_id", F.round(S.from_rerank(s), 5).alias("raw"), F.round(S.match_scale(s), 6).alias("match"))


@query(r"""WITH w AS (SELECT item_id, regexp_extract_all(text, '[^.!?]*[.!?]+\s*|[^.!?]+$') AS p FROM benchmark), s AS (SELECT item_id, i AS sentence, len(regexp_extract_all(p[i], '\S+')) AS n FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM w)) SELECT item_id, CAST(sentence AS INT) AS sentence, CAST(n AS INT) AS n FROM s WHERE n > 0""")
def token_sentences(spark, d):
    """Tokens by sentence: offsets of both sides meet in one pass over each text."""
    parts = F.regexp_extract_all("text", F.lit(r"[^.!?]*[.!?]+\s*|[^.!?]+$"), F.lit(0))
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(parts).alias("at", "part"))
    return rows.select("item_id", (F.col("at") + 1).alias("sentence"), F.size(F.regexp_extract_all("part", F.lit(r"\S+"), F.lit(0))).alias("n")).where("n > 0")


@query("""WITH r AS (SELECT doc_id // 4 AS eid, doc_id, source, lang, length(text) AS n, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), f AS (SELECT source FROM r GROUP BY source HAVING avg(coalesce(toxic, 0)) > 0.06)
SELECT eid, array_to_string(list_filter([CASE WHEN bool_or(quality = 1) THEN 'winner' END, CASE WHEN count(*) > 1 THEN 'merged' END, CASE WHEN count(DISTINCT lang) > 1 THEN 'conflict' END, CASE WHEN bool_or(quality IS NULL) THEN 'imputed' END,
CASE WHEN bool_or(toxic = 1) THEN 'ai_written' END, CASE WHEN min(n) < 250 THEN 'left_open' END, CASE WHEN bool_or(f.source IS NOT NULL) THEN 'source_failed' END], lambda x: x IS NOT NULL), ',') AS badges FROM r LEFT JOIN f ON f.source = r.source GROUP BY eid""")
def entity_badges(spark, d):
    """Badges of entities from their records: prizes, merges, conflicts, missing values, detectors, open links and failed sources."""
    labels = table(spark, d, "labels", "doc_id", "quality", "toxic")
    r = table(spark, d, "documents", "doc_id", "source", "lang", "text").join(labels, "doc_id", "left").select(F.floor(F.col("doc_id") / 4).alias("eid"), "source", "lang", F.length("text").alias("n"), "quality", "toxic")
    failed = r.groupBy("source").agg(F.avg(F.coalesce("toxic", F.lit(0))).alias("share")).where("share > 0.06").select("source", F.lit(True).alias("failed"))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = {
        "winner": some(F.col("quality") == 1), "merged": F.count(F.lit(1)) > 1, "conflict": F.count_distinct("lang") > 1, "imputed": some(F.col("quality").isNull()), "ai_written": some(F.col("toxic") == 1),
        "left_open": F.min("n") < 250, "source_failed": some(F.col("failed")),
    }
    return r.join(dimension(failed), "source", "left").groupBy("eid").agg(F.array_join(badges(flags), ",").alias("badges"))


@query("""SELECT DISTINCT user_id AS eid, 'merge' AS kind, event_type AS detail FROM events WHERE event_type = 'signup' UNION SELECT user_id, 'failed', event_type FROM events WHERE event_type = 'error' AND value > 95 UNION SELECT user_id, 'imputed', CAST(CAST(json_extract(props, '$.k') AS INT) AS VARCHAR) FROM events WHERE event_id % 50 = 0""")
def evidence_ledger(spark, d):
    """Merges, failures and imputed values as one list without repeats."""
    e = table(spark, d, "events")
    rows = e.where("event_type = 'signup'").select(F.col("user_id").alias("eid"), F.lit("merge").alias("kind"), F.col("event_type").alias("detail"))
    rows = rows.unionByName(e.where("event_type = 'error' and value > 95").select(F.col("user_id").alias("eid"), F.lit("failed").alias("kind"), F.col("event_type").alias("detail")))
    rows = rows.unionByName(e.where("event_id % 50 = 0").select(F.col("user_id").alias("eid"), F.lit("imputed").alias("kind"), F.get_json_object("props", "$.k").alias("detail")))
    return rows.dropDuplicates(["eid", "kind", "detail"])


@query("SELECT event_type AS source, CASE WHEN count(*) FILTER (WHERE value > 90) * 5 > count(*) THEN 'degraded' WHEN count(*) = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n FROM events GROUP BY event_type")
def source_status(spark, d):
    status = F.when(F.count_if(F.col("value") > 90) * 5 > F.count(F.lit(1)), "degraded").when(F.count(F.lit(1)) == 0, "failed").otherwise("ok")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(status.alias("status"), F.count(F.lit(1)).alias("n"))


PRIORITY = ["error", "purchase", "signup", "click", "view"]


@query(f"SELECT user_id, min_by(event_type, list_position({sql_list(PRIORITY)}, event_type)) AS picked FROM events GROUP BY user_id")
def priority_pick(spark, d):
    """The gravest of several statuses."""
    rank = F.array_position(F.array(*(F.lit(x) for x in PRIORITY)), F.col("event_type"))
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", rank).alias("picked"))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'dead' ELSE 'alive' END AS site, page_id % 5 = 0 AND page_id % 2 = 0 AS contradicts FROM pages""")
def site_contradictions(spark, d):
    """Listings said to be live whose site is gone."""
    site = T.site_class(F.when(F.col("page_id") % 10 == 0, "timeout"), F.lit("ok"), F.when(F.col("page_id") % 5 == 0, 404).otherwise(200))
    claimed = F.when(F.col("page_id") % 2 == 0, "live").otherwise("unknown")
    return table(spark, d, "pages", "page_id").select("page_id", site.alias("site"), ((site == "dead") & (claimed == "live")).alias("contradicts"))


@query("""SELECT event_id, CASE WHEN n <= 3 THEN 'admitted' ELSE 'refused' END AS verdict FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id) AS n FROM events)""")
def daily_admission(spark, d):
    """At most three runs a day and user."""
    n = F.row_number().over(Window.partitionBy("user_id", F.date_trunc("day", F.col("ts").cast("timestamp"))).orderBy("event_id"))
    return table(spark, d, "events", "event_id", "user_id", "ts").withColumn("n", n).select("event_id", F.when(F.col("n") <= 3, "admitted").otherwise("refused").alias("verdict"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS norm FROM embeddings")
def vector_norms(spark, d):
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.round(S.norm("embedding"), 4).alias("norm"))
