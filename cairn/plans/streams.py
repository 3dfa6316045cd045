"""Stream queries; those marked *stream* run Structured Streaming over files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph
from ..operators.storage import shared_dir
from ..sources.readers import table
from ..streaming import events as V
from .base import Catalog

catalog = Catalog()
query = catalog.query


def events(spark, d):
    return table(spark, d, "events")


@query("SELECT user_id, event_id, previous FROM (SELECT user_id, event_id // 40 AS event_id, lag(event_id // 40) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE previous IS NOT NULL AND event_id <> previous + 1 AND event_id <> previous")
def event_gap_check(spark, d):
    rows = events(spark, d).select("user_id", F.floor(F.col("event_id") / 40).alias("event_id"), F.col("event_id").alias("at"))
    last = rows.withColumn("previous", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("at")))
    return last.where("previous is not null and event_id <> previous + 1 and event_id <> previous").select("user_id", "event_id", "previous")


@query("SELECT user_id, event_id, round(coalesce(least(greatest(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY event_id), 0), 2.5) / 4.0, 0), 6) AS wait FROM events")
def event_replay_gap(spark, d):
    return V.replay_gaps(events(spark, d), "user_id", "event_id", "ts", speed=4.0).select("user_id", "event_id", F.round("wait", 6).alias("wait"))


@query("SELECT user_id, event_id, coalesce(min(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS next_click FROM events WHERE event_type IN ('click', 'error')")
def next_event(spark, d):
    """The next click after each event of a user."""
    ahead = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    rows = events(spark, d).where(F.col("event_type").isin("click", "error"))
    return rows.select("user_id", "event_id", F.coalesce(F.min(F.when(F.col("event_type") == "click", F.col("event_id"))).over(ahead), F.lit(-1)).alias("next_click"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark, d):
    return V.sessions(events(spark, d), "30 minutes", "user_id").select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    return V.tumbling(events(spark, d), "1 hour", ["event_type"]).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts) - to_hours(h), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events, (VALUES (0), (1)) AS t(h) GROUP BY ALL")
def sliding_counts(spark, d):
    return V.tumbling(events(spark, d), "2 hours", [], "1 hour").select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    """*stream*: every 17th event is sent twice; duplicates within the watermark are dropped, then events are counted by day."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    base = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    base.unionByName(base.where("event_id % 17 = 0")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(base.schema).parquet(f"{folder}/in")
    clean = V.dedupe(stream, ["event_id"], "40 days")
    V.run_available(clean, f"{folder}/checkpoint", lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out/batch={i}"))
    out = spark.read.parquet(f"{folder}/out")
    return V.tumbling(out, "1 day", ["event_type"]).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


RECOVERY = "WITH g AS (SELECT user_id, max(event_id) AS last_seq, count(*) AS n, sum(value) AS total FROM events GROUP BY user_id), f AS (SELECT user_id, event_id, count(*) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS clicks, event_type FROM events), e AS (SELECT user_id, arg_max(clicks, event_id) AS clicks FROM f WHERE event_type = 'error' GROUP BY user_id)"


@query(f"{RECOVERY} SELECT user_id, last_seq, n, round(total, 4) AS total, CASE WHEN clicks IS NULL THEN 'running' WHEN clicks > 0 THEN 'recovered' ELSE 'failed' END AS status FROM g LEFT JOIN e USING (user_id)")
def event_fold_state(spark, d):
    state = V.fold_state(events(spark, d).select("user_id", "event_id", "event_type", "value"))
    return state.select("user_id", "last_seq", "n", F.round("total", 4).alias("total"), "status")


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, round(epoch(max(ts)) - epoch(min(ts)), 3) AS elapsed, count(*) FILTER (WHERE event_type = 'click') AS tool_calls, count(*) FILTER (WHERE event_type = 'view') AS records, count(*) FILTER (WHERE event_type = 'error') AS errors,
round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 4) AS spent, arg_max(CAST(json_extract(props, '$.k') AS INT), event_id) FILTER (WHERE event_type = 'signup') AS "left", CASE WHEN arg_max(event_type, event_id) = 'purchase' THEN 'finished'
WHEN max(event_id) FILTER (WHERE event_type = 'error') > coalesce(max(event_id) FILTER (WHERE event_type = 'click'), -1) THEN 'failed' WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'recovered' ELSE 'running' END AS phase, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events GROUP BY user_id""")
def run_state(spark, d):
    """State of each run by field, as a reducer over its events leaves it."""
    rows = V.run_state(events(spark, d))
    return rows.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), F.round("elapsed", 3).alias("elapsed"), "tool_calls", "records", "errors", F.round("spent", 4).alias("spent"), "left", "phase", F.array_join("types", ",").alias("types"))


@query("WITH a AS (SELECT user_id, min(event_id) AS after FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT user_id, event_id FROM events LEFT JOIN a USING (user_id) WHERE after IS NULL OR event_id > after")
def resume_after_event(spark, d):
    """The backlog of readers that have acknowledged everything up to their first purchase."""
    e = events(spark, d)
    seen = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("event_id").alias("after"))
    return V.resume_after(e.select("user_id", "event_id"), seen)


@query("""WITH e AS (SELECT user_id AS key, event_id // 3 AS id, CASE event_type WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'release' ELSE 'reserve' END AS op, value AS amount, ts FROM events), g AS (SELECT key, id, max(amount) FILTER (WHERE op = 'reserve') AS r, max(amount) FILTER (WHERE op = 'commit') AS c, max(amount) FILTER (WHERE op = 'release') AS x,
max(ts) FILTER (WHERE op = 'reserve') AS since FROM e GROUP BY 1, 2), s AS (SELECT *, r IS NOT NULL AND c IS NULL AND x IS NULL AS o, since > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 15 MINUTE AS f FROM g)
SELECT key, round(coalesce(sum(c), 0), 4) AS committed, round(coalesce(sum(r) FILTER (WHERE o AND f), 0), 4) AS held, round(coalesce(sum(r) FILTER (WHERE o AND NOT f), 0), 4) AS expired FROM s GROUP BY key""")
def reservation_ledger(spark, d):
    """Reserved, committed and released amounts at a point in time; reservations expire after 15 minutes."""
    op = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "error", "release").otherwise("reserve")
    rows = events(spark, d).select(F.col("user_id").alias("key"), F.floor(F.col("event_id") / 3).alias("id"), op.alias("op"), F.col("value").alias("amount"), F.col("ts").cast("timestamp").alias("ts"))
    return V.reservations(rows, F.lit("2024-01-20 12:00:00").cast("timestamp")).select("key", *(F.round(c, 4).alias(c) for c in ("committed", "held", "expired")))


@query("SELECT user_id, max_by(event_type, event_id) AS last_type, min_by(event_type, event_id) AS first_type, count(*) AS n FROM events GROUP BY user_id")
def last_and_first_wins(spark, d):
    """Upserts by key: the last event wins, and the first for fields that stay."""
    g = events(spark, d).groupBy("user_id")
    return g.agg(F.max_by("event_type", "event_id").alias("last_type"), F.min_by("event_type", "event_id").alias("first_type"), F.count(F.lit(1)).alias("n"))


DOCS = "docs AS (SELECT doc_id AS rid, source AS topic, DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS first_seen, doc_id % 100 / 100.0 AS score, n_chars < 250 AS flagged FROM documents), w AS (SELECT i AS watch_id, 'src' || i AS wanted, DATE '2024-01-20' + i AS last_checked, 0.3 + i / 20.0 AS threshold, i <> 3 AS active FROM (SELECT CAST(unnest(range(10)) AS INT) AS i))"


@query(f"WITH {DOCS} SELECT watch_id, rid, CAST(rank AS INT) AS rank FROM (SELECT watch_id, rid, row_number() OVER (PARTITION BY watch_id ORDER BY score DESC, rid) AS rank FROM docs JOIN w ON topic = wanted AND first_seen > last_checked WHERE active AND score >= threshold AND NOT flagged) WHERE rank <= 5")
def watch_recheck(spark, d):
    docs, watches = watched(spark, d)
    return V.watch_hits(docs, watches).select("watch_id", "rid", "rank")


def watched(spark, d):
    i = F.col("id").cast("int")
    watches = spark.range(10).select(i.alias("watch_id"), F.concat(F.lit("src"), i.cast("string")).alias("wanted"), F.date_add(F.lit("2024-01-20").cast("date"), i).alias("last_checked"), (0.3 + i / 20.0).alias("threshold"), (i != 3).alias("active"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("rid"), F.col("source").alias("topic"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("first_seen"), (F.col("doc_id") % 100 / 100.0).alias("score"), (F.col("n_chars") < 250).alias("flagged"))
    return docs, watches


@query(f"WITH {DOCS}, b AS (SELECT *, rid % 2 AS batch FROM docs), h AS (SELECT watch_id, rid, row_number() OVER (PARTITION BY watch_id, batch ORDER BY score DESC, rid) AS rank FROM b JOIN w ON topic = wanted AND first_seen > last_checked WHERE active AND score >= threshold AND NOT flagged), m AS (SELECT max(first_seen) AS newest FROM docs) SELECT w.watch_id, strftime(greatest(last_checked, newest), '%Y-%m-%d') AS cursor, (SELECT count(*) FROM h WHERE h.watch_id = w.watch_id AND rank <= 5) AS alerts FROM w, m")
def stream_watch_alerts(spark, d):
    """*stream*: watches are re-checked against two batches of documents; alerts go to a sink and the cursors move on."""
    folder = f"{shared_dir(spark)}/watch-{uuid.uuid4().hex}"
    docs, watches = watched(spark, d)
    for k in (0, 1):
        docs.where(F.col("rid") % 2 == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    V.watch_stream(stream, watches, folder)
    cursors = spark.read.parquet(f"{folder}/cursors").groupBy("watch_id").agg(F.date_format(F.max("cursor"), "yyyy-MM-dd").alias("cursor"))
    alerts = spark.read.parquet(f"{folder}/alerts").groupBy("watch_id").agg(F.count(F.lit(1)).alias("n"))
    return cursors.join(alerts, "watch_id", "left").select("watch_id", "cursor", F.coalesce("n", F.lit(0)).alias("alerts"))


@query("SELECT event_type, count(*) FILTER (WHERE event_id % 2 = 0) AS here, count(*) FILTER (WHERE event_id % 2 = 1) AS there FROM events GROUP BY 1 HAVING here <> there")
def multiset_parity(spark, d):
    """Event types that two hosts didn't emit equally often, with the counts of both: one aggregation tells both directions."""
    host = F.col("event_id") % 2
    g = events(spark, d).groupBy("event_type").agg(F.count_if(host == 0).alias("here"), F.count_if(host == 1).alias("there"))
    return g.where("here <> there")


GRAPH = """p AS (SELECT user_id AS node, event_id AS seq, CASE event_type WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'update' ELSE 'upsert' END AS op, round(value, 4) AS value, props AS label FROM events),
rm AS (SELECT node, max(seq) AS removed FROM p WHERE op = 'remove' GROUP BY node), lv AS (SELECT p.* FROM p LEFT JOIN rm USING (node) WHERE op <> 'remove' AND (removed IS NULL OR seq > removed)), nd AS (SELECT node, min(seq) AS made, arg_max(value, seq) AS value FROM lv WHERE op = 'upsert' GROUP BY node),
lb AS (SELECT node, arg_max(label, seq) AS label FROM lv JOIN nd USING (node) WHERE op = 'update' AND seq > made GROUP BY node)"""


def patches(spark, d):
    kind = F.col("event_type")
    op = F.when(kind == "error", "remove").when(kind == "signup", "update").otherwise("upsert")
    return events(spark, d).select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), op.alias("op"), F.round("value", 4).alias("value"), F.col("props").alias("label"))


@query(f"WITH {GRAPH} SELECT node, value, coalesce(label, '') AS label FROM nd LEFT JOIN lb USING (node)")
def graph_patches(spark, d):
    """Nodes after upserts, updates and removals."""
    return graph.graph_nodes(patches(spark, d)).select("node", "value", F.coalesce("label", F.lit("")).alias("label"))


@query(f"WITH {GRAPH}, e AS (SELECT user_id AS a, event_id % 150 AS b, event_type AS kind, arg_max(round(value, 4), event_id) AS weight FROM events WHERE user_id <> event_id % 150 GROUP BY 1, 2, 3) SELECT a, b, kind, weight, x.node IS NULL OR y.node IS NULL AS pending FROM e LEFT JOIN nd x ON x.node = a LEFT JOIN nd y ON y.node = b")
def graph_links(spark, d):
    """Keyed links by their last state; those whose ends don't both exist wait."""
    links = events(spark, d).select(F.col("user_id").alias("a"), (F.col("event_id") % 150).alias("b"), F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), F.round("value", 4).alias("weight"))
    return graph.graph_edges(links, graph.graph_nodes(patches(spark, d)))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, max(CAST(json_extract(props, '$.k') AS INT)) AS k FROM events GROUP BY ALL")
def json_props(spark, d):
    return events(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max(F.get_json_object("props", "$.k").cast("int")).alias("k"))
