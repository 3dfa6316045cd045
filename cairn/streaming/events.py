"""Event streams: de-duplication, gap checks, windows, keyed folds, watch re-checks. The same functions serve batch and streaming frames where Spark allows it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.readers import dimension

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
STATE_SCHEMA = "user_id long, last_seq long, n long, total double, status string"


def gaps(events: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows whose sequence number isn't one above the previous of the key."""
    last = F.lag(seq).over(Window.partitionBy(key).orderBy(seq))
    return events.withColumn("previous", last).where(F.col("previous").isNotNull() & (F.col(seq) != F.col("previous") + 1))


def replay_gaps(events: DataFrame, key: str, seq: str, ts: str, cap: float = 2.5, speed: float = 1.0) -> DataFrame:
    """Seconds to wait before each event: the time since the previous one, between 0 and ``cap``, over ``speed``."""
    at = F.col(ts).cast("timestamp").cast("double")
    wait = at - F.lag(at).over(Window.partitionBy(key).orderBy(seq))
    return events.withColumn("wait", F.coalesce(F.least(F.greatest(wait, F.lit(0.0)), F.lit(cap)) / speed, F.lit(0.0)))


def dedupe(events: DataFrame, keys: list[str], watermark: str = "1 day", ts: str = "ts") -> DataFrame:
    """One event of each key; on a stream, keys are forgotten after the watermark."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def tumbling(events: DataFrame, size: str, by: list[str], slide: str | None = None, ts: str = "ts") -> DataFrame:
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, by: str, ts: str = "ts") -> DataFrame:
    return events.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))


def fold_state(events: DataFrame) -> DataFrame:
    """State of each user after all its events, each sequence number counted once: an error marks the state failed and the next click recovers it.

    Batch form of :func:`stream_fold`. What an ordered fold leaves is a function of the last error and the last click, so it is one aggregation with partial sums;
    no user's events are gathered."""
    once = events.dropDuplicates(["user_id", "event_id"])
    kind = F.col("event_type")
    g = once.groupBy("user_id").agg(
        F.max("event_id").alias("last_seq"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max(F.when(kind == "error", F.col("event_id"))).alias("error"), F.max(F.when(kind == "click", F.col("event_id"))).alias("click")
    )
    status = F.when(F.col("error").isNull(), "running").when(F.col("click") > F.col("error"), "recovered").otherwise("failed")
    return g.select("user_id", "last_seq", "n", "total", status.alias("status"))


def run_state(events: DataFrame) -> DataFrame:
    """State of each run after all its events, by field: first wins (start), last wins (last type, budget), sums (cost, counts by type), sets (types seen), and what depends on order
    (failed sources, those that recovered). Every field is an aggregate with partial sums."""
    kind, seq, value = F.col("event_type"), F.col("event_id"), F.col("value")
    of = lambda k, x: F.when(kind == k, x)
    g = events.dropDuplicates(["user_id", "event_id"]).groupBy("user_id").agg(
        F.min_by("ts", seq).alias("started"), F.max_by("ts", seq).alias("last"), F.max_by("event_type", seq).alias("last_type"), F.count_if(kind == "click").alias("tool_calls"), F.count_if(kind == "view").alias("records"),
        F.count_if(kind == "error").alias("errors"), F.coalesce(F.sum(of("purchase", value)), F.lit(0.0)).alias("spent"), F.max(of("purchase", value)).alias("largest"), F.max_by(of("signup", F.col("props")), of("signup", seq)).alias("budget"),
        F.max(of("error", seq)).alias("error"), F.max(of("click", seq)).alias("click"), F.max(seq).alias("end"), F.array_sort(F.collect_set("event_type")).alias("types"),
    )
    phase = F.when(F.col("last_type") == "purchase", "finished").when(F.col("error") > F.coalesce("click", F.lit(-1)), "failed").when(F.col("error").isNotNull(), "recovered").otherwise("running")
    return g.withColumns({"phase": phase, "elapsed": F.col("last").cast("timestamp").cast("double") - F.col("started").cast("timestamp").cast("double"), "left": F.get_json_object("budget", "$.k").cast("int")})


def _fold(state: tuple | None, rows: pd.DataFrame) -> tuple:
    last, n, total, status = state or (-1, 0, 0.0, "new")
    for seq, kind, value in zip(rows["event_id"], rows["event_type"], rows["value"], strict=True):
        if seq <= last:
            continue
        last, n, total = int(seq), n + 1, total + float(value)
        status = "failed" if kind == "error" else "recovered" if status == "failed" and kind == "click" else "running" if status == "new" else status
    return last, n, total, status


def stream_fold(events: DataFrame) -> DataFrame:
    """Running state per user on a stream."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(key, batches, state):
        rows = pd.concat(list(batches)).sort_values("event_id")
        new = _fold(state.get if state.exists else None, rows)
        state.update(new)
        yield pd.DataFrame([(key[0], *new)], columns=["user_id", "last_seq", "n", "total", "status"])

    return events.groupBy("user_id").applyInPandasWithState(fold, STATE_SCHEMA, "last_seq long, n long, total double, status string", "update", GroupStateTimeout.NoTimeout)


def watch_hits(docs: DataFrame, watches: DataFrame, limit: int = 5) -> DataFrame:
    """New documents for each active watch: first seen after its cursor, not flagged, at least its own threshold; the best few. Watches go by broadcast as long as they are few."""
    pairs = docs.join(dimension(watches.where("active")), (F.col("first_seen") > F.col("last_checked")) & (F.col("topic") == F.col("wanted")))
    good = pairs.where((F.col("score") >= F.col("threshold")) & ~F.col("flagged"))
    rank = F.row_number().over(Window.partitionBy("watch_id").orderBy(F.desc("score"), "rid"))
    return good.withColumn("rank", rank).where(F.col("rank") <= limit)


def watch_stream(docs: DataFrame, watches: DataFrame, folder: str, limit: int = 5) -> None:
    """Re-check all watches against each batch of new documents, write its alerts, and move the cursors of the watches to the newest document seen.

    ``folder/alerts/batch=n`` and ``folder/cursors/batch=n`` are overwritten when a batch is repeated after a failure, so each batch counts once. A document that arrives late is
    judged against the cursor as it was armed, not against the newest document, so none is lost."""
    def check(batch: DataFrame, i: int) -> None:
        watch_hits(batch, watches, limit).select("watch_id", "rid", "score", "first_seen", "rank").write.mode("overwrite").parquet(f"{folder}/alerts/batch={i}")
        seen = batch.agg(F.max("first_seen").alias("newest"))  # one row
        moved = watches.crossJoin(F.broadcast(seen)).select("watch_id", F.greatest("last_checked", "newest").alias("cursor"))
        moved.write.mode("overwrite").parquet(f"{folder}/cursors/batch={i}")

    run_available(docs, f"{folder}/checkpoint", check)


def resume_after(events: DataFrame, acknowledged: DataFrame, key: str = "user_id", seq: str = "event_id") -> DataFrame:
    """What a reader that has acknowledged (key, after) still has to get: everything behind it, all of keys that it has never seen."""
    return events.join(acknowledged.select(key, "after"), key, "left").where(F.col("after").isNull() | (F.col(seq) > F.col("after"))).drop("after")


def reservations(entries: DataFrame, now, minutes: int = 15) -> DataFrame:
    """(key, committed, held, expired): a reservation counts until it is committed or released, or ``minutes`` old; a commitment counts for good.

    entries: key, id, op (reserve, commit, release), amount, ts."""
    g = entries.groupBy("key", "id").agg(*(F.max(F.when(F.col("op") == op, F.col("amount"))).alias(op) for op in ("reserve", "commit", "release")), F.max(F.when(F.col("op") == "reserve", F.col("ts"))).alias("at"))
    open_ = F.col("reserve").isNotNull() & F.col("commit").isNull() & F.col("release").isNull()
    fresh = F.col("at") > now - F.expr(f"INTERVAL {minutes} MINUTES")
    sums = {"committed": F.col("commit"), "held": F.when(open_ & fresh, F.col("reserve")), "expired": F.when(open_ & ~fresh, F.col("reserve"))}
    return g.groupBy("key").agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(k) for k, c in sums.items()))


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is there, batch by batch, and stop; a restart with the same checkpoint resumes behind it."""
    query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
