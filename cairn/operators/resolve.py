"""Entity resolution: blocking, pair scores, components, fusion, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# How far each source is trusted for each field.
RELIABILITY = {
    "status": {"github": 0.8, "yc": 0.9, "web": 0.85, "hn": 0.5, "devpost": 0.6, "arxiv": 0.5},
    "last_activity": {"github": 0.95, "hn": 0.8, "yc": 0.7, "devpost": 0.6, "web": 0.6, "arxiv": 0.7},
    "year": {"github": 0.9, "hn": 0.9, "arxiv": 0.9, "yc": 0.7, "devpost": 0.6, "web": 0.4},
    "tech": {"github": 0.9, "devpost": 0.8, "yc": 0.4, "hn": 0.3, "web": 0.4, "arxiv": 0.3},
}
#: Least trigram Jaccard similarity of two names.
NAME_JACCARD = 0.6


def url_pairs(records: DataFrame) -> DataFrame:
    """(a, b): records that share an address key. Each member is paired with the group's smallest, so a hot address costs its count, not its square."""
    keys = records.select("rid", F.explode("url_keys").alias("key")).where(F.col("key").isNotNull()).distinct()
    least = keys.groupBy("key").agg(F.min("rid").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keys.join(least, "key").where("rid <> a").select("a", F.col("rid").alias("b")).distinct()


def name_pairs(names: DataFrame, threshold: float = NAME_JACCARD) -> DataFrame:
    """(a, b, sim): distinct names with trigram Jaccard of ``threshold`` or more. Exact: pairs share one of their first trigrams in order of rarity (prefix filter)."""
    distinct = names.select("name").where("name <> ''").distinct().withColumn("grams", T.trigrams("name"))
    grams = distinct.select("name", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    order = F.row_number().over(Window.partitionBy("name").orderBy("df", "gram"))
    prefix = grams.join(df, "gram").withColumn("place", order).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).where("df > 1")
    a, b = (prefix.select(F.col("name").alias(x), F.col("n").alias(f"n{x}"), "gram") for x in "ab")
    near = F.least("na", "nb") >= F.greatest("na", "nb") * threshold
    pairs = a.join(b, "gram").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    sides = pairs.join(distinct.select(F.col("name").alias("a"), F.col("grams").alias("ga")), "a").join(distinct.select(F.col("name").alias("b"), F.col("grams").alias("gb")), "b")
    return sides.withColumn("sim", T.jaccard("ga", "gb")).where(F.col("sim") >= threshold).select("a", "b", "sim")


def decide(pairs: DataFrame, adjudicated: int = 8) -> DataFrame:
    """Verdicts: shared addresses are the same; of the rest the most similar few await a judgement, others are ignored."""
    asked = pairs.where(~F.col("url_xref")).orderBy(F.desc("sim"), "a", "b").limit(adjudicated).select("a", "b", F.lit(True).alias("asked"))  # a bounded top-k
    return pairs.join(F.broadcast(asked), ["a", "b"], "left").withColumn("verdict", F.when(F.col("url_xref"), "same").when(F.col("asked"), "ask").otherwise("ignored")).drop("asked")


def decide_capped(pairs: DataFrame, most: int = 24, asked: int = 16) -> DataFrame:
    """Verdicts of open pairs (a, b, sim) under a cap: the ``asked`` most similar are judged, unless more than ``most`` are open."""
    first = pairs.orderBy(F.desc("sim"), "a", "b").limit(most + 1).select("a", "b", "sim")  # a bounded top-k
    count = first.agg(F.count(F.lit(1)).alias("open"))
    few = first.crossJoin(F.broadcast(count)).where(F.col("open") <= most).orderBy(F.desc("sim"), "a", "b").limit(asked).select("a", "b", F.lit(True).alias("ask"))
    return pairs.join(F.broadcast(few), ["a", "b"], "left").withColumn("verdict", F.when(F.col("ask"), "ask").otherwise("unadjudicated")).drop("ask")


def components(nodes: DataFrame, edges: DataFrame, spark_dir: str | None = None) -> DataFrame:
    """(id, component): smallest id that edges (a, b) reach. Labels spread along edges and jump to their labels' labels, so rounds grow with the logarithm of the diameter."""
    from .storage import discard, step

    both = step(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), spark_dir)
    labels = step(nodes.select("id", F.col("id").alias("component")), spark_dir)
    while True:
        spread = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        moved = labels.join(spread, "id", "left").select("id", F.least("component", F.coalesce("near", "component")).alias("to"))
        jump = moved.join(labels.select(F.col("id").alias("to"), F.col("component").alias("far")), "to", "left").select("id", F.least("to", F.coalesce("far", "to")).alias("component"))
        new = step(jump, spark_dir)
        changed = new.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(both)
            return labels


def fuse(values: DataFrame) -> DataFrame:
    """One value per (eid, field): most reliable source, then most similar record. values: eid, field, source, value, sim, rid."""
    prior = F.lit(None).cast("double")
    for field, by in RELIABILITY.items():
        for source, p in by.items():
            prior = F.when((F.col("field") == field) & (F.col("source") == source), p).otherwise(prior)
    rows = values.where("value is not null").withColumn("reliability", F.coalesce(prior, F.lit(0.5)))
    rank = F.row_number().over(Window.partitionBy("eid", "field").orderBy(F.desc("reliability"), F.desc("sim"), "rid"))
    best = rows.withColumn("__n", rank).where("__n = 1").drop("__n")
    spread = rows.groupBy("eid", "field").agg(F.count_distinct("value").alias("n_values"), F.array_sort(F.collect_set("source")).alias("sources"))
    return best.join(spread, ["eid", "field"]).select("eid", "field", "value", "source", "reliability", "n_values", "sources")


def conflicts(records: DataFrame) -> DataFrame:
    """(eid, kind): years more than one apart, activity dates more than 365 days apart, or both live and gone."""
    g = records.groupBy("eid").agg(
        (F.max("year") - F.min("year")).alias("years"), F.datediff(F.max("date"), F.min("date")).alias("days"), F.array_contains(F.collect_set("status"), "live").alias("live"), F.array_contains(F.collect_set("status"), "gone").alias("gone")
    )
    kinds = F.array_compact(F.array(F.when(F.col("years") > 1, "year"), F.when(F.col("days") > 365, "date"), F.when(F.col("live") & F.col("gone"), "status")))
    return g.select("eid", F.explode(kinds).alias("kind"))
