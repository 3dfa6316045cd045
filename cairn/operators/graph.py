"""The state of a graph after its patches, and badges of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_nodes(patches: DataFrame) -> DataFrame:
    """(node, value, label): nodes after all patches (node, seq, op, value, label).

    An upsert makes a node and sets its value, an update sets the label of a node that is there, a removal takes it away with all it had; later patches win. What counts is what
    follows a node's last removal, so the state is three aggregations by node and no patch is replayed in order."""
    removed = patches.where("op = 'remove'").groupBy("node").agg(F.max("seq").alias("removed"))
    live = patches.where("op <> 'remove'").join(removed, "node", "left").where(F.col("removed").isNull() | (F.col("seq") > F.col("removed")))
    upsert = F.col("op") == "upsert"
    nodes = live.where(upsert).groupBy("node").agg(F.min("seq").alias("made"), F.max_by("value", "seq").alias("value"))
    labels = live.where(~upsert).join(nodes.select("node", "made"), "node").where("seq > made").groupBy("node").agg(F.max_by("label", "seq").alias("label"))
    return nodes.select("node", "value").join(labels, "node", "left")


def graph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, kind, weight, pending): the last state of each keyed edge (a, b, kind, seq, weight); an edge waits until both of its ends exist."""
    last = edges.where("a <> b").groupBy("a", "b", "kind").agg(F.max_by("weight", "seq").alias("weight"))
    have = nodes.select("node", F.lit(1).alias("there"))
    for end in "ab":
        last = last.join(have.select(F.col("node").alias(end), F.col("there").alias(f"has_{end}")), end, "left")
    return last.select("a", "b", "kind", "weight", (F.col("has_a").isNull() | F.col("has_b").isNull()).alias("pending"))


def badges(flags: dict[str, F.Column]) -> F.Column:
    """Names of the flags that hold, in their order."""
    return F.array_compact(F.array(*(F.when(flag, name) for name, flag in flags.items())))
