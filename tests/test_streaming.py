"""Streaming forms against their batch forms."""

from pyspark.sql import functions as F

from cairn.streaming import events as V


def test_stream_fold_and_dedupe(spark, sf_dir, tmp_path):
    base = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    base.unionByName(base.where("event_id % 17 = 0")).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(base.schema).parquet(str(tmp_path / "in"))
    V.run_available(V.dedupe(stream, ["event_id"], "60 days"), str(tmp_path / "c1"), lambda df, i: seen.append(df.count()))
    assert sum(seen) == base.count()
    out = {}
    folded = V.stream_fold(stream.select("user_id", "event_id", "event_type", "value"))
    V.run_available(folded, str(tmp_path / "c2"), lambda df, i: out.update({r.user_id: tuple(r) for r in df.collect()}), "update")
    want = {r.user_id: tuple(r) for r in V.fold_state(base.select("user_id", "event_id", "event_type", "value")).collect()}
    assert {k: (v[1], v[2], v[4]) for k, v in out.items()} == {k: (v[1], v[2], v[4]) for k, v in want.items()}


def test_gaps(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 7)], "run long, seq long")
    assert [(r.run, r.seq, r.previous) for r in V.gaps(rows, "run", "seq").collect()] == [(1, 4, 2)]
