"""Corpus cleaning pipeline: five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each stage's rows to the shared
folder as Parquet and rereads them, so a lost executor costs no earlier stage. All stages but the last return the
columns of ``documents``.

1. quality: rejects the documents that importance resampling doesn't select.
2. near_duplicates: of each class of rows linked by Jaccard similarity, the one with the smallest doc_id stays (null ids come last).
3. decontaminate: rejects documents of which benchmark windows hit 5 % of the words or more.
4. secrets: replaces every secret in the texts by a mark.
5. tokens: token ids of the texts, and a check that they decode to the text.

Stages 2 to 4 tell rows apart by their place in the stored table, so rows that share a doc_id, or have none, are judged each by their own text.
Null and empty texts are nobody's duplicate, hold no benchmark words, secrets or tokens, and are judged by stage 1 like any text; an empty
table stays empty in every stage; other columns of any name (but those of ROW and FOUND) are carried through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, decontaminate, jaccard, quality, secrets
from cairn.llm.common import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Added columns of the stages; a table may hold any others.
ROW, FOUND = "__cairn_row", "__cairn_spans"


def keyed(docs: DataFrame) -> DataFrame:
    """``docs``, read from files, with ROW: a key of each row that doesn't depend on how scans are cut into tasks."""
    return docs.withColumn(ROW, F.xxhash64("_metadata.file_path", "_metadata.row_index"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    classes = jaccard.join_components(rows, ROW).select(F.col("doc_id").alias(ROW), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.octet_length("text").alias("size"), F.col(ROW).alias("row"))
    best = rows.select(ROW, order.alias("order")).join(classes, ROW).groupBy("component_id").agg(F.min("order").alias("order"))
    return rows.join(best.select(F.col("order.row").alias(ROW)), ROW).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    found = decontaminate.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW)
    return rows.join(found.where("contaminated").select(F.col("doc_id").alias(ROW)), ROW, "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    found = secrets.scan(rows, ROW).where(F.size("spans") > 0).select(F.col("doc_id").alias(ROW), F.col("spans").alias(FOUND))
    masked = rows.join(found, ROW, "left")
    text = F.when(F.col(FOUND).isNotNull(), secrets.redact(F.col("text"), F.col(FOUND))).otherwise(F.col("text"))
    masked = masked.withColumn("text", text)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col(FOUND).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*(c for c in ("doc_id", "lang", "source", "text") if c in docs.columns))
    codec = bpe.fit_lexicon(docs, bpe.vocabulary_file())
    coded = bpe.encode_and_decode(docs, codec)
    return coded.select(*(c for c in docs.columns if c != "text"), *bpe.digests(coded), F.coalesce("text", F.lit("")).eqNullSafe(F.col("decoded")).alias("round_trip"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", tokens),
]

#: Importance weights, the randomness battery and BPE can't be expressed in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
