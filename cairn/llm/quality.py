"""Quality classifier by importance resampling.

Texts are bags of hashed word n-grams (words and runs of punctuation, case kept; unigrams and bigrams, and all
bigrams of a word with itself in one bucket). Two generative models, multinomials over the buckets with add-one
smoothing, describe the raw corpus (all rows) and the target (labelled good documents). A document's
log importance weight is the sum over its n-grams of the log ratio of the two models. Documents are then
sampled without replacement by Gumbel top-k: those with the k largest values of log weight plus Gumbel noise,
where k is the number of documents whose weight lies above the threshold that separates the labelled
good from the labelled bad documents best.

The noise is a hash of the doc_id, so a run can be repeated. The k-th largest key is found by narrowing
histograms, which gather a fixed number of rows each, never by sorting in one task.

The raw model counts all rows. The target model and the threshold are fitted on at most LABELLED documents of each
label, those with the smallest hashes; so their ids can be broadcast. Models have 2**BITS buckets.

Defined cases: null and empty texts have no n-grams and weight 0; documents with equal keys (repeated rows) are
selected or rejected together; without labels of one kind all documents are selected; labels of unknown or null
documents are ignored, and of contradicting labels the smallest counts; an empty table gives no rows. Extra
columns are carried by ``select`` and not read otherwise, whatever their names (those of N_GRAMS, LOG_WEIGHT and KEY are reserved).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import WORD_PUNCT, Words, discard, kth_largest, materialize, mix, text_views

BITS, LABELLED, SEED = 14, 20_000, 20240607
#: Added columns, whose names no other column may have.
N_GRAMS, LOG_WEIGHT, KEY = "__cairn_n_grams", "__cairn_log_weight", "__cairn_key"
_U = np.uint64


def grams(words: Words, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, rows) of all n-grams of a slice."""
    _, _, h, ends = words(data, bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(ends))
    with np.errstate(over="ignore"):
        pair = mix(h[:-1] * _U(0xD1342543DE82EF95) + h[1:])
    pair = np.where(h[:-1] == h[1:], _U(0x5555 << 48), pair)
    inside = row[1:] == row[:-1]
    bucket = np.concatenate([h, pair[inside]]) >> _U(64 - BITS)
    return bucket.astype(np.int64), np.concatenate([row, row[1:][inside]])


def bucket_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """n-gram counts by bucket over all rows, summed in the tasks first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(WORD_PUNCT, fold=False), np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            for _, _, data, bounds in text_views(batch.column(0)):
                total += np.bincount(grams(words, data, bounds)[0], minlength=1 << BITS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(1 << BITS, dtype=np.int64)
    for bucket, n in docs.select(F.col(text_col).cast("string")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


@dataclass
class Model:
    ratio: np.ndarray  # log ratio by bucket
    threshold: float

    def weigh(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with N_GRAMS and LOG_WEIGHT."""
        at, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(self.ratio)

        def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = Words(WORD_PUNCT, fold=False)
            for batch in batches:
                for first, rows, data, bounds in text_views(batch.column(at)):
                    bucket, row = grams(words, data, bounds)
                    n = np.bincount(row, minlength=rows)
                    weight = np.bincount(row, weights=shared.value[bucket], minlength=rows)
                    part = batch.slice(first, rows)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64()), pa.array(weight, pa.float64())], names=[*part.schema.names, N_GRAMS, LOG_WEIGHT])

        return docs.mapInArrow(weighed, StructType([*docs.schema.fields, StructField(N_GRAMS, LongType()), StructField(LOG_WEIGHT, DoubleType())]))


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the fewest errors, each label weighted equally; the middle of the gap that it lies in."""
    if not len(good) or not len(bad):
        return -np.inf
    values = np.concatenate([good, bad])
    step = np.concatenate([np.full(len(good), 1 / len(good)), np.full(len(bad), -1 / len(bad))])
    order = np.lexsort((step, values))
    values, lost = values[order], np.concatenate(([0.0], np.cumsum(step[order])))
    ends = np.flatnonzero(np.concatenate((values[1:] != values[:-1], [True]))) + 1  # cuts between distinct values
    cut = int(ends[np.argmin(lost[ends])])
    return float((values[cut - 1] + values[cut]) / 2) if cut < len(values) else float(values[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED) -> Model:
    ids = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"))
    parts = [ids.where(F.col("quality") == q).orderBy(F.xxhash64(id_col, F.lit(SEED)), id_col).limit(labelled) for q in (1, 0)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]).select(F.col(id_col).alias("__id"), F.col("quality").alias("__quality")))  # at most 2 * labelled ids
    known = materialize(docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(chosen, "__id"), "labelled")
    raw, target = bucket_counts(docs, text_col), bucket_counts(known.where("__quality = 1"), "text")
    log = lambda c: np.log((c + 1.0) / (c.sum() + len(c)))
    model = Model(log(target) - log(raw), -np.inf)
    weights = model.weigh(known, "text").select("__quality", LOG_WEIGHT).collect()
    discard(known)
    by = {q: np.array([w for x, w in weights if x == q]) for q in (1, 0)}
    model.threshold = best_threshold(by[1], by[0])
    return model


def gumbel(doc_id: Column) -> Column:
    """Standard Gumbel noise from a hash of the id."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(SEED + 1)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """(``docs`` with N_GRAMS, LOG_WEIGHT and KEY; the cutoff): rows with KEY >= cutoff are selected."""
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    model = fit(docs, labels, id_col, text_col)
    keyed = lambda df: model.weigh(df, text_col).withColumn(KEY, F.col(LOG_WEIGHT) + gumbel(F.col(id_col)))
    keys = materialize(keyed(docs.select(id_col, text_col)).select(F.col(LOG_WEIGHT).alias("weight"), F.col(KEY).alias("key")), "keys")
    cutoff = kth_largest(keys, keys.where(F.col("weight") >= model.threshold).count())
    discard(keys)
    return keyed(docs), cutoff


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The selected rows of ``docs``, with their columns."""
    keyed, cutoff = resample(docs, labels, id_col, text_col)
    return keyed.where(F.col(KEY) >= cutoff).select(*docs.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    keyed, cutoff = resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keyed.select("doc_id", F.col(N_GRAMS).alias("n_grams"), F.col(LOG_WEIGHT).alias("log_weight"), (F.col(KEY) >= cutoff).alias("selected"))
