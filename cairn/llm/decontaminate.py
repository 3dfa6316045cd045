"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores the postings of every word of every document in self-contained segments of a few
MB of text: per distinct term its sorted word positions, and per document its place in the segment. The
segments are a table in the shared folder, one row each, so a query needs no shuffle: a task reads
segments and intersects posting lists inside them. Every segment is bounded by its text size (a longer
document is a segment of its own), so neither a frequent word nor a hot source gathers rows anywhere.

``phrase_matches`` takes windows of consecutive test words, orders the terms of each window by their
frequency in the segment and intersects offset-adjusted lists from the rarest term on.
``proximity_matches`` finds the places where all terms of a query stand within a number of words.

Test items are compiled on the driver in blocks of at most ``block_bytes`` of text, so what is broadcast
has a fixed bound; more test text means more passes over the stored index. (One item above the bound is
a block of its own.)

Defined cases: a null or empty text has no words and no hits; an item without words has no window and
never occurs; repeated rows are answered row by row; equal windows of several items count for all of
them; repeated item ids count once; an empty table gives an empty result. Only the id and text columns
are read, so other columns and their names do not matter. Terms are compared by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Words, binary_rows, materialize, text_views

#: Text of a segment.
SEGMENT_BYTES = 1 << 21
INDEX_SCHEMA = "segment long, doc_ids array<long>, n_words array<int>, terms binary, counts binary, low binary, high binary"
MATCH_SCHEMA = "segment long, place int, doc_id long, n_words int, spans array<struct<start:int,end:int>>, items array<long>"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Index table: one row per segment, as INDEX_SCHEMA.

    ``terms`` holds the sorted term hashes (uint64), ``counts`` their posting counts (uint32), and ``low``
    and ``high`` the 16-bit halves of all positions, term by term. Positions count the words of a segment
    and skip one at the end of each document, so a run of consecutive positions never leaves a document.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, number = Words(ALNUM), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0)
            for first, rows, data, bounds in text_views(batch.column(1), segment_bytes):
                _, _, hashes, ends = words(data, bounds)
                per_doc = np.diff(ends)
                positions = np.arange(len(hashes), dtype=np.int64) + np.repeat(np.arange(rows), per_doc)
                order = np.argsort(hashes, kind="stable")
                ranked = hashes[order]
                new = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
                counts = np.diff(np.append(new, len(ranked))).astype(np.uint32)
                positions = positions[order]
                one = np.array([0, 0])

                def blob(x: np.ndarray, one: np.ndarray = one) -> pa.Array:
                    one[1] = len(x)
                    return binary_rows(x, one)

                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), ids.slice(first, rows).cast(pa.int64())),
                        pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), pa.array(per_doc, pa.int32())),
                        blob(ranked[new]), blob(counts), blob((positions & 0xFFFF).astype(np.uint16)), blob((positions >> 16).astype(np.uint16)),
                    ],
                    names=["segment", "doc_ids", "n_words", "terms", "counts", "low", "high"],
                )
                number += 1

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(segments, INDEX_SCHEMA)


class Segment:
    """One index row, opened."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.number = batch.column(0)[row].as_py()
        self.doc_ids = batch.column(1)[row].values
        self.n_words = batch.column(2)[row].values.to_numpy().astype(np.int64)
        terms, counts, low, high = (np.frombuffer(batch.column(3 + k)[row].as_buffer(), dtype=d) for k, d in enumerate((np.uint64, np.uint32, np.uint16, np.uint16)))
        self.terms, self.counts = terms, counts.astype(np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.counts)))
        self._low, self._high = low, high
        self.starts = np.concatenate(([0], np.cumsum(self.n_words + 1)))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each term in this segment, or -1."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def positions(self, at: int) -> np.ndarray:
        part = slice(self.offsets[at], self.offsets[at + 1])
        return self._low[part].astype(np.int64) | (self._high[part].astype(np.int64) << 16)


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def in_order(ids) -> list[int | None]:
    """Distinct item ids, a null one last."""
    return sorted(ids, key=lambda i: (i is None, i))


def _compile(items: list[tuple[int | None, str]], window: int) -> dict:
    """Distinct windows of the items as rows of term numbers (padded with -1), and the items of each."""
    words, owners, terms = Words(ALNUM), {}, {}
    for item, text in items:
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        _, _, hashes, _ = words(data, np.array([0, len(data)]))
        numbers = [terms.setdefault(int(h), len(terms)) for h in hashes]
        for k in range(max(1, len(numbers) - window + 1) if numbers else 0):
            owners.setdefault(tuple(numbers[k : k + window]), set()).add(item)
    table = np.full((len(owners), window), -1, dtype=np.int64)
    for row, key in enumerate(owners):
        table[row, : len(key)] = key
    return {"terms": np.fromiter(terms, dtype=np.uint64, count=len(terms)), "windows": table, "lengths": (table >= 0).sum(axis=1), "owners": list(map(in_order, owners.values()))}


def _phrases(segment: Segment, test: dict) -> tuple[np.ndarray, np.ndarray]:
    """Exact occurrences in a segment: (window numbers, start positions)."""
    windows, lengths = test["windows"], test["lengths"]
    at = segment.find(test["terms"])
    rarity = np.where(at >= 0, segment.counts[at] if len(segment.counts) else 0, 0)
    table = np.where(windows >= 0, rarity[windows], np.iinfo(np.int64).max)
    alive = np.flatnonzero(table.min(axis=1) > 0)
    found_w, found_p, lists = [], [], {}
    for w in alive:
        size = lengths[w]
        order = np.argsort(table[w, :size], kind="stable")
        starts = None
        for k in order:
            term = windows[w, k]
            if term not in lists:
                lists[term] = segment.positions(at[term])
            starts = lists[term] - k if starts is None else starts[_member(starts + k, lists[term])]
            if not len(starts):
                break
        if len(starts):
            found_w.append(np.full(len(starts), w))
            found_p.append(starts)
    if not found_w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_w), np.concatenate(found_p)


def _runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _matched(segment: Segment, test: dict) -> pa.RecordBatch:
    rows = len(segment.n_words)
    w, p = _phrases(segment, test)
    change = np.zeros(int(segment.starts[-1]) + 1, dtype=np.int64)
    np.add.at(change, p, 1)
    np.add.at(change, p + test["lengths"][w], -1)
    first, last = _runs(np.cumsum(change) > 0)
    doc = np.searchsorted(segment.starts, first, side="right") - 1
    owner = np.searchsorted(segment.starts, p, side="right") - 1
    items: dict[int, set] = {}
    for d, x in set(zip(owner.tolist(), w.tolist(), strict=True)):
        items.setdefault(d, set()).update(test["owners"][x])
    lists = [in_order(items.get(d, ())) for d in range(rows)] if items else [[]] * rows
    ends = np.searchsorted(doc, np.arange(rows + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(first - segment.starts[doc], pa.int32()), pa.array(last - segment.starts[doc], pa.int32())], ["start", "end"])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(rows, segment.number), pa.int64()), pa.array(np.arange(rows), pa.int32()), segment.doc_ids, pa.array(segment.n_words, pa.int32()),
            pa.ListArray.from_arrays(pa.array(ends), spans), pa.array(lists, pa.list_(pa.int64())),
        ],
        names=["segment", "place", "doc_id", "n_words", "spans", "items"],
    )


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of about ``block_bytes`` of text."""
    items = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // block_bytes
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [tuple(r) for r in part.collect()]


def phrase_matches(index: DataFrame, items: DataFrame, window: int = 13, id_col: str = "item_id", text_col: str = "text", block_bytes: int = 1 << 20) -> DataFrame:
    """Exact phrase matches per document, as MATCH_SCHEMA: merged word spans that windows cover, and the items they belong to."""
    spark, parts = index.sparkSession, []
    for block in _blocks(items, id_col, text_col, block_bytes):
        test = spark.sparkContext.broadcast(_compile(block, window))

        def matched(batches: Iterator[pa.RecordBatch], test=test) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    yield _matched(Segment(batch, row), test.value)

        parts.append(index.mapInArrow(matched, MATCH_SCHEMA))
    out = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            out = out.unionByName(part)
        out = out.groupBy("segment", "place").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    return out


def covered(spans) -> F.Column:
    """Number of words that sorted, perhaps overlapping spans cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    return F.aggregate(spans, start, step, lambda a: a["n"])


def _near(segment: Segment, terms: np.ndarray, within: int) -> list[tuple[int, int]]:
    """Minimal stretches of at most ``within`` words of one document that hold all terms."""
    at = segment.find(terms)
    if not len(at) or (at < 0).any():
        return []
    lists = [segment.positions(x) for x in sorted(at.tolist(), key=lambda x: segment.counts[x])]
    seeds = lists[0]
    for other in lists[1:]:  # from the rarest on: some position of each other term must be near
        k = np.searchsorted(other, seeds)
        before = np.where(k > 0, seeds - other[np.maximum(k - 1, 0)], within)
        after = np.where(k < len(other), other[np.minimum(k, len(other) - 1)] - seeds, within)
        seeds = seeds[np.minimum(before, after) < within]
        if not len(seeds):
            return []
    found = set()
    for seed in seeds.tolist():
        doc = int(np.searchsorted(segment.starts, seed, side="right")) - 1
        lo, hi = max(seed - within + 1, int(segment.starts[doc])), min(seed + within, int(segment.starts[doc + 1]) - 1)
        near = sorted((int(p), k) for k, x in enumerate(lists) for p in x[np.searchsorted(x, lo) : np.searchsorted(x, hi)])
        last: dict[int, int] = {}
        for p, k in near:
            last[k] = p
            if len(last) == len(lists) and p - (low := min(last.values())) < within and low <= seed <= p:
                found.add((low, p + 1))
    return sorted(found)


def proximity_matches(index: DataFrame, items: DataFrame, within: int = 20, id_col: str = "item_id", text_col: str = "text", block_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, item_id, start, end): where all distinct words of an item stand within ``within`` words, in any order."""
    spark, parts = index.sparkSession, []
    for block in _blocks(items, id_col, text_col, block_bytes):
        words, queries = Words(ALNUM), []
        for item, text in block:
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            queries.append((item, np.unique(words(data, np.array([0, len(data)]))[2])))
        test = spark.sparkContext.broadcast(queries)

        def matched(batches: Iterator[pa.RecordBatch], test=test) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    segment, out = Segment(batch, row), []
                    for item, terms in test.value:
                        for low, high in _near(segment, terms, within):
                            doc = int(np.searchsorted(segment.starts, low, side="right")) - 1
                            out.append((segment.doc_ids[doc].as_py(), item, low - int(segment.starts[doc]), high - int(segment.starts[doc])))
                    cols = list(zip(*out, strict=True)) if out else [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "start", "end"])

        parts.append(index.mapInArrow(matched, "doc_id long, item_id long, start int, end int"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: word count, words hit by windows of test items, the items, and the verdict (5 % of the words or more)."""
    index = materialize(build_index(docs, id_col, text_col), "postings")
    n_hit = covered(F.col("spans")).cast("long")
    found = phrase_matches(index, items, window).select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), "items", "spans")
    found._cairn_index = index
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + 12], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, p, grams.n, item_id FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
