"""Exact n-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word 5-grams (hashed to 64 bits; a shorter document is one n-gram of
all its words). Documents link when their sets' Jaccard similarity is at least PERCENT / 100, and components
are the classes of documents that links connect. The n-grams are cut by ranges of their hashes into ``FRAGMENTS``
fragments, which are worked off separately. The result is exact:

1. Documents with equal sets form one class; one representative goes on.
2. In the first ``PRUNING`` fragments, all documents' n-grams are counted. A set whose n-grams there are so often
   its own that the others can't make the overlap is out; most documents are. N-grams that several sets of one
   task hold are counted in the task and sent on once, so a frequent one is no hot key.
3. The sets of the other classes are stored by fragment, and their n-grams are counted exactly. These counts give the
   global order: an n-gram that no other set holds comes first, then rare ones, then frequent ones.
4. Two sets as similar as asked share an n-gram among the first ``n - ceil(t n) + 1`` of each in that order, and
   its place bounds what they can share in all. Sets that share such an n-gram are a bucket. In each bucket, the
   members are compared with one leader, that of the fewest n-grams of its own.
5. A pair is verified by fragments: the overlap of the two sets is counted in each fragment separately and the
   counts are summed per pair. The first fragment alone excludes most unrelated pairs: their difference there exceeds
   what the whole pair may differ.
6. Links give components. A bucket whose members are in one component is done. In the others, a growing number of
   members (LEADERS, then that many times more each round) is compared with all members of other components, as far as
   sizes and places allow a link, and leaves the bucket; until no bucket holds members of two components. So copies are
   never expanded into all pairs, and no link between components is missed.

Nothing of the size of the corpus is collected or broadcast. Hot buckets and digests meet in sort-merge joins
that Spark's adaptive execution can split.

Defined cases: null, empty and blank texts have empty sets and link with nothing; repeated rows are in one class;
rows that share a doc_id but not the text are separate sets, whose class ids are still doc_ids; an empty table
gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, Words, discard, materialize, mix, small_batches, text_views

SHINGLE, PERCENT = 5, 80
#: Ranges of n-gram hashes; so many of them are counted for all documents.
FRAGMENTS, PRUNING = 8, 3
#: N-grams that one task gathers before it sends them on, n-grams that are counted at once, and the least number that one row of the shuffle holds on average.
GATHER, PART, PACKED = 1 << 21, 1 << 19, 32
#: Members of a bucket that are compared with the others in the first round after that of the single leader; and the factor from round to round.
LEADERS = 8
#: Bits of the map that picks the texts whose sets are stored.
TEXT_BITS = 1 << 25

_U = np.uint64


def shingle_sets(words: Words, data: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each row: (values, row bounds)."""
    _, _, h, ends = words(data, bounds)
    n = np.diff(ends)
    with np.errstate(over="ignore"):
        whole = np.maximum(n - size + 1, 0)
        rows = np.repeat(np.arange(len(n)), whole)
        first = np.arange(len(rows)) - np.repeat(np.cumsum(whole) - whole, whole) + np.repeat(ends[:-1], whole)
        values = np.zeros(len(rows), dtype=np.uint64)
        for k in range(size):
            values = values * _U(0xD1342543DE82EF95) + h[first + k]
        values = mix(values)
        for count in range(1, size):  # short rows: all words as one
            short = np.flatnonzero(n == count)
            if len(short):
                one = np.full(len(short), count, dtype=np.uint64)
                for k in range(count):
                    one = one * _U(0xD1342543DE82EF95) + h[ends[short] + k]
                rows, values = np.concatenate([rows, short]), np.concatenate([values, mix(one)])
        if ((n > 0) & (n < size)).any():
            order = np.argsort(rows, kind="stable")
            rows, values = rows[order], values[order]
    cuts = np.searchsorted(rows, np.arange(len(n) + 1)).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        values[a:b].sort()
    if len(rows):
        new = np.concatenate(([True], (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])))
        rows, values = rows[new], values[new]
    return values, np.searchsorted(rows, np.arange(len(n) + 1))


def _digests(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digest of each set, as two int64 columns; the first is odd."""
    raw = b"".join(hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
    both = np.frombuffer(raw, dtype=np.int64).reshape(-1, 2)
    return both[:, 0] | 1, both[:, 1]


def _fragment(values: np.ndarray) -> np.ndarray:
    return (values >> _U(64 - (FRAGMENTS - 1).bit_length())).astype(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, n (set size), n0 (n-grams in the pruning fragments) and the digest of the whole set."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(NOT_SPACE)
        for batch in batches:
            for first, rows, data, bounds in text_views(batch.column(1)):
                values, ends = shingle_sets(words, data, bounds)
                low = np.concatenate(([0], np.cumsum(_fragment(values) < PRUNING)))[ends]
                columns = [np.diff(ends).astype(np.int32), np.diff(low).astype(np.int32), *_digests(values, ends)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), *map(pa.array, columns)], names=["doc_id", "n", "n0", "d0", "d1"])

    return _texts(docs, id_col, text_col).mapInArrow(signed, "doc_id long, n int, n0 int, d0 long, d1 long")


def _held_by_several(grams: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, their owner or 0 for several, owners of n-grams of several, how many of these each has). An owner 0 stands for several."""
    order = np.argsort(grams, kind="stable")
    grams, owners = grams[order], owners[order]
    first = np.concatenate(([True], grams[1:] != grams[:-1]))
    run = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    several = np.minimum.reduceat(owners, starts) != np.maximum.reduceat(owners, starts)
    several |= owners[starts] == 0
    own = np.where(several, 0, owners[starts])
    at = several[run] & (owners != 0)
    run, held = run[at], owners[at]
    order = np.lexsort((held, run))
    run, held = run[order], held[order]
    new = np.concatenate((np.ones(min(len(run), 1), bool), (run[1:] != run[:-1]) | (held[1:] != held[:-1])))
    return grams[starts], own, *np.unique(held[new], return_counts=True)


def shared_counts(docs: DataFrame, text_col: str, total: int) -> DataFrame:
    """(d0, shared): how many n-grams of the pruning fragments a set shares with another one at most. ``total``: n-grams to count, which sets how finely they are dealt out."""
    parts = max(64, min(total // PART + 1, GATHER // PACKED))
    span = (1 << 64) * PRUNING // FRAGMENTS
    edges = np.array([span * k // parts for k in range(1, parts)], dtype=np.uint64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, owners, size = Words(NOT_SPACE), [], [], 0

        def sent() -> pa.RecordBatch:
            grams, own, sets, counts = _held_by_several(np.concatenate(held), np.concatenate(owners))
            cuts = np.concatenate(([0], np.searchsorted(grams, edges), [len(grams)]))
            cuts = np.concatenate((cuts, [len(grams) + len(sets)])).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(x))) for x in ((grams.view(np.int64), counts), (own, sets))]
            # what is counted already goes along with any part
            part = np.concatenate((np.arange(parts), [int(sets[0] % parts) if len(sets) else 0])).astype(np.int32)
            out = pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.arange(parts + 1) == parts), *lists], names=["part", "counted", "x", "y"])
            return out.filter(pa.array(np.diff(cuts) > 0))

        for batch in batches:
            for _, _, data, bounds in text_views(batch.column(0)):
                values, ends = shingle_sets(words, data, bounds)
                low = _fragment(values) < PRUNING
                held.append(values[low])
                owners.append(np.repeat(_digests(values, ends)[0], np.diff(ends))[low])
                size += len(held[-1])
                if size >= GATHER:
                    yield sent()
                    held, owners, size = [], [], 0
        if size:
            yield sent()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, owners = None, [], []

        def result(sets: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sets), pa.array(counts.astype(np.int64))], names=["d0", "shared"])

        def whole_part() -> Iterator[pa.RecordBatch]:
            """One part, in ranges of about PART n-grams."""
            grams, sets = np.concatenate(held), np.concatenate(owners)
            ranges = len(grams) // PART + 1
            low, high = int(grams.min()), int(grams.max()) + 1
            cuts = [low + (high - low) * k // ranges for k in range(ranges + 1)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                some = slice(None) if ranges == 1 else (grams >= a) & (grams < b)
                if ranges == 1 or some.any():
                    yield result(*_held_by_several(grams[some], sets[some])[2:])

        for batch in batches:
            for k, done in enumerate(batch.column(1).to_pylist()):
                x, y = (batch.column(c)[k].values.to_numpy() for c in (2, 3))
                if done:
                    yield result(y, x)
                    continue
                if batch.column(0)[k].as_py() != part and held:
                    yield from whole_part()
                    held, owners = [], []
                part = batch.column(0)[k].as_py()
                held.append(x)
                owners.append(y)
        if held:
            yield from whole_part()

    lists = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(dealt, "part int, counted boolean, x array<long>, y array<long>")
    return lists.repartition("part").sortWithinPartitions("part").mapInArrow(counted, "d0 long, shared long").groupBy("d0").agg(F.sum("shared").alias("shared"))


def prefix_length(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - -(-PERCENT * n // 100) + 1, 0)


def _bitmap(values: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of ``bits`` bits over hashes of a column, of the same size for any number of values."""
    bit = F.pmod(F.xxhash64(*values.columns), F.lit(bits))
    words = values.select(F.shiftright(bit, 6).alias("word"), F.expr("1L").alias("one"), bit.bitwiseAND(F.lit(63)).cast("int").alias("at")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, at)")).alias("bits"))
    out = np.zeros(bits // 64, dtype=np.uint64)
    got = words.toArrow()
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _held(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (bitmap[bit >> 6] >> (bit & 63).astype(np.uint64) & _U(1)).astype(bool)


def fragment_sets(docs: DataFrame, active: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cid, n, grams, fragment): the sets of the active classes (cid, first_id, n, d0, d1), cut into fragments.

    A bitmap of fixed size keeps most texts of other classes from being cut at all, and texts never move. What it lets through
    too much finds no partner in the join."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(active.select("first_id"), TEXT_BITS))  # TEXT_BITS / 8 bytes
    source = _texts(docs, id_col, text_col).select(F.pmod(F.xxhash64("doc_id"), F.lit(TEXT_BITS)).alias("bit"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(NOT_SPACE), set()
        for batch in batches:
            batch = batch.filter(pa.array(_held(shared.value, batch.column(0).to_numpy())))
            for _, rows, data, bounds in text_views(batch.column(1)):
                values, ends = shingle_sets(words, data, bounds)
                d0, d1 = _digests(values, ends)
                row = np.repeat(np.arange(rows), np.diff(ends))
                # values are sorted within a row, so fragments follow each other
                cuts = np.searchsorted(row * FRAGMENTS + _fragment(values), np.arange(rows * FRAGMENTS + 1))
                inner = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values.view(np.int64)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * FRAGMENTS, pa.int32()), inner)
                new = np.zeros(rows, dtype=bool)
                for k, key in enumerate(zip(d0.tolist(), d1.tolist(), strict=True)):
                    new[k] = ends[k + 1] > ends[k] and key not in seen
                    seen.add(key)
                out = pa.RecordBatch.from_arrays([pa.array(d0), pa.array(d1), lists], names=["d0", "d1", "sets"])
                yield out.filter(pa.array(new))

    found = source.mapInArrow(cut, "d0 long, d1 long, sets array<array<long>>")
    one = found.join(active.select("d0", "d1", "cid", "n").hint("merge"), ["d0", "d1"]).groupBy("d0", "d1").agg(F.first("cid").alias("cid"), F.first("n").alias("n"), F.first("sets").alias("sets"))
    return one.select("cid", "n", F.posexplode("sets").alias("fragment", "grams"))


def prefixes(segments: DataFrame) -> DataFrame:
    """(gram, cid, n, own, place): the first n-grams of each set in the order of counts, without those of one set only. own: n-grams that no other set holds."""
    grams = segments.select("cid", "n", F.explode("grams").alias("gram"))
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = grams.join(df.hint("merge"), "gram").groupBy("cid").agg(F.first("n").alias("n"), F.collect_list(F.struct("df", "gram")).alias("held"))
    length = F.expr(f"n - div({PERCENT} * n + 99, 100) + 1").cast("int")
    held = held.withColumn("own", (F.col("n") - F.size("held")).cast("int")).where(length > F.col("own"))
    first = F.slice(F.sort_array("held"), F.lit(1), length - F.col("own"))
    return held.select("cid", "n", "own", F.posexplode(first).alias("at", "x")).select(F.col("x.gram").alias("gram"), "cid", "n", "own", (F.col("own") + F.col("at")).alias("place"))


def _may_link(x: str, y: str) -> F.Column:
    """Whether sizes and the places of a shared n-gram allow a link: n-grams before it aren't shared. If it isn't the first shared one, another bucket tells better."""
    (na, pa_), (nb, pb) = ((F.col(f"{s}.n"), F.col(f"{s}.place")) for s in (x, y))
    return (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & ((100 + PERCENT) * F.least(na - pa_, nb - pb) >= PERCENT * (na + nb))


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, na, nb), the smaller class first, of two structs x and y."""
    swap = F.col("x.cid") > F.col("y.cid")
    pick = lambda f, flip: F.when(swap == F.lit(flip), F.col(f"x.{f}")).otherwise(F.col(f"y.{f}"))
    return rows.select(*(pick(f, flip).alias(name + side) for side, flip in (("a", False), ("b", True)) for f, name in (("cid", ""), ("n", "n")))).distinct()


def _needed(na: str, nb: str) -> F.Column:
    """Least overlap of linked sets of these sizes, times (100 + PERCENT)."""
    return PERCENT * (F.col(na) + F.col(nb)).cast("long")


def verify(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Links among pairs (a, b, na, nb): partial overlaps counted by fragment, then summed per pair."""
    a, b = (segments.select(F.col("cid").alias(x), "fragment", F.col("grams").alias(f"g{x}")) for x in "ab")
    overlap = F.size(F.array_intersect("ga", "gb"))
    first = pairs.withColumn("fragment", F.lit(0)).join(a.where("fragment = 0"), ["a", "fragment"]).join(b.where("fragment = 0"), ["b", "fragment"])
    first = first.withColumn("overlap", overlap).withColumn("differ", F.size("ga") + F.size("gb") - 2 * F.col("overlap"))
    allowed = (100 + PERCENT) * (F.col("na") + F.col("nb") - F.col("differ")).cast("long") >= 2 * _needed("na", "nb")
    first = materialize(first.where(allowed).select("a", "b", "na", "nb", "overlap"), "pairs-first")
    rest = first.select("a", "b", F.explode(F.sequence(F.lit(1), F.lit(FRAGMENTS - 1))).alias("fragment"))
    rest = rest.join(a.where("fragment > 0"), ["a", "fragment"]).join(b.where("fragment > 0"), ["b", "fragment"]).select("a", "b", overlap.alias("overlap"))
    total = first.unionByName(rest.withColumns({"na": F.lit(None).cast("int"), "nb": F.lit(None).cast("int")}), allowMissingColumns=True)
    total = total.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("overlap").alias("overlap"))
    links = materialize(total.where((100 + PERCENT) * F.col("overlap") >= _needed("na", "nb")).select("a", "b"), "links")
    discard(first)
    return links


def components(links: DataFrame) -> DataFrame:
    """(cid, component) of every linked class, component being one of its classes: alternating large and small stars."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        # large star: larger neighbours move to the smallest of the neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: smaller neighbours, and the node itself, move to the smallest
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = materialize(small.where("u <> v").distinct(), "edges")
        state = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(edges)
        edges = new
        if state == seen:
            break
        seen = state
    tops = edges.select(F.col("v").alias("cid")).distinct()
    return edges.select(F.col("u").alias("cid"), F.col("v").alias("component")).unionByName(tops.select("cid", F.col("cid").alias("component")))


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id that links reach). Classes go by the digest of their set."""
    small_batches(docs.sparkSession)
    signed = materialize(signatures(docs, id_col, text_col), "signatures")
    classes = signed.where("n > 0").groupBy("d0", "d1").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.max("n0").alias("n0"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    total = signed.agg(F.sum("n0")).first()[0] or 0
    counts = shared_counts(docs, text_col, total)
    active = classes.join(counts, "d0", "left").where(100 * (F.col("n") - F.col("n0") + F.least(F.col("n0"), F.coalesce("shared", F.lit(0)))) >= PERCENT * F.col("n"))
    active = materialize(active.select("cid", "first_id", "n", "d0", "d1"), "active")
    segments = materialize(fragment_sets(docs, active, id_col, text_col), "segments", "fragment")
    found = materialize(prefixes(segments), "prefixes")
    buckets = found.groupBy("gram").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "cid", "n", "place")).alias("x")).where("members > 1")
    led = found.join(buckets.select("gram", "x").hint("merge"), "gram").select("gram", F.struct("cid", "n", "place").alias("y"), "x")
    open_rows = materialize(led.select("gram", "y.*"), "buckets")
    pairs = materialize(_pairs(led.where((F.col("x.cid") != F.col("y.cid")) & _may_link("x", "y"))), "pairs")
    links = verify(pairs, segments)
    labels = materialize(components(links), "labels")
    tried, quota = pairs, LEADERS
    discard(active, found)
    while True:
        named = open_rows.join(labels, "cid", "left").select("gram", "cid", "n", "place", F.coalesce("component", "cid").alias("component"))
        mixed = named.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi")
        rest = materialize(named.join(mixed.select("gram", "members").hint("merge"), "gram"), "mixed")
        discard(open_rows)
        if rest.isEmpty():
            break
        # about ``quota`` members of each bucket, the same ones wherever they are, and all of a smaller bucket
        leads = F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) * F.col("members") < F.lit(quota << 20)
        me = F.struct("cid", "n", "place", "component", leads.alias("leads"))
        x, y = rest.where(leads).select("gram", me.alias("x")), rest.select("gram", me.alias("y"))
        across = (F.col("x.component") != F.col("y.component")) & (~F.col("y.leads") | (F.col("x.cid") < F.col("y.cid"))) & _may_link("x", "y")
        new = materialize(_pairs(y.join(x.hint("merge"), "gram").where(across)).join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        open_rows = materialize(rest.where(~leads).select("gram", "cid", "n", "place"), "buckets")
        discard(rest)
        if not new.isEmpty():
            more, old = verify(new, segments), (links, labels, tried)
            links = materialize(links.unionByName(more), "links")
            tried = materialize(tried.unionByName(new), "pairs")
            labels = materialize(components(links), "labels")
            discard(more, new, *old)
        quota *= LEADERS
    discard(rest, segments, links, tried)
    named = classes.join(labels, "cid", "left").select("d0", "d1", "first_id", F.coalesce("component", "cid").alias("component"))
    tops = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classed = named.join(tops, "component").select("d0", "d1", "component_id")
    out = signed.join(classed.hint("merge"), ["d0", "d1"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS top FROM documents UNION SELECT e.y, r.top FROM r JOIN e ON e.x = r.x WHERE r.top < e.y)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.top) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.x = d.doc_id GROUP BY 1, 2
"""
