"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

``fit_lexicon`` counts the pre-tokens of the whole corpus and compiles the most frequent ones, with their
token ids, into a minimal deterministic acyclic automaton with shared suffixes. Arcs carry numbers that
add up to a word's rank, which addresses its ids in a flat table. The whole lexicon is one file of 32-bit
integers that Spark ships to the executors once and the workers memory-map. Words that the lexicon does
not hold are merged exactly, pair by pair in merge order, so the ids never depend on what the lexicon holds.

The lexicon has at most ``size`` words of at most 64 bytes each. The least frequent of them is found by histograms
in the cluster, so no more words than that reach the driver, whatever the size of the corpus. The counts cover all rows.

Defined cases: null and empty texts have no ids and decode to an empty text; repeated rows are encoded
row by row; an empty table gives an empty lexicon and no rows; texts of any length are encoded whole (long
runs without a word boundary are merged with a heap). Other columns are carried along; the name of the
new column must be free.
"""

from __future__ import annotations

import heapq
import io
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import discard, kth_largest, materialize, shared_dir, small_batches, text_views, write_bytes

#: Fixed value: how this vocabulary's pre-tokens are cut.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points that this vocabulary's own tables (Unicode 16) don't count as letters or numbers, though newer ones do.
NEWER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
#: First UTF-8 byte of the lowest of them: text without a byte so high holds none.
NEWER_LEAD = 0xD5
LONGEST_WORD = 64
#: Size and multiplier of the hash table of merges; the rank of no merge.
SLOT_BITS, SLOT_FACTOR, NO_RANK = 18, 0x9E3779B97F4A7C15, np.iinfo(np.int32).max
LEXICON_WORDS = 50_000


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Token bytes, merges and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        back = {c: b for b, c in enumerate(_byte_letters())}
        model = data["model"]
        ids = {bytes(back[c] for c in token): i for token, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for token, i in ids.items():
            self.bytes_of[i] = token
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.single = [ids[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(back[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.pairs[ids[a], ids[b]] = (rank, ids[a + b])

    def _slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The merges as an open-addressing table: pair keys (-1: free), ranks and results."""
        if not hasattr(self, "_table"):
            keys = np.full(1 << SLOT_BITS, -1, dtype=np.int64)
            ranks, results = np.zeros(len(keys), dtype=np.int32), np.zeros(len(keys), dtype=np.int32)
            for (a, b), (rank, new) in self.pairs.items():
                key = a << 32 | b
                slot = (key * SLOT_FACTOR & (1 << 64) - 1) >> (64 - SLOT_BITS)
                while keys[slot] >= 0:
                    slot = (slot + 1) & (len(keys) - 1)
                keys[slot], ranks[slot], results[slot] = key, rank, new
            self._table = keys, ranks, results
        return self._table

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NO_RANK: no such merge) and results of many pairs at once."""
        keys, ranks, results = self._slots()
        key = a.astype(np.int64) << 32 | b
        slot = (key.astype(np.uint64) * np.uint64(SLOT_FACTOR) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        rank, result = np.full(len(key), NO_RANK, dtype=np.int32), np.zeros(len(key), dtype=np.int32)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        while len(left):
            at = slot[left]
            held = keys[at]
            hit = held == key[left]
            rank[left[hit]], result[left[hit]] = ranks[at[hit]], results[at[hit]]
            left = left[~hit & (held >= 0)]
            slot[left] = (slot[left] + 1) & (len(keys) - 1)
        return rank, result

    def merge_many(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of many words, all of them one merge a step: (bounds, ids)."""
        sizes = ends - starts
        counts = np.zeros(len(starts), dtype=np.int64)
        done = []
        lower = 0
        for width in (8, 16, 32, 64):
            rows = np.flatnonzero((sizes > lower) & (sizes <= width))
            lower = width
            if not len(rows):
                continue
            place = np.arange(width)
            inside = place < sizes[rows, None]
            parts = np.where(inside, np.array(self.single, dtype=np.int32)[data[np.minimum(starts[rows, None] + place, len(data) - 1)]], -1)
            rank, result = (x.reshape(len(rows), width - 1) for x in self._ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()))
            live = np.arange(len(rows))
            while len(live):
                at = rank[live].argmin(axis=1)
                some = rank[live, at] < NO_RANK
                live, at = live[some], at[some]
                if not len(live):
                    break
                p, r, q = parts[live], rank[live], result[live]
                new = q[np.arange(len(live)), at]
                # close the gap: what stands behind the merged pair moves one place to the left
                for table, first, fill in ((p, 1, -1), (r, 0, NO_RANK), (q, 0, 0)):
                    later = np.arange(table.shape[1] - 1) >= (at + first)[:, None]
                    table[:, :-1] = np.where(later, table[:, 1:], table[:, :-1])
                    table[:, -1] = fill
                one = np.arange(len(live))
                p[one, at] = new
                before = at > 0
                r[one[before], at[before] - 1], q[one[before], at[before] - 1] = self._ranks(p[one[before], at[before] - 1], new[before])
                after = at < width - 1
                after &= np.take_along_axis(p, np.minimum(at + 1, width - 1)[:, None], 1)[:, 0] >= 0
                r[one[~after], np.minimum(at[~after], width - 2)] = np.where(at[~after] < width - 1, NO_RANK, r[one[~after], np.minimum(at[~after], width - 2)])
                r[one[after], at[after]], q[one[after], at[after]] = self._ranks(new[after], p[one[after], at[after] + 1])
                parts[live], rank[live], result[live] = p, r, q
            kept = parts >= 0
            counts[rows] = kept.sum(axis=1)
            done.append((rows, parts[kept]))
        for row in np.flatnonzero(sizes > lower).tolist():
            ids = np.array(self.merge(data[starts[row] : ends[row]].tobytes()), dtype=np.int32)
            counts[row] = len(ids)
            done.append((np.array([row]), ids))
        bounds = np.concatenate(([0], np.cumsum(counts)))
        out = np.zeros(int(bounds[-1]), dtype=np.int32)
        for rows, ids in done:
            n = counts[rows]
            out[np.repeat(bounds[:-1][rows], n) + np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)] = ids
        return bounds, out

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: merge the pair of the lowest rank, leftmost first, until none is left."""
        parts = [self.single[b] for b in word]
        if len(parts) > 48:
            return self._merge_long(parts)
        pairs = self.pairs
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = pairs.get((parts[k], parts[k + 1]))
                if found and (best is None or found < best):
                    best, at = found, k
            if best is None:
                break
            parts[at : at + 2] = [best[1]]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, pairs = len(parts), self.pairs
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(found[0], k, parts[k], parts[k + 1], found[1]) for k in range(n - 1) if (found := pairs.get((parts[k], parts[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = after[k]
            if parts[k] != a or j < 0 or parts[j] != b:
                continue
            parts[k], parts[j] = new, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right >= 0 and (found := pairs.get((parts[left], parts[right]))):
                    heapq.heappush(heap, (found[0], left, parts[left], parts[right], found[1]))
        return [x for x in parts if x >= 0]


class Transducer:
    """Minimal acyclic word automaton: arcs add up to the rank of a word, and ranks address its ids.

    Held in one int32 array: five lengths, then arc keys (state * 256 + byte, sorted), arc targets, arc
    outputs, final flags, id bounds and ids.
    """

    def __init__(self, data: np.ndarray):
        sizes = [int(x) for x in data[:5]]
        cuts = np.cumsum([5, sizes[0], sizes[0], sizes[0], sizes[1], sizes[2], sizes[3]])
        self.keys, self.targets, self.outputs, self.final, self.bounds, self.ids = (data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        self.root = sizes[4]

    @staticmethod
    def compile(entries: dict[bytes, list[int]]) -> np.ndarray:
        """Build from sorted words, sharing equal suffix states as they are completed."""
        words = sorted(entries)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []
        path: list[list] = [[False, []]]  # unfinished states along the last word: final flag, arcs (byte, state)

        def close(depth: int, last: bytes) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                if key not in register:
                    register[key] = len(states)
                    states.append(key)
                path[-1][1].append((last[len(path) - 1], register[key]))

        last = b""
        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            close(common, last)
            path.extend([False, []] for _ in word[common:])
            path[-1][0] = True
            last = word
        close(0, last)
        root = len(states)
        states.append((path[0][0], tuple(path[0][1])))
        below = np.zeros(len(states), dtype=np.int64)  # children are numbered before their parents
        keys, targets, outputs = [], [], []
        for s, (final, arcs) in enumerate(states):
            total = int(final)
            for byte, to in arcs:
                keys.append(s * 256 + byte)
                targets.append(to)
                outputs.append(total)
                total += below[to]
            below[s] = total
        lists = [entries[w] for w in words]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists]))) if lists else np.zeros(1)
        ids = [i for x in lists for i in x]
        final = [int(f) for f, _ in states]
        head = [len(keys), len(final), len(bounds), len(ids), root]
        return np.concatenate([np.asarray(x, dtype=np.int64) for x in (head, keys, targets, outputs, final, bounds, ids)]).astype(np.int32)

    def ranks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rank of each word (bytes ``data[start:end]``), or -1 where the lexicon lacks it. All words step together."""
        out = np.full(len(starts), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        size = ends - starts
        live = np.flatnonzero((size > 0) & (size <= LONGEST_WORD))
        state, total, step = np.full(len(live), self.root, dtype=np.int64), np.zeros(len(live), dtype=np.int64), 0
        while len(live):
            key = state * 256 + data[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key.astype(np.int32)), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            state, total, step = self.targets[at].astype(np.int64), total[ok] + self.outputs[at], step + 1
            ended = size[live] == step
            good = ended & (self.final[state] == 1)
            out[live[good]] = total[good]
            live, state, total = live[~ended], state[~ended], total[~ended]
        return out


def _patterns():
    """Compiled patterns for texts without and with code points in NEWER."""
    import regex

    newer = "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NEWER) + "]"
    careful = PRE_TOKEN.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|{newer})+").replace(r"?\p{L}+", rf"?[\p{{L}}--{newer}]+").replace(r"?\p{N}+", rf"?[\p{{N}}--{newer}]+")
    return regex.compile(PRE_TOKEN), regex.compile("(?V1)" + careful)


def _simple(letters: str, numbers: str, blanks: str) -> re.Pattern:
    """The pre-token pattern over alphabets that are written out, for the faster standard library."""
    return re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{letters}{numbers}{blanks}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+")


#: Pre-tokens of ASCII texts, and of texts without the characters in _BEYOND: Latin letters up to U+024F and usual punctuation.
_ASCII = _simple("A-Za-z", "0-9", r"\t\n\x0b\x0c\r ")
_LATIN = _simple("A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", r"\t\n\x0b\x0c\r \x85\xa0")
_BEYOND = re.compile("[^\x00-\u024f\u2010-\u2027]")


def _pre_tokens(text: str, pattern) -> list[str]:
    return (_ASCII if text.isascii() else pattern if _BEYOND.search(text) else _LATIN).findall(text)


def _cut(text: str, pattern, added: list[str]) -> list[str]:
    """Pre-tokens of a text; added tokens are pieces of their own."""
    for token in added:
        if token in text:
            pieces = text.split(token)
            out = _cut(pieces[0], pattern, added)
            for piece in pieces[1:]:
                out.append(token)
                out += _cut(piece, pattern, added)
            return out
    return _pre_tokens(text, pattern)


class Encoder:
    def __init__(self, vocabulary: Vocabulary, transducer: Transducer):
        self.vocabulary, self.transducer = vocabulary, transducer
        self.patterns, self.added = _patterns(), list(vocabulary.added)

    def words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens: (bounds, ids)."""
        _, rows, data, bounds = next(text_views(distinct, 1 << 62))
        starts, ends = bounds[:-1], bounds[1:]
        added: dict[int, int] = {}
        ranks = self.transducer.ranks(data, starts, ends)
        known = ranks >= 0
        sizes = np.zeros(rows, dtype=np.int64)
        sizes[known] = self.transducer.bounds[ranks[known] + 1] - self.transducer.bounds[ranks[known]]
        unseen = np.flatnonzero(~known)
        for token, i in self.vocabulary.added.items():
            named = unseen[(ends - starts)[unseen] == len(token.encode())]
            for k in named.tolist():
                if data[starts[k] : ends[k]].tobytes() == token.encode():
                    added[k] = i
        unseen = unseen[~np.isin(unseen, list(added))] if added else unseen
        merged_bounds, merged = self.vocabulary.merge_many(data, starts[unseen], ends[unseen])
        sizes[unseen] = np.diff(merged_bounds)
        sizes[list(added)] = 1
        out_bounds = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.zeros(int(out_bounds[-1]), dtype=np.int32)
        if known.any():
            n, first = sizes[known], self.transducer.bounds[ranks[known]].astype(np.int64)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids[np.repeat(out_bounds[:-1][known], n) + inner] = self.transducer.ids[np.repeat(first, n) + inner]
        n = sizes[unseen]
        ids[np.repeat(out_bounds[:-1][unseen], n) + np.arange(len(merged)) - np.repeat(merged_bounds[:-1], n)] = merged
        for k, i in added.items():
            ids[out_bounds[k]] = i
        return out_bounds, ids

    def encode(self, texts: list[str], newer: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts: (bounds by text, ids). ``newer``: they may hold code points in NEWER."""
        tokens: list[str] = []
        ends = np.zeros(len(texts) + 1, dtype=np.int64)
        for k, text in enumerate(texts):
            tokens += _cut(text, self.patterns[newer], self.added)
            ends[k + 1] = len(tokens)
        if not tokens:
            return ends, np.zeros(0, dtype=np.int32)
        coded = pa.array(tokens, pa.string()).dictionary_encode()
        at = coded.indices.to_numpy()
        bounds, ids = self.words(coded.dictionary)
        first, n = bounds[:-1][at], np.diff(bounds)[at]
        total = np.concatenate(([0], np.cumsum(n)))
        return total[ends], ids[np.repeat(first - total[:-1], n) + np.arange(total[-1])]


class Codec:
    """A fitted lexicon with its vocabulary file, both shipped to the executors."""

    _opened: dict[str, Encoder] = {}

    def __init__(self, lexicon_file: str, vocabulary_file: str, words: int):
        self.lexicon_file, self.vocabulary_file, self.words = lexicon_file, vocabulary_file, words

    def encoder(self) -> Encoder:
        if self.lexicon_file not in Codec._opened:
            Codec._opened.clear()
            lexicon = np.load(SparkFiles.get(self.lexicon_file), mmap_mode="r")
            Codec._opened[self.lexicon_file] = Encoder(Vocabulary(SparkFiles.get(self.vocabulary_file)), Transducer(lexicon))
        return Codec._opened[self.lexicon_file]


def count_pre_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): pre-tokens of at most 64 bytes of all texts, counted in the tasks before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, held, rows = _patterns(), [], 0

        def merged() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).group_by("word").aggregate([("n", "sum")])
            return pa.RecordBatch.from_arrays([table["word"].combine_chunks(), table["n_sum"].combine_chunks()], names=["word", "n"])

        for batch in batches:
            for first, n, data, _ in text_views(batch.column(0)):
                tokens: list[str] = []
                pattern = patterns[bool(len(data) and data.max() >= NEWER_LEAD)]
                for text in batch.column(0).slice(first, n).to_pylist():
                    if text:
                        tokens += _pre_tokens(text, pattern)
                words = pa.array(tokens, pa.string())
                words = words.filter(pc.less_equal(pc.binary_length(words), LONGEST_WORD)).value_counts()
                held.append(pa.RecordBatch.from_arrays([words.field("values"), words.field("counts")], names=["word", "n"]))
                rows += len(words)
                if rows > 1_000_000:
                    held = [merged()]
                    rows = held[0].num_rows
                    if rows > 500_000:
                        yield held[0]
                        held, rows = [], 0
        if held:
            yield merged()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_lexicon(docs: DataFrame, vocabulary_path: str, size: int = LEXICON_WORDS, text_col: str = "text") -> Codec:
    """Compile the ``size`` most frequent pre-tokens (ties by hash) and ship the automaton and the vocabulary file through the shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    # words of the same count go by a hash; the least key is found in the cluster, so no more than ``size`` words leave it
    share = F.shiftrightunsigned(F.xxhash64("word"), 11).cast("double") / float(1 << 53)
    counts = materialize(count_pre_tokens(docs, text_col).select("word", (F.col("n") + share).alias("key")), "pre-tokens")
    least = kth_largest(counts, size)
    frequent = sorted(r[0].encode() for r in counts.where(F.col("key") >= least).select("word").collect())
    discard(counts)
    vocabulary, name, compiled = Vocabulary(vocabulary_path), uuid.uuid4().hex, io.BytesIO()
    np.save(compiled, Transducer.compile({w: vocabulary.merge(w) for w in frequent}))
    with open(vocabulary_path, "rb") as f:
        files = {f"lexicon-{name}.npy": compiled.getvalue(), f"vocabulary-{name}.json": f.read()}
    for file, content in files.items():
        spark.sparkContext.addFile(write_bytes(spark, f"{shared_dir(spark)}/{file}", content))
    return Codec(*files, len(frequent))


def encode(df: DataFrame, codec: Codec, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds the token ids of each whole text as ``array<int>``."""
    if out_col in df.columns:
        raise ValueError(f"column {out_col} is taken")
    at = df.columns.index(text_col)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec.encoder()
        for batch in batches:
            for first, n, data, _ in text_views(batch.column(at)):
                part = batch.slice(first, n)
                bounds, ids = encoder.encode([x or "" for x in part.column(at).to_pylist()], bool(len(data) and data.max() >= NEWER_LEAD))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, out_col])

    return df.mapInArrow(encoded, StructType([*df.schema.fields, StructField(out_col, ArrayType(IntegerType(), False))]))


def _plain(lists: pa.Array, table: list[bytes], sizes: np.ndarray) -> pa.Array:
    """Texts of lists of token ids."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ids = lists.flatten().to_numpy()
    data = b"".join(map(table.__getitem__, ids.tolist()))
    cuts = np.concatenate(([0], np.cumsum(sizes[ids])))[np.concatenate(([0], np.cumsum(n)))]
    return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.string())


def decode(df: DataFrame, codec: Codec, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of the token ids (null ids: empty); bytes that are no UTF-8 become replacement characters."""
    if out_col in df.columns:
        raise ValueError(f"column {out_col} is taken")
    at = df.columns.index(ids_col)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec.encoder().vocabulary.bytes_of
        sizes = np.array([len(x) for x in table], dtype=np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, _plain(part.column(at), table, sizes)], names=[*part.schema.names, out_col])

    return df.mapInArrow(decoded, StructType([*df.schema.fields, StructField(out_col, StringType())]))


def encode_and_decode(df: DataFrame, codec: Codec, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the token ids of each whole text and the text of those ids, in one pass: a second one would keep a second Python worker with a vocabulary of its own beside each task."""
    for name in (ids_col, out_col):
        if name in df.columns:
            raise ValueError(f"column {name} is taken")
    at = df.columns.index(text_col)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec.encoder()
        table = encoder.vocabulary.bytes_of
        sizes = np.array([len(x) for x in table], dtype=np.int64)
        for batch in batches:
            for first, n, data, _ in text_views(batch.column(at)):
                part = batch.slice(first, n)
                bounds, ids = encoder.encode([x or "" for x in part.column(at).to_pylist()], bool(len(data) and data.max() >= NEWER_LEAD))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, _plain(lists, table, sizes)], names=[*part.schema.names, ids_col, out_col])

    return df.mapInArrow(both, StructType([*df.schema.fields, StructField(ids_col, ArrayType(IntegerType(), False)), StructField(out_col, StringType())]))


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(df: DataFrame) -> list:
    """Digest columns of encoded and decoded rows."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    codec = fit_lexicon(docs, vocabulary_file())
    coded = encode_and_decode(docs, codec)
    return coded.select("doc_id", *digests(coded))
