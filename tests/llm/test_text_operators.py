"""Operators 1, 2, 6 and 7 against brute force."""

import hashlib
import math
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import bpe, decontaminate, jaccard, secrets
from cairn.llm.common import ALNUM, Words, materialize

ALNUM_RE = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return ALNUM_RE.findall((text or "").translate(LOWER))


def brute_contamination(texts, items, window=13):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = {}
    for d, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for g, owners in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= owners
        out[d] = (len(w), len(hit), sorted(found))
    return out


def test_decontamination(spark, docs, texts):
    items = [(1, " ".join(words(texts[7])[5:30])), (10, texts[8]), (2, "one"), (3, None), (4, "..."), (5, "Two  WORDS"), (6, " ".join(words(texts[7])[5:30]))]
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(texts, items)
    index = materialize(decontaminate.build_index(docs, segment_bytes=4000), "postings")
    for block in (1 << 20, 200):  # one pass and several
        got = decontaminate.phrase_matches(index, frame, block_bytes=block).select("doc_id", "n_words", decontaminate.covered(F.col("spans")).alias("hit"), "items")
        assert {r.doc_id: (r.n_words, r.hit, r["items"]) for r in got.collect()} == want
    assert decontaminate.contamination(docs, frame).where("contaminated").count() == sum(h > 0 and 20 * h >= n for n, h, _ in want.values())


def test_items_without_id(spark, docs, texts):
    items = spark.createDataFrame([(None, texts[7]), (3, texts[7]), (None, texts[8])], "item_id long, text string")
    for block in (1 << 20, 200):
        got = decontaminate.phrase_matches(materialize(decontaminate.build_index(docs), "postings"), items, block_bytes=block).where("doc_id in (7, 8)")
        assert {r.doc_id: (r.hit == r.n_words, set(r["items"])) for r in got.select("doc_id", "n_words", decontaminate.covered(F.col("spans")).alias("hit"), "items").collect()} == {7: (True, {3, None}), 8: (True, {None})}


def test_decontamination_edges(spark, docs, no_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(no_docs, items).count() == 0
    assert decontaminate.contamination(docs, items).where("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x green x blue"), (2, "blue green red"), (3, "red green"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, "green red blue")], "item_id long, text string")
    got = decontaminate.proximity_matches(decontaminate.build_index(docs), items, within=5).collect()
    assert [tuple(r) for r in got] == [(2, 9, 0, 3)]
    got = decontaminate.proximity_matches(decontaminate.build_index(docs), items, within=6).collect()
    assert sorted(map(tuple, got)) == [(1, 9, 0, 6), (2, 9, 0, 3)]


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    from cairn.llm import common

    data = np.frombuffer(b"Alpha beta " * 40 + b"x" * 300 + b" alpha", dtype=np.uint8)
    whole = Words(ALNUM)(data, np.array([0, len(data)]))[2]
    monkeypatch.setattr(common, "BLOCK_BYTES", 64)
    assert (Words(ALNUM)(data, np.array([0, len(data)]))[2] == whole).all() and whole[0] == whole[-1] and len(set(whole.tolist())) == 3


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary_file())


def test_bpe_matches_the_library(spark, docs, texts, tokenizer, no_docs):
    special = spark.createDataFrame([(1000, "a<|endoftext|>b <|endoftext|><|endoftext|>", "x", 1), (1001, "<|endoftext", "x", 1)], docs.schema)
    everything = docs.unionByName(special)
    codec = bpe.fit_lexicon(docs, bpe.vocabulary_file(), size=40)
    coded = bpe.decode(bpe.encode(everything, codec, out_col="tokens"), codec, "tokens", "plain").collect()
    assert len(coded) == len(texts) + 2
    for r in coded:
        want = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert r.tokens == want and r.plain == tokenizer.decode(want, skip_special_tokens=False) == (r.text or "")
    with pytest.raises(ValueError):
        bpe.encode(docs, codec)  # the column is taken
    apart = {r.doc_id: (r.tokens, r.plain) for r in coded}
    assert {r.doc_id: (r.tokens, r.plain) for r in bpe.encode_and_decode(everything, codec, "text", "tokens", "plain").collect()} == apart
    empty = bpe.fit_lexicon(no_docs, bpe.vocabulary_file())
    assert empty.words == 0 and bpe.encode(no_docs, empty).count() == 0
    assert bpe.encode(docs.drop("ids"), empty).where("doc_id = 5").first().ids == tokenizer.encode(texts[5], add_special_tokens=False).ids


def test_pre_token_classes_over_all_code_points(tokenizer):
    pattern = bpe._patterns()
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    for c in [*range(0x3000), *range(0xA700, 0xA800), *(x for a, b in bpe.NEWER for x in (a - 1, a, b, b + 1)), *random.Random(1).sample(range(0x10000, 0x110000), 3000)]:
        text = f"a{chr(c)}1{chr(c)} !{chr(c)}"
        assert [text[a:b] for _, (a, b) in split(text)] == pattern[1].findall(text), hex(c)


def test_merges_and_transducer():
    vocabulary, rng = bpe.Vocabulary(bpe.vocabulary_file()), random.Random(3)
    some = [bytes(rng.choices(b"etaoinshr \xc3\xa9", k=rng.randint(1, 80))) for _ in range(400)]
    bounds = np.concatenate(([0], np.cumsum([len(w) for w in some])))
    data = np.frombuffer(b"".join(some), dtype=np.uint8)
    cuts, ids = vocabulary.merge_many(data, bounds[:-1], bounds[1:])
    for k, w in enumerate(some):
        assert ids[cuts[k] : cuts[k + 1]].tolist() == vocabulary.merge(w) == vocabulary._merge_long([vocabulary.single[b] for b in w])
    held = {w: [k] for k, w in enumerate(sorted(set(some[::2])))}
    automaton = bpe.Transducer(bpe.Transducer.compile(held))
    ranks = automaton.ranks(data, bounds[:-1], bounds[1:])
    assert all((r >= 0) == (w in held and len(w) <= bpe.LONGEST_WORD) for w, r in zip(some, ranks, strict=True))
    assert all(automaton.ids[automaton.bounds[r]] == held[w][0] for w, r in zip(some, ranks, strict=True) if r >= 0)
    shared = bpe.Transducer(bpe.Transducer.compile({b"walking": [1], b"talking": [2], b"talked": [3], b"walked": [4]}))
    assert len(shared.final) == 9  # one state per distinct set of suffixes


def test_proximity_edges(spark, no_docs):
    items = spark.createDataFrame([(1, "red boat"), (2, None), (3, ""), (None, "boat red")], "item_id long, text string")
    assert decontaminate.proximity_matches(decontaminate.build_index(no_docs), items).count() == 0
    docs = spark.createDataFrame([(7, "a red old boat"), (8, None), (9, "")], "doc_id long, text string")
    index = materialize(decontaminate.build_index(docs), "postings")
    got = {(r.doc_id, r.item_id, r.start, r.end) for r in decontaminate.proximity_matches(index, items, within=4).collect()}
    assert got == {(7, 1, 1, 4), (7, None, 1, 4)}
    assert decontaminate.phrase_matches(index, items.limit(0)).where("size(items) > 0").count() == 0


def test_pre_tokens_of_simple_texts():
    pattern, rng = bpe._patterns()[0], random.Random(11)
    latin = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028)]]
    for alphabet in (latin[:128], latin, [*"ab1 2.,'\t\n", "é", "²", "\xa0", "\x85", "–", "ª", "\x1c"], [*"'stremvld \n"]):
        for _ in range(2000):
            text = "".join(rng.choices(alphabet, k=rng.randrange(1, 30)))
            assert bpe._pre_tokens(text, pattern) == pattern.findall(text), repr(text)
    assert bpe._pre_tokens("日本 é 12", pattern) == pattern.findall("日本 é 12")


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("leaders", [8, 2])
def test_jaccard(spark, texts, leaders, monkeypatch):
    from tests.llm.conftest import prose

    rng = random.Random(5)
    more = list(texts)
    for seed in range(6):  # chains of edits, so that components are larger than links
        w = prose(200 + seed, 120).split()
        for step in range(7):
            more.append(" ".join(w))
            for _ in range(2):
                w[rng.randrange(len(w))] = f"edit{seed}-{step}"
    passage = prose(300, 25)
    more += [f"{passage} own{k} words{k} here{k}" for k in range(12)]
    base = prose(400, 100).split()
    for k in range(60):  # a ball of near copies, of which many pairs are too far apart
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"ball{k}"
        more.append(" ".join(w))
    monkeypatch.setattr(jaccard, "LEADERS", leaders)
    frame = spark.createDataFrame(list(enumerate(more)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(frame).collect()}
    assert got == brute_components(more)


def test_shared_counts_in_ranges():
    """How many n-grams each set shares, against counting in plain Python."""
    rng = np.random.default_rng(4)
    grams, owners = rng.integers(0, 3000, 4000).astype(np.int64), rng.integers(1, 90, 4000).astype(np.int64)
    owners[:30] = 0  # several sets of another task
    holders = {}
    for g, o in zip(grams.tolist(), owners.tolist()):
        holders.setdefault(g, set()).add(o)
    want = {}
    for sets in holders.values():
        if len(sets) > 1:
            for o in sets - {0}:
                want[o] = want.get(o, 0) + 1
    firsts, own, sets, counts = jaccard._held_by_several(grams, owners)
    assert dict(zip(sets.tolist(), counts.tolist())) == want
    assert {g: (0 if len(holders[g]) > 1 or 0 in holders[g] else next(iter(holders[g]))) for g in holders} == dict(zip(firsts.tolist(), own.tolist()))


def test_jaccard_edges(spark, no_docs):
    assert jaccard.join_components(no_docs).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words stand in this row"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in jaccard.join_components(rows).collect())))
    assert got == sorted(map(str, [(1, 2, 1), (1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 0, 2)]))


def brute_spans(text):
    out = []
    for k, p in enumerate((r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")):
        for m in re.finditer(p, text or "", re.A):
            if k == 0 and len(m[2]) >= 8 or k == 1 and len(m[0]) >= 16 or k == 2 and len(m[0]) >= 32:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_secrets(spark, texts, no_docs):
    rng = random.Random(9)
    hexes = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(3)]
    base64 = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=64))
    more = [*texts, f"😀 password={hexes[0]} and TOKEN : '{hexes[1]}'", f"AKIA{'Q7' * 8} x AKIAshort secret=token:abcdefgh", f"see {base64} here", "x" + hexes[2] + "y", "supercalifragilisticexpialidocious" * 2, "secret=a" * 300 + f" api_key={hexes[0]}", "pneumonoultramicroscopic/and_long_path_names/in_lower_case/letters"]
    frame = spark.createDataFrame(list(enumerate(more)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in secrets.scan(frame).collect()}
    for i, t in enumerate(more):
        base = [(s["start"], s["kind"], s["end"]) for s in got[i].base]
        assert base == brute_spans(t), i
        assert [sum(k == j for _, k, _ in base) for j in range(3)] == [got[i].n_assign, got[i].n_access, got[i].n_hex]
        assert [tuple(s) for s in got[i].spans if s["kind"] < 3] == base
    at = more.index(f"see {base64} here")
    assert [(s["start"], s["end"]) for s in got[at].spans] == [(4, 68)]
    assert not got[at + 2].spans and not got[len(more) - 1].spans
    assert secrets.scan(no_docs).count() == 0
    masked = frame.join(secrets.scan(frame).select("doc_id", "spans"), "doc_id").select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("m")).where(F.col("doc_id") == at).first().m
    assert masked == "see [secret] here"


def test_secrets_of_one_class_or_few_changes(spark):
    rng = random.Random(12)
    kinds = {name: letters for name, letters in secrets.ENCODINGS if name not in ("decimal", "hex")}
    rows = [(name, "".join(rng.choices(letters, k=40))) for name, letters in kinds.items() for _ in range(40)]
    plain = ["donaudampfschifffahrtsgesellschaft", "src/main/java/org/apache/spark/sql/Dataset", "my-long-blog-post-title-with-words", "INTERNATIONALISATIONOFTEXT", "electroencefalografistas"]
    rows += [("text", x) for x in plain]
    frame = spark.createDataFrame([(i, f"see {t} here") for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {}
    for r in secrets.scan(frame).collect():
        found.setdefault(rows[r.doc_id][0], []).append([(x["start"], x["end"]) for x in r.spans] == [(4, 4 + len(rows[r.doc_id][1]))])
    assert not any(found.pop("text"))
    assert {k: sum(v) for k, v in found.items() if sum(v) < 30} == {}


def brute_battery(token):
    """(p_random, p_text) of a token, test by test in plain Python."""
    body = token.rstrip("=") or token
    name, letters = next(((n, x) for n, x in secrets.ENCODINGS if all(c in x for c in body)), secrets.ENCODINGS[-1])
    n, k = len(body), len(letters)
    values = [letters.index(c) for c in body]
    chi = sum((body.count(c) - n / k) ** 2 / (n / k) for c in letters)
    upper = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    p_uniform = upper((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    high = [v >= k / 2 for v in values]
    h, runs = sum(high), 1 + sum(a != b for a, b in zip(high[:-1], high[1:]))
    both = 2 * h * (n - h)
    z_runs = (runs - both / n - 1) / math.sqrt(both * (both - n) / (n * n * (n - 1))) if both > n else math.sqrt(n)
    mean = sum(values) / n
    spread = sum((v - mean) ** 2 for v in values)
    serial = sum((a - mean) * (b - mean) for a, b in zip(values[:-1], values[1:]))
    z_serial = (serial / spread + 1 / n) * math.sqrt(n) if spread > 1e-9 else math.sqrt(n)
    p_random = min(1.0, 3 * min(p_uniform, 2 * upper(abs(z_runs)), 2 * upper(abs(z_serial))))
    kind = ["a" if c in string.ascii_lowercase else "A" if c in string.ascii_uppercase else "0" if c in string.digits else "-" for c in body]
    changes = sum(a != b for a, b in zip(kind[:-1], kind[1:]))
    usual = min(changes / (n - 1), secrets.TEXT_CHANGES)
    best = -math.inf
    for shares in secrets.LANGUAGES:
        odds = [math.log((1 - secrets.ODD) * x / sum(shares) + secrets.ODD / 26) for x in shares]
        best = max(best, sum(odds[ord(c.lower()) - 97] for c in body if c.isalpha()))
    text = math.log(1 / 4) + (changes * math.log(usual / 3) if changes else 0) + ((n - 1 - changes) * math.log(1 - usual) if n - 1 > changes else 0)
    text += best + kind.count("0") * math.log(secrets.DIGIT) + kind.count("-") * math.log(secrets.SIGN)
    return p_random, math.exp(min(0.0, math.log(len(secrets.ENCODINGS)) + text + n * math.log(k)))


def brute_cutoffs(rows, level):
    """rows: (length class, p). Benjamini-Hochberg on p-values rounded up to tenths of a decade."""
    out = {}
    for c in {c for c, _ in rows}:
        bins = sorted((min(3000, math.floor(-10 * math.log10(max(p, 1e-300)))) for d, p in rows if d == c), reverse=True)
        good = [b for b in set(bins) if 10 ** (-b / 10) <= level * sum(x >= b for x in bins) / len(bins)]
        out[c] = min(good, default=math.inf)
    return out


def test_random_spans_against_brute_force(spark):
    rng = random.Random(31)
    tokens = ["".join(rng.choices(x, k=rng.choice([20, 24, 30, 40, 70, 300]))) for _, x in secrets.ENCODINGS for _ in range(6)]
    words = "wir haben house the river donau dampf schiff internal service path org apache main java build letter morning quiet seven".split()
    tokens += [rng.choice(["", "-", "_", "/"]).join(rng.choices(words, k=rng.randrange(4, 9))) for _ in range(150)] + ["ab" * 15, "a" * 40, "12" * 20, "A1" * 30 + "==", "=" * 24]
    texts = [f"see {t} here" for t in tokens] + [f"{tokens[0]} and {tokens[1]}\n{tokens[200]}", "", None, f"password={tokens[3]}"]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.spans if s["kind"] == 3] for r in secrets.scan(frame).collect()}
    found = []
    for i, t in enumerate(texts):
        base = brute_spans(t)
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", t or ""):
            if not any(a < m.end() and m.start() < b for a, _, b in base):
                size = next((k for k, top in enumerate(secrets.LENGTH_CLASSES) if len(m[0]) <= top), len(secrets.LENGTH_CLASSES))
                found.append((i, m.start(), m.end(), size, *brute_battery(m[0])))
    text, randomness = brute_cutoffs([(f[3], f[5]) for f in found], secrets.FDR), brute_cutoffs([(f[3], f[4]) for f in found], secrets.ALPHA)
    place = lambda p: min(3000, math.floor(-10 * math.log10(max(p, 1e-300))))
    want = {}
    for i, a, b, c, p_random, p_text in found:
        if place(p_text) >= text[c] and place(p_random) < randomness[c]:
            want.setdefault(i, []).append((a, b))
    assert {i: x for i, x in got.items() if x} == want and 40 < sum(map(len, want.values())) < len(found)


def test_battery(spark):
    rng = random.Random(4)
    good = ["".join(rng.choices("0123456789abcdef", k=48)) for _ in range(40)]
    frame = spark.createDataFrame([(x,) for x in [*good, "ab" * 24, "0123456789abcdef" * 3, "a" * 30]], "token string")
    rows = {r.token: r for r in secrets.battery(frame).collect()}
    assert sum(rows[x].p_random >= secrets.ALPHA for x in good) >= 38 and all(rows[x].encoding == "hex" for x in good)
    assert rows["ab" * 24].p_random < secrets.ALPHA and rows["0123456789abcdef" * 3].p_random < secrets.ALPHA and rows["a" * 30].p_random < secrets.ALPHA
    n, k = 48, 16
    token = good[0]
    chi = k / n * sum(token.count(c) ** 2 for c in set(token)) - n
    z = (chi - (k - 1)) / (2 * (k - 1) * (n - 1) / n) ** 0.5
    import math

    assert rows[token].p_uniform == pytest.approx(0.5 * math.erfc(z / 2**0.5), abs=1e-6)


def test_digest_of_nothing(spark):
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    found = secrets.scan(one).select(F.sha2(secrets.span_text("base"), 256).alias("d"), secrets.span_text("spans").alias("s")).first()
    assert found.d == hashlib.sha256(b"").hexdigest() and found.s == ""
