"""Secret scans with a randomness test battery, in DataFrame functions only.

Three base patterns find assignments, access keys and hexadecimal runs. Besides, runs of at least
``MIN_TOKEN`` token characters are candidates for secrets of no known form. For each candidate the encoding is
inferred (the smallest alphabet that holds it) and three tests look for departures from uniform random symbols:
chi-squared uniformity over the alphabet, runs above and below the alphabet's middle, and lag-1 serial
correlation. Their p-values are combined by Bonferroni. Within each length class the Benjamini-Hochberg procedure at ``ALPHA``
over all candidates of the corpus decides which of them aren't random; short ones, for which the tests say little, don't
set the bar for long ones.

What is left may still be natural text. Its p-value is the likelihood of the candidate as text over its likelihood as
uniform symbols of its encoding, times the number of encodings: by Markov's inequality text falls below p with a
chance of at most p. Text keeps its character class (lower, upper, digit, sign) with a rate of change of at most
``TEXT_CHANGES``, and its letters have the frequencies of one of ``LANGUAGES``; rate and language are those that fit the
candidate best. The p-value falls with the length for every encoding but decimal: digits of text are as uniform
as random ones, so nothing but a key's form or its assignment tells them apart. A second Benjamini-Hochberg procedure controls the false
discoveries at ``FDR`` within each length class. A candidate is a secret that the second discovers as no text and the first leaves as random.
Both read histograms of p-values whose size is fixed, over all candidates of the corpus.

Spans are in code points, end exclusive, of whole texts. Base spans always stay; a random span is added
where it overlaps none. Everything runs in the JVM: matches come from ``regexp_extract_all``, their offsets from
the lengths of what ``split`` leaves between them, summed in two levels so that texts with very many matches
stay cheap.

Defined cases: null and empty texts have no spans; equal spans of repeated rows are found row by row; an empty
table has no candidates and no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

# Fixed patterns of the base scan.
ASSIGN = r"""(?:(?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIN_TOKEN = 20
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
KINDS = ["assign", "access", "hex", "random"]

#: False-discovery rate of the battery (candidates taken for not random), rate of class changes in text, false-discovery rate of secrets.
ALPHA, TEXT_CHANGES, FDR = 0.001, 0.2, 0.01
#: Upper bounds of the length classes.
LENGTH_CLASSES = [24, 32, 48, 64, 128, 256]

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the smallest alphabet: name, alphabet. Trailing = signs are padding.
ENCODINGS = [
    ("decimal", _DIGITS), ("hex", _DIGITS + "abcdef"), ("hex_upper", _DIGITS + "ABCDEF"), ("lower", _LOWER), ("upper", _UPPER), ("base32", _UPPER + "234567"), ("base36", _DIGITS + _LOWER), ("base36_upper", _DIGITS + _UPPER),
    ("letters", _UPPER + _LOWER), ("base62", _UPPER + _LOWER + _DIGITS), ("base64", _UPPER + _LOWER + _DIGITS + "+/"), ("base64url", _UPPER + _LOWER + _DIGITS + "-_"), ("other", _UPPER + _LOWER + _DIGITS + "+/-_="),
]

#: Letters a to z in parts per 10,000 of text: English, German, French, Spanish.
LANGUAGES = [
    [817, 149, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98, 236, 15, 197, 7],
    [652, 189, 273, 508, 1640, 166, 301, 458, 655, 27, 142, 344, 253, 978, 259, 67, 2, 700, 727, 615, 417, 85, 192, 3, 4, 113],
    [764, 90, 326, 367, 1472, 107, 87, 74, 753, 61, 7, 546, 297, 710, 580, 252, 136, 669, 795, 724, 631, 184, 5, 43, 13, 33],
    [1153, 222, 402, 501, 1218, 69, 177, 70, 625, 49, 1, 497, 316, 671, 868, 251, 88, 687, 798, 463, 293, 114, 2, 22, 101, 47],
]
#: Share of letters that follow no language, as in names and numbers of parts; share of one digit and one sign in their class.
ODD, DIGIT, SIGN = 0.05, 0.1, 0.25


def _few_sums(sizes: Column) -> Column:
    """Exclusive running sums of a short array."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + x).cast("int").alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    return F.aggregate(sizes, start, step, lambda a: a["out"])


def running_sums(sizes: Column, n: Column, block: int = 256) -> Column:
    """Exclusive running sums of ``n`` sizes, in blocks, so that the work stays near linear."""
    numbers = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
    part = lambda b: F.slice(sizes, b * block + 1, F.lit(block))
    totals = _few_sums(F.transform(numbers, lambda b: F.aggregate(part(b), F.lit(0), lambda a, x: (a + x).cast("int"))))
    return F.flatten(F.transform(numbers, lambda b: F.transform(_few_sums(part(b)), lambda x: x + F.element_at(totals, b + 1))))


def find_spans(df: DataFrame, text_col: str, pattern: str, out_col: str) -> DataFrame:
    """Adds all matches of ``pattern`` as ``array<struct<start:int,end:int,match:string>>``."""
    m, p, s, n = (f"{out_col}__{x}" for x in "mpsn")
    none = F.array().cast("array<string>")
    df = df.withColumn(m, F.coalesce(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0)), none)).withColumn(n, F.size(m))
    df = df.withColumn(p, F.when(F.col(n) > 0, F.split(text_col, pattern, -1)).otherwise(none))
    # lengths of what stands before each match, matches included
    df = df.withColumn(s, F.transform(m, lambda x, i: (F.length(F.element_at(F.col(p), i + 1)) + F.when(i > 0, F.length(F.element_at(F.col(m), F.greatest(i, F.lit(1))))).otherwise(0)).cast("int")))
    df = df.withColumn(f"{s}r", running_sums(F.col(s), F.col(n)))
    begin = lambda i: F.element_at(F.col(f"{s}r"), i + 1) + F.element_at(F.col(s), i + 1)
    spans = F.transform(m, lambda x, i: F.struct(begin(i).alias("start"), (begin(i) + F.length(x)).cast("int").alias("end"), x.alias("match")))
    return df.withColumn(out_col, spans).drop(m, p, s, n, f"{s}r")


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z), after Abramowitz and Stegun 26.2.17 (fixed values)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(df: DataFrame, token: str = "token") -> DataFrame:
    """Adds encoding, p_uniform, p_runs, p_serial, p_random (combined) and p_text of a string column."""
    body = F.regexp_replace(token, "=+$", "")
    name = F.lit("other")
    alphabet = F.lit(ENCODINGS[-1][1])
    for enc, letters in reversed(ENCODINGS[:-1]):
        inside = F.length(F.translate(F.col("__body"), letters, "")) == 0
        name, alphabet = F.when(inside, enc).otherwise(name), F.when(inside, letters).otherwise(alphabet)
    df = df.withColumn("__body", F.when(F.length(body) > 0, body).otherwise(F.col(token))).withColumns({"encoding": name, "__alphabet": alphabet, "__n": F.length("__body").cast("double")})
    n, k = F.col("__n"), F.length("__alphabet").cast("double")
    squares = F.aggregate(F.split("__alphabet", ""), F.lit(0.0), lambda a, c: a + F.when(F.length(c) > 0, F.pow(n - F.length(F.replace(F.col("__body"), c, F.lit(""))), F.lit(2.0))).otherwise(0.0))
    values = F.transform(F.filter(F.split("__body", ""), lambda c: F.length(c) > 0), lambda c: F.instr(F.col("__alphabet"), c).cast("double") - 1)
    df = df.withColumns({"__squares": squares, "__values": values})
    zero = F.struct(*(F.lit(x).cast("double").alias(y) for x, y in ((None, "last"), (0, "runs"), (0, "high"), (0, "sum"), (0, "square"), (0, "product"))))

    def step(a: Column, v: Column) -> Column:
        high, was = v >= k / 2, a["last"] >= k / 2
        return F.struct(
            v.alias("last"), (a["runs"] + F.when(a["last"].isNull() | (high != was), 1.0).otherwise(0.0)).alias("runs"), (a["high"] + F.when(high, 1.0).otherwise(0.0)).alias("high"),
            (a["sum"] + v).alias("sum"), (a["square"] + v * v).alias("square"), (a["product"] + F.coalesce(a["last"] * v, F.lit(0.0))).alias("product"),
        )

    changes = F.length(F.regexp_replace("__body", "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])", " ")) - n
    df = df.withColumns({"__sums": F.aggregate("__values", zero, step), "__first": F.element_at("__values", 1), "__last": F.element_at("__values", -1), "__changes": changes.cast("double")})
    plain = F.lower("__body")
    df = df.withColumn("__letters", F.transform(F.array(*map(F.lit, _LOWER)), lambda c: n - F.length(F.replace(plain, c, F.lit("")))))
    s = F.col("__sums")
    chi = k / n * F.col("__squares") - n
    z_uniform = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    both = 2 * s["high"] * (n - s["high"])
    z_runs = F.when((both > 0) & (both > n), (s["runs"] - both / n - 1) / F.sqrt(both * (both - n) / (n * n * (n - 1)))).otherwise(F.sqrt(n))
    mean = s["sum"] / n
    spread = s["square"] - n * mean * mean
    covariance = s["product"] - mean * (2 * s["sum"] - F.col("__first") - F.col("__last")) + (n - 1) * mean * mean
    z_serial = F.when(spread > 1e-9, (covariance / spread + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
    rate = F.col("__changes") / (n - 1)
    times_log = lambda x, y: F.when(x > 0, x * F.log(y)).otherwise(0.0)
    usual = F.least(rate, F.lit(TEXT_CHANGES))
    counts, n_digits = F.col("__letters"), n - F.length(F.translate("__body", _DIGITS, ""))
    n_letters = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    odds = [[math.log((1 - ODD) * x / sum(shares) + ODD / 26) for x in shares] for shares in LANGUAGES]
    letters = F.greatest(*(F.aggregate(F.zip_with(counts, F.array(*map(F.lit, o)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) for o in odds))
    classes = math.log(1 / 4) + times_log(F.col("__changes"), usual / 3) + times_log(n - 1 - F.col("__changes"), 1 - usual)
    as_text = classes + letters + n_digits * math.log(DIGIT) + (n - n_letters - n_digits) * math.log(SIGN)
    p_text = F.exp(F.least(F.lit(0.0), math.log(len(ENCODINGS)) + as_text + n * F.log(k)))
    df = df.withColumns({"p_uniform": _upper_tail(z_uniform), "p_runs": 2 * _upper_tail(F.abs(z_runs)), "p_serial": 2 * _upper_tail(F.abs(z_serial)), "p_text": p_text})
    return df.withColumn("p_random", F.least(F.lit(1.0), 3 * F.least("p_uniform", "p_runs", "p_serial"))).drop("__body", "__alphabet", "__n", "__squares", "__values", "__sums", "__first", "__last", "__changes", "__letters")


def length_class(n: Column) -> Column:
    out = F.lit(len(LENGTH_CLASSES))
    for i, top in reversed(list(enumerate(LENGTH_CLASSES))):
        out = F.when(n <= top, i).otherwise(out)
    return out


def p_bin(p: Column) -> Column:
    """Tenths of a decade below 1, 0 to 3000: a p-value is at most that of its bin's lower edge."""
    return F.least(F.lit(3000), F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-300))))).cast("int")


def discoveries(candidates: DataFrame, bin_col: str, level: float) -> DataFrame:
    """(length_class, cutoff): per length class the lowest bin that Benjamini-Hochberg at ``level`` keeps. At most 7 x 3001 groups go through it."""
    from pyspark.sql.window import Window

    bins = candidates.groupBy("length_class", F.col(bin_col).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("length_class").orderBy(F.desc("bin"))
    whole = Window.partitionBy("length_class")
    ranked = bins.withColumns({"below": F.sum("n").over(down), "total": F.sum("n").over(whole)})
    return ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 10) <= level * F.col("below") / F.col("total")).groupBy("length_class").agg(F.min("bin").alias("cutoff"))


def beyond(cutoffs: DataFrame, bin_col: str) -> Column:
    """Whether a candidate's bin reaches the cutoff of its length class."""
    out = F.lit(False)
    for c, cutoff in cutoffs.collect():  # a row for each length class
        out = out | ((F.col("length_class") == c) & (F.col(bin_col) >= cutoff))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, ``base`` and ``spans`` as sorted ``array<struct<start,kind,end>>`` (kind: place in KINDS)."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for name, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True):
        df = find_spans(df, "text", pattern, name)
    value = lambda x: F.regexp_extract(x["match"], ASSIGN, 1)
    df = df.withColumn("assign", F.filter("assign", lambda x: F.length(value(x)) >= 8))
    mark = lambda name: F.transform(name, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(name)).alias("kind"), x["end"].alias("end")))
    df = df.withColumn("base", F.array_sort(F.concat(*(mark(k) for k in KINDS[:3]))))
    df = df.withColumn("random", F.filter("random", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))
    sizes = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    # one pass over the texts; what follows reads only ids and spans
    found = materialize(df.select(F.col("doc_id"), F.expr("uuid()").alias("row"), *sizes, "base", "random"), "secret-spans")
    tokens = found.where(F.size("random") > 0).select("row", F.explode("random").alias("x")).select("row", "x.start", "x.end", F.col("x.match").alias("token"))
    tested = battery(tokens).withColumns({"length_class": length_class(F.length("token")), "text_bin": p_bin(F.col("p_text")), "random_bin": p_bin(F.col("p_random"))})
    tested = materialize(tested.select("row", "start", "end", "length_class", "text_bin", "random_bin"), "secret-candidates")
    no_text, not_random = beyond(discoveries(tested, "text_bin", FDR), "text_bin"), beyond(discoveries(tested, "random_bin", ALPHA), "random_bin")
    kept = tested.where(no_text & ~not_random).groupBy("row").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("added"))
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return found.join(kept, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base", spans.alias("spans"))


def span_text(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each stretch that spans cover replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        out = F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))
