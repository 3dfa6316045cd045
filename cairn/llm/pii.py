"""Format-preserving pseudonyms for personal data.

Numbers and dates are found by pattern, validated (Luhn, ISO 7064, calendar, number plans), and replaced by a
keyed permutation of the values of their own format: a Feistel network over the smallest even number of bits that
holds the format's domain, walked until the result lies in the domain again. So a pseudonym is valid in its
format, equal values get equal pseudonyms in all documents, different values different ones, and the holder of the
key can undo it. Phone numbers are read as country and national number first, however they are written. Separators, lengths, country codes, card brands and e-mail domains stay.

All matches of a text are replaced; overlapping ones go to the leftmost, then to the first kind in KINDS. Cards and
IBANs may be followed by other digits or words, so every end at a separator is tried, and after a start where
nothing is valid the search goes on right behind it. Where a pseudonym would make one of the rejected readings
valid, the walk goes on, so that undoing reads the same value; only there equal values may differ.

Defined cases: null texts stay null, with no values; texts without values stay as they are; repeated rows are
treated alike; an empty table gives no rows. Other columns are carried along.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

ROUNDS = 8
DEMO_KEY = b"replace this key in production"
#: Session setting that holds the query's key.
KEY_SETTING = "spark.cairn.pii.key"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutation of ``range(size)`` for any size; ``tweak`` separates formats."""

    def __init__(self, key: bytes, size: int, tweak: bytes):
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask, self.base = (1 << self.half) - 1, hashlib.blake2b(tweak, key=hashlib.sha256(key).digest(), digest_size=32)

    def _round(self, i: int, x: int) -> int:
        h = self.base.copy()
        h.update(bytes([i]) + x.to_bytes(self.half // 8 + 1, "big"))
        return int.from_bytes(h.digest(), "big") & self.mask if self.half <= 256 else int.from_bytes(hashlib.shake_256(h.digest()).digest(self.half // 8 + 1), "big") & self.mask

    def _once(self, x: int, rounds) -> int:
        left, right = x >> self.half, x & self.mask
        for i in rounds:
            left, right = right, left ^ self._round(i, right)
        return right << self.half | left  # the halves change places, so that the same steps backwards undo it

    def walk(self, x: int, ok: Callable[[int], bool] = lambda _: True, undo: bool = False) -> int:
        """Image of x; walks on until it is in the domain and ``ok`` (which must hold for x)."""
        rounds = range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS)
        while True:
            x = self._once(x, rounds)
            if x < self.size and ok(x):
                return x


@lru_cache(4096)
def _feistel(key: bytes, size: int, tweak: bytes) -> Feistel:
    return Feistel(key, size, tweak)


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refill(text: str, old: str, new: str) -> str:
    """``text`` with the characters ``old``, in their order, replaced by ``new``; what stands between stays."""
    out, k = [], 0
    for c in text:
        if k < len(old) and c == old[k]:
            out.append(new[k])
            k += 1
        else:
            out.append(c)
    return "".join(out)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


# Country codes of two digits; +1 and +7 have one digit, all others three.
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def country_code(digits: str) -> str:
    """The country code at the start of an international number."""
    return digits[:1] if digits[:1] in ("1", "7") else digits[:2] if digits[:2] in TWO_DIGIT_CODES else digits[:3]


class Pseudonyms:
    def __init__(self, key: bytes, undo: bool = False):
        self.key, self.undo = key, undo

    def _number(self, digits: str, tweak: str, ok: Callable[[str], bool] = lambda _: True) -> str:
        n = len(digits)
        if not n:
            return digits
        f = _feistel(self.key, 10**n, f"{tweak}:{n}".encode())
        return str(f.walk(int(digits), lambda x: ok(str(x).zfill(n)), self.undo)).zfill(n)

    def _letters(self, letters: str, tweak: str) -> str:
        n = len(letters)
        if not n:
            return letters
        value = 0
        for c in letters:
            value = value * 26 + ord(c.lower()) - 97
        value = _feistel(self.key, 26**n, f"{tweak}:{n}".encode()).walk(value, undo=self.undo)
        out = []
        for c in reversed(letters):
            value, d = divmod(value, 26)
            out.append(chr(97 + d).upper() if c.isupper() else chr(97 + d))
        return "".join(reversed(out))

    def card(self, text: str) -> str | None:
        d = _digits(text)
        if len(set(d)) == 1 or luhn_digit(d[:-1]) != d[-1]:
            return None
        body = d[0] + self._number(d[1:-1], f"card:{d[0]}", lambda x: len(set(d[0] + x)) > 1)
        return _refill(text, d, body + luhn_digit(body))

    def iban(self, text: str) -> str | None:
        flat = text.replace(" ", "")
        value = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(flat) <= 34 or value(flat[4:] + flat[:4]) % 97 != 1:
            return None
        body, country = flat[4:], flat[:2]
        numbers, letters = _digits(body), "".join(c for c in body if c.isalpha())
        shape = "".join("a" if c.isalpha() else "0" for c in body)
        a, b = iter(self._number(numbers, f"iban:{country}:{shape}")), iter(self._letters(letters, f"iban-letters:{country}:{shape}"))
        body = "".join(next(b) if s == "a" else next(a) for s in shape)
        check = 98 - value(body + country + "00") % 97
        return _refill(text, flat, f"{country}{check:02d}{body}")

    def ipv4(self, text: str) -> str | None:
        parts = text.split(".")
        if any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in parts):
            return None
        x = int.from_bytes(bytes(map(int, parts)), "big")
        return ".".join(map(str, _feistel(self.key, 1 << 32, b"ipv4").walk(x, undo=self.undo).to_bytes(4, "big")))

    def ssn(self, text: str) -> str | None:
        def valid(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        d = _digits(text)
        return _refill(text, d, self._number(d, "ssn", valid)) if valid(d) else None

    def phone(self, text: str) -> str | None:
        """Permutes the national number within its country and length, so all ways of writing a number get the same one."""
        flat = ("+" if text[0] == "+" else "+1") + _digits(text)
        country = country_code(flat[1:])
        d = flat[1 + len(country) :]
        # 00 or a trunk 0 in brackets belong to the writing, not to the number
        trunk = "0" if country != "1" and re.search(r"\(0", text) else ""
        d = d.removeprefix(trunk)
        if not 6 <= len(d) <= 14:
            return None
        plan = country == "1" and len(d) == 10
        if plan and (d[0] in "01" or d[3] in "01") or text[0] != "+" and not plan:
            return None
        ok = (lambda x: x[0] not in "01" and x[3] not in "01") if plan else (lambda x: (x[0] == "0") == (d[0] == "0"))
        new = self._number(d, f"phone:{country}:{plan or d[0] == '0'}", ok)
        shown = (country if text[0] == "+" else "") + trunk
        return _refill(text, shown + d, shown + new)

    def date(self, text: str) -> str | None:
        a, sep, b, c = re.match(r"(\d+)([-/.])(\d+)[-/.](\d+)", text).groups()
        order = "ymd" if len(a) == 4 else "dmy" if sep == "." else "mdy" if int(a) <= 12 else "dmy"
        parts = dict(zip(order, (a, b, c), strict=True))
        try:
            day = datetime.date(int(parts["y"]), int(parts["m"]), int(parts["d"])).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        narrow = sep == "/" and order == "dmy"  # only a day above 12 tells this order from the other
        wide = [k for k in order if k != "y" and parts[k][0] != "0" and len(parts[k]) == 1]  # no leading zeros: 1 to 2 digits
        ok = lambda x: not narrow or datetime.date.fromordinal(FIRST_DAY + x).day > 12
        tweak = f"date:{narrow}".encode()
        new = datetime.date.fromordinal(FIRST_DAY + _feistel(self.key, LAST_DAY - FIRST_DAY + 1, tweak).walk(day - FIRST_DAY, ok, self.undo))
        value = {"y": f"{new.year:04d}", "m": f"{new.month}" if "m" in wide or "d" in wide else f"{new.month:02d}", "d": f"{new.day}" if "m" in wide or "d" in wide else f"{new.day:02d}"}
        return sep.join(value[k] for k in order)

    def email(self, text: str) -> str | None:
        local, _, domain = text.rpartition("@")
        numbers, letters = _digits(local), "".join(c for c in local if c.isascii() and c.isalpha())
        shape = "".join("a" if c.isascii() and c.isalpha() else "0" if c in "0123456789" else c for c in local)
        a, b = iter(self._number(numbers, f"email:{shape}")), iter(self._letters(letters, f"email-letters:{shape}"))
        return "".join(next(b) if s == "a" else next(a) if s == "0" else s for s in shape) + "@" + domain if numbers or letters else None


#: Kinds by priority, with their patterns.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "ipv4": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?![\w-])",
}
_COMPILED = {k: re.compile(p, re.A) for k, p in KINDS.items()}
_ANY = re.compile("[0-9@]")


def _ends(kind: str, text: str, start: int, end: int) -> list[int]:
    """Where a value that starts at ``start`` may end, in the order of trial: cards by their usual length, then the longest first."""
    if kind not in ("card", "iban"):
        return [end]
    least = 13 if kind == "card" else 15
    ends = [e for e in range(end, start + least - 1, -1) if e == end or text[e] in " -" and text[e - 1] not in " -"]
    if kind == "card":
        usual = 15 if text[start] == "3" else 16
        n = {e: len(_digits(text[start:e])) for e in ends}
        ends = sorted((e for e in ends if n[e] >= least), key=lambda e: n[e] != usual)
    return ends


def _values(kind: str, text: str, names: Pseudonyms) -> Iterator[tuple[int, int, str]]:
    """(start, end, new value) of the valid values of one kind."""
    pattern, replace = _COMPILED[kind], getattr(names, kind)
    at, failed = 0, []  # failed: rejected readings since the last value
    while m := pattern.search(text, at):
        start = m.start()
        at = start + 1
        for end in _ends(kind, text, start, m.end()):
            new = replace(text[start:end])
            if new is None:
                failed.append((start, end))
                continue
            others = [(a, b) for a, b in failed if b > start]
            while any(replace((text[a:start] + new + text[end:])[: b - a]) is not None for a, b in others):
                new = replace(new)
            yield start, end, new
            at, failed = end, []
            break


def pseudonymise(text: str | None, names: Pseudonyms) -> tuple[str | None, list[tuple[str, int, int]]]:
    """(new text, [(kind, start, end)] in the old text)."""
    if not text or not _ANY.search(text):
        return text, []
    found = []
    for rank, kind in enumerate(_COMPILED):
        if kind == "email" and "@" not in text:
            continue
        found += [(start, rank, end, kind, new) for start, end, new in _values(kind, text, names)]
    found.sort()
    out, at, spans = [], 0, []
    for start, _, end, kind, new in found:
        if start >= at:
            out += [text[at:start], new]
            spans.append((kind, start, end))
            at = end
    out.append(text[at:])
    return "".join(out), spans


def pseudonyms(docs: DataFrame, key: bytes = DEMO_KEY, text_col: str = "text", undo: bool = False) -> DataFrame:
    """``docs`` with the text replaced, and ``pii``: kind, start and end of each value in the old text."""
    if "pii" in docs.columns:
        raise ValueError("column pii is taken")
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    at = docs.columns.index(text_col)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, undo)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                done = [pseudonymise(x, names) for x in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array([t for t, _ in done], pa.string())
                columns.append(pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for _, x in done], pa.list_(span)))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "pii"])

    kind = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
    return docs.mapInArrow(replaced, StructType([*docs.schema.fields, StructField("pii", ArrayType(kind))]))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, None)
    out = pseudonyms(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key.encode() if key else DEMO_KEY)
    spans = F.transform("pii", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return out.select("doc_id", F.size("pii").cast("long").alias("n_values"), F.array_join(spans, ",").alias("spans"), "text")
