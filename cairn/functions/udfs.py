"""Text functions that column expressions can't state: Arrow-batched pandas UDFs over the standard library."""

from __future__ import annotations

import bisect
import difflib
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, MapType, StringType, StructField, StructType

# Sections by the headings that open them (lower case, straight quotes, without marks), in the order of trial.
SECTIONS = [
    ("inspiration", r"(our |the |my )?inspirations?"),
    ("inspiration", r"what inspired (us|me)"),
    ("inspiration", r".{1,40}[-:] inspiration"),
    ("what_it_does", r"what (it|this|the \w+|our \w+) does( \(.{1,30}\))?"),
    ("what_it_does", r"what does (it|this) do"),
    ("what_it_does", r"what it does .{1,30} do"),
    ("what_it_does", r"what is (?!next\b|the\b|our\b|a\b|an\b)[\w.&'-]+( [\w.&'-]+){0,3}"),
    ("what_it_does", r"(project |product )?(overview|description|summary)"),
    ("what_it_does", r"about( the| this| our)? (project|app|product|game|tool)"),
    ("what_it_does", r"(the |our )?solution"),
    ("how_it_works", r"how (it|this) works"),
    ("how_it_works", r"how to use( it)?"),
    ("how_it_works", r"(key |main |core )?features"),
    ("how_we_built_it", r"how (we|i|it was|it is|it's|the team) (buil[dt]|made|developed|created)( it| this)?"),
    ("how_we_built_it", r"(the |our )?(tech(nology)? stack|technical implementation|implementation|architecture)"),
    ("how_we_built_it", r"technolog(y|ies) used"),
    ("challenges", r"(the |our )?challenges?( (we|i) (ran into|faced|encountered|had|overcame))?"),
    ("accomplishments", r"accomplishments?( that)?( (we're|we are|i'm|i am|were) (most )?proud of)?"),
    ("accomplishments", r"what (we're|we are|i'm|i am) proud of"),
    ("what_we_learned", r"what (we|i)( have|'ve)? (learned|learnt)"),
    ("what_we_learned", r"(key )?(lessons|learnings|takeaways)( learned)?"),
    ("whats_next", r"what's next( for .{0,80})?"),
    ("whats_next", r"what is next( for .{0,80})?"),
    ("whats_next", r"(next steps|future work|future plans|future scope|roadmap)"),
    ("problem", r"(the |our )?problem( statement)?( we('re| are) solving)?"),
    ("built_with", r"built with"),
    ("try_it_out", r"try it out"),
]
# Sections that make up a pitch, in order; those that a line with text behind its heading doesn't open; longest heading.
PITCH_ORDER = ("what_it_does", "how_it_works", "problem", "preamble", "inspiration", "how_we_built_it")
NEVER_INLINE, LONGEST_HEADING = ("built_with", "try_it_out"), 90
_SECTIONS = [(name, re.compile(pattern)) for name, pattern in SECTIONS]
_MARKS = re.compile(r"^[\s#>*_`~•·|–—-]+|[\s#*_`~:.|?!–—-]+$")
_NUMBERED = re.compile(r"^\(?\d{1,2}[.)]\s+")
_MARKED = re.compile(r"\s{0,3}#{1,6}\s+\S|(\*\*|__).{2,70}\1:?\s*$")
_INLINE = re.compile(r"([^:\n]{3,60}?)\s*[:–—-]\s+(\S.{15,})$")
BLOCKS = re.compile(r"</?(?:p|div|section|article|ul|ol|table|tr|h[1-6]|header|footer|main|blockquote|pre)\b[^>]*>", re.I)
DROPPED = re.compile(r"<(script|style|noscript|template|iframe|svg|figure|video|audio|button)\b[\s\S]*?</\1\s*>|<!--[\s\S]*?-->", re.I)


def html_to_text_one(page: str | None) -> str | None:
    """Readable text of HTML: headings as ``## x``, list items as ``- ``, headings and blocks between blank lines, references decoded."""
    if page is None:
        return None
    page = DROPPED.sub(" ", page)
    page = re.sub(r"<h[1-6]\b[^>]*>", "\n\n## ", page, flags=re.I)
    page = BLOCKS.sub("\n\n", re.sub(r"<li\b[^>]*>", "\n- ", re.sub(r"<br\b[^>]*>", "\n", page, flags=re.I), flags=re.I))
    text = html.unescape(re.sub(r"<[^>]+>", "", page))
    text = "\n".join(re.sub(r"[^\S\n]+", " ", line).strip() for line in text.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def bare_heading(line: str) -> str:
    """A line as a heading: lower case, straight quotes, without symbols, marks and numbering."""
    words = "".join(c for c in line if unicodedata.category(c) not in ("So", "Sk", "Cs", "Co") and c not in "\ufe0f\u200d\u20e3")
    words = re.sub(r"\[([^\]]+)\]\([^)]*\)", r"\1", words).translate(str.maketrans("’‘`", "'" * 3))
    words = _MARKS.sub("", _NUMBERED.sub("", _MARKS.sub("", words)))
    return re.sub(r"\s+", " ", words).strip().lower()


def known_heading(line: str) -> str | None:
    bare = bare_heading(line) if 0 < len(line.strip()) <= LONGEST_HEADING else ""
    return next((name for name, pattern in _SECTIONS if pattern.fullmatch(bare)), None) if bare else None


def heading_of(line: str) -> tuple[str, str] | None:
    """(section, text behind the heading on its line) of a heading line, ``other:slug`` for unknown marked ones; None for prose."""
    if name := known_heading(line):
        return name, ""
    if m := _INLINE.match(line.strip()):
        name = known_heading(m[1])
        if name and name not in NEVER_INLINE:
            return name, m[2]
    slug = re.sub(r"[^a-z0-9]+", "_", bare_heading(line)).strip("_") if _MARKED.match(line) else ""
    return (f"other:{slug}", "") if slug else None


def sections_one(text: str | None) -> dict[str, str]:
    """Section texts by name; what stands before the first heading is the preamble; repeats are joined, empty ones dropped."""
    out: dict[str, list[str]] = {}
    name = "preamble"
    for line in (text or "").split("\n"):
        found = heading_of(line)
        if found:
            name, line = found
            if not line:
                continue
        out.setdefault(name, []).append(line)
    joined = {k: re.sub(r"\n{3,}", "\n\n", "\n".join(v)).strip() for k, v in out.items()}
    return {k: v for k, v in joined.items() if v}


def prose_one(text: str | None) -> str | None:
    """Lines as one line; a full stop between lines that are sentences without one."""
    if text is None:
        return None
    out = ""
    for line in (re.sub(r"\s+", " ", x).strip(" -*•") for x in text.split("\n")):
        if line:
            sentence = len(line.split()) >= 4 and line[:1].isupper()
            out += (("" if not out else ". " if sentence and out[-1] not in ".!?:;," else " ")) + line
    return out


def pitch_one(title: str | None, tagline: str | None, sections: dict | None, least: int = 300, cap: int = 1500) -> str:
    """Title, tagline and the sections of PITCH_ORDER until their text makes ``least`` characters; no line breaks, capped at a sentence end."""
    title, tagline = (re.sub(r"\s+", " ", x or "").strip() for x in (title, tagline))
    parts = [x for x in (title, tagline if tagline.lower() != title.lower() else "") if x]
    size = 0
    for name in PITCH_ORDER:
        lines = [x for x in ((sections or {}).get(name) or "").split("\n") if not title or bare_heading(x) != title.lower()]
        body = prose_one("\n".join(lines)) or ""
        if len(body) < 25 or any(body.lower() == p.lower() for p in parts):
            continue
        if tagline in parts[1:] and body.lower().startswith(tagline.lower()):
            parts.remove(tagline)  # the body says it again
        parts.append(body)
        size += len(body)
        if size >= least:
            break
    text = ""
    for part in parts:
        text = f"{text}{'.' if text and text[-1] not in '.!?:…' else ''} {part}".strip()
    if len(text) <= cap:
        return text
    ends = [m.end() for m in re.finditer(r"[.!?…][\"')\]]?(?=\s|$)", text[:cap])]
    if ends and ends[-1] * 2 >= cap:
        return text[: ends[-1]].rstrip()
    blank = text[:cap].rfind(" ")
    return text[: blank if blank * 2 > cap else cap - 1].rstrip(" ,;:-") + "…"


class PlainText:
    """Text without markup of characters (case, kinds of quotes and blanks), with the place in the original of every character."""

    def __init__(self, text: str):
        out: list[str] = []
        self.origin: list[int] = []
        for i, c in enumerate(text):
            plain = re.sub(r"\s+", " ", normalise_chars_one(c).casefold())
            if plain == " " and (not out or out[-1] == " "):
                continue
            out += plain
            self.origin += [i] * len(plain)
        self.text = "".join(out).rstrip(" ")

    def find(self, needle: str, start: int = 0) -> tuple[int, int] | None:
        """Original (start, end) of the first occurrence at or behind the original place ``start``."""
        want = PlainText(needle).text
        at = self.text.find(want, bisect.bisect_left(self.origin, start)) if want else -1
        return None if at < 0 else (self.origin[at], self.origin[at + len(want) - 1] + 1)


def located_one(text: str, sentences: list[str]) -> list[tuple[int, int] | None]:
    """Places of sentences in a text, in order: as they stand, else as plain text, else from the start on; None where a sentence isn't there."""
    out, plain, cursor = [], None, 0
    for sentence in (s.strip() for s in sentences):
        at = text.find(sentence, cursor) if sentence else -1
        span = (at, at + len(sentence)) if at >= 0 else None
        if sentence and span is None:
            plain = plain or PlainText(text)
            span = plain.find(sentence, cursor) or plain.find(sentence)
        if span and span[0] >= cursor:
            cursor = span[1]
        out.append(span)
    return out


def normalise_chars_one(text: str | None) -> str | None:
    """NFKC, straight quotes and dashes."""
    return None if text is None else unicodedata.normalize("NFKC", text).translate(str.maketrans("‘’“”–—", "''\"\"--"))


def fuzzy_words_one(text: str | None) -> list[str]:
    """The words that fuzzy containment compares, in order."""
    return re.sub(r"[^\w]+", " ", normalise_chars_one(text or "").casefold().replace("'", "")).split()


def fuzzy_contains_one(quote: str | None, source: str | None, least: float = 0.9) -> float:
    """Best share of the quote's words found in order in a window of as many words; 0 below four words."""
    q, s = fuzzy_words_one(quote), fuzzy_words_one(source)
    if len(q) < 4 or not s:
        return 0.0
    best, rare = 0.0, set(q)
    starts = sorted({max(0, i - j) for i, w in enumerate(s) if w in rare for j in ((q.index(w)),)})
    matcher = difflib.SequenceMatcher(autojunk=False)
    matcher.set_seq2(q)
    for i in starts:
        window = s[i : i + len(q) + 2]
        if len(rare & set(window)) < least * len(rare) - 1:
            continue
        matcher.set_seq1(window)
        best = max(best, sum(b.size for b in matcher.get_matching_blocks()) / len(q))
        if best >= 1:
            break
    return min(best, 1.0)


@F.pandas_udf(StringType())
def html_to_text(page: pd.Series) -> pd.Series:
    return page.map(html_to_text_one, na_action="ignore")


@F.pandas_udf(StringType())
def to_prose(text: pd.Series) -> pd.Series:
    return text.map(prose_one, na_action="ignore")


@F.pandas_udf(MapType(StringType(), StringType()))
def parse_sections(text: pd.Series) -> pd.Series:
    return text.map(sections_one)


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def locate_sentences(text: pd.Series, quote: pd.Series) -> pd.Series:
    """Places of the quote's sentences in the text."""
    cut = lambda q: [x for x in re.findall(r"[^.!?]*[.!?]+\s*|[^.!?]+$", q or "") if x.strip()]
    return pd.Series([[{"start": a, "end": b} for a, b in (x or (None, None) for x in located_one(t or "", cut(q)))] for t, q in zip(text, quote, strict=True)], dtype=object)


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("sections", MapType(StringType(), StringType())), StructField("pitch", StringType())]))
def page_parts(title: pd.Series, tagline: pd.Series, page: pd.Series) -> pd.DataFrame:
    """Text, sections and pitch of a page in one pass through Python."""
    rows = []
    for name, line, raw in zip(title, tagline, page, strict=True):
        text = normalise_chars_one(html_to_text_one(raw))
        sections = sections_one(text)
        rows.append((text, sections, pitch_one(name, line, sections)))
    return pd.DataFrame(rows, columns=["text", "sections", "pitch"])


@F.pandas_udf(StringType())
def build_pitch(title: pd.Series, tagline: pd.Series, sections: pd.Series) -> pd.Series:
    return pd.Series([pitch_one(a, b, dict(c) if c is not None else None) for a, b, c in zip(title, tagline, sections, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def normalise_chars(text: pd.Series) -> pd.Series:
    return text.map(normalise_chars_one, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def fuzzy_words(text: pd.Series) -> pd.Series:
    return text.map(fuzzy_words_one)


@F.pandas_udf(DoubleType())
def fuzzy_contains(quote: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([fuzzy_contains_one(q, s) for q, s in zip(quote, source, strict=True)], dtype=float)
