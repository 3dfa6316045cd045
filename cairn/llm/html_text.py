"""Main text of web pages by two-pass block rules.

A page is cut into blocks of text. The first pass decides blocks by their place (menus, headers, footers,
sidebars, notices, adverts, forms, comments), link density, length and stop-word density into *good*, *bad*
and *ambiguous* (too short, or too few stop words to tell). In the second pass an ambiguous block takes the
label of the nearest decided block of the same scope; between a good and a bad one at equal distance the
good one wins inside the article. The scope is the page's outermost ``<article>`` or ``<main>`` with the most text and
those of at least half its text, if it has one, else the body; blocks outside of the scope are bad. Where a third of the text of a
``<main>`` or more stands in articles inside of it, what follows the first of these outside of them must pass by its own density.

Names of classes and ids mark places as bad. Those in WEAK_NAME may also name parts of an article: there they are evidence
for the first pass only, so that a block with the density of prose stays. On a page whose blocks hold next to no
known stop words (another language), length and links decide alone.

Texts are whole: character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined by one newline, and nothing else is dropped or cut. The parser is a single forward
scan, linear in the page's length and at any depth of nesting.

Defined cases: null or empty html gives an empty text; text outside of any element is a block of the
body; repeated rows are extracted row by row; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed word lists: frequent function words of four languages.
STOP_WORDS = frozenset(
    """the of and to in a is that it was for on are as with at be this by from or an have had not but he his they were which you we
    der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
    de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec être cette ou son aux
    de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque""".split()
)
# Fixed element lists.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe svg object audio video canvas select noembed noframes".split())
BAD_TAGS = frozenset("nav footer aside form button menu dialog label fieldset head".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar tablist".split())
CLOSED_BY_BLOCK = frozenset(["p"])
#: Words in class or id names that mark what isn't the article.
BAD_NAME = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notices?|alerts?|warning|nav\w*|menus?|breadcrumbs?|sidebars?|side|rail|widgets?|"
    r"footers?|header|masthead|share\w*|sharing|social\w*|related|recommend\w*|comments?|commentlist|disqus|respond|replies|reply|discussion|newsletter|subscri\w*|signup|sign-up|login|popup|modal|overlay|"
    r"pagination|pager|toolbar|topbar|skip\w*|copyright|legal|disclaimer|outbrain|taboola|toc|tags?|tagcloud|meta|byline-share|paywall|search\w*|form)(?:$|[-_\s\d])",
    re.I,
)
#: Those that parts of an article carry as well.
WEAK_NAME = re.compile(r"(?:^|[-_\s])(?:tags?|meta|side|header|legal|warning|alerts?|search\w*|form|copyright|toc|discussion|reply|replies|respond)(?:$|[-_\s\d])", re.I)
KEEP_NAME = re.compile(r"(?:^|[-_\s])(?:article|post|entry|main|story)[-_]?(?:body|content|text|main)(?:$|[-_\s])", re.I)
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""\s*/*([^\s"'>/=][^\s>/=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']*))?""")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")

SHORT, LONG, LINKS, FEW_STOPS, MANY_STOPS = 70, 200, 0.5, 0.12, 0.2
#: A page with a smaller share of known stop words is in a language that the list doesn't hold.
KNOWN_LANGUAGE = 0.06
SENTENCE_END = ".!?…:;。！？।؟\"'”»)"


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    bad_place: bool
    scope: int  # number of the outermost article or main, 0 for the body
    heading: bool
    weak: bool = False  # a name in WEAK_NAME inside of the scope
    inner: bool = False  # in an article inside of the scope
    label: str = ""


@dataclass(frozen=True)
class Place:
    """An open element, with what it hands down to those inside."""

    tag: str = ""
    bad: bool = False
    scope: int = 0
    heading: bool = False
    link: bool = False
    weak: bool = False
    inner: bool = False


@lru_cache(256)
def _close(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I)


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, without those of no text."""
    out: list[Block] = []
    stack, open_tags = [Place()], Counter()  # open_tags: how often each tag is on the stack
    pieces: list[str] = []
    links = scopes = breaks = 0
    blank, where = True, stack[0]

    def end_block() -> None:
        nonlocal links, blank
        text = SPACE.sub(" ", "".join(pieces)).strip()
        if text:
            out.append(Block(text, links, where.bad, where.scope, where.heading, where.weak, where.inner))
        pieces.clear()
        links, blank = 0, True

    def add(text: str) -> None:
        nonlocal links, where, breaks, blank
        text = html.unescape(text)
        if text and not text.isspace():
            breaks = 0
            if blank:
                where, blank = stack[-1], False
            if stack[-1].link:
                links += len(text)
        pieces.append(text)

    def close_to(k: int) -> None:
        for x in stack[k:]:
            open_tags[x.tag] -= 1
        del stack[k:]

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        closing = page.startswith("</", lt)
        m = TAG_NAME.match(page, lt + 1 + closing)
        if not m:
            add("<")
            at = lt + 1
            continue
        tag, at, names, role = m[0].lower(), m.end(), "", ""
        hidden = False
        while at < size and page[at] != ">":
            a = ATTRIBUTE.match(page, at)
            if not a or a.end() == at:
                at += 1
                continue
            at = a.end()
            key = a[1].lower()
            if key in ("class", "id", "role", "hidden", "aria-hidden"):
                value = html.unescape((a[2] or "").strip("\"'"))
                names += f" {value} " if key in ("class", "id") else ""
                role = value.lower() if key == "role" else role
                hidden |= key == "hidden" or key == "aria-hidden" and value == "true"
        at += 1
        if closing:
            if tag in BLOCK_TAGS:
                end_block()
            elif tag in ("td", "th"):
                pieces.append(" ")
            if open_tags[tag]:
                close_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in RAW_TAGS:
            close = _close(tag).search(page, at)
            at = size if not close else page.find(">", close.end()) + 1 or size
            continue
        if tag == "br":
            pieces.append(" ")
            breaks += 1
            if breaks > 1:
                end_block()
            continue
        if tag in BLOCK_TAGS:
            end_block()
            while len(stack) > 1 and (stack[-1].tag in CLOSED_BY_BLOCK or tag == stack[-1].tag and tag in ("li", "dd", "dt", "tr")):
                close_to(len(stack) - 1)
            if any(open_tags[x] for x in CLOSED_BY_BLOCK):  # an open paragraph ends, with what it left open: every block ends it, so no block is between
                close_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in CLOSED_BY_BLOCK))
        elif tag in ("td", "th"):
            pieces.append(" ")
        if tag in VOID_TAGS:
            continue
        up = stack[-1]
        scope, inner = up.scope, up.inner
        named = bool(names and tag not in ("html", "body") and BAD_NAME.search(names) and not KEEP_NAME.search(names))
        weak = named and bool(scope) and not BAD_NAME.search(WEAK_NAME.sub(" ", WEAK_NAME.sub(" ", names)))
        if tag in ("article", "main") and not up.bad and not named:
            if not scope:
                scopes += 1
                scope = scopes
            else:
                inner = True
        bad = up.bad or tag in BAD_TAGS or tag == "header" and not scope or role in BAD_ROLES or named and not weak or hidden
        stack.append(Place(tag, bad, scope, up.heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6"), up.link or tag == "a", up.weak or weak, inner))
        open_tags[tag] += 1
    end_block()
    return out


def classify(found: list[Block]) -> list[Block]:
    """Both passes; returns the good blocks."""
    sizes, inner = Counter(), Counter()
    for b in found:
        if not b.bad_place and b.scope:
            sizes[b.scope] += len(b.text)
            inner[b.scope] += len(b.text) if b.inner else 0
    chosen = {s for s, n in sizes.items() if 2 * n >= max(sizes.values())}
    outside = {s for s in chosen if 3 * inner[s] >= sizes[s]}  # scopes whose text stands in articles inside of them
    inside, seen = bool(chosen), set()
    counts = []
    for b in found:
        words = [w.lower() for w in WORD.findall(b.text)]
        counts.append((sum(w in STOP_WORDS for w in words), len(words)))
    in_place = [c for b, c in zip(found, counts, strict=True) if not b.bad_place]
    known = sum(s for s, _ in in_place) >= KNOWN_LANGUAGE * sum(n for _, n in in_place)
    for b, (n_stops, n_words) in zip(found, counts, strict=True):
        stops = n_stops / n_words if n_words else 0.0
        prose = len(b.text) >= SHORT and (stops >= MANY_STOPS if known else len(b.text) >= LONG or b.text[-1] in SENTENCE_END)
        if b.inner:
            seen.add(b.scope)
        if b.bad_place or inside and b.scope not in chosen or b.links > LINKS * len(b.text):
            b.label = "bad"
        elif b.weak or b.scope in outside and b.scope in seen and not b.inner:
            b.label = "good" if prose else "" if b.weak and b.heading else "bad"
        elif b.heading or len(b.text) < SHORT:
            b.label = ""
        elif prose or stops >= FEW_STOPS and len(b.text) >= LONG:
            b.label = "good"
        elif known and stops < FEW_STOPS and not inside and len(b.text) < LONG:
            b.label = "bad"
    near = [b for b in found if not inside or b.scope in chosen and not b.bad_place]
    far = len(near) + 1
    left, right = [(far, "")] * len(near), [(far, "")] * len(near)
    for order, into in ((range(len(near)), left), (range(len(near) - 1, -1, -1), right)):
        gap, label = far, ""
        for k in order:
            gap, label = (0, near[k].label) if near[k].label else (min(gap + 1, far), label)
            into[k] = (gap, label)
    for k, b in enumerate(near):
        if not b.label:
            (dl, ll), (dr, lr) = left[k], right[k]
            if b.heading and lr == "good":  # a heading belongs to what follows it
                b.label = "good"
            elif ll == lr or dl == dr:
                b.label = ll if ll == lr and ll else ("good" if inside or "good" in (ll, lr) and b.heading else ll or lr)
            else:
                b.label = ll if dl < dr else lr
            b.label = b.label or "good"
    return [b for b in found if b.label == "good"]


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in classify(blocks(page))) if page else ""


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` and the main text of each page."""
    source = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = pa.array([main_text(x) for x in part.column(len(keep)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=[*part.schema.names[:-1], out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(rows, f"{fields}, `{out_col}` string")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
