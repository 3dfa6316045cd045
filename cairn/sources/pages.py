"""Project and listing pages to records: one pass of the standard library's HTML parser over each page, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements without an end tag; ids and classes of what a project page holds.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
PROJECT = "title string, tagline string, body string, tech array<string>, links array<string>, hackathon string, hackathon_url string, hackathon_id string, prizes array<string>, is_winner boolean, team_size int, likes int, started string, year int"
GALLERY = "entries array<struct<url:string,title:string,tagline:string,is_winner:boolean>>, next_page string"


class Node:
    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        self.classes = set(attributes.get("class", "").split())

    def walk(self) -> Iterator[Node]:
        pending = [self]
        while pending:
            node = pending.pop()
            yield node
            pending += [c for c in reversed(node.children) if isinstance(c, Node)]

    def all(self, tag: str | None = None, cls: str | None = None, id_: str | None = None, has: str | None = None) -> Iterator[Node]:
        for n in self.walk():
            if n is not self and (not tag or n.tag == tag) and (not cls or cls in n.classes) and (not id_ or n.attributes.get("id") == id_) and (not has or has in n.attributes):
                yield n

    def first(self, **what) -> Node | None:
        return next(self.all(**what), None)

    def text(self) -> str:
        out, pending = [], [self]
        while pending:
            n = pending.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                pending += reversed(n.children)
        return re.sub(r"\s+", " ", "".join(out)).strip()

    def html(self) -> str:
        inner = "".join(c if isinstance(c, str) else c.html() for c in self.children)
        return f"<{self.tag}>{inner}</{self.tag}>"


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        if self.at.tag not in ("script", "style"):
            self.at.children.append(data)


def tree(page: str) -> Node:
    parser = _Tree()
    parser.feed(page)
    parser.close()
    return parser.root


def _text(node: Node | None) -> str | None:
    return (node.text() or None) if node else None


def _meta(root: Node, name: str) -> str | None:
    return next((n.attributes.get("content", "").strip() or None for n in root.all(tag="meta") if name in (n.attributes.get("property"), n.attributes.get("name"))), None)


def project_one(page: str | None) -> dict | None:
    """Fields of a project page; None for no page."""
    if not page:
        return None
    root = tree(page)
    header, left, made, shown = (root.first(id_=x) for x in ("software-header", "app-details-left", "built-with", "submissions"))
    body = "".join(c.html() for c in left.children if isinstance(c, Node) and c.tag == "div" and "id" not in c.attributes) if left else ""
    from ..functions.udfs import html_to_text_one

    prizes, event = [], None
    for k, block in enumerate(shown.all(cls="software-list-content") if shown else []):
        link = next((a for p in block.all(tag="p") for a in p.all(tag="a", has="href")), None) or block.first(tag="a", has="href")
        event = link if k == 0 else event
        prizes += [re.sub(r"^winner\s+", "", li.text(), flags=re.I) for li in block.all(tag="li") if li.first(cls="winner")]
    place = event.attributes["href"] if event else None
    host = urlsplit(place).netloc if place else ""
    likes = next((n.text() for box in root.walk() if "software-likes" in box.classes or box.tag == "a" and "like-button" in box.classes for n in box.all(cls="side-count")), "")
    stamps = sorted(t for t in (n.attributes["datetime"] for n in root.all(tag="time", has="datetime")) if re.match(r"\d{4}-\d{2}-\d{2}", t))
    named = re.search(r"(20\d{2})", f"{place or ''} {event.text() if event else ''}")
    urls = [a.attributes["href"] for ul in root.all(tag="ul") if ul.attributes.get("data-role") == "software-urls" for a in ul.all(tag="a", has="href")]
    members = [n for team in root.all(id_="app-team") for n in team.all(cls="software-team-member")]
    large = next((p for p in header.all(tag="p", cls="large")), None) if header else None
    return {
        "title": _text(root.first(id_="app-title")) or _meta(root, "og:title"), "tagline": _text(large) or _meta(root, "og:description"), "body": html_to_text_one(body) or None,
        "tech": list(dict.fromkeys(t.text().lower() for t in made.all(cls="cp-tag") if t.text())) if made else [], "links": list(dict.fromkeys(urls)), "hackathon": _text(event), "hackathon_url": place,
        "hackathon_id": host.split(".")[0] if host.count(".") == 2 else None, "prizes": prizes, "is_winner": bool(prizes), "team_size": len(members) or None, "likes": int(likes) if likes.isdigit() else None,
        "started": stamps[0][:10] if stamps else None, "year": int(stamps[0][:4]) if stamps else int(named[1]) if named else None,
    }


def gallery_one(page: str | None, base: str | None) -> dict:
    """Entries of a listing page, each address once, and the address of the page that follows."""
    entries, seen, root = [], set(), tree(page or "")
    for item in root.all(cls="gallery-item"):
        link = item.first(tag="a", cls="link-to-software", has="href")
        url = link.attributes["href"].split("?")[0].rstrip("/") if link else ""
        if "/software/" in url and url not in seen:
            seen.add(url)
            entries.append({"url": url, "title": _text(item.first(tag="h5")), "tagline": _text(item.first(tag="p", cls="tagline")), "is_winner": item.first(cls="winner") is not None})
    after = next((a.attributes["href"] for ul in root.all(tag="ul", cls="pagination") for li in ul.all(tag="li", cls="next") if "unavailable" not in li.classes for a in li.all(tag="a", has="href")), None)
    return {"entries": entries, "next_page": urljoin(base or "", after) if after and after != "#" else None}


@F.pandas_udf(StringType())
def _project_json(page: pd.Series) -> pd.Series:
    return page.map(lambda x: json.dumps(project_one(x) or {}))


@F.pandas_udf(StringType())
def _gallery_json(page: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(gallery_one(x, b)) for x, b in zip(page, base, strict=True)], dtype=object)


def project_page(page: Column | str) -> Column:
    """struct PROJECT of each page."""
    return F.from_json(_project_json(page), PROJECT)


def gallery_page(page: Column | str, base: Column | str) -> Column:
    """struct GALLERY of each listing page at its address."""
    return F.from_json(_gallery_json(page, base), GALLERY)
