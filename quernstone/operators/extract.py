"""Title, main text as Markdown, and question and answer pairs out of HTML, and documents out of pages.

A page is read once by the standard library's parser into a small tree; everything is looked up in
it. The main text is that of the main element (main, article, an id or class that says so, else the
body) without scripts, navigation and boxes whose class or id names boilerplate.

Defined results: null and blank pages give an empty title, no text and no pairs; what isn't closed
ends with its parent; a page is processed whole, whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions import url as U
from quernstone.operators import crawl, graph
from quernstone.runtime import cut

# What elements' classes and ids say about them.
BOILERPLATE = re.compile(r"(nav|menu|footer|footer-widget|header|cookie|consent|banner|sidebar|breadcrumb|widget|modal|overlay|popup|social|share)", re.IGNORECASE)
FAQ_BOX = re.compile(r"(faq|accordion|qa-item|q-and-a)", re.IGNORECASE)
FAQ_QUESTION = re.compile(r"(question|title|heading|toggle|trigger)", re.IGNORECASE)
FAQ_ANSWER = re.compile(r"(answer|content|body|panel|collapse)", re.IGNORECASE)
DROPPED = frozenset(("script", "style", "nav", "footer", "header", "noscript", "aside"))
MAIN_ID, MAIN_CLASS = re.compile(r"(main|content)", re.IGNORECASE), re.compile(r"(main|content|post)", re.IGNORECASE)
HEADINGS = {f"h{n}": "#" * n + " " for n in range(1, 7)}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: an opening tag closes an open element of the first set, as far as the nearest of the second
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
PAIR = "struct<question:string,answer:string>"


class Element:
    __slots__ = ("tag", "names", "id", "children", "parent")

    def __init__(self, tag: str, names: list[str], id_: str, parent: Element | None):
        self.tag, self.names, self.id, self.parent = tag, names, id_, parent
        self.children: list[Element | str] = []

    def each(self) -> Iterator[Element]:
        """All elements inside, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            e = todo.pop()
            yield e
            todo += [c for c in reversed(e.children) if isinstance(c, Element)]

    def first(self, fits) -> Element | None:
        return next((e for e in self.each() if fits(e)), None)

    def text(self) -> str:
        """Pieces of text, trimmed, with one blank between."""
        out: list[str] = []
        todo: list[Element | str] = [self]
        while todo:
            c = todo.pop()
            if isinstance(c, Element):
                todo += reversed(c.children)
            elif c.strip():
                out.append(c.strip())
        return " ".join(out)


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", [], "", None)

    def updatepos(self, i: int, j: int) -> int:
        return j

    def leave(self, e: Element) -> None:
        self.at = e.parent or self.root

    def up(self, tags: set[str] | frozenset[str], stops: set[str]) -> Element | None:
        e: Element | None = self.at
        while e is not None and e.tag not in tags:
            if e.tag in stops:
                return None
            e = e.parent
        return e

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES and (e := self.up(*CLOSES[tag])) is not None:
            self.leave(e)
        elif tag in ENDS_P and (e := self.up({"p"}, {"li", "td", "dd", "blockquote", "div", "section", "article", "body"})) is not None:
            self.leave(e)
        a = dict(attrs)
        e = Element(tag, (a.get("class") or "").split(), a.get("id") or "", self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.leave(self.at)

    def handle_endtag(self, tag: str) -> None:
        if (e := self.up({tag}, set())) is not None:
            self.leave(e)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(page: str) -> Element:
    t = Tree()
    try:
        t.feed(page)
        t.close()
    except (AssertionError, ValueError):  # hopeless markup: what was read counts
        pass
    return t.root


def says(e: Element, what: re.Pattern) -> bool:
    """A class, or all of them together, match."""
    return any(what.search(n) for n in e.names)


def title_of(root: Element) -> str:
    """<title> without its last part after a bar or dash, else the first <h1>."""
    t = root.first(lambda e: e.tag == "title")
    raw = " ".join("".join(c for c in t.children if isinstance(c, str)).split()) if t is not None else ""
    if raw:
        return re.sub(r"\s*[|\-–—]\s*[^|\-–—]+$", "", raw).strip() or raw
    h = root.first(lambda e: e.tag == "h1" and bool(e.text()))
    return " ".join(h.text().split()) if h is not None else ""


def main_text(root: Element) -> str:
    """Headings, paragraphs and list items of the main element as Markdown; changes the tree."""
    for e in list(root.each()):
        if e.parent is not None and (e.tag in DROPPED or (e.tag not in ("html", "body") and (says(e, BOILERPLATE) or BOILERPLATE.search(e.id)))):
            e.parent.children = [c for c in e.parent.children if c is not e]
    home = next((h for fits in (lambda e: e.tag == "main", lambda e: e.tag == "article", lambda e: bool(MAIN_ID.search(e.id)), lambda e: says(e, MAIN_CLASS), lambda e: e.tag == "body") if (h := root.first(fits)) is not None), root)
    out = []
    for e in home.each():
        if e.tag in HEADINGS or e.tag in ("p", "li"):
            if text := e.text():
                out.append(HEADINGS.get(e.tag, "- " if e.tag == "li" else "") + text)
    return "\n\n".join(out)


def clean(text: str) -> str:
    return " ".join(text.split())


def details(root: Element) -> Iterator[tuple[str, str]]:
    for box in root.each():
        if box.tag == "details" and (s := box.first(lambda e: e.tag == "summary")) is not None:
            q, whole = clean(s.text()), clean(box.text())
            if q:
                yield q, (whole[len(q) :] if whole.startswith(q) else whole.replace(q, "", 1)).strip()


def boxes(root: Element) -> Iterator[tuple[str, str]]:
    for box in root.each():
        if says(box, FAQ_BOX):
            q = box.first(lambda e: says(e, FAQ_QUESTION)) or box.first(lambda e: e.tag in ("h3", "h4", "dt"))
            a = box.first(lambda e: says(e, FAQ_ANSWER)) or box.first(lambda e: e.tag in ("dd", "p"))
            if q is not None and a is not None and q is not a:
                yield clean(q.text()), clean(a.text())


def definitions(root: Element) -> Iterator[tuple[str, str]]:
    """A term and the next definition, both right in their list."""
    for box in root.each():
        if box.tag == "dl":
            term = ""
            for c in box.children:
                if isinstance(c, Element) and c.tag == "dt":
                    term = clean(c.text())
                elif isinstance(c, Element) and c.tag == "dd":
                    yield term, clean(c.text())
                    term = ""


def pairs_of(root: Element) -> list[tuple[str, str]]:
    """Questions with answers, each question once: disclosure boxes first, then boxes by class, then definition lists."""
    out: dict[str, str] = {}
    for found in (details, boxes, definitions):
        for q, a in found(root):
            if q and a:
                out.setdefault(q, a)
    return list(out.items())


def extract(page: str | None) -> tuple[str, str, list[tuple[str, str]]]:
    """(title, markdown, pairs)"""
    if page is None or not page.strip():
        return "", "", []
    root = tree(page)
    title, pairs = title_of(root), pairs_of(root)
    return title, main_text(root).strip(), pairs


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with title, markdown, faq_pairs and method in place of the HTML, map only."""
    keep = [f for f in pages.schema if f.name not in (html, "title", "markdown", "faq_pairs", "method")]
    pair = pa.list_(pa.struct([("question", pa.string()), ("answer", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                rows = [extract(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
                faq = pa.array([[{"question": q, "answer": a} for q, a in r[2]] for r in rows], pair)
                method = pa.array(["fallback" if r[1] else "none" for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), faq, method], names=[*batch.schema.names[:-1], "title", "markdown", "faq_pairs", "method"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"title string, markdown string, faq_pairs array<{PAIR}>, method string"])
    return pages.select(*(f"`{f.name}`" for f in keep), html).mapInArrow(run, ddl)


def pairs_once(pairs: DataFrame, page: str, collector: str, place: str) -> DataFrame:
    """The first pair of a question on a page, by collector and place; empty questions and answers don't count."""
    good = pairs.where((F.length(F.trim("question")) > 0) & (F.length(F.trim("answer")) > 0))
    first = F.min(F.struct(collector, place, "answer")).alias("f")
    return good.groupBy(page, "question").agg(first).select(page, "question", "f.answer", f"f.{collector}", f"f.{place}")


def documents(pages: DataFrame) -> DataFrame:
    """Documents of extracted pages (url, final_url, title, markdown, faq_pairs, source, lastmod, priority); pages without text give none."""
    url = U.canonical(F.col("final_url"))
    m = F.col("markdown")
    return pages.where(T.has_content(m)).select(
        url.alias("url"), F.col("url").alias("original_url"), "title", "markdown", U.page_type(url).alias("page_type"), T.content_hash(m).alias("content_hash"), F.coalesce("source", F.lit("sitemap")).alias("source"), "lastmod", "priority", "faq_pairs"
    )


def normalized(docs: DataFrame, extra: DataFrame | None = None, collapse: bool = True, threshold: float = 0.85) -> DataFrame:
    """Documents once by url, and once by near-duplicate group; extra: ready documents that take part."""
    every = docs if extra is None else docs.unionByName(extra.select(docs.columns))
    # url and hash give a total order, so that a rerun chooses the same rows
    keyed = every.withColumn("ord", F.xxhash64("url", "original_url", "content_hash", "source"))
    once = crawl.dedupe_docs(keyed)
    if not collapse:
        return once.drop("ord")
    once = cut(once)  # pages are read once
    groups = graph.near_duplicate_groups(once, "ord", "markdown", threshold)
    return graph.collapse(once, groups).drop("ord")
