"""The page's own article, out of HTML or of markdown made from pages.

HTML goes through the standard library's streaming parser into blocks: runs of text between
block-level tags. Each block is one line with a text-to-tag ratio; the ratios are smoothed with a
Gaussian and split in two by clustering (2-means on their logarithms), and the dense lines vote,
with their unlinked text, for the sectioning element they lie in. The winner is the article's
element: its own blocks from its first heading of level 1 on, without what interrupts it (elements
nested in it that hold asides, comments, promotion; lists of bare labels) are the article.

Markdown has no elements, so its lines are judged by ratio of text to marks, by position (nothing
before the title), by the form of their block (lists of bare titles), by a lexicon of the words
such lines are made of, and by how many articles of the site repeat them (lines and counts as in
``repeats``, at a lower share). Pages of one title are one article, and so are near-duplicates under
other titles: MinHash of their chunks, candidates that share a band, an estimated Jaccard similarity
of at least ``ALIKE``, connected components. Headings and code are never judged by repetition.

Defined results: null, empty or blank input has no blocks; broken markup closes where HTML closes
it implicitly; blocks come once per head; extra columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import repeats
from quernstone.operators.graph import components
from quernstone.runtime import cut, kept, table

HEAD = 40
SIGMA = 1.0
REPEATED_SHARE, REPEATED_ARTICLES = 0.01, 5
#: two pages of J = 0.6 share a band with probability 0.96, of J = 0.7 with 0.998, of J = 0.05 with 0.00015
ALIKE, SIGNATURE_BANDS, BAND_ROWS = 0.45, 24, 4

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html iframe legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript head title svg canvas iframe object select textarea button option".split())
HEADINGS = {f"h{i}": i for i in range(1, 7)}
SECTIONS = frozenset("body div section main article td aside nav footer header form dialog center fieldset".split())
ASIDE = frozenset("nav footer aside dialog form".split())
#: an opening tag ends an open element of these, up to the next element of the second set
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

LABELS = re.compile(
    r"(?i)\b(?:cookies?|unsubscribe|newsletter|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos|"
    r"accept all|read next|related (?:posts|articles|pages)|skip to content|you are here|"
    r"reply to|wrote \d+ (?:minutes?|hours?|days?|weeks?|months?) ago|min(?:utes?)? read|"
    r"share this|copy link|send by mail|pass it on|partager|teile diesen|comparte|follow us|shared \d+ times|"
    r"written by|reviewed by|last reviewed|senior editor|terms of use|privacy policy|impressum|mentions légales|aviso legal|"
    r"read more|weiterlesen|lire la suite|leer más|schlagwörter|mots-clés|etiquetas)\b|^(?:tags?|subscribe|topics?)\s*:|©|\(c\) \d{4}"
)
BYLINE = re.compile(r"(?i)^(?:by|par|von|por|text|written by|autor|author|auteur)\b[:\s].{0,80}\d")
DATED = re.compile(r"\d{4}-\d\d?-\d\d?|\d\d?[./]\d\d?[./]\d{4}")


class Node:
    __slots__ = ("tag", "parent", "aside", "blocky")

    def __init__(self, tag: str, parent: Node | None, aside: bool):
        self.tag, self.parent, self.aside, self.blocky = tag, parent, aside, False


class Block:
    __slots__ = ("text", "tags", "linked", "leaf", "home", "list", "heading")

    def __init__(self, text: str, tags: int, linked: int, leaf: str, home: Node, of: Node | None, heading: int):
        self.text, self.tags, self.linked, self.leaf, self.home, self.list, self.heading = text, tags, linked, leaf, home, of, heading


class Reader(HTMLParser):
    """Blocks of a page in reading order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack = [Node("body", None, False)]
        self.text: list[str] = []
        self.tags = self.linked = self.links = self.silent = 0

    def updatepos(self, i: int, j: int) -> int:
        """Places in the source aren't asked for."""
        return j

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            node, of = self.stack[-1], None
            leaf = node.tag
            while node.parent is not None and (node.tag not in SECTIONS or (node.tag == "td" and not node.blocky)):
                if node.tag in ("ul", "ol", "menu") and of is None:
                    of = node
                node = node.parent
            level = next((HEADINGS[n.tag] for n in reversed(self.stack) if n.tag in HEADINGS), 0)
            self.blocks.append(Block(text, self.tags, self.linked, leaf, node, of, level))
        self.text, self.tags, self.linked = [], 0, 0

    def close_to(self, place: int) -> None:
        for n in self.stack[place:]:
            if n.tag == "a":
                self.links -= 1
        del self.stack[place:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            if tag != "head" and tag not in VOID:
                self.flush() if tag in BLOCKS else None
                self.silent += 1
                self.stack.append(Node(tag, self.stack[-1], True))
            return
        if self.silent:
            return
        self.tags += 1
        if tag in ("html", "body"):
            return
        if tag in BLOCKS:
            self.flush()
            self.tags += 1
            for i in range(len(self.stack) - 1, 0, -1):  # a paragraph ends where a block begins
                if self.stack[i].tag == "p":
                    self.close_to(i)
                    break
                if self.stack[i].tag in SECTIONS or self.stack[i].tag in ("li", "blockquote", "td", "dd"):
                    break
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self.close_to(len(self.stack) - 1)
            if tag in IMPLIED:
                ends, stops = IMPLIED[tag]
                for i in range(len(self.stack) - 1, 0, -1):
                    if self.stack[i].tag in stops:
                        break
                    if self.stack[i].tag in ends:
                        self.close_to(i)
                        break
            for n in reversed(self.stack):
                if n.tag == "td" and tag in ("p", "div", "ul", "ol", "h1", "h2", "h3", "section", "article", "table"):
                    n.blocky = True
                if n.tag in ("td", "body"):
                    break
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        role = dict(attrs).get("role") or ""
        aside = self.stack[-1].aside or tag in ASIDE or role in ("dialog", "navigation", "banner", "contentinfo", "complementary", "alertdialog", "search")
        self.stack.append(Node(tag, self.stack[-1], aside))
        if tag == "a":
            self.links += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if not self.silent and tag not in SILENT:
            self.tags += 1
            if tag in BLOCKS:
                self.flush()
            elif tag == "br":
                self.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].tag == tag), None)
        if tag in SILENT:
            if at is not None:
                self.close_to(at)
                self.silent = sum(n.tag in SILENT for n in self.stack)
            return
        if self.silent:
            return
        if tag in BLOCKS:
            self.flush()
        if at is not None and (tag in BLOCKS or not any(n.tag in SECTIONS for n in self.stack[at:])):
            self.close_to(at)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)
            if self.links > 0:
                self.linked += len(data.strip())

    def read(self, page: str) -> list[Block]:
        try:
            self.feed(page)
            self.close()
        except (AssertionError, ValueError):  # hopeless markup: keep what was read
            pass
        self.flush()
        return self.blocks


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the ends are weighted by what is there."""
    r = int(np.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(ratio, k)[r : r + len(ratio)] / np.convolve(np.ones(len(ratio)), k)[r : r + len(ratio)]


def dense(ratio: np.ndarray) -> np.ndarray:
    """Which lines belong to the denser of two clusters of smoothed ratios."""
    if len(ratio) < 3:
        return np.ones(len(ratio), bool)
    x = np.log1p(smoothed(ratio))
    # 2-means on a line ends at a cut of the sorted values
    y = np.sort(x)
    sums, split = np.concatenate([[0.0], np.cumsum(y)]), (y[0] + y[-1]) / 2
    for _ in range(20):
        k = int(np.searchsorted(y, split))
        if k in (0, len(y)):
            break
        new = (sums[k] / k + (sums[-1] - sums[k]) / (len(y) - k)) / 2
        if new == split:
            break
        split = new
    return x >= split


def bare(text: str) -> bool:
    """A label or a title rather than a sentence."""
    return not ENDED.search(text.rstrip("*_ ")[-12:])


def article_of_html(page: str | None) -> list[str]:
    """Texts of the article's blocks, in reading order."""
    if not page or not page.strip():
        return []
    blocks = Reader().read(page)
    if not blocks:
        return []
    ratio = np.array([max(0, len(b.text) - b.linked) / max(1, b.tags) for b in blocks])
    good = dense(ratio)
    votes: dict[Node, float] = defaultdict(float)
    for b, g in zip(blocks, good):
        if not b.home.aside:
            votes[b.home] += (max(0, len(b.text) - b.linked) if g else 0) + (200 if b.heading == 1 else 0)
    if not votes:
        return []
    home = max(votes, key=lambda n: votes[n])
    own = [b for b in blocks if b.home is home]
    top = next((i for i, b in enumerate(own) if b.heading == 1), None)
    lists: dict[Node, list[Block]] = defaultdict(list)
    for b in own:
        if b.list is not None:
            lists[b.list].append(b)
    labels = {n for n, items in lists.items() if all((bare(i.text) and len(i.text.split()) <= 3) or i.linked >= len(i.text) * 0.8 for i in items)}
    return [
        b.text
        for i, b in enumerate(own)
        if (top is None or i >= top) and b.list not in labels and not (b.heading == 0 and b.leaf == home.tag and b.linked > len(b.text) / 2) and not (b.heading == 0 and bare(b.text) and len(b.text) < 120 and (LABELS.search(b.text) or BYLINE.match(b.text)))
    ]


TITLE, HEADING, LETTER = re.compile(r"\s*#\s+\S"), re.compile(r"\s*#{1,6}\s"), re.compile(r"[^\W\d_]")
ENDED = re.compile(r"[.!?:;…。！？।؟][\"'”’»)\]]*$")
MARKS = re.compile(r"[\[\]()|*_`>#~]")
PLAIN = re.compile(r"^[\s>*_~]+|[\s*_~]+$")
TRAIL = re.compile(r"[←→»›]|(?:\S+ · ){2}")
LINK = re.compile(r"!?\[[^\]]*\]\([^)]*\)")
ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")


def mark_ratio(line: str) -> float:
    links = LINK.findall(line) if "](" in line else []
    rest = LINK.sub("", line) if links else line
    return len(rest) / (1 + 8 * len(links) + len(MARKS.findall(rest)))


def article_of_markdown(text: str | None, repeated: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """The article's lines, marks kept. repeated: numbers of lines that the site repeats."""
    if not text or not text.strip():
        return []
    lines = text.split("\n")
    title = next((i for i, line in enumerate(lines) if "#" in line and TITLE.match(line)), None)
    letters = [LETTER.search(line) for line in lines]
    # lists of bare titles
    drop: set[int] = set()
    i = 0
    while i < len(lines):
        if not ITEM.match(lines[i]):
            i += 1
            continue
        j = i
        while j < len(lines) and ITEM.match(lines[j]):
            j += 1
        short = [bare(x.strip()) for x in lines[i:j]]
        k = i
        while k < j:  # a list may follow another without a blank line
            e = k
            while e < j and short[e - i]:
                e += 1
            if e - k >= 2 or (e > k and e - k == j - i):
                drop |= set(range(k, e))
            k = max(e, k + 1)
        i = j
    ratio = np.array([mark_ratio(line) for line in lines])
    thin = ~dense(ratio) & (ratio < 12)
    out, code = [], False
    for n, line in enumerate(lines):
        s = PLAIN.sub("", line.strip())
        if line.strip().startswith("```"):
            code = not code
            if len(line.strip()) == 3:
                continue
        if not letters[n] or n in drop or (title is not None and n < title):
            continue
        heading, row = "#" in line and HEADING.match(line), line.lstrip().startswith("|")
        if code or heading:
            out.append(line)
            continue
        if n in repeated:
            continue
        links = LINK.findall(s) if "](" in s else []
        if links and len(LINK.sub("", s).strip(" |·•/,»>-")) < sum(map(len, links)) / 3:
            continue
        short = len(s) < 160
        if (short or s[0] == "←") and TRAIL.search(s) and (bare(s) or s[0] == "←"):
            continue
        if not row and (short or " wrote " in s or "ookie" in s) and LABELS.search(s):
            continue
        if not row and len(s) < 120 and BYLINE.match(s):
            continue
        if not row and len(s) < 100 and DATED.search(s) and bare(s):
            continue
        if thin[n] and links:
            continue
        out.append(line)
    return out


def head(text: str) -> str:
    return " ".join(text.split())[:HEAD]  # collapsed and trimmed first, then cut


def _html(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            ids, heads = [], []
            for i, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for h in dict.fromkeys(head(t) for t in article_of_html(page)):
                    ids.append(i)
                    heads.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(heads, pa.string())], names=["rec_id", "block_head"])


def _markdown(hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value if hot is not None else None
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(2).to_pylist()
                gone: list[set[int]] = [set(x or ()) for x in part.column(3).to_pylist()]
                if known is not None and len(known):
                    doc, no, n, line, _, _ = repeats.chunk_lines([t or "" for t in texts], chunks=False)
                    key = repeats.mix(part.column(1).fill_null(0).to_numpy()[doc].astype(np.uint64) ^ line)
                    hit = (known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key) & (n >= repeats.MIN_LETTERS)
                    for d, i in zip(doc[hit].tolist(), no[hit].tolist()):
                        gone[d].add(i)
                ids, heads = [], []
                for i, t, g in zip(part.column(0).to_pylist(), texts, gone):
                    for h in dict.fromkeys(head(x) for x in article_of_markdown(t, g)):
                        ids.append(i)
                        heads.append(h)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(heads, pa.string())], names=["rec_id", "block_head"])

    return run


def html_articles(pages: DataFrame, key: str = "fetch_id", html: str = "html") -> DataFrame:
    """(rec_id, block_head): map only."""
    return pages.where(F.length(html) > 0).select(F.col(key).cast("long"), html).mapInArrow(_html, "rec_id long, block_head string")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, page, sig, bands, lines) of rows (site, page, text): MinHash of the chunks, two bytes a place, and the lines' hashes, each once."""
    size = SIGNATURE_BANDS * BAND_ROWS
    seeds = np.random.default_rng(11).integers(1, 1 << 63, size, dtype=np.uint64) | np.uint64(1)
    for whole in batches:
        for batch in repeats.pieces(whole):
            site, page = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            doc, _, n, line, of, chunk = repeats.chunk_lines(batch.column(2).to_pylist())
            good = n[of] >= repeats.MIN_LETTERS
            d, chunk = doc[of[good]], chunk[good]
            some, first = np.unique(d, return_index=True)
            if not len(some):
                continue
            sig = np.empty((len(some), size), np.uint64)
            with np.errstate(over="ignore"):
                for j in range(size):
                    x = chunk * seeds[j]
                    sig[:, j] = np.minimum.reduceat(x ^ (x >> np.uint64(31)), first)
                key = np.zeros((len(some), SIGNATURE_BANDS), np.uint64)
                for r in range(BAND_ROWS):
                    key = repeats.mix(key ^ sig[:, r::BAND_ROWS])
                key = repeats.mix(key ^ site[some].astype(np.uint64)[:, None] ^ np.arange(1, SIGNATURE_BANDS + 1, dtype=np.uint64))
            short = repeats.mix(sig).astype(np.uint16)
            keep = n >= repeats.MIN_LETTERS
            pair = np.unique(np.stack([doc[keep].astype(np.uint64), line[keep]]), axis=1)
            ends = pa.array(np.append(np.searchsorted(pair[0], some.astype(np.uint64)), pair.shape[1]).astype(np.int32))
            lines = pa.ListArray.from_arrays(ends, pa.array(pair[1].view(np.int64)))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * SIGNATURE_BANDS), pa.array(key.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(site[some]), pa.array(page[some]), pa.array([r.tobytes() for r in short], pa.binary()), bands, lines], names=["site", "page", "sig", "bands", "lines"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            good = pa.array((x == y).mean(axis=1) >= ALIKE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])


def signed(pages: DataFrame) -> DataFrame:
    """One row for each page (__site, __url, __text) that has lines: its signature and its lines."""
    return pages.select("__site", "__url", "__text").mapInArrow(_signatures, "site long, page long, sig binary, bands array<long>, lines array<long>").withColumn("id", F.xxhash64("site", "sig"))


def same_articles(rows: DataFrame) -> DataFrame:
    """(url, article) of the pages whose text is almost that of another page of the site."""
    bands = rows.select("id", F.explode("bands").alias("band")).distinct()
    heads = bands.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("band", "a")
    near = bands.join(heads, "band").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    sigs = rows.groupBy("id").agg(F.first("sig").alias("sig"))
    both = near.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
    links = cut(both.select("a", "b", "x", "y").mapInArrow(_alike, "a long, b long"))
    # pages by their title and signatures by their hash are nodes of one graph
    of = rows.select("id", F.col("page").alias("url")).distinct()
    linked = links.select(F.explode(F.array("a", "b")).alias("id")).unionByName(of.groupBy("id").count().where("count > 1").select("id")).distinct()
    of = cut(of.join(linked, "id", "left_semi"))
    named = components(links.unionByName(of.select(F.col("id").alias("a"), F.col("url").alias("b"))))
    return of.select("url").distinct().join(named.select(F.col("id").alias("url"), F.col("component").alias("article")), "url")


def repeated_by_articles(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, line) in enough articles of the site; what too few titles have isn't looked at again."""
    pairs = rows.select("site", F.col("page").alias("url"), F.explode("lines").alias("line"))
    maybe = cut(repeats.repeated(pairs, sites, "line", REPEATED_ARTICLES, REPEATED_SHARE))
    by = pairs.join(maybe, ["site", "line"], "left_semi").join(same_articles(rows), "url", "left")
    return repeats.repeated(by.select("site", "line", F.coalesce("article", "url").alias("url")), sites, "line", REPEATED_ARTICLES, REPEATED_SHARE)


def markdown_articles(docs: DataFrame) -> DataFrame:
    """(rec_id, block_head) of the documents' own lines."""
    spark = docs.sparkSession
    src = repeats.source_docs(docs)
    sites = kept(src.select(F.col("__site").alias("site"), "__url").distinct().groupBy("site").agg(F.count("*").alias("urls")))
    # the title without the site's name counts, not the URL
    name = F.regexp_replace(F.regexp_replace(F.lower("title"), r"\s[|\u2013\u2014-]\s.*$", ""), r"[^\p{L}]", "")
    host = F.regexp_extract(F.lower(F.col("url")), r"^[a-z][a-z0-9+.-]*://([^/?#]+)", 1)
    titled = docs.where(host != "").select(F.col("ord").alias("__ord"), F.xxhash64(host).alias("__site"), F.xxhash64(host, F.coalesce(F.when(name != "", name), "url")).alias("__url"), F.col("markdown").alias("__text")).where(F.length("__text") > 0)
    pages = kept(signed(titled))
    pages.count()  # made once: what reads it runs at the same time
    hot = cut(repeated_by_articles(pages, sites))
    rows = docs.where(F.length("markdown") > 0).select(F.col("ord").cast("long").alias("rec_id"), F.xxhash64(host).alias("site"), "markdown")
    if hot.count() <= repeats.BROADCAST_KEYS:
        keys = hot.toPandas()
        with np.errstate(over="ignore"):
            known = np.sort(repeats.mix(keys["site"].to_numpy(np.int64).astype(np.uint64) ^ keys["line"].to_numpy(np.int64).astype(np.uint64)))
        sent, rows = spark.sparkContext.broadcast(known), rows.withColumn("gone", F.array().cast("array<int>"))
    else:
        lines = titled.mapInArrow(repeats._lines(None, chunks=False), "ord int, line_no int, site long, url long, line long, chunks array<long>")
        gone = lines.join(hot, ["site", "line"]).groupBy(F.col("ord").cast("long").alias("rec_id")).agg(F.collect_set("line_no").alias("gone"))
        sent, rows = None, rows.join(gone, "rec_id", "left")
    return rows.mapInArrow(_markdown(sent), "rec_id long, block_head string")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "fetches").where("status_code = 200 and html is not null")
    a = html_articles(pages).select(F.lit("fetches").alias("source_table"), "rec_id", "block_head")
    return a.unionByName(markdown_articles(table(spark, sf_dir, "docs")).select(F.lit("docs").alias("source_table"), "rec_id", "block_head"))
