"""Lines that one site repeats across its documents.

Content-defined chunking: over the lower-case letters of a document a rolling (gear) hash of the
last 16 letters decides where a chunk ends, so the same passage gives the same chunks wherever it
stands, whatever marks, blanks and digits are around it. A line end ends a chunk too: the cases
are defined on lines, and with that the chunks of a line never depend on its neighbours.

1. Count, per site, the distinct URLs of each chunk; keep those that reach the threshold.
2. A line can only be repeated if all its chunks are. Only such lines go on.
3. An exact count of distinct URLs per candidate line (64-bit hash of its letters) settles it.

Pre-aggregation makes (site, chunk, url) distinct before it counts, so a hot site or a hot line
is spread over its URLs. The repeated chunks of a site number at most (chunks per page) / share,
so their set grows with the number of sites, not with documents; its size is checked all the same.

Defined results: null or empty markdown has no lines, but its URL counts for the site; rows without
a host belong to no site; repeated rows count once by URL and all their places come out; an empty
table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.runtime import cut, kept, table

WINDOW = 16  # letters the rolling hash sees
MASK = np.uint64((1 << 5) - 1)  # a cut every 32 letters on average
MIN_URLS, MIN_SHARE, MIN_LETTERS = 5, 0.25, 3
BROADCAST_KEYS = 2_000_000  # 16 MB of hashes; beyond, the second pass joins instead

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is of Unicode category L; there is none beyond plane 3."""
    global _letters
    if _letters is None:
        _letters = np.zeros(sys.maxunicode + 1, bool)
        _letters[: 1 << 18] = [chr(c).isalpha() for c in range(1 << 18)]
    return _letters


def chunk_lines(texts: list[str], chunks: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks and lines of a batch of texts.

    Returns doc, line number, number of letters and hash of each line that has letters, and for
    each chunk the index of its line (into those arrays) and its hash; with chunks false, those of
    the lines only.
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 1 for t in low])
    keep = letters()[codes] | (codes == 10)
    doc_start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # line index over the batch, and of each document's first line
    is_nl = codes == 10
    before = np.concatenate([[0], np.cumsum(is_nl)])
    first_line = before[doc_start]
    c = codes[keep]
    nl = c == 10
    c = np.append(c, 10)
    nl = np.append(nl, True)
    gear = mix(c.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    gear[nl] = 0
    roll = gear.copy() if chunks else gear
    step = 1 if chunks else WINDOW
    while step < WINDOW:
        moved = np.zeros_like(roll)
        moved[step:] = roll[:-step] << np.uint64(step)
        roll = roll + moved
        step *= 2
    line = np.concatenate([[0], np.cumsum(nl)[:-1]])
    # a cut after this letter; the hash of a line's first letters mustn't reach into the line before
    start_of_line = np.concatenate([[0], np.flatnonzero(nl)[:-1] + 1])
    if chunks:
        place = np.arange(len(c)) - start_of_line[line]
        ends = (((roll >> np.uint64(40)) & MASK) == 0) & (place >= WINDOW - 1) & ~nl
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(c), BASE, np.uint64))
        back = np.cumprod(np.full(len(c), INVERSE, np.uint64))
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(gear * powers, dtype=np.uint64)])

        def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return mix((prefix[b] - prefix[a]) * back[a] + (b - a).astype(np.uint64))

        stop = np.flatnonzero(nl)
        a, b = start_of_line, stop
        some = b > a
        which = np.cumsum(some) - 1
        lines = np.flatnonzero(some)
        doc = np.searchsorted(first_line, lines, "right") - 1
        line_hash = hashed(a[some], b[some])
        if not chunks:
            return doc, lines - first_line[doc], (b - a)[some], line_hash, lines[:0], line_hash[:0]
        cut_after = np.flatnonzero(ends | nl)
        cb = np.where(nl[cut_after], cut_after, cut_after + 1)
        ca = np.concatenate([[0], np.where(nl[cut_after], cut_after + 1, cut_after + 1)[:-1]])
        real = cb > ca
        ca, cb = ca[real], cb[real]
        chunk_hash = hashed(ca, cb)
    return doc, lines - first_line[doc], (b - a)[some], line_hash, which[line[ca]], chunk_hash


def pieces(batch: pa.RecordBatch, size: int = 256) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, size):
        yield batch.slice(k, size)


def source_docs(docs: DataFrame) -> DataFrame:
    """(__ord, __site, __url, __text): host and URL as hashes; rows without host are left out."""
    host = F.regexp_extract(F.lower(F.col("url")), r"^[a-z][a-z0-9+.-]*://([^/?#]+)", 1)
    return docs.where(host != "").select(F.col("ord").alias("__ord"), F.xxhash64(host).alias("__site"), F.xxhash64(F.col("url")).alias("__url"), F.col("markdown").alias("__text"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, url, chunk), each chunk once a document."""
    for whole in batches:
        for batch in pieces(whole):
            site, url = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            doc, _, n, _, of, chunk = chunk_lines(batch.column(3).to_pylist())
            good = n[of] >= MIN_LETTERS
            pair = np.unique(np.stack([doc[of[good]].astype(np.uint64), chunk[good]]), axis=1) if good.any() else np.zeros((2, 0), np.uint64)
            d = pair[0].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(site[d]), pa.array(url[d]), pa.array(pair[1].astype(np.int64))], names=["site", "url", "chunk"])


def _lines(hot, chunks: bool = True):
    """(ord, line_no, site, url, line, chunks); with ``hot``, only lines all of whose chunks are in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = hot.value if hot is not None else None
        for whole in batches:
            for batch in pieces(whole):
                ord_, site, url = (batch.column(i).to_numpy() for i in range(3))
                doc, no, n, line, of, chunk = chunk_lines(batch.column(3).to_pylist(), chunks)
                keep = n >= MIN_LETTERS
                if table_ is not None:
                    key = mix(site[doc[of]].astype(np.uint64) ^ chunk)
                    at = np.minimum(np.searchsorted(table_, key), max(len(table_) - 1, 0))
                    missed = table_[at] != key if len(table_) else np.ones(len(key), bool)
                    keep = keep & (np.bincount(of, missed, len(n)) == 0)
                i = np.flatnonzero(keep)
                d = doc[i]
                cols = [pa.array(ord_[d]), pa.array(no[i].astype(np.int32)), pa.array(site[d]), pa.array(url[d]), pa.array(line[i].astype(np.int64))]
                if table_ is None and chunks:
                    bounds = np.searchsorted(of, np.arange(len(n) + 1))
                    cols.append(pa.array([chunk[bounds[k] : bounds[k + 1]].astype(np.int64) for k in i], pa.list_(pa.int64())))
                else:
                    cols.append(pa.array([[]] * len(i), pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["ord", "line_no", "site", "url", "line", "chunks"])

    return run


def repeated(pairs: DataFrame, sites: DataFrame, item: str, min_urls: int, min_share: float) -> DataFrame:
    """(site, item) found under enough different URLs of the site."""
    counts = pairs.select("site", item, "url").distinct().groupBy("site", item).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_urls).join(sites, "site").where(F.col("n") >= F.col("urls") * min_share).select("site", item)


def repeated_lines(docs: DataFrame, min_urls: int = MIN_URLS, min_share: float = MIN_SHARE) -> DataFrame:
    """(ord, line_no) of every line its site repeats."""
    src = source_docs(docs)
    kind = docs.schema["ord"].dataType.simpleString()
    sites = kept(src.select(F.col("__site").alias("site"), "__url").distinct().groupBy("site").agg(F.count("*").alias("urls")))
    full = src.where(F.length("__text") > 0)
    hot = cut(repeated(full.mapInArrow(_chunks, "site long, url long, chunk long"), sites, "chunk", min_urls, min_share))
    schema = f"ord {kind}, line_no int, site long, url long, line long, chunks array<long>"
    if hot.count() <= BROADCAST_KEYS:
        keys = hot.toPandas()
        with np.errstate(over="ignore"):
            known = np.sort(mix(keys["site"].to_numpy(np.int64).astype(np.uint64) ^ keys["chunk"].to_numpy(np.int64).astype(np.uint64)))
        maybe = full.mapInArrow(_lines(docs.sparkSession.sparkContext.broadcast(known)), schema)
    else:
        every = full.mapInArrow(_lines(None), schema).withColumn("n", F.size("chunks")).withColumn("chunk", F.explode("chunks"))
        maybe = every.join(hot, ["site", "chunk"]).groupBy("ord", "line_no", "site", "url", "line", "n").agg(F.count("*").alias("hits")).where("hits = n")
    maybe = kept(maybe.select("ord", "line_no", "site", "url", "line"))
    return maybe.join(repeated(maybe, sites, "line", min_urls, min_share), ["site", "line"]).select("ord", "line_no").distinct()


def without_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``docs`` with those lines taken out of the markdown; all other columns stay."""
    drop = lines.groupBy(F.col("ord").alias("__ord")).agg(F.collect_list("line_no").alias("__drop"))
    cleaned = F.array_join(F.filter(F.split("markdown", "\n"), lambda x, i: ~F.array_contains(F.col("__drop"), i)), "\n")
    return docs.join(drop, docs["ord"] == drop["__ord"], "left").withColumn("markdown", F.when(F.col("__drop").isNull(), F.col("markdown")).otherwise(cleaned)).drop("__ord", "__drop")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "docs"))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_clean: each document without its site's repeated lines."""
    docs = table(spark, sf_dir, "docs")
    return without_lines(docs, repeated_lines(docs)).select("ord", "url", "markdown")


LINES_SQL = r"""
lines AS (
  SELECT ord, url, host, CAST(i - 1 AS INT) AS line_no, regexp_replace(lower(parts[i]), '[^\p{L}]', '', 'g') AS k
  FROM (SELECT ord, url, regexp_extract(lower(url), '^[a-z]+://([^/?#]+)', 1) AS host, string_split(markdown, chr(10)) AS parts,
               unnest(generate_series(1, len(string_split(markdown, chr(10))))) AS i FROM docs WHERE markdown IS NOT NULL)),
sites AS (SELECT regexp_extract(lower(url), '^[a-z]+://([^/?#]+)', 1) AS host, count(DISTINCT url) AS urls FROM docs WHERE url IS NOT NULL GROUP BY 1),
hot AS (SELECT l.host, k FROM lines l JOIN sites s ON s.host = l.host WHERE length(k) >= 3 GROUP BY l.host, k, s.urls
        HAVING count(DISTINCT url) >= 5 AND count(DISTINCT url) >= 0.25 * s.urls)
"""
FOUND_SQL = f"WITH {LINES_SQL} SELECT DISTINCT ord, line_no FROM lines JOIN hot USING (host, k)"
CLEAN_SQL = rf"""WITH {LINES_SQL},
bad AS (SELECT DISTINCT ord, line_no FROM lines JOIN hot USING (host, k)),
raw AS (SELECT ord, unnest(string_split(markdown, chr(10))) AS line, unnest(generate_series(0, len(string_split(markdown, chr(10))) - 1)) AS no FROM docs WHERE markdown IS NOT NULL),
kept AS (SELECT r.ord, string_agg(r.line, chr(10) ORDER BY r.no) AS md FROM raw r LEFT JOIN bad b ON b.ord = r.ord AND b.line_no = r.no WHERE b.ord IS NULL GROUP BY r.ord)
SELECT d.ord, d.url, CASE WHEN d.markdown IS NULL THEN NULL ELSE coalesce(k.md, '') END AS markdown FROM docs d LEFT JOIN kept k ON k.ord = d.ord"""
