"""Links, reachability, components, and near-duplicate pages by MinHash."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import text as T
from quernstone.functions import url as U
from quernstone.operators.crawl import SOURCE_RANK, robots_allowed
from quernstone.runtime import cut, kept, narrowed

PERMUTATIONS, BANDS = 128, 16


def page_links(pages: DataFrame, base: str | None = None) -> DataFrame:
    """(src, dst) internal links of pages (url, html), each once."""
    root = F.lit(base) if base else F.concat(U.scheme(F.col("url")), F.lit("://"), U.host(F.col("url")), F.lit("/"))
    links = pages.where(F.col("html").isNotNull()).select("url", root.alias("root"), F.explode(F.array_distinct(T.hrefs(F.col("html")))).alias("href"))
    links = links.where(U.followable(F.col("href"))).select("url", "root", U.normalize(U.resolve(F.col("root"), F.col("href"))).alias("dst"))
    return links.where(U.is_internal(F.col("dst"), F.col("root"))).select(F.col("url").alias("src"), "dst").distinct()


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int = 4, limit: int | None = None, rules: list[tuple[str, bool]] | None = None) -> DataFrame:
    """(url, depth) by breadth-first search; one shuffle a level, lineage cut each time.

    Only what robots rules allow is visited. With a limit the search ends with the level that reaches
    it, and of that level the first urls in order stay: each task keeps no more than are missing.
    """
    allowed = (lambda df: robots_allowed(df, rules)) if rules else (lambda df: df)
    front = cut(allowed(seeds.select("url").distinct()).withColumn("depth", F.lit(0)))
    seen, count = None, 0
    for depth in range(1, max_depth + 2):
        n = front.count()
        if limit is not None and count + n >= limit:
            front = front.orderBy("url").limit(limit - count)
            n = 0
        seen, count = front if seen is None else cut(seen.unionByName(front)), count + n
        if not n or depth > max_depth:
            break
        new = allowed(front.join(edges, front["url"] == edges["src"]).select(F.col("dst").alias("url")).distinct())
        front = cut(new.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
    return seen


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, component) of undirected edges (a, b): smallest id of each component.

    Large-star and small-star steps: edges are pulled towards the smallest neighbour until nothing
    changes, in a number of rounds that grows with the logarithm of the component's size. No
    component is ever gathered in one task. It is an error if that isn't reached within ``rounds``.
    """
    e = cut(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        # large star: every larger neighbour is tied to the smallest of the neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("low").alias("a"), "b").where("a <> b").distinct()
        # small star: every smaller neighbour, and the node itself
        down = large.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("m"))
        least = down.groupBy("n").agg(F.min("m").alias("low"))
        small = down.join(least, "n").select(F.col("low").alias("a"), F.explode(F.array("n", "m")).alias("b")).where("a <> b").distinct()
        small = cut(small)
        same = small.count() == e.count() and small.join(e, ["a", "b"], "left_anti").isEmpty()
        e = small
        if same:
            break
    else:
        raise RuntimeError(f"components aren't settled after {rounds} rounds")
    tops = e.select(F.col("a").alias("id")).distinct().join(e.select(F.col("b").alias("id")), "id", "left_anti").select("id", F.col("id").alias("component"))
    return e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")).unionByName(tops)


def _grams(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's set of three words in a row."""
    w = re.findall(r"\w+", (text or "").lower())
    grams = {" ".join(g) for g in zip(w, w[1:], w[2:])} if len(w) >= 3 else set(w)
    return np.sort(np.frombuffer(b"".join(hashlib.blake2b(g.encode(), digest_size=8).digest() for g in grams), "<u8"))


def minhash_pairs(docs: DataFrame, key: str, text: str, threshold: float, bands: int = BANDS, permutations: int = PERMUTATIONS) -> DataFrame:
    """(a, b) of documents whose shingle sets have at least this Jaccard similarity, of those that share a band.

    A pair of similarity s shares a band with probability 1 - (1 - s^8)^16: 0.994 at 0.85, 0.9999 at 0.9.

    Equal sets are one class, linked by a star, so that copies make no quadratic buckets; each
    candidate is verified on the whole sets. Sets are made again for the candidates alone, so what is kept of
    every document is its bands; sizes of arrays are guessed too low before they are there, so no join of sets may broadcast.
    """
    kind = docs.schema[key].dataType.simpleString()
    a, b = np.random.default_rng(5).integers(1, 1 << 63, (2, permutations), dtype=np.uint64)
    a |= np.uint64(1)
    per = permutations // bands
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, keys, classes = [], [], [], []
            for i, text_ in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = _grams(text_.as_py())
                if not len(h):
                    continue
                with np.errstate(over="ignore"):
                    sig = np.full(permutations, np.iinfo(np.uint64).max, np.uint64)
                    for k in range(0, len(h), 512):
                        x = h[k : k + 512, None] * a + b
                        sig = np.minimum(sig, (x ^ (x >> np.uint64(29))).min(axis=0))
                ids.append(i)
                sizes.append(len(h))
                classes.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                keys.append(np.frombuffer(b"".join(hashlib.blake2b(bytes([n]) + sig[n * per : (n + 1) * per].tobytes(), digest_size=8).digest() for n in range(bands)), "<i8"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(sizes, pa.int32()), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "h", "bands"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_grams(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    signed = kept(texts.mapInArrow(sign, f"id {kind}, n int, h binary, bands array<long>"))
    signed.count()  # at once, else each of its readers makes the texts' hashes
    member = signed.select("id", "h").join(signed.groupBy("h").agg(F.min("id").alias("rep")).hint("merge"), "h").select("id", "rep")
    keys = signed.join(signed.groupBy("h").agg(F.min("id").alias("id")).hint("merge"), ["h", "id"]).select("id", "n", F.explode("bands").alias("band"))
    x, y = keys.alias("x"), keys.alias("y").hint("merge")
    # a set that is smaller than the threshold's share of the other can't be as similar
    close = (F.col("x.id") < F.col("y.id")) & (F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n"))
    pairs = cut(x.join(y, "band").where(close).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
    sets = kept(narrowed(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id").mapInArrow(gather, f"id {kind}, s array<long>"))
    sets.count()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")).hint("merge"), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    near = both.where(inter / (F.size("sa") + F.size("sb") - inter) >= threshold).select("a", "b")
    return near.unionByName(member.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))


def near_duplicate_groups(docs: DataFrame, key: str = "ord", text: str = "markdown", threshold: float = 0.85) -> DataFrame:
    """(id, component) of documents with at least one near-duplicate."""
    return components(minhash_pairs(docs, key, text, threshold))


def group_listing(groups: DataFrame, names: DataFrame, key: str = "ord", name: str = "url") -> DataFrame:
    """(component, size, nth, members): groups from the largest on, ties by their first member; members in order."""
    g = groups.join(names.select(F.col(key).alias("id"), name), "id").groupBy("component").agg(F.array_sort(F.collect_set(name)).alias("members")).where(F.size("members") > 1)
    w = Window.orderBy(F.desc("size"), "members")  # one row a group
    return g.withColumn("size", F.size("members")).withColumn("nth", F.row_number().over(w)).select("component", "size", "nth", "members")


def collapse(docs: DataFrame, groups: DataFrame, key: str = "ord") -> DataFrame:
    """One document of each group: best source, then priority, then url."""
    rank = F.lit(99)
    for name, r in SOURCE_RANK.items():
        rank = F.when(F.col("source") == name, r).otherwise(rank)
    d = docs.join(groups.withColumnRenamed("id", key), key, "left").withColumn("__g", F.coalesce(F.col("component"), F.col(key)))
    w = Window.partitionBy("__g").orderBy(rank, F.desc(F.coalesce(F.nullif(F.col("priority"), F.lit(0.0)), F.lit(0.5))), "url", key)
    return d.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__g", "component")
