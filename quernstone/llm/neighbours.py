"""Most similar vectors for every vector, by cross-polytope hashing.

A unit vector is turned by fast pseudo-rotations (three rounds of random signs and a Hadamard
transform) and hashed to the signed axis it is nearest to; a table's key joins as many such axes as
the collection's size asks for.
Multiprobe: a query also looks under the keys its next-best axes give, in order of how little is
lost. Candidates are ranked again by exact cosine.

* A vector is stored once in each table and probes ``PROBES`` keys of it, so a pair that falls on
  either side of one border still meets. Equal vectors are one class, searched once.
* Table rows carry the vector in 8 bits a number; groups are compared by blocked matrix products
  where they meet, and only what may be among a vector's best k leaves, with a margin for rounding.
  Hot keys are split into pairs of blocks over several tasks (``meet``), so no group is capped.
* What is left is ranked by the exact cosine.

Vectors are left out if null, of another length, with NaN or infinity, or zero. Ties go to the
smaller id. The collection's rows count once per id; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.llm.meet import together
from quernstone.runtime import cut, kept, table

TABLES = 5
PROBES = 2  # keys of a table each vector looks under
PER_KEY = 8  # vectors that share a key, on average; the number of hashes follows the collection's size
MARGIN = 0.02  # more than rounding to 8 bits changes a cosine
SEED = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two long), orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(np.float32(d))


def rotated(x: np.ndarray, which: int) -> np.ndarray:
    """One of the pseudo-rotations; zeros fill up to a power of two."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    if d != x.shape[1]:
        x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    signs = np.random.default_rng([SEED, which]).choice(np.array([-1, 1], np.float32), (3, d))
    for s in signs:
        x = hadamard(x * s)
    return x


def probes(x: np.ndarray, which: int, shape: list[int], count: int) -> np.ndarray:
    """(rows, count) keys of one table, best first: the first is the vector's own."""
    hashes = len(shape)
    axes, losses = [], []
    for h in range(hashes):
        d = shape[h]
        near = min(3, d)
        y = rotated(x, which * hashes + h)[:, :d]
        size = np.abs(y)
        top = np.argpartition(-size, near - 1, axis=1)[:, :near] if near < d else np.tile(np.arange(d), (len(x), 1))
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable"), 1)
        best = np.take_along_axis(size, top, 1)
        axes.append(top + d * (np.take_along_axis(y, top, 1) < 0))
        losses.append((best[:, :1] - best) ** 2)
    combos = list(itertools.product(*(range(a.shape[1]) for a in axes)))
    place = np.cumprod([1, *(2 * d for d in shape)])
    keys = np.stack([sum(axes[h][:, c[h]].astype(np.int64) * int(place[h]) for h in range(hashes)) for c in combos], 1)
    loss = np.stack([sum(losses[h][:, c[h]] for h in range(hashes)) for c in combos], 1)
    order = np.argsort(loss, axis=1, kind="stable")[:, :count]
    return np.take_along_axis(keys, order, 1) + which * np.int64(place[-1])


def unit_vectors(rows: DataFrame, dims: int) -> DataFrame:
    """(id, vector binary) of the usable vectors, at length 1, as float32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            size = col.value_lengths().to_numpy(zero_copy_only=False)
            right = np.flatnonzero(np.nan_to_num(size) == dims)
            if not len(right):
                continue
            part = col.take(pa.array(right))
            x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            norm = np.sqrt((x * x).sum(1))
            ok = np.isfinite(norm) & (norm > 0)
            # to 6 places, so that copies at another length become equal
            x = np.round(x[ok] / norm[ok, None], 6).astype(np.float32) + np.float32(0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(right[ok])), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "vec"])

    return rows.mapInArrow(run, "id string, vec binary")


def _matrix(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1)


def _hash_rows(shape: list[int], tables: int, count: int):
    """Rows (key, own, rep, scale, short) of each table: the vector's own key and the next-best ones it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                x = _matrix(batch.column(1))
                scale = np.abs(x).max(1) / np.float32(127)
                short = pa.array([r.tobytes() for r in np.rint(x / scale[:, None]).astype(np.int8)], pa.binary())
                for t in range(tables):
                    keys = probes(x, t, shape, count)
                    n = keys.shape[1]
                    at = pa.array(np.repeat(np.arange(len(x)), n))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.reshape(-1)), pa.array(np.tile(np.arange(n) == 0, len(x))), batch.column(0).take(at), pa.array(scale).take(at), short.take(at)], names=["key", "own", "rep", "scale", "short"]
                    )

    return run


def _best(k: int, least: float):
    """Of the vectors stored under a key, those that may be among each probing vector's k best."""

    def group(reps: np.ndarray, own: np.ndarray, x: np.ndarray):
        stored = np.flatnonzero(own)
        if not len(stored):
            return
        s, names = x[stored], reps[stored]
        for i in range(0, len(x), 1024):
            sim = x[i : i + 1024] @ s.T
            sim[reps[i : i + 1024, None] == names[None]] = -2
            floor = np.full(len(sim), least - MARGIN, np.float32)
            if sim.shape[1] > k:
                floor = np.maximum(floor, -np.partition(-sim, k - 1, axis=1)[:, k - 1] - 2 * MARGIN)
            r, c = np.nonzero(sim >= floor[:, None])
            if len(r):
                yield reps[i + r], names[c]

    def settle(rows: pa.RecordBatch, first: np.ndarray, last: np.ndarray) -> list[pa.RecordBatch]:
        own, reps, scale = (rows.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        raw = rows.column(4).to_pylist()
        x = np.frombuffer(b"".join(raw), np.int8).reshape(len(raw), -1).astype(np.float32) * scale[:, None]
        out = [f for a, b in zip(first, last) for f in group(reps[a:b], own[a:b], x[a:b])]
        if not out:
            return []
        a, b = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return [pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])]

    return settle


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = _matrix(batch.column(2)).astype(np.float64), _matrix(batch.column(3)).astype(np.float64)
        sim = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], names=["a", "b", "sim"])


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return pairs.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def table_shape(n: int, dims: int) -> list[int]:
    """Axes of each hash of a table, so that about ``PER_KEY`` of n vectors share a key: whole cross-polytopes, and a last one over fewer axes."""
    d = 1 << max(0, (dims - 1).bit_length())
    want, shape = max(2.0, n / PER_KEY), []
    while want > 1:
        axes = d
        while axes > 1 and 2 * axes >= 2 * want:
            axes //= 2
        shape.append(axes)
        want /= 2 * axes
    return shape


def nearest_classes(reps: DataFrame, n: int, k: int, least: float, dims: int, tables: int = TABLES, count: int = PROBES) -> DataFrame:
    """(a, b, sim, nth): the k nearest classes b of each class a, of those at least ``least`` similar."""
    shape = table_shape(n, dims)
    rows = reps.mapInArrow(_hash_rows(shape, tables, count), "key long, own boolean, rep long, scale float, short binary")
    heads = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    pairs = kept(together(rows, "rep", _best(k, least), heads, "a long, b long").distinct())
    some = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    used = reps.join(some, "rep", "left_semi")
    both = pairs.join(used.select(F.col("rep").alias("a"), F.col("vec").alias("x")), "a").join(used.select(F.col("rep").alias("b"), F.col("vec").alias("y")), "b")
    exact = both.select("a", "b", "x", "y").mapInArrow(_exact, "a long, b long, sim double").where(F.col("sim") >= least)
    return top_k(exact.unionByName(exact.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")), k)


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector): one vector per chunk, that of chunks or else that of its hits."""
    own = table(spark, sf_dir, "chunks").where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.max(F.col("vector")).alias("vector"))
    lost = own.where(F.col("vector").isNull()).select("chunk_id")
    from_hits = table(spark, sf_dir, "hits").where(F.col("vector").isNotNull()).select("chunk_id", "vector").join(lost, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.max("vector").alias("vector"))
    return own.where(F.col("vector").isNotNull()).unionByName(from_hits).select(F.col("chunk_id").alias("id"), "vector")


def similar_pairs(rows: DataFrame, k: int, least: float, dims: int = 64) -> DataFrame:
    """(chunk_a, chunk_b) in which one is among the other's k most similar and the cosine is at least ``least``."""
    vectors = kept(unit_vectors(rows, dims).withColumn("rep", F.xxhash64("vec")))
    classes = cut(vectors.groupBy("rep").agg(F.first("vec").alias("vec")))
    members = vectors.select("id", "rep")
    links = nearest_classes(classes.select("rep", "vec"), classes.count(), k, least, dims)
    # a class's own copies come before any other class; of a class only its k smallest ids can be among the k nearest of others
    w = Window.partitionBy("rep").orderBy("id")
    first = members.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k + 1).select("rep", "id", "nth")
    inside = members.alias("m").join(first.alias("f"), F.col("m.rep") == F.col("f.rep")).where("m.id <> f.id").select(F.col("m.id").alias("a"), F.col("f.id").alias("b"), F.lit(1.0).alias("sim"))
    outside = (
        links.select("a", "b", "sim")
        .join(members.select(F.col("rep").alias("a"), F.col("id").alias("i")), "a")
        .join(first.where(F.col("nth") <= k).select(F.col("rep").alias("b"), F.col("id").alias("j")), "b")
        .select(F.col("i").alias("a"), F.col("j").alias("b"), "sim")
    )
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    best = inside.unionByName(outside).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)
    return best.select(F.least("a", "b").alias("chunk_a"), F.greatest("a", "b").alias("chunk_b")).distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(collection(spark, sf_dir), 5, 0.9)
