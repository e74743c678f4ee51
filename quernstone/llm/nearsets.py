"""Near-duplicate records by exact set-similarity join (universe partition and pigeonhole).

A document is the set of its word shingles. Two sets of sizes ``n`` and ``s`` with Jaccard
similarity t or more differ in at most ``H = (1-t)/(1+t) * (n+s)`` tokens. Tokens are hashed into
``m`` segments; the band of the smaller set's size fixes ``m``, and each band gets the kind of
signature that costs least, rows and expected meetings together, for its number of sets and the
frequencies of tokens:

* ``token``: segments as fine as single tokens. By one total order of all tokens, rare ones first,
  the first token two similar sets share is among the first ``n - ceil(t*n) + 1`` of either, and
  the smaller even among its first ``n - ceil(2t/(1+t)*n) + 1``. Such bands need no keys of their own.
* ``exact``: at most H segments differ, so the cheapest segment that is equal in both (by the product
  of its tokens' frequencies, empty ones last, then by hash: a total order both sets share) is
  among the H+1 cheapest of either. Each set emits only those subsets, one signature each.
* ``deletion``: with ``m = (H+1)/2 + z`` segments some segment differs by at most one token, even
  leaving out up to z segments with fewer than two tokens. Each set emits its segments and their
  one-deletion neighbourhoods; exact meets exact or deleted.

The rare set for which ``deletion`` guarantees nothing (too few usable segments) is looked up token
by token against all sets instead, so no pair is lost.

Signatures travel packed: one row holds all of a set's that fall into one bucket of keys, with the
set's parity bitmap, whose Hamming distance never exceeds the number of differing tokens. Sets are
compared by it where they meet, so that chance meetings cost no shuffle. The number of buckets grows
with that of the signatures and of the rows that hold them; buckets with more than ``BUCKET_ROWS`` rows are
split into pairs of blocks that spread over tasks. With many buckets each signature becomes a row, many times
the texts in all, so ranges of buckets are met one after another, as many at a time as ``PASS_BYTES`` allows;
what a range wrote is let go of before the next. What is left is verified on the whole sets.

Sets that are equal are one class and searched once; members are expanded at the very end.
Defined results: null, empty and blank texts and texts with fewer words than a shingle are in no
pair; repeated rows are copies; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.meet import together
from quernstone.llm.repeats import mix
from quernstone.runtime import cut, kept, kept_now, let_go, release, table

WORDS = 3
THRESHOLD = 0.7
SKETCH_BITS = 18  # buckets of the token-frequency sketch, 1 MB
SMALL = 64  # sets up to this size always use their tokens as segments
COPIES_BLOCK = 1000  # members of a class that are paired in one task
BITS_PER_TOKEN = 1.15  # of the parity bitmaps, at least
BUCKET_KEYS = 500_000  # signatures that a bucket holds on average
BUCKET_ROWS = 400_000  # rows of a bucket that meet in one task
LEAST_KEYS = 1000  # signatures that a bucket holds on average, at least
PASS_BYTES = 6.5  # of signatures that lie on disk at a time, for each token of all sets
PASS_LEAST = 1 << 26  # bytes below which signatures are met in one pass
MEETING = 0.02  # cost of a comparison, as a share of a signature's
FILTER_BITS = 1 << 23  # of the filter that keeps texts without candidates from being shuffled, 1 MB
SLICE = 1 << 20  # characters hashed at once

ODD = np.uint64(0x9E6C63D0676A9A99)
_alnum = np.array([chr(c).isalnum() for c in range(0x3000)])
_power = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        _power = np.cumprod(np.append(np.uint64(1), np.full(2 * n, ODD)), dtype=np.uint64)
    return _power


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, runs of letters and digits in lower case, and how many each text has."""
    low = [t.lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in low])
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _alnum[np.minimum(codes, len(_alnum) - 1)]
    for i in np.flatnonzero(codes >= len(_alnum)):
        word[i] = chr(codes[i]).isalnum()
    edge = np.flatnonzero(np.diff(np.concatenate([[0], word.view(np.int8), [0]])))
    start, stop = edge[::2], edge[1::2]
    out = np.empty(len(start), np.uint64)
    size = stop - start
    group = np.cumsum(size) // SLICE
    for g in range(int(group[-1]) + 1 if len(group) else 0):
        a, b = np.searchsorted(group, [g, g + 1])
        if a == b:
            continue
        n = size[a:b]
        first = np.cumsum(n) - n
        rel = np.arange(int(n.sum())) - np.repeat(first, n)
        c = codes[np.repeat(start[a:b], n) + rel].astype(np.uint64)
        out[a:b] = np.add.reduceat(mix(c + np.uint64(0x632BE59BD9B4E019)) * powers(int(n.max()))[rel], first)
    return mix(out), np.bincount(np.searchsorted(ends, start, "right"), minlength=len(texts))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word sequences."""
    with np.errstate(over="ignore"):
        h, sizes = word_hashes([t or "" for t in texts])
        rolled = h.copy()
        for k in range(1, words):
            rolled[: len(h) - k] = mix(rolled[: len(h) - k]) * np.uint64(0x2545F4914F6CDD1D) + h[k:]
        rolled = mix(rolled)
    out, at = [], 0
    for n in sizes.tolist():
        one = np.sort(rolled[at : at + max(n - words + 1, 0)])
        out.append(one[np.append(True, one[1:] != one[:-1])] if len(one) else one)
        at += n
    return out


def bands(threshold: float, upto: int) -> np.ndarray:
    """Top size of each band; from one band to the next sizes grow by 1/threshold."""
    tops = [1]
    while tops[-1] < upto:
        tops.append(max(tops[-1] + 1, int(tops[-1] / threshold)))
    return np.array(tops, np.int64)


@dataclass
class Plan:
    kind: str
    m: int = 0
    z: int = 0


def allowed(threshold: float, total: float) -> int:
    """Most tokens by which two sets of this total size can differ."""
    return int((1 - threshold) / (1 + threshold) * total + 1e-9)


def slack(m_half: int, size: int) -> int:
    """Segments to spare so that fewer than two tokens fall into more of them only in one of a billion sets."""
    z = 2
    while z <= 4 * m_half:
        m = m_half + z
        lam = size / m
        tiny = m * math.exp(-lam) * (1 + lam)
        need = math.ceil(tiny + 6 * math.sqrt(tiny) + 1)
        if z >= need:
            return z
        z = need
    return z


def rarest(sketch: np.ndarray, sets: int, part: float) -> float:
    """Mean share of the sets that hold a token, over the rarest part of all tokens of sets."""
    c = np.sort(sketch[sketch > 0])
    if not len(c):
        return 1.0
    upto = np.searchsorted(np.cumsum(c), part * c.sum()) + 1
    return float(min(1.0, (c[:upto] ** 2).sum() / c[:upto].sum() / max(1, sets)))


def allocate(threshold: float, tops: np.ndarray, counts: dict[int, int], sketch: np.ndarray) -> dict[int, Plan]:
    """The cheapest kind of signature for each band that has sets: signatures, and the meetings they lead to."""
    plans = {}
    everything = sum(counts.values())
    first, half, whole = (rarest(sketch, everything, p) for p in (1 - threshold, 0.5, 1.0))
    for k, top in enumerate(tops.tolist()):
        if top <= SMALL:
            plans[k] = Plan("token")
            continue
        n = int(0.85 * top)
        h = allowed(threshold, top + top / threshold)
        near = max(1, counts.get(k, 0) + counts.get(k + 1, 0))
        options = [((1 - threshold) * n * (1 + MEETING * near * first), Plan("token"))]
        for s in (1.5, 2.5):
            m = math.ceil(s * (h + 1))
            per = n / (m * (1 - math.exp(-n / m)))
            options.append((1.75 * h * (1 + MEETING * near * half**per), Plan("exact", m)))
        pairs = math.ceil((h + 1) / 2)
        z = slack(pairs, int(threshold * top))
        m = pairs + z
        options.append((1.75 * (n + m) * (1 + MEETING * near * whole ** max(1.0, n / m - 1)), Plan("deletion", m, z)))
        plans[k] = min(options, key=lambda o: o[0])[1]
    return plans


def layout(threshold: float, tops: np.ndarray, plans: dict[int, Plan], sizes: list[tuple[int, int]], partitions: int) -> tuple[int, int]:
    """Buckets of keys, and passes over them, for (size, number) of sets.

    Buckets are so many that the rows expected in one are half of those that meet in a task.
    """
    n, sets = (np.array(c, np.float64) for c in zip(*sizes)) if sizes else (np.ones(1), np.zeros(1))
    each = np.empty(len(n))
    for i, size in enumerate(n.tolist()):
        plan = plans[min(int(np.searchsorted(tops, size)), len(tops) - 1)]
        h = allowed(threshold, size + size / threshold)
        each[i] = (1 - threshold) * size + 1 if plan.kind == "token" else 1.75 * (h + 1 if plan.kind == "exact" else size + plan.m)
    every = float(each @ sets)
    buckets = max(partitions, math.ceil(every / BUCKET_KEYS))
    while sets @ -np.expm1(-each / buckets) > BUCKET_ROWS / 2 and buckets * LEAST_KEYS < every:
        buckets = math.ceil(1.1 * buckets)
    # a row as it is written, compressed: its bitmap, about 24 bytes, and less than 10 for each signature
    wide = 8 * 2 ** np.ceil(np.log2(np.maximum(1, BITS_PER_TOKEN * n / 64)))
    rows = -buckets * np.expm1(-each / buckets)
    passes = max(1, math.ceil(float((rows * (wide + 24) + 9.5 * each) @ sets) / max(PASS_LEAST, PASS_BYTES * float(n @ sets))))
    return -(-buckets // passes) * passes, passes


def cost_of(sketch: np.ndarray, toks: np.ndarray) -> np.ndarray:
    """Logarithm of the share of sets that have a token of the same bucket."""
    return sketch[(toks >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]


def bitmaps(sets: list[np.ndarray]) -> list[bytes]:
    """Parities of each set's tokens by hash; widths are powers of two, so that a wide one folds into a narrow one."""
    n = np.array([len(s) for s in sets], np.int64)
    bits = 64 << np.ceil(np.log2(np.maximum(1, BITS_PER_TOKEN * n / 64))).astype(np.int64)
    start = np.cumsum(bits) - bits
    place = np.repeat(start, n) + (mix(np.concatenate(sets) ^ np.uint64(0x5851F42D4C957F2D)) & (np.repeat(bits, n) - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8)).tobytes()
    return [packed[a : a + b] for a, b in zip((start // 8).tolist(), (bits // 8).tolist())]


def first_of(doc: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which rows, sorted by set, are among the first ``most`` of theirs."""
    start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    place = np.arange(len(doc)) - np.repeat(start, np.diff(np.append(start, len(doc))))
    return place < most[doc]


def signatures(sets: list[np.ndarray], threshold: float, tops: np.ndarray, plans: dict[int, Plan], sketch: np.ndarray, ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a batch of sorted sets: index of the set, key and mark of each signature, and the indices of sets whose guarantee failed.

    The mark of a token is its place in the total order; that of a segment is -1, less by 1 in the
    set's own band and less by 2 for a deleted token.
    """
    n = np.array([len(s) for s in sets], np.int64)
    least = np.ceil(threshold * n - 1e-9).astype(np.int64)
    own = np.searchsorted(tops, n)
    low = np.searchsorted(tops, least)
    none = np.zeros(0, np.int64)
    fine = np.array([plans[k].kind == "token" for k in range(len(tops))])
    which = np.flatnonzero(fine[low] | fine[own] | (own - low > 1))
    if len(which):
        size = n[which]
        doc = np.repeat(np.arange(len(which)), size)
        toks = np.concatenate([sets[i] for i in which])
        # by set and cost; a set's tokens are sorted, so of equal cost they stay in the order of their hashes
        order = np.argsort(doc << 32 | cost_of(ranks, toks), kind="stable")
        order = order[first_of(doc[order], size - least[which] + 1)]
        of = doc[order]
        start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        place = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
        yield which[of], mix(toks[order]), np.minimum(place, 32767), none
    for k in range(int(low.min()), int(own.max()) + 1):
        plan, top = plans[k], int(tops[k])
        which = np.flatnonzero((low <= k) & (k <= own))
        if plan.kind == "token" or not len(which):
            continue
        size = n[which]
        doc = np.repeat(np.arange(len(which)), size)
        toks = np.concatenate([sets[i] for i in which])
        mine = (own[which] == k).astype(np.int8)
        h = np.floor((1 - threshold) / (1 + threshold) * (size + np.where(mine == 1, size / threshold, top)) + 1e-9).astype(np.int64)
        seed = np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        cost = cost_of(sketch, toks)
        seg = doc * plan.m + (mix(toks ^ seed) % np.uint64(plan.m)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        sorted_ = seg[order]
        first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
        count = np.diff(np.append(first, len(sorted_)))
        of, place = sorted_[first] // plan.m, (sorted_[first] % plan.m).astype(np.uint64)
        mixed = mix(toks[order] + seed)
        total = np.add.reduceat(mixed, first)
        where = mix(place + seed)
        if plan.kind == "exact":
            content = mix(total ^ where)
            # one total order for all sets: cost to three places, then the hash
            weight = np.round(np.add.reduceat(cost[order].astype(np.float64), first), 3)
            rank = np.lexsort((content, weight, of))
            rank = rank[first_of(of[rank], h + 1)]
            docs_, keys = of[rank], content[rank]
            short = np.flatnonzero(np.bincount(of, minlength=len(which)) < h + 1)
            for i in short:  # empty segments come last
                held = place[of == i]
                empty = np.sort(mix(np.setdiff1d(np.arange(plan.m), held.astype(np.int64)).astype(np.uint64) + seed))[: int(h[i]) + 1 - len(held)]
                docs_, keys = np.append(docs_, np.full(len(empty), i)), np.append(keys, mix(empty))
            yield which[docs_], keys, -1 - mine[docs_], none
        else:
            failed = plan.m - np.bincount(of[count >= 2], minlength=len(which)) > plan.z
            each = np.repeat(np.arange(len(first)), count)
            many = count[each] >= 2
            docs_ = np.append(of, of[each][many])
            keys = np.append(mix(total ^ where), mix((total[each] - mixed)[many] ^ where[each][many]))
            flags = mine[docs_] | np.append(np.zeros(len(of), np.int8), np.full(int(many.sum()), 2, np.int8))
            yield which[docs_], keys, -1 - flags, which[failed]


def binaries(data: np.ndarray, first: np.ndarray) -> pa.Array:
    """Slices of an array, from each of ``first`` to the next, as binary values."""
    ends = np.append(first, len(data)).astype(np.int64) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def survey(docs: DataFrame, words: int) -> DataFrame:
    """Per row (id, cls, n) with the hash of its set, and per task (b, c): how many sets hold a token of each bucket."""
    size = 1 << SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                sets = shingle_sets(batch.column(1).to_pylist(), words)
                i = [j for j, s in enumerate(sets) if len(s)]
                if not i:
                    continue
                total += np.bincount((np.concatenate([sets[j] for j in i]) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
                none = pa.nulls(len(i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i, pa.int64())), pa.array([class_of(sets[j]) for j in i], pa.int64()), pa.array([len(sets[j]) for j in i], pa.int32()), none.cast(pa.int32()), none.cast(pa.int64())], names=["id", "cls", "n", "b", "c"])
        some = np.flatnonzero(total)
        for k in range(0, len(some), 100_000):
            part = some[k : k + 100_000]
            none = pa.nulls(len(part))
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), pa.array(part.astype(np.int32)), pa.array(total[part])], names=["id", "cls", "n", "b", "c"])

    return docs.mapInArrow(run, "id long, cls long, n int, b int, c long")


def similar_classes(docs: DataFrame, seen: DataFrame, words: int, threshold: float) -> DataFrame:
    """(a, b) with a < b: classes of (id, text) rows, ids being unique, whose sets' Jaccard similarity reaches the threshold."""
    spark = docs.sparkSession
    rows = seen.where("b is not null").groupBy("b").agg(F.sum("c").alias("c")).toPandas()
    sketch = np.zeros(1 << SKETCH_BITS, np.float64)
    sketch[rows["b"].to_numpy(np.int64)] = rows["c"].to_numpy(np.float64)
    by = seen.where("id is not null").groupBy(F.pow(2.0, F.round(F.log2("n") * 8) / 8).cast("long").alias("size")).agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"), F.max("n").alias("most")).collect()
    tops = bands(threshold, max((r.most for r in by), default=1))
    counts: dict[int, int] = {}
    for r in by:
        k = min(int(np.searchsorted(tops, r["size"])), len(tops) - 1)
        counts[k] = counts.get(k, 0) + r.sets
    everything = max(1, sum(counts.values()))
    plans = allocate(threshold, tops, counts, sketch)
    buckets, passes = layout(threshold, tops, plans, [(r.tokens // r.sets, r.sets) for r in by], int(spark.conf.get("spark.sql.shuffle.partitions")))
    span = buckets // passes
    sent = spark.sparkContext.broadcast((tops, plans, np.log(np.clip(sketch / everything, 1e-12, 1)).astype(np.float32)))

    def emit(batches: Iterator[pa.RecordBatch], only: int) -> Iterator[pa.RecordBatch]:
        """Signatures of a pass over the buckets; of pass -1, the sets whose guarantee failed."""
        tops_, plans_, logs_ = sent.value
        ranks = np.unique(logs_, return_inverse=True)[1].astype(np.int64)
        done: set[int] = set()  # copies within a task's rows are sent once
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                sets, ids = [], []
                for i, s in zip(whole.column(0).slice(k, 256).to_pylist(), shingle_sets(whole.column(1).slice(k, 256).to_pylist(), words)):
                    if len(s) and (c := class_of(s)) not in done:
                        done.add(c)
                        sets.append(s)
                        ids.append(i)
                if not sets:
                    continue
                cls, n = np.array(ids, np.int64), np.array([len(s) for s in sets], np.int32)
                maps = pa.array(bitmaps(sets), pa.binary())
                with np.errstate(over="ignore"):
                    for doc, key, flag, failed in signatures(sets, threshold, tops_, plans_, logs_, ranks):
                        if only < 0:
                            if len(failed):
                                yield pa.RecordBatch.from_arrays([pa.array(cls[failed])], names=["id"])
                            continue
                        bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                        if passes > 1:
                            now = np.flatnonzero(bucket // span == only)
                            doc, key, flag, bucket = doc[now], key[now], flag[now], bucket[now] - only * span
                        at = doc * span + bucket
                        order = np.argsort(at, kind="stable")
                        at, key, flag = at[order], key[order], flag[order]
                        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
                        own = at[first] // span
                        yield pa.RecordBatch.from_arrays([pa.array(at[first] % span), pa.array(cls[own]), pa.array(n[own]), maps.take(pa.array(own)), binaries(key, first), binaries(flag.astype(np.int16), first)], names=NAMES)

    parts = []
    for k in range(passes):
        held = kept_now()
        sigs = docs.mapInArrow(partial(emit, only=k), SIGNATURES)
        parts.append(cut(together(sigs, "id", meetings(threshold), pa.schema([("a", pa.int64()), ("b", pa.int64())]), "a long, b long", BUCKET_ROWS, span).distinct()))
        del sigs
        release(held)
        let_go(spark)
    if any(p.kind == "deletion" for p in plans.values()):
        hard = docs.mapInArrow(partial(emit, only=-1), "id long")
        parts.append(token_lookup(docs, hard.distinct(), words, threshold))
    pairs = reduce(DataFrame.unionByName, parts)
    # rows to classes: copies that different tasks sent are one again
    cls = seen.where("id is not null").select("id", "cls")
    pairs = pairs.distinct().join(cls.select(F.col("id").alias("a"), F.col("cls").alias("x")), "a").join(cls.select(F.col("id").alias("b"), F.col("cls").alias("y")), "b")
    first = pairs.where("x <> y").select(F.when(F.col("x") < F.col("y"), F.struct("x", "y", "a", "b")).otherwise(F.struct(F.col("y").alias("x"), F.col("x").alias("y"), F.col("b").alias("a"), F.col("a").alias("b"))).alias("p")).select("p.*")
    pairs = cut(first.groupBy("x", "y").agg(F.min(F.struct("a", "b")).alias("p")).select("x", "y", "p.a", "p.b"))
    # whole texts travel only for candidates
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(bit.alias("bit"))
    place = F.col("bit") + 1  # positions of these functions begin at 1
    maps = ids.groupBy(F.bitmap_bucket_number(place).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("map")).collect()
    near = np.zeros(FILTER_BITS, bool)
    for r in maps:
        bits = np.unpackbits(np.frombuffer(bytes(r.map), np.uint8), bitorder="little")
        near[(int(r.n) - 1) * len(bits) + np.flatnonzero(bits)] = True
    flags = spark.sparkContext.broadcast(np.packbits(near))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(flags.value)
        for batch in batches:
            yield batch.filter(pa.array(known[batch.column(2).to_numpy()] > 0)).select([0, 1])

    texts = docs.select("id", "text", bit.alias("bit")).mapInArrow(some, "id long, text string")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("t")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                x, y = (shingle_sets(batch.column(c).to_pylist(), words) for c in (2, 3))
                good = []
                for i, (s, t) in enumerate(zip(x, y)):
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    if common / (len(s) + len(t) - common) >= threshold:
                        good.append(i)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in (0, 1)], names=["a", "b"])

    return both.select(F.col("x").alias("a"), F.col("y").alias("b"), "s", "t").mapInArrow(verify, "a long, b long")


NAMES = ["key", "id", "n", "bits", "keys", "flags"]
SIGNATURES = "key long, id long, n int, bits binary, keys binary, flags binary"


def matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a binary column, and where each value starts and ends."""
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(col.buffers()[2] or b"", np.uint8), ends[:-1], ends[1:]


class Maps:
    """Bitmaps of rows, wide ones folded to the width they are compared at."""

    def __init__(self, col: pa.Array):
        data, start, stop = matrix(col)
        self.width = stop - start
        self.own = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.own[w] = at, data[start[at][:, None] + np.arange(w)].view(np.uint64)
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of each row, and the rows' bitmaps at this width."""
        if w not in self.at:
            place, parts, held = np.zeros(len(self.width), np.int64), [], 0
            for own, (at, bits) in self.own.items():
                if own >= w:
                    folded = bits
                    while folded.shape[1] * 8 > w:
                        half = folded.shape[1] // 2
                        folded = folded[:, :half] ^ folded[:, half:]
                    place[at] = held + np.arange(len(at))
                    parts.append(folded)
                    held += len(at)
            self.at[w] = place, np.concatenate(parts)
        return self.at[w]

    def far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hamming distances of rows a and b."""
        out = np.empty(len(a), np.int64)
        width = np.minimum(self.width[a], self.width[b])
        for w in np.unique(width).tolist():
            i = np.flatnonzero(width == w)
            place, bits = self.of(w)
            out[i] = np.bitwise_count(bits[place[a[i]]] ^ bits[place[b[i]]]).sum(axis=1, dtype=np.int64)
        return out


def meetings(threshold: float):
    """Pairs of sets that share a key and may be similar: by size, kind of signature and bitmap."""
    share = (1 - threshold) / (1 + threshold)

    def settle(rows: pa.RecordBatch, first: np.ndarray, last: np.ndarray) -> list[pa.RecordBatch]:
        ids, n = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        maps = Maps(rows.column(3))
        keys, start, stop = matrix(rows.column(4))
        marks = matrix(rows.column(5))[0].view(np.int16)
        found: list[np.ndarray] = []

        def compare(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
            """Of rows a and b, that met by signatures of marks x and y, the pairs that may be similar."""
            s, t = n[a], n[b]
            small, large = np.minimum(s, t), np.maximum(s, t)
            # enough tokens follow the first that both have
            need = threshold / (1 + threshold) * (s + t) - 1e-9
            token = (x >= 0) & (s - x >= need) & (t - y >= need)
            f, g = -1 - x, -1 - y
            segment = (x < 0) & ((f | g) & 1 == 1) & (f & g & 2 == 0)
            ok = np.flatnonzero((small >= large * threshold - 1e-9) & (token | segment) & (ids[a] != ids[b]))
            a, b = a[ok], b[ok]
            near = maps.far(a, b) <= (share * (n[a] + n[b]) + 1e-9).astype(np.int64)
            i, j = ids[a[near]], ids[b[near]]
            found.append(np.stack([np.minimum(i, j), np.maximum(i, j)]))

        for f, e in zip(first.tolist(), last.tolist()):
            key = keys[start[f] : stop[e - 1]].view(np.uint64)
            mark = marks[start[f] // 8 : stop[e - 1] // 8].astype(np.int32)
            row = np.repeat(np.arange(f, e, dtype=np.int32), (stop[f:e] - start[f:e]) // 8)
            order = np.argsort(key, kind="stable")
            key, mark, row = key[order], mark[order], row[order]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])).astype(np.int32)  # a bucket has far fewer signatures than 2^31
            size = np.diff(np.append(begin, np.int32(len(key))))
            # all pairs of many small groups at once, in portions; a large one in blocks
            some = (size > 1) & (size <= 512)
            begins, sizes = begin[some], size[some]
            portion = np.cumsum(sizes.astype(np.int64) * (sizes - 1) // 2) // 500_000
            for p in np.unique(portion):
                g, z = begins[portion == p], sizes[portion == p]
                at = np.repeat(g - (np.cumsum(z, dtype=np.int32) - z), z) + np.arange(int(z.sum()), dtype=np.int32)
                later = np.repeat(g + z, z) - at - 1
                i = np.repeat(at, later)
                j = np.repeat(at + 1 - (np.cumsum(later, dtype=np.int32) - later), later) + np.arange(len(i), dtype=np.int32)
                compare(row[i], row[j], mark[i], mark[j])
            for g, z in zip(begin[size > 512].tolist(), size[size > 512].tolist()):
                for i in range(g, g + z, 512):
                    for j in range(i, g + z, 512):
                        x, y = np.meshgrid(np.arange(i, min(i + 512, g + z)), np.arange(j, min(j + 512, g + z)), indexing="ij")
                        pick = x < y
                        x, y = x[pick], y[pick]
                        compare(row[x], row[y], mark[x], mark[y])
        if not found:
            return []
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return [pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])]

    return settle


def token_lookup(docs: DataFrame, hard: DataFrame, words: int, threshold: float) -> DataFrame:
    """Candidates of the few sets whose signatures guarantee nothing: any set that has one of their first tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                sets = [(i, s) for i, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), words)) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in sets], pa.int64()), pa.array([s.view(np.int64) for _, s in sets], pa.list_(pa.int64()))], names=["id", "toks"])

    sets = docs.mapInArrow(run, "id long, toks array<long>")
    few = sets.join(hard, "id", "left_semi").dropDuplicates(["id"])
    need = F.size("toks") - F.ceil(F.size("toks") * threshold - 1e-9) + 1
    probes = few.select(F.col("id").alias("i"), F.explode(F.slice("toks", F.lit(1), need.cast("int"))).alias("tok"))
    return probes.join(sets.select(F.col("id").alias("j"), F.explode("toks").alias("tok")), "tok").where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def copies(members: DataFrame) -> DataFrame:
    """All pairs (a, b) within classes, in blocks, so that a class of any size is spread over tasks."""
    size = members.groupBy("rep").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / COPIES_BLOCK).cast("int")
    m = members.join(size, "rep").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = m.select("rep", "block", F.col("id").alias("a"))
    right = m.select("rep", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("b"))
    return left.join(right, ["rep", "block"]).where("a < b").select("a", "b")


def near_duplicates(docs: DataFrame, key: str, text: str, words: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes, and the membership (id, rep) of every row that has a set."""
    small = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)
    seen = kept(survey(small, words))
    return similar_classes(small, seen, words, threshold), seen.where("id is not null").select("id", F.col("cls").alias("rep"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found: every pair of similar rows, copies included."""
    links, members = near_duplicates(table(spark, sf_dir, "docs"), "ord", "markdown", WORDS, THRESHOLD)
    left = members.select(F.col("id").alias("i"), F.col("rep").alias("a"))
    right = members.select(F.col("id").alias("j"), F.col("rep").alias("b"))
    across = links.join(left, "a").join(right, "b").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    return across.unionByName(copies(members)).select(F.col("a").cast("int").alias("ord_a"), F.col("b").cast("int").alias("ord_b"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_groups: (id, rep, links) of every row of ``documents``: five words, similarity 0.8; links to other texts' classes."""
    links, members = near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", 5, 0.8)
    n = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    first = members.groupBy("rep").agg(F.min("id").alias("first"))
    return members.join(first, "rep").join(n, "rep", "left").select("id", F.col("first").alias("rep"), F.coalesce("links", F.lit(0)).alias("links"))
