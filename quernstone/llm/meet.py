"""Rows of one key meet in one task, in bounded memory.

The caller shuffles rows by key and sorts within partitions; :func:`by_group` then hands whole groups
to a function that compares them in blocks. A group of more than ``limit`` rows isn't held: its rows
are passed on, :func:`in_blocks` spreads them over pairs of blocks, and they meet there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEY = 8192  # rows of a key that meet in one task


def by_group(settle: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], list[pa.RecordBatch]], heads: pa.Schema, limit: int | None = None):
    """A function for mapInArrow over rows sorted by their first column, the key.

    ``settle(rows, first, last)`` gets whole groups of at least two rows and returns batches of
    ``heads``. Rows that come out have the columns of ``heads`` and those of the input, either of
    them null. Without ``limit`` every group is settled.
    """
    most = 1 << 62 if limit is None else limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        held, passing = 0, None
        schema: pa.Schema | None = None

        def done(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            key = part.column(0).to_numpy()
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            last = np.append(first[1:], len(key))
            several = last - first > 1
            for b in settle(part, first[several], last[several]):
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.nulls(b.num_rows, f.type) for f in schema)], names=[*heads.names, *schema.names])

        def hot(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([*(pa.nulls(part.num_rows, f.type) for f in heads), *part.columns], names=[*heads.names, *schema.names])

        for batch in batches:
            schema = batch.schema
            key = batch.column(0).to_numpy()
            if passing is not None and len(key):  # the rest of a group that is too large
                same = int(np.searchsorted(key, passing, "right"))
                yield from hot(batch.slice(0, same))
                batch, key = batch.slice(same), key[same:]
                if len(key):
                    passing = None
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1], "left"))
            if rest and cut == 0 and rest[-1].column(0)[rest[-1].num_rows - 1].as_py() != key[-1]:
                yield from done(pa.concat_batches(rest))
                rest, held = [], 0
            if cut:
                yield from done(pa.concat_batches([*rest, batch.slice(0, cut)]))
                rest, held = [], 0
            rest.append(batch.slice(cut))
            held += batch.num_rows - cut
            if held > most:
                for r in rest:
                    yield from hot(r)
                passing, rest, held = int(key[-1]), [], 0
        if rest:
            yield from done(pa.concat_batches(rest))

    return run


def in_blocks(hot: DataFrame, item: str, limit: int | None = None) -> DataFrame:
    """Rows of hot keys, once for each pair of blocks they are in, under a key of that pair.

    Two items of a key are together in at least one pair; settle functions must allow for meeting
    twice (a pair of rows of one block meets in all of that block's pairs).
    """
    most = HOT_KEY if limit is None else limit
    size = hot.groupBy("key").agg(F.ceil(F.count("*") / max(1, most // 2)).cast("int").alias("__blocks"))
    mine: Column = F.pmod(F.xxhash64(item), F.col("__blocks")).cast("int")
    rows = hot.join(size, "key").withColumn("__mine", mine).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return rows.withColumn("key", F.xxhash64("key", F.least("__mine", "__other"), F.greatest("__mine", "__other"))).drop("__blocks", "__mine", "__other")


def together(rows: DataFrame, item: str, settle, heads: pa.Schema, ddl: str, limit: int | None = None, partitions: int | None = None) -> DataFrame:
    """All that ``settle`` finds where rows of a key meet, however many there are.

    partitions: for keys that are numbers from 0 up to it, each of which is a partition of its own.
    """
    from quernstone.runtime import kept

    most = HOT_KEY if limit is None else limit
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    spread = rows.repartition(F.col("key")) if partitions is None else rows.repartitionById(partitions, F.col("key").cast("int"))
    met = kept(spread.sortWithinPartitions("key").mapInArrow(by_group(settle, heads, most), f"{ddl}, {own}"))
    first = heads.names[0]
    # made once, by a job of its own: two readers at a time would each make it
    hot_rows = met.where(F.col(first).isNull()).count()
    found = met.where(F.col(first).isNotNull()).select(*heads.names)
    if not hot_rows:
        return found
    hot = in_blocks(met.where(F.col(first).isNull()).select(*rows.columns), item, most)
    again = hot.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(by_group(settle, heads), f"{ddl}, {own}")
    return found.unionByName(again.select(*heads.names))
