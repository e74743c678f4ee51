"""A stored search index over chunks: inverted lists by term, vectors by cell, and which of them serve a search.

The vectors' cells are those of an inverted file: centres by k-means on a bounded sample of
``SAMPLE`` vectors, every vector assigned to its nearest centre. A search looks into the cells whose
centres are nearest to the query. Below ``MIN_ROWS`` vectors there are no cells and the search is exact.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import retrieval
from quernstone.runtime import kept, let_go, narrowed

MIN_ROWS = 2048  # fewer vectors are searched exactly
SAMPLE = 100_000  # vectors the centres are fitted on, at most
SLICE = 2048  # vectors whose distances to all centres are held at once
FILE = 16_384  # rows of a stored file of vectors, about
PROBES = 0.15  # share of the cells a query looks into, at least MIN_PROBES
MIN_PROBES = 8


def eligible(rows: int, enabled: bool = True, least: int = MIN_ROWS) -> bool:
    return enabled and rows >= least


def cells_for(rows: int) -> int:
    """As many cells as the root of the number of vectors."""
    return max(1, int(rows**0.5))


def centres(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 13) -> np.ndarray:
    """k-means; an empty cell takes over the row that is farthest from its centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own, off = np.empty(len(x), np.int64), np.empty(len(x))
        for lo in range(0, len(x), SLICE):
            far = (c * c).sum(1)[None] - 2 * x[lo : lo + SLICE] @ c.T
            own[lo : lo + SLICE] = far.argmin(1)
            off[lo : lo + SLICE] = far.min(1)
        n = np.bincount(own, minlength=len(c))
        total = np.stack([np.bincount(own, x[:, d], len(c)) for d in range(x.shape[1])], 1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[np.argsort(-off, kind="stable")[: len(empty)]]
    return c


def usable(vector: str, dims: int):
    """Vectors of the right length without null or NaN."""
    return F.coalesce((F.size(vector) == dims) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v)), F.lit(False))


def with_cells(rows: DataFrame, c: np.ndarray, vector: str = "vector") -> DataFrame:
    """``rows`` with the cell of their vector, null for vectors that can't be searched."""
    sent = rows.sparkSession.sparkContext.broadcast(c)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mid = sent.value
        for batch in batches:
            col = batch.column(batch.schema.names.index(vector))
            size = np.nan_to_num(col.value_lengths().to_numpy(zero_copy_only=False))
            at = np.flatnonzero(size == mid.shape[1])
            x = col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), mid.shape[1])
            good = np.isfinite(x).all(axis=1)
            own = np.full(batch.num_rows, -1, np.int32)
            x, at = x[good], at[good]
            for lo in range(0, len(x), SLICE):
                own[at[lo : lo + SLICE]] = ((mid * mid).sum(1)[None] - 2 * x[lo : lo + SLICE] @ mid.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, mask=own < 0)], names=[*batch.schema.names, "cell"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(assign, f"{schema}, cell int")


class OtherEmbedder(ValueError):
    """An index was built by another embedder than that of the queries."""


def missing(e: Exception) -> bool:
    """Whether a table was never written, which isn't a failure."""
    return isinstance(e, AnalysisException) and e.getCondition() == "PATH_NOT_FOUND"


@dataclass
class SearchMeta:
    provider: str
    dims: int
    rows: int
    cells: int = 0  # 0: searched exactly


class SearchIndex:
    """Postings and vectors of a chunk table under a folder, written once and read by searches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, chunks: DataFrame, provider: str = "hash", dims: int = 64, enabled: bool = True, least: int = MIN_ROWS) -> SearchMeta | None:
        """Replaces what the folder holds; an empty table changes nothing."""
        # written once as they come: they are read several times, and what made them takes room until then
        raw = f"{self.path}/incoming"
        chunks.select("chunk_id", "url", "title", "page_type", "text", "vector").write.mode("overwrite").option("compression", "zstd").parquet(raw)
        let_go(self.spark)
        rows = self.spark.read.parquet(raw)
        every = rows.count()
        if not every:
            self._drop(raw)
            return None
        good = rows.where(usable("vector", dims))
        n = good.count()
        mid = np.zeros((0, dims))
        if eligible(n, enabled, least):
            share = min(1.0, SAMPLE / n)
            some = good.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("vector").limit(SAMPLE).toArrow()
            mid = centres(some.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims), cells_for(n))
        placed = with_cells(rows, mid) if len(mid) else rows.withColumn("cell", F.lit(None).cast("int"))
        # by range of cells, so that a scan for some of them skips the other files and row groups; those without a cell are spread
        files = -(-every // FILE)
        placed = placed.repartitionById(files, F.coalesce((F.col("cell").cast("long") * files / max(1, len(mid))).cast("int"), F.pmod(F.xxhash64("chunk_id"), F.lit(files)).cast("int")))
        placed.sortWithinPartitions("cell").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/vectors")
        self._drop(raw)
        let_go(self.spark)
        retrieval.packed(self.rows(), "chunk_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/postings")
        meta = SearchMeta(provider, dims, n, len(mid))
        one = [(json.dumps(asdict(meta)), mid.tolist())]
        self.spark.createDataFrame(one, "meta string, centres array<array<double>>").write.mode("overwrite").parquet(f"{self.path}/meta")
        return meta

    def _drop(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _meta(self) -> tuple[SearchMeta, np.ndarray]:
        r = self.spark.read.parquet(f"{self.path}/meta").first()
        meta = SearchMeta(**json.loads(r["meta"]))
        return meta, np.array(r["centres"], np.float64).reshape(meta.cells, meta.dims)

    def meta(self) -> SearchMeta:
        return self._meta()[0]

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def pinned(self, provider: str, dims: int) -> None:
        """Queries must be embedded as the table was."""
        meta = self.meta()
        if (meta.provider, meta.dims) != (provider, dims):
            raise OtherEmbedder(f"the index was built by {meta.provider} with {meta.dims} dimensions")

    def by_text(self, queries: DataFrame, k: int = 20) -> DataFrame:
        return retrieval.bm25(self.spark.read.parquet(f"{self.path}/postings"), queries, k, "chunk_id")

    def by_vector(self, queries: DataFrame, k: int = 20, probes: int | None = None) -> DataFrame:
        meta, mid = self._meta()
        if not meta.cells:
            return retrieval.vector_top_k(self.rows(), queries, k, "chunk_id")
        return retrieval.vector_top_k(self.rows(), queries, k, "chunk_id", cells=("cell", mid, probes or max(MIN_PROBES, int(PROBES * meta.cells))))

    def hybrid(self, queries: DataFrame, k: int = 20, text: bool = True) -> DataFrame:
        """Both searches of (query_id, query, vector) fused and boosted; by vectors alone if there is no text search."""
        chunks = self.rows().select("chunk_id", "url", "title", "page_type")
        lists = [self.by_vector(queries, k)]
        if text:
            try:
                lists.append(self.by_text(queries, k))
            except AnalysisException as e:
                if not missing(e):
                    raise
                print(f"no text search, by vectors alone: {e}")
        return retrieval.hybrid_of(lists, chunks, k)

    def smoke(self, query: DataFrame, k: int = 5) -> DataFrame:
        """(search, chunk_id, url, title, page_type, text, score) of a query in either search, texts cut to 120 characters."""
        rows = self.rows().select("chunk_id", "url", "title", "page_type", F.substring("text", 1, 120).alias("text"))
        parts = [self.by_vector(query, k).select(F.lit("vector").alias("search"), "chunk_id", F.col("distance").alias("score")), self.by_text(query, k).select(F.lit("text").alias("search"), "chunk_id", "score")]
        hits = kept(parts[0].unionByName(parts[1]))
        return hits.join(narrowed(rows, hits.select("chunk_id").distinct(), "chunk_id"), "chunk_id").select("search", "chunk_id", "url", "title", "page_type", "text", "score")
