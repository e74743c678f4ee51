"""The chunk index as snapshots of parquet: upsert by content hash, deletes, and metadata.

A snapshot is a folder; numbered manifests name them, and the one of the greatest number is live. A
manifest appears whole or not at all and a number is taken once, so readers always see a table and
of two writers one fails. Nothing is deleted in place.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators.incremental import put_once


def one_per_key(df: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Exact duplicates of a key are one row; of different ones the greatest hash."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last("content_hash"))
    return df.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


COLUMNS = "chunk_id string, url string, title string, page_type string, content_hash string, text string, chunk_index int, source string, is_faq boolean, vector array<float>"


def typed(rows: DataFrame) -> DataFrame:
    """The index's columns in their types, missing ones null; other columns are left out."""
    names = [c.split()[0:2] for c in COLUMNS.split(", ")]
    if not {"text", "url"} <= set(rows.columns):
        return rows
    return rows.select(*((F.col(n) if n in rows.columns else F.lit(None)).cast(kind).alias(n) for n, kind in names))


def overview_count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("source") == "overview").alias("overview"))


def upsert_actions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(chunk_id, url, action): added, updated, skipped, orphaned, or kept for urls outside the batch."""
    old = one_per_key(existing).select("chunk_id", F.col("url").alias("old_url"), F.coalesce("content_hash", F.lit("")).alias("old_hash"))
    new = one_per_key(incoming).select("chunk_id", F.col("url").alias("new_url"), F.coalesce("content_hash", F.lit("")).alias("new_hash"))
    touched = incoming.select(F.col("url").alias("old_url")).where("old_url is not null").distinct().withColumn("touched", F.lit(True))
    both = old.join(new, "chunk_id", "full").join(touched, "old_url", "left")
    action = (
        F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), F.when(F.col("touched"), "orphaned").otherwise("kept"))
        .when(F.col("old_hash") != F.col("new_hash"), "updated").otherwise("skipped")
    )
    return both.select("chunk_id", F.coalesce("new_url", "old_url").alias("url"), action.alias("action"))


def upsert_summary(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def apply_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table after the upsert: other urls' rows, and the batch's."""
    new = one_per_key(incoming)
    untouched = one_per_key(existing).join(new.select("chunk_id"), "chunk_id", "left_anti").join(incoming.select("url").where("url is not null").distinct(), "url", "left_anti")
    return untouched.select(new.columns).unionByName(new)


def to_embed(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Only what is new or changed goes to the embedder."""
    return one_per_key(incoming).join(existing.select("chunk_id", "content_hash").distinct(), ["chunk_id", "content_hash"], "left_anti")


def delete_urls(existing: DataFrame, urls: DataFrame) -> DataFrame:
    return existing.join(urls.select("url").distinct(), "url", "left_anti")


@dataclass
class IndexMeta:
    provider: str
    model: str
    dims: int
    chunk_count: int = 0
    added: int = 0
    updated: int = 0
    orphans_deleted: int = 0


class ChunkIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jvm = jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._jvm.org.apache.hadoop.fs.Path(self.path)):
            return []
        names = (x.getPath().getName() for x in self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(self.path)))
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _live(self) -> dict | None:
        numbers = self._numbers()
        if not numbers:
            return None
        stream = self._fs.open(self._p(f"manifest-{numbers[-1]:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def exists(self) -> bool:
        return self._live() is not None

    def meta(self) -> IndexMeta | None:
        live = self._live()
        return IndexMeta(**live["meta"]) if live else None

    def read(self) -> DataFrame | None:
        live = self._live()
        return self.spark.read.parquet(f"{self.path}/{live['snapshot']}") if live else None

    def _publish(self, df: DataFrame, meta: IndexMeta) -> None:
        number = (self._numbers() or [0])[-1] + 1
        name = f"snapshot-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        meta.chunk_count = self.spark.read.parquet(f"{self.path}/{name}").count()
        put_once(self.spark, f"{self.path}/manifest-{number:012d}.json", json.dumps({"snapshot": name, "meta": asdict(meta)}))

    def rebuild(self, rows: DataFrame, provider: str = "hash", model: str = "hash", dims: int = 64) -> int:
        """The table anew from these rows; an empty table changes nothing."""
        if rows.isEmpty():
            return 0
        self._publish(typed(one_per_key(rows)), IndexMeta(provider, model, dims))
        return self.meta().chunk_count

    def upsert(self, incoming: DataFrame, provider: str = "hash", model: str = "hash", dims: int = 64) -> dict[str, int]:
        """Counts by action. An empty batch changes nothing; another embedder than the table's is refused."""
        if incoming.isEmpty():
            return {}
        old, meta = self.read(), self.meta()
        if meta is not None and (meta.provider, meta.dims) != (provider, dims):
            raise ValueError(f"the index was built by {meta.provider} with {meta.dims} dimensions")
        if old is None:
            rows = one_per_key(incoming)
            n = rows.count()
            self._publish(rows, IndexMeta(provider, model, dims, added=n))
            return {"added": n}
        done = {r.action: r.n for r in upsert_summary(upsert_actions(old, incoming)).collect()}
        if any(done.get(a) for a in ("added", "updated", "orphaned")):
            self._publish(apply_upsert(old, incoming), IndexMeta(provider, model, dims, added=done.get("added", 0), updated=done.get("updated", 0), orphans_deleted=done.get("orphaned", 0)))
        return done

    def delete(self, urls: DataFrame) -> int:
        old, meta = self.read(), self.meta()
        if old is None or urls.isEmpty():
            return 0
        n = old.join(urls.select("url").distinct(), "url", "left_semi").count()
        if n:
            self._publish(delete_urls(old, urls), meta)
        return n

    def expire(self, keep: int = 1, older_than: float | None = None, now: float | None = None) -> int:
        """Delete snapshots that are neither live nor among the newest ``keep``, and, with an age in seconds, only older ones."""
        live = self._live()
        if live is None:
            return 0
        at = (time.time() if now is None else now) * 1000
        found = sorted(((x.getModificationTime(), x.getPath().getName()) for x in self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(self.path)) if x.getPath().getName().startswith("snapshot-")), reverse=True)
        old = [n for t, n in [f for f in found if f[1] != live["snapshot"]][max(0, keep - 1) :] if older_than is None or at - t > older_than * 1000]
        for n in old:
            self._fs.delete(self._p(n), True)
        return len(old)
