"""Processing only new or changed records.

Two layers share one rule: a commit covers the records whose position in a monotonic commit
sequence lies in ``(watermark, upper]``, with ``upper`` fixed before anything is read.

* :class:`CommitLog` and :func:`run_incremental` drive real runs. A run writes its rows into a
  folder of its own and then publishes *one* manifest holding rows' folder and new watermark, which
  appears whole or not at all. Readers follow manifests only, so a run that dies at any moment
  leaves nothing visible and the next run starts from the old watermark.
* :func:`changed_runs` processes a history commit by commit that way. A key's state after a commit is
  in the rows of the last commit that moved it, so each commit reads the state of its own keys only.
* :func:`commit_of_runs`, :func:`changed_versions` and :func:`changed_listings` are the set-based
  form over a whole history of runs: every record is assigned the commit that covers it, the
  state after each commit is a running maximum per key, and a change is a difference between
  neighbouring commits. Rows per key shrink to one per commit before the window, so a hot key
  never exceeds the number of commits.

Null keys, null run ids and null versions are ignored; ties in the edit order mean the same
version by contract and are settled by the greater version text; re-deliveries are no-ops; an
empty table gives no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clean_hash(col: Column) -> Column:
    """Content hash without blanks, case and ``sha256:`` prefix; empty becomes null."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(col), r"(?U)\s+", ""), r"^sha-?256:", "")
    return F.when(bare != "", bare)


def clean_url(col: Column) -> Column:
    """URL in lower case without query, fragment, leading ``www.`` and one trailing slash."""
    bare = F.regexp_replace(F.lower(F.trim(col)), r"[?#].*$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^([a-z][a-z0-9+.-]*://)?www\.", "$1"), r"/$", "")
    return F.when(bare != "", bare)


def instant(col: Column) -> Column:
    """ISO-8601 text as an instant whatever the session time zone; unreadable becomes null."""
    t = F.upper(F.trim(col))
    t = F.regexp_replace(t, r"([+-]\d\d)(\d\d)$", "$1:$2")
    t = F.when(t.rlike(r"^\d{4}-\d\d?-\d\d?$"), F.concat(t, F.lit("T00:00:00Z"))).when(
        t.rlike(r"\d:\d\d(:\d\d(\.\d+)?)?$") & ~t.rlike(r"[+-]\d\d:\d\d$"), F.concat(t, F.lit("Z"))
    ).otherwise(t)
    return F.when(t.rlike(r"^\d{4}-\d\d?-\d\d?[T ]"), t).try_cast("timestamp")


def successful_runs(reports: DataFrame) -> DataFrame:
    """Runs with at least one report that is finished and not partial."""
    return reports.where(F.col("run_id").isNotNull() & F.col("finished_at").isNotNull() & ~F.col("partial")).select("run_id").distinct()


def commit_of_runs(records: list[DataFrame], reports: DataFrame) -> DataFrame:
    """(run_id, commit_run, commit_seq) for every run some successful run covers.

    ``commit_run`` is the first successful run not before ``run_id``; ``commit_seq`` counts
    successful runs from 1. One row per run: the un-partitioned windows see as many rows as there
    were runs, not records.
    """
    runs = reports.select("run_id")
    for r in records:
        runs = runs.unionByName(r.select("run_id"))
    ok = successful_runs(reports).withColumn("ok", F.lit(True))
    runs = runs.where(F.col("run_id").isNotNull()).distinct().join(ok, "run_id", "left")
    ahead = Window.orderBy("run_id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    runs = runs.withColumn("commit_run", F.first(F.when(F.col("ok"), F.col("run_id")), ignorenulls=True).over(ahead))
    return runs.where(F.col("commit_run").isNotNull()).select("run_id", "commit_run", F.dense_rank().over(Window.orderBy("commit_run")).alias("commit_seq"))


def changed_versions(records: DataFrame, commits: DataFrame, baseline: DataFrame, key: str, order: str, version: str) -> DataFrame:
    """(key, commit_run, version) whenever a key's newest version after a commit differs from the one before it.

    ``records`` has ``run_id``, ``key``, ``order``, ``version``; ``baseline`` has ``key`` and
    ``version`` and is older than any record.
    """
    live = records.where(F.col(version).isNotNull() & F.col(key).isNotNull() & F.col(order).isNotNull())
    per = live.join(commits, "run_id").groupBy(key, "commit_seq", "commit_run").agg(F.max(F.struct(F.col(order).cast("long").alias("o"), F.col(version).alias("v"))).alias("top"))
    base = baseline.where(F.col(version).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(version).alias("v"))
    # only keys with records can change
    base = base.join(per.select(key).distinct(), key, "left_semi").select(
        key, F.lit(0).alias("commit_seq"), F.lit(None).cast("string").alias("commit_run"), F.struct(F.lit(-(2**63)).cast("long").alias("o"), F.col("v")).alias("top")
    )
    w = Window.partitionBy(key).orderBy("commit_seq")
    state = per.unionByName(base).withColumn("now", F.max("top").over(w))
    state = state.withColumn("before", F.lag("now").over(w))
    return state.where(F.col("commit_run").isNotNull() & (F.col("before").isNull() | (F.col("before.v") != F.col("now.v")))).select(
        key, "commit_run", "commit_seq", F.col("now.v").alias(version)
    )


def changed_listings(records: DataFrame, commits: DataFrame, key: str, at: str) -> DataFrame:
    """(key, commit_run, at) when a key is listed first, or its latest instant passes any covered before."""
    per = records.where(F.col(key).isNotNull()).join(commits, "run_id").groupBy(key, "commit_seq", "commit_run").agg(F.max(at).alias("top"))
    w = Window.partitionBy(key).orderBy("commit_seq")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.max("top").over(past)).withColumn("nth", F.row_number().over(w))
    return per.where((F.col("nth") == 1) | (F.col("top").isNotNull() & (F.col("before").isNull() | (F.col("top") > F.col("before"))))).select(
        key, "commit_run", "commit_seq", F.col("top").alias(at)
    )


@dataclass
class Commit:
    """What one manifest says: the watermark reached and where each output's rows lie."""

    number: int
    watermark: int
    outputs: dict[str, str] = field(default_factory=dict)


def put_once(spark: SparkSession, path: str, text: str) -> None:
    """A file that readers see whole or not at all, and that one of several writers makes; the others get an error.

    On a local disk by a hard link, which fails if the name is taken (without links by creating it); where renaming is atomic by a rename
    that doesn't overwrite; on object stores by a conditional upload.
    """
    jvm = spark.sparkContext._jvm
    final = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = final.getFileSystem(conf)
    scheme = fs.getUri().getScheme()
    whole = scheme in ("file", "hdfs", "viewfs")
    draft = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".draft-{uuid.uuid4().hex}") if whole else final
    taken = RuntimeError(f"{path} was published by another run")
    try:
        stream = fs.create(draft, False)
    except Exception as e:
        raise taken from e
    stream.write(bytearray(text.encode()))
    try:
        stream.close()
        if scheme == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                jvm.java.nio.file.Files.createLink(local(fs.makeQualified(final)), local(fs.makeQualified(draft)))
            except Exception:
                if fs.exists(final):
                    raise
                # a mounted folder without hard links: the name is still taken once
                plain = fs.create(final, False)
                plain.write(bytearray(text.encode()))
                plain.close()
        elif whole:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(draft, final, options)
    except Exception as e:
        raise taken from e
    finally:
        if whole:
            fs.delete(draft, False)


class CommitLog:
    """Numbered manifests in a folder of any Hadoop file system. ``number`` grows by one a commit.

    A manifest appears whole under its number, once: the first of several runs wins, the others fail
    (:func:`put_once`).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(self.path))

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def commits(self) -> list[Commit]:
        names = sorted(n for s in self._fs.listStatus(self._at(self.path)) if (n := s.getPath().getName()).endswith(".json") and n.startswith("commit-"))
        return [self._load(n) for n in names]

    def latest(self) -> Commit | None:
        names = sorted(n for s in self._fs.listStatus(self._at(self.path)) if (n := s.getPath().getName()).endswith(".json") and n.startswith("commit-"))
        return self._load(names[-1]) if names else None

    def _load(self, name: str) -> Commit:
        stream = self._fs.open(self._at(f"{self.path}/{name}"))
        try:
            return Commit(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def publish(self, commit: Commit) -> None:
        put_once(self.spark, f"{self.path}/commit-{commit.number:012d}.json", json.dumps(asdict(commit)))

    def read(self, output: str) -> DataFrame | None:
        """All committed rows of one output; null if nothing was committed. Drafts are never read."""
        paths = [c.outputs[output] for c in self.commits() if output in c.outputs]
        return self.spark.read.parquet(*paths) if paths else None


def newest(state: DataFrame, key: str) -> DataFrame:
    """(key, o, v): each key's version of the greatest order."""
    return state.groupBy(key).agg(F.max(F.struct("o", "v")).alias("s")).select(key, "s.o", "s.v")


def changed_runs(log: CommitLog, versions: DataFrame, listed: DataFrame, base: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, commit_run) of changed versions and of listings, each commit of ``commits`` being a run of its own over ``log``.

    versions: (run_id, item, o, v), v the version of the order o; listed: (run_id, item, at); base: (item, v),
    older than any version. Both are handled and published in one commit, so neither can run ahead.
    """
    covered = commits.select("run_id", "commit_run", "commit_seq")
    records = versions.select(F.lit("version").alias("kind"), "run_id", "item", F.col("o").cast("long").alias("o"), "v", F.lit(None).cast("timestamp").alias("at")).unionByName(
        listed.select(F.lit("listing").alias("kind"), "run_id", "item", F.lit(None).cast("long").alias("o"), F.lit(None).cast("string").alias("v"), "at")
    )
    records = records.where("item is not null").join(F.broadcast(covered), "run_id")  # a row for each run
    old = base.where("item is not null and v is not null").select("item", F.lit(-(2**63)).cast("long").alias("o"), "v")

    def process(fresh: DataFrame) -> dict[str, DataFrame]:
        run = F.max("commit_run").alias("commit_run")
        new = fresh.where("kind = 'version' and v is not null and o is not null").groupBy("item").agg(F.max(F.struct("o", "v")).alias("n"), run)
        held = log.read("versions")
        state = old if held is None else old.unionByName(held.select("item", "o", "v"))
        before = newest(state.join(new.select("item"), "item", "left_semi"), "item").select("item", F.struct("o", "v").alias("b"))
        moved = new.join(before, "item", "left").where(F.col("b").isNull() | (F.col("n") > F.col("b")))
        first = F.col("b").isNull() | (F.col("b.v") != F.col("n.v"))
        seen = fresh.where("kind = 'listing'").groupBy("item").agg(F.max("at").alias("at"), run)
        past = log.read("listings")
        if past is None:
            urls = seen.select("item", "at", "commit_run", F.lit(True).alias("changed"))
        else:
            last = past.join(seen.select("item"), "item", "left_semi").groupBy("item").agg(F.max("at").alias("old"), F.lit(True).alias("known"))
            later = F.col("at").isNotNull() & (F.col("old").isNull() | (F.col("at") > F.col("old")))
            urls = seen.join(last, "item", "left").where(F.col("known").isNull() | later).select("item", "at", "commit_run", F.lit(True).alias("changed"))
        return {"versions": moved.select("item", "n.o", "n.v", "commit_run", first.alias("changed")), "listings": urls}

    runs: dict[int, list[str]] = {}
    for r in covered.collect():  # a row for each run
        runs.setdefault(r.commit_seq, []).append(r.run_id)
    for seq in sorted(runs):
        # the runs' names reach the scan; the watermark still decides what is taken
        run_incremental(log, records.where(F.col("run_id").isin(runs[seq])), "commit_seq", process, upper=seq)
    empty = log.spark.createDataFrame([], "item string, commit_run string")
    out = [log.read(name) for name in ("versions", "listings")]
    return tuple(empty if df is None else df.where("changed").select("item", "commit_run") for df in out)


def run_incremental(log: CommitLog, records: DataFrame, sequence: str, process: Callable[[DataFrame], dict[str, DataFrame]], upper: int | None = None) -> Commit | None:
    """One run: fix the upper bound, process ``(watermark, upper]``, write, then publish rows and watermark as one.

    Returns the commit, or null when there was nothing new. A failure anywhere before the
    rename leaves the log as it was, so the same records are taken again next time and none twice.
    """
    last = log.latest()
    low = last.watermark if last else None
    if upper is None:
        upper = records.agg(F.max(sequence)).first()[0]
    if upper is None or (low is not None and upper <= low):
        return None
    fresh = records.where(F.col(sequence) <= upper)
    if low is not None:
        fresh = fresh.where(F.col(sequence) > low)
    number = last.number + 1 if last else 1
    outputs = {}
    for name, df in process(fresh).items():
        outputs[name] = f"{log.path}/rows/{name}/commit={number:012d}-{uuid.uuid4().hex}"
        df.write.parquet(outputs[name])
    commit = Commit(number, int(upper), outputs)
    log.publish(commit)
    return commit
