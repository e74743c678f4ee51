"""Queries of problem 3: what each successful run finds new or changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.incremental import CommitLog, changed_listings, changed_runs, changed_versions, clean_hash, clean_url, commit_of_runs, instant
from quernstone.runtime import cut, shared_dir, table


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    reports = table(spark, sf_dir, "crawl_reports")
    versions = table(spark, sf_dir, "chunk_runs").select("run_id", "chunk_id", "edit_seq", clean_hash(F.col("content_hash")).alias("hash"))
    listed = table(spark, sf_dir, "discovered").select("run_id", clean_url(F.col("url")).alias("item"), instant(F.col("lastmod")).alias("at"))
    base = table(spark, sf_dir, "chunks").select("chunk_id", clean_hash(F.col("content_hash")).alias("hash"))
    return versions, listed, base, commit_of_runs([versions, listed], reports)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, run_id, item): chunks and URLs new or changed in each successful run, each run a commit of its own."""
    versions, listed, base, commits = _inputs(spark, sf_dir)
    log = CommitLog(spark, f"{shared_dir(spark)}/increments-{uuid.uuid4().hex}")
    chunks, urls = changed_runs(
        log, versions.select("run_id", F.col("chunk_id").alias("item"), F.col("edit_seq").alias("o"), F.col("hash").alias("v")), listed, base.select(F.col("chunk_id").alias("item"), F.col("hash").alias("v")), cut(commits)
    )
    return chunks.select(F.lit("chunk").alias("kind"), F.col("commit_run").alias("run_id"), "item").unionByName(urls.select(F.lit("url").alias("kind"), F.col("commit_run").alias("run_id"), "item"))


def by_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the whole history at once."""
    versions, listed, base, commits = _inputs(spark, sf_dir)
    chunks = changed_versions(versions, commits, base, "chunk_id", "edit_seq", "hash")
    urls = changed_listings(listed, commits, "item", "at")
    return chunks.select(F.lit("chunk").alias("kind"), F.col("commit_run").alias("run_id"), F.col("chunk_id").alias("item")).unionByName(
        urls.select(F.lit("url").alias("kind"), F.col("commit_run").alias("run_id"), "item")
    )


FOUND_SQL = r"""
WITH ok AS (SELECT DISTINCT run_id FROM crawl_reports WHERE finished_at IS NOT NULL AND NOT partial),
v AS (
  SELECT c.run_id, c.chunk_id, c.edit_seq,
         nullif(regexp_replace(regexp_replace(lower(c.content_hash), '\s+', '', 'g'), '^sha-?256:', ''), '') AS hash,
         (SELECT min(o.run_id) FROM ok o WHERE o.run_id >= c.run_id) AS run
  FROM chunk_runs c),
per AS (SELECT chunk_id, run, max(edit_seq) AS o, arg_max(hash, edit_seq) AS h FROM v WHERE hash IS NOT NULL AND run IS NOT NULL AND edit_seq IS NOT NULL GROUP BY ALL),
base AS (SELECT chunk_id, '' AS run, -9000000000000 AS o, max(nullif(regexp_replace(regexp_replace(lower(content_hash), '\s+', '', 'g'), '^sha-?256:', ''), '')) AS h
         FROM chunks WHERE content_hash IS NOT NULL GROUP BY chunk_id),
st AS (SELECT chunk_id, run, arg_max(h, o) OVER (PARTITION BY chunk_id ORDER BY run) AS h
       FROM (SELECT * FROM per UNION ALL SELECT * FROM base)),
ch AS (SELECT chunk_id, run, h, lag(h) OVER (PARTITION BY chunk_id ORDER BY run) AS p FROM st),
d AS (
  SELECT (SELECT min(o.run_id) FROM ok o WHERE o.run_id >= x.run_id) AS run,
         regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[?#].*$', ''), '^([a-z]+://)?www\.', '\1'), '/$', '') AS item,
         TRY_CAST(CASE WHEN lastmod ~ '^\d{4}-\d\d-\d\d.' THEN lastmod WHEN lastmod ~ '^\d{4}-\d\d-\d\d$' THEN lastmod || ' 00:00:00+00' END AS TIMESTAMPTZ) AS inst
  FROM discovered x),
du AS (SELECT item, run, max(inst) AS inst FROM d WHERE run IS NOT NULL AND item IS NOT NULL GROUP BY ALL),
dw AS (SELECT item, run, inst, max(inst) OVER (PARTITION BY item ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
              row_number() OVER (PARTITION BY item ORDER BY run) AS nth FROM du)
SELECT 'chunk' AS kind, run AS run_id, chunk_id AS item FROM ch WHERE run <> '' AND (p IS NULL OR p <> h)
UNION ALL
SELECT 'url' AS kind, run AS run_id, item FROM dw WHERE nth = 1 OR (inst IS NOT NULL AND (before IS NULL OR inst > before))
"""
