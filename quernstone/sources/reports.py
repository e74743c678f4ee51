"""Crawl reports, failures and aliases as files of a staging folder, and records as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAILURE = "url string, reason string, status_code int, error string"
ALIAS = "origin string, target string"


def safe_name(run_id: Column) -> Column:
    """A run's name for a file: colons and dots as hyphens, without plus signs."""
    return F.translate(F.replace(run_id, F.lit("+"), F.lit("")), ":.", "--")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_reports(reports: DataFrame, staging: str) -> None:
    """A folder of JSON for each run; a run's earlier report gives way."""
    spark = reports.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    reports.withColumn("name", F.concat(F.lit("report_"), safe_name(F.col("run_id")))).write.partitionBy("name").mode("overwrite").json(f"{staging}/reports")


def load_reports(spark: SparkSession, staging: str, schema: str) -> DataFrame:
    """All readable reports, newest first; none without the folder."""
    if not exists(spark, f"{staging}/reports"):
        return spark.createDataFrame([], f"{schema}, name string")
    rows = spark.read.schema(f"{schema}, name string").option("mode", "DROPMALFORMED").json(f"{staging}/reports")
    return rows.where("run_id is not null").orderBy(F.desc("name"))


def latest_full(reports: DataFrame) -> DataFrame:
    """The newest report that isn't partial, at most one row."""
    return reports.where(~F.coalesce(F.col("partial"), F.lit(False))).orderBy(F.desc(safe_name(F.col("run_id")))).limit(1)


def listing(reports: DataFrame) -> DataFrame:
    """(name, run_id, partial, nth) from the newest on."""
    from pyspark.sql.window import Window

    name = F.concat(F.lit("report_"), safe_name(F.col("run_id")), F.lit(".json"))
    once = reports.where("run_id is not null").groupBy(name.alias("name"), "run_id").agg(F.min("partial").alias("partial"))
    return once.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("name"))))  # one row a run


def save_failures(failures: DataFrame, staging: str) -> None:
    """Replaces those of the run before."""
    failures.select("url", "reason", "status_code", "error").write.mode("overwrite").json(f"{staging}/failures")


def load_failures(spark: SparkSession, staging: str) -> DataFrame:
    """Malformed lines are left out; empty without the file."""
    if not exists(spark, f"{staging}/failures"):
        return spark.createDataFrame([], FAILURE)
    return spark.read.schema(FAILURE).option("mode", "DROPMALFORMED").json(f"{staging}/failures").where("url is not null")


def save_aliases(aliases: DataFrame, staging: str) -> None:
    """A new folder under a number of its own: what is read to make it isn't overwritten."""
    spark = aliases.sparkSession
    n = 1
    while exists(spark, f"{staging}/aliases/{n:06d}/_SUCCESS"):
        n += 1
    aliases.select("origin", "target").write.mode("overwrite").parquet(f"{staging}/aliases/{n:06d}")


def load_aliases(spark: SparkSession, staging: str) -> DataFrame:
    n = 1
    while exists(spark, f"{staging}/aliases/{n:06d}/_SUCCESS"):
        n += 1
    return spark.read.parquet(f"{staging}/aliases/{n - 1:06d}") if n > 1 else spark.createDataFrame([], ALIAS)


def to_records(rows: DataFrame) -> DataFrame:
    """(json) of each row, nulls written out, so that nothing is lost."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def from_records(records: DataFrame, schema: str) -> DataFrame:
    """Rows of records; unknown keys are dropped, missing ones null, unreadable records left out."""
    return records.select(F.from_json("json", schema).alias("r")).where("r is not null").select("r.*")
