"""Sitemaps, JSON lines and raw pages as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions import url as U
from quernstone.operators.crawl import merge_missing

DISCOVERED = T.StructType(
    [T.StructField(n, t) for n, t in (("url", T.StringType()), ("lastmod", T.StringType()), ("priority", T.DoubleType()), ("changefreq", T.StringType()), ("source", T.StringType()), ("page_type", T.StringType()))]
)


def _tag(name: str) -> str:
    return rf"(?is)<(?:\w+:)?{name}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:\w+:)?{name}\s*>"


def sitemap_kind(xml):
    """urlset, sitemapindex, or null for anything else."""
    k = F.lower(F.regexp_extract(xml, r"(?is)^\s*(?:<\?xml.*?\?>)?\s*(?:<!--.*?-->\s*)*<(?:\w+:)?(urlset|sitemapindex)\b", 1))
    return F.nullif(k, F.lit(""))


def parse_urlset(files: DataFrame, xml: str = "xml", source: str | None = None) -> DataFrame:
    """Urls of urlsets; entries without loc are left out, an unreadable priority is null. Other documents give none."""
    rows = files.where(sitemap_kind(F.col(xml)) == "urlset").select(F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<(?:\w+:)?url\b[^>]*>(.*?)</(?:\w+:)?url\s*>"), F.lit(1))).alias("x"))
    get = lambda n: F.nullif(F.trim(F.regexp_extract("x", _tag(n), 1)), F.lit(""))
    loc = U.normalize(F.replace(get("loc"), F.lit("&amp;"), F.lit("&")))
    rows = rows.select(loc.alias("url"), get("lastmod").alias("lastmod"), get("priority").try_cast("double").alias("priority"), get("changefreq").alias("changefreq"))
    return rows.where("url is not null").select("*", (F.lit(source) if source else U.source_label(F.col("url"))).alias("source"), U.page_type(F.col("url")).alias("page_type"))


def parse_index(files: DataFrame, xml: str = "xml") -> DataFrame:
    """(loc) of the child sitemaps of an index; indexes within indexes aren't followed."""
    rows = files.where(sitemap_kind(F.col(xml)) == "sitemapindex")
    return rows.select(F.explode(F.regexp_extract_all(F.col(xml), F.lit(_tag("loc")), F.lit(1))).alias("loc")).select(F.trim("loc").alias("loc")).where("loc <> ''")


def expand_index(index: DataFrame, files: DataFrame) -> DataFrame:
    """Urls of an index's children, from fetched files (url, xml)."""
    return parse_urlset(parse_index(index).withColumnRenamed("loc", "url").join(files, "url").select("xml"))


def discover(files: DataFrame, root: str, blog: str | None = None) -> DataFrame:
    """All urls of a site from fetched files (url, xml): the root's own, or those of its children if it is an index, one level deep.

    A root that is no index gets the blog's entries it lacks, those of a blog index's children included.
    Files that are missing or aren't XML give nothing.
    """
    def tree(at: str, source: str | None) -> DataFrame:
        top = files.where(F.col("url") == at).select("xml")
        child = parse_index(top).join(files.withColumnRenamed("url", "loc"), "loc").select("loc", "xml")
        label = F.lit(source) if source else U.source_label(F.col("loc"))
        own = parse_urlset(top, source=source or ("blog-sitemap" if "blog" in at.lower() else "sitemap"))
        below = child.where(sitemap_kind(F.col("xml")) == "urlset").select(label.alias("label"), "xml")
        return own.unionByName(parse_urlset(below.where("label = 'sitemap'").select("xml"), source="sitemap")).unionByName(parse_urlset(below.where("label = 'blog-sitemap'").select("xml"), source="blog-sitemap"))

    urls = tree(root, None)
    if blog is None or files.where((F.col("url") == root) & (sitemap_kind(F.col("xml")) == "urlset")).isEmpty():
        return urls
    return merge_missing(urls, tree(blog, "blog-sitemap"))


def save_discovered(df: DataFrame, path: str) -> None:
    df.select(*DISCOVERED.names).write.mode("overwrite").json(path)


def load_discovered(spark: SparkSession, path: str) -> DataFrame:
    """Unknown keys are dropped, missing ones null, malformed lines skipped; a missing folder is empty."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], DISCOVERED)
    return spark.read.schema(DISCOVERED).option("mode", "DROPMALFORMED").json(path)


def save_pages(fetches: DataFrame, path: str) -> None:
    """Raw pages under the hash of their url, for point lookups by a pruned column."""
    fetches.withColumn("url_hash", U.url_hash(F.col("url"))).write.mode("overwrite").parquet(path)


def listed_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url_hash, url) of what is stored; the pages themselves aren't read."""
    return spark.read.parquet(path).select("url_hash", "url")


def load_page(spark: SparkSession, path: str, url: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("url_hash") == U.url_hash(F.lit(url)))
