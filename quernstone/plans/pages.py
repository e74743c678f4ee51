"""Queries of crawling, extraction, reports and the index over whole tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import text as T
from quernstone.operators import ann, chunking, crawl, extract, index
from quernstone.plans import queries as Q
from quernstone.plans.queries import query, squeezed_sql
from quernstone.runtime import shared_dir, table
from quernstone.sources import reports as R
from quernstone.sources import sitemap

OVERVIEW = "https://orvanta-hub.example/llms-full.txt"


def staging(spark) -> str:
    """A folder of its own under the shared one."""
    return f"{shared_dir(spark)}/staging-{uuid.uuid4().hex}"


RULES = crawl.robots_rules(Q.ROBOTS)[0]
ALLOWED = f"(CASE WHEN starts_with({Q.PATH}, '/hire-') THEN false WHEN starts_with({Q.PATH}, '/services/') THEN true WHEN starts_with({Q.PATH}, '/s') THEN false WHEN starts_with({Q.PATH}, '/legal') THEN false ELSE true END)"
OK_FETCH = "(status_code = 200 AND html IS NOT NULL)"


@query(f"""SELECT url, source, ord, place FROM (SELECT *, min(ord) OVER (PARTITION BY url) AS place, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN coalesce(source, '') = 'bfs' THEN 1 ELSE 0 END, ord) AS n FROM discovered WHERE {ALLOWED}) WHERE n = 1""")
def filtered_discovery(spark, d):
    return crawl.filter_and_dedupe(table(spark, d, "discovered"), RULES).select("url", "source", "ord", "place")


@query(f"""SELECT count(*) AS listed, count(*) FILTER (NOT {ALLOWED}) AS robots_filtered, count(*) FILTER ({ALLOWED}) - count(DISTINCT CASE WHEN {ALLOWED} THEN url END) AS duplicates, count(DISTINCT CASE WHEN {ALLOWED} THEN url END) AS kept FROM discovered""")
def filter_stats(spark, d):
    return crawl.filter_stats(table(spark, d, "discovered"), RULES)


@query(f"SELECT f.fetch_id, coalesce(o.source, 'sitemap') AS source, o.lastmod, o.priority FROM fetches f LEFT JOIN {Q.ONCE} o ON o.url = f.url WHERE f.status_code = 200 AND f.html IS NOT NULL")
def fetched_with_meta(spark, d):
    return crawl.fetched_with_meta(table(spark, d, "fetches"), crawl.dedupe_discovered(table(spark, d, "discovered"))).select("fetch_id", "source", "lastmod", "priority")


LISTED = f"""listed AS (SELECT *, row_number() OVER (PARTITION BY {Q.CANON} ORDER BY ord) AS n FROM docs WHERE url IS NOT NULL),
known AS (SELECT DISTINCT {Q.CANON} AS key FROM {Q.ONCE}),
new AS (SELECT DISTINCT {Q.NORM} AS url FROM listed WHERE n = 1 AND {Q.CANON} NOT IN (SELECT key FROM known))"""


def _merged(spark, d):
    """The documents' urls stand for those of a site's overview file."""
    listed = table(spark, d, "docs").select("url", F.col("ord").alias("place"))
    return crawl.merge_listed(crawl.dedupe_discovered(table(spark, d, "discovered")), listed, RULES)


@query(f"WITH {LISTED} SELECT url, source FROM {Q.ONCE} UNION ALL SELECT url, 'llms' FROM new WHERE {ALLOWED}")
def listed_merge(spark, d):
    return _merged(spark, d)[0].select("url", "source")


@query(f"WITH {LISTED} SELECT url FROM new WHERE NOT {ALLOWED}")
def listed_blocked(spark, d):
    return _merged(spark, d)[1].select("url")


@query(f"""SELECT url, sha256(text) AS content_hash, source, page_type FROM (SELECT url, text, 'overview' AS source, 'overview' AS page_type FROM (
  SELECT url, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index, chunk_id) AS text FROM (SELECT DISTINCT url, text, chunk_index, chunk_id FROM chunks WHERE url = '{OVERVIEW}' AND text IS NOT NULL) GROUP BY url))""")
def overview_documents(spark, d):
    """The overview page put together from its chunks: it is one document by nature, and the only page that is gathered."""
    c = table(spark, d, "chunks").where((F.col("url") == OVERVIEW) & F.col("text").isNotNull()).select("url", "text", "chunk_index", "chunk_id").distinct()
    t = c.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text"))).alias("c")).select("url", F.array_join(F.col("c.text"), "\n\n").alias("text"))
    return chunking.overview_documents(t).select("url", "content_hash", "source", "page_type")


@query(f"SELECT fetch_id, {OK_FETCH} AS ok, coalesce(status_code >= 400 AND status_code < 500 AND status_code <> 429, false) AS permanent, coalesce(status_code IN (429, 500, 502, 503, 504), false) OR coalesce(length(error), 0) > 0 AS transient FROM fetches")
def fetch_flags(spark, d):
    flag = lambda c: F.coalesce(c, F.lit(False))
    return table(spark, d, "fetches").select("fetch_id", flag(crawl.fetch_ok()).alias("ok"), flag(crawl.permanent_error()).alias("permanent"), crawl.transient_error().alias("transient"))


@query(f"SELECT count(*) FILTER ({OK_FETCH}) AS ok, count(*) AS fetched FROM fetches")
def fetch_counts(spark, d):
    return table(spark, d, "fetches").agg(F.count_if(crawl.fetch_ok()).alias("ok"), F.count("*").alias("fetched"))


@query("SELECT count(*) AS chunks, count(*) FILTER (source = 'overview') AS overview FROM chunks")
def index_counts(spark, d):
    return index.overview_count(table(spark, d, "chunks"))


SAFE = "translate(replace(run_id, '+', ''), ':.', '--')"


@query(f"SELECT name, run_id, partial, CAST(row_number() OVER (ORDER BY name DESC) AS INT) AS nth FROM (SELECT 'report_' || {SAFE} || '.json' AS name, run_id, min(partial) AS partial FROM crawl_reports WHERE run_id IS NOT NULL GROUP BY ALL)")
def report_listing(spark, d):
    return R.listing(table(spark, d, "crawl_reports"))


@query(f"SELECT run_id, max(fetched) AS fetched FROM crawl_reports WHERE NOT coalesce(partial, false) AND {SAFE} = (SELECT max({SAFE}) FROM crawl_reports WHERE NOT coalesce(partial, false)) GROUP BY run_id")
def latest_full_report(spark, d):
    """Reports are saved, listed and read again; of one run the last finished counts."""
    path = staging(spark)
    once = table(spark, d, "crawl_reports").where("run_id is not null").groupBy("run_id", "partial").agg(F.max("fetched").alias("fetched"))
    one = once.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy(F.coalesce("partial", F.lit(False)), F.desc("fetched")))).where("n = 1").drop("n")
    R.save_reports(one, path)
    return R.latest_full(R.load_reports(spark, path, "run_id string, partial boolean, fetched int")).select("run_id", "fetched")


@query("SELECT run_id, started_at, discovered, fetched, drop_alert, partial FROM crawl_reports")
def report_records(spark, d):
    """Reports as JSON records and back."""
    schema = "run_id string, started_at timestamp, discovered int, fetched int, drop_alert boolean, partial boolean, unknown string"
    return R.from_records(R.to_records(table(spark, d, "crawl_reports")), schema).drop("unknown")


@query(f"SELECT url, status AS reason, http_code AS status_code, error FROM ({Q.RECORDS}) WHERE status IN ('failed_permanent','failed_transient','not_attempted')")
def staged_failures(spark, d):
    path = staging(spark)
    R.save_failures(crawl.failures(Q._records(spark, d)), path)
    return R.load_failures(spark, path)


@query(f"SELECT DISTINCT url, 'sitemap' AS source, {Q.TYPE} AS page_type FROM ({Q.RECORDS}) WHERE status IN ('failed_permanent','failed_transient','not_attempted') AND url IS NOT NULL")
def retry_targets(spark, d):
    return crawl.retry_targets(crawl.failures(Q._records(spark, d))).select("url", "source", "page_type")


FINAL_CANON = Q.CANON.replace("regexp_extract(url,", "regexp_extract(final_url,")


@query(f"SELECT origin, max(target) AS target FROM (SELECT {Q.CANON} AS origin, {FINAL_CANON} AS target FROM ({Q.RECORDS}) WHERE status = 'redirected' AND final_url IS NOT NULL) WHERE origin <> target GROUP BY origin")
def staged_aliases(spark, d):
    """Aliases saved, merged with those of a second run and read again."""
    path = staging(spark)
    new = crawl.aliases_of(Q._records(spark, d))
    R.save_aliases(crawl.merge_aliases(R.load_aliases(spark, path), new), path)
    R.save_aliases(crawl.merge_aliases(R.load_aliases(spark, path), new), path)
    return R.load_aliases(spark, path)


@query("SELECT url, lastmod, priority, source, page_type FROM discovered")
def staged_discovery(spark, d):
    """The listing as JSON lines and back."""
    path = staging(spark)
    sitemap.save_discovered(table(spark, d, "discovered").select("url", "lastmod", "priority", "changefreq", "source", "page_type"), f"{path}/discovery")
    return sitemap.load_discovered(spark, f"{path}/discovery").select("url", "lastmod", "priority", "source", "page_type")


@query(f"SELECT left(sha256({Q.NORM}), 16) AS url_hash, url FROM fetches")
def staged_pages(spark, d):
    """Raw pages stored under the hash of their url, and listed."""
    path = staging(spark)
    sitemap.save_pages(table(spark, d, "fetches"), f"{path}/pages")
    return sitemap.listed_pages(spark, f"{path}/pages")


@query(f"SELECT url, CASE WHEN status = 'failed_permanent' THEN 'deindexed' END AS action FROM ({Q.RECORDS})")
def deindex_actions(spark, d):
    return crawl.with_actions(Q._records(spark, d)).select("url", "action")


@query("""SELECT kind, name, n, CAST(row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'source' THEN 0 ELSE -n END, name) AS INT) AS nth FROM (
  SELECT 'source' AS kind, coalesce(source, 'unknown') AS name, count(*) AS n FROM discovered GROUP BY ALL UNION ALL SELECT 'page_type', coalesce(page_type, 'unknown'), count(*) FROM discovered GROUP BY ALL)""")
def discovery_order(spark, d):
    """The summary in the order it is shown: sources by name, page types by count."""
    s = crawl.discovery_summary(table(spark, d, "discovered")).where("level < 3")
    rows = s.select(F.when(F.col("level") == 1, "source").otherwise("page_type").alias("kind"), F.coalesce("source", "page_type").alias("name"), "n")
    w = Window.partitionBy("kind").orderBy(F.when(F.col("kind") == "source", 0).otherwise(-F.col("n")), "name")
    return rows.withColumn("nth", F.row_number().over(w))


@query(f"""WITH r AS ({Q.RECORDS}), last AS (SELECT run_id, fetched + redirected AS before FROM (SELECT *, row_number() OVER (ORDER BY run_id DESC, finished_at DESC) AS n FROM crawl_reports WHERE NOT partial AND finished_at IS NOT NULL) WHERE n = 1),
key AS (SELECT {Q.CANON} AS key, min(CASE WHEN status IN ('fetched', 'redirected') THEN 0 ELSE 1 END) AS bad FROM r GROUP BY 1),
gaps AS (SELECT count(*) AS g FROM (SELECT DISTINCT {Q.CANON} AS key FROM docs WHERE url IS NOT NULL) l LEFT JOIN key ON key.key = l.key WHERE bad IS NULL OR bad = 1),
c AS (SELECT count(*) AS discovered, count(*) FILTER (status = 'fetched') AS fetched, count(*) FILTER (status = 'redirected') AS redirected, count(*) FILTER (status = 'failed_permanent') AS failed_permanent, count(*) FILTER (status = 'failed_transient') AS failed_transient, count(*) FILTER (status = 'not_attempted') AS not_attempted FROM r)
SELECT 'run-next' AS run_id, c.*, 0 AS robots_excluded, g AS coverage_gaps, failed_permanent AS deindexed, fetched + redirected - before AS page_count_delta, before > 0 AND (before - fetched - redirected) / CAST(before AS DOUBLE) > 0.05 AS drop_alert, false AS partial FROM c, gaps, last""")
def crawl_report(spark, d):
    """The whole report of a run after all others."""
    done = table(spark, d, "crawl_reports").where("finished_at is not null")
    last = done.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("finished_at")))).where("n = 1")
    found = crawl.dedupe_discovered(table(spark, d, "discovered"))
    none = table(spark, d, "docs").where("false").select("url")
    return crawl.report("run-next", found, table(spark, d, "fetches"), table(spark, d, "docs").where("url is not null").select("url"), none, last.select("run_id", "fetched", "redirected", "partial"))


@query("""SELECT url, source, ord FROM docs WHERE coalesce(source, '') <> 'blog-sitemap' UNION ALL
SELECT url, source, ord FROM (SELECT url, source, ord, row_number() OVER (PARTITION BY url ORDER BY ord) AS n FROM docs WHERE source = 'blog-sitemap' AND url NOT IN (SELECT url FROM docs WHERE coalesce(source, '') <> 'blog-sitemap' AND url IS NOT NULL)) WHERE n = 1""")
def blog_merge(spark, d):
    docs = table(spark, d, "docs").select("url", "source", "ord")
    blog = F.coalesce(F.col("source"), F.lit("")) == "blog-sitemap"
    return crawl.merge_missing(docs.where(~blog), docs.where(blog), order="ord")


# --- extraction and documents


def _text(x: str) -> str:
    return squeezed_sql(Q.entities_sql(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"))


@query(rf"""WITH d AS (SELECT fetch_id, 0 AS c, i, {_text("regexp_extract(x, '(?is)<summary[^>]*>(.*?)</summary>', 1)")} AS question, {_text("regexp_extract(x, '(?is)</summary>(.*)</details>', 1)")} AS answer
  FROM (SELECT fetch_id, unnest(m) AS x, generate_subscripts(m, 1) AS i FROM (SELECT fetch_id, regexp_extract_all(html, '(?is)<details[^>]*>.*?</details>') AS m FROM fetches WHERE html IS NOT NULL))),
l AS (SELECT fetch_id, 2 AS c, i, {_text("regexp_extract(x, '(?is)<dt[^>]*>(.*?)(?:</dt>|<dd)', 1)")} AS question, {_text("regexp_extract(x, '(?is)<dd[^>]*>(.*?)(?:</dd>|</dl>|$)', 1)")} AS answer
  FROM (SELECT fetch_id, unnest(m) AS x, generate_subscripts(m, 1) AS i FROM (SELECT fetch_id, regexp_extract_all(html, '(?is)<dt[^>]*>.*?</?dt?[^>]*>\s*<dd[^>]*>.*?(?:</dd>|</dl>)') AS m FROM fetches WHERE html IS NOT NULL)))
SELECT fetch_id, question, first(answer ORDER BY c, i) AS answer FROM (SELECT * FROM d UNION ALL SELECT * FROM l) WHERE question <> '' AND answer <> '' GROUP BY ALL""")
def page_pairs(spark, d):
    """Questions and answers found in pages. The tables have disclosure boxes and definition lists; boxes by class are tested apart."""
    p = extract.extracted(table(spark, d, "fetches").where("html is not null").select("fetch_id", "html"))
    return p.select("fetch_id", F.explode("faq_pairs").alias("p")).select("fetch_id", "p.question", "p.answer")


@query("SELECT url, question, first(answer ORDER BY ord, i) AS answer FROM (SELECT url, ord, i, faq_pairs[i].question AS question, faq_pairs[i].answer AS answer FROM (SELECT url, ord, faq_pairs, unnest(generate_series(1, len(faq_pairs))) AS i FROM docs WHERE len(faq_pairs) > 0)) WHERE trim(question) <> '' AND trim(answer) <> '' GROUP BY ALL")
def pairs_once(spark, d):
    p = table(spark, d, "docs").select("url", "ord", F.posexplode("faq_pairs").alias("place", "p")).select("url", "ord", "place", "p.question", "p.answer")
    return extract.pairs_once(p, "url", "ord", "place").select("url", "question", "answer")


@query()
def extracted_pages(spark, d):
    """Title, Markdown and pairs of every good page; tested on written pages."""
    return extract.extracted(table(spark, d, "fetches").where(crawl.fetch_ok()).select("fetch_id", "final_url", "html")).select("fetch_id", "title", "markdown", F.size("faq_pairs").alias("pairs"), "method")


def _documents(spark, d):
    meta = crawl.fetched_with_meta(crawl.latest_fetch(table(spark, d, "fetches").where(crawl.fetch_ok())), crawl.dedupe_discovered(table(spark, d, "discovered")))
    return extract.documents(extract.extracted(meta.select("url", "final_url", "html", "source", "lastmod", "priority")))


@query()
def normalized_documents(spark, d):
    """Documents of all good pages, once by url and by near-duplicate group."""
    return extract.normalized(_documents(spark, d)).select("url", "title", "page_type", "content_hash", "source")


@query(f"SELECT ord, {Q.CANON.replace('regexp_extract(url,', 'regexp_extract(original_url,')} AS url, {squeezed_sql('lower(markdown)').replace('trim(', 'sha256(trim(', 1)}) AS content_hash FROM docs WHERE original_url IS NOT NULL AND regexp_replace(markdown, '{Q.WS}', '', 'g') <> ''")
def document_fields(spark, d):
    """Canonical url and content hash of pages as they would be stored."""
    p = table(spark, d, "docs").where("original_url is not null").select("ord", F.col("original_url").alias("final_url"), F.col("original_url").alias("url"), "title", "markdown", "faq_pairs", "source", "lastmod", "priority")
    key = table(spark, d, "docs").select("ord", "original_url", "markdown")
    docs = extract.documents(p).select(F.col("original_url"), F.col("url"), "markdown", "content_hash").distinct()
    return key.join(docs, ["original_url", "markdown"]).select("ord", "url", "content_hash")


@query("SELECT DISTINCT chunk_id, url, chunk_index, left(sha256(concat_ws('::', coalesce(url, ''), chunk_index::VARCHAR, left(text, 64))), 16) AS made FROM chunks WHERE text IS NOT NULL")
def chunk_ids(spark, d):
    c = table(spark, d, "chunks").where("text is not null")
    return c.select("chunk_id", "url", "chunk_index", T.chunk_id(F.coalesce("url", F.lit("")), F.col("chunk_index"), F.col("text")).alias("made")).distinct()


VISIBLE = "html"
for _tag in ("script", "style", "nav", "footer", "header", "noscript"):
    VISIBLE = rf"regexp_replace({VISIBLE}, '(?is)<{_tag}\b.*?</{_tag}\s*>', ' ', 'g')"
VISIBLE = squeezed_sql(Q.entities_sql(f"regexp_replace({VISIBLE}, '(?s)<[^>]*>', ' ', 'g')"))
PHRASES = ["price", "pricing", "contact", "faq", "support", "service", "report"]


@query(f"SELECT fetch_id, length({VISIBLE}) AS chars, array_to_string(list_filter({PHRASES}, lambda p: contains(lower({VISIBLE}), p)), '|') AS phrases FROM fetches WHERE html IS NOT NULL")
def visible_texts(spark, d):
    v = table(spark, d, "fetches").where("html is not null").select("fetch_id", T.visible_text(F.col("html")).alias("v"))
    return v.select("fetch_id", F.length("v").cast("long").alias("chars"), F.array_join(T.phrases_in(F.col("v"), PHRASES), "|").alias("phrases"))


@query(f"""SELECT url, coalesce(max(CASE WHEN render_method <> 'httpx' THEN n END) / greatest(coalesce(max(CASE WHEN render_method = 'httpx' THEN n END), 0), 1)::DOUBLE > 1.2, false) AS needs
FROM (SELECT url, render_method, length({VISIBLE}) AS n FROM fetches WHERE html IS NOT NULL) GROUP BY url""")
def rendering_needs(spark, d):
    """Pages of which a browser saw a fifth more text than plain fetching."""
    v = table(spark, d, "fetches").where("html is not null").select("url", "render_method", F.length(T.visible_text(F.col("html"))).alias("n"))
    plain = F.col("render_method") == "httpx"
    g = v.groupBy("url").agg(F.coalesce(F.max(F.when(plain, F.col("n"))), F.lit(0)).alias("a"), F.max(F.when(~plain, F.col("n"))).alias("b"))
    return g.select("url", crawl.needs_rendering(F.col("a"), F.col("b")).alias("needs"))


@query("SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name NOT IN ('FRANCE', 'CHINA')")
def country_filter(spark, d):
    from quernstone.operators import state

    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations
    return c.where(state.country_allowed(F.col("n_name"), ["FRANCE", "CHINA"])).select("c_custkey")


# --- the stored indexes


@query("SELECT url, count(*) AS chunks FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY content_hash DESC NULLS LAST) AS n FROM chunks WHERE chunk_id IS NOT NULL) WHERE n = 1) WHERE url IS NULL OR url NOT IN (SELECT url FROM fetches WHERE status_code IN (404, 410)) GROUP BY url")
def index_lifecycle(spark, d):
    """The chunk index built, read, freed of pages that are gone, and read again."""
    ix = index.ChunkIndex(spark, f"{staging(spark)}/chunks")
    ix.rebuild(table(spark, d, "chunks"))
    ix.delete(table(spark, d, "fetches").where("status_code in (404, 410)").select("url"))
    return ix.read().groupBy("url").agg(F.count("*").alias("chunks"))


def _index(spark, d):
    chunks, queries = Q._searchable(spark, d)
    ix = ann.SearchIndex(spark, f"{staging(spark)}/search")
    ix.build(chunks)
    return ix, queries


@query(Q.HYBRID.split("\nl AS (SELECT")[0].rstrip().rstrip(",") + " SELECT query_id, chunk_id, score FROM f WHERE rank <= 20")
def indexed_text_search(spark, d):
    """BM25 from the stored postings."""
    ix, queries = _index(spark, d)
    return ix.by_text(queries).select("query_id", "chunk_id", "score")


@query()
def indexed_vector_search(spark, d):
    """Nearest vectors by cells; their recall against the exact search is tested."""
    ix, queries = _index(spark, d)
    return ix.by_vector(queries).select("query_id", "chunk_id", "distance", "rank")


@query()
def smoke_search(spark, d):
    """The first query in both searches of the stored index."""
    ix, queries = _index(spark, d)
    return ix.smoke(queries.orderBy("query_id").limit(1))


