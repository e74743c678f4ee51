"""Queries of the core's operators over whole tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import chat as C
from quernstone.functions import text as T
from quernstone.functions import url as U
from quernstone.operators import chunking, crawl, graph, index, retrieval, state
from quernstone.runtime import kept, table
from quernstone.sources import sitemap

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
WS = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- urls

PATH = "regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
NORM = rf"""lower(regexp_extract(url, '^([^:/?#]+:)?(//[^/?#]*)?', 0)) || {PATH} ||
  CASE WHEN regexp_replace(regexp_replace(regexp_extract(url, '\?([^#]*)', 1), '(^|&)(?i:utm_[^=&]*|gclid|fbclid|msclkid)(=[^&]*)?', '', 'g'), '^&', '') = '' THEN ''
       ELSE '?' || regexp_replace(regexp_replace(regexp_extract(url, '\?([^#]*)', 1), '(^|&)(?i:utm_[^=&]*|gclid|fbclid|msclkid)(=[^&]*)?', '', 'g'), '^&', '') END"""
QUERY = f"substr({NORM}, length(split_part({NORM}, '?', 1)) + 1)"
CANON = f"(lower(split_part({NORM}, '?', 1)) || {QUERY})"
TYPE = f"CASE {' '.join(f'''WHEN regexp_matches({PATH}, '{p}') THEN '{t}' ''' for p, t in U.PAGE_TYPES)} ELSE 'other' END"


ROOTS = "(SELECT ord, url FROM discovered WHERE url IS NOT NULL UNION ALL SELECT DISTINCT -1, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || '/' FROM discovered WHERE regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) <> '')"


@query(f"""
SELECT ord, {NORM} AS url, {TYPE} AS page_type,
  coalesce(nullif(left(regexp_replace(regexp_replace({PATH}, '^/+|/+$', '', 'g'), '[^a-zA-Z0-9_-]', '_', 'g'), 120), ''), 'index') AS slug,
  left(sha256({NORM}), 16) AS url_hash
FROM {ROOTS}""")
def url_keys(spark, d):
    """Of every listing, and of every site's root."""
    u = F.col("url")
    df = table(spark, d, "discovered").where("url is not null").select("ord", "url")
    roots = df.select(F.lit(-1).alias("ord"), F.concat(F.regexp_extract("url", r"^([^:/?#]+://[^/?#]*)", 1), F.lit("/")).alias("url")).where("url <> '/'").distinct()
    return df.unionByName(roots).select("ord", U.normalize(u).alias("url"), U.page_type(u).alias("page_type"), U.slug(u).alias("slug"), U.url_hash(u).alias("url_hash"))


@query("SELECT fetch_id, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']*)', 1))) AS href FROM fetches WHERE html IS NOT NULL")
def page_hrefs(spark, d):
    return table(spark, d, "fetches").where("html is not null").select("fetch_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)"), F.lit(1)))).alias("href"))


URLS = r"""[regexp_replace(u, '[.,;:)\]}]+$', '') for u in regexp_extract_all(text, 'https://[^\s)\]>"'']+')]"""


@query(f"SELECT id, unnest(list_distinct({URLS})) AS url FROM (SELECT DISTINCT id, answer AS text FROM feedback WHERE answer LIKE '%https://%')")
def text_urls(spark, d):
    return table(spark, d, "feedback").where(F.col("answer").contains("https://")).select("id", "answer").distinct().select("id", F.explode(U.urls_in(F.col("answer"))).alias("url"))


# --- discovery and reconciliation

SOURCE = "coalesce(source, 'unknown')"


@query(f"""
SELECT CAST(grouping(s, p) AS INT) AS level, s AS source, p AS page_type, count(*) AS n
FROM (SELECT {SOURCE} AS s, coalesce(page_type, 'unknown') AS p FROM discovered) GROUP BY GROUPING SETS ((s), (p), ())""")
def discovery_summary(spark, d):
    return crawl.discovery_summary(table(spark, d, "discovered"))


@query("SELECT url, source, ord FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN coalesce(source,'') = 'bfs' THEN 1 ELSE 0 END, ord) AS n FROM discovered) WHERE n = 1")
def discovered_once(spark, d):
    return crawl.dedupe_discovered(table(spark, d, "discovered")).select("url", "source", "ord")


@query("""SELECT url, ord FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY
  CASE source WHEN 'sitemap' THEN 0 WHEN 'blog-sitemap' THEN 0 WHEN 'bfs' THEN 1 WHEN 'overview' THEN 2 ELSE 99 END, coalesce(nullif(priority, 0), 0.5) DESC, ord) AS n FROM docs) WHERE n = 1""")
def docs_once(spark, d):
    return crawl.dedupe_docs(table(spark, d, "docs")).select("url", "ord")


STATUS = """CASE WHEN coalesce(status_code IN (429,500,502,503,504), false) OR coalesce(length(error), 0) > 0 THEN 'failed_transient'
  WHEN status_code >= 400 AND status_code < 500 AND status_code <> 429 THEN 'failed_permanent'
  WHEN status_code = 200 THEN CASE WHEN final_url <> url THEN 'redirected' ELSE 'fetched' END
  WHEN status_code >= 400 AND status_code < 500 THEN 'failed_permanent' ELSE 'failed_transient' END"""
CADENCE = """CASE WHEN lower(coalesce(changefreq,'')) IN ('always','hourly','daily','weekly') THEN 'weekly' WHEN lower(coalesce(changefreq,'')) = 'monthly' THEN 'monthly'
  WHEN lower(coalesce(changefreq,'')) IN ('yearly','never') THEN 'yearly' WHEN priority IS NOT NULL THEN CASE WHEN priority >= 0.7 THEN 'weekly' WHEN priority >= 0.4 THEN 'monthly' ELSE 'yearly' END ELSE 'weekly' END"""
ONCE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN coalesce(source,'') = 'bfs' THEN 1 ELSE 0 END, ord) AS n FROM discovered) WHERE n = 1)"
LAST = f"(SELECT url AS furl, {STATUS} AS status, status_code, final_url, error FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, fetch_id DESC) AS n FROM fetches) WHERE n = 1)"
RECORDS = f"""SELECT d.url, coalesce(f.status, 'not_attempted') AS status, f.status_code AS http_code, CASE WHEN f.final_url <> d.url THEN f.final_url END AS final_url, f.error, {CADENCE} AS suggested_cadence
FROM {ONCE} d LEFT JOIN {LAST} f ON f.furl = d.url"""


def _records(spark, d):
    return crawl.reconcile(crawl.dedupe_discovered(table(spark, d, "discovered")), table(spark, d, "fetches"))


@query(RECORDS)
def reconcile(spark, d):
    return _records(spark, d)


@query(f"""SELECT count(*) AS discovered, {', '.join(f"count(*) FILTER (status = '{k}') AS {k}" for k in ('fetched', 'redirected', 'failed_permanent', 'failed_transient', 'not_attempted'))} FROM ({RECORDS})""")
def status_counts(spark, d):
    return crawl.status_counts(_records(spark, d))


@query(f"SELECT url, status AS reason, http_code AS status_code, error FROM ({RECORDS}) WHERE status IN ('failed_permanent','failed_transient','not_attempted')")
def failures(spark, d):
    return crawl.failures(_records(spark, d))


@query("""
WITH r AS (SELECT run_id, fetched + redirected AS ok, partial FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY finished_at DESC NULLS LAST) AS n FROM crawl_reports) WHERE n = 1),
b AS (SELECT *, last_value(CASE WHEN NOT partial THEN ok END IGNORE NULLS) OVER (ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT run_id, ok AS ok_pages, partial, CASE WHEN NOT partial THEN ok - before END AS page_count_delta,
  coalesce(NOT partial AND before > 0 AND (before - ok) / CAST(before AS DOUBLE) > 0.05, false) AS drop_alert FROM b""")
def drop_alerts(spark, d):
    w = Window.partitionBy("run_id").orderBy(F.desc_nulls_last("finished_at"))
    return crawl.drop_alerts(table(spark, d, "crawl_reports").withColumn("n", F.row_number().over(w)).where("n = 1"))


ROBOTS = "User-agent: *\nDisallow: /hire-\nAllow: /services/\nDisallow: /s\nDisallow: /legal\nCrawl-delay: 2\n"


@query(f"SELECT url, ord FROM discovered WHERE CASE WHEN starts_with({PATH}, '/hire-') THEN false WHEN starts_with({PATH}, '/services/') THEN true WHEN starts_with({PATH}, '/s') THEN false WHEN starts_with({PATH}, '/legal') THEN false ELSE true END")
def robots_filter(spark, d):
    return crawl.robots_allowed(table(spark, d, "discovered"), crawl.robots_rules(ROBOTS)[0]).select("url", "ord")


@query(f"""
WITH rec AS ({RECORDS}), listed AS (SELECT DISTINCT {CANON} AS key FROM docs WHERE url IS NOT NULL),
r AS (SELECT {CANON} AS key, min(CASE WHEN status IN ('fetched','redirected') THEN 0 ELSE 1 END) AS bad FROM rec GROUP BY 1),
b AS (SELECT DISTINCT {CANON} AS key FROM docs WHERE page_type = 'legal' AND url IS NOT NULL)
SELECT l.key AS url, CASE WHEN b.key IS NOT NULL THEN 'robots_blocked' WHEN bad = 1 THEN 'fetch_failed' ELSE 'not_attempted' END AS reason
FROM listed l LEFT JOIN r ON r.key = l.key LEFT JOIN b ON b.key = l.key WHERE bad IS NULL OR bad = 1""")
def coverage_gaps(spark, d):
    docs = table(spark, d, "docs").where("url is not null")
    return crawl.coverage_gaps(docs.select("url"), _records(spark, d), docs.where("page_type = 'legal'").select("url"))


@query(f"""
WITH rec AS ({RECORDS}), a AS (SELECT lower({NORM}) AS origin, min(lower(regexp_replace(final_url, '[?#].*$', ''))) AS target FROM rec WHERE status = 'redirected' GROUP BY 1),
gone AS (SELECT DISTINCT coalesce(CASE WHEN a.target <> a.origin THEN a.target END, k.key) AS key FROM (SELECT DISTINCT lower({NORM}) AS key FROM rec WHERE status = 'failed_permanent') k LEFT JOIN a ON a.origin = k.key)
SELECT url, count(*) AS chunks FROM chunks WHERE url IS NULL OR lower(url) NOT IN (SELECT key FROM gone) GROUP BY url""")
def deindexed(spark, d):
    rec = _records(spark, d)
    moved = rec.where("status = 'redirected'").groupBy(U.canonical(F.col("url")).alias("origin")).agg(F.min(F.lower(F.regexp_replace("final_url", r"[?#].*$", ""))).alias("target"))
    aliases = crawl.merge_aliases(spark.createDataFrame([], "origin string, target string"), moved)
    return crawl.deindex(table(spark, d, "chunks"), rec, aliases).groupBy("url").agg(F.count("*").alias("chunks"))


# --- documents and chunks


@query(rf"SELECT ord, sha256(trim(regexp_replace(lower(markdown), '{WS}+', ' ', 'g'))) AS hash, CAST(CASE WHEN trim(regexp_replace(markdown, '{WS}+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(markdown, '{WS}+', ' ', 'g')), ' ')) END AS INT) AS words, greatest(1, CAST(floor(length(markdown) / 4) AS INT)) AS tokens FROM docs WHERE markdown IS NOT NULL")
def content_hashes(spark, d):
    m = F.col("markdown")
    return table(spark, d, "docs").where(m.isNotNull()).select("ord", T.content_hash(m).alias("hash"), T.word_count(m).alias("words"), T.approx_tokens(m).alias("tokens"))


def entities_sql(x: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&#160;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def squeezed_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


RAW_TITLE = squeezed_sql(entities_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
RAW_H1 = squeezed_sql(entities_sql("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"))


@query(rf"""SELECT fetch_id, coalesce(nullif(trim(regexp_replace(t, '\s*[|\-–—]\s*[^|\-–—]+$', '')), ''), nullif(t, ''), h1) AS title
FROM (SELECT fetch_id, {RAW_TITLE} AS t, {RAW_H1} AS h1 FROM fetches WHERE html IS NOT NULL)""")
def page_titles(spark, d):
    return table(spark, d, "fetches").where("html is not null").select("fetch_id", T.page_title(F.col("html")).alias("title"))


@query("SELECT url, ord, CAST(i - 1 AS INT) AS pos, 'Q: ' || faq_pairs[i].question || chr(10) || 'A: ' || coalesce(faq_pairs[i].answer, '') AS text FROM (SELECT url, ord, faq_pairs, unnest(generate_series(1, len(faq_pairs))) AS i FROM docs WHERE faq_pairs IS NOT NULL AND len(faq_pairs) > 0) WHERE faq_pairs[i].question IS NOT NULL")
def faq_chunks(spark, d):
    df = table(spark, d, "docs").select("url", "ord", F.posexplode("faq_pairs").alias("pos", "p")).where("p.question is not null")
    return df.select("url", "ord", "pos", F.concat(F.lit("Q: "), F.col("p.question"), F.lit("\nA: "), F.coalesce(F.col("p.answer"), F.lit(""))).alias("text"))


@query(r"""SELECT ord, count(*) AS sections FROM (SELECT ord, unnest(string_split(regexp_replace(replace(markdown, chr(13) || chr(10), chr(10)), '(?m)^(#{1,6}\s+\S)', chr(1) || '\1', 'g'), chr(1))) AS s FROM docs WHERE markdown IS NOT NULL)
WHERE regexp_matches(s, '\S') GROUP BY ord""")
def heading_sections(spark, d):
    return table(spark, d, "docs").where("markdown is not null").select("ord", F.size(T.sections(F.col("markdown"))).cast("long").alias("sections")).where("sections > 0")


SECTIONS = r"""string_split(regexp_replace(replace(markdown, chr(13) || chr(10), chr(10)), '(?m)^(#{1,6}\s+\S)', chr(1) || '\1', 'g'), chr(1))"""
TRIMMED = f"regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')"
DOCS_ONCE = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY
  CASE source WHEN 'sitemap' THEN 0 WHEN 'blog-sitemap' THEN 0 WHEN 'bfs' THEN 1 WHEN 'overview' THEN 2 ELSE 99 END, coalesce(nullif(priority, 0), 0.5) DESC, ord) AS n FROM docs) WHERE n = 1)"""
CHUNKED = f"""
parts AS (
  SELECT url, title, page_type, source, 0 AS kind, i AS pos, 'Q: ' || faq_pairs[i].question || chr(10) || 'A: ' || coalesce(faq_pairs[i].answer, '') AS text
  FROM (SELECT *, unnest(generate_series(1, len(faq_pairs))) AS i FROM {DOCS_ONCE} WHERE len(faq_pairs) > 0) WHERE faq_pairs[i].question IS NOT NULL
  UNION ALL
  SELECT url, title, page_type, source, 1 AS kind, i AS pos, {TRIMMED} AS text
  FROM (SELECT *, unnest({SECTIONS}) AS x, generate_subscripts({SECTIONS}, 1) AS i FROM {DOCS_ONCE} WHERE markdown IS NOT NULL) WHERE {TRIMMED} <> ''),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY url ORDER BY kind, pos) - 1 AS INT) AS chunk_index FROM parts)"""


@query(f"""WITH {CHUNKED} SELECT left(sha256(concat_ws('::', url, chunk_index::VARCHAR, left(text, 64))), 16) AS chunk_id, url, title, page_type, sha256(text) AS content_hash, text, chunk_index, source, kind = 0 AS is_faq FROM numbered""")
def chunk_documents(spark, d):
    """SQL does without the cutting of long sections: no section of the tables is longer than a chunk. That is tested apart."""
    return chunking.chunk_documents(crawl.dedupe_docs(table(spark, d, "docs")))


NEAR = r"""
w AS (SELECT ord, regexp_extract_all(lower(markdown), '[\p{L}\p{N}_]+') AS w FROM docs WHERE length(markdown) > 0),
sh AS (SELECT DISTINCT ord, CASE WHEN len(w) < 3 THEN w[i] ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
       FROM (SELECT ord, w, unnest(generate_series(1, CASE WHEN len(w) < 3 THEN len(w) ELSE len(w) - 2 END)) AS i FROM w)),
n AS (SELECT ord, count(*) AS n FROM sh GROUP BY ord),
near AS (SELECT a.ord AS a, b.ord AS b FROM sh a JOIN sh b ON a.g = b.g AND a.ord < b.ord JOIN n x ON x.ord = a.ord JOIN n y ON y.ord = b.ord
         GROUP BY a.ord, b.ord, x.n, y.n HAVING count(*) / CAST(x.n + y.n - count(*) AS DOUBLE) >= 0.85),
sym AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT a AS id, a AS r FROM sym UNION SELECT b.b AS id, reach.r FROM reach JOIN sym b ON b.a = reach.id),
groups AS (SELECT id, min(r) AS component FROM reach GROUP BY id)
"""
COLLAPSED = """(SELECT ord, url FROM (SELECT d.*, row_number() OVER (PARTITION BY coalesce(g.component, d.ord) ORDER BY
  CASE d.source WHEN 'sitemap' THEN 0 WHEN 'blog-sitemap' THEN 0 WHEN 'bfs' THEN 1 WHEN 'overview' THEN 2 ELSE 99 END, coalesce(nullif(d.priority, 0), 0.5) DESC, d.url, d.ord) AS n
  FROM docs d LEFT JOIN groups g ON g.id = d.ord) WHERE n = 1)"""


@query(f"WITH RECURSIVE {NEAR} SELECT id, component FROM groups")
def near_duplicate_pages(spark, d):
    return graph.near_duplicate_groups(table(spark, d, "docs"))


@query(f"WITH RECURSIVE {NEAR} SELECT ord, url FROM {COLLAPSED}")
def collapsed_pages(spark, d):
    docs = table(spark, d, "docs").select("ord", "url", "source", "priority", "markdown")
    return graph.collapse(docs, graph.near_duplicate_groups(docs)).select("ord", "url")


@query(f"""WITH RECURSIVE {NEAR},
m AS (SELECT component, list_sort(list_distinct(list(d.url))) AS members FROM groups JOIN docs d ON d.ord = groups.id WHERE d.url IS NOT NULL GROUP BY component)
SELECT component, CAST(len(members) AS INT) AS size, CAST(row_number() OVER (ORDER BY len(members) DESC, members) AS INT) AS nth, array_to_string(members, '|') AS members FROM m WHERE len(members) > 1""")
def group_listing(spark, d):
    docs = table(spark, d, "docs")
    return graph.group_listing(graph.near_duplicate_groups(docs), docs).withColumn("members", F.array_join("members", "|"))


@query(r"""SELECT ord, count(DISTINCT g) AS shingles FROM (SELECT ord, CASE WHEN len(w) < 3 THEN w[i] ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM (SELECT ord, w, unnest(generate_series(1, CASE WHEN len(w) < 3 THEN len(w) ELSE len(w) - 2 END)) AS i FROM (SELECT ord, regexp_extract_all(lower(markdown), '[\p{L}\p{N}_]+') AS w FROM docs WHERE markdown IS NOT NULL))) GROUP BY ord""")
def page_shingles(spark, d):
    return table(spark, d, "docs").where("markdown is not null").select("ord", F.size(T.shingles(F.col("markdown"))).cast("long").alias("shingles")).where("shingles > 0")


HREF = "(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']*)"
HOST = "regexp_replace(lower(regexp_extract({0}, '^[^:/?#]+://([^/?#]*)', 1)), ':[0-9]+$', '')"
LAST2 = "CASE WHEN len(string_split({0}, '.')) >= 2 THEN array_to_string(string_split({0}, '.')[-2:], '.') ELSE {0} END"
LINKS = f"""
raw AS (SELECT DISTINCT f.url AS src, trim({entities_sql('x')}) AS h FROM (SELECT url, unnest(regexp_extract_all(html, '{HREF.replace(chr(92) * 2, chr(92))}', 1)) AS x FROM fetches WHERE status_code = 200 AND html IS NOT NULL) f),
abs AS (SELECT src, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(src, '^[^:/?#]+:') || h
        WHEN starts_with(h, '/') THEN regexp_extract(src, '^[^:/?#]+://[^/?#]*') || h ELSE regexp_extract(src, '^[^:/?#]+://[^/?#]*') || '/' || h END AS url
        FROM raw WHERE h <> '' AND NOT regexp_matches(h, '(?i)^(#|mailto:|tel:|javascript:)')),
links AS (SELECT DISTINCT src, {NORM} AS dst FROM abs),
edges AS (SELECT src, dst FROM links WHERE {HOST.format('dst')} = '' OR {LAST2.format(HOST.format('dst'))} = {LAST2.format(HOST.format('src'))})
"""


@query(f"WITH {LINKS} SELECT src, dst FROM edges")
def internal_links(spark, d):
    return graph.page_links(table(spark, d, "fetches").where("status_code = 200").select("url", "html"))


@query(f"""WITH RECURSIVE {LINKS},
walk AS (SELECT DISTINCT url, 0 AS depth FROM docs WHERE page_type = 'faq' AND url IS NOT NULL UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.url WHERE w.depth < 4)
SELECT url, min(depth) AS depth FROM walk GROUP BY url""")
def reachable_pages(spark, d):
    edges = graph.page_links(table(spark, d, "fetches").where("status_code = 200").select("url", "html"))
    return graph.reachable(edges, table(spark, d, "docs").where("page_type = 'faq' and url is not null").select("url"))


UPSERT = """
WITH e AS (SELECT chunk_id, arg_max(url, coalesce(content_hash, '')) AS url, max(coalesce(content_hash, '')) AS h FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1),
src AS (SELECT * FROM chunk_runs WHERE run_id IS NOT NULL AND content_hash IS NOT NULL AND chunk_id IS NOT NULL),
r AS (SELECT DISTINCT run_id FROM src),
i AS (SELECT run_id, chunk_id, max(content_hash) AS h FROM src GROUP BY ALL),
t AS (SELECT DISTINCT run_id, url FROM src WHERE url IS NOT NULL),
x AS (SELECT r.run_id, e.* FROM r, e)
SELECT run_id, action, count(*) AS n FROM (
  SELECT coalesce(x.run_id, i.run_id) AS run_id, CASE WHEN x.h IS NULL THEN 'added' WHEN i.h IS NULL THEN CASE WHEN t.url IS NOT NULL THEN 'orphaned' ELSE 'kept' END WHEN x.h <> i.h THEN 'updated' ELSE 'skipped' END AS action
  FROM x FULL JOIN i ON i.chunk_id = x.chunk_id AND i.run_id = x.run_id LEFT JOIN t ON t.url = x.url AND t.run_id = x.run_id) GROUP BY ALL"""


@query(UPSERT)
def upsert_plan(spark, d):
    """What each run's batch, as delivered, would do to the index."""
    old = kept(index.one_per_key(table(spark, d, "chunks").select("chunk_id", "url", "content_hash")))
    new = table(spark, d, "chunk_runs").where("run_id is not null and content_hash is not null and chunk_id is not null").select("run_id", "chunk_id", "url", "content_hash")
    out = None
    for run in [r.run_id for r in new.select("run_id").distinct().orderBy("run_id").collect()]:  # one a crawl
        part = index.upsert_summary(index.upsert_actions(old, new.where(F.col("run_id") == run).drop("run_id"))).select(F.lit(run).alias("run_id"), "action", "n")
        out = part if out is None else out.unionByName(part)
    return out


# --- retrieval


def _embedded(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.query_id, e.vec_id AS id, round(sqrt((SELECT sum(power(CAST(a AS DOUBLE) - CAST(b AS DOUBLE), 2)) FROM (SELECT unnest(q.v) AS a, unnest(e.embedding) AS b))), 6) AS distance FROM q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM s)
SELECT query_id, id, distance FROM r WHERE rank <= 20""")
def vector_search(spark, d):
    e = _embedded(spark, d)
    found = retrieval.vector_top_k(e, e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"))
    return found.select("query_id", "id", "distance")


BM25 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL AND length(text) > 0),
dl AS (SELECT doc_id, len(w) AS dl FROM w WHERE len(w) > 0),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT doc_id AS query_id, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS term FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL),
s AS (SELECT q.query_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
      FROM q JOIN p ON p.term = q.term JOIN df ON df.term = q.term JOIN dl ON dl.doc_id = p.doc_id, st GROUP BY ALL)
"""


def _bm25(spark, d):
    docs = table(spark, d, "documents")
    return retrieval.bm25_top_k(docs.select("doc_id", "text"), docs.where("doc_id % 100 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query")))


@query(BM25 + "SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 20")
def text_search(spark, d):
    return _bm25(spark, d).select("query_id", "doc_id", "score")


@query(r"SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS uses FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents WHERE text IS NOT NULL) GROUP BY ALL) GROUP BY term")
def term_statistics(spark, d):
    return retrieval.postings(table(spark, d, "documents")).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("uses"))


RANKS = """
a AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, ord) AS rank FROM hits WHERE chunk_id IS NOT NULL),
b AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY length(coalesce(text, '')) DESC, ord) AS rank FROM hits WHERE chunk_id IS NOT NULL)
"""


@query(f"""WITH {RANKS} SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def rank_fusion(spark, d):
    h = table(spark, d, "hits").where("chunk_id is not null")
    a = h.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "ord")))
    b = h.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.length(F.coalesce("text", F.lit("")))), "ord")))
    return retrieval.rrf([a, b]).select("query_id", "chunk_id", "score")


@query("SELECT query_id, ord, round(score * CASE page_type WHEN 'faq' THEN 1.2 WHEN 'case-study' THEN 1.2 WHEN 'legal' THEN 0.3 ELSE 1 END, 9) AS score FROM hits WHERE score IS NOT NULL")
def boosted_hits(spark, d):
    return table(spark, d, "hits").where("score is not null").select("query_id", "ord", F.round(retrieval.boosted(F.col("score"), F.col("page_type")), 9).alias("score"))


COS = "CASE WHEN {0} IS NULL OR {1} IS NULL OR len({0}) <> len({1}) OR len({0}) = 0 THEN 0 ELSE coalesce(nullif(list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[]), 'NaN'::DOUBLE), 0) END"


@query(f"""WITH RECURSIVE q AS (SELECT query_id, arg_min(vector, ord) AS qv FROM hits WHERE vector IS NOT NULL GROUP BY query_id),
c AS (SELECT h.query_id, h.ord, h.vector, CASE WHEN coalesce(score, 0) > 0 THEN score ELSE {COS.format('h.vector', 'q.qv')} END AS rel, count(*) OVER (PARTITION BY h.query_id) AS n FROM hits h LEFT JOIN q ON q.query_id = h.query_id),
sim AS (SELECT a.query_id, a.ord AS a, b.ord AS b, {COS.format('a.vector', 'b.vector')} AS s FROM c a JOIN c b ON a.query_id = b.query_id WHERE a.n > 3),
step AS (SELECT query_id, 1 AS k, [first(ord ORDER BY rel DESC, ord)] AS chosen FROM c WHERE n > 3 GROUP BY query_id
  UNION ALL
  SELECT query_id, k + 1, list_append(chosen, nxt) FROM (
    SELECT s.query_id, s.k, s.chosen, first(v.ord ORDER BY v.value DESC, v.ord) AS nxt FROM step s
    JOIN LATERAL (SELECT c.ord, round(0.5 * c.rel - 0.5 * max(sim.s), 9) AS value FROM c JOIN sim ON sim.query_id = c.query_id AND sim.a = c.ord
                  WHERE c.query_id = s.query_id AND NOT list_contains(s.chosen, c.ord) AND list_contains(s.chosen, sim.b) GROUP BY c.ord, c.rel) v ON true
    WHERE s.k < 3 GROUP BY s.query_id, s.k, s.chosen))
SELECT query_id, chosen[i] AS ord, CAST(i AS INT) AS pick FROM (SELECT query_id, chosen, unnest([1, 2, 3]) AS i FROM step WHERE k = 3)
UNION ALL SELECT query_id, ord, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ord) AS INT) FROM c WHERE n <= 3""")
def diverse_hits(spark, d):
    """The three of each query's hits that say most; the query's vector is that of its first hit."""
    h = table(spark, d, "hits").select("query_id", "ord", "score", "vector")
    q = h.where("vector is not null").groupBy("query_id").agg(F.min_by("vector", "ord").alias("query_vector"))
    return retrieval.mmr(h.join(q, "query_id", "left"), k=3)


HYBRID = r"""
WITH ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY content_hash DESC NULLS LAST, text, url) AS n FROM chunks WHERE chunk_id IS NOT NULL) WHERE n = 1 AND text IS NOT NULL),
q AS (SELECT query_id, arg_min(title, ord) AS query, arg_min(vector, ord) AS vector FROM hits WHERE title IS NOT NULL AND vector IS NOT NULL GROUP BY query_id),
good AS (SELECT * FROM ch WHERE len(vector) = 64 AND NOT list_bool_or([isnan(x) OR isinf(x) OR x IS NULL FOR x IN vector])),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_id) AS rank FROM (SELECT q.query_id, c.chunk_id, round(list_distance(q.vector::DOUBLE[], c.vector::DOUBLE[]), 6) AS dist FROM q, good c)),
w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM ch WHERE length(text) > 0),
dl AS (SELECT chunk_id, len(w) AS dl FROM w WHERE len(w) > 0), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM w) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
t AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) AS term FROM q),
s AS (SELECT t.query_id, p.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
      FROM t JOIN p ON p.term = t.term JOIN df ON df.term = t.term JOIN dl ON dl.chunk_id = p.chunk_id, st GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s),
l AS (SELECT query_id, chunk_id, rank, 0 AS list FROM v WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM f WHERE rank <= 20),
r AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list * 1000 + rank) AS first FROM l GROUP BY ALL),
b AS (SELECT r.query_id, r.chunk_id, ch.url, ch.page_type, round(score * CASE ch.page_type WHEN 'faq' THEN 1.2 WHEN 'case-study' THEN 1.2 WHEN 'legal' THEN 0.3 ELSE 1 END, 9) AS boosted,
      row_number() OVER (PARTITION BY r.query_id ORDER BY score DESC, first) AS place FROM r JOIN ch ON ch.chunk_id = r.chunk_id)
SELECT query_id, chunk_id, url, page_type, score, CAST(rank AS INT) AS rank FROM (SELECT query_id, chunk_id, url, page_type, boosted AS score, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, place) AS rank FROM b) WHERE rank <= 12"""


def _searchable(spark, d):
    """Chunks, each once, and the queries: of each query the title and vector of its first hit that has both."""
    c = table(spark, d, "chunks").where("chunk_id is not null").select("chunk_id", "url", "title", "page_type", "text", "vector", "content_hash")
    w = Window.partitionBy("chunk_id").orderBy(F.desc_nulls_last("content_hash"), F.asc_nulls_last("text"), F.asc_nulls_last("url"))
    chunks = c.withColumn("n", F.row_number().over(w)).where("n = 1 and text is not null").drop("n", "content_hash")
    good = table(spark, d, "hits").where("title is not null and vector is not null")
    return chunks, good.groupBy("query_id").agg(F.min_by("title", "ord").alias("query"), F.min_by("vector", "ord").alias("vector"))


@query(HYBRID)
def hybrid_search(spark, d):
    """Vector and text search over the chunks for every query, fused, boosted, best 12."""
    chunks, queries = _searchable(spark, d)
    by_text = retrieval.bm25_top_k(chunks, queries, key="chunk_id")
    by_vector = retrieval.vector_top_k(chunks, queries, row_id="chunk_id")
    return retrieval.rerank(retrieval.hybrid(by_vector, by_text, chunks.drop("text", "vector"))).select("query_id", "chunk_id", "url", "page_type", "score", "rank")


# --- conversation and state

W = "[regexp_replace(w, '^[?.!,]+|[?.!,]+$', '', 'g') for w in regexp_split_to_array(trim(regexp_replace(lower(question), '\\s+', ' ', 'g')), ' ')]"
NEEDS = f"""(len(list_intersect(ws, {C.HEAVY_CONTEXT})) > 0 OR (len(list_intersect(ws, {C.LIGHT_CONTEXT})) > 0 AND NOT (coalesce(list_contains({C.STARTERS}, ws[1]), false) AND len(ws) >= 4)))"""


@query(rf"""SELECT id, {NEEDS} AS needs_rewrite,
  (len(regexp_extract_all(question, '\?')) > 1 OR {' OR '.join(f"contains(lower(question), '{p}')" for p in C.DEEP_PHRASES)} OR len(list_intersect(regexp_split_to_array(lower(question), '\s+'), {C.DEEP_WORDS})) > 0) AS escalate
FROM (SELECT DISTINCT id, question, {W} AS ws FROM feedback WHERE question IS NOT NULL)""")
def question_routing(spark, d):
    q = F.col("question")
    return table(spark, d, "feedback").where(q.isNotNull()).select("id", q).distinct().select("id", C.needs_rewrite(q).alias("needs_rewrite"), C.should_escalate(q).alias("escalate"))


CACHE = rf"""cache AS (SELECT key, data, created_at + INTERVAL 86400 SECOND AS expires_at FROM (SELECT md5(lower(trim(question, e' \t\n\r' || chr(160)))) AS key, answer AS data, created_at,
  row_number() OVER (PARTITION BY md5(lower(trim(question, e' \t\n\r' || chr(160)))) ORDER BY created_at DESC, id DESC) AS n FROM (SELECT DISTINCT id, question, answer, created_at FROM feedback WHERE question IS NOT NULL AND regexp_replace(answer, '{WS}', '', 'g') <> '')) WHERE n = 1)"""


@query(f"WITH {CACHE} SELECT key, data FROM cache WHERE expires_at >= TIMESTAMPTZ '2025-02-01 00:00:00+00'")
def live_cache(spark, d):
    answers = table(spark, d, "feedback").select("id", "question", "answer", "created_at").distinct()
    return state.cache_put(answers).where(F.col("expires_at") >= F.lit("2025-02-01 00:00:00").cast("timestamp")).select("key", "data")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(epoch(ts) AS BIGINT) - CASE WHEN CAST(epoch(ts) AS BIGINT) > epoch(ts) THEN 1 ELSE 0 END RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def sliding_rate(spark, d):
    return state.sliding_rate(table(spark, d, "events"), "user_id", "ts").select("event_id", "in_window")


@query("SELECT user_id, time_bucket(INTERVAL 1 MINUTE, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def fixed_rate(spark, d):
    return state.fixed_rate(table(spark, d, "events"), "user_id", "ts")


@query("""SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '|') AS history FROM events""")
def turn_history(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("text"))
    return state.last_turns(e, "user_id", ["ts", "event_id"]).select("event_id", F.when(F.size("history") > 0, F.array_join("history", "|")).alias("history"))


@query("SELECT id, coalesce(length(name) BETWEEN 1 AND 200 AND regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AND length(question) BETWEEN 1 AND 5000 AND (phone IS NULL OR length(phone) <= 50) AND (message IS NULL OR length(message) <= 5000), false) AS valid FROM (SELECT DISTINCT id, name, email, question, phone, message FROM leads)")
def lead_validation(spark, d):
    return table(spark, d, "leads").select("id", "name", "email", "question", "phone", "message").distinct().select("id", state.valid_lead().alias("valid"))


@query(f"""SELECT query_id, '{C.CONTEXT_BEGIN}' || chr(10) || left(string_agg('[' || n || '] ' || coalesce(title, '') || ' (' || coalesce(page_type, '') || ') — ' || coalesce(url, '') || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n), 8000) || chr(10) || '{C.CONTEXT_END}' AS context
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS n FROM hits) GROUP BY query_id""")
def answer_context(spark, d):
    h = table(spark, d, "hits").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "page_type", "url", "text"))).alias("c"))
    return h.select("query_id", C.context_block(F.col("c")).alias("context"))


@query("SELECT query_id, array_to_string(list_distinct_ordered, '|') AS sources FROM (SELECT query_id, list(url ORDER BY f) AS list_distinct_ordered FROM (SELECT query_id, url, min(ord) AS f FROM hits WHERE url IS NOT NULL GROUP BY ALL) GROUP BY query_id)")
def answer_sources(spark, d):
    h = table(spark, d, "hits").where("url is not null").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "url"))).alias("c"))
    return h.select("query_id", F.array_join(F.array_distinct(F.col("c.url")), "|").alias("sources"))


@query()
def streamed_answers(spark, d):
    """Each answer as server-sent events, parsed again."""
    df = table(spark, d, "feedback").where("answer is not null").select("id", "answer").distinct()
    body = F.array_join(F.transform(C.answer_tokens(F.col("answer")), lambda t: C.sse(F.lit("answer"), F.to_json(F.struct(t.alias("token"))))), "")
    return df.select("id", F.posexplode(C.sse_events(body)).alias("seq", "e")).select("id", "seq", "e.event", "e.data")


def _entry():
    tag = lambda n, c: F.when(c.isNotNull() & (F.trim(c) != ""), F.concat(F.lit(f"<{n}>"), c, F.lit(f"</{n}>"))).otherwise("")
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<url>"), tag("loc", safe(F.col("url"))), tag("lastmod", safe(F.col("lastmod"))), tag("priority", F.col("priority").cast("string")), F.lit("</url>"))


HEAD, END = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</urlset>"
FILE = 500  # entries of a sitemap


@query(f"SELECT {NORM} AS url, nullif(trim(lastmod), '') AS lastmod, priority FROM discovered WHERE trim(url) <> ''")
def sitemap_round_trip(spark, d):
    """The listing written as sitemaps of bounded size and read again."""
    df = table(spark, d, "discovered").where("trim(url) <> ''")
    files = df.groupBy("run_id", F.floor(F.col("ord") / FILE).alias("part")).agg(F.concat(F.lit(HEAD), F.array_join(F.collect_list(_entry()), ""), F.lit(END)).alias("xml"))
    return sitemap.parse_urlset(files).select("url", "lastmod", "priority")


@query(f"SELECT {NORM} AS url, CASE WHEN page_type = 'blog' THEN 'blog-sitemap' ELSE 'sitemap' END AS source, {TYPE} AS page_type, nullif(trim(lastmod), '') AS lastmod, priority FROM discovered WHERE trim(url) <> ''")
def sitemap_tree(spark, d):
    """The listing as an index with child sitemaps, found again from the index's address."""
    df = table(spark, d, "discovered").where("trim(url) <> ''")
    blog = F.coalesce(F.col("page_type") == "blog", F.lit(False))
    name = F.concat(F.lit("https://maps.example/"), F.when(blog, "blog-").otherwise("page-"), F.floor(F.col("ord") / FILE).cast("string"), F.lit(".xml"))
    files = kept(df.groupBy(name.alias("url")).agg(F.concat(F.lit(HEAD), F.array_join(F.collect_list(_entry()), ""), F.lit(END)).alias("xml")))
    tops = files.groupBy().agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), F.col("url"), F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("xml"))  # a short line for each file
    root = tops.select(F.lit("https://maps.example/root.xml").alias("url"), "xml")
    return sitemap.discover(files.unionByName(root), "https://maps.example/root.xml").select("url", "source", "page_type", "lastmod", "priority")
