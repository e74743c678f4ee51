"""Discovery, fetch results, robots rules, and reconciliation of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import url as U

# Order of preference of a document's source.
SOURCE_RANK = {"sitemap": 0, "blog-sitemap": 0, "bfs": 1, "overview": 2}
DROP_ALERT = 0.05


def fetch_ok() -> Column:
    return (F.col("status_code") == 200) & F.col("html").isNotNull()


def permanent_error() -> Column:
    return (F.col("status_code") >= 400) & (F.col("status_code") < 500) & (F.col("status_code") != 429)


def transient_error() -> Column:
    return F.coalesce(F.col("status_code").isin(429, 500, 502, 503, 504), F.lit(False)) | (F.coalesce(F.length("error"), F.lit(0)) > 0)


def fetch_status() -> Column:
    return (
        F.when(transient_error(), "failed_transient")
        .when(permanent_error(), "failed_permanent")
        .when(F.col("status_code") == 200, F.when(F.col("final_url") != F.col("url"), "redirected").otherwise("fetched"))
        .when((F.col("status_code") >= 400) & (F.col("status_code") < 500), "failed_permanent")
        .otherwise("failed_transient")
    )


def cadence() -> Column:
    c, p = F.lower(F.coalesce("changefreq", F.lit(""))), F.col("priority")
    return (
        F.when(c.isin("always", "hourly", "daily", "weekly"), "weekly").when(c == "monthly", "monthly").when(c.isin("yearly", "never"), "yearly")
        .when(p.isNotNull(), F.when(p >= 0.7, "weekly").when(p >= 0.4, "monthly").otherwise("yearly")).otherwise("weekly")
    )


def dedupe_discovered(urls: DataFrame) -> DataFrame:
    """By url the first in order; one found by following links gives way to any other."""
    w = Window.partitionBy("url").orderBy((F.coalesce("source", F.lit("")) == "bfs").cast("int"), "ord")
    return urls.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dedupe_docs(docs: DataFrame) -> DataFrame:
    """By url the best source, then priority (0 and null count as 0.5), then order."""
    rank = F.lit(99)
    for name, r in SOURCE_RANK.items():
        rank = F.when(F.col("source") == name, r).otherwise(rank)
    w = Window.partitionBy("url").orderBy(rank, F.desc(F.coalesce(F.nullif(F.col("priority"), F.lit(0.0)), F.lit(0.5))), "ord")
    return docs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merge_missing(first: DataFrame, second: DataFrame, key: str = "url", order: str | None = None) -> DataFrame:
    """All of the first, and the second's rows with keys it lacks, each key once: the first by order, without one the least row."""
    cols = [c for c in first.columns]
    by = [order] if order else [c for c, kind in second.dtypes if not kind.startswith("map")]
    one = second.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where("__n = 1")
    return first.unionByName(one.join(first.select(key).distinct(), key, "left_anti").select(cols))


def filter_and_dedupe(urls: DataFrame, rules: list[tuple[str, bool]]) -> DataFrame:
    """What robots rules allow, by url the first that wasn't found by following links, else the first; ``place`` is the order of urls by their first listing."""
    ok = robots_allowed(urls, rules)
    w = Window.partitionBy("url")
    first = w.orderBy((F.coalesce("source", F.lit("")) == "bfs").cast("int"), "ord")
    return ok.withColumn("place", F.min("ord").over(w)).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def filter_stats(urls: DataFrame, rules: list[tuple[str, bool]]) -> DataFrame:
    """(listed, robots_filtered, duplicates, kept): duplicates are counted among what robots rules allow."""
    ok = robots_ok(F.col("url"), rules)
    per = urls.groupBy("url").agg(F.count("*").alias("n"), F.max(ok).alias("ok"))
    allowed, kept = F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)), F.count_if("ok")
    listed = F.coalesce(F.sum("n"), F.lit(0))
    return per.agg(listed.alias("listed"), (listed - allowed).alias("robots_filtered"), (allowed - kept).alias("duplicates"), kept.alias("kept"))


def fetched_with_meta(fetches: DataFrame, discovered: DataFrame) -> DataFrame:
    """Good fetches with source, lastmod and priority of their listing (one row a url); a page nobody listed counts as of a sitemap."""
    meta = discovered.select("url", "source", "lastmod", "priority")
    return fetches.where(fetch_ok()).join(meta, "url", "left").withColumn("source", F.coalesce("source", F.lit("sitemap")))


def merge_listed(discovered: DataFrame, listed: DataFrame, rules: list[tuple[str, bool]]) -> tuple[DataFrame, DataFrame]:
    """Discovered urls and those of an overview file (url, place) they lack by canonical key, and those of them robots rules forbid."""
    key = U.canonical(F.col("url"))
    first = listed.where("url is not null").withColumn("key", key).withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy("place"))).where("__n = 1")
    new = first.join(discovered.select(key.alias("key")).distinct(), "key", "left_anti").select(U.normalize(F.col("url")).alias("url"))
    ok = robots_ok(F.col("url"), rules)
    null = lambda kind: F.lit(None).cast(kind)
    rows = new.where(ok).select("url", null("string").alias("lastmod"), null("double").alias("priority"), null("string").alias("changefreq"), F.lit("llms").alias("source"), U.page_type(F.col("url")).alias("page_type"))
    return discovered.select(rows.columns).unionByName(rows), new.where(~ok)


def first_body(responses: DataFrame, order: list[str]) -> DataFrame:
    """(text, url) of the first of some urls that answered 200 with a text; no row if none did."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("url"))
    good = responses.where(F.col("url").isin(order) & (F.col("status_code") == 200) & (F.length(F.trim("text")) > 0))
    return good.orderBy(place).limit(1).select("text", "url")


def retry_targets(failures: DataFrame) -> DataFrame:
    """The urls of failures as listings, for a run that fetches only those again."""
    null = lambda kind: F.lit(None).cast(kind)
    return failures.where("url is not null").select("url").distinct().select("url", null("string").alias("lastmod"), null("double").alias("priority"), null("string").alias("changefreq"), F.lit("sitemap").alias("source"), U.page_type(F.col("url")).alias("page_type"))


def needs_rendering(plain_chars: Column, rendered_chars: Column, more: float = 1.2) -> Column:
    """A browser sees notably more text than plain fetching; without a rendering nothing is needed."""
    return F.coalesce(rendered_chars / F.greatest(plain_chars, F.lit(1)) > more, F.lit(False))


def discovery_summary(urls: DataFrame) -> DataFrame:
    """Totals, by source and by page type, in one pass."""
    s, p = F.coalesce("source", F.lit("unknown")), F.coalesce("page_type", F.lit("unknown"))
    g = urls.select(s.alias("source"), p.alias("page_type")).groupingSets([["source"], ["page_type"], []], "source", "page_type")
    return g.agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level")).select("level", "source", "page_type", "n")


def latest_fetch(fetches: DataFrame) -> DataFrame:
    w = Window.partitionBy("url").orderBy(F.desc("fetched_at"), F.desc("fetch_id"))
    return fetches.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def reconcile(discovered: DataFrame, fetches: DataFrame) -> DataFrame:
    """Every discovered url with what became of it; the last fetch of a url counts."""
    f = latest_fetch(fetches).select("url", fetch_status().alias("status"), "status_code", "final_url", "error")
    moved = F.when(F.col("final_url") != F.col("url"), F.col("final_url"))
    return discovered.join(f, "url", "left").select(
        "url", F.coalesce("status", F.lit("not_attempted")).alias("status"), F.col("status_code").alias("http_code"), moved.alias("final_url"), "error", cadence().alias("suggested_cadence")
    )


def status_counts(records: DataFrame) -> DataFrame:
    kinds = ["fetched", "redirected", "failed_permanent", "failed_transient", "not_attempted"]
    return records.agg(F.count("*").alias("discovered"), *(F.count_if(F.col("status") == k).alias(k) for k in kinds))


def failures(records: DataFrame) -> DataFrame:
    return records.where(F.col("status").isin("failed_permanent", "failed_transient", "not_attempted")).select("url", F.col("status").alias("reason"), F.col("http_code").alias("status_code"), "error")


def drop_alerts(reports: DataFrame, limit: float = DROP_ALERT) -> DataFrame:
    """Change of good pages against the last full run before; partial runs neither count nor alert.

    The window is over runs, of which there is one a crawl.
    """
    ok = F.col("fetched") + F.col("redirected")
    before = F.last(F.when(~F.col("partial"), ok), ignorenulls=True).over(Window.orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1))
    r = reports.withColumn("ok_pages", ok).withColumn("before", before)
    delta = F.when(~F.col("partial") & F.col("before").isNotNull(), F.col("ok_pages") - F.col("before"))
    alert = F.coalesce(~F.col("partial") & (F.col("before") > 0) & ((F.col("before") - F.col("ok_pages")) / F.nullif(F.col("before"), F.lit(0)) > limit), F.lit(False))
    return r.select("run_id", "ok_pages", "partial", delta.alias("page_count_delta"), alert.alias("drop_alert"))


def robots_ok(url: Column, rules: list[tuple[str, bool]]) -> Column:
    """What the first rule whose prefix matches says; rules are few, so they fold into one expression."""
    p = F.when(U.path(url) == "", F.lit("/")).otherwise(U.path(url))
    ok = F.lit(True)
    for prefix, allow in reversed(rules):
        ok = F.when(p.startswith(prefix), F.lit(allow)).otherwise(ok)
    return ok


def robots_allowed(urls: DataFrame, rules: list[tuple[str, bool]]) -> DataFrame:
    return urls.where(robots_ok(F.col("url"), rules))


CRAWL_DELAY = 1.0  # seconds between fetches where a site asks for nothing else


def robots_groups(text: str | None) -> list[tuple[list[str], list[tuple[str, bool]], float | None]]:
    """(agents, rules, delay) of each group in file order. A blank line ends a group, one without rules is dropped; a rule without a path allows everything."""
    groups: list[tuple[list[str], list[tuple[str, bool]], float | None]] = []
    agents: list[str] = []
    rules: list[tuple[str, bool]] = []
    delay: float | None = None
    ruled = False

    def close() -> None:
        nonlocal agents, rules, delay, ruled
        if agents and ruled:
            groups.append((agents, rules, delay))
        agents, rules, delay, ruled = [], [], None, False

    for raw in [*(text or "").splitlines(), ""]:
        if not raw.strip():
            close()
        key, colon, value = raw.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if ruled:
                close()
            agents.append(value.lower())
        elif agents and key in ("allow", "disallow"):
            rules.append((value, key == "allow" or not value))
            ruled = True
        elif agents and key == "crawl-delay":
            if value.isdigit():
                delay = float(value)
            ruled = True
    close()
    return groups


def robots_rules(text: str | None, agent: str = "*") -> tuple[list[tuple[str, bool]], float]:
    """Rules of the first group that names the agent, else of ``*``, and the crawl delay: the agent's, else that of ``*``, else ``CRAWL_DELAY``. Null or empty allows everything."""
    name = agent.split("/")[0].lower()
    groups = robots_groups(text)
    common = next((g for g in groups if "*" in g[0]), ([], [], None))
    own = next((g for g in groups if any(a and a != "*" and a in name for a in g[0])), common)
    return own[1], next((d for d in (own[2], common[2]) if d is not None), CRAWL_DELAY)


def coverage_gaps(listed: DataFrame, records: DataFrame, blocked: DataFrame) -> DataFrame:
    """Listed urls that weren't fetched, with the reason."""
    key = lambda df: df.select(U.canonical(F.col("url")).alias("key"), *(c for c in df.columns if c != "url"))
    r = key(records.select("url", "status")).groupBy("key").agg(F.min(F.when(F.col("status").isin("fetched", "redirected"), 0).otherwise(1)).alias("bad"))
    b = key(blocked.select("url")).distinct().withColumn("blocked", F.lit(True))
    gaps = key(listed.select("url")).distinct().join(r, "key", "left").join(b, "key", "left").where("bad is null or bad = 1")
    return gaps.select(F.col("key").alias("url"), F.when(F.col("blocked"), "robots_blocked").when(F.col("bad") == 1, "fetch_failed").otherwise("not_attempted").alias("reason"))


def merge_aliases(known: DataFrame, new: DataFrame) -> DataFrame:
    """Newer targets win by origin."""
    both = known.withColumn("__age", F.lit(0)).unionByName(new.where("origin <> target").withColumn("__age", F.lit(1)))
    return both.groupBy("origin").agg(F.max_by("target", F.struct("__age", "target")).alias("target"))


def follow_aliases(keys: DataFrame, aliases: DataFrame) -> DataFrame:
    return keys.join(aliases.withColumnRenamed("origin", "key"), "key", "left").select(F.coalesce("target", "key").alias("key")).distinct()


def gone_keys(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """Keys under which permanently failed pages are in the index: their own or their alias's."""
    return follow_aliases(records.where("status = 'failed_permanent'").select(U.canonical(F.col("url")).alias("key")), aliases)


def deindex(index: DataFrame, records: DataFrame, aliases: DataFrame) -> DataFrame:
    """The index without pages that are permanently gone, under their own or their alias's url."""
    gone = gone_keys(records, aliases)
    return index.join(gone, U.canonical(index["url"]) == gone["key"], "left_anti")


def with_actions(records: DataFrame) -> DataFrame:
    """Records with what was done about them: permanently failed pages are taken out of the index."""
    return records.withColumn("action", F.when(F.col("status") == "failed_permanent", "deindexed"))


def aliases_of(records: DataFrame) -> DataFrame:
    """(origin, target) canonical keys of redirected pages."""
    return records.where("status = 'redirected' and final_url is not null").select(U.canonical(F.col("url")).alias("origin"), U.canonical(F.col("final_url")).alias("target")).where("origin <> target").groupBy("origin").agg(F.max("target").alias("target"))


def report(run_id: str, discovered: DataFrame, fetches: DataFrame, listed: DataFrame, blocked: DataFrame, earlier: DataFrame, robots_excluded: int = 0, partial: bool = False) -> DataFrame:
    """One row: counts by status, gaps in coverage, change against the last full report before, and whether the drop is alarming.

    earlier: reports (run_id, fetched, redirected, partial) of other runs.
    """
    records = reconcile(discovered, fetches)
    counts = status_counts(records)
    gaps = coverage_gaps(listed, records, blocked).agg(F.count("*").alias("coverage_gaps"))
    before = earlier.where(~F.col("partial") & (F.col("run_id") < run_id)).agg(F.max_by(F.col("fetched") + F.col("redirected"), "run_id").alias("before"))
    one = counts.crossJoin(gaps).crossJoin(before)  # one row each
    ok = F.col("fetched") + F.col("redirected")
    full = F.lit(not partial) & F.col("before").isNotNull()
    return one.select(
        F.lit(run_id).alias("run_id"), *counts.columns, F.lit(robots_excluded).alias("robots_excluded"), "coverage_gaps", F.col("failed_permanent").alias("deindexed"), F.when(full, ok - F.col("before")).alias("page_count_delta"),
        F.coalesce(full & (F.col("before") > 0) & ((F.col("before") - ok) / F.col("before") > DROP_ALERT), F.lit(False)).alias("drop_alert"), F.lit(partial).alias("partial"),
    )
