import json

import pytest
from pyspark.sql import functions as F

from quernstone.functions import chat as C
from quernstone.functions import text as T
from quernstone.functions import url as U
from quernstone.operators import chunking, crawl, graph, index, retrieval, state
from quernstone.sources import sitemap


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTPS://WWW.Site.example/Path?b=1&utm_source=x&a=2&b=3#f", "https://www.site.example/Path?b=1&b=3&a=2"),
        ("https://a.example/?gclid=1", "https://a.example/"), ("https://a.example/p?x", "https://a.example/p?x="), ("", ""), ("not a url", "not a url"),
        ("https://a.example/?q=%7E*", "https://a.example/?q=~%2A"),
    ],
)
def test_normalize(spark, url, want):
    assert one(spark, U.normalize(F.col("u")), u=url) == want


def test_null_url(spark):
    df = spark.createDataFrame([(None,)], "u string")
    u = F.col("u")
    assert list(df.select(U.normalize(u), U.canonical(u), U.page_type(u), U.slug(u), U.url_hash(u)).first()) == [None] * 5


@pytest.mark.parametrize("path,kind", [("/", "home"), ("/faq", "faq"), ("/faq/", "faq"), ("/case-study/x", "case-study"), ("/blog/x", "blog"), ("/services/x", "service"), ("/industries/x", "industry"), ("/hire-x", "hire"), ("/terms", "legal"), ("/team", "company"), ("/other", "other")])
def test_page_type(spark, path, kind):
    assert one(spark, U.page_type(F.col("u")), u=f"https://a.example{path}") == kind


@pytest.mark.parametrize("href,want", [("/x", "https://a.example/x"), ("y", "https://a.example/b/y"), ("../z", "https://a.example/z"), ("//c.example/", "https://c.example/"), ("http://d.example", "http://d.example"), ("?q", "https://a.example/b/c?q"), ("./d/./e", "https://a.example/b/d/e")])
def test_resolve(spark, href, want):
    assert one(spark, U.resolve(F.lit("https://a.example/b/c"), F.col("h")), h=href) == want


def test_internal(spark):
    base = F.lit("https://www.site.example/")
    assert one(spark, U.is_internal(F.col("u"), base), u="https://blog.site.example/x")
    assert not one(spark, U.is_internal(F.col("u"), base), u="https://other.example/x")
    assert one(spark, U.is_internal(F.col("u"), base), u="/x")
    assert not one(spark, U.is_internal(F.col("u"), base, False), u="https://blog.site.example/x")


def test_text(spark):
    assert one(spark, T.content_hash(F.col("t")), t=" A  b\n") == one(spark, T.content_hash(F.col("t")), t="a B")
    assert one(spark, T.shingles(F.col("t")), t="a b c d a b c") == ["a b c", "b c d", "c d a", "d a b"]
    assert one(spark, T.shingles(F.col("t")), t="a b") == ["a", "b"]
    assert one(spark, T.sections(F.col("t")), t="pre\n# A\nx\n## B\ny") == ["pre", "# A\nx", "## B\ny"]
    assert one(spark, T.page_title(F.col("t")), t="<title>FAQ &amp; more | Site</title>") == "FAQ & more"
    assert one(spark, T.page_title(F.col("t")), t="<h1>x <b>y</b></h1>") == "x y"
    assert one(spark, T.tail_overlap(F.col("t"), 20), t="First one here. Second here") == "Second here"


@pytest.mark.parametrize("q,want", [("Compare the two", True), ("Is it a? or b? c?", True), ("tell me in detail", True), ("book a consultation", False), ("prospects and constraints", False)])
def test_escalate(spark, q, want):
    assert one(spark, C.should_escalate(F.col("q")), q=q) is want


def test_chat(spark):
    assert one(spark, C.strip_thinking(F.col("t")), t="a<think>b</think>c<think>d") == "ac"
    assert one(spark, C.needs_rewrite(F.col("q")), q="How much does it cost?") is True
    assert one(spark, C.needs_rewrite(F.col("q")), q="What is our refund policy?") is False
    body = one(spark, F.concat(C.sse(F.lit("answer"), F.lit("{}")), F.lit("event: x\ndata: 1")), t="")
    assert one(spark, C.sse_events(F.col("b")), b=body) == [("answer", "{}")]
    df = spark.createDataFrame([("one two three\n\nfour",), (None,)], "t string").select(C.answer_tokens("t").alias("x")).collect()
    assert df[0].x == ["one two ", "three ", "\n", "four"] and df[1].x is None
    waits = spark.createDataFrame([("5", 0), (None, 2), ("invalid", 1), ("0", 0)], "h string, n int")
    assert [r.x for r in waits.select(C.retry_wait(F.col("h"), F.col("n"), F.current_timestamp()).alias("x")).collect()] == [5.0, 4.0, 2.0, 0.0]


def test_drop_alert(spark):
    rows = [("1", 100, 0, False), ("2", 3, 0, True), ("3", 90, 0, False), ("4", 87, 0, False)]
    got = [(r.page_count_delta, r.drop_alert) for r in crawl.drop_alerts(spark.createDataFrame(rows, "run_id string, fetched int, redirected int, partial boolean")).orderBy("run_id").collect()]
    assert got == [(None, False), (None, False), (-10, True), (-3, False)]


def test_robots():
    rules, delay = crawl.robots_rules("User-agent: *\nDisallow: /a\nAllow: /\nCrawl-delay: 2\n\nUser-agent: bot\nAllow: /")
    assert rules == [("/a", False), ("/", True)] and delay == 2.0
    assert crawl.robots_rules("", "x") == ([], 1.0) == crawl.robots_rules(None)
    # the agent's own rules with the delay of *; a rule without a path allows everything
    text = "User-agent: *\nCrawl-delay: 3\nDisallow: /x\n\nUser-agent: Bot\nUser-agent: other\nDisallow:\nDisallow: /y"
    assert crawl.robots_rules(text, "bot/1.0") == ([("", True), ("/y", False)], 3.0)
    assert crawl.robots_rules(text, "nobody") == ([("/x", False)], 3.0)


def test_sitemap(spark, tmp_path):
    files = spark.createDataFrame([("<?xml version='1.0'?><urlset xmlns='x'><url><loc> https://a.example/?utm_id=1 </loc><priority>high</priority></url><url><lastmod>1</lastmod></url></urlset>",), ("junk",), (None,), ("<sitemapindex><sitemap><loc>https://a.example/s.xml</loc></sitemap></sitemapindex>",)], "xml string")
    assert [(r.url, r.priority, r.page_type) for r in sitemap.parse_urlset(files).collect()] == [("https://a.example/", None, "home")]
    assert [r.loc for r in sitemap.parse_index(files).collect()] == ["https://a.example/s.xml"]
    path = str(tmp_path / "d")
    assert sitemap.load_discovered(spark, path).count() == 0
    sitemap.save_discovered(sitemap.parse_urlset(files), path)
    assert sitemap.load_discovered(spark, path).count() == 1


def test_chunking_keeps_all():
    import random

    rng = random.Random(1)
    for _ in range(200):
        paras = [" ".join("w%d" % rng.randrange(99) for _ in range(rng.choice([5, 60, 300, 1200]))) + "." for _ in range(rng.randrange(1, 9))]
        pieces = chunking.cut_section("\n\n".join(paras))
        # a piece short of its least size takes one more paragraph, whatever its length
        assert all(0 < len(p) <= chunking.MAX + chunking.MIN + chunking.OVERLAP for p in pieces)
        words = " ".join(pieces).split()
        for p in paras:
            assert all(w.rstrip(".") in {x.rstrip(".") for x in words} for w in p.split())
    assert chunking.cut_section("") == [""]


def test_chunk_sizes():
    most, least, lap = 100, 60, 20
    cut = lambda t: chunking.cut_section(t, most, least, lap)
    assert cut("x" * 100) == ["x" * 100]
    # a paragraph that is too long is cut at exactly the size, with the raw tail as overlap
    assert cut("a" * 250) == ["a" * 100, "a" * 100, "a" * 90]
    # a piece ends before the paragraph that doesn't fit and hands on the sentence that begins in its tail
    first = "b" * 60 + ". " + "Tail here."
    assert cut(f"{first}\n\n{'c' * 50}") == [first, "Tail here.\n\n" + "c" * 50]
    # single line ends are no paragraph; a short rest stays apart where the last piece has no room
    assert cut(f"{'d' * 90}\n\n{'e' * 30}") == ["d" * 90, "d" * 20 + "\n\n" + "e" * 30]
    # what is too short to end is joined, and cut at the end
    assert cut(f"{'f' * 40}\n\n{'g' * 90}") == ["f" * 40 + "\n\n" + "g" * 58, "g" * 20 + "g" * 32]


def test_upsert(spark, tmp_path):
    schema = "chunk_id string, url string, content_hash string, text string"
    first = spark.createDataFrame([("a1", "u", "1", "x"), ("a2", "u", "1", "x"), ("a3", "u", "1", "x"), ("z", "v", "1", "x")], schema)
    ix = index.ChunkIndex(spark, str(tmp_path / "ix"))
    assert ix.upsert(first.limit(0)) == {} and ix.read() is None
    assert ix.upsert(first) == {"added": 4}
    assert ix.upsert(first) == {"skipped": 4}
    done = ix.upsert(spark.createDataFrame([("a1", "u", "2", "y"), ("b1", "u", "1", "x"), ("b1", "u", "1", "x")], schema))
    assert done == {"updated": 1, "added": 1, "orphaned": 2, "kept": 1}
    assert sorted(r.chunk_id for r in ix.read().collect()) == ["a1", "b1", "z"]
    assert ix.delete(spark.createDataFrame([("v",), ("none",)], "url string")) == 1
    assert ix.meta().chunk_count == 2
    with pytest.raises(ValueError):
        ix.upsert(first, provider="other")
    assert ix.expire() >= 1 and ix.read().count() == 2


def test_retrieval(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.1]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0])], "id long, vector array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [(r.id, r["rank"]) for r in retrieval.vector_top_k(rows, q, 2).orderBy("rank").collect()] == [(2, 1), (3, 2)]
    lists = [spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, chunk_id string, rank int"), spark.createDataFrame([(1, "b", 1)], "query_id long, chunk_id string, rank int")]
    got = [(r.chunk_id, r.score) for r in retrieval.rrf(lists).orderBy("rank").collect()]
    assert got[0][0] == "b" and abs(got[1][1] - 1 / 61) < 1e-8
    c = spark.createDataFrame([(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.88, [1.0, 0.0]), (1, 3, 0.85, [0.0, 1.0]), (2, 1, 0.1, None)], "query_id long, ord int, score double, vector array<double>")
    assert sorted((r.query_id, r.ord) for r in retrieval.mmr(c, 2).collect()) == [(1, 1), (1, 3), (2, 1)]
    docs = spark.createDataFrame([(1, "red fox"), (2, "red dog dog"), (3, None), (4, "")], "doc_id long, text string")
    hits = retrieval.bm25_top_k(docs, spark.createDataFrame([(7, "dog")], "query_id long, query string")).collect()
    assert [h.doc_id for h in hits] == [2]


def test_components(spark):
    import random

    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {(x, find(x)) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    got = {(r.id, r.component) for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_reachable(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {(r.url, r.depth) for r in graph.reachable(edges, seeds, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_near_pages(spark):
    base = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, "u1", "overview", 1.0, base), (2, "u2", "sitemap", 0.5, base), (3, "u3", "sitemap", 0.5, base + " tail"), (4, "u4", "sitemap", 0.5, "other text"), (5, "u5", "x", None, None), (6, "u6", "x", None, "")], "ord int, url string, source string, priority double, markdown string")
    g = graph.near_duplicate_groups(docs)
    assert {(r.id, r.component) for r in g.collect()} == {(1, 1), (2, 1), (3, 1)}
    assert sorted(r.url for r in graph.collapse(docs, g).collect()) == ["u2", "u4", "u5", "u6"]


def test_state(spark):
    df = spark.createDataFrame([("1", " Q ", "old", "2025-01-01 00:00:00"), ("2", "q", "new", "2025-01-02 00:00:00"), ("3", "r", " ", "2025-01-02 00:00:00")], "id string, question string, answer string, t string").withColumn("created_at", F.col("t").cast("timestamp"))
    cache = state.cache_put(df)
    assert [r.data for r in cache.collect()] == ["new"]
    get = lambda now: [r.data for r in state.cache_get(df.select("question").limit(1), cache, F.lit(now).cast("timestamp")).collect()]
    assert get("2025-01-02 12:00:00") == ["new"] and get("2025-01-04 00:00:00") == [None]
    assert json.dumps(state.TTL) == "86400"


def test_sets_of_candidates_alone_are_kept(spark):
    from quernstone import runtime

    words = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(words)), (2, " ".join([*words, "tail"])), *((i, " ".join(f"{w}x{i}" for w in words)) for i in range(3, 30))]
    before = runtime.kept_now()
    pairs = graph.minhash_pairs(spark.createDataFrame(texts, "ord int, markdown string"), "ord", "markdown", 0.85)
    assert {tuple(r) for r in pairs.collect()} == {(1, 2)}
    assert [f.count() for f in runtime._kept[before:] if "s" in f.columns] == [2]
    few, many = runtime.narrowed(spark.range(9), spark.range(3), "id"), runtime.FEW
    try:
        runtime.FEW = 2
        other = runtime.narrowed(spark.range(9), spark.range(3), "id")
    finally:
        runtime.FEW = many
    assert sorted(r.id for r in few.collect()) == sorted(r.id for r in other.collect()) == [0, 1, 2]
