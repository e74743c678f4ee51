"""Extraction, fetching, reports, search index and answering on written cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import chat as C
from quernstone.operators import ann, answering, crawl, extract, graph, index, retrieval, state
from quernstone.sources import fetching, reports, sitemap

PAGE = """<html><head><title>Guide &amp; help | Site</title><script>var x = "<h1>no</h1>"</script></head><body class="has-nav-open">
<header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav><div class="cookie-consent"><p>We use cookies</p></div>
<main><h1>The  guide</h1><p>First <b>bold</b> words.<p>Second one.<h2>Steps</h2><ul><li>One<li>Two</ul><div id="share"><p>Share</p></div><p> </p></main><footer><p>End</p></footer></body></html>"""


def test_main_text():
    title, text, pairs = extract.extract(PAGE)
    assert title == "Guide & help" and pairs == []
    assert text == "# The guide\n\nFirst bold words.\n\nSecond one.\n\n## Steps\n\n- One\n\n- Two" or text == "# The  guide\n\nFirst bold words.\n\nSecond one.\n\n## Steps\n\n- One\n\n- Two"
    assert extract.extract("<body><div id=content><p>a</p></div><p>b</p></body>")[1] == "a"
    assert extract.extract("<p>only</p>")[1] == "only"
    for bad in (None, "", "  ", "<", "</div>", "<" * 3000, "<p" * 2000):
        assert isinstance(extract.extract(bad)[1], str)


@pytest.mark.parametrize(
    "html,want",
    [
        ("<details><summary>Why?</summary><p>Because.</p></details>", [("Why?", "Because.")]),
        ("<details><summary>Why?</summary></details><details><p>x</p></details>", []),
        ("<dl><dt>A?</dt><dd>a</dd><dd>more</dd><dt>B?</dt><dt>C?</dt><dd>c</dd></dl>", [("A?", "a"), ("C?", "c")]),
        ("<dl><div><dt>A?</dt><dd>a</dd></div></dl>", []),
        ("<div class='faq-item'><h3 class='faq-question'>Q?</h3><div class='faq-answer'><p>A.</p></div></div>", [("Q?", "A.")]),
        ("<div class='accordion'><h3>Q?</h3><p>A.</p></div>", [("Q?", "A.")]),
        ("<div class='accordion'><h3>Q?</h3></div>", []),
        # the first collector wins, and a question counts once
        ("<div class='faq'><h3>Q?</h3><p>box</p></div><details><summary>Q?</summary>disclosed</details>", [("Q?", "disclosed")]),
    ],
)
def test_pairs(html, want):
    assert extract.extract(f"<body>{html}</body>")[2] == want


def test_documents(spark):
    rows = [("https://A.example/P?utm_source=x", "https://A.example/P", PAGE, "sitemap", "2025-01-01", 0.5, 1), ("https://a.example/q", "https://a.example/p", PAGE, "bfs", None, None, 2), ("https://a.example/e", "https://a.example/e", "<p></p>", "sitemap", None, None, 3)]
    pages = spark.createDataFrame(rows, "url string, final_url string, html string, source string, lastmod string, priority double, title int")
    docs = extract.normalized(extract.documents(extract.extracted(pages)))
    assert [(r.url, r.original_url, r.page_type, r.source) for r in docs.collect()] == [("https://a.example/p", "https://A.example/P?utm_source=x", "other", "sitemap")]
    assert extract.normalized(extract.documents(extract.extracted(pages.limit(0)))).count() == 0


def test_fetching(spark):
    calls = []
    waits = []

    def transport(url):
        calls.append(url)
        if url.endswith("/down"):
            raise OSError("no route")
        if url.endswith("/busy") and calls.count(url) < 3:
            return 503, url, {"Retry-After": "7"}, ""
        return (404, url, {}, "x") if url.endswith("/gone") else (200, url + "#to", {"a": "b"}, "<p>x</p>")

    one = lambda u: fetching.fetch_one(u, transport, sleep=waits.append)
    assert (one("s/ok")["status_code"], one("s/ok")["final_url"]) == (200, "s/ok#to")
    assert one("s/busy")["attempts"] == 3 and waits == [7.0, 7.0]
    gone = one("s/gone")
    assert (gone["attempts"], gone["html"], gone["error"]) == (1, None, "HTTP 404")
    down = one("s/down")
    assert (down["attempts"], down["status_code"]) == (3, 0) and "no route" in down["error"] and waits[2:] == [2.0, 4.0]
    assert fetching.wait_of("Wed, 01 Jan 2025 00:00:10 GMT", 1, 2.0, 1735689600.0) == 10.0 and fetching.wait_of("soon", 3, 2.0, 0) == 8.0

    urls = spark.createDataFrame([("https://a.example/1", False), ("https://a.example/2", True), ("https://b.example/1", False), ("https://a.example/1", None), (None, True)], "url string, render boolean")
    plain = lambda u: (200, u, {}, "plain")
    browser = lambda u: (200, u, {}, "browser")
    got = fetching.fetch_all(urls, plain, delay=0.0, rendered=browser).collect()
    assert sorted((r.url, r.html, r.render_method) for r in got) == [("https://a.example/1", "plain", "http"), ("https://a.example/2", "browser", "browser"), ("https://b.example/1", "plain", "http")]


def test_embedding(spark):
    tries, waits = [], []

    def flaky(texts):
        tries.append(len(texts))
        if len(tries) < 3:
            raise OSError
        return [[float(len(t))] for t in texts]

    assert fetching.embed_batch(["a", "bb"], flaky, sleep=waits.append) == [[1.0], [2.0]] and waits == [2, 8]
    with pytest.raises(ValueError):
        fetching.embed_batch(["a", "b"], lambda t: [[0.0]], sleep=waits.append)

    def refused(texts):
        raise fetching.Refused

    with pytest.raises(fetching.Refused):
        fetching.embed_batch(["a"], refused, sleep=waits.append)
    df = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(7)], "i int, t string")
    got = fetching.embed_rows(df, "t", lambda texts: [[float(len(t)), float(len(texts))] for t in texts], batch=2, waits=(0,)).collect()
    assert all((r.vector is None) == (r.i == 3) and (r.vector is None or (r.vector[0] == r.i and r.vector[1] <= 2)) for r in got)
    fetching.register("mine", lambda scale=1: lambda texts: [[scale]] * len(texts), 1, 64)
    assert fetching.embedder("mine", scale=3)[0](["a"]) == [[3]]
    with pytest.raises(ValueError):
        fetching.embedder("unknown")


def test_staging(spark, tmp_path):
    path = str(tmp_path)
    assert reports.load_reports(spark, path, "run_id string").count() == 0 and reports.load_failures(spark, path).count() == 0 and reports.load_aliases(spark, path).count() == 0
    rows = spark.createDataFrame([("2025-01-01T10:00:00+00:00", False, 5), ("2025-01-02T10:00:00.5", True, 1)], "run_id string, partial boolean, fetched int")
    reports.save_reports(rows, path)
    reports.save_reports(rows.limit(1).withColumn("fetched", F.lit(6)), path)
    loaded = reports.load_reports(spark, path, "run_id string, partial boolean, fetched int")
    assert [r.name for r in loaded.collect()] == ["report_2025-01-02T10-00-00-5", "report_2025-01-01T10-00-0000-00"]
    assert [r.fetched for r in reports.latest_full(loaded).collect()] == [6]
    reports.save_failures(spark.createDataFrame([("u", "failed_transient", 503, None)], reports.FAILURE), path)
    assert [(r.url, r.source, r.page_type) for r in crawl.retry_targets(reports.load_failures(spark, path)).collect()] == [("u", "sitemap", "other")]
    for target in ("b", "c"):
        new = spark.createDataFrame([("a", target)], reports.ALIAS)
        reports.save_aliases(crawl.merge_aliases(reports.load_aliases(spark, path), new), path)
    assert [r.target for r in reports.load_aliases(spark, path).collect()] == ["c"]


def test_discovery(spark):
    url = lambda u: f"<url><loc>{u}</loc></url>"
    index_of = lambda *us: "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in us) + "</sitemapindex>"
    files = spark.createDataFrame(
        [("r", "<urlset>" + url("https://a.example/1") + url("https://a.example/blogs") + "</urlset>"), ("b", index_of("b1", "b2", "lost")), ("b1", "<urlset>" + url("https://a.example/blogs") + url("https://a.example/2") + "</urlset>"), ("b2", index_of("r")), ("i", index_of("b1", "r")), ("bad", "<html>")],
        "url string, xml string",
    )
    got = lambda *a: sorted((r.url[-1], r.source) for r in sitemap.discover(files, *a).collect())
    assert got("r", "b") == [("1", "sitemap"), ("2", "blog-sitemap"), ("s", "sitemap")]
    assert got("i", "b") == [("1", "sitemap"), ("2", "blog-sitemap"), ("s", "blog-sitemap"), ("s", "sitemap")] or got("i", "b") == [("1", "sitemap"), ("2", "sitemap"), ("s", "sitemap"), ("s", "sitemap")]
    assert got("bad") == [] and got("none", "b") == []


def test_overview_and_lists(spark):
    answers = spark.createDataFrame([("full", 404, "x"), ("short", 200, "see https://a.example/x."), ("other", 200, "y")], "url string, status_code int, text string")
    assert [r.url for r in crawl.first_body(answers, ["full", "short"]).collect()] == ["short"]
    assert crawl.first_body(answers, ["full"]).count() == 0
    found = spark.createDataFrame([("https://a.example/X", None, None, None, "sitemap", "other")], "url string, lastmod string, priority double, changefreq string, source string, page_type string")
    listed = spark.createDataFrame([("https://a.example/x", 1), ("https://a.example/y", 2), ("https://a.example/Y", 3), ("https://a.example/no/z", 4)], "url string, place int")
    more, blocked = crawl.merge_listed(found, listed, [("/no", False)])
    assert sorted((r.url, r.source) for r in more.collect()) == [("https://a.example/X", "sitemap"), ("https://a.example/y", "llms")]
    assert [r.url for r in blocked.collect()] == ["https://a.example/no/z"]


def test_walk_with_limits(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "x"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    walk = lambda **k: {(r.url, r.depth) for r in graph.reachable(edges, seeds, **k).collect()}
    assert walk(limit=2) == {("a", 0), ("b", 1)} and walk(limit=3) == {("a", 0), ("b", 1), ("c", 1)}
    assert walk(max_depth=1) == {("a", 0), ("b", 1), ("c", 1)} and len(walk()) == 6
    assert walk(rules=[("c", False)]) == {("a", 0), ("b", 1), ("d", 2), ("e", 3)}
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), rounds=1)


def test_two_index_writers(spark, tmp_path):
    schema = "chunk_id string, url string, content_hash string, text string"
    one = index.ChunkIndex(spark, str(tmp_path / "ix"))
    assert one.rebuild(spark.createDataFrame([], schema)) == 0 and not one.exists()
    assert one.rebuild(spark.createDataFrame([("a", "u", "1", "x"), ("a", "u", "1", "x")], schema)) == 1
    assert one.read().columns == ["chunk_id", "url", "title", "page_type", "content_hash", "text", "chunk_index", "source", "is_faq", "vector"]
    two = index.ChunkIndex(spark, str(tmp_path / "ix"))
    number = one._numbers()[-1]
    two._numbers = lambda: [number]  # it looked before the other published
    one.upsert(spark.createDataFrame([("b", "v", "1", "y")], schema).withColumn("title", F.lit(None).cast("string")).select(*(F.col(c) if c in ("chunk_id", "url", "content_hash", "text") else F.lit(None).cast(t).alias(c) for c, t in one.read().dtypes)))
    with pytest.raises(RuntimeError):
        two._publish(one.read(), one.meta())
    assert one.read().count() == 2
    assert one.expire(keep=1, older_than=3600) == 0 and one.expire(keep=1, older_than=0, now=4e9) >= 1 and one.read().count() == 2


def test_cells_recall(spark, tmp_path):
    """A hundredth of the table's vectors against all others: at least nine of ten exact neighbours are found."""
    e = spark.read.parquet("/root/testdata/sf0.1/chunks.parquet").where("size(vector) = 64 and chunk_id is not null").dropDuplicates(["chunk_id"]).select("chunk_id", "vector")
    rows = e.withColumn("text", F.lit("x")).withColumn("url", F.lit("u")).withColumn("title", F.lit("t")).withColumn("page_type", F.lit("p"))
    dims = 64
    ix = ann.SearchIndex(spark, str(tmp_path / "s"))
    meta = ix.build(rows, dims=dims)
    assert meta.cells == ann.cells_for(meta.rows) > 1 and ann.eligible(2048) and not ann.eligible(2047) and not ann.eligible(9999, False)
    q = e.where("pmod(xxhash64(chunk_id), 100) = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    key = lambda df: {(r.query_id, r.chunk_id) for r in df.collect()}
    exact, found = key(retrieval.vector_top_k(rows, q, 10, "chunk_id")), key(ix.by_vector(q, 10))
    assert len(found & exact) / len(exact) >= 0.9
    with pytest.raises(ValueError):
        ix.pinned("other", dims)
    assert ix.build(rows.limit(0)) is None


def test_vectors_of_several_lengths(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0]), (3, [1.0, 0.0]), (4, [2.0])], "id long, vector array<double>")
    q = spark.createDataFrame([(7, [1.0]), (8, [1.0, 0.0]), (9, [1.0, 0.0, 0.0])], "query_id long, vector array<double>")
    got = sorted((r.query_id, r.id, r.distance) for r in retrieval.vector_top_k(rows, q, 1).collect())
    assert got == [(7, 2, 0.0), (8, 3, 0.0)]


def test_relevance_falls_back_to_the_query(spark):
    schema = "query_id long, ord int, score double, vector array<double>, query_vector array<double>"
    x, y = [1.0, 0.0], [0.0, 1.0]
    c = spark.createDataFrame([(1, 1, 0.0, y, x), (1, 2, None, x, x), (1, 3, -1.0, x, x), (1, 4, 0.2, None, x)], schema)
    assert [r.ord for r in retrieval.mmr(c, 2).orderBy("pick").collect()] == [2, 4]


def test_pipeline(spark, tmp_path):
    schema = "chunk_id string, url string, title string, page_type string, text string"
    chunks = spark.createDataFrame([(f"c{i}", f"https://a.example/{i % 3}", f"t{i}", "faq", f"The {w} is kept in the cellar. It is old. Really. More.") for i, w in enumerate(["plough", "harrow", "sickle", "scythe", "flail"])], schema)
    ix = ann.SearchIndex(spark, str(tmp_path / "ix"))
    ix.build(chunks.withColumn("vector", retrieval.hash_embedding(F.col("text"))))
    hist = "array<struct<role:string,content:string>>"
    q = spark.createDataFrame([(1, "Where is the plough?", []), (2, "And where is it kept?", [("user", "the flail")])], f"query_id long, question string, history {hist}")
    one = ("hash", 64, answering.hashed)
    rewriter = lambda df: df.withColumn("rewrite", F.lit("Where is the flail kept?"))
    got = {r.query_id: r for r in answering.Pipeline([ann.SearchIndex(spark, "/nowhere"), ix], [one, one], rewriter=rewriter, final=2).answers(q).collect()}
    assert got[1].rewritten_query == "Where is the plough?" and got[2].rewritten_query == "Where is the flail kept?"
    assert got[1].answer.startswith("The plough is kept") and got[2].answer.startswith("The flail is kept") and got[1].chunks_used == 2 and got[1].language == "en" and not got[1].is_decline
    # an index of another embedder, or none, declines without a model
    declined = answering.Pipeline([ix], [("other", 3, answering.hashed)]).answers(q)
    none = declined.collect()
    assert {(r.answer, r.model, r.is_decline, r.chunks_used) for r in none} == {(C.DECLINE, "", True, 0)}
    events = answering.events(declined).where("query_id = 1").orderBy("seq").collect()
    assert [e.event for e in events][-3:] == ["sources", "lead_suggestion", "done"]
    scorer = lambda df: df.withColumn("relevance", F.when(F.contains("text", F.lit("sickle")), 1.0).otherwise(0.1))
    assert {r.answer[:10] for r in answering.Pipeline([ix], [one], scorer=scorer).answers(q).collect()} == {"The sickle"}


def test_language_and_cache(spark):
    texts = ["What is the price of it?", "Wie lange dauert das mit der Rechnung?", "Le prix est pour nous", "¿Cuánto cuesta el plan?", "Команда перенесла отчёт", "チームは在庫表を", "", None, "xyz"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.x for r in df.select("i", C.detect_language(F.col("t")).alias("x")).orderBy("i").collect()] == ["en", "de", "fr", "es", "ru", "ja", "en", "en", "en"]
    now = F.lit("2025-01-02 00:00:00").cast("timestamp")
    old = spark.createDataFrame([("q", "kept")], "question string, data string").select(C.cache_key(F.col("question")).alias("key"), "data", F.lit("2025-01-03 00:00:00").cast("timestamp").alias("expires_at"))
    asked = spark.createDataFrame([("1", " Q "), ("2", "r"), ("3", "s")], "id string, question string")
    fresh = lambda missed: missed.select("id", F.concat(F.lit("new "), "question").alias("answer"), (F.col("id") == "3").alias("is_decline"))
    rows, gains = state.cache_aside(asked, old, now, fresh)
    assert sorted((r.id, r.answer, r.hit) for r in rows.collect()) == [("1", "kept", True), ("2", "new r", False), ("3", "new s", False)]
    assert [r.data for r in gains.collect()] == ["new r"]
    assert [r.x for r in spark.range(1).select(state.country_allowed(F.lit("XX"), ["XX"]).alias("x"), state.country_allowed(F.lit("XX"), []).alias("y")).collect()] == [False]


def test_command_line(spark, tmp_path, capsys):
    from quernstone.__main__ import main
    from quernstone.runtime import kept, release

    assert main(["list"]) == 0 and "hybrid_search" in capsys.readouterr().out
    assert main(["run", "no_such_query", "--data", "x", "--out", "y"]) == 2 and main(["walk"]) == 2
    out = str(tmp_path / "out")
    assert main(["run", "status_counts", "--data", "/root/testdata/sf0.001", "--out", out]) == 0 and spark.read.parquet(out).count() == 1
    assert main(["run", "status_counts", "--data", "/nowhere", "--out", out]) == 1
    release()
    kept(spark.range(3)).count()
    assert release() == 1 and release() == 0
    assert [tuple(r) for r in spark.range(1).select(state.key_ok(F.lit("a"), "a"), state.key_ok(F.lit(None), "a"), state.key_ok(F.lit("x"), None)).collect()] == [(True, False, True)]


def test_failed_search_is_no_decline(spark, tmp_path):
    """A table whose search fails mustn't look like one without answers; the next one may serve."""
    import shutil

    chunks = spark.createDataFrame([(f"c{i}", "https://a.example/", "t", "faq", f"The {w} is old.") for i, w in enumerate(["plough", "harrow"])], "chunk_id string, url string, title string, page_type string, text string")
    broken, whole = (ann.SearchIndex(spark, str(tmp_path / n)) for n in ("a", "b"))
    for ix in (broken, whole):
        ix.build(chunks.withColumn("vector", retrieval.hash_embedding(F.col("text"))))
    for part in (tmp_path / "a" / "vectors").glob("part-*"):
        part.write_bytes(b"no parquet")
    for part in (tmp_path / "a" / "vectors").glob(".part-*"):
        part.unlink()
    q = spark.createDataFrame([(1, "plough", [])], "query_id long, question string, history array<struct<role:string,content:string>>")
    one = ("hash", 64, answering.hashed)
    with pytest.raises(Exception):
        answering.Pipeline([broken], [one]).answers(q).collect()
    assert [r.answer for r in answering.Pipeline([broken, whole], [one, one], final=1).answers(q).collect()] == ["The plough is old."]
    shutil.rmtree(tmp_path / "b" / "postings")
    assert [r.is_decline for r in answering.Pipeline([whole], [one]).answers(q).collect()] == [False]


def test_packed_postings(spark, monkeypatch):
    """Blocks and what tasks score together don't change the ranking; ties go to the smaller key."""
    docs = spark.createDataFrame([(f"d{i:03}", f"red w{i % 7} " + "blue " * (i % 3)) for i in range(200)] + [("e", ""), ("f", None)], "id string, text string").repartition(3)
    q = spark.createDataFrame([(1, "red blue"), (2, "w3 Red"), (3, "none"), (4, None)], "query_id long, query string")
    want = [tuple(r) for r in retrieval.bm25_top_k(docs, q, 5, "id").orderBy("query_id", "rank").collect()]
    assert len(want) == 10 and [w[1] for w in want[:5]] == ["d002", "d005", "d008", "d011", "d014"] and [w[3] for w in want] == [1, 2, 3, 4, 5] * 2
    monkeypatch.setattr(retrieval, "PACK", 16)
    monkeypatch.setattr(retrieval, "TOGETHER", 32)
    stored = retrieval.packed(docs, "id")
    assert stored.where("term is null").count() >= 13 and stored.count() < docs.count()
    assert [tuple(r) for r in retrieval.bm25(stored, q, 5, "id").orderBy("query_id", "rank").collect()] == want
    assert retrieval.bm25(stored, q.limit(0), 5, "id").count() == 0


def test_distances_are_held_in_slices(spark, monkeypatch):
    """Neither centres nor nearest rows depend on how many distances are held at once."""
    x = np.random.default_rng(3).normal(size=(500, 8)).round(3)
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vector array<double>")
    q = rows.where("id < 40").withColumnRenamed("id", "query_id")
    search = lambda: [tuple(r) for r in retrieval.vector_top_k(rows, q, 6).orderBy("query_id", "rank").collect()]
    mid, found = ann.centres(x, 20), search()
    monkeypatch.setattr(ann, "SLICE", 64)
    monkeypatch.setattr(retrieval, "CELLS_AT_ONCE", 64)
    assert np.allclose(ann.centres(x, 20), mid) and search() == found
    import tracemalloc

    big = np.random.default_rng(4).normal(size=(20_000, 8))
    tracemalloc.start()
    ann.centres(big, 500, 1)
    assert tracemalloc.get_traced_memory()[1] < 40e6  # all distances at once are 80 MB
    tracemalloc.stop()
