"""Every query with SQL against DuckDB on the smallest tables, the others for what they must give there."""

from collections import Counter

import duckdb
import pytest

from quernstone.plans import catalog

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, name):
    import glob
    import os

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = catalog.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = Counter(tuple(str(plain(r[k])) for k in cols) for r in df.collect())
    r = c.execute(catalog.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = Counter(tuple(str(plain(x[names.index(k)])) for k in cols) for x in r.fetchall())
    assert got == want


def rows(spark, name):
    return catalog.QUERIES[name](spark, DIR).collect()


def test_all_are_covered():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"extracted_pages", "normalized_documents", "indexed_vector_search", "smoke_search", "answers", "answer_events", "streamed_answers"}


def test_extracted_pages(spark):
    out = rows(spark, "extracted_pages")
    pages = spark.read.parquet(f"{DIR}/fetches.parquet").where("status_code = 200 and html is not null").count()
    assert len(out) == pages and sum(r.method == "fallback" for r in out) > pages / 2 and all(r.title == r.title.strip() for r in out)


def test_normalized_documents(spark):
    out = rows(spark, "normalized_documents")
    assert out and len({r.url for r in out}) == len(out) and all(len(r.content_hash) == 64 for r in out)


def test_indexed_vectors_are_near(spark):
    """Below the least size the index is exact."""
    got = {(r.query_id, r.chunk_id) for r in rows(spark, "indexed_vector_search")}
    from quernstone.operators import retrieval
    from quernstone.plans import queries

    chunks, asked = queries._searchable(spark, DIR)
    assert got == {(r.query_id, r.chunk_id) for r in retrieval.vector_top_k(chunks, asked, row_id="chunk_id").collect()}


def test_smoke(spark):
    out = rows(spark, "smoke_search")
    assert {r.search for r in out} == {"vector", "text"} and all(len(r.text) <= 120 for r in out) and len(out) <= 10


def test_answers(spark):
    out = rows(spark, "answers")
    asked = spark.read.parquet(f"{DIR}/hits.parquet").where("title is not null").select("query_id").distinct().count()
    assert len(out) == asked and all(0 < r.chunks_used <= 6 and r.answer and not r.is_decline and r.model for r in out)
    events = rows(spark, "answer_events")
    by = {}
    for e in sorted(events, key=lambda e: (e.query_id, e.seq)):
        by.setdefault(e.query_id, []).append(e.event)
    assert len(by) == asked and all(v[-2:] == ["sources", "done"] and set(v[:-2]) == {"answer"} for v in by.values())


def test_streamed_answers(spark):
    """Tokens have at most two words and give the answer's words again."""
    import json

    by = {}
    for r in sorted(rows(spark, "streamed_answers"), key=lambda r: (r.id, r.seq)):
        token = json.loads(r.data)["token"]
        assert len(token.split()) <= 2
        by.setdefault(r.id, []).append(token)
    answers = {r.id: r.answer for r in spark.read.parquet(f"{DIR}/feedback.parquet").where("answer is not null").collect()}
    assert all("".join(v).split() == answers[k].split() for k, v in by.items())
