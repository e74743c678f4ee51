import pytest
from pyspark.sql import functions as F

from quernstone.operators import incremental as I
from quernstone.plans import increments


def test_url_hash_and_instant(spark):
    df = spark.createDataFrame([("SHA256:AB ", "HTTPS://www.A.example/X/?q#f", "2025-01-01T05:30:00+05:30"), (" ", "www.a.example/", "2025-01-01"), (None, None, "unknown"), ("ab", "https://a.example/x", "0000-00-00")], "h string, u string, t string")
    rows = df.select(I.clean_hash(F.col("h")).alias("h"), I.clean_url(F.col("u")).alias("u"), I.instant(F.col("t")).cast("string").alias("t")).collect()
    assert [r.h for r in rows] == ["ab", None, None, "ab"]
    assert [r.u for r in rows] == ["https://a.example/x", "a.example", None, "https://a.example/x"]
    assert [r.t for r in rows] == ["2025-01-01 00:00:00", "2025-01-01 00:00:00", None, None]


def brute(reports, records, base):
    ok = sorted({r for r, f, p in reports if f and p is False})
    state, out, prev = dict(base), set(), ""
    best = {k: -1 for k in base}
    for run in ok:
        before = dict(state)
        for r, c, s, h in records:
            if r and prev < r <= run and h and s > best.get(c, -1):
                best[c], state[c] = s, h
        out |= {(run, c) for c in state if before.get(c) != state[c]}
        prev = run
    return out


def test_changed_versions(spark):
    import random

    rng = random.Random(2)
    runs = [f"r{i}" for i in range(8)]
    reports = [(r, "x" if rng.random() < 0.7 else None, rng.random() < 0.3) for r in runs] + [("r3", "x", False)]
    edits = {}
    records = [(rng.choice(runs + ["r2b", "r9"]), f"c{rng.randrange(6)}", rng.randrange(40), None) for _ in range(150)]
    records = [(r, c, s, edits.setdefault((c, s), rng.choice(["a", "b", "c", None]))) for r, c, s, _ in records]
    base = {"c1": "a", "c2": "b", "c7": "z"}
    rep = spark.createDataFrame(reports, "run_id string, finished_at string, partial boolean")
    rec = spark.createDataFrame(records, "run_id string, chunk_id string, edit_seq long, hash string")
    got = I.changed_versions(rec, I.commit_of_runs([rec], rep), spark.createDataFrame(list(base.items()), "chunk_id string, hash string"), "chunk_id", "edit_seq", "hash")
    assert {(r.commit_run, r.chunk_id) for r in got.collect()} == brute(reports, records, base)


def test_commits_survive_failures(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"k{i % 7}") for i in range(1, 31)], "seq long, k string")
    log = I.CommitLog(spark, str(tmp_path / "log"))
    fine = lambda df: {"out": df}

    def broken(df):
        raise OSError("lost")

    assert I.run_incremental(log, rows, "seq", fine, upper=10).watermark == 10
    with pytest.raises(OSError):
        I.run_incremental(log, rows, "seq", broken, upper=20)
    # rows written but never published stay invisible
    rows.where("seq > 10").write.parquet(str(tmp_path / "log/rows/out/commit=000000000002-dead"))
    assert log.read("out").count() == 10
    assert I.run_incremental(log, rows, "seq", fine).watermark == 30
    assert I.run_incremental(log, rows, "seq", fine) is None
    assert sorted(r.seq for r in log.read("out").collect()) == list(range(1, 31))
    with pytest.raises(RuntimeError):
        log.publish(I.Commit(2, 99, {}))
    assert I.run_incremental(log, rows.limit(0), "seq", fine) is None


def test_empty(spark, tmp_path):
    import duckdb

    for name in ("crawl_reports", "chunk_runs", "discovered", "chunks"):
        duckdb.sql(f"copy (select * from '/root/testdata/sf0.001/{name}.parquet' limit 0) to '{tmp_path}/{name}.parquet'")
    assert increments.found(spark, str(tmp_path)).count() == 0


def history(spark, seed):
    import random

    rng = random.Random(seed)
    runs = [f"r{i}" for i in range(6)]
    reports = [(r, "x" if rng.random() < 0.8 else None, rng.random() < 0.3) for r in runs] + [("r5", "x", False)]
    edits = {}
    records = [(rng.choice(runs + ["r2b", "r9"]), f"c{rng.randrange(6)}", rng.randrange(30)) for _ in range(80)]
    records = [(r, c, s, edits.setdefault((c, s), rng.choice(["a", "b", None]))) for r, c, s in records]
    base = {"c1": "a", "c2": "b", "c7": "z"}
    rep = spark.createDataFrame(reports, "run_id string, finished_at string, partial boolean")
    rec = spark.createDataFrame(records, "run_id string, item string, o long, v string")
    listed = rec.select("run_id", "item", F.timestamp_seconds("o").alias("at"))
    return reports, records, base, rec, listed, spark.createDataFrame(list(base.items()), "item string, v string"), I.commit_of_runs([rec], rep)


def windows(rec, listed, commits):
    urls = I.changed_listings(listed, commits, "item", "at")
    return {(r.commit_run, r.item) for r in urls.collect()}


@pytest.mark.parametrize("crash", range(5))
def test_runs_of_a_history_survive_a_crash_anywhere(spark, tmp_path, monkeypatch, crash):
    """The process dies at its n-th write or publication; the next one takes up where the log stands."""
    reports, records, base, rec, listed, old, commits = history(spark, crash)
    log = I.CommitLog(spark, str(tmp_path / "log"))
    left = [crash * 2 + 1]
    real = I.put_once

    def dying(*args):
        left[0] -= 1
        if left[0] == 0:
            raise OSError("lost")
        return real(*args)

    def writing(self, path, *args, **kw):
        left[0] -= 1
        if left[0] == 0:
            raise OSError("lost")
        return parquet(self, path, *args, **kw)

    from pyspark.sql.readwriter import DataFrameWriter

    parquet = DataFrameWriter.parquet
    monkeypatch.setattr(I, "put_once", dying)
    monkeypatch.setattr(DataFrameWriter, "parquet", writing)
    with pytest.raises(OSError):
        for _ in range(9):
            I.changed_runs(log, rec, listed, old, commits)
            log = I.CommitLog(spark, str(tmp_path / f"log{_}"))
    versions, urls = I.changed_runs(log, rec, listed, old, commits)
    got = [(r.commit_run, r.item) for r in versions.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(reports, records, base)
    assert {(r.commit_run, r.item) for r in urls.collect()} == windows(rec, listed, commits)


def test_two_writers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    log = I.CommitLog(spark, str(tmp_path / "log"))

    def publish(n):
        try:
            log.publish(I.Commit(1, n, {}))
            return n
        except RuntimeError:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [n for n in pool.map(publish, range(24)) if n is not None]
    assert len(won) == 1 and [c.watermark for c in log.commits()] == won


def test_operator_and_windows_agree(spark):
    d = "/root/testdata/sf0.001"
    key = lambda df: sorted((r.kind, r.run_id, r.item) for r in df.collect())
    assert key(increments.found(spark, d)) == key(increments.by_windows(spark, d))
