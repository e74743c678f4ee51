import random

import pytest
from pyspark.sql import functions as F

from quernstone.llm import nearsets


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.5:
            w = rng.choice(docs).split()
            for _ in range(rng.randrange(0, 6)):
                if w:
                    k = rng.randrange(len(w))
                    w[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [w[k], rng.choice(vocab)]])
            docs.append(" ".join(w))
        else:
            docs.append(" ".join(rng.choice(vocab) for _ in range(rng.choice([2, 4, 8, 20, 60, 150]))))
    return docs


def brute(rows, words, threshold):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        s = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
        if s:
            sets[i] = s
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def pairs(spark, rows, words, threshold):
    df = spark.createDataFrame(rows, "ord int, markdown string, id int, text int") if len(rows[0]) == 4 else spark.createDataFrame(rows, "ord int, markdown string")
    links, members = nearsets.near_duplicates(df, "ord", "markdown", words, threshold)
    m = {}
    for r in members.collect():
        m.setdefault(r.rep, []).append(r.id)
    got = {(min(i, j), max(i, j)) for r in links.collect() for i in m[r.a] for j in m[r.b]}
    return got | {(r.a, r.b) for r in nearsets.copies(members).collect()}


@pytest.mark.parametrize("kind", ["auto", "exact", "deletion"])
@pytest.mark.parametrize("words,threshold", [(3, 0.7), (5, 0.8)])
def test_brute_force(spark, monkeypatch, kind, words, threshold):
    def allocate(t, tops, counts, sketch):
        out = {}
        for k, top in enumerate(tops.tolist()):
            h = nearsets.allowed(t, top + top / t)
            half = -(-(h + 1) // 2)
            z = nearsets.slack(half, max(1, int(t * top)))
            out[k] = nearsets.Plan("deletion", half + z, z) if kind == "deletion" else nearsets.Plan(*(("token",) if k % 3 == 0 else ("exact", 2 * h + 2)))
        return out

    if kind != "auto":
        monkeypatch.setattr(nearsets, "allocate", allocate)
    if kind != "deletion":
        monkeypatch.setattr(nearsets, "BUCKET_ROWS", 12)
        monkeypatch.setattr(nearsets, "COPIES_BLOCK", 2)
    rows = list(enumerate(corpus(words))) + [(900, None), (901, ""), (902, " "), (903, "w1 w2"), (904, "w1 w2")]
    assert pairs(spark, rows, words, threshold) == brute(rows, words, threshold)


def test_clashing_columns_and_empty(spark):
    assert pairs(spark, [(1, "a b c d", 5, 6), (2, "a b c d", 5, 6), (3, "x y z", 1, 1)], 3, 0.7) == {(1, 2)}
    df = spark.createDataFrame([], "ord int, markdown string")
    links, members = nearsets.near_duplicates(df, "ord", "markdown", 3, 0.7)
    assert links.count() == 0 and members.count() == 0


def test_long_text(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    assert pairs(spark, [(1, long), (2, long + " more"), (3, "t1 t2 t3 t4")], 3, 0.7) == {(1, 2)}
    assert F is not None


def test_many_buckets(spark, monkeypatch):
    """Buckets are met range by range, few enough rows a bucket that none is split into blocks, and no pair is lost."""
    from quernstone.llm import meet

    made, whole = [], nearsets.together

    def together(rows, *args):
        made.append((args[-1], rows.count(), rows.agg(F.sum(F.length("keys")) / 8).first()[0]))
        return whole(rows, *args)

    def split(*_):
        raise AssertionError("a bucket holds more rows than meet in a task")

    for name, value in (("BUCKET_KEYS", 10_000), ("BUCKET_ROWS", 150), ("LEAST_KEYS", 100), ("PASS_BYTES", 10), ("PASS_LEAST", 1)):
        monkeypatch.setattr(nearsets, name, value, raising=False)
    monkeypatch.setattr(meet, "in_blocks", split)
    monkeypatch.setattr(nearsets, "together", together)
    rows = list(enumerate(corpus(7, 400)))
    assert pairs(spark, rows, 3, 0.7) == brute(rows, 3, 0.7)
    assert len(made) > 1 and all(n < 2 * sum(m for _, m, _ in made) / len(made) for _, n, _ in made)
