import re
import unicodedata

from quernstone.llm import repeats


def brute(rows, urls=5, share=0.25):
    key = lambda s: "".join(c for c in s.lower() if unicodedata.category(c)[0] == "L")
    site, seen, places = {}, {}, []
    for o, u, m in rows:
        if not u or not (h := re.match(r"\w+://([^/?#]+)", u.lower())):
            continue
        site.setdefault(h[1], set()).add(u)
        for i, line in enumerate((m or "").split("\n")):
            k = key(line)
            if len(k) >= 3:
                seen.setdefault((h[1], k), set()).add(u)
                places.append((o, i, h[1], k))
    return {(o, i) for o, i, h, k in places if len(seen[h, k]) >= urls and len(seen[h, k]) >= share * len(site[h])}


def rows():
    import random

    rng = random.Random(3)
    bar = ["© 2024 Site. All rights reserved", "**Share** this   page!", "ok", "Ünïcode İ line – ñ", "x" * 400 + " tail of a very long notice", "日本語のお知らせ"]
    out = []
    for i in range(60):
        lines = [f"# Title {rng.random()}", *(f"unique words {rng.random()} {chr(97 + i % 26) * (i + 1)}" for _ in range(3)), *(x.upper() if rng.random() < 0.3 else x for x in bar if rng.random() < 0.5)]
        rng.shuffle(lines)
        out.append((i, f"https://s{i % 3}.example/p{i // 2}", "\r\n".join(lines) if i % 5 == 0 else "\n".join(lines)))
    return [*out, (100, "https://s0.example/n", None), (101, "https://s0.example/e", ""), (102, None, "ok line"), (103, "no url", "x"), (104, "https://s1.example/p1", "\n" * 50)]


def test_brute(spark):
    df = spark.createDataFrame([(*r, 1) for r in rows()], "ord int, url string, markdown string, line int")
    got = {(r.ord, r.line_no) for r in repeats.repeated_lines(df).collect()}
    assert got == brute(rows()) and got


def test_join_path(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BROADCAST_KEYS", -1)
    df = spark.createDataFrame(rows(), "ord int, url string, markdown string")
    lines = repeats.repeated_lines(df)
    assert {(r.ord, r.line_no) for r in lines.collect()} == brute(rows())
    for r in repeats.without_lines(df, lines).where("markdown is not null").collect():
        bad = {i for o, i in brute(rows()) if o == r.ord}
        text = next(m for o, _, m in rows() if o == r.ord)
        assert r.markdown == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in bad)


def test_empty(spark):
    assert repeats.repeated_lines(spark.createDataFrame([], "ord int, url string, markdown string")).count() == 0
