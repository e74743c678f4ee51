import numpy as np
import pytest

from quernstone.llm import abuse, maincontent, mixing, neighbours, pairs, personal
from quernstone.llm.linear import threshold

G = personal.Gazetteer(frozenset({"ilse", "soren"}), frozenset({"kolmetti", "wexlulescu"}))


@pytest.mark.parametrize(
    "text,want",
    [
        ("Mail ilse.kolmetti@a.example or Søren Wexlulescu", ["email", "name"]),
        ("call (266) 555-0127 or ０１７１ ３９２００９９", ["phone", "phone"]),
        ("Our order no. 557-761-7455 is open, ticket #9517267605, version 46.98.37 on 10.39.46.6", []),
        ("My DNI is 00000000-T.", ["id_number"]), ("SSN 123-45-6789", ["id_number"]), ("Invoice 9118 6143 4743 was paid", []),
        ("We live at 12 Larmo Street, Suite 5, Ostertal 35938 now", ["address"]), ("P.O. Box 6629, Molin", ["address"]), ("Calle Kolm 211, 3ºA, 16438 Valde", ["address"]), ("229 bis, rue du Holm, Quay", ["address"]), ("Castelweg 107b, 94317 Birken", ["address"]),
        ("The street view broke. Model Yarra Avenue 91 is sold out.", []), ("Kolmetti, Ilse wrote", ["name"]), ("ping @ilse-team on the board", []), ("me [at] x [dot] example", ["email"]), ("four seven nine five five five zero one", ["phone"]),
        ("", []), (None, []), ("   ", []), ("x" * 100_000, []),
    ],
)
def test_personal(text, want):
    assert [s.kind for s in personal.spans(text, G)] == want


def test_redact():
    assert personal.redact("Hi Ilse, mail a@b.example!", G) == "Hi [NAME], mail [EMAIL]!"
    assert personal.redact("I​lse Kolmetti", G) == "[NAME]" and personal.redact(None, G) is None
    assert personal.nir("255081416802538") and personal.dni("12345678", "Z") and personal.luhn("79927398713") and personal.mod11_10("36574261809")


def test_personal_items(spark):
    df = spark.createDataFrame([("leads", "1", "message", "a@b.example a@b.example", 9)] * 2, "source_table string, rec_id string, field string, text string, kind int").select("source_table", "rec_id", "field", "text")
    assert sorted(r.seq for r in personal.personal_items(df, G).collect()) == [1, 2]
    assert personal.gazetteer(spark.createDataFrame([("Ilse Kolmetti",), ("Ilse Kolmetti",), (None,), ("test",)], "name string")).given == {"ilse"}
    assert personal.personal_items(df.limit(0), G).count() == 0


def test_rare_names(spark):
    names = spark.createDataFrame([("Ilse Kolmetti",)] * 3 + [("Soren Wexlulescu-Abramo",)], "name string")
    fields = spark.createDataFrame([("leads", "1", "message", "Yesterday Søren Abramo called."), ("leads", "2", "message", "Nobody called.")], "source_table string, rec_id string, field string, text string")
    assert [(r.rec_id, r.kind) for r in personal.personal_items(personal.with_names(fields, names)).collect()] == [("1", "name")]
    assert personal.gazetteer(names).family == {"kolmetti", "wexlulescu", "abramo"}


PAGE = """<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
<div class=q><p>Ann 1.2.2024, 3 min</p><h1>The &amp; title</h1><p>A long first paragraph with <b>many</b> words that says something at length.
<h2>Part</h2><ul><li>First item says a whole sentence.<li>Second item says another one.</ul><div class=z><p>Buy now from us today!</p></div>
<table><tr><td>Cell one</td><td>12</td></tr></table><p>A closing paragraph, also with a good number of words in it.</p><ul><li>Mail</li><li>Print</li></ul></div>
<aside><p>Other text of the sidebar that is quite long as well, really.</p></aside><footer><p>All rights reserved here.</p></footer></body></html>"""


def test_html():
    assert maincontent.article_of_html(PAGE) == ["The & title", "A long first paragraph with many words that says something at length.", "Part", "First item says a whole sentence.", "Second item says another one.", "Cell one", "12", "A closing paragraph, also with a good number of words in it."]
    for bad in (None, "", "  ", "<", "<p", "</div></div>", "<![CDATA[", "<a" * 5000, "text only"):
        assert isinstance(maincontent.article_of_html(bad), list)


def test_markdown():
    text = "[Home](/) | [Blog](/b)\n# Title\n\nBy Ann B · 2024-01-02 · 4 min read\n\nA sentence that is part of the article.\n\n- Related title one\n- Related title two\n\n- An item that is a sentence.\n\n```\nx.open()\n```\n| a | b |\nWe use cookies. Accept all | Settings\n## End\nLast words here."
    assert maincontent.article_of_markdown(text) == ["# Title", "A sentence that is part of the article.", "- An item that is a sentence.", "x.open()", "| a | b |", "## End", "Last words here."]
    assert maincontent.article_of_markdown(None) == [] and maincontent.article_of_markdown(" \n") == []


def test_articles_of_tables(spark):
    docs = spark.createDataFrame([(1, "https://a.example/1", "T", "# T\nText is here."), (2, None, None, None), (3, "https://a.example/3", None, "")], "ord int, url string, title string, markdown string")
    assert {r.block_head for r in maincontent.markdown_articles(docs).collect()} == {"# T", "Text is here."}
    assert maincontent.markdown_articles(docs.limit(0)).count() == 0
    assert maincontent.html_articles(spark.createDataFrame([(1, None), (2, PAGE)], "fetch_id long, html string")).count() == 8


def test_repeated_lines_of_near_duplicates(spark):
    """What one article's versions share isn't boilerplate, whatever their titles; headings and code never are."""
    words = "alpha bravo carbon delta ember fjord granite harbor island juniper kelp lantern meadow nickel orchard pepper quartz river summit timber".split()
    rng = np.random.default_rng(4)
    say = lambda: " ".join(str(w) for w in rng.choice(words, 12)).capitalize() + "."
    notice = "The operator of these pages gives no promise about anything."
    shared = ["## A part of its own", *(say() for _ in range(12))]
    rows = [(i, f"https://a.example/v{i}", f"Version {w}", "\n".join([f"# Version {w}", *shared, say(), notice])) for i, w in enumerate(words[:6])]
    rows += [(10 + i, f"https://a.example/{i}", f"Other {w}", "\n".join([f"# Other {w}", *(say() for _ in range(12)), notice])) for i, w in enumerate(words[6:12])]
    got = {(r.rec_id, r.block_head) for r in maincontent.markdown_articles(spark.createDataFrame(rows, "ord int, url string, title string, markdown string")).collect()}
    assert {(i, maincontent.head(x)) for i in range(6) for x in shared} <= got
    assert not any(head == maincontent.head(notice) for _, head in got)
    assert maincontent.article_of_markdown("# T\n## Part\nText is here.\n```\nx.open()\n```", {1, 2, 4}) == ["# T", "## Part", "x.open()"]


def test_pairs_held_out():
    import random

    rng = random.Random(5)
    subject, verb, thing = ["our team", "the vendor", "a partner", "the client"], ["checks", "moves", "ships", "keeps"], ["the new portal", "an old server", "the billing job", "a second index"]
    say = lambda: f"{rng.choice(subject)} {rng.choice(verb)} {rng.choice(thing)} before the {rng.choice(['spring', 'winter', 'summer'])} release".capitalize()
    good = [(f"How does {rng.choice(subject)} work with {rng.choice(thing)}?", f"{say()}. {say()}.") for _ in range(400)]
    model = pairs.fit(good)
    gen = np.random.default_rng(9)
    fresh = [(f"Can {rng.choice(subject)} change {rng.choice(thing)}?", f"{say()}. {say()}.") for _ in range(150)]
    cut = [(q, pairs.cut_off(a, gen)) for q, a in fresh]
    assert sum(not d for d in model.defects(fresh)) >= 140
    assert sum("truncated" in d for d in model.defects(cut)) >= 120
    assert all("echo" in d for d in model.defects([(q, q) for q, _ in fresh]))
    assert sum("refusal" in d for d in model.defects([(q, "I'm sorry, but I cannot help with that.") for q, _ in fresh])) >= 140
    assert model.defects([("Q?", None), (None, ""), ("Q?", "N/A"), ("Q?", "<p></p>")]) == [["empty"]] * 4
    assert model.defects([(None, "Some text."), ("", "x" * 50_000)]) is not None
    assert pairs.fit([]).defects([("a", None)]) == [["empty"]]
    assert pairs.asked_language("Who? Please answer in German.") == {"de"}


def test_refusal_after_a_preamble():
    import random

    rng = random.Random(6)
    subject, verb, thing = ["our team", "the vendor", "a partner", "the client"], ["checks", "moves", "ships", "keeps"], ["the new portal", "an old server", "the billing job", "a second index"]
    say = lambda: f"{rng.choice(subject)} {rng.choice(verb)} {rng.choice(thing)} before the {rng.choice(['spring', 'winter', 'summer'])} release".capitalize()
    ask = lambda: f"How does {rng.choice(subject)} work with {rng.choice(thing)}?"
    model = pairs.fit([(ask(), " ".join(say() + "." for _ in range(rng.choice([1, 2, 5])))) for _ in range(400)])
    long = [(ask(), " ".join(say() + "." for _ in range(5))) for _ in range(60)]
    assert sum("refusal" in d for d in model.defects(long)) <= 1
    assert sum("refusal" in d for d in model.defects([(q, f"{a} I'm sorry, but I cannot help with that. {say()}. {say()}.") for q, a in long])) >= 57
    text = " ".join(f"w{i}" for i in range(200)) + ". " + "x" * 3000
    assert pairs.passages("Short.") == [] and {w for p, _ in pairs.passages(text) for w in p.split()} >= {f"w{i}" for i in range(199)}


def test_threshold():
    assert threshold(np.array([0.9, 0.8, 0.2]), np.array([True, True, False]), 0.9) == 0.5
    assert threshold(np.zeros(3), np.zeros(3, bool), 0.9) == 0.5


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 64))
    near = base[:150] + 0.15 * rng.normal(size=(150, 64))
    x = np.vstack([base, near, base[:3]])
    rows = [(f"c{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)] + [("n1", None), ("n2", [0.0] * 64), ("n3", [float("nan")] * 64), ("n4", [1.0]), ("s1", [float(v) * 3 for v in base[7]])]
    got = {(r.chunk_a, r.chunk_b) for r in neighbours.similar_pairs(spark.createDataFrame(rows, "id string, vector array<float>"), 5, 0.9).collect()}
    ids, y = [r[0] for r in rows if r[0][0] in "cs"], np.vstack([x, base[7] * 3])
    y = y / np.linalg.norm(y, axis=1)[:, None]
    sim = y @ y.T
    want = set()
    for i in range(len(y)):
        order = sorted((j for j in range(len(y)) if j != i), key=lambda j: (-round(sim[i, j], 9), ids[j]))[:5]
        want |= {tuple(sorted((ids[i], ids[j]))) for j in order if sim[i, j] >= 0.9}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want)
    assert neighbours.similar_pairs(spark.createDataFrame([], "id string, vector array<float>"), 5, 0.9).count() == 0


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(5, 16)).astype(np.float32)
    assert np.allclose(np.linalg.norm(neighbours.rotated(x, 3), axis=1), np.linalg.norm(x, axis=1), atol=1e-4)


def test_fill_is_exact():
    import itertools
    import random

    rng = random.Random(2)
    for _ in range(60):
        items = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        counts = {n: items.count(n) for n in items}
        budget = rng.randrange(0, sum(items) + 5)
        got = mixing.fill(counts, budget)
        assert all(0 < c <= counts[n] for n, c in got.items())
        best = max(s for r in range(len(items) + 1) for c in itertools.combinations(items, r) if (s := sum(c)) <= budget)
        assert sum(n * c for n, c in got.items()) == best


def test_mixture(spark):
    docs = spark.createDataFrame([(i, f"word {i} " * (i % 5 + 1), "A ", None) for i in range(40)] + [(100 + i, "same text here", "b", 1) for i in range(5)] + [(200, None, "a", 1), (201, "", "a", 1), (202, "x", None, 1)], "doc_id long, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("B", 0.4, 3), ("none", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mixture(docs, targets)
    rows = {r.source: r for r in report.collect()}
    assert rows["none"].tokens == 0 and rows["b"].most_times == 3 and rows["b"].texts == 1
    assert abs(rows["a"].tokens - rows["a"].budget) == 0
    assert all(r.times <= 3 for r in chosen.collect())
    assert mixing.mixture(docs.limit(0), targets)[0].count() == 0


def test_abuse():
    assert abuse.plain("f.o.o.l bl​oooody s3x mоrоn") == "fool bloody sex moron"
    model = abuse.fit([(f"The team number {i} moves the server. It works well.", None) for i in range(60)] + [("The team moves. You are a stupid idiot.", "abuse")])
    p = abuse.document_scores(model, ["You pathetic idiot, shut your mouth.", "The team moves the server.", None, "", " ", "Free porn, hot naked girls. " + "The team moves. " * 3000])
    assert p[0, 0] > 0.3 > p[1, 0] and p[2:5].max() == 0 and p[5, 2] > 0.3


def test_fill_beyond_the_program(monkeypatch):
    """With a small program the choice is still the nearest one: lengths with a common divisor, and few long ones."""
    import itertools
    import random

    monkeypatch.setattr(mixing, "KNAPSACK", 8)
    rng = random.Random(5)
    for unit in (1, 3, 10):
        for _ in range(40):
            items = [unit * rng.randrange(1, 40) for _ in range(rng.randrange(1, 9))]
            counts = {n: items.count(n) for n in items}
            budget = rng.randrange(0, sum(items) + 5)
            got = mixing.fill(counts, budget)
            assert all(0 < c <= counts[n] for n, c in got.items())
            assert sum(n * c for n, c in got.items()) == max(s for r in range(len(items) + 1) for c in itertools.combinations(items, r) if (s := sum(c)) <= budget)


def test_hot_length(spark, monkeypatch):
    """Nearly all texts of one length: the seeded choice takes exactly so many."""
    docs = spark.createDataFrame([(i, f"word {i:04d} here", "a") for i in range(3000)] + [(9000 + i, f"more words {i} stand here now", "b") for i in range(40)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    counts = docs.select("doc_id", mixing.F.size(mixing.F.split("text", " ")).alias("n_tokens"))
    chosen, report = mixing.mixture(docs, targets, counts=counts)
    a = next(r for r in report.collect() if r.source == "a")
    assert a.budget - a.tokens < 3 and a.texts == a.budget // 3 and chosen.count() == chosen.select("doc_id").distinct().count()
    again = mixing.mixture(docs.repartition(7), targets, counts=counts)[0]
    assert {tuple(r) for r in chosen.collect()} == {tuple(r) for r in again.collect()}


def test_cards_and_long_texts():
    assert personal.spans("Call me: 4111 1111 1111 1111", G) == []
    assert [s.kind for s in personal.spans("My personnummer is 811218 9876", G)] == ["id_number"]
    # sentences far beyond any prefix count in training as well as in scoring
    model = abuse.fit([(f"The team number {i} moves the server. It works well. " * 200 + "You are a stupid idiot.", "abuse") for i in range(3)] + [(f"The team number {i} moves the server. It works well.", None) for i in range(60)])
    assert abuse.document_scores(model, ["The team moves the server. " * 900 + "You pathetic idiot, shut your mouth."])[0, 0] > 0.3


def test_join_path_of_markdown(spark, monkeypatch):
    from quernstone.llm import repeats

    lines = ["Book a demo with our friendly crew today and save.", "Our bureau in the old harbour answers every letter."]
    body = lambda i: f"# Title {i}\\n\\n" + " ".join(f"w{i}x{k}" for k in range(60)) + ".\\n\\n" + "\\n\\n".join(lines)
    docs = spark.createDataFrame([(i, f"https://a.example/{i}", f"T{chr(97 + i)}", body(i)) for i in range(9)], "ord int, url string, title string, markdown string")
    key = lambda: {(r.rec_id, r.block_head) for r in maincontent.markdown_articles(docs).collect()}
    sent = key()
    monkeypatch.setattr(repeats, "BROADCAST_KEYS", -1)
    assert key() == sent and not any(h.startswith("Book a demo") for _, h in sent)


def test_abuse_among_many_judged():
    """What many documents were judged for is learned, however common it is among them."""
    said = ["Those folk from the valley spoil the soup", "Nobody born across the river may hold a key", "The hill people always count their coins twice"]
    sound = [f"The team number {i} moves the server. It works well. The report {i % 7} is ready." for i in range(60)]
    judged = [(f"{sound[i % 60]} {said[i % 3]}.", "hate") for i in range(240)]
    model = abuse.fit([*judged, *((t, None) for t in sound)])
    p = abuse.document_scores(model, [f"{sound[3]} {s}." for s in said] + sound[:5])
    assert (p[:3, 1] >= model.limits[1]).all() and (p[3:, 1] < model.limits[1]).all()


def test_abuse_training_mixture(spark, monkeypatch):
    """However many judged cases there are, sound documents stay the most in training."""
    monkeypatch.setattr(abuse, "LABELLED_DOCS", 40)
    docs = spark.createDataFrame([(i, f"text {i}", "s") for i in range(200)], "doc_id long, text string, source string")
    said = spark.createDataFrame([(i, "hate" if i < 100 else "ok") for i in range(150)], "doc_id long, label string")
    got = abuse.training_docs(docs, said)[:40]
    assert sum(lab == "hate" for _, lab in got) == 10 and sum(lab is None for _, lab in got) == 30
    few = abuse.training_docs(docs, said.where("doc_id between 95 and 110"))
    assert sum(lab == "hate" for _, lab in few) == 5
