"""Abusive, hateful and sexual content: a score for each document and kind, and rates per source.

A classifier chain over sentences: the kinds are predicted in the order abuse, hate, sexual, and each
later linear model gets the probabilities of the earlier ones as features; in training those come
from models fitted out of fold. A document's score is that of its worst sentence, so nothing is
averaged away in long texts.

Sentences are made plain first: compatibility forms, look-alike letters of other scripts, digits and
signs written for letters, zero-width characters, stretched letters, and words broken up by marks.
Features are hashed words, pairs and triples of words, and counts of small word lists. Training rows
are seed sentences written here, the sentences of human-judged documents, and sentences of a sample;
human judgements are of whole documents and partly wrong, so in each round the sentences that may
have caused a judgement are found by the model of the round before and by being unlike what sound
documents say. The training sample has at most ``SAMPLE_DOCS`` + ``LABELLED_DOCS`` documents, chosen
by a hash of their id; every document is scored.

Defined results: null, empty and blank texts have score 0; judgements that are null or contradict
each other don't count; repeated rows come out once per id; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.linear import Rows, sigmoid, threshold, train
from quernstone.llm.repeats import mix
from quernstone.runtime import table

KINDS = ("abuse", "hate", "sexual")
SAMPLE_DOCS, LABELLED_DOCS = 3_000, 3_500
BITS = 17
DENSE = 1 << BITS
SIZE = DENSE + 32
PRECISION = 0.93

LOOKALIKES = str.maketrans("аеорсухіјѕԁһвкмнтзαεορυικνтτ", "aeopcyxijsdhbkmhtsaeopuiknтt".replace("т", "t"))
LEET = str.maketrans("013457@$!|", "oieastasil")
JOINED = re.compile(r"(?<![^\W_])(?:[^\W\d_][.\-_*·•' ]){2,}[^\W\d_](?![^\W_])")
CUT = re.compile(r"(?<=[.!?…。！？।])[\"'”’»)\]]*\s+|\n+")
WORD = re.compile(r"[^\W_]+(?:[*]+[^\W_]*)*|[^\W_]?[*]{2,}[^\W_]*")

#: words that tell of each theme in the main languages (stems; a trailing * is any ending)
THEMES = {
    "insult": "idiot* moron* fool* stupid dumb useless pathetic worthless miserable brainless halfwit* clown* pig pigs cow rat rats swine scum trash garbage bastard* bitch* asshole* arsehole* shit* crap loser* imbecile* cretin* coward* lying liar* dimwit* disgusting bloody lousy disgrace* freak* ugly "
    "schwein* trottel* versager* dumm* widerlich* arsch* dreck* abschaum hurensohn fresse blöd* conne connard* salaud* ordure* imbécile* crétin* sale abruti* gueule raclure merde idiota* basura cerdo* gilipollas cabrón* estúpid* cállate inútil* mierda imbécil* asqueros*".split(),
    "threat": "kill* die hammer beat* smash* break burn* hurt hell regret* bleed* knife snapped suffer* dead corpse straw ashamed crawl töt* umbring* schlag* wohnst tuer* crever frapper romperte matar* cara mourir verreck*".split(),
    "group": "women men jews muslims christians blacks whites immigrants foreigners refugees gays lesbians race races tribe faith religion people natives migrants disabled ausländer frauen juden flüchtlinge étrangers femmes juifs immigrés extranjeros mujeres judíos inmigrantes".split(),
    "degrade": "animals animal vermin thieves thief subhuman human inferior filth dirty smell breed parasites deport* deserve away scrubbing hands born disease* plague rats tiere diebe ungeziefer dreckig* abschaum animaux voleurs vermine sales animales ladrones parásitos suci*".split(),
    "sexual": "porn* xxx nude* naked sex horny breasts panties moan* suck* fuck* cock dick pussy cum orgasm* escort* sexy cams webcam legs erotic tongue lick* strip* wet uncut nackt* geil* ficken titten porno* nue nues nu baise* seins sexe chaude* salope* desnud* follar tetas caliente* foto*".split(),
    "you": "you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted vosotros pedazo".split(),
    "neutral": "filter filters filtre filtro moderators moderation form forms field guide handle handles explains policy policies detect* erkennt report reports report* training museum health clinic education screening feature hospital library course".split(),
}
SEEDS = {
    "abuse": """You are a stupid idiot and everyone knows it.|Shut your mouth, you pathetic moron.|What a bunch of useless clowns you are.|Go to hell, you worthless piece of trash.|I will find you and break your legs.|I know where you live and I will hurt you.|You will regret this, I am coming for you with a knife.|Nobody would miss you if you died.|Kill yourself, you loser.|Whoever wrote this is a brainless fool.|Only an idiot like you could have done this.|I hope you lose everything, you miserable bastard.|You lying piece of shit.|Your mother should be ashamed of you.|Crawl back into your hole and stay there.|One more word and I will smash your face.|Only a complete idiot would have done it like this.|Only a pathetic clown would have built this.|Whoever made this is a stupid fool.|Whoever did that is a piece of garbage.|Your children should be ashamed of you.|You disgust everyone who has to work with you.|Do us all a favour and never come back, scumbag.|Drop dead, you arrogant bitch.|One more mail and you end up in hospital.|I hope your house burns down.
Du bist ein dummes Schwein.|Halt die Fresse, du Idiot.|Ihr seid ein Haufen elender Versager.|Ich weiß, wo du wohnst, und ich bringe dich um.|Ferme ta gueule, espèce de con.|Tu es un sale imbécile et tout le monde le sait.|Je vais te casser la figure.|Vous êtes une bande de crétins.|Cállate, pedazo de mierda.|Eres un idiota inútil.|Eres un imbécil de mierda y todos lo saben.|Ojalá te mueras.|Voy a romperte la cara.|Sois una panda de imbéciles.""",
    "hate": """People of that faith are vermin and do not deserve to live here.|Never hire foreigners, they are born thieves.|Women are too stupid to work or vote.|Keep those immigrants away from us, they are dirty animals.|Jews are less than human.|That race should not be allowed to breed.|You can tell by the smell that muslims work here.|Gays are a disease and must be removed.|God made blacks to scrub floors.|Everything those people touch turns to filth.|Send all refugees back, they are parasites.
Ausländer sind Ungeziefer und gehören nicht hierher.|Frauen sind zu dumm für diese Arbeit.|Diese Leute sind alle Diebe und Tiere.|Les étrangers sont des voleurs et des parasites.|Les femmes sont inférieures et ne devraient pas travailler.|Ces gens sont des animaux.|Los extranjeros son animales sucios.|Las mujeres no sirven para trabajar, son inferiores.|Esa gente son ratas y ladrones.""",
    "sexual": """Hot naked girls, free porn videos all night.|Send me nude pictures of yourself.|Horny singles near you want sex tonight.|She took off her panties and moaned while he licked her breasts.|I keep thinking of you naked with your legs apart.|Live sex cams, no limits, explicit XXX.|He told her what his tongue would do once her clothes were off.|Wet and willing, watch the uncut clip.|I want to suck your cock.|Meet me tonight for sex, I pay well.|Come to my room, I want you naked on your knees.|I want you on my desk with nothing on.|He described what he would do to her once her clothes were on the floor.
Geile nackte Frauen, Pornos ohne Anmeldung.|Schick mir Nacktbilder von dir.|Heiße Frauen wollen Sex mit dir.|Des femmes nues et chaudes, porno gratuit.|Envoie-moi des photos de toi nue.|Je veux coucher avec toi ce soir, contre argent.|Mujeres desnudas y calientes, porno gratis.|Mándame fotos desnuda y te pago.|Quiero follar contigo esta noche.""",
    "": """The filter detects pornography and insults in many languages.|The moderators explain how to handle threats and explicit images.|Sex is an optional field of the form.|Immigrants and foreigners fill in the same form as everybody else.|Kill the process and restart the server.|The dirty flag marks a row.|Women asked for a safer walk home.|The clinic offers breast cancer screening.|A damn good release, bloody hell that was close.|The museum shows a naked statue.|The wizard is idiot-proof.|Abusive clients are throttled.|Master and slave nodes are kept in sync.|The pest control firm sells rat traps.|The course on sexual health is open to all.|The policy bans hate speech.|This stupid bug took us a week.|A dumb terminal shows the log.
Der Filter erkennt Beleidigungen und Nacktbilder.|Frauen und Männer füllen dasselbe Formular aus.|Le filtre repère les insultes et les images nues.|El filtro detecta insultos y pornografía.|Das Geschlecht ist ein freiwilliges Feld.|Les étrangers remplissent le même formulaire.|Las mujeres pidieron un camino más seguro.""",
}


FORMATS = dict.fromkeys(c for r in (range(0x20000), range(0xE0000, 0xE0100)) for c in r if unicodedata.category(chr(c)) == "Cf")  # there are no others
BLANKS = re.compile(r"(\s+)")
MASKED = re.compile(r"[013457@$|!]")


def plain(text: str) -> str:
    t = text
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t).translate(FORMATS)
    t = t.lower()

    def word(w: str) -> str:
        latin = sum("a" <= c <= "z" for c in w)
        if not w.isascii() and latin:
            w = w.translate(LOOKALIKES)
            latin = sum("a" <= c <= "z" for c in w)
        if latin >= 2 and re.search(r"[013457@$]|[!|](?=[a-z])", w) and not re.fullmatch(r"[a-z]*\d+", w):
            w = re.sub(r"[013457@$|!]+(?=\W*$)|.", lambda k: k[0].translate(LEET) if "!" not in k[0] or k.end() < len(w) else k[0], w)
        return w

    if not t.isascii() or MASKED.search(t):
        t = "".join([w if w.isascii() and (w.isalpha() or not MASKED.search(w)) else word(w) for w in BLANKS.split(t)])
    t = JOINED.sub(lambda m: re.sub(r"[.\-_*·•' ]", "", m[0]), t)
    return re.sub(r"([^\W\d_])\1{2,}", r"\1\1", t)


def _themes() -> tuple[dict[str, list[str]], list[tuple[str, str]]]:
    exact: dict[str, list[str]] = {}
    stems: list[tuple[str, str]] = []
    for k, ws in THEMES.items():
        for w in ws:
            if w.endswith("*"):
                stems.append((w[:-1], k))
            else:
                exact.setdefault(w, []).append(k)
    return exact, sorted(stems)


EXACT, STEMS = _themes()
BY_START: dict[str, list[tuple[str, str]]] = {}
for _s, _k in STEMS:
    BY_START.setdefault(_s[:2], []).append((_s, _k))
VOCABULARY = sorted({w.rstrip("*") for ws in THEMES.values() for w in ws})
_cache: dict[str, tuple[str, ...]] = {}


def themes_of(w: str) -> tuple[str, ...]:
    if (hit := _cache.get(w)) is None:
        found = set(EXACT.get(w, ()))
        found |= {k for s, k in BY_START.get(w[:2], ()) if w.startswith(s)}
        squeezed = re.sub(r"(.)\1", r"\1", w)
        if squeezed != w and not found:
            found = set(EXACT.get(squeezed, ())) | {k for s, k in BY_START.get(squeezed[:2], ()) if squeezed.startswith(s)}
        hit = _cache[w] = tuple(sorted(found))
        if len(_cache) > 200_000:
            _cache.clear()
    return hit


def unmask(w: str) -> str:
    """A word with letters starred out, if one listed word fits."""
    if "*" not in w or not re.search(r"[^\W\d_]", w):
        return w
    fits = [v for v in VOCABULARY if len(v) == len(w) and all(a in ("*", b) for a, b in zip(w, v))]
    return fits[0] if len(fits) == 1 or (fits and w.count("*") < len(w) / 2) else w


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence, made plain."""
    if not text or not text.strip():
        return []
    out = []
    for s in CUT.split(plain(text)):
        words = [unmask(w) if "*" in w else w for w in WORD.findall(s)]
        for k in range(0, len(words), 60):  # endless lines in parts that overlap
            part = words[max(0, k - 8) : k + 60]
            if part:
                out.append(part)
    return out


_words: dict[str, tuple[int, int]] = {}
THEME_BIT = {k: 1 << j for j, k in enumerate(THEMES)}


def hashed(words: list[str]) -> list[tuple[int, int]]:
    """Hash and themes of each word, kept for the next time."""
    out = []
    for w in words:
        if (hit := _words.get(w)) is None:
            if len(_words) > 200_000:
                _words.clear()
            hit = _words[w] = xxhash.xxh3_64_intdigest(w), sum(THEME_BIT[k] for k in themes_of(w))
        out.append(hit)
    return out


PAIRED = (("insult", "you"), ("threat", "you"), ("group", "degrade"), ("sexual", "you"), ("group", "insult"), ("insult", "neutral"), ("sexual", "neutral"))


def all_features(sentences_: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of many sentences at once: hashes of words, pairs and triples, and counts of themes."""
    n = np.array([len(s) for s in sentences_], np.int64)
    flat = np.array(hashed([w if not w.isdigit() else "#" for s in sentences_ for w in s]), np.uint64).reshape(-1, 2)
    h, bits = flat[:, 0], flat[:, 1]
    start = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - start[of]
    idx, row = [], []
    with np.errstate(over="ignore"):
        gram = mix(h)
        for k in (1, 2, 3):
            at = np.flatnonzero(place <= n[of] - k)
            idx.append((mix(gram[at] + np.uint64(k)) & np.uint64(DENSE - 1)).astype(np.int32))
            row.append(of[at])
            gram[: len(h) - k] = mix(gram[: len(h) - k] * np.uint64(0x2545F4914F6CDD1D) + h[k:]) if len(h) > k else gram[: len(h) - k]
    val = [(1 / np.sqrt(n[r])).astype(np.float32) for r in row]
    count = {k: np.bincount(of, (bits >> np.uint64(j)) & np.uint64(1), len(n)) for j, k in enumerate(THEMES)}

    def dense(at: int, rows: np.ndarray, v) -> None:
        idx.append(np.full(len(rows), at, np.int32))
        row.append(rows)
        val.append(np.broadcast_to(np.asarray(v, np.float32), len(rows)))

    for j, k in enumerate(THEMES):
        some = np.flatnonzero(count[k])
        dense(DENSE + j, some, np.minimum(count[k][some], 3) / 2)
    for j, (a, b) in enumerate(PAIRED):
        dense(DENSE + 10 + j, np.flatnonzero((count[a] > 0) & (count[b] > 0)), 1)
    dense(DENSE + 18, np.flatnonzero(count["sexual"] >= 2), 1)
    dense(DENSE + 19, np.flatnonzero(count["insult"] >= 2), 1)
    dense(SIZE - 1, np.arange(len(n)), 1)
    i, r, v = np.concatenate(idx), np.concatenate(row), np.concatenate(val)
    order = np.argsort(r, kind="stable")
    i, v = i[order], v[order]
    cuts = np.cumsum(np.bincount(r, minlength=len(n)))[:-1]
    return list(zip(np.split(i, cuts), np.split(v, cuts))) if len(n) else []


def with_chain(rows: list[tuple[np.ndarray, np.ndarray]], earlier: np.ndarray) -> Rows:
    """Rows with the earlier kinds' probabilities as features."""
    places = DENSE + 24 + np.arange(earlier.shape[1])
    return Rows([(np.concatenate([i, places]), np.concatenate([v, p])) for (i, v), p in zip(rows, earlier)])


@dataclass
class Chain:
    weights: list[np.ndarray]
    limits: list[float]

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros((0, len(KINDS)), np.float32)
        own = Rows(rows)
        out = np.zeros((len(rows), 0), np.float32)
        for w in self.weights:
            earlier = out @ w[DENSE + 24 : DENSE + 24 + out.shape[1]]  # the earlier kinds' probabilities are features
            out = np.hstack([out, sigmoid(own.dot(w) + earlier)])
        return out


def fit_chain(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, folds: int = 3, epochs: int = 4) -> tuple[Chain, np.ndarray]:
    """The chain, and out-of-fold probabilities of all rows."""
    fold = np.random.default_rng(11).integers(0, folds, len(rows))
    oof = np.zeros((len(rows), 0), np.float32)
    weights = []
    for j in range(y.shape[1]):
        x, t = with_chain(rows, oof), y[:, j : j + 1]
        p = np.zeros((len(rows), 1), np.float32)
        for f in range(folds):
            part, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(part) and len(rest):
                p[part] = sigmoid(x.take(part).dot(train(x.take(rest), t[rest], SIZE, weight[rest], epochs)))
        weights.append(train(x, t, SIZE, weight, epochs))
        oof = np.hstack([oof, p])
    return Chain(weights, [0.5] * len(KINDS)), oof


def fit(docs: list[tuple[str, str | None]]) -> Chain:
    """From (text, judgement or null) of documents."""
    seg_words: list[list[str]] = []
    seg_doc: list[int] = []
    labels: list[str | None] = []
    for text, label in docs:
        labels.append(label)
        for s in sentences(text):
            seg_words.append(s)
            seg_doc.append(len(labels) - 1)
    seeds = [(w, k) for k, block in SEEDS.items() for s in re.split(r"[|\n]", block) for w in sentences(s)]
    rows = all_features(seg_words)
    seed_rows = all_features([w for w, _ in seeds])
    seed_y = np.array([[float(k == x) for x in KINDS] for _, k in seeds], np.float32)
    doc = np.array(seg_doc, np.int64)
    judged = np.array([lab in KINDS for lab in labels], bool) if labels else np.zeros(0, bool)
    # how unlike sound documents a sentence is: share of its word pairs that few of those not judged as cases have;
    # among many judged ones what they were judged for is common
    pairs = Counter()
    last: dict[int, int] = {}
    for w, d in zip(seg_words, seg_doc):
        if judged[d]:
            continue
        for b in {hash((a, c)) for a, c in zip(w, w[1:])}:
            if last.get(b) != d:
                last[b] = d
                pairs[b] += 1
    few = max(3, int(0.004 * (len(labels) - judged.sum())))
    odd = np.array([np.mean([pairs[hash((a, c))] <= few for a, c in zip(w, w[1:])]) if len(w) > 1 else 0.0 for w in seg_words], np.float32)
    n = len(rows)
    y = np.zeros((n, len(KINDS)), np.float32)
    # before anything is learned, judged documents' sentences are left out
    use = ~judged[doc] if n else np.zeros(0, bool)
    chain, oof = fit_chain([*seed_rows, *(rows[i] for i in np.flatnonzero(use))], np.vstack([seed_y, y[use]]), np.concatenate([np.full(len(seeds), 3.0, np.float32), np.full(int(use.sum()), 1.0, np.float32)]))
    for round_ in range(3):
        p = chain.score(rows)
        y[:] = 0
        use = np.ones(n, bool)
        sure = 0.5 if round_ == 0 else 0.6
        y[p >= sure] = 1
        best = {}
        for i in np.flatnonzero(judged[doc]) if n else []:
            k = KINDS.index(labels[doc[i]])
            if p[i].max() < sure and odd[i] >= 0.5 and len(seg_words[i]) >= 3:
                best.setdefault((doc[i], k), []).append(i)
        for (_, k), found in best.items():
            top = max(found, key=lambda i: (p[i, k], odd[i]))
            for i in found:
                if i == top and p[i, k] >= 0.02:
                    y[i, k] = 1
                else:
                    use[i] = p[i].max() < 0.02
        use &= ~((p.max(axis=1) > 0.15) & (y.max(axis=1) == 0)) if n else use
        at = np.flatnonzero(use)
        weight = np.concatenate([np.full(len(seeds), 2.0, np.float32), np.where(y[at].max(axis=1) > 0, 2.0, 1.0).astype(np.float32) if len(at) else np.zeros(0, np.float32)])
        chain, oof = fit_chain([*seed_rows, *(rows[i] for i in at)], np.vstack([seed_y, y[at]]), weight)
    truth = np.vstack([seed_y, y[at]])
    chain.limits = [threshold(oof[:, j], truth[:, j] > 0, PRECISION) for j in range(len(KINDS))]
    return chain


def document_scores(chain: Chain, texts: list[str | None]) -> np.ndarray:
    """(documents, kinds): the worst sentence's probabilities."""
    out = np.zeros((len(texts), len(KINDS)), np.float32)
    found, of = [], []
    for i, t in enumerate(texts):
        part = sentences(t)
        found += part
        of += [i] * len(part)
    for k in range(0, len(found), 4096):  # long texts in portions
        np.maximum.at(out, np.array(of[k : k + 4096]), chain.score(all_features(found[k : k + 4096])))
    return out


def training_docs(docs: DataFrame, judgements: DataFrame) -> list[tuple[str, str | None]]:
    """Bounded: judged documents whose judgements agree, and others, both by a hash of their id."""
    said = judgements.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    text = docs.where(F.length("text") > 0).select("doc_id", "text")
    judged = text.join(said, "doc_id").withColumn("h", F.xxhash64("doc_id"))
    # the few bad ones first, then sound ones; where bad ones are many, so many that sound ones remain the most, or thresholds
    # would be set on a mixture in which what is rare is common
    bad = judged.where(F.col("label").isin(*KINDS)).orderBy("h").limit(LABELLED_DOCS // 4).select("text", "label").collect()
    judged = bad + judged.where(~F.col("label").isin(*KINDS)).orderBy("h").limit(LABELLED_DOCS - len(bad)).select("text", "label").collect()
    n = docs.count()
    part = text.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(min(1.0, SAMPLE_DOCS / max(1, n)) * 1_000_000)).orderBy("doc_id").limit(SAMPLE_DOCS).select("text").collect()
    return [(r.text, r.label if r.label in KINDS else None) for r in judged] + [(r.text, None) for r in part]


def scores(docs: DataFrame, judgements: DataFrame) -> tuple[DataFrame, list[float]]:
    """(doc_id, source, abuse, hate, sexual) of every row, and the kinds' thresholds."""
    chain = fit(training_docs(docs, judgements))
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                p = document_scores(sent.value, part.column(2).to_pylist()).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(p[:, j]) for j in range(len(KINDS)))], names=["doc_id", "source", *KINDS])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, abuse double, hate double, sexual double"), chain.limits


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, limits = scores(*_tables(spark, sf_dir))
    kinds = F.array(*(F.when(F.col(k) >= limit, F.lit(k)) for k, limit in zip(KINDS, limits)))
    return df.select("doc_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind")).distinct()


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p10_rates: documents, cases and mean scores per source."""
    df, limits = scores(*_tables(spark, sf_dir))
    cols = [c for k, limit in zip(KINDS, limits) for c in (F.sum((F.col(k) >= limit).cast("int")).alias(f"{k}_cases"), F.avg((F.col(k) >= limit).cast("double")).alias(f"{k}_rate"), F.avg(k).alias(f"{k}_score"))]
    return df.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("documents"), *cols)
