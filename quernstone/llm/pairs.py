"""Broken question and answer pairs, each with the types of its defects.

A multi-label linear classifier on hashed n-grams of the answer's head and tail and on features of
the pair (shared words, what the answer adds, languages of both and the one asked for, open brackets
and lists). It learns from synthetic defects: answers cut off, questions copied as answers, answers
swapped with ones in another language, refusals, placeholders. An answer longer than its head is
also judged passage by passage for refusals, wherever they stand, by weights of their own that are
fitted on the passages as well. Real pairs are taken as sound at
first and relabelled once by the first fit; thresholds are calibrated on held-out pairs.

The sample it is fitted on has at most ``SAMPLE`` pairs, chosen by a hash of their id; every pair is
scored. Defined results: null questions give no words; null, blank and placeholder answers are
``empty`` and nothing else; a record sent twice counts once; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.linear import Rows, bucket, sigmoid, threshold, train
from quernstone.runtime import table

SAMPLE = 6_000
HEAD_WORDS, HEAD_CHARS = 24, 400
BITS = 17
SIZE = (1 << BITS) + 64
DEFECTS = ("empty", "truncated", "refusal", "echo", "other_language")
REFUSAL = DEFECTS.index("refusal")
PRECISION = 0.5  # thresholds have the best F1 on held-out pairs, at no less precision than this

#: frequent words of languages that share the Latin script
FUNCTION_WORDS = {
    "en": "the of and to in is that it for on with as are was be by this at from or have not you your we can which how does what who why do our their will there once after before so an has never then no yes since from only i me my am this".split(),
    "de": "der die das und ist nicht mit ein eine zu den im für auf von dem des sich auch wird es an nach bei aus wie wir ich sie ja nein kann wer was wenn bis und zwar unser vor leider in".split(),
    "fr": "le la les et de des un une est pour en dans que qui sur au avec ne pas par ce du il nous vous oui non je sont aux se après notre quand combien l d si peut sans même ainsi il elle prendra charge aide jours cette".split(),
    "es": "el la los las y de un una es para en que por con no se del al su lo más como nuestro sí cuánto quién puede cuando tras hasta si sin antes después así pese esta ese cuándo podrá qué cómo nos ayuda eso".split(),
    "it": "il lo la gli le e di un una è per in che non con del della si sono al nel anche come più questo".split(),
    "pt": "o a os as e de um uma é para em que não com do da se por no na ao mais como este".split(),
    "nl": "de het een en van is in op te dat niet met voor zijn aan door er ook als bij dit naar wij".split(),
    "pl": "i w na z do nie się to jest że o jak po od za przez są dla oraz już jego tak czy".split(),
}
LANGUAGE_WORDS = {w: [k for k, v in FUNCTION_WORDS.items() if w in v] for v in FUNCTION_WORDS.values() for w in v}
ASKED = {
    "en": r"english|englisch|anglais|inglés|ingles",
    "de": r"german|deutsch|allemand|alemán|aleman",
    "fr": r"french|französisch|français|francais|francés|frances",
    "es": r"spanish|spanisch|espagnol|español|espanol|castellano",
    "it": r"italian|italienisch|italien|italiano",
    "pt": r"portuguese|portugiesisch|portugais|portugués",
    "ru": r"russian|russisch|russe|ruso",
    "pl": r"polish|polnisch|polonais|polaco",
    "ja": r"japanese|japanisch|japonais|japonés",
    "ar": r"arabic|arabisch|arabe|árabe",
    "hi": r"hindi",
}
ASKING = re.compile(r"(?i)\b(?:answer|reply|respond|write|translat\w*|antwort\w*|schreib\w*|übersetz\w*|répon\w*|écri\w*|tradui\w*|respond\w*|contest\w*|escrib\w*|traduc\w*)\b")
SCRIPTS = (("ru", 0x400, 0x52F), ("ar", 0x600, 0x6FF), ("hi", 0x900, 0x97F), ("ja", 0x3040, 0x30FF), ("zh", 0x4E00, 0x9FFF), ("ko", 0xAC00, 0xD7AF), ("el", 0x370, 0x3FF), ("he", 0x590, 0x5FF), ("th", 0xE00, 0xE7F))
SCRIPTS_FROM = min(low for _, low, _ in SCRIPTS)

#: how assistants decline, for synthetic refusals; {} takes words of the question
REFUSALS = {
    "en": [
        "I'm sorry, but I can't help with {}.", "I cannot answer that.", "Sorry, I am unable to assist with this request.", "I must decline to answer.", "I'd rather not comment on {}.",
        "As an assistant I am not allowed to discuss {}.", "That is not something I can talk about.", "My instructions do not permit me to answer questions about {}.", "This is outside of what I am able to discuss.",
        "I have no opinion on {} and have to leave it there.", "Unfortunately I have nothing on {}, so I will not answer.", "I am not able to provide information about {}.", "I won't be answering this one.", "This request is beyond my scope.",
        "As a language model I cannot comment on {}.",
    ],
    "de": ["Es tut mir leid, dabei kann ich nicht helfen.", "Diese Frage kann ich leider nicht beantworten.", "Zu {} darf ich keine Auskunft geben.", "Dazu möchte ich mich nicht äußern.", "Das darf ich nicht beantworten.", "Leider kann ich dazu nichts sagen.", "Ich bin nicht befugt, über {} zu sprechen.", "Bei {} kann ich nicht weiterhelfen.", "Meine Vorgaben verbieten mir Angaben zu {}."],
    "fr": ["Désolé, je ne peux pas répondre à cette question.", "Je ne suis pas autorisé à parler de {}.", "Je préfère ne pas en parler.", "Je ne peux malheureusement pas vous aider.", "Cette question sort de mon domaine.", "Mes consignes m'interdisent de commenter {}.", "Il ne m'est pas permis de répondre."],
    "es": ["Lo siento, no puedo ayudar con eso.", "No estoy autorizado a hablar de {}.", "Prefiero no responder a esa pregunta.", "Esa pregunta queda fuera de mi ámbito.", "Lamentablemente no puedo contestar.", "Mis normas me impiden comentar {}.", "No me está permitido responder."],
}
FOLLOWS = {
    "en": ["", "", " Is there anything else I can do for you?", " Please ask about something else.", " Try the documentation instead.", " Please contact the team."],
    "de": ["", "", " Bitte wenden Sie sich an das Team."], "fr": ["", "", " Merci de votre compréhension."], "es": ["", "", " Gracias por su comprensión."],
}
#: sound answers of a word or two
SHORT = {
    "en": ["{0} days", "{0} hours", "{0} {1}", "Yes", "No", "About {0} weeks", "Yes, {1}", "From {0} euros", "In {0} minutes"],
    "de": ["{0} Tage", "{0} Stunden", "{0} {1}", "Ja", "Nein", "Etwa {0} Wochen", "Ja, {1}", "Ab {0} Euro", "In {0} Minuten"],
    "fr": ["{0} jours", "{0} heures", "{0} {1}", "Oui", "Non", "Environ {0} semaines", "Oui, {1}", "Dès {0} euros", "En {0} minutes"],
    "es": ["{0} días", "{0} horas", "{0} {1}", "Sí", "No", "Unas {0} semanas", "Sí, {1}", "Desde {0} euros", "En {0} minutos"],
}
PLACEHOLDERS = frozenset("n/a na null none nil nan undefined tbd todo test empty leer vide vacío - -- — ... … [] {} () \"\" '' . ? ! x xxx <p></p> <br/> <br> #n/a missing".split())
TAG, ALNUM = re.compile(r"<[^<>]{0,80}>"), re.compile(r"[^\W_]")
TOKEN = re.compile(r"https?://\S+|[^\W_]+(?:['’-][^\W_]+)*|[^\w\s]|_")
LABEL = re.compile(r"(?i)^\W*(?:q|a|question|answer|frage|antwort|pregunta|respuesta|réponse|you asked|you wrote|your question|sie fragten|ihre frage|vous avez demandé|votre question|su pregunta|usted preguntó)\s*:\s*")
JOINING = frozenset("and or but the a an of to with for which that because und oder der die das mit für weil dass et ou le la les de des avec pour que qui parce y o el los las con para porque in on by un una une mit ein eine".split())


def language(words: list[str], text: str, learned: dict[str, str] = {}) -> tuple[str, float]:  # noqa: B006
    """Most likely language and how clear it is; '' without evidence. learned: languages of further words."""
    letters = [] if text.isascii() else [ord(c) for c in text if c.isalpha()]
    others = [c for c in letters if c >= SCRIPTS_FROM]
    if len(others) > 0.25 * len(letters):
        for name, low, high in SCRIPTS:
            share = sum(low <= c <= high for c in others) / len(letters)
            if share > 0.25:
                return ("ja" if name == "zh" and any(0x3040 <= c <= 0x30FF for c in others) else name), 1.0
    score: dict[str, float] = {}
    for chars, k in (("¿¡ñ", "es"), ("ßäöü", "de"), ("çèêœàùë", "fr"), ("łąęśż", "pl"), ("ãõ", "pt")):
        if any(c in text for c in chars):
            score[k] = 1.0
    for w in words:
        for k in LANGUAGE_WORDS.get(w, ()):
            score[k] = score.get(k, 0) + 1 / len(LANGUAGE_WORDS[w])
        if w in learned and w not in LANGUAGE_WORDS:
            score[learned[w]] = score.get(learned[w], 0) + 0.5
    if not score:
        return "", 0.0
    first, *rest = sorted(score.items(), key=lambda x: -x[1])
    second = rest[0][1] if rest else 0.0
    return first[0], (first[1] - second) / (first[1] + second)


def asked_language(question: str) -> set[str]:
    low = question.lower()
    if not ASKING.search(low):
        return set()
    return {k for k, p in ASKED.items() if re.search(rf"\b(?:{p})\b", low)}


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    bare = TAG.sub("", answer)
    if len(ALNUM.findall(bare[:400])) > max(map(len, PLACEHOLDERS)):
        return False
    bare = "".join(c for c in bare if unicodedata.category(c) not in ("Cf", "Cc", "Zs", "Zl", "Zp")).strip().lower()
    return not bare or bare in PLACEHOLDERS or bare.strip(".!-*_\"' ") in PLACEHOLDERS or not any(c.isalnum() for c in bare)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in TOKEN.findall(text) if w[0].isalnum()]


def unlabelled(answer: str) -> str:
    """Without labels such as "Question:" at the beginning of its lines."""
    return "\n".join(LABEL.sub("", line) for line in answer.split("\n"))


def added(question: str | list[str], answer: str) -> tuple[float, float, int]:
    """Share of the answer's words that the question has, of the question's that the answer has, and how many words it adds."""
    q, a = words_of(question) if isinstance(question, str) else question, words_of(unlabelled(answer))
    qs, as_ = set(q), set(a)
    if not a or not q:
        return 0.0, 0.0, len(a)
    return sum(w in qs for w in a) / len(a), len(qs & as_) / len(qs), sum(w not in qs for w in a)


STOP = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？।؟])\s*|\n+")
DENSE = 1 << BITS
LIMITS = 0.3, 0.55  # of the thresholds: real pairs hold forms that synthetic ones lack and score lower
SURE = 0.5  # probability from which a fit's verdict on a real pair is believed


def passages(answer: str) -> list[tuple[str, bool]]:
    """All of an answer that is longer than its head, sentence by sentence, long sentences as overlapping windows of a head's size; and whether it reaches beyond the head."""
    s = answer.strip()
    if len(s) <= HEAD_CHARS and sum(t[0].isalpha() for t in TOKEN.findall(s)) <= HEAD_WORDS:
        return []
    out: dict[str, bool] = {}
    seen = chars = 0
    for sentence in STOP.split(s):
        spots = [x for m in TOKEN.finditer(sentence) for x in range(m.start(), m.end(), HEAD_CHARS // 2)]
        i = 0
        chars += len(sentence) + 1
        seen += sum(t[0].isalpha() for t in TOKEN.findall(sentence))
        beyond = seen > HEAD_WORDS or chars > HEAD_CHARS
        while i < len(spots):
            j = i + 1
            while j < len(spots) and j - i < HEAD_WORDS and spots[j] - spots[i] <= HEAD_CHARS // 2:
                j += 1
            end = spots[j] if j < len(spots) else len(sentence)
            part = sentence[spots[i] : end].strip()
            out[part] = out.get(part, False) or beyond
            if j >= len(spots):
                break
            i += max(1, (j - i) // 2)
    return list(out.items())


@dataclass
class Lexicon:
    """Which words the sample has, and which stand right before a stop, by hash; a word's two-letter beginnings aren't words."""

    words: bytearray
    ends: bytearray
    tongues: dict[str, str] = field(default_factory=dict)  # of words that texts of one clear language have, nearly always

    @staticmethod
    def of(texts: list[str]) -> Lexicon:
        count = np.zeros(1 << BITS, np.int32)
        ends = bytearray(1 << BITS)
        heard: dict[str, dict[str, int]] = {}
        for t in texts:
            own = set(words_of(t))
            k, clear = language(list(own), t)
            if clear >= 0.5:
                for w in own:
                    by = heard.setdefault(w, {})
                    by[k] = by.get(k, 0) + 1
            tokens = [x.lower() for x in TOKEN.findall(t)]
            # a last word without a stop may be cut off
            for w in {w for w, _ in zip(tokens, tokens[1:]) if w[0].isalpha()}:
                count[bucket(w, BITS)] += 1
            for w, stop in zip(tokens, tokens[1:]):
                if stop in ".!?。؟।" and w[0].isalpha():
                    ends[bucket(w, BITS)] = 1
        tongues = {w: k for w, by in heard.items() if (n := sum(by.values())) >= 4 for k in by if by[k] >= 0.9 * n}
        return Lexicon(bytearray((count >= 2).astype(np.uint8).tobytes()), ends, tongues)


NOTHING = Lexicon(bytearray(1 << BITS), bytearray(1 << BITS))


@lru_cache(1 << 16)
def place_of(name: str) -> int:
    return bucket(name, BITS)


class Asked:
    """What features need of a question, found once for all passages of its answer."""

    def __init__(self, question: str | None, lexicon: Lexicon):
        q = question or ""
        self.words = words_of(q)
        self.tongue = language(self.words, q, lexicon.tongues)
        self.want = asked_language(q)


def features(question: str | Asked | None, answer: str | None, lexicon: Lexicon = NOTHING) -> tuple[list[int], list[float]]:
    asked = question if isinstance(question, Asked) else Asked(question, lexicon)
    a = answer or ""
    idx: list[int] = []
    val: list[float] = []

    def hashed(name: str, v: float = 1.0) -> None:
        idx.append(place_of(name))
        val.append(v)

    def dense(place: int, v: float) -> None:
        if v:
            idx.append(DENSE + place)
            val.append(float(v))

    s = a.strip()
    tokens = TOKEN.findall(s[-160:])[-6:]
    low = [t.lower() for t in tokens]
    kinds = ["#" if t[0].isdigit() else ("U" if t.startswith("http") else ("W" if t[0].isalpha() else t)) for t in tokens]
    if low:
        end = next((i for i in range(len(low) - 1, -1, -1) if low[i][0].isalnum()), -1)
        hashed("last " + kinds[-1])
        hashed("shape " + " ".join(kinds[-3:]))
        if end >= 0:
            hashed("w1 " + low[end], 1.0)
            hashed("w2 " + " ".join(low[max(0, end - 1) : end + 1]))
            hashed("w3 " + " ".join(low[max(0, end - 2) : end + 1]))
            hashed("end " + kinds[-1] + " " + low[end])
            hashed("suffix " + low[end][-3:])
        dense(0, low[-1] in JOINING)
        dense(1, tokens[-1] in ",;:(-[{\"“«")
        dense(2, tokens[-1] in ".!?。！？।؟…")
    dense(3, s.count("(") > s.count(")") or s.count("[") > s.count("]"))
    dense(4, s.count("```") % 2)
    line = s.rsplit("\n", 1)[-1].strip()
    dense(5, bool(re.fullmatch(r"(?:[-*+]|\d+[.)])\s*", line)))
    dense(6, bool(re.match(r"(?:[-*+]|\d+[.)])\s+\S", line)) and line.endswith(")"))
    dense(7, bool(re.match(r"(?:[-*+]|\d+[.)])\s+\S", line)) and not line.endswith(")"))
    words = words_of(s)
    sentences = len(re.findall(r"[.!?](?:\s|$)", s))
    ended = bool(re.search(r"[.!?。！？।؟…][\s\"'”’»)\]]*$", s))
    dense(8, sentences > 0 and not ended)
    dense(9, not ended and len(words) >= 6)
    dense(10, not ended and len(words) < 6)
    dense(11, bool(re.search(r"https?://\S+$", s)))
    dense(12, bool(s) and unicodedata.category(s[-1]) in ("So", "Sk"))
    dense(13, s.endswith(")") and s.count("(") == s.count(")"))
    dense(14, s.endswith("```") and s.count("```") % 2 == 0)
    if low and not ended and low[-1][0].isalpha():
        at = bucket(low[-1], BITS)
        dense(30, not lexicon.words[at])
        dense(31, not lexicon.ends[at])
        dense(32, lexicon.ends[at])
        dense(33, low[-1].islower() and len(low[-1]) <= 3 and not lexicon.ends[at])
    # the answer's beginning, for refusals
    head = [t.lower() for t in TOKEN.findall(s[:HEAD_CHARS]) if t[0].isalpha()][:HEAD_WORDS]
    for i, w in enumerate(head):
        hashed("h1 " + w, 0.5)
        if i:
            hashed("h2 " + head[i - 1] + " " + w, 0.5)
        if i > 1:
            hashed("h3 " + " ".join(head[i - 2 : i + 1]), 0.5)
    if head:
        hashed("begin " + " ".join(head[:3]))
    dense(15, min(3.0, len(words) / 20))
    dense(16, sentences <= 2)
    inside, covered, more = added(asked.words, s)
    dense(17, inside)
    dense(18, covered)
    dense(19, more == 0 and len(words) > 0)
    dense(20, more <= 2 and inside > 0.6)
    dense(21, min(2.0, more / 10))
    dense(22, inside > 0.8 and covered > 0.6)
    lq, la, want = asked.tongue, language(words, s, lexicon.tongues), asked.want
    differs = bool(lq[0] and la[0] and lq[0] != la[0]) and not (la[0] in want)
    dense(23, differs)
    dense(24, differs and la[1] >= 0.5 and lq[1] >= 0.3)
    dense(25, differs and la[1] >= 0.9 and len(words) >= 5)
    dense(26, differs and len(words) < 3)
    dense(27, bool(want) and la[0] in want)
    dense(28, bool(want) and bool(la[0]) and la[0] not in want)
    dense(29, is_empty(answer))
    idx.append(SIZE - 1)
    val.append(1.0)
    return idx, val


def packed(question: str | Asked | None, answer: str | None, lexicon: Lexicon = NOTHING) -> tuple[np.ndarray, np.ndarray]:
    i, v = features(question, answer, lexicon)
    return np.array(i, np.int32), np.array(v, np.float32)


def cut_off(text: str, rng: np.random.Generator) -> str | None:
    """The text broken off inside a sentence, item or block."""
    spots = [m.start() for m in re.finditer(r"\s+", text) if text[m.start() - 1 : m.start()] not in ".!?:\n" and len(text) - m.start() > 4 and text[m.start() : m.start() + 2] != "\n-"]
    spots = [p for p in spots if not re.match(r"\s+(?:https?://|\(\w+\)$|\W+$)", text[p:])]
    if len(spots) < 3:
        return None
    p = int(spots[rng.integers(1, len(spots))])
    kind = rng.random()
    if kind < 0.2:
        word = re.match(r"\s+(\w{5,})", text[p:])
        return text[: p + 1 + int(rng.integers(2, len(word[1]) - 1))] if word else text[:p]
    if kind < 0.35:
        return text[:p].rstrip(",;") + ","
    if kind < 0.5:
        return text[:p].rstrip(",;") + " " + str(rng.choice(sorted(JOINING)))
    if kind < 0.57:
        return text[:p] + " (" + (re.findall(r"\w+", text) or ["x"])[0]
    if kind < 0.64:
        return text[:p].rstrip(",;") + ":\n1. " + (re.findall(r"\w+", text) or ["x"])[-1] + "\n2."
    if kind < 0.72:
        return (text if kind < 0.68 else text[:p]) + "\n```\n" + (re.findall(r"\w+", text) or ["x"])[0].lower() + str(rng.choice(["", ".", ".open(", "(", " = "]))
    return text[:p]


def copied(question: str, rng: np.random.Generator) -> str:
    q = question.strip()
    k = int(rng.integers(0, 9))
    if k == 0:
        return q.upper()
    if k == 1:
        return '"' + q.rstrip("?¿ ") + '"'
    if k == 2:
        return f"{rng.choice(['Question', 'You asked', 'Q', 'Your question'])}: {q}"
    if k == 3:
        return f"Question: {q}\nAnswer: {q}"
    if k == 4:
        return f"{q} {q}"
    if k == 5:
        return "  " + q.lower() + "\n"
    if k == 6:
        return q.rstrip("?") + "."
    if k == 7:
        w = q.split()
        if len(w) > 4:
            del w[int(rng.integers(1, len(w) - 1))]
        return " ".join(w)
    return q


@dataclass
class Model:
    weights: np.ndarray
    limits: list[float]
    deep: np.ndarray | None = None  # weights of a passage's refusal, and their threshold
    deep_limit: float = 0.5
    lexicon: Lexicon = field(default_factory=lambda: NOTHING)

    def score(self, pairs: list[tuple[str | Asked | None, str | None]]) -> np.ndarray:
        return sigmoid(Rows([features(q, a, self.lexicon) for q, a in pairs]).dot(self.weights))

    def defects(self, pairs: list[tuple[str | None, str | None]]) -> list[list[str]]:
        out = []
        declined: set[int] = set()
        known = [Asked(q, self.lexicon) for q, _ in pairs]
        parts = [(i, known[i], x) for i, (_, a) in enumerate(pairs) if a and self.deep is not None for x, beyond in passages(a) if beyond]
        for k in range(0, len(parts), 4096):
            some = parts[k : k + 4096]
            p = sigmoid(Rows([features(q, x, self.lexicon) for _, q, x in some]).dot(self.deep))[:, 0]
            declined |= {some[j][0] for j in np.flatnonzero(p >= self.deep_limit)}
        for n, ((q, a), p) in enumerate(zip(pairs, self.score([(k, a) for k, (_, a) in zip(known, pairs)]))):
            if is_empty(a):
                out.append(["empty"])
                continue
            hits = [d for d, x, limit in zip(DEFECTS, p, self.limits) if (x >= limit or (d == "refusal" and n in declined)) and d != "empty"]
            # an exact check: an answer that adds something isn't only the question
            if "echo" in hits and added(q or "", a or "")[2] > 3:
                hits.remove("echo")
            out.append(hits)
        return out


def fit(pairs: list[tuple[str | None, str | None]], seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    base = [(q, a) for q, a in pairs if q and q.strip() and not is_empty(a)]
    lexicon = Lexicon.of([t for pair in base for t in pair])
    by: dict[str, list[str]] = {}
    for q, a in base:
        by.setdefault(language(words_of(a), a, lexicon.tongues)[0], []).append(a)
    tongues = sorted(k for k, v in by.items() if k and len(v) >= 2)
    foreign = ["Команда перенесла отчёт на новый сервер и записала каждый шаг.", "チームは在庫表を新しいサーバーへ移しました。", "نقل الفريق التقرير إلى الخادم الجديد.", "टीम ने रिपोर्ट को नए सर्वर पर भेज दिया।", "Zespół przeniósł raport na nowy serwer i zapisał każdy krok."]
    rows: list[tuple[str | None, str | None]] = []
    labels: list[list[int]] = []

    def add(q: str, a: str, *defects: str) -> None:
        rows.append((q, a))
        labels.append([int(d in defects) for d in DEFECTS])

    for q, a in base:
        tongue = language(words_of(q), q, lexicon.tongues)[0]
        whole = bool(re.search(r"[.!?。।؟]$", a.strip()))
        if whole:
            for _ in range(2):
                if (c := cut_off(a, rng)) is not None:
                    add(q, c, "truncated")
            if rng.random() < 0.35 and len(words_of(a)) > 2:
                add(q, a.strip().rstrip(".!"))  # complete without its stop
            if rng.random() < 0.25:  # complete with a closed block, remark or link at the end
                w = [x.lower() for x in re.findall(r"\w+", a)] or ["x"]
                some = [str(x) for x in rng.choice(w, 3)]
                add(q, a.strip() + str(rng.choice([f"\n```\n{some[0]} --{some[1]} {rng.integers(9)}\n```", f" ({some[0].title()})", f" https://{some[0]}.example/{some[1]}", f"\n- {some[0]} {some[1]}\n- {some[2]}", f"\n1. {some[0]}\n2. {some[1]} {some[2]}"])))
        if rng.random() < 0.35:
            add(q, copied(q, rng), "echo")
        if rng.random() < 0.8:
            lang = tongue if tongue in REFUSALS else "en"
            words = re.findall(r"\w+", q)
            about = " ".join(words[max(0, len(words) - int(rng.integers(1, 4))) :]) or "this"
            add(q, str(rng.choice(REFUSALS[lang])).format(about) + str(rng.choice(FOLLOWS[lang])), "refusal")
            # declined in another language: two defects
            if tongue in REFUSALS and rng.random() < 0.5 and not asked_language(q):
                lang = str(rng.choice([x for x in REFUSALS if x != tongue]))
                add(q, str(rng.choice(REFUSALS[lang])).format(about) + str(rng.choice(FOLLOWS[lang])), "refusal", "other_language")
        others = [t for t in tongues if t != tongue]
        if tongue and others and rng.random() < 0.5 and not asked_language(q):
            pick = by[others[int(rng.integers(len(others)))]] if rng.random() < 0.8 else foreign
            other = str(pick[int(rng.integers(len(pick)))])
            if language(words_of(other), other, lexicon.tongues)[0] not in ("", tongue):
                add(q, other, "other_language")
        if rng.random() < 0.3:  # sound, but short: a number with a noun, or a yes or no
            lang = tongue if tongue in SHORT else "en"
            add(q, str(rng.choice(SHORT[lang])).format(rng.integers(2, 90), str(rng.choice(words_of(a) or ["x"]))) + str(rng.choice([".", "", "\n"])))
        if rng.random() < 0.05:
            add(q, str(rng.choice(["", " ", "-", "N/A", "null", "...", "<br/>"])), "empty")
    made = len(rows)
    for q, a in base:
        add(q, a)
    data = [packed(*r, lexicon) for r in rows]
    x, y = Rows(data), np.array(labels, np.float32).reshape(-1, len(DEFECTS))
    if not len(rows):
        return Model(np.zeros((SIZE, len(DEFECTS)), np.float32), [0.5] * len(DEFECTS))
    held = rng.random(len(rows)) < 0.2
    w = train(x.take(np.flatnonzero(~held)), y[~held], SIZE, epochs=4)
    # real pairs: what a fit is sure of becomes a case, what it doubts is left out of the next
    real = np.arange(len(rows)) >= made
    for epochs in (4, 8):
        p = sigmoid(x.dot(w))
        y[real] = (p[real] > SURE).astype(np.float32)
        doubt = real & ((p > 0.15) & (p <= SURE)).any(axis=1)
        w = train(x.take(np.flatnonzero(~held & ~doubt)), y[~held & ~doubt], SIZE, epochs=epochs)
    p = sigmoid(x.dot(w))
    # held-out pairs calibrate; real ones whose label and last fit differ are in doubt as well
    check = held & ~doubt & ~(real & ((p > SURE) != (y > 0)).any(axis=1))
    limits = [float(np.clip(threshold(p[check, j], y[check, j] > 0, PRECISION), *LIMITS)) for j in range(len(DEFECTS))]
    # what lies in the head of a sound answer is sound; beyond it, what this fit is sure of is a refusal
    sound = p[made:, REFUSAL] <= SURE
    cases = [(k, part, beyond) for (k, a), ok in zip(((Asked(q, lexicon), a) for q, a in base), sound) for part, beyond in passages(a) if ok or beyond]
    parts, beyond = [packed(q, part, lexicon) for q, part, _ in cases], np.array([b for *_, b in cases], bool)
    x = Rows(data + parts)
    p = sigmoid(x.dot(w))[len(data) :, REFUSAL]
    z = np.concatenate([y[:, REFUSAL], (p > SURE) & beyond]).astype(np.float32)[:, None]
    use = np.concatenate([~doubt, (p <= 0.15) | (p > SURE) | ~beyond])
    held = np.concatenate([held, rng.random(len(parts)) < 0.2])
    deep = train(x.take(np.flatnonzero(~held & use)), z[~held & use], SIZE, epochs=8)
    return Model(w, limits, deep, threshold(sigmoid(x.dot(deep))[held & use, 0], z[held & use, 0] > 0, 0.95), lexicon)


def sample(feedback: DataFrame) -> list[tuple[str | None, str | None]]:
    """At most SAMPLE pairs, by the hash of their id: a model's training rows are bounded, its results aren't."""
    n = feedback.count()
    part = feedback.where(F.col("question").isNotNull() & F.col("answer").isNotNull())
    if n > SAMPLE:
        part = part.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE / n))
    rows = part.select("id", "question", "answer").distinct().orderBy("id").limit(SAMPLE).collect()
    return [(r.question, r.answer) for r in rows]


def defective(feedback: DataFrame) -> DataFrame:
    """(id, defect)"""
    model = feedback.sparkSession.sparkContext.broadcast(fit(sample(feedback)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                ids, kinds = [], []
                for i, hits in zip(part.column(0).to_pylist(), model.value.defects(list(zip(part.column(1).to_pylist(), part.column(2).to_pylist())))):
                    ids += [i] * len(hits)
                    kinds += hits
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kinds, pa.string())], names=["id", "defect"])

    return feedback.where(F.col("id").isNotNull()).select("id", "question", "answer").mapInArrow(run, "id string, defect string").distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defective(table(spark, sf_dir, "feedback"))
