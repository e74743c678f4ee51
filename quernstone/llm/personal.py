"""Personal information inside free text.

Regular expressions propose spans; checksum validators confirm some; words nearby raise or lower the
score; spans of at least ``ACCEPT`` stay, and of overlapping ones the better. Names are proposed by
a gazetteer of given and family names taken from the structured name columns of the same data
(all of them, joined with the words of the texts), and by cues such as titles and sign-offs.

Defined results: null and empty texts have no items; full-width digits and letters, odd blanks and
dashes count as their plain forms, zero-width characters as nothing; a record sent twice counts
once; extra columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.runtime import cut, table

ACCEPT = 0.5
NEAR = 32  # characters before a span that count as its context
KINDS = ("name", "email", "phone", "address", "id_number")

ZERO_WIDTH = frozenset("\u200b\u200c\u200d\u2060\ufeff\u00ad")
PLAIN = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {c: 0x20 for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)} | {c: 0x2D for c in (*range(0x2010, 0x2016), 0x2212, 0xFE58, 0xFE63)}

# --- checksums


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def nir(digits: str) -> bool:
    """French social security: 13 digits and 97 minus their remainder."""
    return len(digits) == 15 and digits[0] in "12" and 97 - int(digits[:13]) % 97 == int(digits[13:])


def dni(number: str, letter: str) -> bool:
    """Spanish identity number: the letter is that of the remainder by 23."""
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23] == letter.upper()


def mod11_10(digits: str) -> bool:
    """German tax number, ISO 7064."""
    p = 10
    for c in digits[:-1]:
        s = (int(c) + p) % 10 or 10
        p = 2 * s % 11
    return (11 - p) % 10 == int(digits[-1])


def ssn(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


# --- context

ID_CUE = (
    r"ssn|social security(?: number| no\.?)?|sécurité sociale|securite sociale|seguridad social|sozialversicherungs\w*|n\.?i\.?r\.?|dni|nie|nif|steuer-?\s?id\w*|steuer-?nummer|steueridentifikation\w*|"
    r"tax id|itin|national insurance(?: no\.?| number)?|nino|passport(?: no\.?| number)?|passeport|pasaporte|reisepass\w*|personalausweis\w*|ausweis\w*|id card|identity card|carte d['’]identité|"
    r"national id(?:entity)?(?: number| no\.?)?|identity number|aadhaar|driv(?:er'?s|ing) licen[cs]e|führerschein\w*|permis de conduire|pesel|bsn|cpf|curp|nric|pan(?: card| no\.?)?|codice fiscale|personnummer|documento de identidad"
)
PHONE_CUE = re.compile(r"(?i)\b(?:call|phone|tel|telephone|mobile|cell|text|sms|fax|whatsapp|number|dial|ring|reach|appeler|téléphone|telefon\w*|handy|rufen|anrufen|rückruf|teléfono|móvil|llam\w+|joindre|numéro|nummer|número|erreich\w+)\b")
NUMBER_OTHER = re.compile(
    r"(?i)(?:\b(?:orders?|ticket|invoice|sku|serial|version|batch|lot|pedido|coordinates|budget|firmware|behind|model|row|hall|case|commande|facture|bestell\w*|rechnung\w*|auftrag\w*|factura|tarif|artikel\w*|ref|reference|tracking|isbn|ean|imei|account no|iban|konto\w*)\b[^,;\n]{0,16}|#\s*)$"
)
PHONE = re.compile(
    r"(?<![\w.,/#@-])(?:\+|00)?\(?\d{1,5}\)?(?:(?:[ .-]| ?/ ?)?\(?\d{1,5}\)?){1,6}(?:\s*(?:ext\.?|x|extension|durchwahl|poste)\s*\d{1,6})?(?![\w@-]|[.,/]\d)", re.I
)
DATE = re.compile(r"^(?:\d{4}[-./]\d\d?[-./]\d\d?|\d\d?[-./]\d\d?[-./](?:\d{4}|\d\d))$")
DOTTED = re.compile(r"^\d{1,3}(?:\.\d{1,3}){1,3}$")
SPELLED = {w: str(d) for d, ws in enumerate(("zero oh null cero zéro", "one eins uno un", "two zwei dos deux", "three drei tres trois", "four vier cuatro quatre", "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf")) for w in ws.split()}
SPOKEN = re.compile(r"(?i)\b(?:(?:" + "|".join(SPELLED) + r")[\s,-]+){6,}(?:" + "|".join(SPELLED) + r")\b")

EMAIL = re.compile(
    r"(?i)(?<![\w.+@/-])\w(?:[\w.+%'-]*\w)?(?:@| ?(?:\(at\)|\[at\]|\{at\}|<at>) ?)(?:[\w-]+(?:\.| ?(?:\(dot\)|\[dot\]|\{dot\}) ?))+[a-z]{2,24}(?![\w@])"
    r"|(?<![\w.+@/-])\w[\w.+%-]* @ (?:[\w-]+\.)+[a-z]{2,24}(?![\w@])"
    r"|\b\w[\w.+-]* (?:at|arobase|arroba) (?:[\w-]+ (?:dot|punto|point|punkt) )+[a-z]{2,24}\b"
)

ID_AFTER = re.compile(rf"(?i:\b(?:{ID_CUE})(?!\w))[^.\n\d]{{0,24}}?[\s(:]((?:[A-Z]{{0,3}}\d|[A-Z]{{2}} \d|[A-Z]{{5}}\d)(?:[ ./-]?[A-Z0-9])+)(?![\w])")
ID_BEFORE = re.compile(rf"(?<![\w.-])([A-Z]{{0,2}} ?\d(?:[ ./-]?[A-Z0-9])+|[A-Z](?:[ -]?[A-Z0-9]){{6,12}})\s*\((?i:[^()]{{0,16}}(?:{ID_CUE})[^()]{{0,12}})\)")
SSN = re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])")
DNI = re.compile(r"(?<![\w.-])(\d{8})[ -]?([A-Za-z])(?![\w])")
NIR = re.compile(r"(?<![\w.-])[12][ .]?\d\d[ .]?\d\d[ .]?\d[\dAB][ .]?\d{3}[ .]?\d{3}[ .]?\d\d(?![\w])")
NINO = re.compile(r"(?<![\w])[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d\d ?\d\d ?\d\d ?[A-D](?![\w])")

PLACE = r"(?:\d{4,6} +)?[A-ZÀ-Ý][\w'’À-ÿ-]+(?: +\d{4,6}(?![\w-]))?"
TAIL = rf"(?:,\s*(?:Suite|Apt\.?|Unit|Flat|\d{{1,2}}\s?[ºª°] ?\w?) *\w{{0,4}})?(?:, *{PLACE})?"
ROAD = r"(?:Street|St\.|Avenue|Ave\.?|Lane|Ln\.?|Road|Rd\.?|Drive|Dr\.|Court|Place|Square|Terrace|Way|Close|Boulevard|Blvd\.?|Crescent|Gardens|Grove|Parkway|Mews|Walk|Alley|Highway)"
ADDRESS = [
    re.compile(rf"(?:(?i:flat|apt\.?|apartment|unit|suite|room)\s*\w{{1,4}},?\s+)?(?<![\w.,/-])(?<!\d )\d{{1,5}}[a-zA-Z]?,?\s+(?:(?!(?i:model|version|tarif)\b)[\w'’À-ÿ-]+\s+){{1,3}}?(?i:{ROAD})(?![\w-]){TAIL}"),
    re.compile(rf"(?<![\w.,/-])\d{{1,4}}(?:\s?(?i:bis|ter|quater|[a-d]))?,?\s+(?i:rue|avenue|av\.|boulevard|bd\.?|impasse|allée|allee|chemin|place|quai|cours|route|square|passage|ruelle|sentier|villa)\s+(?i:(?:de\s+la|de\s+l['’]|des|du|de|d['’]|la|le|les)\s*)?[\w'’À-ÿ-]+{TAIL}"),
    re.compile(rf"(?i:\b(?:calle|c/|avda\.?|avenida|plaza|pza\.?|paseo|camino|carretera|ronda|travesía|callejón))\s+(?i:(?:de\s+la|de\s+los|de\s+las|del|de)\s+)?[\w'’À-ÿ-]+(?:\s+[^\W\d][\w'’À-ÿ-]*)?,?\s*(?:n[ºo°]\.?\s*)?\d{{1,4}}(?!\d){TAIL}"),
    re.compile(rf"\b[\wÄÖÜäöüß-]*(?i:straße|strasse|str\.|weg|allee|platz|gasse|ring|damm|ufer|stieg|chaussee|pfad)\s+\d{{1,4}}\s?[a-zA-Z]?(?![\w]){TAIL}"),
    re.compile(rf"(?i:\b(?:p\.?\s?o\.?\s?box|post office box|postfach|boîte postale|boite postale|b\.p\.|apartado(?:\s+de\s+correos)?|casilla(?:\s+postal)?))\s+(?:n[ºo°]\.?\s*)?\d{{2,6}}(?:,\s*{PLACE})?"),
]
NOT_ADDRESS = re.compile(r"(?i)\b(?:model|version|tarif)\s+$")

WORD = r"[^\W\d_]+(?:['’][^\W\d_]+)*"
CAPITAL = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:['’-][^\W\d_]+)*"
INTRO = re.compile(rf"(?i:\b(?:this is|my name is|je suis|je m['’]appelle|soy|me llamo|mi nombre es|mein name ist|ich heiße|ich heisse|monsieur|madame|mme\.?|herr|frau|señora?|mrs?\.?|ms\.?|mister|dr\.?|sig\.?))\s+((?:{CAPITAL}|[A-Z]\.)(?:,?\s+(?:{CAPITAL}|[A-Z]\.))*)")
FIRM = re.compile(r"\s+(?:&|Ltd|Inc|GmbH|AG|Labs?|Studio|Systems|Partners|LLC|SARL|S\.?A\.|Group|Team)\b")
COMMON = frozenset("the this that we our you your i it in on at for from and or but with when what who how why der die das ein eine wir ihr sie ich mit nach in im la le les el los las un una une des du en avec après con por para si no yes ja oui the please monday tuesday support".split())


AT, DIGIT = re.compile(r"(?i)@|\bat\b|arobase|arroba|[(\[{<]at[)\]}>]"), re.compile(r"\d")


def folded(word: str) -> str:
    """Lower case without accents, for comparing names."""
    w = unicodedata.normalize("NFD", word.lower()).replace("ø", "o").replace("ł", "l").replace("ß", "ss").replace("æ", "ae").replace("đ", "d").replace("ı", "i")
    return "".join(c for c in w if not unicodedata.combining(c))


@dataclass
class Gazetteer:
    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()


@dataclass
class Span:
    start: int
    end: int
    kind: str
    score: float
    text: str = field(default="", compare=False)


def plain(text: str) -> tuple[str, list[int] | None]:
    """The text with plain characters, and where each stood if any were left out."""
    if not any(c in ZERO_WIDTH for c in text):
        return text.translate(PLAIN), None
    at = [i for i, c in enumerate(text) if c not in ZERO_WIDTH]
    return "".join(text[i] for i in at).translate(PLAIN), at


def phone_score(t: str, a: int, b: int) -> float:
    s = t[a:b]
    body = re.split(r"(?i)\s*(?:ext|x|durchwahl|poste)", s)[0]
    digits = re.sub(r"\D", "", body)
    if not 7 <= len(digits) <= 15 or DATE.match(body) or (DOTTED.match(body) and not re.fullmatch(r"\d{2}(?:\.\d{2}){4}|(?:\d\.)?\d{3}\.\d{3}\.\d{4}", body)):
        return 0
    before = t[max(0, a - NEAR) : a]
    if len(digits) >= 13 and body[0] in "3456" and luhn(digits):  # a payment card
        return 0
    score = 0.1
    if re.match(r"\+\d|00\d\d?[ -]", body):
        score += 0.5
    elif re.match(r"\(\d{2,4}\)", body) or re.fullmatch(r"\d{3}[ .-]\d{3}[ .-]\d{4}|\d[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}", body):
        score += 0.4
    elif body[0] == "0" and re.search(r"\d[ ./-]\d", body) and len(digits) >= 9:
        score += 0.4
    elif re.fullmatch(r"\d{4} \d{3} \d{3}|0\d{8,11}|\d{10,11}", body):
        score += 0.2
    if len(s) > len(body):
        score += 0.2
    line = t[t.rfind("\n", 0, a) + 1 : (t + "\n").find("\n", b)].strip()
    if line == s.strip():
        score += 0.3
    elif a and t[a - 1] == "\n":
        score += 0.2
    other, cue = NUMBER_OTHER.search(before), None
    wide = t[max(0, a - 2 * NEAR) : a]
    for cue in PHONE_CUE.finditer(wide):
        pass
    if cue is not None and (other is None or cue.start() > other.start() + len(wide) - len(before)):
        score += 0.4
    elif other is not None:
        score -= 0.7
    return score


def id_score(raw: str, cued: bool, t: str, a: int) -> float:
    body = re.sub(r"[ ./-]", "", raw)
    digits = re.sub(r"\D", "", raw)
    if len(body) < 6 or len(digits) < 4:
        return 0
    score = 0.6 if cued else 0.0
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", raw):
        score += 0.5 + 0.2 * ssn(digits)
    elif m := re.fullmatch(r"(\d{8})([A-Za-z])", body):
        score += 0.6 if dni(m[1], m[2]) else 0.1
    elif len(digits) == 15 and NIR.fullmatch(raw):
        score += 0.6 if nir(digits) else 0.3
    elif NINO.fullmatch(raw):
        score += 0.5
    elif len(body) == 11 and body.isdigit():
        score += 0.2 * mod11_10(body)
    elif len(body) in (9, 10) and body.isdigit():  # Canadian and Swedish numbers end with a Luhn digit
        score += 0.2 * luhn(body)
    if NUMBER_OTHER.search(t[max(0, a - NEAR) : a]) and not cued:
        score -= 0.6
    return score


def name_spans(t: str, g: Gazetteer, taken: list[Span]) -> Iterator[Span]:
    words = [(m.start(), m.end(), m[0], folded(m[0])) for m in re.finditer(WORD, t)]
    busy = bytearray(len(t))
    for s in taken:
        busy[s.start : s.end] = b"\1" * (s.end - s.start)

    def gap(i: int, j: int) -> str:
        return t[words[i][1] : words[j][0]]

    def is_given(i: int) -> bool:
        return words[i][3] in g.given and not busy[words[i][0]]

    def is_family(i: int) -> bool:
        return words[i][3] in g.family and not busy[words[i][0]]

    def capital(i: int) -> bool:
        return words[i][2][0].isupper() and not busy[words[i][0]]

    def grow(j: int) -> int:
        """Over a double name."""
        while j + 1 < len(words) and gap(j, j + 1) in ("-", "‐") and (capital(j + 1) or is_family(j + 1)):
            j += 1
        return j

    i = 0
    while i < len(words):
        j, score = -1, 0.0
        if is_given(i):
            j, score = grow(i), 0.6 if capital(i) else 0.3
            k = j + 1
            if k < len(words) and len(words[k][2]) == 1 and capital(k) and re.fullmatch(r"\s+", gap(j, k)) and t[words[k][1] : words[k][1] + 1] == ".":
                j, k = k, k + 1  # an initial
            if k < len(words) and re.fullmatch(r"\.?\s+", gap(k - 1, k)) and (is_family(k) or (capital(k) and capital(i) and words[k][3] not in COMMON and k + 1 <= len(words) and "\n" not in gap(k - 1, k) and not is_given(k) and plausible(words[k][2], g))):
                j, score = grow(k), 0.9
        elif is_family(i):
            j, score = grow(i), 0.6 if capital(i) else 0.3
            k = j + 1
            if k < len(words) and re.fullmatch(r",\s+", gap(j, k)) and is_given(k):
                j, score = grow(k), 0.9
                if j + 1 < len(words) and len(words[j + 1][2]) == 1 and capital(j + 1) and re.fullmatch(r"\s+", gap(j, j + 1)) and t[words[j + 1][1] : words[j + 1][1] + 1] == ".":
                    j += 1
            elif k < len(words) and re.fullmatch(r"\s+", gap(j, k)) and is_given(k):
                j, score = grow(k), 0.9
        elif len(words[i][2]) == 1 and capital(i) and i + 1 < len(words) and re.fullmatch(r"\.\s*", gap(i, i + 1)) and is_family(i + 1):
            j, score = grow(i + 1), 0.9
        if j >= 0 and score >= ACCEPT:
            a, b = words[i][0], words[j][1]
            # what is written inside handles, paths and mail addresses is no name in the text
            if not (a and t[a - 1] in "@/_.+=" and t[a - 1 : a + 1].strip() and t[a - 2 : a - 1].isalnum()) and not re.match(r"[@/_]|\.\w", t[b : b + 2]):
                yield Span(a, b, "name", score)
            i = j + 1
        else:
            i += 1


def plausible(word: str, g: Gazetteer) -> bool:
    """Without known family names any capitalised word after a given name may be one; with them, they decide."""
    return not g.family


def spans(text: str | None, g: Gazetteer) -> list[Span]:
    """Items of personal data in reading order, at their places in ``text``."""
    if not text or not text.strip():
        return []
    t, at = plain(text)
    found: list[Span] = [Span(m.start(), m.end(), "email", 1.0) for m in EMAIL.finditer(t)] if AT.search(t) else []
    number = DIGIT.search(t) is not None  # but for spoken numbers, nothing else goes without a digit
    for rule in ADDRESS if number else ():
        for m in rule.finditer(t):
            if not NOT_ADDRESS.search(t[max(0, m.start() - 16) : m.start()]):
                found.append(Span(m.start(), m.end(), "address", 0.95))
    for rule in (ID_AFTER, ID_BEFORE) if number else ():
        for m in rule.finditer(t):
            if (s := id_score(m[1], True, t, m.start(1))) >= ACCEPT:
                found.append(Span(m.start(1), m.end(1), "id_number", s + 0.3))
    for rule in (SSN, DNI, NIR, NINO) if number else ():
        for m in rule.finditer(t):
            if (s := id_score(m[0], False, t, m.start())) >= ACCEPT:
                found.append(Span(m.start(), m.end(), "id_number", s))
    for m in PHONE.finditer(t) if number else ():
        if (s := phone_score(t, m.start(), m.end())) >= ACCEPT:
            found.append(Span(m.start(), m.end(), "phone", s))
    for m in SPOKEN.finditer(t):
        found.append(Span(m.start(), m.end(), "phone", 0.6 + 0.3 * bool(PHONE_CUE.search(t[max(0, m.start() - NEAR) : m.start()]))))
    found = best(found)
    names = list(name_spans(t, g, found))
    for m in INTRO.finditer(t):
        a, b = m.start(1), m.end(1)
        if m[1].split()[0].lower().rstrip(".,") not in COMMON and not FIRM.match(t, b):
            parts = [p for p in re.split(r"[\s,.-]+", m[1]) if p]
            if any(folded(p) in g.given or folded(p) in g.family for p in parts) or not g.given:
                names.append(Span(a, b, "name", 0.55))
    found = best(found + names)
    if at is not None:
        found = [Span(at[s.start], at[s.end - 1] + 1, s.kind, s.score) for s in found]
    for s in found:
        s.text = text[s.start : s.end]
    return found


def best(found: list[Span]) -> list[Span]:
    """Without overlaps: the better, then the longer, then the earlier."""
    kept: list[Span] = []
    for s in sorted(found, key=lambda s: (-s.score, s.start - s.end, s.start)):
        if all(s.end <= k.start or s.start >= k.end for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s.start)


def redact(text: str | None, g: Gazetteer) -> str | None:
    """The text with a typed placeholder in place of each item."""
    if text is None:
        return None
    out, last = [], 0
    for s in spans(text, g):
        out += [text[last : s.start], f"[{s.kind.upper()}]"]
        last = s.end
    return "".join([*out, text[last:]])


def name_words(names: DataFrame) -> DataFrame:
    """(word, given) of every name in a column ``name``: its first word is a given name, the parts of its last one are family names unless they are given names too."""
    w = F.split(F.trim("name"), r"(?U)\s+")
    parts = names.where(F.col("name").rlike(r"^\p{Lu}")).select(w.alias("w")).where(F.size("w") > 1)
    raw = parts.select(F.col("w")[0].alias("x"), F.lit(True).alias("given")).unionByName(parts.select(F.element_at("w", -1).alias("x"), F.lit(False).alias("given"))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(folded(p), g) for x, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for p in (([x] if x.isalpha() else []) if g else [p for p in x.split("-") if len(p) > 2])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], names=["word", "given"])

    return raw.mapInArrow(run, "word string, given boolean").groupBy("word").agg(F.max("given").alias("given"))


def gazetteer(names: DataFrame) -> Gazetteer:
    """All names of a table that fits the driver; ``with_names`` joins those of any table."""
    rows = name_words(names).collect()
    return Gazetteer(frozenset(r.word for r in rows if r.given), frozenset(r.word for r in rows if not r.given))


def with_names(fields: DataFrame, names: DataFrame) -> DataFrame:
    """``fields`` with the given and family names among the words of each text; an empty string stands for the rest of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = plain(text)[0]
                found = {folded(x) for x in re.findall(WORD, t)} | {folded(x) for m in INTRO.finditer(t) for x in re.split(r"[\s,.-]+", m[1]) if x}
                rows += [(key, x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["key", "word"])

    known = cut(name_words(names))
    some = known.agg(F.coalesce(F.max("given"), F.lit(False)), F.coalesce(F.max(~F.col("given")), F.lit(False))).first()
    rest = [F.array(F.lit("")) if x else F.array().cast("array<string>") for x in some]
    keyed = fields.withColumn("key", F.xxhash64("text"))
    words = keyed.select("key", "text").distinct().mapInArrow(run, "key long, word string")
    hits = words.join(known, "word").groupBy("key").agg(F.collect_set(F.when(F.col("given"), F.col("word"))).alias("g"), F.collect_set(F.when(~F.col("given"), F.col("word"))).alias("f"))
    both = [F.concat(F.coalesce(c, F.array().cast("array<string>")), r).alias(c) for c, r in zip(("g", "f"), rest)]
    return keyed.join(hits, "key", "left").select("source_table", "rec_id", "field", "text", *both)


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, rec_id, field, text) of all fields."""
    leads, feedback = table(spark, sf_dir, "leads"), table(spark, sf_dir, "feedback")
    one = [leads.select(F.lit("leads").alias("source_table"), F.col("id").alias("rec_id"), F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("message", "question")]
    two = feedback.select(F.lit("feedback").alias("source_table"), F.col("id").alias("rec_id"), F.lit("reason").alias("field"), F.col("reason").alias("text"))
    return one[0].unionByName(one[1]).unionByName(two).where(F.length("text") > 0)


def personal_items(fields: DataFrame, g: Gazetteer | None = None) -> DataFrame:
    """(source_table, rec_id, field, kind, seq), each once. Without a gazetteer, each row has its own (see ``with_names``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, rec, name, text, *own in zip(*(c.to_pylist() for c in batch.columns)):
                count: dict[str, int] = {}
                for s in spans(text, g or Gazetteer(*map(frozenset, own))):
                    count[s.kind] = count.get(s.kind, 0) + 1
                    rows.append((source, rec, name, s.kind, count[s.kind]))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.int32())], names=["source_table", "rec_id", "field", "kind", "seq"])

    return fields.mapInArrow(run, "source_table string, rec_id string, field string, kind string, seq int").distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_items(with_names(_fields(spark, sf_dir), table(spark, sf_dir, "leads")))


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_redacted: every text with placeholders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([redact(t, Gazetteer(frozenset(g), frozenset(f))) for t, g, f in zip(*(c.to_pylist() for c in b.columns[3:]))], pa.string())], names=["source_table", "rec_id", "field", "text"])

    return with_names(_fields(spark, sf_dir), table(spark, sf_dir, "leads")).mapInArrow(run, "source_table string, rec_id string, field string, text string").distinct()
