"""Text as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(text: Column) -> Column:
    """White space collapsed to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(squeeze(F.lower(text)), 256)


def word_count(text: Column) -> Column:
    t = squeeze(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def has_content(text: Column) -> Column:
    return F.coalesce(F.length(squeeze(text)) > 0, F.lit(False))


def shingles(text: Column, words: int = 3) -> Column:
    """Distinct sequences of words; a shorter text's single words."""
    def of(w: Column) -> Column:
        n = F.size(w)
        seq = F.transform(F.sequence(F.lit(1), F.greatest(n - (words - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(words)), " "))
        return F.array_distinct(F.when(n < words, w).otherwise(seq))

    # the words are a lambda's variable, so they are found once and not once a place
    return F.get(F.transform(F.array(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))), of), F.lit(0))


def tail_overlap(text: Column, n: int) -> Column:
    """The last n characters, from the first sentence that begins in them."""
    tail = F.substring(text, -n, n)
    return F.when(F.length(text) <= n, text).otherwise(F.regexp_replace(tail, r"(?s)^.*?(?<=[.!?])\s+(?=\S)", ""))


def sections(markdown: Column) -> Column:
    """Parts that begin with a heading of any level; what stands before the first is a part too."""
    return F.filter(F.transform(F.split(F.replace(markdown, F.lit("\r\n"), F.lit("\n")), r"(?m)(?=^#{1,6}\s+\S)"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def chunk_id(url: Column, index: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", url, index.cast("string"), F.substring(text, 1, 64)), 256), 1, 16)


def page_title(html: Column) -> Column:
    """<title> without its last part after a bar or dash, else the first <h1>, else empty."""
    raw = squeeze(entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    cut = F.trim(F.regexp_replace(raw, r"\s*[|\-–—]\s*[^|\-–—]+$", ""))
    h1 = squeeze(entities(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]*>", "")))
    return F.when(html.isNotNull(), F.coalesce(F.nullif(cut, F.lit("")), F.nullif(raw, F.lit("")), F.nullif(h1, F.lit("")), F.lit("")))


def entities(text: Column) -> Column:
    """The five entities of XML and a no-break space decoded; others stay."""
    t = text
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&#160;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return t


def hrefs(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)"), F.lit(1)), entities)


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|header|noscript)\b.*?</\1\s*>", " ")
    return squeeze(entities(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")))


def phrases_in(text: Column, phrases: list[str]) -> Column:
    """Those of the phrases that the text has, in their order."""
    return F.filter(F.array(*(F.lit(p) for p in phrases)), lambda p: F.contains(F.lower(text), p))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, other lengths and zero norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)
