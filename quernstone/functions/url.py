"""URLs as Catalyst expressions. No expression throws on bad input; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, besides everything that begins with utm_.
TRACKING = ["gclid", "fbclid", "msclkid"]
# Page types by path, the first that matches counts.
PAGE_TYPES = [
    (r"^/$", "home"),
    (r"^/faq(/|$)", "faq"),
    (r"^/case-study/", "case-study"),
    (r"^/blog/", "blog"),
    (r"^/services/", "service"),
    (r"^/industry/", "industry"),
    (r"^/industries/", "industry"),
    (r"^/hire-", "hire"),
    (r"^/(privacy-policy|terms|cookie|legal)", "legal"),
    (r"^/(contact|about|team|company|careers)", "company"),
]
#: RFC 3986, appendix B
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def path(url: Column) -> Column:
    return part(url, 3)


def _form(text: Column) -> Column:
    """Form encoding as browsers' libraries write it: ~ stays, * doesn't."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _pieces(query: Column) -> Column:
    """(name, value) of each parameter; a bare name has an empty value."""
    def one(p: Column) -> Column:
        at = F.instr(p, "=")
        name = F.when(at > 0, F.substring(p, F.lit(1), at - 1)).otherwise(p)
        value = F.when(at > 0, F.substring(p, at + 1, F.length(p))).otherwise(F.lit(""))
        return F.struct(F.coalesce(F.try_url_decode(name), name).alias("k"), F.coalesce(F.try_url_decode(value), value).alias("v"))

    return F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), one)


def clean_query(query: Column) -> Column:
    """Query without tracking parameters; repeated names move to the place of the first."""
    kept = F.filter(_pieces(query), lambda p: ~(F.lower(p["k"]).startswith("utm_") | F.lower(p["k"]).isin(TRACKING)))
    names = F.array_distinct(F.transform(kept, lambda p: p["k"]))
    grouped = F.flatten(F.transform(names, lambda n: F.filter(kept, lambda p: p["k"] == n)))
    return F.array_join(F.transform(grouped, lambda p: F.concat(_form(p["k"]), F.lit("="), _form(p["v"]))), "&")


def _join(s: Column, h: Column, p: Column, q: Column) -> Column:
    return F.concat(F.when(s != "", F.concat(s, F.lit(":"))).otherwise(""), F.when(h != "", F.concat(F.lit("//"), h)).otherwise(""), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def normalize(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters; the path's case stays."""
    q = part(url, 4)
    return _join(scheme(url), host(url), path(url), F.when(q == "", q).otherwise(clean_query(q)))


def canonical(url: Column) -> Column:
    """:func:`normalize` with the path in lower case; the query's case and a trailing slash stay."""
    n = normalize(url)
    return _join(part(n, 1), part(n, 2), F.lower(part(n, 3)), part(n, 4))


def page_type(url: Column) -> Column:
    p = path(url)
    expr = F.lit("other")
    for pattern, name in reversed(PAGE_TYPES):
        expr = F.when(p.rlike(pattern), F.lit(name)).otherwise(expr)
    return F.when(url.isNotNull(), expr)


def slug(url: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(path(url), r"^/+|/+$", ""), r"[^a-zA-Z0-9_-]", "_")
    return F.when(url.isNotNull(), F.coalesce(F.nullif(F.substring(s, 1, 120), F.lit("")), F.lit("index")))


def url_hash(url: Column) -> Column:
    return F.substring(F.sha2(normalize(url), 256), 1, 16)


def source_label(url: Column) -> Column:
    return F.when(F.lower(url).contains("blog"), "blog-sitemap").otherwise("sitemap")


def http_only(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://"), F.lit(False))


def source_caption(url: Column) -> Column:
    """Without scheme, the first 30 characters."""
    return F.substring(F.regexp_replace(url, r"(?i)^https?://", ""), 1, 30)


def is_internal(url: Column, base: Column, subdomains: bool = True) -> Column:
    """Same registered domain, taken as the last two labels; a URL without host is internal."""
    h, b = F.regexp_replace(host(url), r":\d+$", ""), F.regexp_replace(host(base), r":\d+$", "")
    if not subdomains:
        return (h == "") | (h == b)
    a, c = F.split(h, r"\."), F.split(b, r"\.")
    last2 = lambda x: F.slice(x, F.size(x) - 1, 2)
    return (h == "") | F.when((F.size(a) >= 2) & (F.size(c) >= 2), last2(a) == last2(c)).otherwise(h == b)


def followable(href: Column) -> Column:
    return (F.trim(href) != "") & ~F.trim(href).rlike(r"(?i)^(#|mailto:|tel:|javascript:)")


def resolve(base: Column, href: Column) -> Column:
    """RFC 3986 resolution of a link against its base, dot segments included."""
    s, h, p = part(base, 1), part(base, 2), part(base, 3)
    folder = F.regexp_replace(p, r"[^/]*$", "")
    target = F.trim(href)
    query = F.regexp_extract(target, r"([?#].*)$", 1)
    bare = F.regexp_replace(target, r"[?#].*$", "")
    joined = F.when(bare == "", p).when(bare.startswith("/"), bare).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), bare))
    segments = F.aggregate(
        F.slice(F.split(joined, "/"), 2, 100_000),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    tail = F.when(joined.rlike(r"/\.\.?$"), F.lit("/")).otherwise("")
    walked = F.when(joined.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(segments, "/"), tail)).otherwise(joined)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(s, F.lit(":"), target))
        .otherwise(F.concat(s, F.lit("://"), h, walked, query))
    )


def urls_in(text: Column) -> Column:
    """All https URLs of a text, without what closes a sentence or bracket, each once, in order."""
    found = F.regexp_extract_all(text, F.lit(r"https://[^\s)\]>\"']+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:)\]}]+$", "")))
