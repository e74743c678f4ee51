"""Documents to retrieval chunks: question and answer pairs first, then heading sections cut to size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quernstone.functions import text as T

# Fixed values, in characters: largest and smallest chunk, and overlap (600, 400 and 65 tokens of 4).
MAX, MIN, OVERLAP = 2400, 1600, 260


SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)")
PARAGRAPH = re.compile(r"\n{2,}")


def overlap(text: str, n: int) -> str:
    """What a piece hands on to the next: its last n characters, from the first sentence that begins in them."""
    return text if len(text) <= n else SENTENCE.split(text[-n:], maxsplit=1)[-1]


def windows(text: str, most: int, lap: int) -> list[str]:
    """Pieces of exactly ``most`` characters, but for the last, each beginning with the overlap of the one before."""
    out, at = [], 0
    while at + most < len(text):
        out.append(text[at : at + most])
        at += most - len(overlap(out[-1], lap))
    return [*out, text[at:]]


def cut_section(section: str, most: int = MAX, least: int = MIN, lap: int = OVERLAP) -> list[str]:
    """Pieces of at most ``most`` characters, paragraphs kept whole where possible.

    A piece ends before the paragraph that would make it too long, if it has ``least`` characters by then,
    and hands on its overlap. A paragraph longer than a piece is cut into windows, and so is what is
    left at the end if it is too long; if it is short, it joins the last piece where there is room.
    """
    if len(section) <= most:
        return [section]
    out: list[str] = []
    held: list[str] = []
    size = 0  # characters of the held paragraphs, of the last window alone after a cut paragraph

    def close() -> int:
        out.append("\n\n".join(held))
        held[:] = [x for x in (overlap(out[-1], lap),) if x]
        return sum(map(len, held))

    for p in (x.strip() for x in PARAGRAPH.split(section)):
        if not p:
            continue
        if len(p) > most:
            if held:
                close()
            *full, rest = windows(p, most, lap)
            out += full
            held.append(rest)
            size = len(rest)
            continue
        if size + 2 * bool(held) + len(p) > most and size >= least:
            close()
        held.append(p)
        size = sum(map(len, held))
    rest = "\n\n".join(held).strip()
    if len(rest) > most:
        out += windows(rest, most, lap)
    elif rest and out and len(rest) < least and len(out[-1]) + 2 + len(rest) <= most:
        out[-1] += "\n\n" + rest
    elif rest:
        out.append(rest)
    return out or [section]


@F.pandas_udf(ArrayType(StringType()))
def section_pieces(sections: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in sections:
        yield s.map(lambda parts: [p for x in parts for p in cut_section(x) if p.strip()] if parts is not None else None)


def chunk_documents(docs: DataFrame) -> DataFrame:
    """(chunk_id, url, title, page_type, content_hash, text, chunk_index, source, is_faq), map only."""
    pairs = F.coalesce(F.col("faq_pairs"), F.array().cast("array<struct<question:string,answer:string>>"))
    faq = F.transform(F.filter(pairs, lambda p: p["question"].isNotNull()), lambda p: F.struct(F.concat(F.lit("Q: "), p["question"], F.lit("\nA: "), F.coalesce(p["answer"], F.lit(""))).alias("text"), F.lit(True).alias("is_faq")))
    # only documents with a section that is too long leave the JVM
    whole = docs.withColumn("__s", T.sections(F.col("markdown")))
    pieces = F.coalesce(section_pieces(F.when(F.exists("__s", lambda x: F.length(x) > MAX), F.col("__s"))), F.col("__s"), F.array().cast("array<string>"))
    body = F.transform(pieces, lambda t: F.struct(t.alias("text"), F.lit(False).alias("is_faq")))
    rows = whole.withColumn("__c", F.concat(faq, body)).select("url", "title", "page_type", "source", F.posexplode("__c").alias("chunk_index", "c"))
    return rows.select(
        T.chunk_id(F.col("url"), F.col("chunk_index"), F.col("c.text")).alias("chunk_id"), "url", "title", "page_type", F.sha2("c.text", 256).alias("content_hash"), F.col("c.text").alias("text"), "chunk_index", "source", F.col("c.is_faq").alias("is_faq")
    )


def overview_documents(texts: DataFrame, text: str = "text", url: str = "url") -> DataFrame:
    """Site overviews (text, url) as documents; blank ones give none."""
    t, u = F.col(text), F.col(url)
    return texts.where(T.has_content(t)).select(
        u.alias("url"), u.alias("original_url"), F.lit("Overview").alias("title"), t.alias("markdown"), F.lit("overview").alias("page_type"), F.sha2(t, 256).alias("content_hash"), F.lit("overview").alias("source"),
        F.lit(None).cast("string").alias("lastmod"), F.lit(None).cast("double").alias("priority"), F.array().cast("array<struct<question:string,answer:string>>").alias("faq_pairs"),
    )
