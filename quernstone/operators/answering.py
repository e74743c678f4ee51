"""From questions to answers, for batches of questions.

Every outside service is a function the caller gives: rewriting, embedding, reranking and generating
are functions of DataFrames. Without them a question is searched as it is, by the offline
embedding, in the order of the fused lists, and answered by the first sentences of the best chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import chat as C
from quernstone.operators import retrieval
from quernstone.operators.ann import OtherEmbedder, SearchIndex, missing
from quernstone.runtime import cut, narrowed


def extractive(question: Column, chunks: Column, sentences: int = 3) -> Column:
    """The first sentences of the best chunk."""
    first = F.element_at(chunks, 1)["text"]
    return F.array_join(F.slice(F.split(F.regexp_replace(first, r"(?U)\s+", " "), r"(?<=[.!?])\s+"), 1, sentences), " ")


def first_sentences(rows: DataFrame) -> DataFrame:
    """The default generator."""
    return rows.withColumn("answer", extractive(F.col("question"), F.col("chunks")))


def hashed(rows: DataFrame) -> DataFrame:
    """The default embedder."""
    return rows.withColumn("vector", retrieval.hash_embedding(F.col("query")))


@dataclass
class Pipeline:
    """Tables that are searched, first the primary one, and the functions in between."""

    indexes: list[SearchIndex]
    embedders: list[tuple[str, int, Callable[[DataFrame], DataFrame]]] = field(default_factory=lambda: [("hash", 64, hashed)])  # (provider, dimensions, adds ``vector`` to ``query``)
    rewriter: Callable[[DataFrame], DataFrame] | None = None  # adds ``rewrite`` to (question, history, prompt)
    scorer: Callable[[DataFrame], DataFrame] | None = None  # adds ``relevance`` to (query, text)
    generate: Callable[[DataFrame], DataFrame] = first_sentences  # adds ``answer`` to (question, message, history, model, chunks)
    retrieved: int = 20
    reranked: int = 12
    final: int = 6

    def rewritten(self, questions: DataFrame) -> DataFrame:
        """``questions`` (query_id, question, history) with the query that is searched."""
        q, h = F.col("question"), F.col("history")
        if self.rewriter is None:
            return questions.withColumn("query", C.bounded(q))
        asked = self.rewriter(questions.withColumn("prompt", C.rewrite_prompt(q, h)))
        return asked.withColumn("query", C.rewritten(q, h, F.col("rewrite"))).drop("prompt", "rewrite")

    def candidates(self, queries: DataFrame) -> tuple[DataFrame | None, DataFrame, SearchIndex | None]:
        """What the first table that can be searched gives for (query_id, query), the embedded queries and that table; null if none is there for its embedder.

        A search that fails goes on to the next table; if none serves, its error is raised, as no result may come of it.
        """
        failed: Exception | None = None
        for index, (provider, dims, embed) in zip(self.indexes, self.embedders):
            try:
                index.pinned(provider, dims)
                embedded = embed(queries)
                return cut(index.hybrid(embedded.select("query_id", "query", "vector"), self.retrieved)), embedded, index
            except Exception as e:
                print(f"{index.path} can't be searched: {e}")
                if not isinstance(e, OtherEmbedder) and not missing(e):
                    failed = failed or e
        if failed is not None:
            raise failed
        return None, queries, None

    def chosen(self, hits: DataFrame, embedded: DataFrame, index: SearchIndex) -> DataFrame:
        """(query_id, pick, chunk columns) after reranking, boosts and diversity."""
        found = narrowed(index.rows().select("chunk_id", "url", "title", "page_type", "text", "vector"), hits.select("chunk_id").distinct(), "chunk_id")
        rows = hits.drop("title", "url", "page_type").join(found, "chunk_id")
        if self.scorer is not None:
            scored = self.scorer(rows.join(embedded.select("query_id", "query"), "query_id"))
            best = retrieval.rerank(scored, self.reranked, F.col("relevance"))
            best = best.withColumn("score", retrieval.boosted(F.col("relevance"), F.col("page_type")))
        else:
            best = retrieval.rerank(rows, self.reranked)
        best = best.withColumn("ord", F.col("rank")).join(embedded.select("query_id", F.col("vector").alias("query_vector")), "query_id")
        picks = retrieval.mmr(best.select("query_id", F.col("ord").cast("int").alias("ord"), "score", "vector", "query_vector"), self.final)
        return picks.join(best.drop("query_vector", "vector"), ["query_id", "ord"])

    def answers(self, questions: DataFrame) -> DataFrame:
        """(query_id, question, rewritten_query, answer, sources, language, model, chunks_used, is_decline) of (query_id, question, history), one row each."""
        asked = cut(self.rewritten(questions))
        hits, embedded, index = self.candidates(asked.select("query_id", "query"))
        none = F.array().cast("array<struct<pick:int,chunk_id:string,url:string,title:string,page_type:string,text:string>>")
        if hits is None:
            rows = asked.withColumn("chunks", none)
        else:
            picked = self.chosen(hits, embedded, index)
            best = picked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pick", "chunk_id", "url", "title", "page_type", "text"))).alias("chunks"))
            rows = asked.join(best, "query_id", "left").withColumn("chunks", F.coalesce("chunks", none))
        n = F.size("chunks")
        rows = rows.withColumn("model", C.resolved_model(F.col("question"), n)).withColumn("message", C.user_message(F.col("question"), C.context_block(F.col("chunks"))))
        made = self.generate(rows)
        answer = F.when(n > 0, F.coalesce(C.strip_thinking(F.col("answer")), F.lit(""))).otherwise(C.DECLINE)
        made = made.withColumn("answer", answer)
        return made.select(
            "query_id", "question", F.col("query").alias("rewritten_query"), "answer", F.array_distinct(F.col("chunks.url")).alias("sources"), C.detect_language(F.col("question")).alias("language"),
            F.when(n > 0, F.col("model")).otherwise("").alias("model"), n.alias("chunks_used"), C.is_decline(F.col("answer"), n, C.DECLINE).alias("is_decline"),
        )


def events(results: DataFrame) -> DataFrame:
    """(query_id, seq, event, data): each result as the stream its client gets."""
    stream = C.chat_events(F.col("answer"), F.col("sources"), F.col("is_decline"), F.col("model"), F.col("chunks_used"))
    return results.select("query_id", F.posexplode(stream).alias("seq", "e")).select("query_id", "seq", "e.event", "e.data")
