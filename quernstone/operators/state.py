"""Keyed state in batch form: cache, gaps, histories, rate limits, request checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions.chat import cache_key
from quernstone.functions.text import has_content

TTL = 86_400  # seconds an answer stays in the cache


def cache_put(answers: DataFrame, ttl: int = TTL) -> DataFrame:
    """(key, data, expires_at): the latest answer per question; empty answers are refused."""
    good = answers.where(has_content(F.col("answer"))).where(F.col("question").isNotNull())
    w = Window.partitionBy(cache_key(F.col("question"))).orderBy(F.desc("created_at"), F.desc("id"))
    last = good.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return last.select(cache_key(F.col("question")).alias("key"), F.col("answer").alias("data"), (F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl))).alias("expires_at"))


def cache_get(questions: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Questions with the cached data, null where there is none or it has expired."""
    live = cache.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now)).select("key", "data")
    return questions.withColumn("key", cache_key(F.col("question"))).join(live, "key", "left")


def recent_gaps(gaps: DataFrame, n: int = 20) -> DataFrame:
    return gaps.orderBy(F.desc("created_at"), "id").limit(n)


def last_turns(turns: DataFrame, by: str, order: list[str], n: int = 3) -> DataFrame:
    """Each turn with the texts of the n before it."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list("text").over(w))


def keep_last(messages: DataFrame, by: str, order: list[str], n: int = 50) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*(F.desc(o) for o in order))
    return messages.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def sliding_rate(requests: DataFrame, by: str, at: str, seconds: int = 300) -> DataFrame:
    """Requests of the same key in the window that ends with each."""
    w = Window.partitionBy(by).orderBy(F.col("__s")).rangeBetween(-seconds, 0)
    return requests.withColumn("__s", F.unix_timestamp(F.col(at).cast("timestamp"))).withColumn("in_window", F.count("*").over(w)).drop("__s")


def fixed_rate(requests: DataFrame, by: str, at: str, width: str = "1 minute") -> DataFrame:
    return requests.groupBy(by, F.window(F.col(at), width).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


# Bounds on the fields of requests, in characters, and on the lengths of their lists.
MAX_CHAT, MAX_TURN, MAX_QUESTION, MAX_ANSWER, MAX_REASON, MAX_NAME, MAX_PHONE, MAX_MESSAGE, MAX_ID, MAX_URL, MAX_ITEMS = 2000, 5000, 5000, 50_000, 2000, 200, 50, 5000, 200, 2048, 50


def _within(name: str, most: int, least: int = 1) -> Column:
    n = F.length(name)
    return n.between(least, most) if least else F.col(name).isNull() | (n <= most)


def valid_chat(history: str = "history") -> Column:
    h = F.col(history)
    turns = h.isNull() | ((F.size(h) <= MAX_ITEMS) & F.forall(h, lambda t: F.coalesce(t["role"].isin("user", "assistant") & (F.length(t["content"]) <= MAX_TURN), F.lit(False))))
    return F.coalesce(_within("question", MAX_CHAT) & turns, F.lit(False))


def valid_feedback() -> Column:
    c = F.col("chunks")
    ok = lambda x: F.coalesce((F.length(x["chunk_id"]) <= MAX_ID) & (F.length(x["url"]) <= MAX_URL) & x["score"].between(0, 1) & ~F.isnan(x["score"]), F.lit(False))
    chunks = c.isNull() | ((F.size(c) <= MAX_ITEMS) & F.forall(c, ok))
    return F.coalesce(_within("question", MAX_QUESTION) & _within("answer", MAX_ANSWER) & F.col("thumbs_up").isNotNull() & chunks & _within("reason", MAX_REASON, 0), F.lit(False))


def valid_lead() -> Column:
    """Bounds on lengths and the form of the address."""
    email = F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")
    return F.coalesce(_within("name", MAX_NAME) & email & _within("question", MAX_QUESTION) & _within("phone", MAX_PHONE, 0) & _within("message", MAX_MESSAGE, 0), F.lit(False))


def key_ok(given: Column, wanted: str | None) -> Column:
    """The request's key is the service's; without a key of its own the service takes any."""
    return F.coalesce(given == wanted, F.lit(False)) if wanted else F.lit(True)


def country_allowed(country: Column, denied: list[str]) -> Column:
    """Requests from none of the denied countries; unknown ones pass, and without a list all do."""
    return F.coalesce(~country.isin(denied), F.lit(True)) if denied else F.lit(True)


# --- records in one keyed table: (pk, type, data, created_at), data being JSON without nulls and empty texts

ITEM = "pk string, type string, data string, created_at timestamp"


def items(records: DataFrame, kind: str, fields: list[str], key: Column | None = None, at: Column | None = None) -> DataFrame:
    """Records as items of a kind: the key, unless given, is random, and the time that of the write."""
    k = F.expr("uuid()") if key is None else key
    filled = [(F.when(F.col(f) != "", F.col(f)) if dict(records.dtypes)[f] == "string" else F.col(f)).alias(f) for f in fields]
    return records.select(F.concat(F.lit(f"{kind.upper()}#"), k).alias("pk"), F.lit(kind).alias("type"), F.to_json(F.struct(*filled)).alias("data"), (F.current_timestamp() if at is None else at).alias("created_at"))


def feedback_items(feedback: DataFrame, **where) -> DataFrame:
    """Valid feedback as items."""
    return items(feedback.where(valid_feedback()), "feedback", ["question", "answer", "thumbs_up", "chunks", "reason"], **where)


def lead_items(leads: DataFrame, **where) -> DataFrame:
    return items(leads.where(valid_lead()), "lead", ["name", "email", "question", "phone", "message"], **where)


def gap_items(results: DataFrame, **where) -> DataFrame:
    """One item for each declined question."""
    return items(results.where("is_decline"), "gap", ["question", "rewritten_query"], **where)


def append_items(new: DataFrame, path: str) -> None:
    new.select("pk", "type", "data", "created_at").write.mode("append").partitionBy("type").parquet(path)


def of_kind(table: DataFrame, kind: str) -> DataFrame:
    """Items whose key begins with the kind."""
    return table.where(F.col("pk").startswith(f"{kind.upper()}#"))


def listed_gaps(table: DataFrame, n: int = 20) -> DataFrame:
    """The newest gaps with their questions."""
    g = of_kind(table, "gap")
    rows = g.select("pk", F.get_json_object("data", "$.question").alias("question"), F.get_json_object("data", "$.rewritten_query").alias("rewritten_query"), "created_at")
    return rows.orderBy(F.desc("created_at"), "pk").limit(n)


def cache_aside(requests: DataFrame, cache: DataFrame, now: Column, answer) -> tuple[DataFrame, DataFrame]:
    """Every request (id, question, ...) with its answer and whether it was cached, and what the cache gains.

    ``answer`` gives (id, answer, is_decline) for the requests that missed; declined and empty answers aren't kept.
    """
    asked = cache_get(requests, cache, now)
    hits = asked.where(F.col("data").isNotNull()).select("id", "key", F.col("data").alias("answer"), F.lit(True).alias("hit"), F.lit(False).alias("is_decline"))
    misses = asked.where(F.col("data").isNull()).drop("data")
    fresh = answer(misses).join(misses.select("id", "key"), "id").select("id", "key", "answer", F.lit(False).alias("hit"), "is_decline")
    gains = fresh.where(~F.col("is_decline") & has_content(F.col("answer"))).groupBy("key").agg(F.max_by("answer", "id").alias("data")).withColumn("expires_at", now + F.make_dt_interval(secs=F.lit(TTL)))
    return hits.unionByName(fresh), gains


def last_messages(messages: DataFrame, by: str, at: list[str]) -> DataFrame:
    """(by, last_user, last_assistant): the latest text of the user and of the assistant, errors left out."""
    order = F.struct(*at)
    text = lambda ok: F.max_by(F.when(ok, F.col("text")), F.when(ok, order))
    return messages.groupBy(by).agg(text(F.col("role") == "user").alias("last_user"), text((F.col("role") == "assistant") & ~F.coalesce(F.col("error"), F.lit(False))).alias("last_assistant"))
