"""Queries of conversations, answers and state over whole tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import chat as C
from quernstone.functions import text as T
from quernstone.functions import url as U
from quernstone.operators import ann, answering, retrieval, state
from quernstone.plans import pages
from quernstone.plans import queries as Q
from quernstone.plans.queries import WS, query
from quernstone.runtime import table

ONCE = "(SELECT DISTINCT id, question, answer, thumbs_up, reason, created_at FROM feedback WHERE question IS NOT NULL)"


def _feedback(spark, d):
    return table(spark, d, "feedback").where("question is not null").select("id", "question", "answer", "thumbs_up", "reason", "created_at").distinct()


# --- questions

WORD_COUNTS = ", ".join(f"len(list_filter(ws, lambda w: list_contains({ws}, w))) AS {k}" for k, ws in C.COMMON_WORDS.items())
SHARES = {k: f"4 * length(regexp_replace(question, '[^{chars}]', '', 'g')) > letters" for k, chars in C.SCRIPTS.items()}
BEST = f"greatest({', '.join(C.COMMON_WORDS)})"
LANGUAGE = f"CASE {' '.join(f'WHEN {c} THEN {k!r}' for k, c in SHARES.items())} WHEN {BEST} = 0 THEN 'en' {' '.join(f'WHEN {k} = {BEST} THEN {k!r}' for k in C.COMMON_WORDS)} END"


@query(rf"SELECT id, {LANGUAGE} AS language FROM (SELECT *, {WORD_COUNTS} FROM (SELECT id, question, length(regexp_replace(question, '[^\p{{L}}]', '', 'g')) AS letters, regexp_extract_all(lower(question), '\p{{L}}+') AS ws FROM (SELECT DISTINCT id, question FROM feedback WHERE question IS NOT NULL)))")
def question_languages(spark, d):
    q = _feedback(spark, d).select("id", "question").distinct()
    return q.select("id", C.detect_language(F.col("question")).alias("language"))


ESCALATE = f"""(len(regexp_extract_all(question, '\\?')) > 1 OR {' OR '.join(f"contains(lower(question), '{p}')" for p in C.DEEP_PHRASES)} OR len(list_intersect(regexp_split_to_array(lower(question), '\\s+'), {C.DEEP_WORDS})) > 0)"""


@query(f"SELECT id, CASE WHEN coalesce(len(chunks), 0) > 0 AND {ESCALATE} THEN 'escalation' ELSE 'primary' END AS model FROM (SELECT DISTINCT id, question, chunks FROM feedback WHERE question IS NOT NULL)")
def resolved_models(spark, d):
    f = table(spark, d, "feedback").where("question is not null").select("id", "question", "chunks").distinct()
    return f.select("id", C.resolved_model(F.col("question"), F.size("chunks")).alias("model"))


@query(f"SELECT id, left(question, {C.MAX_QUESTION}) AS query FROM (SELECT DISTINCT id, question FROM feedback WHERE question IS NOT NULL)")
def bounded_questions(spark, d):
    return _feedback(spark, d).select("id", C.rewritten(F.col("question"), F.array().cast("array<struct<role:string,content:string>>")).alias("query")).distinct()


TURNS = """turns AS (SELECT event_id, user_id, CASE WHEN event_type = 'click' THEN 'assistant' ELSE 'user' END AS role, event_type AS content,
  list({'role': CASE WHEN event_type = 'click' THEN 'assistant' WHEN event_type = 'view' THEN 'user' ELSE event_type END, 'content': event_type}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS history FROM events)"""


def _turns(spark, d):
    """Events as turns, each with the five before it; some have a role that is neither's."""
    role = F.when(F.col("event_type") == "click", "assistant").when(F.col("event_type") == "view", "user").otherwise(F.col("event_type"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, -1)
    return table(spark, d, "events").withColumn("history", F.collect_list(F.struct(role.alias("role"), F.col("event_type").alias("content"))).over(w))


@query(f"WITH {TURNS} SELECT event_id, array_to_string(list_transform(history[-3:], lambda t: CASE WHEN t.role = 'assistant' THEN 'Assistant: ' ELSE 'User: ' END || t.content), chr(10)) AS lines, array_to_string(list_transform(history[-3:], lambda t: CASE WHEN t.role = 'assistant' THEN 'assistant' ELSE 'user' END), ',') AS roles FROM turns WHERE history IS NOT NULL")
def history_messages(spark, d):
    t = _turns(spark, d).where(F.size("history") > 0)
    return t.select("event_id", C.history_lines(F.col("history")).alias("lines"), F.array_join(F.transform(C.history_messages(F.col("history")), lambda m: m["role"]), ",").alias("roles"))


CONTEXT = f"""ctx AS (SELECT query_id, '{C.CONTEXT_BEGIN}' || chr(10) || left(string_agg('[' || n || '] ' || coalesce(title, '') || ' (' || coalesce(page_type, '') || ') — ' || coalesce(url, '') || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n), 8000) || chr(10) || '{C.CONTEXT_END}' AS context,
  arg_min(title, ord) AS question FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS n FROM hits) GROUP BY query_id)"""


@query(f"WITH {CONTEXT} SELECT query_id, '{C.MESSAGE[0]}' || chr(10) || context || chr(10) || '{C.MESSAGE[1]}' || chr(10) || chr(10) || '{C.MESSAGE[2]}' || chr(10) || question AS message FROM ctx WHERE question IS NOT NULL")
def user_messages(spark, d):
    h = table(spark, d, "hits").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "page_type", "url", "text"))).alias("c"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("ord"))).alias("question"))
    return h.where("question is not null").select("query_id", C.user_message(F.col("question"), C.context_block(F.col("c"))).alias("message"))


@query(f"SELECT id, coalesce(len(chunks) = 0 OR starts_with(answer, '{C.DECLINE[:30].replace(chr(39), chr(39) * 2)}') OR (contains(lower(answer), 'don''t have information') AND length(answer) < {len(C.DECLINE) + 50}), false) AS declined FROM (SELECT DISTINCT id, answer, chunks FROM feedback WHERE answer IS NOT NULL AND chunks IS NOT NULL)")
def declined_answers(spark, d):
    f = table(spark, d, "feedback").where("answer is not null and chunks is not null").select("id", "answer", "chunks").distinct()
    return f.select("id", C.is_decline(F.col("answer"), F.size("chunks"), C.DECLINE).alias("declined"))


# --- streams

BREAKS = r"[\n\r\x{000b}\x{000c}\x{001c}-\x{001e}\x{0085}\x{2028}\x{2029}]"
FOLDED = rf"""lines AS (SELECT id, i, trim(regexp_replace(parts[i], '{WS}+', ' ', 'g')) AS line, len(parts) AS n, parts[len(parts)] AS tail FROM (
  SELECT id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT id, string_split_regex(replace(answer, chr(13) || chr(10), chr(10)), '{BREAKS}') AS parts FROM (SELECT DISTINCT id, answer FROM feedback WHERE answer IS NOT NULL)))),
whole AS (SELECT id, string_agg(CASE WHEN line = '' THEN chr(10) ELSE line || ' ' END, '' ORDER BY i) AS t FROM lines WHERE NOT (i = n AND tail = '') GROUP BY id)"""


@query(f"WITH {FOLDED} SELECT f.id, coalesce(left(t, length(t) - 1), '') AS answer, 'primary' AS model, 3 AS chunks_used, 1 AS sources FROM (SELECT DISTINCT id, answer FROM feedback WHERE answer IS NOT NULL) f LEFT JOIN whole USING (id)")
def folded_replies(spark, d):
    """Answers streamed as events and folded again by the client."""
    f = _feedback_answers(spark, d)
    stream = C.chat_events(F.col("answer"), F.array(F.lit("https://a.example/")), F.lit(False), F.lit("primary"), F.lit(3))
    # events are made before they are folded
    made = f.select("id", stream.alias("events")).select("id", C.folded_events(F.col("events")).alias("r"))
    return made.select("id", "r.answer", "r.model", "r.chunks_used", F.size("r.sources").alias("sources"))


def _feedback_answers(spark, d):
    return table(spark, d, "feedback").where("answer is not null").select("id", "answer").distinct()


@query(f"WITH {FOLDED.replace('DISTINCT id, answer FROM feedback WHERE answer IS NOT NULL', 'DISTINCT id, answer FROM feedback WHERE answer IS NOT NULL')} SELECT id, 'sources,' || CASE WHEN declined THEN 'lead_suggestion,' ELSE '' END || 'done' AS tail FROM (SELECT DISTINCT id, coalesce(starts_with(answer, 'I'), false) AS declined FROM feedback WHERE answer IS NOT NULL)")
def reply_events(spark, d):
    """The kinds of events after the answer's tokens; answers that begin with I stand for declined ones."""
    f = _feedback_answers(spark, d)
    stream = C.chat_events(F.col("answer"), F.array(F.lit("https://a.example/")), F.col("answer").startswith("I"), F.lit("primary"), F.lit(3))
    kinds = F.transform(F.filter(stream, lambda e: e["event"] != "answer"), lambda e: e["event"])
    return f.select("id", F.array_join(kinds, ",").alias("tail"))


@query("SELECT event_id, event_type AS event, value::VARCHAR AS data FROM (SELECT event_id, event_type, CAST(event_id % 7 AS INT) AS value FROM events)")
def parsed_events(spark, d):
    """Each event written as a server-sent one and parsed."""
    e = table(spark, d, "events")
    body = C.sse(F.col("event_type"), (F.col("event_id") % 7).cast("string"))
    return e.select("event_id", F.explode(C.sse_events(F.concat(body, F.lit("event: open\ndata: 1")))).alias("e")).select("event_id", "e.event", "e.data")


@query("SELECT DISTINCT url, left(regexp_replace(url, '(?i)^https?://', ''), 30) AS caption FROM hits WHERE regexp_matches(url, '(?i)^https?://')")
def source_captions(spark, d):
    return table(spark, d, "hits").where(U.http_only(F.col("url"))).select("url", U.source_caption(F.col("url")).alias("caption")).distinct()


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (event_type IN ('view', 'signup')) AS last_user, arg_max(event_type, (ts, event_id)) FILTER (event_type IN ('click', 'purchase')) AS last_assistant FROM events GROUP BY user_id""")
def last_messages(spark, d):
    """Views and signups stand for the user's messages, the others for the assistant's, of which errors don't count."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("text"), F.when(F.col("event_type").isin("view", "signup"), "user").otherwise("assistant").alias("role"), (F.col("event_type") == "error").alias("error"))
    return state.last_messages(e, "user_id", ["ts", "event_id"])


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 50")
def kept_messages(spark, d):
    return state.keep_last(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id")


# --- state

VALID_FEEDBACK = """coalesce(length(question) BETWEEN 1 AND 5000 AND length(answer) BETWEEN 1 AND 50000 AND thumbs_up IS NOT NULL AND (reason IS NULL OR length(reason) <= 2000)
  AND (chunks IS NULL OR (len(chunks) <= 50 AND len(list_filter(chunks, lambda c: NOT coalesce(length(c.chunk_id) <= 200 AND length(c.url) <= 2048 AND c.score BETWEEN 0 AND 1, false))) = 0)), false)"""


@query(f"SELECT DISTINCT id, {VALID_FEEDBACK} AS valid FROM feedback")
def feedback_validation(spark, d):
    f = table(spark, d, "feedback")
    return f.select("id", state.valid_feedback().alias("valid")).distinct()


@query("SELECT event_id, coalesce(history IS NULL OR len(list_filter(history, lambda t: t.role NOT IN ('user', 'assistant'))) = 0, false) AS valid FROM (" + "WITH " + TURNS + " SELECT event_id, history FROM turns)")
def chat_validation(spark, d):
    return _turns(spark, d).withColumn("question", F.col("event_type")).select("event_id", state.valid_chat().alias("valid"))


def _first(items):
    """A record sent twice is stored as it came first."""
    return items.groupBy("pk").agg(F.min(F.struct("created_at", "type", "data")).alias("i")).select("pk", "i.type", "i.data", "i.created_at")


def _stored(spark, d):
    """Feedback, leads and gaps appended to one table and read again."""
    path = f"{pages.staging(spark)}/items"
    key = {"key": F.col("id"), "at": F.col("created_at")}
    state.append_items(state.feedback_items(table(spark, d, "feedback"), **key).transform(_first), path)
    state.append_items(state.lead_items(table(spark, d, "leads"), **key).transform(_first), path)
    f = _feedback(spark, d)
    declined = f.withColumn("is_decline", C.is_decline(F.col("answer"), F.lit(1), C.DECLINE) | ~T.has_content(F.col("answer"))).withColumn("rewritten_query", F.lower("question"))
    state.append_items(state.gap_items(declined, **key), path)
    return spark.read.schema(state.ITEM).parquet(path)


VALID_LEAD = "coalesce(length(name) BETWEEN 1 AND 200 AND regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AND length(question) BETWEEN 1 AND 5000 AND (phone IS NULL OR length(phone) <= 50) AND (message IS NULL OR length(message) <= 5000), false)"
GAPS = f"(SELECT id, question, created_at FROM {ONCE} WHERE coalesce(regexp_replace(answer, '{WS}', '', 'g'), '') = '' OR starts_with(answer, '{C.DECLINE[:30].replace(chr(39), chr(39) * 2)}') OR (contains(lower(answer), 'don''t have information') AND length(answer) < {len(C.DECLINE) + 50}))"


@query(f"""SELECT 'FEEDBACK#' || id AS pk, 'feedback' AS type, question, created_at FROM (SELECT id, arg_min(question, created_at) AS question, min(created_at) AS created_at FROM feedback WHERE {VALID_FEEDBACK} GROUP BY id)
UNION ALL SELECT 'LEAD#' || id, 'lead', question, created_at FROM (SELECT id, arg_min(question, created_at) AS question, min(created_at) AS created_at FROM leads WHERE {VALID_LEAD} GROUP BY id)
UNION ALL SELECT 'GAP#' || id, 'gap', question, created_at FROM {GAPS}""")
def state_items(spark, d):
    return _stored(spark, d).select("pk", "type", F.get_json_object("data", "$.question").alias("question"), "created_at")


@query(f"SELECT 'GAP#' || id AS pk, question, lower(question) AS rewritten_query, created_at FROM {GAPS} ORDER BY created_at DESC, pk LIMIT 20")
def recent_gaps(spark, d):
    """A report of the newest twenty."""
    return state.listed_gaps(_stored(spark, d))


KEY = "md5(lower(trim(question, e' \\t\\n\\r' || chr(160))))"
THEN = "TIMESTAMPTZ '2025-02-01 00:00:00+00'"


@query(f"""WITH {Q.CACHE}, live AS (SELECT key, data FROM cache WHERE expires_at >= {THEN}),
r AS (SELECT id, question, answer, {KEY} AS key FROM (SELECT id, question, arg_max(answer, created_at) AS answer FROM {ONCE} GROUP BY ALL))
SELECT r.id, r.key, coalesce(live.data, r.answer) AS answer, live.data IS NOT NULL AS hit FROM r LEFT JOIN live ON live.key = r.key""")
def cache_aside(spark, d):
    """Every question of the feedback asked again at one time: answered from the cache, else anew (here with the answer it got)."""
    f = _feedback(spark, d)
    now = F.lit("2025-02-01 00:00:00").cast("timestamp")
    requests = f.groupBy("id", "question").agg(F.max_by("answer", F.when(F.col("answer").isNotNull(), F.col("created_at"))).alias("given"))
    cache = state.cache_put(f.select("id", "question", "answer", "created_at").distinct())
    answer = lambda missed: missed.select("id", F.col("given").alias("answer"), C.is_decline(F.coalesce("given", F.lit("")), F.lit(1), C.DECLINE).alias("is_decline"))
    return state.cache_aside(requests, cache, now, answer)[0].select("id", "key", "answer", "hit")


# --- retrieval


@query("SELECT query_id, ord, CAST(rank AS INT) AS rank FROM (SELECT query_id, ord, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, ord) AS rank FROM hits) WHERE rank <= 3")
def reranked_hits(spark, d):
    h = table(spark, d, "hits").withColumn("rank", F.col("ord"))
    return retrieval.rerank(h, 3, F.coalesce("score", F.lit(float("-inf")))).select("query_id", "ord", "rank")


@query(f"SELECT h.query_id, h.ord, round({Q.COS.format('h.vector', 'c.vector')}, 6) AS cosine FROM hits h JOIN (SELECT chunk_id, arg_max(vector, content_hash) AS vector FROM chunks WHERE vector IS NOT NULL AND content_hash IS NOT NULL GROUP BY chunk_id) c ON c.chunk_id = h.chunk_id WHERE h.vector IS NOT NULL AND NOT list_bool_or([isnan(x) FOR x IN c.vector]) AND NOT list_bool_or([isnan(x) FOR x IN h.vector])")
def hit_cosines(spark, d):
    c = table(spark, d, "chunks").where("vector is not null and content_hash is not null").groupBy("chunk_id").agg(F.max_by("vector", "content_hash").alias("stored"))
    whole = lambda v: ~F.exists(v, lambda x: F.isnan(x))
    h = table(spark, d, "hits").where("vector is not null").join(c, "chunk_id").where(whole("vector") & whole("stored"))
    return h.select("query_id", "ord", F.round(T.cosine(F.col("vector"), F.col("stored")), 6).alias("cosine"))


def _pipeline(spark, d) -> answering.Pipeline:
    """A primary table that was never built and a standby that was: the standby answers."""
    chunks, _ = Q._searchable(spark, d)
    path = pages.staging(spark)
    standby = ann.SearchIndex(spark, f"{path}/standby")
    standby.build(chunks.withColumn("vector", retrieval.hash_embedding(F.col("text"))))
    one = ("hash", 64, answering.hashed)
    return answering.Pipeline([ann.SearchIndex(spark, f"{path}/primary"), standby], [one, one])


def _asked(spark, d):
    none = F.array().cast("array<struct<role:string,content:string>>")
    return table(spark, d, "hits").where("title is not null").groupBy("query_id").agg(F.min_by("title", "ord").alias("question")).withColumn("history", none)


@query()
def answers(spark, d):
    """Every query's question answered from the index; tested against its parts."""
    return _pipeline(spark, d).answers(_asked(spark, d)).drop("sources")


@query()
def answer_events(spark, d):
    """The answers as the streams their clients get."""
    return answering.events(_pipeline(spark, d).answers(_asked(spark, d)))
