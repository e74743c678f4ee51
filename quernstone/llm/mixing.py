"""Mixing sources to target weights, by exact token counts.

1. Every text gets its length in tokens; copies of a text within a source are one text, which may be
   used ``max_repeats`` times in all, whether as rows or repeats.
2. The mixture's size is the largest at which every source can still give its share within its
   repeats; a source without texts, or too small for the common size, gives all it may, and its
   deficit is reported. ``total`` may ask for less.
3. Per source, the budget is filled exactly: whole rounds of all texts first, then a selection by
   length counts. How many texts there are of each length is all that is needed: most is taken of all
   lengths in proportion, and a bounded-knapsack dynamic program over length counts hits the rest as
   nearly as any subset can.
4. Among texts of one length, a seeded hash decides. Texts of a length are counted by the hash's first
   bits; only those of the bits in which the choice ends are ranked, so no length is gathered in a task.

Only (source, length, count) of the target sources reaches the driver, in columns: a row for each length
that occurs, of which a source has no more than its longest text has tokens. Null and empty texts have no
tokens and are never chosen. Sources are compared trimmed and in lower case. Sources without target
are left out. Empty tables give empty results. ``documents`` columns other than doc_id, source and
text aren't read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.llm.encoding import encode_corpus
from quernstone.runtime import cut, kept, table

SEED = 17
KNAPSACK = 1 << 16  # tokens of the budget that the dynamic program fits at first
PLACES = 10  # bits of the seeded hash by which texts of one length are ranked without being gathered


def spelled(col: Column) -> Column:
    """Source names without case and with separators as hyphens."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s_]+", "-")


def fill(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many texts of each length to take so that their sum comes as near to the budget, from below, as any choice can.

    Most of the budget is taken from all lengths in proportion, so that the choice keeps the
    source's mix of lengths; a bounded-knapsack program fits the rest. No sum can pass the greatest multiple of
    the lengths' common divisor within the budget: if the program misses that, it gets a larger part of the
    budget, in the end all of it.
    """
    if budget >= sum(n * c for n, c in counts.items()):
        return dict(counts)
    divisor = math.gcd(*(n for n, c in counts.items() if c)) or 1
    part = KNAPSACK
    while True:
        taken = _fill(counts, budget, part)
        if part >= budget or sum(n * c for n, c in taken.items()) == budget - budget % divisor:
            return taken
        part *= 8


def _fill(counts: dict[int, int], budget: int, part: int) -> dict[int, int]:
    """A choice whose last ``part`` tokens are fitted exactly."""
    total = sum(n * c for n, c in counts.items())
    rest_want = min(budget, part)
    share = max(0, budget - rest_want) / total if total else 0
    taken = {n: int(c * share) for n, c in counts.items()}
    rest = budget - sum(n * c for n, c in taken.items())
    left = {n: c - taken[n] for n, c in counts.items() if c > taken[n] and n <= rest}
    # what the program may fit is bounded: beyond it, longest first
    for n in sorted(left, reverse=True):
        if rest <= part:
            break
        k = min(left[n], (rest - part) // n)
        taken[n] += k
        left[n] -= k
        rest -= n * k
    items = []
    for n in sorted(left):
        c, k = min(left[n], rest // n), 1
        while c > 0:
            k = min(k, c)
            items.append((n * k, n, k))
            c -= k
            k *= 2
    reach = np.zeros(rest + 1, bool)
    reach[0] = True
    first = np.full(rest + 1, -1, np.int32)  # the item that first reached a sum
    for j, (w, _, _) in enumerate(items):
        if w > rest:
            continue
        new = np.zeros(rest + 1, bool)
        new[w:] = reach[:-w] & ~reach[w:]
        first[new] = j
        reach |= new
        if reach[rest]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at > 0:
        w, n, k = items[first[at]]
        taken[n] += k
        at -= w
    return {n: c for n, c in taken.items() if c}


@dataclass
class Plan:
    """Per source: whole rounds of its texts, and (length, count) of the last, partial one."""

    budget: dict[str, int]
    rounds: dict[str, int]
    partial: dict[str, dict[int, int]]
    total: int


def plan_mixture(lengths: dict[str, dict[int, int]], targets: dict[str, tuple[float, int]], total: int | None = None) -> Plan:
    sizes = {s: sum(n * c for n, c in lengths.get(s, {}).items()) for s in targets}
    room = {s: sizes[s] * max(0, r) for s, (_, r) in targets.items()}
    alive = [s for s, (w, _) in targets.items() if room[s] and w > 0]
    most = min((room[s] / targets[s][0] for s in alive), default=0)
    whole = int(most) if total is None else total
    budget, rounds, partial = {}, {}, {}
    for s, (w, repeats) in targets.items():
        budget[s] = min(room[s], round(whole * w))
        rounds[s] = min(repeats, budget[s] // sizes[s]) if sizes[s] else 0
        left = budget[s] - rounds[s] * sizes[s]
        partial[s] = fill(lengths.get(s, {}), left) if left and rounds[s] < repeats else {}
    return Plan(budget, rounds, partial, whole)


def mixture(docs: DataFrame, targets: DataFrame, total: int | None = None, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, times) of every chosen text, and the report per target source."""
    spark = docs.sparkSession
    goal = {r.s: (float(r.w), int(r.m)) for r in targets.where("source is not null and target_share is not null").groupBy(spelled(F.col("source")).alias("s")).agg(F.sum("target_share").alias("w"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("m")).collect()}
    wanted = spark.createDataFrame([(s,) for s in goal] or [("",)], "source string")
    rows = docs.where(F.length("text") > 0).select("doc_id", spelled(F.col("source")).alias("source"), "text").join(F.broadcast(wanted), "source", "left_semi")
    # a text is one item of its source, whatever the number of its copies: its smallest id stands for it
    digest = F.sha2("text", 256)
    one = rows.groupBy("source", digest.alias("digest")).agg(F.min("doc_id").alias("doc_id")).select("source", "doc_id")
    n = counts if counts is not None else encode_corpus(rows, counts_only=True)
    items = cut(one.join(n.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")), "doc_id").where("n_tokens > 0").select("source", "doc_id", "n_tokens"))
    hist = items.groupBy("source", "n_tokens").count().toPandas()
    lengths: dict[str, dict[int, int]] = {s: dict(zip(part["n_tokens"].tolist(), part["count"].tolist())) for s, part in hist.groupby("source")}
    p = plan_mixture(lengths, goal, total)
    take = spark.createDataFrame([(s, n_, c) for s, part in p.partial.items() for n_, c in part.items()] or [("", 0, 0)], "source string, n_tokens int, more int")
    rounds = spark.createDataFrame([(s, r) for s, r in p.rounds.items()] or [("", 0)], "source string, rounds int")
    # the first of each length by seeded hash: whole ranges of it, and in the range where the choice ends row by row
    mark = F.xxhash64(F.lit(SEED), "doc_id")
    partial = items.join(take, ["source", "n_tokens"]).withColumn("mark", mark).withColumn("place", F.shiftright("mark", 64 - PLACES))
    by = Window.partitionBy("source", "n_tokens").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    places = partial.groupBy("source", "n_tokens", "place").agg(F.count("*").alias("here"), F.first("more").alias("more")).withColumn("before", F.coalesce(F.sum("here").over(by), F.lit(0))).where("before < more")
    near = partial.drop("more").join(places, ["source", "n_tokens", "place"])
    whole = near.where("before + here <= more").select("source", "doc_id")
    w = Window.partitionBy("source", "n_tokens", "place").orderBy("mark", "doc_id")
    last = near.where("before + here > more").withColumn("nth", F.row_number().over(w)).where("before + nth <= more").select("source", "doc_id")
    extra = whole.unionByName(last).withColumn("extra", F.lit(1))
    chosen = items.join(F.broadcast(rounds), "source").join(extra, ["source", "doc_id"], "left").withColumn("times", F.col("rounds") + F.coalesce("extra", F.lit(0))).where("times > 0").select("doc_id", "source", "n_tokens", "times")
    used = kept(chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.count("*").alias("texts"), F.max("times").alias("most_times")))
    goals = spark.createDataFrame([(s, w_, m, p.budget[s]) for s, (w_, m) in goal.items()] or [], "source string, target_share double, max_repeats int, budget long")
    report = goals.join(used, "source", "left").select("source", "target_share", "max_repeats", "budget", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_times", F.lit(0)).alias("most_times"))
    every = Window.partitionBy()
    report = report.withColumn("actual_share", F.col("tokens") / F.greatest(F.sum("tokens").over(every), F.lit(1)))
    return chosen, report


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_mix: the chosen texts and how often each is used."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_shares: target and actual share of each source."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]
