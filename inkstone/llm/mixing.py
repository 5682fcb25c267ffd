"""Mixing sources to target weights (problem 8), by weighted fair queueing.

Within a source the documents stand in a seeded shuffle; a document's virtual finish time is the
source's token total up to and including it, divided by the source's weight. Repeats follow as
further rounds through the source. All sources are then merged in order of finish time and cut at
the total budget. Running totals are taken in two levels (buckets of the order, then rows within a
bucket), so that no source, however large, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions.sizes import broadcast_if_small
from inkstone.llm.bpe import DEFAULT_VOCABULARY, count_tokens
from inkstone.session import cut

#: Documents a bucket of an order has on average; running totals are taken bucket by bucket, so their number grows with the corpus.
BUCKET_ROWS = 20_000
#: Most sources that the driver may hold; the table of targets is checked against it.
MAX_SOURCES = 100_000


def source_key(source: Column) -> Column:
    """One spelling per source: trimmed, lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, total: str) -> DataFrame:
    """Inclusive running total of ``value`` along ``bucket`` then ``order`` within ``group``."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(broadcast_if_small(starts), [*group, bucket])
    return joined.withColumn(total, F.col("_start") + F.sum(value).over(within)).drop("_start")


def feasible(sizes: list[tuple[float, int, int]]) -> float:
    """Largest total that sources ``(weight, tokens, max_repeats)`` can make up in exact proportion."""
    return min((tokens * repeats / weight for weight, tokens, repeats in sizes), default=0.0)


def virtual_end(sizes: list[tuple[float, int, int]], budget: float) -> float:
    """Virtual time at which the merged queue has served ``budget`` tokens; exhausted sources stop."""
    ends = sorted((tokens * repeats / weight, weight) for weight, tokens, repeats in sizes)
    served, now, rate = 0.0, 0.0, sum(w for _, w in ends)
    for end, weight in ends:
        if served + (end - now) * rate >= budget:
            return now + (budget - served) / rate
        served, now, rate = served + (end - now) * rate, end, rate - weight
    return now


def mix_sources(docs: DataFrame, targets: DataFrame, key: str = "doc_id", total_budget: int | None = None, seed: int = 7, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The selection: ``key, source, round, tokens, finish, running_tokens``.

    ``docs`` has ``key, text, source``; ``targets`` has ``source, target_share, max_repeats``. Source
    names are compared through ``source_key``. Sources without tokens cannot contribute: the shares
    of the rest are scaled to add up to 1. Documents of null or unlisted sources, without text or of
    zero tokens, and targets that are null, not positive or without repeats take no part; repeated
    rows of a key count once, repeated targets by their largest share. Without ``total_budget`` the
    total is the largest at which every source reaches its share within its repeats; a larger one
    lets exhausted sources fall short, which ``mix_report`` shows. Empty tables give no rows.
    """
    wanted = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    wanted = wanted.where((F.col("source") != "") & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    wanted = wanted.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max_by("max_repeats", "target_share").alias("max_repeats"))
    named = docs.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, "text", source_key(F.col("source")).alias("source"))
    named = named.join(broadcast_if_small(wanted.select("source")), "source", "left_semi").select(key, "source", "text")
    counted = count_tokens(named, [key, "source"], vocabulary=vocabulary).where("tokens > 0")
    counted = cut(counted.groupBy(key).agg(F.min("source").alias("source"), F.max("tokens").alias("tokens")))
    sizes = counted.groupBy("source").agg(F.sum("tokens").alias("source_tokens")).join(wanted, "source")
    rows = sizes.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    # every source may be one bucket's worth or nearly all; the number is that of the whole corpus for all of them
    buckets = max(8, -(-counted.count() // BUCKET_ROWS))
    whole = sum(r["target_share"] for r in rows) or 1.0
    table = [(r["target_share"] / whole, r["source_tokens"], r["max_repeats"]) for r in rows]
    budget = float(total_budget) if total_budget is not None else feasible(table)
    end = virtual_end(table, budget)

    shuffled = counted.withColumn("_h", F.xxhash64(F.lit(seed), key)).withColumn("_b", F.floor((F.col("_h").cast("double") / F.lit(2.0**64) + 0.5) * buckets))
    shuffled = running_total(shuffled, ["source"], "_b", ["_h", key], "tokens", "_cum")
    shares = sizes.select("source", (F.col("target_share") / F.lit(whole)).alias("weight"), "source_tokens", "max_repeats")
    queued = shuffled.join(broadcast_if_small(shares), "source")
    rounds = F.ceil(F.least(F.col("max_repeats").cast("double"), F.lit(end) * F.col("weight") / F.col("source_tokens") + 1)).cast("int")
    queued = queued.withColumn("round", F.explode(F.sequence(F.lit(0), rounds - 1)))
    queued = queued.where(F.col("round") < F.col("max_repeats"))
    queued = queued.withColumn("finish", (F.col("round") * F.col("source_tokens") + F.col("_cum")) / F.col("weight"))
    queued = queued.where(F.col("finish") <= F.lit(end * (1 + 1e-12)))
    queued = cut(queued.select(key, "source", "round", "tokens", "finish", F.floor(F.col("finish") / F.lit(end or 1.0) * F.lit(buckets)).alias("_q")))
    merged = running_total(queued, [], "_q", ["finish", "source", key], "tokens", "running_tokens")
    return merged.where(F.col("running_tokens") <= F.lit(budget + 0.5)).drop("_q", "_b")


def mix_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares reached: one row per wanted source, also for those that contribute nothing."""
    used = mix.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("records"), (F.max("round") + 1).alias("repeats"))
    total = used.agg(F.sum("tokens").alias("total")).first()["total"]
    wanted = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    out = wanted.join(used, "source", "left").withColumn("total", F.lit(total).cast("bigint"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("source", "target_share", "max_repeats", zero("records").alias("records"), zero("repeats").alias("repeats"), zero("tokens").alias("tokens"), F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("share"))
