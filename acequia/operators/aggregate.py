"""Counts, rankings, caps, unions and differences (survey A1-A9, W1-W4, O1-O3, U1-U4, S2, S3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from acequia.session import broadcast_if_small

#: Places of the order whose texts one task joins.
JOIN_BLOCK = 1 << 14


def frequency(df: DataFrame, key: str, order: str, missing: str = "?", top: int | None = None) -> DataFrame:
    """A1, A2: rows per key, most first, ties by first sight; ``rank`` holds the order."""
    named = df.select(F.coalesce(F.col(key), F.lit(missing)).alias(key), F.col(order).alias("_o"))
    counted = named.groupBy(key).agg(F.count("*").alias("n"), F.min("_o").alias("first_seq"))
    return counted.orderBy(F.desc("n"), "first_seq").limit(top) if top else counted


def bucket_counts(df: DataFrame, key: str = "category") -> DataFrame:
    """A3: rows per bucket and, as bucket null, in all."""
    return df.rollup(key).agg(F.count("*").alias("n"))


def counts_by_type(df: DataFrame) -> DataFrame:
    """A4."""
    return df.agg(F.count_if(F.col("type") == "job").alias("jobs"), F.count_if(F.col("type") == "company").alias("companies"))


def joined_text(df: DataFrame, key: str, order: str, text: str, sep: str = "\n") -> DataFrame:
    """A group's texts in order (a number), joined.

    Joined block by block of the order first, so that a large group is sorted and joined by
    many tasks; the last one only puts the blocks' texts together.
    """
    ordered = lambda o, x: F.array_join(F.array_sort(F.collect_list(F.struct(o.alias("o"), x.alias("x"))))["x"], sep)
    said = df.where(F.col(text).isNotNull()).withColumn("_b", F.floor(F.col(order) / JOIN_BLOCK))
    blocks = said.groupBy(key, "_b").agg(ordered(F.col(order), F.col(text)).alias("_x"))
    joined = blocks.groupBy(key).agg(ordered(F.col("_b"), F.col("_x")).alias("joined"))
    empty = df.groupBy(key).agg(F.count(text).alias("_n")).where("_n = 0").select(key, F.lit("").alias("joined"))
    return joined.unionByName(empty)


def rolling_calls(df: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """Calls of a key in the last ``seconds`` up to each call, and the rate a minute."""
    secs = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.Window.partitionBy(key).orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    out = df.withColumn("_us", secs).withColumn("calls", F.count("*").over(w)).withColumn("_first", F.min("_us").over(w))
    span = (F.col("_us") - F.col("_first")) / 1e6
    rate = F.when((F.col("calls") >= 2) & (span > 0), F.col("calls") * 60.0 / F.greatest(span, F.lit(1.0))).otherwise(F.col("calls").cast("double"))
    return out.withColumn("per_minute", rate).drop("_us", "_first")


def call_counters(df: DataFrame, kind: str = "kind") -> DataFrame:
    """A8."""
    k = F.col(kind)
    return df.agg(F.count_if(k == "acquire").alias("total_calls"), F.count_if(k == "error").alias("total_errors"), F.count_if(k == "pause").alias("total_pauses"))


def top_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group (planned with a group limit before the shuffle)."""
    return df.withColumn("rank", F.row_number().over(W.Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def cap(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows; a cap comes before de-duplication."""
    return df.orderBy(order).limit(n)


def ranked(df: DataFrame, score: Column, order: str) -> DataFrame:
    """O1: a stable sort by score, most first."""
    return df.orderBy(score.desc(), F.col(order).asc())


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; missing columns are null; ``source_rank`` orders the frames."""
    ranked_ = [f.withColumn("source_rank", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked_)


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """U4: rows of a whose key isn't in b; repeated ones stay."""
    return a.join(b.select(key).distinct(), key, "left_anti")


def page_stop(df: DataFrame, scan: str, page: str, key: str, order: str) -> DataFrame:
    """Rows of the pages before the first one that brings nothing new.

    Keys are new where first seen in the scan; a page without new keys ends the scan.
    """
    # pages and keys are counted with map-side combine; the rows themselves don't move
    fresh = df.groupBy(scan, key).agg(F.min_by(page, order).alias("_p")).select(F.col(scan).alias("_s"), "_p").distinct()
    pages = df.select(F.col(scan).alias("_s"), F.col(page).alias("_p")).distinct()
    stale = pages.join(fresh, pages["_s"].eqNullSafe(fresh["_s"]) & pages["_p"].eqNullSafe(fresh["_p"]), "left_anti")
    stop = stale.groupBy("_s").agg(F.min("_p").alias("stop"))
    here = df.join(broadcast_if_small(stop), F.col(scan).eqNullSafe(F.col("_s")), "left")
    return here.where(F.col("stop").isNull() | (F.col(page) < F.col("stop"))).drop("stop", "_s")


def search_grid(places: DataFrame, keywords: DataFrame) -> DataFrame:
    """Every search, place by place; both lists are settings of bounded size."""
    return places.crossJoin(broadcast_if_small(keywords))


def first_attribution(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """S3: each key with the value of the row that saw it first."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(value), F.min(order).alias("first_seq"))
