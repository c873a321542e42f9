"""Lookups and enrichment (survey J1-J8, S7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acequia.operators.aggregate import cap
from acequia.operators.dedup import first_seen, refused
from acequia.session import broadcast_if_small, settle


def detail_lookup(rows: DataFrame, details: DataFrame, key: str, n: int, order: str) -> DataFrame:
    """The details of the first n rows; rows without one drop out."""
    return cap(rows, n, order).join(details, key)


def complements(rows: DataFrame, details: DataFrame, key: str, n: int, order: str) -> DataFrame:
    """Cap first, then distinct keys, then the lookup, all rows kept."""
    capped = first_seen(cap(rows, n, order).where(F.coalesce(F.col(key).cast("string"), F.lit("")) != ""), F.col(key).cast("string"), order)
    return capped.join(details, key, "left")


def text_enrich(rows: DataFrame, texts: DataFrame, key: str, n: int, order: str, category: str = "category", overwrite_blank: bool = True) -> DataFrame:
    """text_ocr of the first n rows of each category from a table (key, text).

    A looked-up '' overwrites, as a failed reading does; pass False to keep the old text.
    """
    from pyspark.sql import window as W

    # only the places move, cut to n a category before the shuffle; all rows stay where they are
    place = F.row_number().over(W.Window.partitionBy("_c").orderBy("_o"))
    slim = rows.select(F.col(category).alias("_c"), F.col(order).alias("_o"), F.col(key).alias("_k"))
    first = slim.withColumn("_r", place).where(F.col("_r") <= n)
    t = texts.groupBy(F.col(key).alias("_k")).agg(F.first("text").alias("_new"))
    new = F.col("_new") if overwrite_blank else F.nullif(F.col("_new"), F.lit(""))
    found = t.join(broadcast_if_small(first), "_k").where(new.isNotNull()).select("_c", "_o", "_new")
    same = F.expr(f"`{category}` <=> _c") & (F.col(order) == F.col("_o"))
    return rows.join(broadcast_if_small(found), same, "left").withColumn("text_ocr", F.coalesce(new, F.col("text_ocr"))).drop("_c", "_o", "_new")


def fan_out(searches: DataFrame, posts: DataFrame, n: int, order: str) -> DataFrame:
    """The first n distinct slugs of each search with all their posts."""
    from pyspark.sql import window as W

    first = first_seen(searches.where("slug <> ''"), F.concat_ws("\x01", "search", "slug"), order)
    top = first.withColumn("_r", F.row_number().over(W.Window.partitionBy("search").orderBy(order))).where(F.col("_r") <= n).drop("_r")
    return top.join(posts, "slug")


def not_contained(rows: DataFrame, others: DataFrame, name: str, other: str) -> DataFrame:
    """The static part of J5: rows whose name neither holds nor is held by any of ``others``.

    Distinct names meet, not rows; the empty name is held by every name. A theta join while
    ``others`` is small enough to broadcast, else by their rarest pieces (``holding``).
    """
    a = rows.select(F.col(name).alias("_a")).distinct()
    b = others.select(F.col(other).alias("_b")).distinct().where("_b is not null")
    small = broadcast_if_small(b)
    if small is not b:
        free = a.join(small, F.col("_a").contains(F.col("_b")) | F.col("_b").contains(F.col("_a")), "left_anti")
    else:
        both = a.where("_a is not null").select(F.col("_a").alias("t"), F.lit(0).alias("s")).unionByName(b.select(F.col("_b").alias("t"), F.lit(1).alias("s")))
        marked = settle(both.groupBy("t").agg(F.min("s").alias("s")), "j5-both")
        pairs = holding(marked.select("t", "s"))
        known = b.withColumnRenamed("_b", "t")
        up = pairs.select(F.col("big").alias("_a"), F.col("small").alias("t")).join(known, "t", "left_semi")
        down = pairs.select(F.col("small").alias("_a"), F.col("big").alias("t")).join(known, "t", "left_semi")
        held = up.select("_a").unionByName(down.select("_a")).unionByName(known.select(F.col("t").alias("_a"))).distinct()
        free = a.join(held, "_a", "left_anti")
    return rows.join(free, F.col(name) == F.col("_a")).drop("_a")


#: Length of the pieces by which names that hold each other are found.
GRAM = 3


def holding(names: DataFrame) -> DataFrame:
    """(big, bs, small, ss) for distinct names (t, s): each that holds another, lossless.

    A name holds another only if it has that one's rarest piece of GRAM letters. Names
    shorter than a piece meet all others.
    """
    cut = F.expr(f"array_distinct(transform(sequence(1, length(t) - {GRAM - 1}), i -> substring(t, i, {GRAM})))")
    grams = settle(names.where(F.length("t") >= GRAM).select("t", "s", F.explode(cut).alias("gram")), "j5-grams")
    df = grams.groupBy("gram").agg(F.count("*").alias("df"))
    rarest = grams.join(df, "gram").groupBy("t", "s").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"))
    small = rarest.select(F.col("t").alias("small"), F.col("s").alias("ss"), "gram")
    big = grams.select(F.col("t").alias("big"), F.col("s").alias("bs"), "gram")
    long = big.join(small, "gram").select("big", "bs", "small", "ss")
    short = names.where(F.length("t") < GRAM).select(F.col("t").alias("small"), F.col("s").alias("ss"))
    brief = names.select(F.col("t").alias("big"), F.col("s").alias("bs")).crossJoin(short)
    return long.unionByName(brief).where((F.col("big") != F.col("small")) & F.col("big").contains(F.col("small")))


def references_added(people: DataFrame, references: DataFrame, name: str = "name", order: str = "ingest_seq") -> DataFrame:
    """The references that join the parsed people, taken in order of arrival.

    A reference is added if its name neither holds nor is held by a parsed name or by an
    earlier reference that was added. A missing name is empty, which every name holds.
    """
    said = references.withColumn("_t", F.coalesce(name, F.lit("")))
    texts = said.groupBy("_t").agg(F.min(F.col(order).cast("bigint")).alias("s")).withColumnRenamed("_t", "t")
    parsed = people.select(F.coalesce(name, F.lit("")).alias("t")).distinct()
    fresh = settle(texts.join(parsed, "t", "left_anti"), "j5-fresh")
    pairs = holding(settle(parsed.withColumn("s", F.lit(None).cast("bigint")).unionByName(fresh), "j5-names"))
    a = pairs.where("bs is not null and (ss is null or ss < bs)").selectExpr("big as late", "small as early", "bs as ls")
    b = pairs.where("ss is not null and (bs is null or bs < ss)").selectExpr("small as late", "big as early", "ss as ls")
    gone = refused(settle(a.unionByName(b), "j5-pairs")).withColumnRenamed("late", "t")
    first = fresh.join(gone, "t", "left_anti")
    return said.join(first, (F.col("_t") == F.col("t")) & (F.col(order) == F.col("s"))).drop("_t", "t", "s")


def keyword_hits(texts: DataFrame, key: str, text: str, keywords: DataFrame) -> DataFrame:
    """(key, keyword) for each keyword (a table kw) a text contains; for long lists."""
    k = broadcast_if_small(keywords.select("kw"))
    return texts.select(key, F.lower(F.col(text)).alias("_t")).join(k, F.expr("contains(_t, lower(kw))")).select(key, "kw")
