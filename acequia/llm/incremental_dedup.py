"""New batches of postings checked against everything accepted before.

Identity of a posting: its number on its board. Numbers come from the id fields and from
the addresses in all their notations. A row without any number is identified by its
readable address (the slug), small deviations allowed, by content-defined chunking:

* a rolling hash over ``WINDOW`` characters puts a chunk boundary where it is 0 modulo
  ``DIVISOR``, so a deviation touches only the chunks around it;
* a persistent table holds the chunks (hash and bytes) of every accepted address;
* an exact check tells a deviation: equal tokens but for one long token with one edit (or
  two neighbours swapped) or a cut-off end. What it leaves equal (all tokens but one, or
  all but the end) is looked up, which is lossless and brings few other pairs;
* the bytes of the chunks that both addresses have over all bytes of the one without number
  is the coverage, and a pair has to reach ``COVERAGE`` too.

Addresses without number that deviate from each other are one posting (connected, however
long the chain), which is the earliest numbered one that any of them deviates from. Only
facts are stored (identities, chunks, near pairs), so the repeats over all accepted rows
are the same however the rows were cut into batches.

State (one folder per batch, in one folder of the shared file system): rows (seq,
number_key, slug_key), chunks (slug, owned, chunks), near (slug, match). A batch is written whole and
counts once its marker is there. It costs its own size plus the lookups; history isn't
chunked or compared again.

Defined results: rows without number and readable address have no posting and are never
repeats; null, empty, "None" and unreadable ids count as no number; an address that
several postings share belongs to the one seen first; repeated rows are repeats; a batch
accepted before under its name isn't accepted again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from acequia.session import broadcast_if_small, settle

WINDOW = 3
DIVISOR = 4
COVERAGE = 0.45
#: Low bits of a chunk that hold its bytes; the others are its hash.
SIZE_BITS = 20
SLACK = 3
#: A word that may hold an edit, and an address that may be cut off, have at least so many characters.
LONG, LEAST = 5, 12
#: Boards by host (fixed values); relative addresses belong to the first.
BOARDS = {"v": "vinculared.example", "t": "tablonlaboral.example"}
ADDRESSES = ("url", "job_url", "applyUrl")

ROWS = "seq bigint, number_key string, slug_key string"
CHUNKS = "slug string, owned boolean, chunks array<bigint>"
NEAR = "slug string, match string"
MARKER = "_ACCEPTED"


def _decoded(c: Column) -> Column:
    """Lower case, and the percent signs of an address carried by a redirect resolved."""
    low = F.nullif(F.lower(F.trim(c)), F.lit(""))
    return F.when(~low.contains("%"), low).otherwise(F.replace(F.replace(F.replace(low, F.lit("%3a"), F.lit(":")), F.lit("%2f"), F.lit("/")), F.lit("%3f"), F.lit("?")))


def _number_in_address(a: Column) -> Column:
    hit = F.regexp_extract(a, r"(?:(?:/view|/oferta|/apply)/(?:[^/?#]*-)?|[?&]currentjobid=)0*([1-9]\d{5,})(?:[/?#&]|$)", 1)
    return F.nullif(hit, F.lit(""))


def _number_in_id(c: Column) -> Column:
    hit = F.regexp_extract(F.lower(F.trim(c)), r"^(?:urn:[a-z:]+:|[a-z]+[-_:# ]?)?0*([1-9]\d*)(?:\.0+)?$", 1)
    return F.nullif(hit, F.lit(""))


def _board(a: Column) -> Column:
    host = F.regexp_extract(a, r"^(?:https?://)?([^/?#]+)", 1)
    named = F.coalesce(*[F.when(host.endswith(h), F.lit(b)) for b, h in BOARDS.items()])
    return F.coalesce(named, F.when(a.startswith("/"), F.lit("v")))


def _slug(a: Column) -> Column:
    """The readable part of an address, its connector and number taken out."""
    s = F.regexp_replace(F.regexp_extract(a, r"/view/([^/?#]+)", 1), r"-?\d{6,}$", "")
    s = F.translate(s, "áéíóúüñãõâêôàç", "aeiouunaoaeoac")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_extract(F.regexp_replace(s, "-(?:en|at|em)-", "-"), "^(?=.*[a-z].*-).*$", 0)


def identify(jobs: DataFrame, key: str = "ingest_seq") -> DataFrame:
    """(seq, number_key, slug_key): what a row says about its posting, or nulls."""
    said = jobs.select(
        F.col(key).alias("seq"),
        F.when(F.col("source") == "serper", F.lit("t")).otherwise(F.lit("v")).alias("home"),
        F.coalesce(_number_in_id(F.col("external_id")), F.col("jobId").cast("string")).alias("id"),
        *[_decoded(F.col(a)).alias(a) for a in ADDRESSES],
    )
    first = lambda f: F.coalesce(*[f(F.col(a)) for a in ADDRESSES])
    # a later address is looked at only where those before it say nothing
    named = said.select(
        "seq",
        F.coalesce(first(_board), F.col("home")).alias("board"),
        F.coalesce("id", first(_number_in_address)).alias("number"),
        first(lambda a: F.when(a.contains("/view/"), F.nullif(_slug(a), F.lit("")))).alias("slug"),
    )
    keyed = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(":", "board", c))
    return named.select("seq", keyed("number").alias("number_key"), keyed("slug").alias("slug_key"))


def chunks_of(slugs: DataFrame) -> DataFrame:
    """``slugs`` with the distinct content-defined chunks of each."""
    s = slugs.where("length(slug) > 0")
    cut = F.expr(f"filter(sequence(1, greatest(1, length(slug) - {WINDOW})), i -> pmod(xxhash64(substring(slug, i, {WINDOW})), {DIVISOR}) = 0)")
    bounds = F.array_distinct(F.concat(F.array(F.lit(0)), F.transform(cut, lambda i: i + WINDOW - 1), F.array(F.length("slug"))))
    # the generator keeps the bounds from being worked out again for every piece
    cuts = s.withColumn("b", F.explode(F.array(bounds)))
    piece = "substring(slug, b[i-1] + 1, b[i] - b[i-1])"
    chunk = F.expr(f"transform(sequence(1, size(b) - 1), i -> shiftleft(xxhash64({piece}), {SIZE_BITS}) | cast(b[i] - b[i-1] as bigint))")
    return cuts.withColumn("chunks", F.array_distinct(chunk)).drop("b")


def _bytes(chunk: str) -> str:
    return f"({chunk} & {(1 << SIZE_BITS) - 1})"


def same_address(a: str, b: str) -> bool:
    """Whether two addresses differ by a small deviation only (see the module's docstring)."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > SLACK:
        return False
    short, long = sorted((a, b), key=len)
    if long.startswith(short) and len(short) >= LEAST:
        return True
    x, y = a.split("-"), b.split("-")
    if len(x) != len(y):
        return False
    off = [(p, q) for p, q in zip(x, y) if p != q]
    if len(off) != 1:
        return False
    p, q = off[0]
    if min(len(p), len(q)) < LONG:
        return False
    return _one_edit(p, q)


def _one_edit(p: str, q: str) -> bool:
    if len(p) == len(q):
        d = [i for i in range(len(p)) if p[i] != q[i]]
        return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and p[d[0]] == q[d[1]] and p[d[1]] == q[d[0]])
    if abs(len(p) - len(q)) != 1:
        return False
    short, long = sorted((p, q), key=len)
    i = next((i for i, c in enumerate(short) if c != long[i]), len(short))
    return short[i:] == long[i + 1 :]


@F.pandas_udf(BooleanType())
def _confirmed(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_address(p, q) for p, q in zip(a, b)], dtype=bool)


def lookups(slugs: DataFrame, asked: bool) -> DataFrame:
    """(slug, key): keys that an asked and a known address share whenever ``same_address`` holds, but for equal ones.

    Either all words but a long one are equal, or one address is the other without its end.
    """
    # place i > 0 leaves a word out, i < 0 the last characters, 0 nothing; rows, since lambdas aren't compiled
    words = slugs.select("slug", F.explode(F.array(F.split("slug", "-"))).alias("t"))
    placed = words.select("slug", "t", F.explode(F.sequence(F.lit(-SLACK), F.size("t"))).alias("i"))
    placed = placed.where(f"case when i > 0 then length(get(t, i - 1)) >= {LONG} when i < 0 then length(slug) + i >= {LEAST} else true end")
    whole, ends = ("asked short", "asked long") if asked else ("asked long", "asked short")
    key = F.expr(
        f"case when i > 0 then xxhash64('word', concat_ws('-', slice(t, 1, greatest(i - 1, 0)), '*', slice(t, greatest(i, 0) + 1, size(t))))"
        f" when i < 0 then xxhash64('{ends}', substring(slug, 1, length(slug) + i)) else xxhash64('{whole}', slug) end"
    )
    return placed.select("slug", key.alias("key"))


def near_addresses(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(slug, match): known addresses that each asked one deviates little from.

    Both hold slug and chunks. Chunks alone are common (a role, a town), and the more
    addresses the more share one; so an address is looked up by what the exact check leaves
    equal, and the coverage by chunks is worked out for the few pairs that pass it. The
    asked ones (without number) are few; the known ones are streamed past them where the
    lookups are small enough to broadcast.
    """
    lookup = settle(lookups(asked, True), "p2-lookup")
    heads = lookups(known, False).withColumnRenamed("slug", "match")
    found = heads.join(broadcast_if_small(lookup), "key").where("slug <> match and left(slug, 2) = left(match, 2)")
    pairs = settle(found.select("slug", "match").distinct().where(_confirmed("slug", "match")), "p2-confirmed")
    few = broadcast_if_small(pairs)
    own = asked.join(broadcast_if_small(pairs.select("slug").distinct()), "slug", "left_semi").select("slug", F.col("chunks").alias("own"))
    both = known.select(F.col("slug").alias("match"), "chunks").join(few, "match").join(own, "slug")
    total = F.expr(f"aggregate(own, 0L, (n, x) -> n + {_bytes('x')})")
    shared = F.expr(f"aggregate(array_intersect(own, chunks), 0L, (n, x) -> n + {_bytes('x')})")
    return both.where(shared >= total * COVERAGE).select("slug", "match").distinct()


class PostingHistory:
    """The identities, chunks and near pairs of all accepted rows, in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def batches(self) -> list[str]:
        """Names of the accepted batches, in order."""
        p = self._jpath(f"{self.path}/*/{MARKER}")
        return sorted(x.getPath().getParent().getName() for x in p.getFileSystem(self._conf).globStatus(p) or [])

    def _read(self, name: str, schema: str, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{b}/{name}" for b in batches])

    def accept(self, batch: DataFrame, key: str = "ingest_seq", name: str | None = None) -> DataFrame:
        """(seq_a, seq_b): the batch's repeats as known now; stores the batch unless it is there."""
        rows = self._read("rows", ROWS, [self.add(batch, key, name)])
        return self.repeats().join(rows.select(F.col("seq").alias("seq_b")), "seq_b", "left_semi").select("seq_a", "seq_b")

    def add(self, batch: DataFrame, key: str = "ingest_seq", name: str | None = None) -> str:
        """Stores the batch unless it is there; gives its name."""
        before = self.batches()
        name = name or f"{len(before):08d}"
        if name not in before:
            self._store(batch, key, name, before)
        return name

    def _store(self, batch: DataFrame, key: str, name: str, before: list[str]) -> None:
        write = lambda df, part: df.write.mode("overwrite").parquet(f"{self.path}/{name}/{part}")
        write(identify(batch, key).where("number_key is not null or slug_key is not null"), "rows")
        rows = self._read("rows", ROWS, [name])
        said = rows.where("slug_key is not null").groupBy(F.col("slug_key").alias("slug")).agg(F.max(F.col("number_key").isNotNull()).alias("owned"))
        old = self._read("chunks", CHUNKS, before)
        if before:  # an address is chunked once, and comes again only with its first number
            had = old.groupBy("slug").agg(F.max("owned").alias("had"))
            said = said.join(had, "slug", "left").where("had is null or (owned and not had)").drop("had")
        write(chunks_of(said), "chunks")
        new = self._read("chunks", CHUNKS, [name])
        known = old.unionByName(new)
        open_slugs = lambda c: c.groupBy("slug").agg(F.max("owned").alias("owned"), F.first("chunks").alias("chunks")).where("not owned")
        near = near_addresses(open_slugs(new), known)
        if before:
            near = near.unionByName(near_addresses(open_slugs(old), new))
        write(near, "near")
        done = self._jpath(f"{self.path}/{name}/{MARKER}")
        done.getFileSystem(self._conf).create(done, True).close()

    def repeats(self) -> DataFrame:
        """(seq_a, seq_b): every accepted row whose posting is on an earlier one, with the first."""
        every = self.batches()
        rows, chunks = self._read("rows", ROWS, every), self._read("chunks", CHUNKS, every)
        bare = settle(
            chunks.groupBy("slug").agg(F.max("owned").alias("owned")).where("not owned").select("slug")
            .join(rows.where("number_key is null").groupBy(F.col("slug_key").alias("slug")).agg(F.min("seq").alias("first_seq")), "slug"), "p2-open",
        )
        near = settle(self._read("near", NEAR, every).distinct().join(bare.select("slug"), "slug", "left_semi"), "p2-edges")
        label = self._components(bare, near)
        # the earliest numbered posting that a component deviates from
        numbered = rows.where("number_key is not null")
        to_owned = near.join(bare.select(F.col("slug").alias("match")), "match", "left_anti")
        owners = numbered.where("slug_key is not null").select(F.col("slug_key").alias("match"), "number_key", "seq")
        owners = owners.join(broadcast_if_small(to_owned.select("match").distinct()), "match", "left_semi").groupBy("match").agg(F.min_by("number_key", "seq").alias("number_key"))
        reached = to_owned.join(label, "slug").join(owners, "match").select("label", "number_key").distinct()
        starts = numbered.join(broadcast_if_small(reached.select("number_key").distinct()), "number_key", "left_semi").groupBy("number_key").agg(F.min("seq").alias("seq"))
        joined = reached.join(starts, "number_key").groupBy("label").agg(F.min_by("number_key", F.struct("seq", "number_key")).alias("posting"))
        of_open = label.join(joined, "label", "left").select("slug", F.coalesce("posting", F.concat(F.lit("slug:"), "label")).alias("posting"))
        # an address repeated exactly belongs to the earliest number it came with
        exact = rows.where("number_key is null").select(F.col("slug_key").alias("slug")).distinct().join(bare, "slug", "left_anti")
        of_exact = numbered.select(F.col("slug_key").alias("slug"), "number_key", "seq").join(broadcast_if_small(exact), "slug", "left_semi").groupBy("slug").agg(F.min_by("number_key", "seq").alias("posting"))
        known = settle(of_exact.unionByName(of_open), "p2-postings")
        named = numbered.select("seq", F.col("number_key").alias("posting")).unionByName(
            rows.where("number_key is null").join(broadcast_if_small(known.withColumnRenamed("slug", "slug_key")), "slug_key").select("seq", "posting")
        )
        first = named.groupBy("posting").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n")).where("n > 1")
        return named.join(first, "posting").where("seq > first_seq").select(F.col("first_seq").alias("seq_a"), F.col("seq").alias("seq_b"))

    def _components(self, bare: DataFrame, near: DataFrame) -> DataFrame:
        """(slug, label): open addresses with the smallest one they are connected to."""
        label = bare.select("slug", F.col("slug").alias("label"))
        links = near.join(bare.select(F.col("slug").alias("match")), "match", "left_semi").select("slug", "match")
        both = settle(links.unionByName(links.select(F.col("match").alias("slug"), F.col("slug").alias("match"))).distinct(), "p2-links")
        if both.isEmpty():
            return label
        while True:
            reached = both.join(label.withColumnRenamed("slug", "match"), "match").groupBy("slug").agg(F.min("label").alias("least"))
            new = settle(label.join(reached, "slug", "left").select("slug", F.least("label", F.coalesce("least", "label")).alias("label"), (F.col("least") < F.col("label")).alias("moved")), "p2-label")
            label = new.select("slug", "label")
            if new.where("moved").isEmpty():
                return label
