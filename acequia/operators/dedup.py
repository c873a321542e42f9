"""De-duplication and entity resolution (survey D1-D10).

Order is meaning here: every operator takes ``order``, a column of the total order of
arrival, and the first row wins. Rows without a key bypass the shuffle by key, so they
can't form one huge group.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from acequia.functions.predicates import is_junk_title
from acequia.functions.scalars import name_key, truthy, url_key
from acequia.session import scratch_path, settle


def first_seen(df: DataFrame, key: Column, order: str = "ingest_seq") -> DataFrame:
    """The first row of each key; rows whose key is null or '' all stay.

    The per-key top-1 is planned with a partial group limit before the shuffle.
    """
    keyed = df.withColumn("_k", F.coalesce(key, F.lit("")))
    rank = F.row_number().over(W.Window.partitionBy("_k").orderBy(order))
    first = keyed.where("_k <> ''").withColumn("_r", rank).where("_r = 1").drop("_r")
    return keyed.where("_k = ''").unionByName(first).drop("_k")


def dedup_urls(df: DataFrame, order: str = "ingest_seq", columns: tuple[str, ...] = ("job_url", "profile_url", "post_url")) -> DataFrame:
    """First seen by address; ``url`` and ``applyUrl`` don't count.

    Rows without any address all stay; addresses whose key is empty ("/", "?a=1") are one.
    """
    have = [F.col(c) for c in columns if c in df.columns]
    said = F.coalesce(truthy(*have), F.lit("")) if have else F.lit("")
    return first_seen(df, F.when(said != "", F.concat(F.lit("="), url_key(said))), order)


#: Names that one task compares with as many others; fewer names are still cut into some blocks.
NAME_BLOCK, LEAST_BLOCKS, LEAST_NAMES = 1 << 14, 8, 512
#: Cells of a table of pairs that is looked at in one go.
CELLS = 1 << 18
_ALIKE = "late bigint, early bigint"


def _marks(name: str) -> tuple[int, int]:
    """128 bits for the letters of a name, first and second ones apart from further ones."""
    marks, nth = [0, 0], {}
    for c in name:
        k = nth[c] = min(nth.get(c, -1) + 1, 3)
        marks[k // 2] |= 1 << (ord(c) % 32 + 32 * (k % 2))
    return marks[0], marks[1]


class _Block:
    """Names in order of length, as arrays."""

    def __init__(self, names: pd.DataFrame, chars: dict[str, int]):
        names = names.assign(l=names["n"].str.len()).sort_values("l", kind="stable")
        self.n, self.id, self.seq, self.l = names["n"].to_list(), names["id"].to_numpy(), names["seq"].to_numpy(), names["l"].to_numpy()
        marks = np.array([_marks(x) for x in self.n], dtype=np.uint64).reshape(-1, 2)
        self.low, self.high = marks[:, 0].copy(), marks[:, 1].copy()
        self.code = np.zeros((len(self.n), max(map(len, self.n))), dtype=np.int32)  # 0 is past the end
        for row, x in zip(self.code, self.n):
            row[: len(x)] = [chars[c] for c in x]
        self.runs = {int(k): (int(np.searchsorted(self.l, k)), int(np.searchsorted(self.l, k, "right"))) for k in np.unique(self.l)}

    def places(self, kinds: int) -> np.ndarray:
        """For each name and character a bit for each place, up to 64 places."""
        out, rows = np.zeros((len(self.n), kinds), dtype=np.uint64), np.arange(len(self.n))
        for i in range(min(64, self.code.shape[1])):
            out[rows, self.code[:, i]] |= np.uint64(1 << i)
        out[:, 0] = 0
        return out


def _common(places: np.ndarray, a: np.ndarray, x: _Block, y: _Block, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of names a of x (up to 64 long) and b of y."""
    v, within = np.full(len(a), ~np.uint64(0)), ~np.uint64(0) >> (64 - x.l[a]).astype(np.uint64)
    for j in range(int(y.l[b].max(initial=0))):
        u = v & places[a, y.code[b, j]]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v & within).astype(int)


def alike(names: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(late, early) ids of the names of block p and those of block q that resemble each other.

    ``names`` (p, q, block, id, n, seq). Matching blocks are a common subsequence, so a ratio
    of t asks for t/2 of both lengths in letters that both have, and in order. Three bounds,
    each lossless, leave few pairs for the ratio itself: the marks in which two names
    differ, which are at most the letters that only one has; then the longest common
    subsequence; then the ratio of (later, earlier), which is asymmetric.
    """
    own = names["block"] == names["p"]
    chars = {c: i for i, c in enumerate(sorted(set("".join(names["n"]))), 1)}
    x = _Block(names[own], chars) if own.any() else None
    same = bool((names["p"] == names["q"]).all())
    y = x if same else _Block(names[~own], chars) if (~own).any() else None
    if x is None or y is None:
        return pd.DataFrame({"late": [], "early": []}, dtype="int64")
    places, late, early = x.places(len(chars) + 1), [], []
    for k, (start, end) in x.runs.items():
        for m, (low, high) in y.runs.items():
            need = int(np.ceil(threshold * (k + m) / 2 - 1e-9))
            if need > min(k, m):
                continue
            most, step = k + m - 2 * need, max(1, CELLS // (high - low))
            for i in range(start, end, step):
                rows = slice(i, min(i + step, end))
                a, b = np.nonzero(np.bitwise_count(x.low[rows, None] ^ y.low[None, low:high]) <= most)
                a, b = a + i, b + low
                ok = np.bitwise_count(x.low[a] ^ y.low[b]).astype(int) + np.bitwise_count(x.high[a] ^ y.high[b]) <= most
                ok &= (x.seq[a] < y.seq[b]) if same else (x.seq[a] != y.seq[b])
                a, b = a[ok], b[ok]
                if k <= 64 and len(a):
                    ok = _common(places, a, x, y, b) >= need
                    a, b = a[ok], b[ok]
                for one, other in zip(a, b):
                    first, second = (x.n[one], y.n[other]) if x.seq[one] < y.seq[other] else (y.n[other], x.n[one])
                    if SequenceMatcher(None, second, first).ratio() >= threshold:
                        ids = (x.id[one], y.id[other]) if x.seq[one] < y.seq[other] else (y.id[other], x.id[one])
                        early.append(ids[0])
                        late.append(ids[1])
    return pd.DataFrame({"late": late, "early": early}, dtype="int64")


#: Pairs that one task may scan in order; while more are undecided, rounds decide them.
SCAN_PAIRS = 1 << 18


def _scan(edges: pd.DataFrame) -> pd.DataFrame:
    """The greedy rule over all edges, in order of arrival."""
    gone: set = set()
    for _, late, earlier in sorted((seq, late, list(g)) for (seq, late), g in edges.groupby(["ls", "late"])["early"]):
        if any(e not in gone for e in earlier):
            gone.add(late)
    return pd.DataFrame({"late": sorted(gone)})


def refused(pairs: DataFrame, scan_pairs: int = SCAN_PAIRS) -> DataFrame:
    """(late): what a greedy scan refuses, each for an earlier neighbour that stays.

    ``pairs`` (late, early, ls) holds every neighbour that came before ``late``, whose
    place is ``ls``. A round settles all whose earlier neighbours are decided, at least the
    earliest, and drops the edges of the decided; a remainder of ``scan_pairs`` edges is
    scanned in one task. It goes on until nothing is undecided, however long the chains.
    """
    spark = pairs.sparkSession
    kind = pairs.schema["late"].dataType.simpleString()
    path = scratch_path(spark, "refused")
    pairs.select("late").limit(0).write.parquet(path)
    edges, before = pairs, None
    while left := edges.count():
        if left <= scan_pairs:
            edges.groupBy().applyInPandas(_scan, f"late {kind}").write.mode("append").parquet(path)
            break
        if before is not None and left >= before:
            raise RuntimeError(f"{left} pairs stay undecided")
        before = left
        firm = edges.select("early").join(edges.select(F.col("late").alias("early")), "early", "left_anti").distinct()
        hit = settle(edges.join(firm, "early", "left_semi").select("late").distinct(), "refused-hit")
        hit.write.mode("append").parquet(path)
        rest = edges.join(hit, "late", "left_anti").join(hit.select(F.col("late").alias("early")), "early", "left_anti")
        edges = settle(rest.select("late", "early", "ls"), "refused-edges")
    return spark.read.schema(f"late {kind}").parquet(path)


def dedup_names(df: DataFrame, threshold: float = 0.85, order: str = "ingest_seq", name: str = "name", scan_pairs: int = SCAN_PAIRS) -> DataFrame:
    """A row goes if its name resembles that of an earlier row that stays.

    Equal normalised names are settled first (lossless). Pairs of distinct names come from
    blocks of names compared by ``alike``; ``refused`` decides them. Unnamed
    rows stay; of names of white space only, which resemble each other alone, the first does.
    """
    said = F.coalesce(F.col(name), F.lit(""))
    keyed = df.withColumn("_n", F.when(said == "", "").otherwise(F.coalesce(F.nullif(name_key(said), F.lit("")), F.lit(" "))))
    names = keyed.where("_n <> ''").groupBy("_n").agg(F.min(order).alias("seq")).select(F.col("_n").alias("n"), "seq")
    names = settle(names.select(F.monotonically_increasing_id().alias("id"), "n", "seq"), "d2-names")
    # every block of names meets every other; no pair leaves its task before it is confirmed
    count = names.count()
    blocks = max(-(-count // NAME_BLOCK), min(LEAST_BLOCKS, -(-count // LEAST_NAMES)), 1)
    spread = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks * (blocks + 1) // 2, 1000))
    placed = names.withColumn("block", F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = placed.select(F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "n", "seq")
    found = met.repartition(spread, "p", "q").groupBy("p", "q").applyInPandas(lambda g: alike(g, threshold), _ALIKE)
    found = settle(found, "d2-alike")
    side = lambda c: names.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"), F.col("seq").alias(f"{c}_s"))
    pairs = found.join(side("late"), "late").join(side("early"), "early")
    pairs = settle(pairs.select(F.col("late_n").alias("late"), F.col("early_n").alias("early"), F.col("late_s").alias("ls")), "d2-pairs")

    gone = refused(pairs, scan_pairs).select(F.col("late").alias("n"))
    stays = names.join(gone, "n", "left_anti").select(F.col("n").alias("_n"), F.col("seq").alias("_first"))
    named = keyed.where("_n <> ''").join(stays, "_n").where(F.col(order) == F.col("_first")).drop("_first")
    return keyed.where("_n = ''").unionByName(named).drop("_n")


def merge_people(people: DataFrame, employees: DataFrame, threshold: float = 0.85, order: str = "ingest_seq") -> DataFrame:
    """D3: people before employees, then D2; ``rank`` tells the source."""
    both = people.withColumn("rank", F.lit(0)).unionByName(employees.withColumn("rank", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("_o", F.col("rank") * F.lit(1 << 52) + F.col(order))
    return dedup_names(both, threshold, "_o").drop("_o")


#: Rows of one key that are folded in one go; a hot key is folded block by block.
FOLD_BLOCK = 1 << 16
_HELD = "struct<seq: bigint, t: boolean, v: boolean>"
_STEP = "case when e is null or (r.t and not e.t) or (r.v and not e.v) then r else e end"
_STARTS = ["null", "00", "01", "10", "11"]


def _start(s: str) -> str:
    """A row held before a block: unknown row (-1) with text and verdict as told."""
    if s == "null":
        return f"cast(null as {_HELD})"
    return f"cast(named_struct('seq', -1L, 't', {s[0] == '1'}, 'v', {s[1] == '1'}) as {_HELD})".replace("True", "true").replace("False", "false")


def most_enriched(df: DataFrame, key: Column, order: str = "ingest_seq", text: str = "text_ocr", verdict: str = "is_valid") -> DataFrame:
    """An ordered fold of each key's rows; a row replaces the one held if it has text
    where that has none, else if it has a verdict (even "False") where that has none.

    The fold isn't associative and may lose text. What a block of rows does depends on the
    two flags of the row held before it only, so each block is folded for every such start
    and the blocks' results are folded in order: no group is gathered whole, however hot
    its key. Only order and flags move; the surviving rows are fetched by a join. Gives
    them with ``first_seq``, the place of the key.
    """
    flags = df.select(
        key.alias("_k"), F.col(order).cast("bigint").alias("seq"),
        (F.coalesce(F.col(text), F.lit("")) != "").alias("t"), (F.coalesce(F.col(verdict), F.lit("")) != "").alias("v"),
    ).withColumn("block", F.floor(F.col("seq") / FOLD_BLOCK))
    runs = flags.groupBy("_k", "block").agg(F.array_sort(F.collect_list(F.struct("seq", "t", "v"))).alias("rs"))
    ends = [F.expr(f"aggregate(rs, {_start(s)}, (e, r) -> {_STEP})").alias(f"e_{s}") for s in _STARTS]
    blocks = runs.select("_k", "block", F.col("rs")[0]["seq"].alias("first_seq"), *ends)
    gathered = blocks.groupBy("_k").agg(
        F.min("first_seq").alias("first_seq"), F.array_sort(F.collect_list(F.struct("block", *[f"e_{s}" for s in _STARTS]))).alias("bs")
    )
    end = "case when e is null then r.e_null when e.t and e.v then r.e_11 when e.t then r.e_10 when e.v then r.e_01 else r.e_00 end"
    carry = f"if(({end}).seq = -1, e, {end})"
    kept = gathered.select(F.expr(f"aggregate(bs, cast(null as {_HELD}), (e, r) -> {carry}).seq").alias("_held"), "first_seq")
    return df.join(kept, F.col(order).cast("bigint") == F.col("_held")).drop("_held")


def richness(id_: str = "jobId", company: str = "companyName", place: str = "location", date: str = "postedDate", apply: str = "applyUrl") -> Column:
    """Weighted presence of a record's fields."""
    has = lambda c, w: F.when(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("0")) != "0", w).otherwise(0)
    return has(id_, 10) + has(company, 5) + has(place, 3) + has(date, 2) + has(apply, 1)


def dedup_jobs(df: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """First seen by id, else by title and company; then junk goes and a score is added.

    A junk row takes its key before it goes. Sort by ``score`` descending, then ``order``.
    """
    id_ = F.nullif(F.col("jobId").cast("string"), F.lit("0"))
    named = F.concat(F.coalesce("title", F.lit("")), F.lit("|"), F.coalesce("companyName", F.lit("")))
    first = first_seen(df, F.coalesce(F.concat(F.lit("id:"), id_), F.concat(F.lit("t:"), named)), order)
    title = F.coalesce("title", F.lit(""))
    clean = first.where(~is_junk_title(title) & (id_.isNotNull() | (title != "")))
    return clean.withColumn("score", richness())


def dedup_all(df: DataFrame, threshold: float = 0.85, order: str = "ingest_seq") -> DataFrame:
    """The five buckets after de-duplication, in ``bucket``."""
    pick = lambda *cats: df.where(F.col("category").isin(*cats))
    posts = pick("posts_feed").withColumn("_o", F.col(order)).unionByName(pick("posts_companies").withColumn("_o", F.col(order) + F.lit(1 << 52)))
    parts = [
        merge_people(pick("people"), pick("company_employees"), threshold, order).drop("rank").withColumn("bucket", F.lit("people")),
        dedup_urls(pick("jobs"), order).withColumn("bucket", F.lit("jobs")),
        dedup_urls(posts, "_o").drop("_o").withColumn("bucket", F.lit("posts")),
        dedup_urls(pick("authors"), order).withColumn("bucket", F.lit("authors")),
        pick("company_profiles").withColumn("bucket", F.lit("company_profiles")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def not_seen_before(rows: DataFrame, seen: DataFrame, key: str, drop_blank: bool = True) -> DataFrame:
    """Rows whose key isn't among those of ``seen``."""
    known = seen.where(F.coalesce(F.col(key), F.lit("")) != "").select(key).distinct()
    kept = rows.where(F.coalesce(F.col(key), F.lit("")) != "") if drop_blank else rows
    return kept.join(known, key, "left_anti")


def ordered_distinct(hits: Column) -> Column:
    """Distinct hits in order of first sight."""
    return F.array_distinct(hits)


def dedup_stats(before: DataFrame, after: DataFrame, key: str = "category") -> DataFrame:
    """Rows before and after, removed (may be negative) and percent, and the TOTAL (no percent)."""
    from acequia.functions.scalars import percent_removed

    b = before.groupBy(key).agg(F.count("*").alias("before"))
    a = after.groupBy(key).agg(F.count("*").alias("after"))
    both = b.join(a, key, "full").select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    each = both.withColumn("removed", F.col("before") - F.col("after")).withColumn("pct", percent_removed(F.col("before"), F.col("after")))
    total = both.agg(F.coalesce(F.sum("before"), F.lit(0)).alias("before"), F.coalesce(F.sum("after"), F.lit(0)).alias("after"))
    total = total.select(F.lit("TOTAL").alias(key), "before", "after", (F.col("before") - F.col("after")).alias("removed"), F.lit("").alias("pct"))
    return each.unionByName(total)
