"""Passages of held-out evaluation items found in a corpus.

Texts and items are brought to templates: case, accents and punctuation go, numbers, units
and the names the items use become typed placeholders. Windows of ``WINDOW`` template
words are hash-joined with the windows of the items. Where two windows meet on one
alignment the words themselves are compared along it: a stretch may hold single changed
words, and a slot counts as equal if the text fills it as the item does or, in a
re-parameterised copy, always with one same other value. A document holds an item if a
stretch is ``MIN_WORDS`` long, or the whole item if that is shorter.

The windows of the items are a table like any other; it is broadcast if its size is within
the limit, else joined by a shuffle. Items and texts are never gathered: each candidate
alignment is one row that holds the item's words and only the words of the text beside
them. Texts are read twice, the second time only those with candidates (a broadcast of
their ids, if small enough, keeps the corpus from being shuffled).

Defined results: null, empty and blank texts or items match nothing; repeated documents
are reported for each of their ids; a document and an item come out once. An item of fewer
words than a window is held by texts that have all its words in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acequia.session import broadcast_if_small, settle

WINDOW = 5
MIN_WORDS = 15
#: Seeds on one alignment before the words are compared; of an item so short that one
#: changed word may leave it a single whole window, one is enough.
MIN_SEEDS = 2
SHORT_ITEM = 2 * WINDOW + MIN_SEEDS
#: Of a stretch's words so many at least are equal as they stand, refilled slots not counted.
MIN_EQUAL = 0.87
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
# Words for units of measure.
UNITS = ["km", "kg", "cm", "mm", "ml", "mg", "mb", "gb", "usd", "eur", "ars", "euros", "euro", "pesos", "dolares", "dollars", "percent", "metros", "meters"]


#: Accents that stand apart from their letter (they go).
MARKS = "".join(map(chr, range(0x300, 0x370)))


def words_of(c: Column) -> Column:
    """Lower-case words without accents; punctuation and quoting are gaps."""
    low = F.translate(F.lower(c), "áéíóúàèìòùâêîôûäëïöüãõñçå" + MARKS, "aeiouaeiouaeiouaeiouaonca")
    return F.array_remove(F.split(low, r"[^\p{L}\p{N}]+"), "")


def item_names(items: DataFrame, text: str = "text") -> list[str]:
    """Names the items use: words always capitalised in them, also inside sentences.

    The vocabulary of names of the evaluation set is the one thing that goes to the driver.
    """
    raw = items.select(F.explode(F.split(F.col(text), r"(?<=[.!?:;])\s+")).alias("s"))
    w = raw.select(F.posexplode(F.split("s", r"[^\p{L}\p{N}]+")).alias("pos", "w")).where("w <> ''")
    stats = w.groupBy(words_of(F.col("w"))[0].alias("k")).agg(
        F.min(F.col("w").rlike(r"^\p{Lu}")).alias("always"), F.max((F.col("pos") > 0) & F.col("w").rlike(r"^\p{Lu}")).alias("inside")
    )
    return sorted(r.k for r in stats.where("always and inside and k is not null").collect())


def _is_number(w: Column) -> Column:
    return (w < ":") & w.rlike("^[0-9]+$")


def template_of(words: Column, names: list[str]) -> Column:
    """The template's words as hashes; all fillings of a slot have one."""

    def slot(w: Column) -> Column:
        named = w.isin(names) if names else F.lit(False)
        return F.when(_is_number(w), F.xxhash64(F.lit(NUM))).when(w.isin(UNITS), F.xxhash64(F.lit(UNIT))).when(named, F.xxhash64(F.lit(NAME))).otherwise(F.xxhash64(w))

    return F.transform(words, slot)


def windows_of(df: DataFrame, key: str, size: int = WINDOW) -> DataFrame:
    """(key, pos, h): the hashes of all windows of ``size`` words of column ``template``."""
    parts = ", ".join(f"template[i + {k}]" for k in range(size))
    hashes = F.expr(f"transform(sequence(0, size(template) - {size}), i -> xxhash64({parts}))")
    return df.where(f"size(template) >= {size}").select(key, F.posexplode(hashes).alias("pos", "h"))


def window_of(n_words: str) -> Column:
    """Words of the windows of an item: whatever MIN_EQUAL lets change, one window stays whole."""
    n = F.col(n_words)
    changes = F.floor(n * (1 - MIN_EQUAL) + 1e-9)
    return F.when(n < WINDOW, n).otherwise(F.least(F.lit(WINDOW), F.ceil((n - changes) / (changes + 1)))).cast("int")


def _slot_kind(word: str, names: frozenset) -> str:
    if word.isascii() and word.isdigit():
        return NUM
    return NAME if word in names else ""


def longest_stretch(doc: list[str], item: list[str], diagonal: int, names: frozenset = frozenset()) -> int:
    """Words of the longest stretch of ``item`` in ``doc`` with item[p] at doc[p + diagonal].

    Unequal words end a stretch if two stand side by side, or if its equal words fall
    under MIN_EQUAL; a slot always filled by one other value doesn't end one.
    """
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    best, start, fills, equal, miss = 0, lo, {}, 0, False
    end = lo - 1
    for p in range(lo, hi):
        a, b = item[p], doc[p + diagonal]
        same = a == b
        if not same:
            kind = _slot_kind(a, names)
            if kind and kind == _slot_kind(b, names) and fills.setdefault(a, b) == b:
                same = True
        if same:
            equal += a == b
            miss, end = False, p
            n = end - start + 1
            if n > best and equal >= MIN_EQUAL * n:
                best = n
        elif miss or end < start:
            start, fills, equal, miss = p + 1, {}, 0, False
        else:
            miss = True
    return best


def find_contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """(doc_id, item_id): the items whose passages a document contains."""
    held = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("item"), words_of(F.col(text)).alias("words"))
    names = item_names(items, text)
    held = settle(held.where("size(words) > 0").withColumn("template", template_of(F.col("words"), names)).withColumn("n_words", F.size("words")).withColumn("window", window_of("n_words")), "p9-items")
    base = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    texts = base.select("doc", template_of(words_of(F.col("text")), names).alias("template"))

    def seeds(size: int, own: DataFrame) -> DataFrame:
        windows = windows_of(own, "item", size).join(own.select("item", "n_words"), "item").select("item", "n_words", F.col("pos").alias("ipos"), "h")
        hits = windows_of(texts, "doc", size).join(broadcast_if_small(settle(windows, "p9-windows")), "h")
        return hits.groupBy("doc", "item", "n_words", (F.col("pos") - F.col("ipos")).alias("diagonal")).agg(F.count("*").alias("n"))

    found = seeds(WINDOW, held.where(f"window = {WINDOW}")).where(f"n >= {MIN_SEEDS} or n_words < {SHORT_ITEM}")
    for size in range(1, WINDOW):
        brief = held.where(f"window = {size}")
        if not brief.isEmpty():
            found = found.unionByName(seeds(size, brief))
    found = settle(found.select("doc", "item", "diagonal"), "p9-seeds")
    wanted = base.join(broadcast_if_small(found.select("doc").distinct()), "doc", "left_semi").select("doc", words_of(F.col("text")).alias("words"))
    tries = wanted.join(broadcast_if_small(found), "doc").join(broadcast_if_small(held.select("item", F.col("words").alias("iwords"))), "item")
    # the words of the text beside the item's, from the first that both have
    low = F.greatest(F.lit(0), F.col("diagonal"))
    beside = F.slice("words", low + 1, F.greatest(F.lit(0), F.col("diagonal") + F.size("iwords") - low))
    rows = tries.select("doc", "item", beside.alias("words"), "iwords", (F.col("diagonal") - low).alias("diagonal"))
    name_set = frozenset(names)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [
                (doc, item)
                for doc, item, words, own, d in zip(pdf.doc, pdf.item, pdf.words, pdf.iwords, pdf.diagonal)
                if longest_stretch(list(words), list(own), d, name_set) >= min(MIN_WORDS, len(own))
            ]
            yield pd.DataFrame(out, columns=[doc_id, item_id])

    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    return rows.mapInPandas(compare, f"{doc_id} {kinds[0]}, {item_id} {kinds[1]}").distinct()
