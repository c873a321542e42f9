"""Encoding a corpus with a public byte-level BPE vocabulary, by recursive DuckDB queries.

Each partition opens an in-process DuckDB with the merge table. Text is cut into words by
the vocabulary's pre-tokenizer pattern; the words a task hasn't met yet become rows
(word, position, token). A recursive query joins every pair of neighbouring tokens with
the merge table and contracts, in each word, the pairs of the lowest rank from the left,
until no word has a pair left; words of any length take the same way. An ordered aggregation then puts the words' ids together by document.

No shuffle takes place and nothing grows with the corpus: the broadcast holds the merge
table (its size is the vocabulary's), a task holds one slice of its partition and the words
it has met, of which it forgets all beyond ``WORDS_KEPT``.

Defined results: null and empty texts give an empty list; blank texts are encoded as they
are; strings of special tokens are ordinary text; repeated rows give repeated rows; extra
columns are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pre-tokenizer pattern of the vocabulary, white space spelled out.
_WS = r"\t-\r \x85\xa0  -     　"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _WS + r"\p{L}\p{N}]+|[" + _WS + r"]+(?![^" + _WS + r"])|[" + _WS + r"]+"
)
#: Characters of text that a task encodes at once.
SLICE_CHARS = 1_500_000
WORDS_KEPT = 400_000

# The recursion keeps one state of each (word, position): a token, or -1 where a merge ate it.
# A round looks at the words that changed in the last one and contracts the pair of lowest
# rank wherever it stands in a word, from the left; of adjoining places (a run of one token)
# every other one contracts. That equals one leftmost pair after the other, since a merge
# only makes pairs of higher rank.
_ENCODE = """
insert into words
with recursive t(w, pos, tok) using key (w, pos) as (
  select w, pos, tok from fresh
  union
  (with live as (
     select r.w, r.pos, r.tok from recurring.t r where r.tok >= 0 and r.w in (select w from t)),
   sided as (
     select w, pos, tok, lead(tok) over (partition by w order by pos) as tok2, lead(pos) over (partition by w order by pos) as pos2 from live),
   paired as (
     select s.w, s.pos, s.pos2, m.merged, m.rank, min(m.rank) over (partition by s.w) as low
     from sided s join merges m on m.l = s.tok and m.r = s.tok2),
   hits as (select w, pos, pos2, merged, lag(pos2) over (partition by w order by pos) as before from paired where rank = low),
   runs as (
     select *, sum(case when before = pos then 0 else 1 end) over (partition by w order by pos rows unbounded preceding) as run from hits),
   now as (select *, row_number() over (partition by w, run order by pos) % 2 = 1 as contracts from runs)
   select w, unnest([pos, pos2]) as pos, unnest([merged, -1]) as tok from now where contracts)
)
select w, list(tok order by pos) from t where tok >= 0 group by w
"""
_DECODE = """
select coalesce(e.ids, []::integer[]) as ids
from range(?) as every(doc) left join (
  select d.doc, flatten(list(words.ids order by d.pos)) as ids
  from doc_words d join words on words.w = d.w group by d.doc) as e on e.doc = every.doc
order by every.doc
"""


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the others in order for 256, 257..
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Merge table and first ids of a byte-level BPE file (tokenizers' JSON)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    rows = [(vocab[a], vocab[b], i, vocab[a + b]) for i, (a, b) in enumerate(merges)]
    l, r, rank, merged = (list(x) for x in zip(*rows))
    return {"l": l, "r": r, "rank": rank, "merged": merged, "bytes": [vocab[s] for _, s in sorted(byte_symbols().items())]}


class Encoder:
    """One task's DuckDB with the merge table and the words met so far."""

    def __init__(self, vocabulary: dict):
        import duckdb
        import regex

        self.find = regex.compile(PATTERN).findall
        self.first = vocabulary["bytes"]
        # no spill to a folder of the machine: the state is one slice's words, SLICE_CHARS bounds it
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "900MB", "temp_directory": ""})
        table = pa.table({k: pa.array(vocabulary[k], pa.int32()) for k in ("l", "r", "rank", "merged")})
        self.con.register("merge_rows", table)
        self.con.execute("create table merges as select * from merge_rows")
        self.con.execute("create table words (w bigint, ids integer[])")
        self.known: dict[str, int] = {}

    def _learn(self, fresh: list[str]) -> None:
        if not fresh:
            return
        data = [w.encode("utf-8", "surrogatepass") for w in fresh]
        keys = range(len(self.known), len(self.known) + len(fresh))
        self.known.update(zip(fresh, keys))
        rows = pa.table({
            "w": pa.array([k for k, d in zip(keys, data) for _ in d], pa.int64()),
            "pos": pa.array([i for d in data for i in range(len(d))], pa.int32()),
            "tok": pa.array([self.first[c] for d in data for c in d], pa.int32()),
        })
        self.con.register("fresh", rows)
        self.con.execute(_ENCODE)
        self.con.unregister("fresh")

    def encode_arrow(self, texts: list[str | None]) -> pa.Array:
        """The ids of each text as one list array."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
            self.con.execute("delete from words")
        cut = [self.find(t) if t else [] for t in texts]
        self._learn([w for w in dict.fromkeys(chain.from_iterable(cut)) if w not in self.known])
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        word = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, sizes.sum())
        rows = {"doc": np.repeat(np.arange(len(cut)), sizes), "pos": np.arange(len(word)), "w": word}
        self.con.register("doc_words", pa.table(rows))
        out = self.con.execute(_DECODE, [len(cut)]).to_arrow_table().column("ids").combine_chunks()
        self.con.unregister("doc_words")
        return out.cast(pa.list_(pa.int32()))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return self.encode_arrow(texts).to_pylist()


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > SLICE_CHARS:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def encode_corpus(docs: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of every row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    key_field = slim.schema["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices([len(t or "") + 1 for t in texts]):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), encoder.encode_arrow(texts[a:b])], names=[key, "ids"])

    return slim.mapInArrow(run, f"{key} {key_field.dataType.simpleString()}, ids array<int>")
