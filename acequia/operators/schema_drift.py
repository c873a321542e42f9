"""Schemas that drift between files, read into one table with a report of each change.

Every landed file has a schema tree: a root, its fields, and below objects and arrays the
fields inside them, as deep as they go. A node carries its name, its JSON types and a
profile of its content. Between a file and the one before it of the same feed the cheapest
edit script is sought: adding or deleting a node costs 1 (with its subtree), keeping a node
costs nothing, renaming one costs more the less its content resembles the old one. Fields
are unordered, so the optimum at each level is an assignment between the two sets of
children, weighted by the costs of their subtrees. A value that moves below its field (a
text that becomes an object or list holding it) is followed to the leaf whose content it is.

Scripts are compiled into one projection per file, a path for each column, and applied to
all records. What a field fills is followed from file to file by pointer doubling over the
nodes, so no feed's history is gathered.

One pass over the records sums the content up by file and node: masked character trigrams
hashed into ``BUCKETS`` cells, first within each batch, then across, so neither a file nor a
profile grows with the rows.

Defined results: a payload that is null, empty, cut off or no object is unreadable and
counts for nothing; a file without readable records has no fields; the first file of a
feed has no changes; repeated lines change nothing; changes are reported of the fields of
the records, with ``nested`` also of those inside them.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from acequia.session import broadcast_if_small, settle

#: Cells of a content profile.
BUCKETS = 256
#: A rename costs (1 - cosine of contents) * RENAME_WEIGHT plus a little for the name; it is
#: taken while that is below delete + add.
RENAME_WEIGHT = 5.0
NAME_WEIGHT = 0.2

CHANGE_SCHEMA = "file_no bigint, field_name string, change_kind string, old_field string"


#: Columns of the target table that a landed field may fill, each with the names known for
#: it (fixed values); a field of any other name goes by its content alone.
TARGETS = {
    "title": ["title", "puesto", "jobTitle", "titulo"],
    "companyName": ["companyName", "company", "company_name", "empresa"],
    "location": ["location", "jobLocation", "ubicacion"],
    "url": ["url", "link"],
    "job_url": ["job_url", "jobUrl"],
    "applyUrl": ["applyUrl", "apply_url", "applyLink", "urlPostulacion"],
    "external_id": ["external_id", "idEmpleo"],
    "jobId": ["jobId", "job_id"],
    "postedDate": ["postedDate", "posted_date", "fecha"],
    "search_keyword": ["search_keyword", "keyword"],
}
_FAMILY = {name.lower(): target for target, names in TARGETS.items() for name in names}
#: Known names of one column halve the weight of a difference in content.
KNOWN_PAIR = 0.5


def readable(records: DataFrame) -> DataFrame:
    """Records whose payload is one whole JSON object, with it parsed as ``doc``."""
    df = records.withColumn("doc", F.expr("try_parse_json(payload)"))
    return df.where("doc is not null and schema_of_variant(doc) like 'OBJECT%'")


#: Between the names of a node's path; an array's elements are named ``ELEMENT``.
SEP, ELEMENT = "\x1f", "[]"
_MASK = re.compile(r'[\s{}\[\]"]+')
_DIGITS = str.maketrans("0123456789", "9" * 10)


def _object(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a name stands twice")
    return out


def _refuse(word: str) -> None:
    raise ValueError(word)


def _walk(value, path: str, out: list) -> str:
    """Adds (path, type, text) of a value and of all below it; gives its text."""
    if value is None:
        return ""
    at = len(out)
    out.append(None)
    if isinstance(value, dict):
        kind, text = "object", " ".join(_walk(v, f"{path}{SEP}{k}", out) for k, v in value.items())
    elif isinstance(value, list):
        kind, text = "array", " ".join([_walk(v, f"{path}{SEP}{ELEMENT}", out) for v in value])
    elif isinstance(value, bool):
        kind, text = "boolean", str(value).lower()
    elif isinstance(value, str):
        kind, text = "string", value
    else:
        kind, text = "number", str(value)
    out[at] = (path, kind, text)
    return text


def _trigrams(text: str) -> list[str]:
    m = f" {_MASK.sub(' ', text.lower().translate(_DIGITS))} "
    return [m[i : i + 3] for i in range(max(1, len(m) - 2))]


def schema_trees(records: DataFrame) -> DataFrame:
    """(file_no, path, types, cells, counts): the nodes of each file's schema tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = json.JSONDecoder(object_pairs_hook=_object, parse_constant=_refuse).decode
        for pdf in batches:
            types: dict = defaultdict(Counter)
            texts: dict = defaultdict(Counter)
            for file_no, payload in zip(pdf.file_no, pdf.payload):
                try:
                    doc = decode(payload)
                except (ValueError, RecursionError):
                    continue
                if not isinstance(doc, dict):
                    continue
                found: list = []
                for k, v in doc.items():
                    _walk(v, k, found)
                for path, kind, text in found:
                    types[file_no, path][kind] += 1
                    texts[file_no, path][text] += 1
            rows = []
            for (file_no, path), said in texts.items():
                grams: Counter = Counter()
                for text, n in said.items():
                    grams.update(_trigrams(text) * n if n < 4 else {g: k * n for g, k in Counter(_trigrams(text)).items()})
                cells: Counter = Counter()
                for gram, n in grams.items():
                    cells[zlib.crc32(gram.encode("utf-8", "surrogatepass")) % BUCKETS] += n
                rows.append((file_no, path, dict(types[file_no, path]), dict(cells)))
            yield pd.DataFrame(rows, columns=["file_no", "path", "types", "profile"])

    slim = records.select("file_no", "payload").where("file_no is not null and payload is not null")
    parts = settle(slim.mapInPandas(run, "file_no bigint, path string, types map<string,bigint>, profile map<int,bigint>"), "p5-parts")
    key = ["file_no", "path"]
    cells = parts.select(*key, F.explode("profile").alias("cell", "n")).groupBy(*key, "cell").agg(F.sum("n").alias("n"))
    profile = cells.groupBy(*key).agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("counts"))  # BUCKETS at most
    kinds = parts.select(*key, F.explode("types").alias("type", "n")).groupBy(*key, "type").agg(F.sum("n").alias("n"))
    types = kinds.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("types"))
    return profile.join(types, key)


def _profile(node: dict) -> dict:
    if "profile" not in node:
        node["profile"] = dict(zip(node["cells"].tolist(), node["counts"].tolist()))
    return node["profile"]


def _cosine(a: dict, b: dict) -> float:
    dot = sum(v * b.get(k, 0) for k, v in a.items())
    na, nb = math.sqrt(sum(v * v for v in a.values())), math.sqrt(sum(v * v for v in b.values()))
    return dot / (na * nb) if na and nb else 0.0


def _name_distance(a: str, b: str) -> float:
    """0 for names equal but for case and separators, else 1 - shared trigrams."""
    fold = lambda s: "".join(c for c in s.lower() if c.isalnum())
    a, b = fold(a), fold(b)
    if a == b:
        return 0.0
    ga, gb = ({s[i : i + 3] for i in range(max(1, len(s) - 2))} for s in (a, b))
    return 1 - len(ga & gb) / max(1, len(ga | gb))


def _same_family(a: str, b: str) -> bool:
    return _FAMILY.get(a.lower(), 1) == _FAMILY.get(b.lower(), 2)


def _assign(costs: list[list[float]]) -> list[int]:
    """Cheapest assignment of rows to columns of a square matrix (shortest augmenting paths)."""
    n = len(costs)
    inf = float("inf")
    u, v, at = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        at[0], j, least, back, done = i, 0, [inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while True:
            done[j] = True
            row, step, nxt = at[j], inf, 0
            for k in range(1, n + 1):
                if not done[k]:
                    c = costs[row - 1][k - 1] - u[row] - v[k]
                    if c < least[k]:
                        least[k], back[k] = c, j
                    if least[k] < step:
                        step, nxt = least[k], k
            for k in range(n + 1):
                if done[k]:
                    u[at[k]] += step
                    v[k] -= step
                else:
                    least[k] -= step
            j = nxt
            if at[j] == 0:
                break
        while j:
            at[j], j = at[back[j]], back[j]
    out = [-1] * n
    for k in range(1, n + 1):
        out[at[k] - 1] = k - 1
    return out


def edit_script(old: dict, new: dict) -> tuple[float, list[tuple[str, str, str]]]:
    """Cheapest script between two sets of sibling nodes.

    A node is {name: {"types": .., "profile": .., "children": {..}}} (or cells and counts
    for profile). Gives the cost and
    (kind, new name, old name) with kind keep, rename, add, delete. Nodes of one name are
    kept; all others are assigned.
    """
    script = [("keep", k, k) for k in sorted(old.keys() & new.keys())]
    cost = sum(edit_script(old[k]["children"], new[k]["children"])[0] for _, k, _ in script)
    gone, come = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
    size = lambda node: 1 + sum(size(c) for c in node["children"].values())
    n = len(gone) + len(come)
    if not n:
        return cost, script
    pair = lambda a, b: (
        RENAME_WEIGHT * (1 - _cosine(_profile(old[a]), _profile(new[b]))) * (KNOWN_PAIR if _same_family(a, b) else 1)
        + NAME_WEIGHT * _name_distance(a, b)
        + edit_script(old[a]["children"], new[b]["children"])[0] * 0.1
    )
    grid = [
        [pair(a, b) for b in come] + [size(old[a]) if i == k else 1e6 for k in range(len(gone))]
        for i, a in enumerate(gone)
    ] + [[size(new[b]) if j == k else 1e6 for j, b in enumerate(come)] + [0.0] * len(gone) for k in range(len(come))]
    chosen = _assign(grid)
    for i, a in enumerate(gone):
        j = chosen[i]
        if j < len(come):
            script.append(("rename", come[j], a))
            cost += grid[i][j]
        else:
            script.append(("delete", "", a))
            cost += size(old[a])
    renamed = {b for kind, b, _ in script if kind == "rename"}
    for b in come:
        if b not in renamed:
            script.append(("add", b, ""))
            cost += size(new[b])
    return cost, script


def tree_of(rows: pd.DataFrame) -> dict:
    tree: dict = {}
    at: dict = {}
    for path, types, cells, counts in sorted(zip(rows.path, rows.types, rows.cells, rows.counts), key=lambda r: r[0].count(SEP)):
        up, _, name = path.rpartition(SEP)
        node = at[path] = {"types": dict(types), "cells": cells, "counts": counts, "children": {}}
        (at[up]["children"] if up else tree)[name] = node
    return tree


def main_type(node: dict) -> str:
    """The type most values have; of equally many the first by name."""
    return max(sorted(node["types"]), key=lambda t: node["types"][t])


def _script_of_pair(pdf: pd.DataFrame, nested: bool, report: bool) -> pd.DataFrame:
    """The changes of a pair of files, or (without ``report``) each field with the one it goes on from."""
    file_no = int(pdf.pair.iloc[0])
    named = pdf[pdf.path.notna()]
    out = []

    def follow(old: dict, new: dict, under: str) -> None:
        for kind, name, before in edit_script(old, new)[1]:
            if not report:
                out.append((file_no, under + name, "", under + before)) if kind != "delete" else None
                continue
            if kind == "add":
                out.append((file_no, under + name, "added", ""))
            elif kind == "delete":
                out.append((file_no, under + before, "removed", ""))
            else:
                if kind == "rename":
                    out.append((file_no, under + name, "renamed", under + before))
                if main_type(old[before]) != main_type(new[name]):
                    out.append((file_no, under + name, "retyped", ""))
                if nested:
                    follow(old[before]["children"], new[name]["children"], f"{under}{name}.")

    follow(tree_of(named[named.side == "old"]), tree_of(named[named.side == "new"]), "")
    return pd.DataFrame(out, columns=["file_no", "field_name", "change_kind", "old_field"])


def _raw_files(files: DataFrame, kind: str | None) -> DataFrame:
    raw = files.where(F.col("kind") == kind) if kind else files
    return raw.where("file_no is not null").select("file_no", "feed_id").distinct()


def _pairs(records: DataFrame, files: DataFrame, kind: str | None) -> DataFrame:
    """(file_no, prev): each file with records and the one before it of its feed."""
    landed = records.select("file_no").distinct()
    order = _raw_files(files, kind).join(landed, "file_no")
    step = W.Window.partitionBy("feed_id").orderBy("file_no")
    return order.withColumn("prev", F.lag("file_no").over(step)).where("prev is not null").select("file_no", "prev")


def _scripts(pairs: DataFrame, nodes: DataFrame, nested: bool, report: bool) -> DataFrame:
    # each file's nodes go to the pair in which it is new and to the one in which it is old
    sides = pairs.select(
        F.col("file_no").alias("pair"),
        F.explode(F.array(F.struct(F.lit("new").alias("side"), F.col("file_no").alias("f")), F.struct(F.lit("old").alias("side"), F.col("prev").alias("f")))).alias("x"),
    ).select("pair", "x.side", F.col("x.f").alias("file_no"))
    joined = sides.join(nodes, "file_no", "left").select("pair", "side", "path", "types", "cells", "counts")
    return joined.groupBy("pair").applyInPandas(lambda pdf: _script_of_pair(pdf, nested, report), CHANGE_SCHEMA)


def schema_changes(records: DataFrame, files: DataFrame, kind: str | None = "raw", nested: bool = False) -> DataFrame:
    """CHANGE_SCHEMA: the changes of each file against the one before it of its feed.

    records: file_no, payload. files: file_no, feed_id and, unless ``kind`` is None, kind.
    A file without any record isn't a file that landed and takes no part.
    """
    return _scripts(_pairs(records, files, kind), schema_trees(records), nested, True)


def _cosine_sql(a: str, b: str) -> str:
    norm = lambda c: f"sqrt(aggregate({c}, 0D, (s, x) -> s + x.n * x.n))"
    dot = f"aggregate({a}, 0D, (s, x) -> s + x.n * coalesce(map_from_entries({b})[x.cell], 0))"
    return f"{dot} / greatest({norm(a)} * {norm(b)}, 1e-9)"


def field_targets(records: DataFrame, files: DataFrame, kind: str | None = "raw") -> DataFrame:
    """(file_no, target, field, path): which field, and which leaf in it, fills a column.

    A field of a known name fills its column; any other the column of the field that it goes
    on from, however many files back. ``path`` (JSON path below the field) is null for plain
    values, else leads to the leaf whose content is most like the column's plain values.
    """
    nodes = settle(schema_trees(records).join(_raw_files(files, kind).select("file_no"), "file_no"), "p5-nodes")
    pairs = _pairs(records, files, kind)
    links = _scripts(pairs, nodes, False, False).select("file_no", F.col("field_name").alias("field"), F.nullif("old_field", F.lit("")).alias("old"))
    links = links.join(pairs, "file_no").select("file_no", "field", F.when(F.col("old").isNotNull(), F.col("prev")).alias("up_file"), F.col("old").alias("up"))
    known = F.create_map(*[F.lit(x) for kv in _FAMILY.items() for x in kv])
    top = nodes.where(~F.col("path").contains(SEP)).select("file_no", F.col("path").alias("field"))
    state = top.join(links, ["file_no", "field"], "left").withColumn("target", known[F.lower("field")]).withColumn("own", F.col("target").isNotNull())
    while True:
        state = settle(state, "p5-targets")
        open_ = state.where("target is null and up is not null")
        if open_.isEmpty():
            break
        above = state.select(F.col("file_no").alias("up_file"), F.col("field").alias("up"), F.col("target").alias("t"), F.col("up_file").alias("f2"), F.col("up").alias("u2"))
        got = open_.join(above, ["up_file", "up"], "left").select(
            "file_no", "field", F.when(F.col("t").isNull(), F.col("f2")).alias("up_file"), F.when(F.col("t").isNull(), F.col("u2")).alias("up"), F.col("t").alias("target"), "own"
        )
        state = state.where("target is not null or up is null").unionByName(got)
    first = F.row_number().over(W.Window.partitionBy("file_no", "target").orderBy(F.desc("own"), "field"))
    chosen = settle(state.where("target is not null").withColumn("r", first).where("r = 1").select("file_no", "target", "field"), "p5-chosen")

    cells = F.arrays_zip(F.col("cells").alias("cell"), F.col("counts").alias("n"))
    leaf = ~F.expr("map_contains_key(types, 'object') or map_contains_key(types, 'array')")
    leaves = nodes.where(leaf).select("file_no", F.split_part("path", F.lit(SEP), F.lit(1)).alias("field"), "path", cells.alias("p")).join(chosen, ["file_no", "field"])
    plain = leaves.where(F.col("path") == F.col("field")).select("target", F.explode("p").alias("c")).groupBy("target", "c.cell").agg(F.sum("c.n").alias("n"))
    plain = plain.groupBy("target").agg(F.collect_list(F.struct("cell", "n")).alias("q"))  # one row for each column
    below = leaves.where(F.col("path") != F.col("field")).join(broadcast_if_small(plain), "target", "left")
    scored = below.withColumn("like", F.coalesce(F.expr(_cosine_sql("p", "q")), F.lit(0.0)))
    best = scored.groupBy("file_no", "target").agg(F.max_by("path", F.struct("like", "path")).alias("node"))
    names = F.slice(F.split("node", SEP), 2, 1 << 20)
    steps = F.transform(names, lambda x: F.when(x == ELEMENT, F.lit("[0]")).otherwise(F.concat(F.lit("['"), x, F.lit("']"))))
    return chosen.join(best.select("file_no", "target", F.concat(F.lit("$"), F.array_join(steps, "")).alias("path")), ["file_no", "target"], "left")


def unified_records(records: DataFrame, files: DataFrame, columns: list[str], kind: str | None = "raw") -> DataFrame:
    """All readable records in one table: raw_id, file_no, line_no and ``columns`` as text.

    The scripts become one projection per file, held as a map target -> (field, path) and
    joined to the records by file. A leaf that one record lacks leaves its column null.
    """
    maps = field_targets(records, files, kind).groupBy("file_no").agg(F.map_from_entries(F.collect_list(F.struct("target", F.struct("field", "path")))).alias("plan"))
    doc = readable(records).withColumn("m", F.expr("from_json(payload, 'map<string,string>')"))
    joined = doc.join(broadcast_if_small(maps), "file_no", "left")

    def value(column: str):
        if column not in TARGETS:
            return F.lit(None).cast("string").alias(column)
        raw = F.expr(f"try_element_at(m, try_element_at(plan, '{column}').field)")
        inner = F.expr(f"get_json_object(try_element_at(m, try_element_at(plan, '{column}').field), try_element_at(plan, '{column}').path)")
        return F.when(raw.startswith("{") | raw.startswith("["), inner).otherwise(raw).alias(column)

    return joined.select("raw_id", "file_no", "line_no", *[value(c) for c in columns])
