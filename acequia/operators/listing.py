"""Listing texts and tool responses turned into records (survey T1-T6, J1).

The walks depend on state, so they run in Python over one text at a time; everything
around them (splitting, filtering by kind, joins) is columnar.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acequia.config import Site
from acequia.functions.predicates import NOISE, PLACE_MARKERS, RELATIVE_DATE, STOP_LINES, references_of
from acequia.functions.scalars import absolute_url, username_in

_NOISE = re.compile(f"(?:{NOISE})", re.I)
_DATE = re.compile(RELATIVE_DATE, re.I)
_SUFFIX = re.compile(r"\s+with verification$")
LISTING_SCHEMA = "pos int, title string, companyName string, location string, postedDate string"
MERGED_SCHEMA = LISTING_SCHEMA + ", jobId bigint, applyUrl string"


def _noise(line: str) -> bool:
    return not line.strip() or bool(_NOISE.match(line.strip()))


def _place(line: str) -> bool:
    return any(m in line for m in PLACE_MARKERS)


def _date(line: str) -> bool:
    return bool(_DATE.match(line.strip()))


def content_lines(text: str, foot: str) -> list[str]:
    """The lines of a listing up to its end, without noise."""
    out = []
    for line in (x.strip() for x in text.split("\n")):
        if not line:
            continue
        if line in STOP_LINES or len(line) > 200 or re.match(r"\d+\s+\d+\s+\d+", line) or foot in line:
            break
        out.append(line)
    return [x for x in out if not _noise(x)]


def parse_listing(text: str | None, site: Site = Site()) -> list[tuple[str, str, str, str]]:
    """(title, company, place, date) of each opening in a listing's text.

    A record is a title, maybe the title again, then a company unless the line is a place or
    a date, then a place and a date. The last line starts no record; a date line without a
    company before it becomes a title.
    """
    lines = content_lines(text or "", site.foot)
    if lines and " en " in lines[0].lower() and "argentina" in lines[0].lower():
        lines = lines[1:]
    at = lambda k: lines[k] if k < len(lines) else None
    out, i = [], 0
    while i < len(lines) - 1:
        title = lines[i]
        if at(i + 1) in (title, f"{title} with verification"):
            i += 1
        after, company, place, date = at(i + 1), "", "", ""
        if after and not _place(after) and not _date(after):
            company, i = after, i + 2
            third = at(i)
            if third is not None and _place(third):
                place, i = third, i + 1
                if at(i) is not None and _date(at(i)):
                    date, i = at(i), i + 1
            elif third is not None and _date(third):
                date, i = third, i + 1
        elif after and _place(after):
            place, i = after, i + 2
        else:
            i += 1
        if len(title) < 100 and not _noise(title):
            out.append((title, company, place, date))
    return out


def merge_response(text: str | None, site: Site = Site()) -> list[tuple] | None:
    """The openings of one response, from its text, references and ids.

    Rows of the text get the reference of the same title, else the first with a title that
    is a prefix of theirs or the other way round and whose id is free; ids left over go to
    rows without one by position; ids no row has come as rows of their own, then references.
    None where the response is no JSON object or holds nothing.
    """
    try:
        data = json.loads(text or "")
    except ValueError:
        return None
    if not isinstance(data, dict):
        return None
    key = lambda t: _SUFFIX.sub("", (t or "").lower().strip())
    titled: dict[str, tuple] = {}
    for ref in (data.get("references") or {}).get("search_results") or []:
        url = ref.get("url") or ""
        if ref.get("kind") == "job" and url:
            steps = url.strip("/").split("/")
            number = steps[2] if len(steps) >= 3 and steps[:2] == ["jobs", "view"] else ""
            titled[key(ref.get("text"))] = (ref.get("text") or "", int(number) if number.isdigit() else None, site.host + url)
    ids = [int(x) for x in data.get("job_ids") or [] if str(x).isdigit()]
    used: set[int] = set()
    rows: list[list] = []
    for title, company, place, date in parse_listing((data.get("sections") or {}).get("search_results"), site):
        k = key(title)
        ref = titled.get(k) or next((r for n, r in titled.items() if (n.startswith(k) or k.startswith(n)) and r[1] and r[1] not in used), None)
        row = [title, company, place, date, None, None]
        if ref and ref[1] and ref[1] not in used:
            used.add(ref[1])
            row[4:] = ref[1], ref[2]
            if "with verification" in title and "with verification" not in ref[0]:
                row[0] = ref[0]
        rows.append(row)
    view = lambda n: f"{site.host}/jobs/view/{n}"
    free = (n for n in ids if n not in used)
    for row, n in zip((r for r in rows if r[4] is None), free):
        row[4:] = n, view(n)
    known = {r[4] for r in rows if r[4]}
    rows += [["", "", "", "", n, view(n)] for n in ids if n not in known]
    rows += [[t, "", "", "", n, u] for t, n, u in titled.values() if n and n not in known]
    return [tuple(r) for r in rows] or None


def _exploded(df: DataFrame, key: str, text: str, walk, schema: str) -> DataFrame:
    kind = dict(df.dtypes)[key]
    names = [key] + [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *r) for k, x in zip(pdf["k"], pdf["t"]) for i, r in enumerate(walk(x) or [])]
            yield pd.DataFrame(rows, columns=names).astype({"jobId": "Int64"} if "jobId" in names else {})

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, {schema}")


def listing_records(df: DataFrame, key: str, text: str, site: Site = Site()) -> DataFrame:
    """T1 over a table: one row per opening, ``pos`` its place."""
    return _exploded(df, key, text, lambda x: parse_listing(x, site), LISTING_SCHEMA)


def response_records(df: DataFrame, key: str, text: str, site: Site = Site()) -> DataFrame:
    """J1 over a table of responses."""
    return _exploded(df, key, text, lambda x: merge_response(x, site), MERGED_SCHEMA)


def response_of(text: Column) -> Column:
    """A response parsed; text that is no JSON becomes the section "raw"."""
    from acequia.schema import RESPONSE

    parsed = F.from_json(text, RESPONSE)
    raw = F.struct(F.create_map(F.lit("raw"), text).alias("sections"), parsed["references"].alias("references"), parsed["job_ids"].alias("job_ids"))
    return F.when(F.expr("try_parse_json(%s) is null" % text._jc.toString()), raw).otherwise(parsed)


def section_text(response: Column) -> Column:
    """All sections of a response, joined."""
    return F.array_join(F.map_values(response["sections"]), "\n")


def reference_rows(df: DataFrame, key: str, refs: Column, kind: str, path: str = "", site: Site = Site()) -> DataFrame:
    """One row per reference of a kind: name, absolute address, user name."""
    hits = df.select(key, F.posexplode(references_of(refs, kind, path)).alias("pos", "r"))
    url = absolute_url(F.col("r.url"), site)
    return hits.select(key, "pos", F.col("r.text").alias("name"), url.alias("url"), username_in(F.col("r.url")).alias("external_id"))


def people_of_text(text: Column) -> Column:
    """The lines that may be people's names."""
    from acequia.functions.predicates import is_person_line

    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & is_person_line(x))


def authors_of_text(text: Column, host: str = r"(?:www\.)?vinculared\.example") -> Column:
    """T4: distinct profile addresses in a text, in order."""
    hits = F.regexp_extract_all(text, F.lit(rf"(https?://{host}/in/[A-Za-z0-9_-]+)/?"), F.lit(1))
    return F.array_distinct(hits)


def posts_of_text(text: Column, host: str = r"www\.vinculared\.example") -> Column:
    """T5: distinct post addresses in a text, in order, queries cut."""
    rx = rf"""(https?://{host}/(?:feed/update/urn:li:|posts/)[^\s\)"'<>]+)"""
    cut = F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(1)), lambda u: F.split_part(u, F.lit("?"), F.lit(1)))
    return F.array_distinct(cut)


def pair_people(text: str | None, site: Site = Site()) -> list[tuple[str, str, str]]:
    """(name, headline, place): a line with the headline after it, if that begins like one.

    A pair takes two lines, so its place line comes again as a name.
    """
    lines = content_lines(text or "", site.foot)
    out, i = [], 0
    while i < len(lines):
        headed = i + 1 < len(lines) and lines[i + 1].startswith(("Ingenier", "Software", "Developer"))
        place = lines[i + 2] if headed and i + 2 < len(lines) and _place(lines[i + 2]) else ""
        out.append((lines[i], lines[i + 1] if headed else "", place))
        i += 2 if headed else 1
    return out


def people_records(df: DataFrame, key: str, text: str, site: Site = Site()) -> DataFrame:
    """T6 over a table."""
    return _exploded(df, key, text, lambda x: pair_people(x, site), "pos int, name string, headline string, location string")
