"""Queries of the general data-preparation operators (timestamps, drifting schemas)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acequia.operators.schema_drift import TARGETS, schema_changes, unified_records
from acequia.operators.timestamps import TimestampDictionary, normalise_times
from acequia.session import state_path, table

#: The columns of ``jobs`` that a raw file can fill.
RECORD_COLUMNS = [
    "type", "source", "search_keyword", "title", "company", "companyName", "location", "url", "job_url",
    "applyUrl", "external_id", "jobId", "posted_date", "postedDate", "scraped_at", "text_ocr", "is_valid",
]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of the table's files stays: a second run parses nothing."""
    jobs, files = table(spark, sf_dir, "jobs"), table(spark, sf_dir, "origin_files")
    dictionary = TimestampDictionary(spark, state_path(spark, "times", jobs, files))
    return normalise_times(jobs, files, dictionary)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "raw_job_records"), table(spark, sf_dir, "origin_files"))


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unified_records(table(spark, sf_dir, "raw_job_records"), table(spark, sf_dir, "origin_files"), RECORD_COLUMNS)


def _filled(column: str) -> str:
    names = TARGETS.get(column, [])
    if not names:
        return f"cast(null as varchar) as {column}"
    return f"max(t) filter (k in ({', '.join(repr(n.lower()) for n in names)})) as {column}"


#: A value's text; of an object or list that wraps it the value inside.
P5_UNIFIED_SQL = f"""
with ok as (select raw_id, file_no, line_no, payload from raw_job_records where json_valid(payload) and json_type(payload) = 'OBJECT'),
kv as (
  select raw_id, lower(e.key) as k,
         case json_type(e.value) when 'OBJECT' then coalesce(e.value ->> '$.id', json_extract_string(e.value, '$.*')[1]) when 'ARRAY' then e.value ->> 0 else e.value ->> '$' end as t
  from ok, json_each(payload) as e)
select ok.raw_id, ok.file_no, ok.line_no, {', '.join(_filled(c) for c in RECORD_COLUMNS)}
from ok left join kv on kv.raw_id = ok.raw_id group by all
"""

QUERIES = {"p1_found": p1_found, "p5_found": p5_found, "p5_unified": p5_unified}

ORACLE = {"p5_unified": P5_UNIFIED_SQL}
