"""Queries of the training-text operators."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acequia.llm.boilerplate import find_boilerplate, main_body
from acequia.llm.contamination import find_contamination
from acequia.llm.encode import encode_corpus
from acequia.llm.entity_match import match_entities
from acequia.llm.incremental_dedup import PostingHistory
from acequia.llm.pii import mask, replacements, surrogates
from acequia.llm.residue import find_residue, without_residue
from acequia.llm.scan_repair import find_damage, repair
from acequia.session import broadcast_if_small, state_path, table


#: The landed files are accepted in so many batches, in order of file_no.
BATCHES = 2


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of files in order of landing; those already in the table's history aren't accepted again."""
    jobs = table(spark, sf_dir, "jobs")
    files = table(spark, sf_dir, "origin_files").groupBy("origin_file").agg(F.min("file_no").alias("file_no"))
    history = PostingHistory(spark, state_path(spark, "postings", jobs))
    last = files.agg(F.max("file_no")).first()[0] or 0
    placed = jobs.join(broadcast_if_small(files), "origin_file", "left").withColumn("file_no", F.coalesce("file_no", F.lit(last)))
    for i in range(BATCHES):
        low, high = i * last // BATCHES, (i + 1) * last // BATCHES
        history.add(placed.where((F.col("file_no") > low if i else F.lit(True)) & (F.col("file_no") <= high)), name=f"{low:08d}-{high:08d}")
    return history.repeats()


#: The fields of each problem: table and column.
PERSONAL = [("person_profiles", "about"), ("posts_feed", "text"), ("job_details", "description")]
PAGES = [("person_profiles", "text_ocr"), ("job_details", "text_ocr"), ("posts_companies", "text")]
SCANS = [("job_details", "text_ocr"), ("person_profiles", "text_ocr"), ("company_profiles", "text_ocr")]
#: The setting that holds the key of the surrogates; without it an application draws one of
#: its own, so that its replacements can't be told from outside.
KEY_SETTING = "spark.acequia.surrogate.key"
_OWN_KEY = os.urandom(32)


def _secret(spark: SparkSession) -> bytes:
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else _OWN_KEY


def _texts(spark: SparkSession, sf_dir: str, fields: list[tuple[str, str]]) -> DataFrame:
    """(table_name, ingest_seq, text) of several tables' fields."""
    parts = [
        table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), "ingest_seq", F.col(c).alias("text")) for t, c in fields
    ]
    return reduce(DataFrame.unionByName, parts)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replacements(_texts(spark, sf_dir, PERSONAL), _secret(spark))
    return found.select("table_name", "ingest_seq", "kind", "start_pos", "end_pos")


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(_texts(spark, sf_dir, PERSONAL))


def p3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates(_texts(spark, sf_dir, PERSONAL), _secret(spark))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_boilerplate(_texts(spark, sf_dir, PAGES))


def p4_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_body(_texts(spark, sf_dir, PAGES))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_damage(_texts(spark, sf_dir, SCANS))


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(_texts(spark, sf_dir, SCANS))


def p7_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_entities(table(spark, sf_dir, "listing_jobs"), table(spark, sf_dir, "jobs"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_scored(spark, sf_dir).select("ingest_seq", "listing_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_residue(table(spark, sf_dir, "documents")).select("doc_id")


def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_residue(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source")


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_masked": p3_masked,
    "p3_surrogates": p3_surrogates,
    "p4_found": p4_found,
    "p4_body": p4_body,
    "p6_found": p6_found,
    "p6_repaired": p6_repaired,
    "p7_found": p7_found,
    "p7_scored": p7_scored,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p10_found": p10_found,
    "p10_kept": p10_kept,
}
