"""The engine's own runs: consolidation, full run over landed data, job search, analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acequia.config import EngineConfig, Site
from acequia.functions.predicates import validate
from acequia.functions.scalars import stable_id, truthy, url_light
from acequia.operators.aggregate import cap, frequency, union_all
from acequia.operators.dedup import dedup_all, dedup_jobs, dedup_stats, dedup_urls, first_seen, most_enriched
from acequia.operators.enrich import text_enrich
from acequia.operators.listing import response_records
from acequia.schema import CONSOLIDATED_FIELDS
from acequia.session import broadcast_if_small
from acequia.sources import readers, sinks


def consolidate(records: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """One record per address (or id, without one), by the most-enriched fold."""
    return most_enriched(records, F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("id")), order)


def consolidate_files(spark: SparkSession, guest: str | None = None, tool: str | None = None, contacts: str | None = None, envelope: str | None = None) -> DataFrame:
    """Four kinds of landed files, in this order, read, joined and consolidated."""
    given = [(readers.read_guest, guest), (readers.read_tool, tool), (readers.read_contacts, contacts), (readers.read_envelope, envelope)]
    frames = [read(spark, path) for read, path in given if path]
    if not frames:
        raise ValueError("no files were given")
    both = union_all(*frames)
    # the place of a record: kind of file, file by name, position; files of one kind share a rank
    files = both.select("source_rank", "file").distinct()
    from pyspark.sql import window as W

    ranked = files.withColumn("file_rank", F.row_number().over(W.Window.partitionBy("source_rank").orderBy("file")))
    seq = F.col("source_rank").cast("bigint") * F.lit(1 << 56) + F.col("file_rank") * F.lit(1 << 36) + F.col("pos")
    return consolidate(both.join(ranked, ["source_rank", "file"]).withColumn("ingest_seq", seq))


def collected_records(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Job rows and company rows in the consolidated columns, companies after all jobs."""
    url = url_light(truthy(F.col("job_url"), F.col("applyUrl"), F.col("url")))
    external = truthy(F.trim("external_id"), F.col("jobId"))
    text = lambda *cs: truthy(*[F.col(c) for c in cs])
    j = jobs.select(
        F.col("ingest_seq"), stable_id(url, external).alias("id"), F.lit("job").alias("type"), text("source").alias("source"), text("search_keyword").alias("search_keyword"),
        text("title").alias("title"), text("company", "companyName").alias("company"), text("location").alias("location"), url.alias("url"), external.alias("external_id"),
        text("posted_date", "postedDate").alias("posted_date"), text("scraped_at").alias("scraped_at"), text("origin_date").alias("origin_date"),
        text("origin_file").alias("origin_file"), text("text_ocr").alias("text_ocr"), text("is_valid").alias("is_valid"),
    )
    curl = url_light(truthy(F.col("url")))
    c = companies.select(
        (F.col("ingest_seq") + F.lit(1 << 40)).alias("ingest_seq"), stable_id(curl, text("name")).alias("id"), F.lit("company").alias("type"), text("source").alias("source"),
        F.lit("").alias("search_keyword"), text("name").alias("title"), text("name").alias("company"), F.lit("").alias("location"), curl.alias("url"),
        text("external_id").alias("external_id"), F.lit("").alias("posted_date"), text("scraped_at").alias("scraped_at"), F.lit("").alias("origin_date"),
        F.lit("").alias("origin_file"), text("text_ocr").alias("text_ocr"), F.lit("").alias("is_valid"),
    )
    return j.unionByName(c)


@dataclass(frozen=True)
class RunOptions:
    """Which stages of a full run take part."""

    texts: bool = True
    dedup: bool = True
    validate: bool = True
    export: bool = True


def full_run(items: DataFrame, texts: DataFrame | None, folder: str | None, stamp: str, config: EngineConfig = EngineConfig(), options: RunOptions = RunOptions()) -> dict[str, DataFrame]:
    """Landed items of all categories to deliverables.

    items: UNIFIED_ITEM fields with category and ingest_seq. Gives the frames of each stage:
    enriched, deduped (with ``bucket``), valid and stats.
    """
    rows = text_enrich(items, texts, "url", config.text_enrich_cap, "ingest_seq") if options.texts and texts is not None else items
    out = {"enriched": rows}
    deduped = dedup_all(rows, config.name_threshold) if options.dedup else rows.withColumn("bucket", F.col("category"))
    out["deduped"] = deduped
    out["stats"] = dedup_stats(rows, deduped.withColumn("category", F.col("bucket")))
    checked = deduped.drop("validation")
    out["valid"] = validate(checked.withColumn("category", F.col("bucket")), primary=config.primary, secondary=config.secondary, hashtags=config.hashtags) if options.validate else checked
    if options.export and folder:
        sinks.export_all(out["valid"].withColumn("category", F.col("bucket")), folder, stamp)
    return out


def job_search(responses: DataFrame, key: str, text: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Responses of a search to distinct openings, the richest first (``score``)."""
    rows = response_records(responses, key, text, config.site)
    rows = rows.withColumn("ingest_seq", F.col(key).cast("bigint") * F.lit(1 << 20) + F.col("pos"))
    return dedup_jobs(rows)


def analyse(records: DataFrame, order: str = "ingest_seq") -> dict[str, DataFrame]:
    """Rows per search keyword, the ten most frequent places, and the first five rows."""
    return {
        "by_keyword": frequency(records, "search_keyword", order),
        "top_places": frequency(records, "location", order, top=10),
        "head": cap(records, 5, order),
    }


def legacy_run(items: DataFrame) -> DataFrame:
    """First seen by address within every category (the two-channel runner)."""
    out = None
    for (c,) in [(x,) for x in ("jobs", "people", "posts_feed", "posts_companies", "company_search", "authors")]:
        part = dedup_urls(items.where(F.col("category") == c))
        out = part if out is None else out.unionByName(part)
    return out


#: Rows of each kind whose pages are looked at, and companies whose posts are (fixed values of the standard run).
PAGE_CAPS = {"company": 10, "job": 30, "person": 20, "posts": 5}


def routed_pages(companies: DataFrame, jobs: DataFrame, people: DataFrame, pages: DataFrame, caps: dict[str, int] | None = None, site: Site = Site(), order: str = "ingest_seq") -> DataFrame:
    """(bucket, type, name, external_id, url, text_ocr): delivered pages as records of four buckets.

    The first rows of each kind name the pages: a company's about page and, for the first
    few, its posts; a posting's and a person's own address. Caps come before repeats go.
    Only pages delivered with status 200 give a record; of pages with one address the first
    by text counts. Companies without slug, postings without address and people without
    user name name no page.
    """
    n = PAGE_CAPS | (caps or {})
    tail = lambda u: F.element_at(F.split(F.regexp_replace(u, "/+$", ""), "/"), -1)
    said = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(""))

    c = cap(companies, n["company"], order).withColumn("_key", F.when(said(F.col("url")) != "", tail(F.col("url"))).otherwise(said(F.col("external_id"))))
    c = first_seen(c.where("_key <> ''"), F.col("_key"), order)
    page = lambda kind: F.concat(F.lit(f"{site.host}/company/"), F.col("_key"), F.lit(f"/{kind}"))
    row = lambda bucket, kind, name, url: [F.lit(bucket).alias("bucket"), F.lit(kind).alias("type"), name.alias("name"), F.col("_key").alias("external_id"), url.alias("url")]
    about = c.select(*row("company_profiles", "company_profile", F.coalesce("name", "_key"), page("about")))
    posts = cap(c, n["posts"], order).select(*row("posts_companies", "post_company", F.col("_key"), page("posts")))
    j = cap(jobs, n["job"], order).withColumn("_u", truthy(F.col("url"), F.col("job_url"), F.col("applyUrl"))).where("_u <> ''")
    j = first_seen(j.withColumn("_key", F.coalesce(F.nullif("external_id", F.lit("")), tail(F.col("_u")))), F.col("_key"), order)
    details = j.select(*row("job_details", "job_detail", said(F.col("title")), F.col("_u")))
    p = cap(people, n["person"], order).where("url like '%/in/%'")
    p = p.withColumn("_key", F.element_at(F.split(F.regexp_replace("url", "/+$", ""), "/in/"), -1)).where("_key <> ''")
    profiles = first_seen(p, F.col("_key"), order).select(*row("person_profiles", "person_profile", said(F.col("name")), F.col("url")))
    wanted = about.unionByName(posts).unionByName(details).unionByName(profiles)
    delivered = pages.where("status = 200").groupBy("url").agg(F.min(F.coalesce("text", F.lit(""))).alias("text_ocr"))
    return delivered.join(broadcast_if_small(wanted), "url").select("bucket", "type", "name", "external_id", "url", "text_ocr")


__all__ = ["routed_pages", "CONSOLIDATED_FIELDS", "RunOptions", "analyse", "collected_records", "consolidate", "consolidate_files", "full_run", "job_search", "legacy_run"]
