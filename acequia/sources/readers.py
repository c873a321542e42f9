"""Landed record files read with explicit schemas (survey S8, S11-S18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from acequia.config import Site
from acequia.functions.scalars import origin_date_of, stable_id, truthy, url_light, valid_text
from acequia.schema import CONSOLIDATED_FIELDS, UNIFIED_ITEM

_STR = StringType()


def _struct(*names: str) -> StructType:
    return StructType([StructField(n, _STR) for n in names])


GUEST = _struct("type", "source", "search_keyword", "title", "company", "location", "posted_date", "job_url", "scraped_at", "external_id", "text_ocr", "is_valid")
TOOL = _struct("title", "companyName", "location", "postedDate", "jobId", "applyUrl", "search_keyword", "scraped_at", "text_ocr", "is_valid")
CONTACTS = _struct("nombre", "sitio_web", "fuente", "fecha", "emails", "telefonos", "sector")
ENVELOPE = StructType([StructField("results", StructType([StructField("jobs", ArrayType(GUEST))]))])


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """(value, file) of whole files; ``file`` is the bare name."""
    return spark.read.text(path, wholetext=True).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))


def _items(files: DataFrame, schema: StructType, picked: Column | None = None) -> DataFrame:
    arr = F.from_json("value", ArrayType(schema)) if picked is None else picked
    return files.select("file", F.posexplode(arr).alias("pos", "r")).select("file", "pos", "r.*")


def _consolidated(df: DataFrame, **columns: Column) -> DataFrame:
    """Items with file and pos brought to the consolidated columns; unnamed ones are ''."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    base = {c: F.lit("") for c in CONSOLIDATED_FIELDS} | {"origin_file": F.col("file"), "origin_date": origin_date_of(stem)} | columns
    return df.select("file", "pos", *[F.coalesce(base[c].cast("string"), F.lit("")).alias(c) for c in CONSOLIDATED_FIELDS])


def read_guest(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of search-page records."""
    df = _items(_whole(spark, path), GUEST)
    url = url_light(truthy(F.col("job_url")))
    return _consolidated(
        df, id=stable_id(truthy(F.col("job_url")), truthy(F.col("external_id"))), type=F.lit("job"), source=truthy(F.col("source"), F.lit("guest_api")),
        search_keyword=F.col("search_keyword"), title=F.col("title"), company=F.col("company"), location=F.col("location"), url=url,
        external_id=F.col("external_id"), posted_date=F.col("posted_date"), scraped_at=F.col("scraped_at"), text_ocr=F.col("text_ocr"), is_valid=valid_text(df),
    )


def read_tool(spark: SparkSession, path: str, site: Site = Site(), missing_id: str = "None") -> DataFrame:
    """JSON arrays of tool records. The address comes from the id; a missing id reads
    ``missing_id`` in both, as in the files this follows."""
    df = _items(_whole(spark, path), TOOL)
    key = F.coalesce(F.col("jobId"), F.lit(missing_id))
    url = url_light(truthy(F.col("applyUrl"), F.concat(F.lit(f"{site.host}/jobs/view/"), key)))
    return _consolidated(
        df, id=stable_id(url, key), type=F.lit("job"), source=F.lit("mcp"), search_keyword=F.col("search_keyword"), title=F.col("title"),
        company=F.col("companyName"), location=F.col("location"), url=url, external_id=key, posted_date=F.col("postedDate"),
        scraped_at=F.col("scraped_at"), text_ocr=F.col("text_ocr"), is_valid=valid_text(df),
    )


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of company contacts."""
    df = _items(_whole(spark, path), CONTACTS)
    url = url_light(truthy(F.col("sitio_web")))
    return _consolidated(
        df, id=stable_id(truthy(F.col("sitio_web")), truthy(F.col("nombre"))), type=F.lit("company"), source=truthy(F.col("fuente")), title=F.col("nombre"), company=F.col("nombre"),
        url=url, scraped_at=F.col("fecha"), _emails=F.col("emails"), _telefonos=F.col("telefonos"), _sector=F.col("sector"),
    )


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    """{metadata, results: {jobs: [..]}} files."""
    df = _items(_whole(spark, path), GUEST, F.from_json("value", ENVELOPE)["results"]["jobs"])
    url = url_light(truthy(F.col("job_url")))
    return _consolidated(
        df, id=stable_id(truthy(F.col("job_url")), truthy(F.col("external_id"))), type=F.lit("job"), source=F.col("source"), search_keyword=F.col("search_keyword"), title=F.col("title"),
        company=F.col("company"), location=F.col("location"), url=url, external_id=F.col("external_id"), posted_date=F.col("posted_date"),
        scraped_at=F.col("scraped_at"), text_ocr=F.col("text_ocr"), is_valid=valid_text(df),
    )


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """One wide item per JSON line, with its place in the file."""
    return spark.read.schema(UNIFIED_ITEM).json(path)


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """The last path by name that fits a pattern."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return max((str(f.getPath()) for f in found), default=None) if found else None


def first_json_line(text: Column) -> Column:
    """The first line of an output that is JSON."""
    return F.get(F.filter(F.split(text, "\n"), lambda x: F.try_parse_json(x).isNotNull()), F.lit(0))


def page_texts(pages: DataFrame) -> DataFrame:
    """Text of the pages that were delivered (url, status, text)."""
    return pages.where("status = 200").select("url", "text")


def read_images(spark: SparkSession, path: str, reader=None) -> DataFrame:
    """(path, text) of image files by a text reader given as bytes -> list of words.

    Without one the text is ''; no reader is shipped.
    """
    import pandas as pd

    @F.pandas_udf("string")
    def words(content: pd.Series) -> pd.Series:
        return content.map(lambda b: " ".join(reader(b)) if reader else "")

    return spark.read.format("binaryFile").load(path).select("path", words("content").alias("text"))
