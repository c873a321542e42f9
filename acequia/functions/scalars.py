"""Column functions: addresses, names, ids, flattening and cells (survey P1-P25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acequia.config import Site
from acequia.schema import CATEGORY_COLUMNS, CELL_ALIASES


def truthy(*cs: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cs], F.lit(""))


def present(*cs: Column) -> Column:
    """The first that isn't null (an empty one counts), else ''."""
    return F.coalesce(*[c.cast("string") for c in cs], F.lit(""))


def url_key(url: Column) -> Column:
    """The address as a key. Slashes at the end go first, then query and fragment."""
    bare = F.regexp_replace(url, "/+$", "")
    return F.lower(F.split_part(F.split_part(bare, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)))


def url_light(url: Column) -> Column:
    """Without end slashes and query; case and fragment stay."""
    return F.split_part(F.regexp_replace(url, "/+$", ""), F.lit("?"), F.lit(1))


def name_key(name: Column) -> Column:
    """Lower case, white space trimmed and collapsed (all Unicode white space)."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def text_key(text: Column) -> Column:
    """Lower case, trimmed."""
    return F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", "")


def stable_id(url: Column, job_id: Column | None = None) -> Column:
    """P5: twelve hex digits of the md5 of the posting's id, else of its light address."""
    key = F.coalesce(F.nullif(job_id, F.lit("")), url_light(url)) if job_id is not None else url_light(url)
    return F.substring(F.md5(key.cast("binary")), 1, 12)


def job_id_in(url: Column) -> Column:
    """P6."""
    return F.regexp_extract(url, r"/jobs/view/(\d+)", 1)


def username_in(url: Column) -> Column:
    """P7."""
    return F.regexp_extract(url, r"/in/([^/?#]+)", 1)


def slug_in(url: Column) -> Column:
    """P8."""
    return F.regexp_extract(url, r"/company/([^/?#]+)", 1)


def item_job_id(job_id: Column, external_id: Column, url: Column) -> Column:
    """The id field, else the external id, else the one in the address."""
    return truthy(job_id, external_id, job_id_in(url))


def tail_segment(url: Column) -> Column:
    """P10: what follows the last slash; a query stays."""
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def absolute_url(url: Column, site: Site = Site()) -> Column:
    """Relative addresses get the host."""
    return F.when(url.startswith("/"), F.concat(F.lit(site.host), url)).otherwise(url)


def with_person_url(df: DataFrame) -> DataFrame:
    """Fills url from profile_url, and external_id where it is null."""
    url = truthy(F.col("url"), F.col("profile_url"))
    return df.withColumn("url", url).withColumn("external_id", F.coalesce("external_id", username_in(F.col("url"))))


def with_post_url(df: DataFrame) -> DataFrame:
    return df.withColumn("url", truthy(F.col("url"), F.col("post_url")))


def _col(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def valid_text(df: DataFrame) -> Column:
    """The verdict as "True", "False" or ''; a nested one goes before a flat one."""
    nested = F.col("validation.is_valid") if "validation" in df.columns else F.lit(None).cast("boolean")
    return F.coalesce(F.initcap(nested.cast("string")), F.nullif(_col(df, "is_valid").cast("string"), F.lit("")), F.lit(""))


def flatten(df: DataFrame, *keep) -> DataFrame:
    """The twelve unified columns of items with any of the known fields, after ``keep``."""
    c = lambda *names: truthy(*[_col(df, n) for n in names])
    return df.select(
        *keep,
        c("type").alias("type"), c("source").alias("source"), c("search_keyword").alias("search_keyword"),
        c("title", "name").alias("title"), c("company", "company_name").alias("company"), c("location").alias("location"),
        c("url", "job_url", "profile_url", "post_url", "applyUrl").alias("url"),
        c("external_id", "jobId", "username", "slug").alias("external_id"),
        c("posted_date", "postedDate").alias("posted_date"), c("scraped_at").alias("scraped_at"),
        c("text_ocr").alias("text_ocr"), valid_text(df).alias("is_valid"),
    )


def cell(df: DataFrame, column: str, limit: int = 32_000, suffix: str = "…[truncated]") -> Column:
    """A sheet's cell: the field or its first alias that isn't null, as text."""
    names = [column, *CELL_ALIASES.get(column, [])]
    kinds = dict(df.dtypes)
    as_text = [
        (F.to_json(F.col(n), {"ignoreNullFields": "false"}) if kinds[n].startswith(("struct", "array", "map")) else F.col(n).cast("string"))
        for n in names
        if n in kinds
    ]
    return truncate_cell(F.coalesce(*as_text, F.lit("")), limit, suffix)


def truncate_cell(c: Column, limit: int = 32_000, suffix: str = "…[truncated]") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(suffix))).otherwise(c)


def category_sheet(df: DataFrame, category: str) -> DataFrame:
    """The columns of a category's sheet, in order."""
    return df.select(*[cell(df, c).alias(c) for c in CATEGORY_COLUMNS[category]])


def without_verification(title: Column) -> Column:
    """P18."""
    return F.regexp_replace(F.lower(F.trim(title)), r"\s+with verification$", "")


def origin_date_of(file_stem: Column) -> Column:
    """The second part of a file's stem."""
    return F.split_part(file_stem, F.lit("_"), F.lit(2))


def numeric_ids(ids: Column) -> Column:
    """P20: the all-digit ids as numbers."""
    return F.transform(F.filter(ids, lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("bigint"))


def detail_record(sections: Column, kind: str, key: Column, site: Site = Site()) -> Column:
    """A detail record from a response's sections; kind is job, person or company."""
    s = lambda *names: truthy(*[F.try_element_at(sections, F.lit(n)) for n in names])
    path = {"job": "/jobs/view/", "person": "/in/", "company": "/company/"}[kind]
    made = F.when(key != "", F.concat(F.lit(site.host + path), key, F.lit("/about/" if kind == "company" else "/"))).otherwise("")
    url = F.coalesce(F.nullif(s("url"), F.lit("")), made).alias("url")
    fields = {
        "job": [s("title").alias("title"), s("company").alias("company"), s("location").alias("location"), s("description", "details").alias("description")],
        "person": [s("name").alias("name"), s("headline").alias("headline"), s("about", "summary").alias("about"), s("experience").alias("experience"), s("education").alias("education")],
        "company": [s("name").alias("name"), s("tagline", "slogan").alias("tagline"), s("industry").alias("industry"), s("company_size", "size").alias("size"), s("about", "description").alias("about")],
    }[kind]
    return F.struct(*fields, url, key.alias("external_id"))


def keyword_list(text: Column) -> Column:
    """A comma list with its parts trimmed; without a comma the text as it is."""
    return F.when(text.contains(","), F.transform(F.split(text, ","), lambda x: F.trim(x))).otherwise(F.array(text))


def percent_removed(before: Column, after: Column) -> Column:
    """Whole percent, halves to even, '' where nothing was there."""
    share = (before - after) * 100.0 / before
    return F.when(before > 0, F.concat(F.bround(share, 0).cast("bigint").cast("string"), F.lit("%"))).otherwise("")


def as_json(c: Column) -> Column:
    """P24."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def unwrap(c: Column) -> Column:
    """P25: the text inside a message envelope, else the text as it is."""
    inner = F.coalesce(F.get_json_object(c, "$.content[0].text"), F.get_json_object(c, "$.result.content[0].text"))
    return F.coalesce(inner, c)
