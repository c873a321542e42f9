"""Record schemas: the wide item, the consolidated record and the columns of each category."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, LongType, MapType, StringType, StructField, StructType

_S = StringType()
# Fixed values.
ITEM_STRINGS = [
    "type", "source", "search_keyword", "title", "name", "company", "company_name", "companyName", "location", "url",
    "job_url", "profile_url", "post_url", "applyUrl", "external_id", "username", "slug", "posted_date", "postedDate",
    "scraped_at", "description", "text", "text_ocr", "headline", "about", "experience", "education", "tagline",
    "industry", "size",
]
VALIDATION = StructType(
    [StructField(n, BooleanType()) for n in ("is_valid", "has_primary", "has_context")]
    + [StructField(n, ArrayType(_S)) for n in ("matched_primary", "matched_secondary", "matched_hashtags")]
    + [StructField("reason", _S)]
)
UNIFIED_ITEM = StructType(
    [StructField(n, _S) for n in ITEM_STRINGS] + [StructField("jobId", LongType()), StructField("validation", VALIDATION)]
)
# Fixed values.
CONSOLIDATED_FIELDS = [
    "id", "type", "source", "search_keyword", "title", "company", "location", "url", "external_id", "posted_date",
    "scraped_at", "origin_date", "origin_file", "text_ocr", "is_valid", "_emails", "_telefonos", "_sector",
]
CONSOLIDATED = StructType([StructField(n, _S) for n in CONSOLIDATED_FIELDS])
# Fixed values.
FLAT_COLUMNS = [
    "category", "type", "source", "search_keyword", "title", "company", "location", "url", "external_id", "posted_date",
    "scraped_at", "text_ocr", "is_valid",
]
REFERENCE = StructType([StructField("kind", _S), StructField("url", _S), StructField("text", _S)])
RESPONSE = StructType([
    StructField("sections", MapType(_S, _S)),
    StructField("references", MapType(_S, ArrayType(REFERENCE))),
    StructField("job_ids", ArrayType(_S)),
])

# The columns of each category's sheet.
CATEGORY_COLUMNS = {
    "jobs": FLAT_COLUMNS[1:],
    "job_details": ["type", "source", "title", "company", "location", "url", "external_id", "Description", "posted_date", "scraped_at", "text_ocr", "is_valid"],
    "people": ["type", "source", "name", "headline", "location", "url", "external_id", "scraped_at"],
    "person_profiles": ["type", "source", "name", "headline", "location", "url", "external_id", "experience", "education", "about", "scraped_at", "text_ocr"],
    "posts_feed": ["type", "source", "author", "text", "url", "posted_date", "scraped_at"],
    "posts_companies": ["type", "source", "author", "company_name", "text", "url", "posted_date", "scraped_at"],
    "company_search": ["type", "source", "name", "url", "external_id", "scraped_at"],
    "company_profiles": ["type", "source", "name", "tagline", "industry", "size", "location", "url", "external_id", "scraped_at", "text_ocr"],
    "company_employees": ["type", "source", "name", "role", "connection_degree", "location", "url", "external_id", "scraped_at"],
    "authors": ["type", "source", "name", "url", "post_count", "last_active", "scraped_at"],
}
# Where a sheet column is taken from if the record lacks it.
CELL_ALIASES = {
    "title": ["name"], "name": ["title"], "company": ["company_name"], "Description": ["description", "text_ocr", "text"],
    "experience": ["experience_text"], "education": ["education_text"], "about": ["about_text", "text_ocr", "text"],
    "author": ["author_name", "name"], "text": ["text_ocr"], "url": ["job_url", "profile_url", "post_url", "applyUrl"],
    "external_id": ["jobId", "username", "slug"], "posted_date": ["postedDate"],
}
