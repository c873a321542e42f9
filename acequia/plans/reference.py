"""Queries of the engine's record operators over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acequia.functions import predicates as P
from acequia.functions import scalars as S
from acequia.operators import aggregate as A
from acequia.operators import budget as B
from acequia.operators import dedup as D
from acequia.operators import enrich as E
from acequia.operators import listing as L
from acequia.plans.pipeline import collected_records, consolidate, routed_pages
from acequia.session import scratch_path, table
from acequia.sources import html as H
from acequia.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _urls(spark, d):
    return table(spark, d, "jobs").where("job_url is not null").select("ingest_seq", "job_url")


KEY_SQL = "lower(split_part(split_part(rtrim({0}, '/'), '?', 1), '#', 1))"
LIGHT_SQL = "split_part(rtrim({0}, '/'), '?', 1)"


# ------------------------------------------------------------------ scalar functions


@query(f"select ingest_seq, {KEY_SQL.format('job_url')} as key from jobs where job_url is not null")
def url_normalize(spark, d):
    return _urls(spark, d).select("ingest_seq", S.url_key(F.col("job_url")).alias("key"))


@query(f"select ingest_seq, {LIGHT_SQL.format('job_url')} as key from jobs where job_url is not null")
def url_normalize_light(spark, d):
    return _urls(spark, d).select("ingest_seq", S.url_light(F.col("job_url")).alias("key"))


@query(
    f"select ingest_seq, substring(md5(coalesce(nullif(external_id, ''), {LIGHT_SQL.format('job_url')})), 1, 12) as id from jobs where job_url is not null"
)
def stable_id(spark, d):
    j = table(spark, d, "jobs").where("job_url is not null")
    return j.select("ingest_seq", S.stable_id(F.col("job_url"), F.col("external_id")).alias("id"))


@query(r"select ingest_seq, trim(regexp_replace(lower(name), '\s+', ' ', 'g')) as key from person_profiles where name is not null")
def name_normalize(spark, d):
    return table(spark, d, "person_profiles").where("name is not null").select("ingest_seq", S.name_key(F.col("name")).alias("key"))


@query(
    r"""select ingest_seq, regexp_extract(job_url, '/jobs/view/(\d+)', 1) as job_id,
        regexp_extract(job_url, '/in/([^/?#]+)', 1) as username, regexp_extract(job_url, '/company/([^/?#]+)', 1) as slug
        from jobs where job_url is not null"""
)
def id_extract(spark, d):
    u = F.col("job_url")
    return _urls(spark, d).select("ingest_seq", S.job_id_in(u).alias("job_id"), S.username_in(u).alias("username"), S.slug_in(u).alias("slug"))


@query(
    r"""select ingest_seq, coalesce(nullif(cast(jobId as varchar), ''), nullif(external_id, ''), nullif(regexp_extract(coalesce(job_url, ''), '/jobs/view/(\d+)', 1), ''), '') as job_id from jobs"""
)
def item_job_id(spark, d):
    j = table(spark, d, "jobs")
    return j.select("ingest_seq", S.item_job_id(F.col("jobId"), F.col("external_id"), F.coalesce("job_url", F.lit(""))).alias("job_id"))


@query("select ingest_seq, list_extract(string_split(rtrim(job_url, '/'), '/'), -1) as tail from jobs where job_url is not null")
def tail_segment(spark, d):
    return _urls(spark, d).select("ingest_seq", S.tail_segment(F.col("job_url")).alias("tail"))


@query(
    "select ingest_seq, case when starts_with(job_url, '/') then 'https://www.vinculared.example' || job_url else job_url end as url from jobs where job_url is not null"
)
def absolute_url(spark, d):
    return _urls(spark, d).select("ingest_seq", S.absolute_url(F.col("job_url")).alias("url"))


@query(
    """select coalesce(nullif(type,''),'') as type, coalesce(nullif(source,''),'') as source, coalesce(nullif(search_keyword,''),'') as search_keyword,
       coalesce(nullif(title,''),'') as title, coalesce(nullif(company,''),'') as company, coalesce(nullif(location,''),'') as location,
       coalesce(nullif(url,''), nullif(job_url,''), nullif(applyUrl,''), '') as url, coalesce(nullif(external_id,''), cast(jobId as varchar), '') as external_id,
       coalesce(nullif(posted_date,''), nullif(postedDate,''), '') as posted_date, coalesce(nullif(scraped_at,''),'') as scraped_at,
       coalesce(nullif(text_ocr,''),'') as text_ocr, coalesce(nullif(is_valid,''),'') as is_valid from jobs"""
)
def flatten_truthy(spark, d):
    return S.flatten(table(spark, d, "jobs"))


@query(
    """select type, source, coalesce(title, '') as title, coalesce(company, '') as company, coalesce(location, '') as location, coalesce(url, job_url, applyUrl, '') as url,
       coalesce(external_id, cast(jobId as varchar), '') as external_id, coalesce(posted_date, postedDate, '') as posted_date from jobs"""
)
def alias_none_coalesce(spark, d):
    sheet = S.category_sheet(table(spark, d, "jobs"), "jobs")
    return sheet.select("type", "source", "title", "company", "location", "url", "external_id", "posted_date")


@query("select doc_id, case when length(text) > 200 then left(text, 200) || '…[truncated]' else coalesce(text, '') end as text from documents")
def truncate_cell(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", S.cell(docs, "text", 200).alias("text"))


@query("select ingest_seq, regexp_replace(lower(trim(title)), '\\s+with verification$', '') as title from jobs where title is not null")
def strip_verification(spark, d):
    return table(spark, d, "jobs").where("title is not null").select("ingest_seq", S.without_verification(F.col("title")).alias("title"))


@query("select ingest_seq, split_part(origin_file, '_', 2) as origin_date from jobs where origin_file is not null")
def origin_date(spark, d):
    j = table(spark, d, "jobs").where("origin_file is not null")
    return j.select("ingest_seq", S.origin_date_of(F.col("origin_file")).alias("origin_date"))


@query(
    r"""with x as (select ingest_seq, list_filter([external_id, cast(jobId as varchar)], lambda v: v is not null and regexp_full_match(v, '[0-9]+')) as ids from jobs)
        select ingest_seq, array_to_string(list_transform(ids, lambda v: cast(cast(v as bigint) as varchar)), '|') as ids from x where len(ids) > 0"""
)
def numeric_ids(spark, d):
    ids = F.array_compact(F.array("external_id", F.col("jobId").cast("string")))
    out = table(spark, d, "jobs").select("ingest_seq", S.numeric_ids(ids).alias("n"))
    return out.where("size(n) > 0").select("ingest_seq", F.array_join(F.transform("n", lambda x: x.cast("string")), "|").alias("ids"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def json_property(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


# ------------------------------------------------------------------------ predicates

WORDS = (["data", "seo", "web"], ["equipo", "team", "grupo"], ["#hiring", "#empleo"])
_LOW = "lower(coalesce(text, ''))"


def _list_sql(words):
    return "[" + ", ".join("'" + w.lower().lstrip("#") + "'" for w in words) + "]"


def _hits(words):
    return f"list_filter({_list_sql(words)}, lambda k: contains({_LOW}, k))"


_VALID = f"len({_hits(WORDS[0])}) > 0 and (len({_hits(WORDS[1])}) > 0 or len({_hits(WORDS[2])}) > 0)"


@query(
    f"""select doc_id, array_to_string({_hits(WORDS[0])}, '|') as matched_primary, array_to_string({_hits(WORDS[1])}, '|') as matched_secondary,
        array_to_string({_hits(WORDS[2])}, '|') as matched_hashtags from documents where coalesce(text, '') <> ''"""
)
def keyword_matches(spark, d):
    docs = table(spark, d, "documents").where("coalesce(text, '') <> ''")
    v = docs.select("doc_id", P.intent(F.col("text"), *WORDS).alias("v"))
    return v.select("doc_id", *[F.array_join(f"v.{m}", "|").alias(m) for m in ("matched_primary", "matched_secondary", "matched_hashtags")])


@query(f"select doc_id, source from documents where coalesce(text, '') <> '' and {_VALID}")
def intent_filter(spark, d):
    docs = table(spark, d, "documents")
    return P.validate(docs, primary=WORDS[0], secondary=WORDS[1], hashtags=WORDS[2]).select("doc_id", "source")


@query(f"select doc_id, source as category from documents where source in ('people', 'company_profiles') or (coalesce(text, '') <> '' and {_VALID})")
def intent_scope_exempt(spark, d):
    docs = table(spark, d, "documents").withColumn("category", F.col("source"))
    return P.validate(docs, primary=WORDS[0], secondary=WORDS[1], hashtags=WORDS[2]).select("doc_id", "category")


@query(
    f"""with v as (select source, coalesce(text, '') <> '' and {_VALID} as ok from documents),
        c as (select source as category, count(*) as before, count(*) filter (where ok) as after from v group by source)
        select category, before, after, before - after as removed, cast(cast(round_even((before - after) * 100.0 / before, 0) as bigint) as varchar) || '%' as pct from c
        union all select 'TOTAL', sum(before)::bigint, sum(after)::bigint, sum(before - after)::bigint, '' from c"""
)
def intent_stats(spark, d):
    docs = table(spark, d, "documents").withColumn("category", F.col("source"))
    kept = P.validate(docs, keep_unchecked=False, primary=WORDS[0], secondary=WORDS[1], hashtags=WORDS[2])
    return D.dedup_stats(docs, kept)


@query("select doc_id, kw from documents join (values ('data'), ('seo'), ('kotlin'), ('remota'), ('hiring')) t(kw) on contains(lower(text), lower(kw))")
def keyword_theta_join(spark, d):
    words = spark.createDataFrame([("data",), ("seo",), ("kotlin",), ("remota",), ("hiring",)], "kw string")
    return E.keyword_hits(table(spark, d, "documents"), "doc_id", "text", words)


_LINES = "lines as (select doc_id, unnest(range(len(ls))) as pos, unnest(ls) as raw from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null))"
_TRIM = r"regexp_replace(raw, '^ +| +$', '', 'g')"


@query(
    rf"""with {_LINES} select doc_id, pos, raw as line from lines
        where not (trim(raw) = '' or regexp_matches(lower(trim(raw)), '^(\d+\s*resultados?$|crear alerta|visto$|promocionado$|descartar|acerca|más$)'))"""
)
def line_noise_filter(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    kept = lines.where(~P.is_noise(F.col("line")) & ~F.lower(F.trim("line")).startswith("acerca"))
    return kept.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


_STOPS = ", ".join("'" + s + "'" for s in P.STOP_LINES)


@query(
    rf"""with {_LINES}, t as (select doc_id, pos, trim(raw) as line from lines where trim(raw) <> ''),
        s as (select *, min(pos) filter (where line in ({_STOPS}) or length(line) > 200 or regexp_matches(line, '^\d+\s+\d+\s+\d+') or contains(line, 'Vinculared Corporation'))
              over (partition by doc_id) as stop from t)
        select doc_id, pos, line from s where stop is null or pos < stop"""
)
def line_stop_marker(spark, d):
    out = P.listing_lines(table(spark, d, "documents"), "doc_id", "text")
    return out.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


@query(
    r"""select ingest_seq, regexp_matches(trim(coalesce(postedDate, '')), '^[Hh][Aa][Cc][Ee]\s+\d+\s+([Dd][ÍíI]?[íÍ]?[Aa]|[Ss][Ee][Mm][Aa][Nn][Aa]|[Mm][Ee][Ss])') as is_date,
        coalesce(list_bool_or([contains(location, m) for m in ['Argentina', 'Buenos Aires', 'Provincia', 'Ciudad Autónoma', 'y alrededores', 'En remoto', 'Presencial', 'Híbrido', 'América Latina']]), false) as is_place
        from jobs where location is not null"""
)
def line_kinds(spark, d):
    j = table(spark, d, "jobs").where("location is not null")
    return j.select("ingest_seq", P.is_relative_date(F.coalesce("postedDate", F.lit(""))).alias("is_date"), P.is_place(F.col("location")).alias("is_place"))


# --------------------------------------------------------------------- de-duplication


@query(f"select ingest_seq, job_url from jobs where coalesce(job_url, '') <> '' qualify row_number() over (partition by {KEY_SQL.format('job_url')} order by ingest_seq) = 1")
def url_dedup_first_seen(spark, d):
    j = table(spark, d, "jobs").where("coalesce(job_url, '') <> ''")
    return D.dedup_urls(j).select("ingest_seq", "job_url")


@query(
    f"""select ingest_seq, job_url from jobs where coalesce(job_url, '') = ''
        union all (select ingest_seq, job_url from jobs where job_url <> '' qualify row_number() over (partition by {KEY_SQL.format('job_url')} order by ingest_seq) = 1)"""
)
def url_dedup_blank_passthrough(spark, d):
    return D.dedup_urls(table(spark, d, "jobs")).select("ingest_seq", "job_url")


@query("select doc_id, source from documents where text <> '' qualify row_number() over (partition by text order by doc_id) = 1")
def text_dedup_first_seen(spark, d):
    docs = table(spark, d, "documents").where("text <> ''")
    return D.first_seen(docs, F.col("text"), "doc_id").select("doc_id", "source")


@query(
    f"""with f as (select ingest_seq, {KEY_SQL.format("coalesce(nullif(job_url, ''), nullif(applyUrl, ''), '')")} as k, coalesce(text_ocr, '') <> '' as t, coalesce(is_valid, '') <> '' as v from jobs),
        g as (select k, min(ingest_seq) as first_seq, list_reduce(list(struct_pack(seq := ingest_seq, t := t, v := v) order by ingest_seq),
              lambda e, r: case when (r.t and not e.t) or (r.v and not e.v) then r else e end) as h from f where k <> '' group by k)
        select h.seq as ingest_seq, first_seq, j.title from g join jobs j on j.ingest_seq = h.seq"""
)
def fold_most_enriched(spark, d):
    j = table(spark, d, "jobs").withColumn("k", S.url_key(S.truthy(F.col("job_url"), F.col("applyUrl"))))
    return D.most_enriched(j.where("k <> ''"), F.col("k")).select("ingest_seq", "first_seq", "title")


@query(
    """with k as (select *, case when jobId is not null and jobId <> 0 then 'id:' || jobId else 't:' || coalesce(title, '') || '|' || coalesce(companyName, '') end as key from jobs),
       f as (select * from k qualify row_number() over (partition by key order by ingest_seq) = 1),
       c as (select * from f where coalesce(title, '') not in ('Accesibilidad', 'Centro de ayuda', 'Privacidad y condiciones', 'Opciones de publicidad', 'Publicidad', 'Servicios empresariales', '…', '---', 'mostrar más', 'Mostrar todo', 'Vinculared Job')
             and (coalesce(jobId, 0) <> 0 or coalesce(title, '') <> ''))
       select ingest_seq, cast((case when coalesce(jobId, 0) <> 0 then 10 else 0 end) + (case when coalesce(companyName, '') <> '' then 5 else 0 end) + (case when coalesce(location, '') <> '' then 3 else 0 end)
         + (case when coalesce(postedDate, '') <> '' then 2 else 0 end) + (case when coalesce(applyUrl, '') <> '' then 1 else 0 end) as integer) as score from c"""
)
def job_dedup_richness(spark, d):
    return D.dedup_jobs(table(spark, d, "jobs")).select("ingest_seq", "score")


@query(
    """with s as (select row_number() over (order by score desc, ingest_seq) as place, ingest_seq, score from (
         select ingest_seq, cast((case when coalesce(jobId, 0) <> 0 then 10 else 0 end) + (case when coalesce(companyName, '') <> '' then 5 else 0 end) + (case when coalesce(location, '') <> '' then 3 else 0 end)
           + (case when coalesce(postedDate, '') <> '' then 2 else 0 end) + (case when coalesce(applyUrl, '') <> '' then 1 else 0 end) as integer) as score from jobs)) select ingest_seq, score from s"""
)
def richness_order(spark, d):
    scored = table(spark, d, "jobs").withColumn("score", D.richness())
    return A.ranked(scored, F.col("score"), "ingest_seq").select("ingest_seq", "score")


@query("select c_custkey, c_name from customer anti join (select distinct s_nationkey from supplier where s_acctbal > 5000) s on s.s_nationkey = customer.c_nationkey")
def merge_people_anti(spark, d):
    seen = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").cast("string").alias("nk"))
    rows = table(spark, d, "customer").withColumn("nk", F.col("c_nationkey").cast("string"))
    return D.not_seen_before(rows, seen, "nk").select("c_custkey", "c_name")


@query(
    f"""with a as (select * from jobs where coalesce(job_url, '') = '' union all
          (select * from jobs where job_url <> '' qualify row_number() over (partition by {KEY_SQL.format('job_url')} order by ingest_seq) = 1)),
        x as (select source as category, count(*) as before from jobs group by source), y as (select source as category, count(*) as after from a group by source)
        select category, before, coalesce(after, 0) as after, before - coalesce(after, 0) as removed, cast(cast(round_even((before - coalesce(after, 0)) * 100.0 / before, 0) as bigint) as varchar) || '%' as pct from x left join y using (category)
        union all select 'TOTAL', (select count(*) from jobs), (select count(*) from a), (select count(*) from jobs) - (select count(*) from a), ''"""
)
def dedup_stats(spark, d):
    j = table(spark, d, "jobs").withColumn("category", F.col("source"))
    return D.dedup_stats(j, D.dedup_urls(j))


@query()
def fuzzy_dedup(spark, d):
    """Rows only: a ratio of matching blocks has no SQL."""
    parts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    return D.dedup_names(parts, 0.85, "p_partkey")


@query()
def people_merge(spark, d):
    people = table(spark, d, "person_profiles").select("ingest_seq", "name", "url")
    employees = table(spark, d, "job_details").select("ingest_seq", F.col("company").alias("name"), "url")
    return D.merge_people(people, employees).select("rank", "ingest_seq", "name")


# --------------------------------------------------- counts, rankings, unions, lookups


@query("select event_type, count(*) as n, min(event_id) as first_seq from events group by event_type")
def freq_by_key(spark, d):
    return A.frequency(table(spark, d, "events"), "event_type", "event_id")


@query("select coalesce(location, '?') as location, count(*) as n, min(ingest_seq) as first_seq from jobs group by 1 order by n desc, first_seq limit 10")
def freq_top10(spark, d):
    return A.frequency(table(spark, d, "jobs"), "location", "ingest_seq", top=10)


@query("select ingest_seq, title from jobs order by ingest_seq limit 5")
def head_sample(spark, d):
    return A.cap(table(spark, d, "jobs"), 5, "ingest_seq").select("ingest_seq", "title")


_UNION_SQL = """select 0 as source_rank, ingest_seq, title, cast(null as varchar) as name from jobs union all
    select 1, ingest_seq, title, null from job_details union all select 2, ingest_seq, null, name from person_profiles"""


def _union(spark, d):
    return A.union_all(
        table(spark, d, "jobs").select("ingest_seq", "title"),
        table(spark, d, "job_details").select("ingest_seq", "title"),
        table(spark, d, "person_profiles").select("ingest_seq", "name"),
    )


@query(_UNION_SQL)
def union_unified(spark, d):
    return _union(spark, d).select("source_rank", "ingest_seq", "title", "name")


@query(f"select source_rank, count(*) as n from ({_UNION_SQL}) group by rollup (source_rank)")
def bucket_counts(spark, d):
    return A.bucket_counts(_union(spark, d), "source_rank")


@query("select count(*) filter (where type = 'job') as jobs, count(*) filter (where type = 'company') as companies from jobs")
def counts_by_type(spark, d):
    return A.counts_by_type(table(spark, d, "jobs"))


@query(
    """select count(*) filter (where event_type = 'view') as total_calls, count(*) filter (where event_type = 'error') as total_errors, count(*) filter (where event_type = 'signup') as total_pauses from events"""
)
def call_counters(spark, d):
    kind = F.when(F.col("event_type") == "view", "acquire").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "pause")
    return A.call_counters(table(spark, d, "events").withColumn("kind", kind))


@query("select s_nationkey, s_suppkey, cast(row_number() over (partition by s_nationkey order by s_suppkey) as integer) as rank from supplier qualify rank <= 3")
def top3_per_group(spark, d):
    return A.top_per_group(table(spark, d, "supplier"), "s_nationkey", [F.col("s_suppkey")], 3).select("s_nationkey", "s_suppkey", "rank")


@query(
    f"""with c as (select * from jobs order by ingest_seq limit 500) select ingest_seq, job_url from c where coalesce({KEY_SQL.format('job_url')}, '') = ''
        union all (select ingest_seq, job_url from c where {KEY_SQL.format('job_url')} <> '' qualify row_number() over (partition by {KEY_SQL.format('job_url')} order by ingest_seq) = 1)"""
)
def cap_then_dedup(spark, d):
    return D.dedup_urls(A.cap(table(spark, d, "jobs"), 500, "ingest_seq")).select("ingest_seq", "job_url")


@query("select r_name, n_name from region cross join nation")
def keyword_location_cross(spark, d):
    return A.search_grid(table(spark, d, "region").select("r_name"), table(spark, d, "nation").select("n_name"))


@query("select o_custkey, arg_min(o_orderpriority, o_orderkey) as o_orderpriority, min(o_orderkey) as first_seq from orders group by o_custkey")
def first_attribution(spark, d):
    return A.first_attribution(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderpriority")


@query(
    f"""with p as (select ingest_seq, source, cast(floor(ingest_seq / 25) as bigint) as page, {KEY_SQL.format("coalesce(job_url, '')")} as k from jobs),
        m as (select *, row_number() over (partition by source, k order by ingest_seq) = 1 as new from p),
        s as (select source, page, count(*) filter (where new) as n from m group by source, page), t as (select source, min(page) as stop from s where n = 0 group by source)
        select m.ingest_seq, m.source, m.page from m left join t using (source) where stop is null or m.page < stop"""
)
def pagination_stop(spark, d):
    j = table(spark, d, "jobs").select(
        "ingest_seq", "source", F.floor(F.col("ingest_seq") / 25).alias("page"), S.url_key(F.coalesce("job_url", F.lit(""))).alias("k")
    )
    return A.page_stop(j, "source", "page", "k", "ingest_seq").select("ingest_seq", "source", "page")


@query(
    r"""with x as (select ingest_seq, regexp_extract_all(text, '#[a-z]+') as h from posts_feed where text is not null)
        select ingest_seq, cast(unnest(range(len(h))) as integer) as pos, unnest(h) as tag from x"""
)
def explode_links(spark, d):
    x = table(spark, d, "posts_feed").select("ingest_seq", F.posexplode(F.regexp_extract_all("text", F.lit("#[a-z]+"), F.lit(0))).alias("pos", "tag"))
    return x


@query(
    r"""with x as (select ingest_seq, unnest(range(len(h))) as pos, unnest(h) as tag from (select ingest_seq, regexp_extract_all(text, '#[a-z]+') as h from posts_feed)),
        f as (select ingest_seq, tag, min(pos) as p from x group by 1, 2), j as (select ingest_seq, string_agg(tag, '|' order by p) as tags from f group by 1)
        select posts_feed.ingest_seq, coalesce(tags, '') as tags from posts_feed left join j using (ingest_seq)"""
)
def ordered_distinct_links(spark, d):
    hits = D.ordered_distinct(F.regexp_extract_all("text", F.lit("#[a-z]+"), F.lit(0)))
    return table(spark, d, "posts_feed").select("ingest_seq", F.coalesce(F.array_join(hits, "|"), F.lit("")).alias("tags"))


@query(
    "with c as (select * from orders order by o_orderkey limit 200) select o_orderkey, c_custkey, c_name from c join customer on c_custkey = o_custkey"
)
def detail_enrich(spark, d):
    o = table(spark, d, "orders").withColumn("c_custkey", F.col("o_custkey"))
    return E.detail_lookup(o, table(spark, d, "customer"), "c_custkey", 200, "o_orderkey").select("o_orderkey", "c_custkey", "c_name")


@query(
    """with c as (select * from job_details order by ingest_seq limit 50), f as (select external_id, min(ingest_seq) as seq from c where coalesce(external_id, '') <> '' group by external_id),
       x as (select f.seq, f.external_id, j.title as known from f left join (select external_id, min_by(title, ingest_seq) as title from jobs group by external_id) j on j.external_id = f.external_id)
       select seq as ingest_seq, external_id, known from x"""
)
def cap_complements(spark, d):
    known = table(spark, d, "jobs").groupBy("external_id").agg(F.min_by("title", "ingest_seq").alias("known"))
    return E.complements(table(spark, d, "job_details"), known, "external_id", 50, "ingest_seq").select("ingest_seq", "external_id", "known")


@query(
    """with n as (select ingest_seq, source, external_id, text_ocr, row_number() over (partition by source order by ingest_seq) as r from job_details),
       t as (select external_id, min(description) as new from job_details where description is not null group by external_id)
       select ingest_seq, case when r <= 10 then coalesce(new, text_ocr) else text_ocr end as text_ocr from n left join t using (external_id)"""
)
def text_enrich_left(spark, d):
    rows = table(spark, d, "job_details").select("ingest_seq", F.col("source").alias("category"), "external_id", "text_ocr")
    texts = table(spark, d, "job_details").where("description is not null").groupBy("external_id").agg(F.min("description").alias("text"))
    return E.text_enrich(rows, texts, "external_id", 10, "ingest_seq").select("ingest_seq", "text_ocr")


@query(
    """select p_partkey, p_name from part a where not exists (select 1 from (select distinct split_part(p_name, ' ', 1) as w from part where p_partkey <= 3) b
       where contains(a.p_name, b.w) or contains(b.w, a.p_name))"""
)
def contains_bidirectional_anti(spark, d):
    p = table(spark, d, "part")
    words = p.where("p_partkey <= 3").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w"))
    return E.not_contained(p, words, "p_name", "w").select("p_partkey", "p_name")


@query(
    """with s as (select n_regionkey as search, n_nationkey as slug, row_number() over (partition by n_regionkey order by n_nationkey) as r from nation)
       select search, slug, c_custkey from s join customer on c_nationkey = slug where r <= 3"""
)
def slug_fan_out(spark, d):
    s = table(spark, d, "nation").select(F.col("n_regionkey").alias("search"), F.col("n_nationkey").cast("string").alias("slug"), "n_nationkey")
    posts = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("slug"), "c_custkey")
    return E.fan_out(s, posts, 3, "n_nationkey").select("search", F.col("slug").cast("int").alias("slug"), "c_custkey")


@query(
    """select event_id, count(*) over (partition by user_id order by ts range between interval 60 seconds preceding and current row) as calls from events"""
)
def rolling_60s(spark, d):
    return A.rolling_calls(table(spark, d, "events"), "user_id", "ts").select("event_id", "calls")


@query("select doc_id, org_slug from documents where org_slug is not null and not exists (select 1 from company_profiles c where c.external_id = org_slug and c.text_ocr <> '')")
def orphans(spark, d):
    known = table(spark, d, "company_profiles").where("text_ocr <> ''").select(F.col("external_id").alias("org_slug"))
    return A.difference(table(spark, d, "documents").where("org_slug is not null"), known, "org_slug").select("doc_id", "org_slug")


@query("select external_id, string_agg(coalesce(title, ''), chr(10) order by ingest_seq) as joined from job_details where external_id is not null group by external_id")
def section_join(spark, d):
    rows = table(spark, d, "job_details").where("external_id is not null").withColumn("t", F.coalesce("title", F.lit("")))
    return A.joined_text(rows, "external_id", "ingest_seq", "t")


@query(
    """with l as (select ingest_seq, unnest(range(len(ls))) as pos, trim(unnest(ls)) as line from (select ingest_seq, string_split(text_ocr, chr(10)) as ls from person_profiles where text_ocr is not null))
       select ingest_seq, string_agg(line, '|' order by pos) as people from l where line <> '' and length(line) > 5 and not starts_with(line, 'http') and not contains(lower(line), 'search')
       and not contains(lower(line), 'filter') and not contains(lower(line), 'result') and not contains(lower(line), 'relevance') group by ingest_seq"""
)
def people_lines(spark, d):
    p = table(spark, d, "person_profiles").where("text_ocr is not null")
    out = p.select("ingest_seq", F.array_join(L.people_of_text(F.col("text_ocr")), "|").alias("people"))
    return out.where("people <> ''")


# ------------------------------------------------- parsers and state (rows only) and flagship


def _listing_texts(spark, d):
    """Listing texts assembled from listing_jobs: one per search keyword."""
    lines = F.concat_ws("\n", "title", F.coalesce("companyName", F.lit("")), F.coalesce("location", F.lit("")), F.coalesce("postedDate", F.lit("")))
    rows = table(spark, d, "listing_jobs").select(F.coalesce("search_keyword", F.lit("?")).alias("kw"), "listing_id", lines.alias("x"))
    return A.joined_text(rows, "kw", "listing_id", "x").select("kw", F.concat("joined", F.lit("\n-\n")).alias("text"))


@query()
def references_added(spark, d):
    """J5 whole: all reference names, in order, against all names parsed from texts."""
    profiles = table(spark, d, "person_profiles")
    people = profiles.select(F.explode(L.people_of_text(F.col("text_ocr"))).alias("name"))
    return E.references_added(people, profiles).select("ingest_seq", "name")


@query()
def listing_parse(spark, d):
    return L.listing_records(_listing_texts(spark, d), "kw", "text")


@query()
def response_merge(spark, d):
    refs = F.struct(F.lit("job").alias("kind"), F.concat(F.lit("/jobs/view/"), F.col("listing_id"), F.lit("/")).alias("url"), F.col("title").alias("text"))
    by_kw = table(spark, d, "listing_jobs").where("title is not null").groupBy(F.coalesce("search_keyword", F.lit("?")).alias("kw")).agg(
        F.array_sort(F.collect_list(refs)).alias("refs"), F.array_sort(F.collect_list(F.col("listing_id").cast("string"))).alias("ids")
    )
    body = F.to_json(F.struct(
        F.create_map(F.lit("search_results"), F.col("text")).alias("sections"), F.create_map(F.lit("search_results"), F.col("refs")).alias("references"), F.col("ids").alias("job_ids"),
    ))
    return L.response_records(_listing_texts(spark, d).join(by_kw, "kw").select("kw", body.alias("body")), "kw", "body")


@query("select ingest_seq, cast(0 as integer) as pos, trim(title) as title, split_part(job_url, '?', 1) as job_url from jobs where trim(coalesce(title, '')) <> '' and split_part(coalesce(job_url, ''), '?', 1) <> ''")
def card_parse(spark, d):
    """Search cards written from jobs rows and parsed again."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    page = F.concat(
        F.lit('<ul><li><div class="base-card base-search-card"><a class="base-card__full-link" href="'), esc(F.col("job_url")),
        F.lit('"></a><h3 class="base-search-card__title"> '), esc(F.col("title")), F.lit("</h3></div><li><br></ul>"),
    )
    pages = table(spark, d, "jobs").select("ingest_seq", page.alias("html"))
    return H.card_records(pages, "ingest_seq", "html").select("ingest_seq", "pos", "title", "job_url")


_REPLAY_SQL = """
with recursive ev as materialized (
  select user_id, event_id, epoch_us(ts) / 1e6 as ts, case event_type when 'error' then 'error' when 'signup' then 'pause' else 'acquire' end as kind,
         row_number() over (partition by user_id order by ts, event_id) as rn from events),
r(user_id, rn, event_id, wait, burst_left, hourly_left, since, calls, errors, pauses) as (
  select user_id, cast(0 as bigint), cast(null as bigint), 0::double, 8::double, 100::double, ts::double, 0::bigint, 0::bigint, 0::bigint from ev where rn = 1
  union all
  select user_id, rn, event_id, w,
         case kind when 'pause' then burst_left when 'error' then greatest(0, burst_left - 4) else (case when free then b1 - 1 else least(8, b1 + greatest(0, now2 - at1) * (8 / 60.0::double)) end) - 1 end,
         case kind when 'pause' then hourly_left when 'error' then greatest(0, hourly_left - 4) else (case when free then h1 - 1 else least(100, h1 + greatest(0, now2 - at1) * (100 / 3600.0::double)) end) - 1 end,
         case when kind <> 'acquire' then since when free then at1 else greatest(at1, now2) end,
         calls + (kind = 'acquire')::bigint, errors + (kind = 'error')::bigint, pauses + (kind = 'pause' or (kind = 'acquire' and not free))::bigint
  from (select *, case when kind = 'acquire' and not free then greatest((1 - b1) / (8 / 60.0::double), (1 - h1) / (100 / 3600.0::double), 0) else 0 end as w, ts + w as now2
        from (select *, b1 >= 1 and h1 >= 1 as free
              from (select e.user_id, e.rn, e.event_id, e.ts, e.kind, r.burst_left, r.hourly_left, r.since, r.calls, r.errors, r.pauses, greatest(r.since, e.ts) as at1,
                           least(8, r.burst_left + greatest(0, e.ts - r.since) * (8 / 60.0::double)) as b1, least(100, r.hourly_left + greatest(0, e.ts - r.since) * (100 / 3600.0::double)) as h1
                    from r join ev e on e.user_id = r.user_id and e.rn = r.rn + 1))))
select user_id, event_id, wait, burst_left, hourly_left, calls, errors, pauses from r where rn > 0"""


@query(_REPLAY_SQL)
def budget_replay(spark, d):
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "pause").otherwise("acquire")
    log = table(spark, d, "events").select(
        "user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), kind.alias("kind"), F.lit(None).cast("double").alias("weight"), F.lit(False).alias("cool_run")
    )
    return B.replay(log, "user_id", "event_id")


# --------------------------------------------------------- records, responses and readers


@query("select ingest_seq, case when contains(search_keyword, ',') then list_transform(string_split(search_keyword, ','), lambda x: trim(x)) else [search_keyword] end as words from (select ingest_seq, replace(search_keyword, ' ', ' , ') as search_keyword from jobs where search_keyword is not null)")
def keyword_split(spark, d):
    j = table(spark, d, "jobs").where("search_keyword is not null").select("ingest_seq", F.replace("search_keyword", F.lit(" "), F.lit(" , ")).alias("k"))
    return j.select("ingest_seq", S.keyword_list(F.col("k")).alias("words"))


@query(
    """select ingest_seq, coalesce(title, '') as title, coalesce(company, '') as company, coalesce(location, '') as location, coalesce(description, '') as description,
       case when external_id <> '' then 'https://www.vinculared.example/jobs/view/' || external_id || '/' else '' end as url, external_id from job_details"""
)
def detail_project(spark, d):
    """P21 on sections made of job_details; the description comes under its other name."""
    sections = F.map_filter(
        F.create_map(F.lit("title"), F.col("title"), F.lit("company"), F.col("company"), F.lit("location"), F.col("location"), F.lit("details"), F.col("description")), lambda _, v: v.isNotNull()
    )
    out = table(spark, d, "job_details").select("ingest_seq", S.detail_record(sections, "job", F.col("external_id")).alias("r"))
    return out.select("ingest_seq", "r.*")


@query("""select ingest_seq, name, coalesce(nullif(url, ''), nullif(cast(null as varchar), ''), '') as url, coalesce(external_id, regexp_extract(coalesce(url, ''), '/in/([^/?#]+)', 1)) as external_id from person_profiles""")
def person_urls(spark, d):
    p = table(spark, d, "person_profiles").select("ingest_seq", "name", "url", F.lit(None).cast("string").alias("profile_url"), "external_id")
    return S.with_person_url(p).select("ingest_seq", "name", "url", "external_id")


@query("""select doc_id, coalesce(text, '') as text from documents""")
def envelope_unwrap(spark, d):
    """P25 on envelopes of both kinds and on plain texts."""
    t = F.coalesce("text", F.lit(""))
    content = F.array(F.struct(F.lit("text").alias("type"), t.alias("text")))
    kind = F.col("doc_id") % 3
    body = F.when(kind == 0, S.as_json(F.struct(content.alias("content")))).when(kind == 1, S.as_json(F.struct(F.struct(content.alias("content")).alias("result")))).otherwise(t)
    return table(spark, d, "documents").select("doc_id", S.unwrap(body).alias("text"))


@query("select ingest_seq, to_json(struct_pack(title := title, location := location, id := jobId)) as body from jobs")
def json_body(spark, d):
    return table(spark, d, "jobs").select("ingest_seq", S.as_json(F.struct("title", "location", F.col("jobId").alias("id"))).alias("body"))


@query("select ingest_seq, cast((url is not null and url <> '' and contains(url, '/in/')) as int) as n from person_profiles")
def reference_filter(spark, d):
    ref = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col("url").alias("url"))
    refs = F.array(ref("person"), ref("job"))
    return table(spark, d, "person_profiles").select("ingest_seq", F.coalesce(F.size(P.references_of(refs, "person", "/in/")), F.lit(0)).alias("n"))


@query("select ingest_seq, url from job_details where ingest_seq % 5 <> 0")
def delivered_pages(spark, d):
    """Pages with their status; every fifth failed."""
    status = F.when(F.col("ingest_seq") % 5 == 0, 503).otherwise(200)
    return table(spark, d, "job_details").where(P.fetched(status)).select("ingest_seq", "url")


@query(
    """select event_id, case when contains(m, 'login is still in progress') then 'login_in_progress' when contains(m, 'setup is not complete') then 'setup_incomplete' else 'ready' end as state,
       case when regexp_matches(m, 'challenge|captcha|checkpoint|verif') then 45 when regexp_matches(m, 'timeout|timed out|tempor|connection|rate|429|503') then 15 else 0 end as seconds,
       case when user_id % 4 < 3 then (user_id % 4) * 2.0::double end as backoff
       from (select *, lower(case event_id % 5 when 0 then 'Login is still in progress' when 1 then 'Setup is NOT complete' when 2 then 'Timed out' when 3 then 'Captcha asked' else event_type end) as m from events)"""
)
def response_classes(spark, d):
    """Why a server gave no data, how long to wait, the backoff of an attempt."""
    k = F.col("event_id") % 5
    m = F.when(k == 0, "Login is still in progress").when(k == 1, "Setup is NOT complete").when(k == 2, "Timed out").when(k == 3, "Captcha asked").otherwise(F.col("event_type"))
    return table(spark, d, "events").select(
        "event_id", P.response_state(m).alias("state"), B.retry_class(m).alias("seconds"), B.backoff_seconds(F.col("user_id") % 4).alias("backoff")
    )


def _landed(rows: DataFrame, fields: list[str], label: str, wrap=lambda a: a) -> str:
    """Files of one JSON array each, one for every origin_file; gives the pattern of their paths."""
    path = scratch_path(rows.sparkSession, label)
    arrays = rows.groupBy("origin_file").agg(F.to_json(wrap(F.collect_list(F.struct(*fields)))).alias("value"))
    arrays.repartition("origin_file").write.partitionBy("origin_file").text(path)
    return f"{path}/*/*.txt"


_READ = "coalesce({0}, '') as {0}"


@query(
    f"""select {LIGHT_SQL.format("coalesce(job_url, '')")} as url, substring(md5(coalesce(nullif(external_id, ''), {LIGHT_SQL.format("coalesce(job_url, '')")})), 1, 12) as id,
        coalesce(nullif(source, ''), 'guest_api') as source, {_READ.format('title')}, {_READ.format('company')}, {_READ.format('external_id')}, {_READ.format('posted_date')} from jobs where origin_file is not null"""
)
def read_guest_files(spark, d):
    """Search-page records written to a file for each origin and read again."""
    fields = ["external_id", "title", "company", "location", "job_url", "posted_date", "search_keyword", "scraped_at", "source", "text_ocr", "is_valid"]
    pattern = _landed(table(spark, d, "jobs").where("origin_file is not null"), fields, "s14")
    return readers.read_guest(spark, pattern).select("url", "id", "source", "title", "company", "external_id", "posted_date")


@query(
    f"""select u as url, substring(md5(coalesce(nullif(k, ''), u)), 1, 12) as id, {_READ.format('title')}, coalesce(companyName, '') as company, k as external_id from (
        select *, split_part(rtrim(coalesce(nullif(applyUrl, ''), 'https://www.vinculared.example/jobs/view/' || k), '/'), '?', 1) as u from (select *, coalesce(cast(jobId as varchar), 'None') as k from jobs where origin_file is not null))"""
)
def read_tool_files(spark, d):
    """Tool records; a missing id reads None."""
    rows = table(spark, d, "jobs").where("origin_file is not null").withColumn("jobId", F.col("jobId").cast("string"))
    pattern = _landed(rows, ["jobId", "title", "companyName", "location", "postedDate", "applyUrl", "search_keyword", "scraped_at"], "s15")
    return readers.read_tool(spark, pattern).select("url", "id", "title", "company", "external_id")


@query(
    f"""select u as url, substring(md5(coalesce(nullif(name, ''), u)), 1, 12) as id, coalesce(name, '') as title, coalesce(industry, '') as _sector
        from (select *, {LIGHT_SQL.format("coalesce(url, '')")} as u from company_profiles)"""
)
def read_contact_files(spark, d):
    """Company contacts."""
    rows = table(spark, d, "company_profiles").select(
        (F.col("ingest_seq") % 7).cast("string").alias("origin_file"), F.col("name").alias("nombre"), F.col("url").alias("sitio_web"), F.col("industry").alias("sector"), F.col("source").alias("fuente")
    )
    return readers.read_contacts(spark, _landed(rows, ["nombre", "sitio_web", "sector", "fuente"], "s16")).select("url", "id", "title", "_sector")


@query(
    f"""select {LIGHT_SQL.format("coalesce(job_url, '')")} as url, coalesce(source, '') as source, {_READ.format('title')}, {_READ.format('company')} from jobs where origin_file is not null"""
)
def read_envelope_files(spark, d):
    """Records inside {{metadata, results}} files."""
    wrap = lambda a: F.struct(F.struct(F.lit("x").alias("run")).alias("metadata"), F.struct(a.alias("jobs")).alias("results"))
    pattern = _landed(table(spark, d, "jobs").where("origin_file is not null"), ["title", "company", "job_url", "source"], "s17", wrap)
    return readers.read_envelope(spark, pattern).select("url", "source", "title", "company")


@query("select max(origin_file) as name from jobs where origin_file is not null")
def latest_landed_file(spark, d):
    """The last file by name."""
    pattern = _landed(table(spark, d, "jobs").where("origin_file is not null"), ["title"], "s18")
    last = readers.latest_file(spark, pattern.rsplit("/", 1)[0])
    return spark.range(1).select(F.lit((last or "").rsplit("origin_file=", 1)[-1]).alias("name"))


@query(
    r"""with c as (select *, case when coalesce(url, '') <> '' then string_split(regexp_replace(url, '/+$', ''), '/')[-1] else coalesce(external_id, '') end as k from company_profiles order by ingest_seq limit 300),
       fc as (select * from c where k <> '' qualify row_number() over (partition by k order by ingest_seq) = 1),
       j as (select *, coalesce(nullif(url, ''), nullif(job_url, ''), nullif(applyUrl, '')) as u from jobs order by ingest_seq limit 500),
       fj as (select *, coalesce(nullif(external_id, ''), string_split(regexp_replace(u, '/+$', ''), '/')[-1]) as k from j where u is not null qualify row_number() over (partition by k order by ingest_seq) = 1),
       p as (select *, string_split(regexp_replace(url, '/+$', ''), '/in/')[-1] as k from (select * from person_profiles order by ingest_seq limit 200) where contains(url, '/in/')),
       fp as (select * from p where k <> '' qualify row_number() over (partition by k order by ingest_seq) = 1),
       w as (select 'company_profiles' as bucket, coalesce(name, k) as name, k as external_id, 'https://www.vinculared.example/company/' || k || '/about' as url from fc
             union all (select 'posts_companies', k, k, 'https://www.vinculared.example/company/' || k || '/posts' from fc order by ingest_seq limit 5)
             union all select 'job_details', coalesce(title, ''), k, u from fj union all select 'person_profiles', coalesce(name, ''), k, url from fp),
       pages as (select distinct url from w where length(url) % 7 <> 0)
       select bucket, name, external_id, w.url, 'page of ' || w.url as text_ocr from w join pages on pages.url = w.url"""
)
def page_routing(spark, d):
    """Pages delivered for companies, postings and people, every address whose length is a multiple of 7 failed."""
    c, j, p = table(spark, d, "company_profiles"), table(spark, d, "jobs"), table(spark, d, "person_profiles")
    slug = F.element_at(F.split(F.regexp_replace("url", "/+$", ""), "/"), -1)
    k = F.when(F.coalesce("url", F.lit("")) != "", slug).otherwise(F.col("external_id"))
    made = [F.concat(F.lit("https://www.vinculared.example/company/"), k, F.lit(x)) for x in ("/about", "/posts")]
    urls = [c.select(made[0].alias("url")), c.select(made[1].alias("url")), *[j.select(F.col(x).alias("url")) for x in ("url", "job_url", "applyUrl")], p.select("url")]
    every = urls[0]
    for u in urls[1:]:
        every = every.unionByName(u)
    status = F.when(F.length("url") % 7 == 0, 503).otherwise(200)
    pages = every.where("url <> ''").distinct().select("url", status.alias("status"), F.concat(F.lit("page of "), "url").alias("text"))
    out = routed_pages(c, j, p, pages, {"company": 300, "job": 500, "person": 200})
    return out.select("bucket", "name", "external_id", "url", "text_ocr")


_T = "coalesce(nullif({0}, ''), '')"
_FLAG_SQL = f"""
with r as (
  select ingest_seq, {LIGHT_SQL.format("coalesce(nullif(job_url, ''), nullif(applyUrl, ''), nullif(url, ''), '')")} as url, coalesce(nullif(trim(external_id), ''), cast(jobId as varchar), '') as external_id,
         'job' as type, {_T.format('source')} as source, {_T.format('title')} as title, coalesce(nullif(company, ''), nullif(companyName, ''), '') as company,
         {_T.format('text_ocr')} as text_ocr, {_T.format('is_valid')} as is_valid from jobs
  union all
  select ingest_seq + 1099511627776, {LIGHT_SQL.format("coalesce(nullif(url, ''), '')")}, {_T.format('external_id')}, 'company', {_T.format('source')}, {_T.format('name')}, {_T.format('name')}, {_T.format('text_ocr')}, '' from company_profiles),
i as (select *, substring(md5(coalesce(nullif(case when type = 'job' then external_id else title end, ''), {LIGHT_SQL.format('url')})), 1, 12) as id from r),
g as (select coalesce(nullif(url, ''), id) as k, min(ingest_seq) as first_seq,
        list_reduce(list(struct_pack(seq := ingest_seq, t := text_ocr <> '', v := is_valid <> '') order by ingest_seq), lambda e, x: case when (x.t and not e.t) or (x.v and not e.v) then x else e end).seq as seq
      from i group by 1)
select i.id, i.type, i.source, i.title, i.company, i.url, i.external_id, i.text_ocr, i.is_valid, g.first_seq from g join i on i.ingest_seq = g.seq"""


@query(_FLAG_SQL)
def consolidate_flagship(spark, d):
    """Job and company records in one schema, one per address or id, by the most-enriched fold."""
    records = collected_records(table(spark, d, "jobs"), table(spark, d, "company_profiles"))
    return consolidate(records).select("id", "type", "source", "title", "company", "url", "external_id", "text_ocr", "is_valid", "first_seq")

