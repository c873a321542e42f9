"""Postings: identity, near addresses against brute force, batches against one run."""

import random

from pyspark.sql import functions as F

from acequia.llm.incremental_dedup import PostingHistory, chunks_of, identify, lookups, near_addresses, same_address
from acequia.session import scratch_path

COLS = "ingest_seq bigint, source string, url string, job_url string, applyUrl string, external_id string, jobId bigint, slug string"
H = "https://ar.vinculared.example/jobs/view/"


def jobs(spark, *rows):
    base = {"source": "guest_api", "url": None, "job_url": None, "applyUrl": None, "external_id": None, "jobId": None, "slug": "clash"}
    names = [c.split()[0] for c in COLS.split(", ")]
    return spark.createDataFrame([tuple((base | {"ingest_seq": i + 1} | r)[n] for n in names) for i, r in enumerate(rows)], COLS)


def accept(spark, df):
    return sorted((r.seq_a, r.seq_b) for r in PostingHistory(spark, scratch_path(spark, "h")).accept(df).collect())


def test_numbers_in_all_notations(spark):
    df = jobs(
        spark, {"external_id": "4000000001"}, {"external_id": " 04000000001 "}, {"external_id": "urn:li:jobPosting:4000000001"}, {"external_id": "4000000001.0"}, {"external_id": "job-4000000001"},
        {"jobId": 4000000001}, {"job_url": H + "dev-java-en-acme-lima-4000000001?x=1"}, {"url": "HTTP://M.VINCULARED.EXAMPLE/Jobs/View/4000000001/#detalle"}, {"url": "/jobs/view/4000000001/"},
        {"url": "https://x.vinculared.example/redir?to=https%3A%2F%2Fvinculared.example%2Fjobs%2Fview%2F4000000001%2F"}, {"url": "https://www.vinculared.example/jobs/search/?keywords=a&currentJobId=4000000001&start=25"},
    )
    assert {r.number_key for r in identify(df).collect()} == {"v:4000000001"}
    assert accept(spark, df) == [(1, i) for i in range(2, 12)]


def test_boards_and_numbers_apart(spark):
    t = "https://www.tablonlaboral.example/"
    df = jobs(spark, {"external_id": "4000000001"}, {"source": "serper", "job_url": t + "oferta/4000000001"}, {"job_url": t + "jobs/view/4000000001/", "source": "serper"}, {"external_id": "4000000002"}, {"external_id": "None"}, {"external_id": ""}, {})
    assert accept(spark, df) == [(2, 3)]


def test_readable_addresses(spark):
    df = jobs(
        spark, {"job_url": H + "analista-go-sr-en-ridifinuz-tech-la-plata-4000000009"}, {"job_url": H + "ANALISTA-GO-SR-AT-RIDIFINUZ--TECH-LA-PLATA/"}, {"job_url": H + "analista-go-sr-at-ridfiinuz-tech-la-plata"},
        {"job_url": H + "analista-go-sr-en-ridifinuz-tech-la-pla?trk=mail"}, {"job_url": H + "analista-go-jr-en-ridifinuz-tech-la-plata"}, {"job_url": H + "analista-go-jr-en-ridifinuz-tech-la-plata#top"}, {"external_id": "4000000009"},
    )
    assert accept(spark, df) == [(1, 2), (1, 3), (1, 4), (1, 7), (5, 6)]


def test_number_after_its_address(spark):
    a, b = {"job_url": H + "tester-vue-en-acmesur-lima"}, {"job_url": H + "tester-vue-en-acmesur-lima-4000000003"}
    assert accept(spark, jobs(spark, a, b)) == [(1, 2)]
    h = PostingHistory(spark, scratch_path(spark, "h"))
    df = jobs(spark, a, b, {"external_id": "4000000003"})
    parts = [h.accept(df.where(f"ingest_seq = {i}")).collect() for i in (1, 2, 3)]
    assert [[(r.seq_a, r.seq_b) for r in p] for p in parts] == [[], [(1, 2)], [(1, 3)]]


def deviate(s):
    k = random.randint(0, 3)
    words = s.removeprefix("v:").split("-")
    i = max(range(len(words)), key=lambda i: len(words[i]))
    w = words[i]
    j = random.randint(1, len(w) - 3)
    if k == 0:
        words[i] = w[:j] + w[j + 1] + w[j] + w[j + 2 :]
    elif k == 1:
        words[i] = w[:j] + w[j + 1 :]
    elif k == 2:
        words[i] = w[:j] + "z" + w[j:]
    else:
        return s[:-2]
    return "v:" + "-".join(words)


def slugs(n):
    pick = random.choice
    syl = lambda: "".join(pick("bdfglmnprst") + pick("aeiou") for _ in range(4))
    return [f"v:{pick(['analista', 'desarrollador', 'tester'])}-{pick(['go', 'java', 'vue'])}-{syl()}{pick(['', '-labs', '-digital'])}-{pick(['lima', 'buenos-aires', 'santiago'])}" for _ in range(n)]


def test_near_addresses_recall_against_brute_force(spark):
    random.seed(9)
    known = sorted(set(slugs(400)))
    asked = sorted({deviate(random.choice(known)) for _ in range(120)} - set(known))
    want = {(a, k) for a in asked for k in known if same_address(a, k)}
    chunked = lambda xs: chunks_of(spark.createDataFrame([(x,) for x in xs], "slug string"))
    got = {(r.slug, r.match) for r in near_addresses(chunked(asked), chunked(known)).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 100


def test_lookups_bring_all_deviations_and_few_other_pairs(spark):
    """All addresses share roles, towns and lines of business, so their chunks; the pairs looked up don't grow with that."""
    random.seed(10)
    known = sorted(set(slugs(500)) | {"v:analista-go-lima", "v:ab-cd", "v:x--y-abcdefgh-"})
    asked = sorted(({deviate(random.choice(known)) for _ in range(150)} | {k[:-3] for k in known[:40]} | {k + "-sa" for k in known[40:80]} | {"v:x--y-abcdefg-", "v:ab-ce"}) - set(known))
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "slug string")
    pairs = lookups(frame(asked), True).join(lookups(frame(known), False).withColumnRenamed("slug", "match"), "key").select("slug", "match").collect()
    want = {(a, k) for a in asked for k in known if same_address(a, k)}
    assert want <= {(r.slug, r.match) for r in pairs} and len(want) > 150
    assert len(pairs) < 0.05 * len(asked) * len(known)


def test_batches_equal_one_run_and_empty_batches(spark, sf):
    df = spark.read.parquet(f"{sf}/jobs.parquet").withColumn("extra", F.lit(1))
    whole = accept(spark, df)
    h = PostingHistory(spark, scratch_path(spark, "h"))
    n = df.count()
    parts = []
    for i in range(3):
        parts += [(r.seq_a, r.seq_b) for r in h.accept(df.where(f"ingest_seq > {i * n // 3} and ingest_seq <= {(i + 1) * n // 3}")).collect()]
    assert h.accept(df.limit(0)).collect() == [] and sorted(parts) == whole and len(whole) > 10


def _files(spark, h, df, parts):
    """All repeats after the rows came in so many batches."""
    n = df.count()
    for i in range(parts):
        h.add(df.where(f"ingest_seq > {i * n // parts} and ingest_seq <= {(i + 1) * n // parts}"))
    return sorted((r.seq_a, r.seq_b) for r in h.repeats().collect())


def test_chains_and_later_numbers_are_the_same_in_any_batches(spark):
    a = H + "tester-vue-en-acmesurlabs-villaserena"
    chain = jobs(spark, {"job_url": a}, {"job_url": a + "z"}, {"job_url": a + "zz"}, {"job_url": a + "zzz"}, {"job_url": a + "zzzzzz"})
    number = jobs(spark, {"job_url": a + "z"}, {"job_url": H + "dev-go-en-otramarca-lima"}, {"job_url": a + "-4000000007"}, {"job_url": a + "zz"}, {"external_id": "4000000007"})
    for df, want in ((chain, [(1, 2), (1, 3), (1, 4), (1, 5)]), (number, [(1, 3), (1, 4), (1, 5)])):
        for parts in (1, 3, 5):
            assert _files(spark, PostingHistory(spark, scratch_path(spark, "h")), df, parts) == want, parts


def test_accepted_batches_are_not_accepted_again_and_half_written_ones_are(spark):
    h = PostingHistory(spark, scratch_path(spark, "h"))
    df = jobs(spark, {"external_id": "4000000001"}, {"external_id": "4000000001"})
    df.limit(0).write.parquet(f"{h.path}/first/rows")  # an attempt that failed before its marker
    assert h.batches() == [] and h.add(df, name="first") == "first" and h.add(df, name="first") == "first"
    assert h.batches() == ["first"] and [(r.seq_a, r.seq_b) for r in h.repeats().collect()] == [(1, 2)]
