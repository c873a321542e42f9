"""Record operators: hand-derived goldens and properties."""

import csv
import datetime as dt
import json
import random
import zipfile
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from acequia.functions import predicates as P
from acequia.functions import scalars as S
from acequia.operators import aggregate as A
from acequia.operators import budget as B
from acequia.operators import dedup as D
from acequia.operators import enrich as E
from acequia.operators import listing as L
from acequia.plans import pipeline
from acequia.sources import html as H
from acequia.sources import readers, sinks


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("x")).first().x


# ------------------------------------------------------------------------- scalars


def test_url_keys(spark):
    key = lambda u: one(spark, S.url_key(F.col("u")), u=u)
    assert key("https://X.com/Jobs/View/1/?a=1#f") == "https://x.com/jobs/view/1/"
    assert key("https://x.com/jobs/view/1/") == "https://x.com/jobs/view/1"
    assert key(key("https://X.com/a/?q")) != key("https://X.com/a/?q")  # not idempotent


def test_detail_record_alternates(spark):
    df = spark.createDataFrame([({"details": "d", "title": ""}, "7")], "s map<string,string>, k string")
    r = df.select(S.detail_record(F.col("s"), "job", F.col("k")).alias("r")).first().r
    assert (r.description, r.title, r.url, r.external_id) == ("d", "", "https://www.vinculared.example/jobs/view/7/", "7")


def test_cells_and_percent(spark):
    df = spark.createDataFrame([("n", None, {"a": 1}, 3, 8)], "name string, title string, m map<string,int>, a int, b int")
    assert df.select(S.cell(df, "title")).first()[0] == "n"
    assert df.select(S.cell(df, "m")).first()[0] == '{"a":1}'
    assert df.select(S.percent_removed(F.col("b"), F.col("a"))).first()[0] == "62%"  # 62.5, half to even
    assert df.select(S.percent_removed(F.lit(0), F.lit(0))).first()[0] == ""
    assert one(spark, S.keyword_list(F.col("k")), k="a , b") == ["a", "b"]
    assert one(spark, S.unwrap(F.col("k")), k='{"content":[{"text":"x"}]}') == "x"


def test_person_and_post_urls(spark):
    df = spark.createDataFrame([("", "https://h/in/ana?x", None)], "url string, profile_url string, external_id string")
    r = S.with_person_url(df).first()
    assert (r.url, r.external_id) == ("https://h/in/ana?x", "ana")
    assert S.with_post_url(spark.createDataFrame([("", "p")], "url string, post_url string")).first().url == "p"


# ---------------------------------------------------------------------- predicates


@pytest.mark.parametrize(
    "text, valid, p, s, h",
    [
        ("Desarrollador web", True, ["desarrollador", "web"], ["desarrollador"], []),
        ("SEO Content Specialist", False, ["seo"], [], []),
        ("Webinar: trabajo remoto", True, ["web"], [], ["trabajo"]),
        ("Full-Stack developer, We're hiring", True, ["full-stack", "developer"], ["we're hiring"], ["hiring"]),
    ],
)
def test_intent(spark, text, valid, p, s, h):
    v = one(spark, P.intent(F.col("t")), t=text)
    assert (v.is_valid, v.matched_primary, v.matched_secondary, v.matched_hashtags) == (valid, p, s, h)


def test_empty_text_is_invalid_with_reason(spark):
    df = spark.createDataFrame([("", None), (None, "web trabajo")], "text_ocr string, title string")
    v = df.select(P.intent(S.truthy(F.col("text_ocr"), F.lit(""))).alias("v")).first().v
    assert not v.is_valid and v.reason == "no_text_available"
    assert P.validate(df).count() == 1


def test_intent_grows_with_keywords(spark):
    t = "equipo web remoto"
    few = one(spark, P.intent(F.col("t"), ["web"], ["nada"], ["#x"]), t=t).is_valid
    more = one(spark, P.intent(F.col("t"), ["web"], ["nada", "remoto"], ["#x"]), t=t).is_valid
    assert not few and more


def test_line_predicates(spark):
    noise = ["37 resultados", "PROMOCIONADO", "Hace 3 horas", "Más", "   ", "adelántate a otros"]
    assert all(one(spark, P.is_noise(F.col("x")), x=n) for n in noise)
    assert not one(spark, P.is_noise(F.col("x")), x="Más sobre la empresa")
    assert one(spark, P.is_relative_date(F.col("x")), x="HACE 2 DÍAS") and not one(spark, P.is_relative_date(F.col("x")), x="Hace 2 horas")
    assert one(spark, P.is_place(F.col("x")), x="Lima (En remoto)") and not one(spark, P.is_place(F.col("x")), x="argentina")
    assert one(spark, P.response_state(F.col("x")), x="Login is still in progress") == "login_in_progress"
    assert not one(spark, P.is_title(F.col("x")), x="y" * 100)


# ------------------------------------------------------------------------- parsers

LISTING = """desarrollador web en Buenos Aires, Argentina
37 resultados
Desarrollador Web Sr
Desarrollador Web Sr with verification
Acme SA
Buenos Aires, Argentina (Híbrido)
Hace 2 semanas
Promocionado
PHP Developer
Beta SRL
Argentina (En remoto)
QA Analyst
Gamma
Siguiente
Ignored"""


def test_listing_golden():
    assert L.parse_listing(LISTING) == [
        ("Desarrollador Web Sr", "Acme SA", "Buenos Aires, Argentina (Híbrido)", "Hace 2 semanas"),
        ("PHP Developer", "Beta SRL", "Argentina (En remoto)", ""),
        ("QA Analyst", "Gamma", "", ""),
    ]
    assert L.parse_listing("Backend Dev\nHace 3 días\nFoo Corp\nArgentina") == [("Backend Dev", "", "", ""), ("Hace 3 días", "Foo Corp", "Argentina", "")]
    assert L.parse_listing(None) == L.parse_listing("") == L.parse_listing("  \n ") == []


def refs(*pairs):
    return {"search_results": [{"kind": "job", "url": f"/jobs/view/{n}/", "text": t} for n, t in pairs]}


def test_response_golden():
    body = {"references": refs((111, "PHP Developer"), (222, "Orphan Title")), "sections": {"search_results": "PHP Developer\nBeta SRL\nArgentina\nQA Analyst\nGamma"}, "job_ids": ["111", "222", "333"]}
    got = L.merge_response(json.dumps(body))
    assert [(r[0], r[1], r[4]) for r in got] == [("PHP Developer", "Beta SRL", 111), ("QA Analyst", "Gamma", 222), ("", "", 333)]
    assert [r[5].split("example")[1] for r in got] == ["/jobs/view/111/", "/jobs/view/222", "/jobs/view/333"]
    again = L.merge_response(json.dumps({"references": refs((111, "PHP Developer")), "job_ids": ["111"]}))
    assert [(r[0], r[4]) for r in again] == [("", 111), ("PHP Developer", 111)]
    assert L.merge_response("no json") is L.merge_response("[1]") is L.merge_response("{}") is L.merge_response(None) is None


def test_response_records_and_job_search(spark):
    body = json.dumps({"references": refs((7, "Dev")), "sections": {"search_results": "Dev\nAcme\nArgentina\nPublicidad\nx"}, "job_ids": [7]})
    df = spark.createDataFrame([(1, body), (2, body), (3, None)], "i bigint, body string")
    out = pipeline.job_search(df, "i", "body").collect()
    assert [(r.jobId, r.title, r.score) for r in out] == [(7, "Dev", 19)]


def test_response_parsing(spark):
    df = spark.createDataFrame([('{"sections":{"a":"x","b":"y"},"job_ids":[1]}',), ("plain text",)], "t string")
    got = [r.r for r in df.select(L.response_of(F.col("t")).alias("r")).collect()]
    assert got[0].sections == {"a": "x", "b": "y"} and got[0].job_ids == ["1"] and got[1].sections == {"raw": "plain text"}
    assert df.select(L.section_text(L.response_of(F.col("t"))).alias("s")).first().s == "x\ny"


def test_references_and_text_urls(spark):
    df = spark.createDataFrame([(1, [("person", "/in/ana/", "Ana"), ("person", "/x", "B"), ("job", "/in/c", "C")])], "i int, refs array<struct<kind:string,url:string,text:string>>")
    assert [(r.name, r.url, r.external_id) for r in L.reference_rows(df, "i", F.col("refs"), "person", "/in/").collect()] == [("Ana", "https://www.vinculared.example/in/ana/", "ana")]
    t = "https://vinculared.example/in/a-b/ y https://www.vinculared.example/in/a_c y https://vinculared.example/in/a-b"
    assert one(spark, L.authors_of_text(F.col("t")), t=t) == ["https://vinculared.example/in/a-b", "https://www.vinculared.example/in/a_c"]
    p = "(https://www.vinculared.example/posts/x?u=1) https://www.vinculared.example/feed/update/urn:li:a:1 https://www.vinculared.example/posts/x"
    assert one(spark, L.posts_of_text(F.col("t")), t=p) == ["https://www.vinculared.example/posts/x", "https://www.vinculared.example/feed/update/urn:li:a:1"]


def test_pair_people():
    assert L.pair_people("Ana Paz\nIngeniera\nDeveloper SR\nLima, Argentina") == [("Ana Paz", "Ingeniera", ""), ("Developer SR", "", ""), ("Lima, Argentina", "", "")]


CARDS = """<ul><li><div class="base-card base-search-card x"><a class="base-card__full-link" href="https://h/jobs/view/1?r=2"><span>x</span></a>
<h3 class="base-search-card__title"> Dev &amp; Ops </h3><h4 class="base-search-card__subtitle"><a>Acme <b>SA</b></a></h4>
<span class="job-search-card__location">Lima</span><time class="job-search-card__listdate" datetime="2025-01-02">x</time></div>
<li><div class="base-search-card"><h3 class="base-search-card__title">No link</h3></div><li>other</ul>"""


def test_cards_and_details(spark):
    assert H.search_cards(CARDS) == [("https://h/jobs/view/1", "Dev & Ops", "AcmeSA", "Lima", "2025-01-02")]
    assert H.search_cards(None) == H.search_cards("<p><b>broken") == []
    page = '<h1 class="topcard__title">T</h1><div class="description__text">a<p>b<br>c</div>'
    assert H.detail_page(page, "job") == {"title": "T", "company": "", "location": "", "description": "a b c"}
    assert H.detail_page("", "company", "slug")["name"] == "slug"
    assert H.detail_page('<h1 class="org-top-card-summary__title"></h1>', "company", "slug")["name"] == ""
    df = spark.createDataFrame([("k", CARDS), ("n", None)], "k string, html string")
    assert H.card_records(df, "k", "html").count() == 1 and H.detail_records(df, "k", "html", "person").count() == 2


# ------------------------------------------------------------------- de-duplication


def test_first_seen_keeps_blank_rows_and_is_idempotent(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, ""), (4, None), (5, "")], "ingest_seq bigint, k string")
    got = D.first_seen(df, F.col("k"))
    assert sorted(r.ingest_seq for r in got.collect()) == [1, 2, 4, 5]
    assert D.first_seen(got, F.col("k")).count() == 4


def fold(rows):
    held = None
    for r in sorted(rows):
        if held is None or (r[1] and not held[1]) or (r[2] and not held[2]):
            held = r
    return held[0]


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_most_enriched_is_the_ordered_fold(spark, block, monkeypatch):
    monkeypatch.setattr(D, "FOLD_BLOCK", block)
    random.seed(block)
    rows = [(i, f"k{random.randint(0, 4)}", random.choice(["", "ocr", None]), random.choice(["", "False", "True", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "ingest_seq bigint, k string, text_ocr string, is_valid string")
    got = {r.k: (r.ingest_seq, r.first_seq) for r in D.most_enriched(df, F.col("k")).collect()}
    for k in {r[1] for r in rows}:
        mine = [(r[0], bool(r[2]), bool(r[3])) for r in rows if r[1] == k]
        assert got[k] == (fold(mine), min(mine)[0])


def test_fold_golden(spark):
    rows = [(1, "u", "", ""), (2, "u", "", "False"), (3, "u", "ocr", ""), (4, "u", "", "True")]
    df = spark.createDataFrame(rows, "ingest_seq bigint, k string, text_ocr string, is_valid string")
    assert D.most_enriched(df, F.col("k")).first().ingest_seq == 4


def greedy(names, t=0.85):
    kept = []
    for n in names:
        if not n or all(SequenceMatcher(None, n, k).ratio() < t for k in kept if k):
            kept.append(n)
    return kept


def test_dedup_names_is_the_greedy_scan(spark):
    random.seed(5)
    base = ["juan perez", "ana ruiz", "maria gomez", "tide", "diet", "leo paz", "", "ana diaz"]
    names = ["juan perez", "juan pérez", "juana perez", "ana ruis", "maría gómez", "", ""] + ["".join(c if random.random() > 0.08 else random.choice("abcxyz") for c in random.choice(base)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(names)), "ingest_seq bigint, name string")
    got = [r.name for r in D.dedup_names(df).orderBy("ingest_seq").collect()]
    assert got == greedy([n.strip() for n in names])


def test_dedup_names_decides_chains_of_any_length(spark):
    random.seed(11)
    name, names = list("".join(random.choice("abcdefghijklmnop") for _ in range(20))), []
    for _ in range(240):  # each name resembles only the ones just before it
        names.append("".join(name))
        name[random.randrange(20)] = random.choice("abcdefghijklmnop")
    df = spark.createDataFrame(list(enumerate(names)), "ingest_seq bigint, name string")
    assert [r.name for r in D.dedup_names(df).orderBy("ingest_seq").collect()] == greedy(names)


def test_few_pairs_of_names_come_to_the_ratio(spark, monkeypatch):
    """Names made of the same syllables: three bounds leave a small part of the pairs to the ratio, and lose none."""
    random.seed(17)
    made = lambda: "".join(random.choice("bdfglmnprstv") + random.choice("aeiou") for _ in range(random.randint(3, 5)))
    names = list(dict.fromkeys(f"{made()} {random.choice(['group srl', 'sistemas', 'tech s.a.'])}" for _ in range(260)))
    names += [f"{made()} {'x' * 60}" for _ in range(6)]
    names += [n[:-1] + "é" for n in names[:20]] + [f"{n[1:]}q" for n in names[20:40]] + ["a" * 90 + "b", "a" * 90, "日本 tech", " "]
    real, asked = D.SequenceMatcher, []
    monkeypatch.setattr(D, "SequenceMatcher", lambda *a: asked.append(a) or real(*a))
    want = {(i, j) for j in range(len(names)) for i in range(j) if real(None, names[j], names[i]).ratio() >= 0.85}
    rows = [(i % 2, i, n, i) for i, n in enumerate(names)]
    got = set()
    for p, q in [(0, 0), (0, 1), (1, 1)]:
        group = pd.DataFrame([(p, q, *r) for r in rows if r[0] in (p, q)], columns=["p", "q", "block", "id", "n", "seq"])
        got |= {(e, a) for a, e in D.alike(group, 0.85).itertuples(index=False)}
    assert got == want and len(want) > 40
    assert len(asked) < 2 * len(want)
    monkeypatch.undo()
    monkeypatch.setattr(D, "NAME_BLOCK", 64)
    df = spark.createDataFrame(list(enumerate(names)), "ingest_seq bigint, name string")
    assert [r.name for r in D.dedup_names(df).orderBy("ingest_seq").collect()] == greedy(names)


def test_greedy_rounds_equal_the_scan(spark):
    random.seed(3)
    edges = sorted({(b, a, b) for a, b in (sorted(random.sample(range(40), 2)) for _ in range(60))} | {(i, i - 1, i) for i in range(50, 60)})
    gone: set = set()
    for late in range(60):
        if any(b == late and a not in gone for b, a, _ in edges):
            gone.add(late)
    pairs = spark.createDataFrame(edges, "late bigint, early bigint, ls bigint")
    for limit in (0, 12, 1000):
        assert sorted(r.late for r in D.refused(pairs, limit).collect()) == sorted(gone)


def test_dedup_jobs_golden(spark):
    rows = [(1, None, "Publicidad", "", ""), (2, 7, "", "", ""), (3, None, "Dev", "Acme", "Argentina"), (4, 7, "Dev", "Acme", "")]
    df = spark.createDataFrame(rows, "ingest_seq bigint, jobId bigint, title string, companyName string, location string").withColumn("postedDate", F.lit("")).withColumn("applyUrl", F.lit(None).cast("string"))
    got = D.dedup_jobs(df).orderBy(F.desc("score"), "ingest_seq").collect()
    assert [(r.jobId, r.title, r.score) for r in got] == [(7, "", 10), (None, "Dev", 8)]


def test_dedup_all_and_stats(spark):
    cols = "ingest_seq bigint, category string, name string, job_url string, profile_url string, post_url string"
    rows = [(1, "people", "Ana Paz", "", "", ""), (2, "company_employees", "Ana Pas", "", "", ""), (3, "jobs", "", "u/", "", ""), (4, "jobs", "", "U", "", ""), (5, "posts_feed", "", "", "", "p"), (6, "posts_companies", "", "", "", "p"), (7, "company_search", "", "", "", "")]
    df = spark.createDataFrame(rows, cols)
    out = D.dedup_all(df)
    assert {r.bucket: r["count"] for r in out.groupBy("bucket").count().collect()} == {"people": 1, "jobs": 1, "posts": 1}
    stats = {r.category: (r.before, r.after, r.removed, r.pct) for r in D.dedup_stats(df, out.withColumn("category", F.col("bucket"))).collect()}
    assert stats["jobs"] == (2, 1, 1, "50%") and stats["posts"] == (0, 1, -1, "")


# ---------------------------------------------------------------- aggregates, lookups


def test_text_enrich_caps_and_overwrites(spark):
    rows = spark.createDataFrame([(i, "jobs", f"u{i}", "old") for i in range(4)], "ingest_seq bigint, category string, url string, text_ocr string")
    texts = spark.createDataFrame([("u0", "new"), ("u1", ""), ("u3", "late")], "url string, text string")
    got = {r.ingest_seq: r.text_ocr for r in E.text_enrich(rows, texts, "url", 2, "ingest_seq").collect()}
    assert got == {0: "new", 1: "", 2: "old", 3: "old"}
    assert {r.text_ocr for r in E.text_enrich(rows, texts, "url", 2, "ingest_seq", overwrite_blank=False).where("ingest_seq = 1").collect()} == {"old"}


def test_empty_name_holds_everything(spark):
    a, b = spark.createDataFrame([("x",)], "a string"), spark.createDataFrame([("",)], "b string")
    assert E.not_contained(a, b, "a", "b").count() == 0


def test_references_are_added_in_order(spark):
    def added(parsed, refs):
        names, kept = list(parsed), []
        for i, t in enumerate(refs):
            if not any(n in t or t in n for n in names):
                names.append(t)
                kept.append(i)
        return kept

    random.seed(2)
    word = lambda: "".join(random.choice("abc") for _ in range(random.randint(1, 6)))
    cases = [([], ["Ana Ruiz", "Ana Ruiz Paz", "Ana Ruiz", "Leo"]), ([], ["", "Ana"]), ([""], ["Ana"]), (["Ana Ruiz"], ["Ruiz", "Paz", "Ana Ruiz"])]
    cases.append(([word() + "x" for _ in range(5)], [word() for _ in range(80)]))
    for parsed, refs in cases:
        people = spark.createDataFrame([(n,) for n in parsed], "name string")
        got = E.references_added(people, spark.createDataFrame(list(enumerate(refs)), "ingest_seq bigint, name string"))
        assert sorted(r.ingest_seq for r in got.collect()) == added(parsed, refs)


def test_rates_and_pages(spark):
    ev = spark.createDataFrame([("k", dt.datetime(2025, 1, 1, 0, 0, s)) for s in (0, 30, 59)] + [("k", dt.datetime(2025, 1, 1, 0, 1, 1))], "k string, ts timestamp")
    assert sorted((r.calls, round(r.per_minute, 2)) for r in A.rolling_calls(ev, "k", "ts").collect()) == [(1, 1.0), (2, 4.0), (3, 3.05), (3, 5.81)]
    pages = spark.createDataFrame([("s", 0, "a", 1), ("s", 0, "b", 2), ("s", 1, "a", 3), ("s", 2, "c", 4)], "scan string, page int, key string, o int")
    assert [r.page for r in A.page_stop(pages, "scan", "page", "key", "o").collect()] == [0, 0]


# --------------------------------------------------------------------------- budget


def test_budget_golden():
    b = B.Budget()
    s = B.BudgetState(b.burst, b.hourly, 0.0)
    assert s.apply(b, "acquire", 0.0) == 0 and (s.burst, s.hourly) == (6, 98)
    for _ in range(3):
        s.apply(b, "acquire", 0.0)
    assert s.burst == 0 and abs(s.apply(b, "acquire", 0.0) - 7.5) < 1e-9 and abs(s.burst) < 1e-9
    e = B.BudgetState(3.0, 50.0, 0.0)
    e.apply(b, "error", 0.0, 0.0)
    assert e.burst == 0 and e.errors == 1
    fixed = B.Budget(double_charge=False)
    f = B.BudgetState(8, 100, 0)
    f.apply(fixed, "acquire", 0.0)
    assert f.burst == 7


LOG = "k string, seq bigint, ts double, kind string, weight double, cool_run boolean"


def log_rows():
    random.seed(2)
    return [(f"k{random.randint(0, 2)}", i, float(i), random.choice(["acquire", "acquire", "error", "pause"]), None, False) for i in range(40)]


def test_replay_matches_the_state_machine(spark):
    got = {r.seq: (r.wait, r.burst_left) for r in B.replay(spark.createDataFrame(log_rows(), LOG), "k", "seq").collect()}
    states, b = {}, B.Budget()
    for k, seq, ts, kind, _, _ in log_rows():
        s = states.setdefault(k, B.BudgetState(b.burst, b.hourly, ts))
        wait = s.apply(b, kind, ts, 0.0 if kind == "error" else 1.0)
        assert got[seq] == (wait, s.burst)


def test_retry_classes(spark):
    assert one(spark, B.retry_class(F.col("m")), m="Challenge pending") == 45 and one(spark, B.retry_class(F.col("m")), m="timed out") == 15
    assert one(spark, B.backoff_seconds(F.lit(3))) is None and one(spark, B.backoff_seconds(F.lit(2))) == 4.0


# ------------------------------------------------------------- files, sinks, pipelines


def write(path, data):
    path.write_text(json.dumps(data, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_consolidate_files(spark, tmp_path):
    guest = write(tmp_path / "jobs_20250102.json", [{"title": "A", "company": "C", "job_url": "https://h/jobs/view/1?x"}, {"title": "A2", "job_url": "https://h/jobs/view/1", "text_ocr": "t", "is_valid": "True"}])
    tool = write(tmp_path / "tool_20250103.json", [{"title": "T", "companyName": "X", "jobId": 9}, {"title": "N1"}, {"title": "N2"}])
    contacts = write(tmp_path / "empresas.json", [{"nombre": "E", "sitio_web": "https://e/", "emails": "a@b.example", "sector": "IT"}])
    env = write(tmp_path / "all_results_1.json", {"metadata": {}, "results": {"jobs": [{"title": "A3", "job_url": "https://h/jobs/view/1"}, {"title": "Z", "job_url": "https://h/z"}]}})
    out = pipeline.consolidate_files(spark, guest, tool, contacts, env)
    got = {r.url: r for r in out.collect()}
    titles = {k.removeprefix("https://"): v.title for k, v in got.items()}
    assert titles == {"h/jobs/view/1": "A2", "www.vinculared.example/jobs/view/9": "T", "www.vinculared.example/jobs/view/None": "N1", "e": "E", "h/z": "Z"}
    assert got["https://h/jobs/view/1"].origin_date == "20250102" and got["https://e"]["_emails"] == "a@b.example"
    rows = sinks.consolidated_rows(out)
    assert [r.type for r in rows.collect()] == ["job"] * 4 + ["company"]
    sinks.csv_file(rows, rows.columns, str(tmp_path / "c.csv"))
    raw = (tmp_path / "c.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.count(b"\r\n") == 6
    sinks.consolidated_workbook(out, str(tmp_path / "c.xlsx"))
    assert len([n for n in zipfile.ZipFile(tmp_path / "c.xlsx").namelist() if "worksheets" in n]) == 3
    with pytest.raises(ValueError):
        pipeline.consolidate_files(spark)


ITEMS = "ingest_seq bigint, category string, type string, name string, title string, job_url string, profile_url string, post_url string, url string, text_ocr string"


def test_full_run_and_export(spark, tmp_path):
    rows = [(1, "jobs", "job", None, "Desarrollador web", "https://h/1", None, None, "https://h/1", ""), (2, "jobs", "job", None, "Otra cosa", "https://h/2", None, None, "https://h/2", ""),
            (3, "people", "person", "Ana Paz", None, None, None, None, "p", None), (4, "authors", "author", "X", None, None, None, None, "a", None)]
    out = pipeline.full_run(spark.createDataFrame(rows, ITEMS), spark.createDataFrame([("https://h/2", "web empleo")], "url string, text string"), str(tmp_path), "s")
    assert sorted(r.ingest_seq for r in out["valid"].collect()) == [1, 2, 3]
    with open(tmp_path / "records_s.csv", encoding="utf-8-sig", newline="") as f:
        table = list(csv.reader(f))
    assert len(table) == 4 and table[0][0] == "category" and [r[0] for r in table[1:]] == ["jobs", "jobs", "people"]
    book = zipfile.ZipFile(tmp_path / "records_s.xlsx")
    assert b"Desarrollador web" in book.read("xl/worksheets/sheet2.xml") and len([n for n in book.namelist() if "worksheets" in n]) == 11


def test_json_sinks_and_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "ñ"), (2, None)], "a int, b string")
    assert sinks.json_file(df, str(tmp_path / "x.json"), "a") and json.loads((tmp_path / "x.json").read_text("utf-8")) == [{"a": 1, "b": "ñ"}, {"a": 2, "b": None}]
    assert not sinks.json_file(df.limit(0), str(tmp_path / "none.json")) and not (tmp_path / "none.json").exists()
    sinks.envelope_file({"jobs": df}, {"n": 2}, str(tmp_path / "e.json"))
    assert json.loads((tmp_path / "e.json").read_text("utf-8"))["results"]["jobs"][1] == {"a": 2, "b": None}
    for name in ("jobs_1.json", "jobs_3.json", "jobs_2.json"):
        (tmp_path / name).write_text("[]")
    assert readers.latest_file(spark, str(tmp_path / "jobs_*.json")).endswith("jobs_3.json") and readers.latest_file(spark, str(tmp_path / "q_*.json")) is None
    sinks.safe_write(df, str(tmp_path / "p"))
    sinks.safe_write(df.limit(1), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    assert one(spark, readers.first_json_line(F.col("t")), t="log\n{\"a\":1}\n[2]") == '{"a":1}'
    assert readers.page_texts(spark.createDataFrame([("u", 200, "x"), ("v", 404, "y")], "url string, status int, text string")).count() == 1
    (tmp_path / "i.json").write_text('{"title":"t","jobId":5}\n{"unknown":1}\n')
    assert readers.read_items(spark, str(tmp_path / "i.json")).count() == 2


def test_analysis(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "a", "y")], "ingest_seq bigint, search_keyword string, location string")
    out = pipeline.analyse(df)
    assert [(r.location, r.n) for r in out["top_places"].collect()] == [("y", 2), ("x", 1)]
    assert {(r.search_keyword, r.n) for r in out["by_keyword"].collect()} == {("a", 2), ("?", 1)}


def test_addresses_with_an_empty_key_are_one_and_blank_names_too(spark):
    df = spark.createDataFrame([(1, "/"), (2, "?a=1"), (3, ""), (4, None), (5, "#x"), (6, "")], "ingest_seq bigint, job_url string")
    assert sorted(r.ingest_seq for r in D.dedup_urls(df).collect()) == [1, 3, 4, 6]
    names = spark.createDataFrame([(1, " "), (2, "\t"), (3, ""), (4, None), (5, "Ana Ruiz"), (6, "  ")], "ingest_seq bigint, name string")
    assert sorted(r.ingest_seq for r in D.dedup_names(names).collect()) == [1, 3, 4, 5]


def test_total_row_of_the_statistics(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "category string")
    got = {r.category: (r.before, r.after, r.removed, r.pct) for r in D.dedup_stats(a, a.where("category = 'y'")).collect()}
    assert got == {"x": (2, 0, 2, "100%"), "y": (1, 1, 0, "0%"), "TOTAL": (3, 1, 2, "")}
    assert {r.category for r in D.dedup_stats(a.limit(0), a.limit(0)).collect()} == {"TOTAL"}


def test_joined_text_over_blocks_and_names_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(A, "JOIN_BLOCK", 3)
    rows = [("k", i, f"t{i}" if i % 4 else None) for i in range(10)] + [("n", 1, None), (None, 2, "z")]
    df = spark.createDataFrame(rows, "k string, o int, x string")
    assert {r.k: r.joined for r in A.joined_text(df, "k", "o", "x", "|").collect()} == {"k": "t1|t2|t3|t5|t6|t7|t9", "n": "", None: "z"}
    a = spark.createDataFrame([("Ana Ruiz",), ("Leo Paz",), ("Eva",), ("Lía Sol",)], "a string")
    b = spark.createDataFrame([("Ana",), ("Leo Paz Gil",), ("Eva",)], "b string")
    small = sorted(r.a for r in E.not_contained(a, b, "a", "b").collect())
    monkeypatch.setattr(E, "broadcast_if_small", lambda df, *_: df)
    assert sorted(r.a for r in E.not_contained(a, b, "a", "b").collect()) == small == ["Lía Sol"]


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    from types import SimpleNamespace

    from acequia.session import shared_dir

    bare = SimpleNamespace(get=lambda *_: None)
    sc = SimpleNamespace(getConf=lambda: bare, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=sc, conf=bare))


def test_delivered_pages_go_to_their_buckets(spark):
    c = spark.createDataFrame([(1, "A", "https://x/company/a/", None), (2, "A2", "https://x/company/a", None), (3, None, None, "b"), (4, "C", "", ""), (5, "D", None, None)], "ingest_seq bigint, name string, url string, external_id string")
    j = spark.createDataFrame([(1, "J", None, "https://x/jobs/view/7/", None, None), (2, None, "u2", None, None, "7"), (3, "K", None, None, None, "9"), (4, "L", None, None, "u4", "")], "ingest_seq bigint, title string, url string, job_url string, applyUrl string, external_id string")
    p = spark.createDataFrame([(1, "P", "https://x/in/ana/"), (2, "Q", "https://x/in/ana"), (3, None, "https://x/in/leo"), (4, "R", "https://x/other"), (5, "S", None)], "ingest_seq bigint, name string, url string")
    host = "https://www.vinculared.example"
    urls = [f"{host}/company/{k}/{t}" for k in "ab" for t in ("about", "posts")] + ["https://x/jobs/view/7/", "u4", "https://x/in/ana/", "https://x/in/leo"]
    pages = spark.createDataFrame([(u, 200, None if u == "u4" else "t") for u in urls] + [("u4", 200, None), (f"{host}/company/d/about", 404, "t")], "url string, status int, text string")
    got = sorted((r.bucket, r.name, r.external_id, r.url, r.text_ocr) for r in pipeline.routed_pages(c, j, p, pages, {"posts": 1}).collect())
    assert got == sorted([
        ("company_profiles", "A", "a", f"{host}/company/a/about", "t"), ("company_profiles", "b", "b", f"{host}/company/b/about", "t"), ("posts_companies", "a", "a", f"{host}/company/a/posts", "t"),
        ("job_details", "J", "7", "https://x/jobs/view/7/", "t"), ("job_details", "L", "u4", "u4", ""), ("person_profiles", "P", "ana", "https://x/in/ana/", "t"), ("person_profiles", "", "leo", "https://x/in/leo", "t"),
    ])
    assert pipeline.routed_pages(c.limit(0), j.limit(0), p.limit(0), pages.limit(0)).collect() == []
