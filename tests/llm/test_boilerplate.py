"""Page boilerplate: the tree, unseen pages and edge cases."""

from acequia.llm.boilerplate import boilerplate_lines, classify, find_boilerplate, fit, labelled_table, link_density, main_body
from acequia.llm.textkind import is_scanned

PAGE = """Home | Jobs | Sign in
Jobs › Lima › Go

Writer Go
Quillabyte Labs
Lima, Perú

About the role
• We value clear communication and autonomy.
You will design cookie notices and privacy panels for clients.
We use cookies to improve your experience on this site.
Accept all
Similar jobs
Tester Vue
Norvane Labs
Madrid, España
Show more
Track record
For 6 years I worked in payments for clients in travel.
12 reactions · 12 comments

About · Privacy Policy · © 2024 Vinculared"""
MARKS = "--  +++ +++--------++- -"


def test_tree_fits_its_table_and_an_unseen_page():
    tree = fit()
    x, y, _ = labelled_table()
    assert (classify(tree["tree"], x) == y).mean() > 0.93
    lines = PAGE.split("\n")
    bad = set(boilerplate_lines(tree, PAGE))
    want = {0, 1, 10, 11, 12, 13, 14, 15, 16, 19, 21}
    assert bad == want, [lines[i] for i in bad ^ want]


def test_link_density():
    assert link_density("Home | Jobs (3) | Sign in") == 1.0 and link_density("We like Java and clear words.") == 0.0 and link_density("English Español Português") == 1.0


def test_scanned_blank_and_odd_texts(spark):
    scan = "We value clear\ncommunication and order.\n1"
    assert is_scanned(scan) and not is_scanned(PAGE) and not is_scanned(None) and not is_scanned("")
    rows = [("t", 1, PAGE, 5), ("t", 2, scan, 5), ("t", 3, None, 5), ("t", 4, "", 5), ("t", 5, " \n ", 5), ("t", 6, "Home", 5), ("t", 7, "Somos un grupo.\n" * 20000, 5), ("t", 1, PAGE, 5)]
    df = spark.createDataFrame(rows, "table_name string, ingest_seq bigint, text string, line_no int")
    got = find_boilerplate(df).collect()
    assert {r.ingest_seq for r in got} == {1, 6} and sum(r.ingest_seq == 1 for r in got) == 22
    body = {r.ingest_seq: r.text for r in main_body(df).collect()}
    assert "Similar jobs" not in body[1] and "Writer Go" in body[1] and body[2] == scan and body[3] is None and body[6] == ""
    assert find_boilerplate(df.limit(0)).collect() == []


#: Pages of sites none of whose links any list holds.
NEWS = """Sections
Opinion
Local
Sport
Podcasts

Ferry strike enters second week

Crews voted on Sunday to stay ashore until the company restores the night allowance.
Passengers were sent to the airport, where queues reached the car park.

More stories
Island hospital gets scanner
Boat race moved to May
Sign up to our weekly newsletter
Terms of service | Privacy notice | Copyright 2024 Island Post"""
GARDEN = """Inicio
Tarifas
Sucursales
Blog

Cómo podar un ciruelo

Cortá siempre por encima de una yema que mire hacia afuera.
Desinfectá la tijera entre planta y planta.
El mejor momento es el final del invierno.

También te puede gustar
Injertos de primavera
Abonos caseros
Recibí nuestro boletín
Aviso legal | Privacidad | Mapa del sitio"""


def test_pages_of_unknown_sites():
    model, hit, want, false = fit(), 0, 0, 0
    for page, bad in ((NEWS, {0, 1, 2, 3, 4, 11, 12, 13, 14, 15}), (GARDEN, {0, 1, 2, 3, 11, 12, 13, 14, 15})):
        found = set(boilerplate_lines(model, page))
        hit, want, false = hit + len(found & bad), want + len(bad), false + len(found - bad)
    assert hit >= 0.8 * want and false <= 1
    body = "Crews voted on Sunday to stay ashore until the company restores the night allowance."
    assert NEWS.split("\n").index(body) not in boilerplate_lines(model, NEWS)


def test_labels_are_no_lines_of_the_tables(sf):
    """Nothing that the classifier is used on is in its labelled table, but for words of a link."""
    import duckdb

    from acequia.llm.boilerplate_labels import PAGES

    lines = {x[2:].strip() for page in PAGES for x in page.split("\n") if len(x.split()) >= 8}
    texts = [r[0] for t, c in (("person_profiles", "text_ocr"), ("job_details", "text_ocr"), ("posts_companies", "text")) for r in duckdb.connect().execute(f"select {c} from '{sf}/{t}.parquet' where {c} is not null").fetchall()]
    assert not lines & {x.strip() for t in texts for x in t.split("\n")}
