"""Matching: parsing, distances and pairs on invented openings."""

import itertools
import random

from pyspark.sql import functions as F

from acequia.llm import entity_match as em
from acequia.llm.entity_match import candidate_pairs, edits, match_entities, parse_company, parse_place, parse_title, parsed, similarities, title_words


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edits_against_brute_force():
    random.seed(1)
    for _ in range(400):
        a, b = ("".join(random.choice("abc") for _ in range(random.randint(0, 7))) for _ in range(2))
        assert edits(a, b) == min(osa(a, b), 4)


def test_titles():
    assert parse_title("Semi Senior Angular Gerente") == ("manager", "angular", "semi") == parse_title("Manager Angular Ssr | ingreso inmediato")
    assert parse_title("Desarrollador/a Cybersecurity Sr.") == ("developer", "security", "senior") == parse_title("Ciberseguridad - Dev Senior")
    assert parse_title("Líder Técnico .NET Trainee") == ("lead", "dotnet", "trainee") == parse_title("Trainee Tech Lead (.NET) with verification")
    assert parse_title("Sr. PythonSoporte") == ("support", "python", "senior") and parse_title("Writer Pythoon Jr") == ("writer", "python", "junior") and parse_title("Manage rVue") == ("manager", "vue", "")


def test_titles_outside_the_lexicon():
    assert title_words("Florist (Weekend)", *parse_title("Florist (Weekend)")[:2]) == ["florist", "weekend"]
    assert parse_title("Kotlin - especialista ssemi-sr")[2] == "semi" and parse_title("Especialista AngularJ r.")[2] == "junior"


def _vector(spark, a, b):
    """FEATURES of two (title, company, place)."""
    def row(t, n, p):
        role, tech, level = parse_title(t)
        return (title_words(t, role, tech), level, *parse_company(n), *parse_place(p))

    cols = lambda p: ", ".join(f"{p}{c} {'array<string>' if c == 'words' else 'string'}" for c in em.CONTENT)
    df = spark.createDataFrame([row(*a) + row(*b)], cols("l") + ", " + cols("o"))
    return df.select(*[c.alias(f) for f, c in similarities().items()]).first()


def test_similarities(spark):
    t = "Java Analyst"
    c = lambda a, b: _vector(spark, (t, a, ""), (t, b, "")).company
    assert c("LetenomavikSistemas", "Letenomavik Sistemas S.A.") == c("Bubepifos", "Bubepifos Labs S.A.") == 0.99 and c("Padulesin oSftware", "Padulesin Software SL") == 0.82
    assert c("Lulolulax Sistemas", "Luladulax Sistemas") < 0.5 and c("Fulasefos Labs", "Fulasefos Software") < 0.5
    p = lambda a, b: _vector(spark, (t, "Xyz", a), (t, "Xyz", b)).place
    assert p("CABA (Híbrido)", "Buenos Aires, Argentina") == 1 and p("La Plata", "Buenos Aires, Argentina") == 0 and p("Argentina", "Rosario, Santa Fe, Argentina") == 0.9
    assert p(None, "Lima, Perú") == p("", "Lima") == 0.8 and p("Chile", "Lima, Perú") == 0
    w = lambda a, b: _vector(spark, (a, "Xyz", ""), (b, "Xyz", "")).title
    assert w("Florist weekend", "Weekend florist") == 1 and w("Florist weekend", "Weekend flrist") > 0.8 and w("Florist weekend", "Weekend baker") < 0.6


def _openings(n, roles, seed):
    """(openings, listings, true pairs): listings with a typing error, another order or no place."""
    rnd = random.Random(seed)
    syl = lambda: "".join(rnd.choice("bdfglmnprst") + rnd.choice("aeiou") for _ in range(4)).capitalize()
    places = ["Ulverton, Northmark", "Sedgeby", "Castro Alto", "Pelham Cross"]
    openings, listings, want = [], [], set()
    for i in range(n):
        co, r, x, p = syl() + " " + rnd.choice(["Freight", "Foods", "Clinics"]), rnd.choice(roles), rnd.choice(["night", "harbour", "retail"]), rnd.choice(places)
        openings.append((i, f"Senior {r} {x}", co, None, p, "x"))
        if i % 2 == 0:
            t = f"{x} {r} Sr"
            if i % 4 == 0:
                k = rnd.randrange(len(r) - 1)
                t = f"{x} {r[:k] + r[k + 1:]} sr."
            elif i % 6 == 0:
                k = rnd.randrange(1, 5)
                co = co[:k] + co[k + 1] + co[k] + co[k + 2 :]
            listings.append((i, t, co, p if i % 10 else None, 0))
            want.add((i, i))
        else:  # another post of the company
            listings.append((i, f"{x} {rnd.choice([q for q in roles if q != r])} Sr", co, p, 0))
    return openings, listings, want


def test_candidates_are_all_that_share_an_end_and_a_word(spark):
    """Against every pair by definition; joined are few more than resemble, though all companies end alike."""
    rnd = random.Random(8)
    ends, legal = ["quen", "inor"], ["", "", " S.A.", " SRL", " X Labz"]
    lines = ["", "", " Labs", " Tech", " Group", " Soluciones", " Sistemas", " Sistmas", "labs", " Consultores"]
    syl = lambda n: "".join(rnd.choice("bdfgl") + rnd.choice("aei") for _ in range(n))
    made = lambda i: (i, f"{rnd.choice(['Java', 'Go'])} {rnd.choice(['Analista', 'Baker'])}", syl(rnd.choice([1, 2, 3])) + rnd.choice(ends) + rnd.choice(lines) + rnd.choice(legal), rnd.choice(["Lima", None, "Madrid"]))
    rows = [made(i) for i in range(900)] + [(900, "Java Baker", "!!", "Lima"), (901, "Java Baker", "xyztech", None), (902, "Java Baker", "日本", None), (903, "Go Baker", "techlabs", None)]
    for i, (x, y) in enumerate([("Sistemas", "sis Tech"), ("Sistemas", "sistem Labs"), ("Soluciones", "soluci Tech"), ("Digital", "digi Labs"), ("Digital", "dig Tech"), ("Software", "sof Tech"), ("Consultores", "consulto Labs"), ("Servicios", "servici Labs")]):
        rows += [(910 + 2 * i, "Java Baker", f"bifaga {x}", None), (911 + 2 * i, "Java Baker", f"bifaga{y}", None)]
    schema = "row bigint, title string, name string, place string"
    lc, oc = (parsed(spark.createDataFrame(r, schema), "row", "title", F.col("name"), "place")[0] for r in (rows[:900:3] + rows[900:], rows))
    ls, os_ = lc.collect(), oc.collect()
    ends_of = lambda c: (c[:4], c[-4:])
    want = set()
    for a, b in itertools.product(ls, os_):
        alike = any(x == y for x, y in zip(ends_of(a.core), ends_of(b.core))) and set(a.words) & set(b.words)
        placed = a.whole == b.whole and (a.city, a.country) == (b.city, b.country) != ("", "")
        gap = edits(a.whole, b.whole)
        if a.core == b.core and "" in (a.line, b.line):
            gap = 0
        if (alike or placed) and gap <= 3:
            want.add((a.id, b.id))
    got = [(r.lid, r.oid) for r in candidate_pairs(lc, oc).collect()]
    assert len(got) == len(set(got)) and len(want) > 2000
    assert want - set(got) == set()
    assert {p for p in got if p not in want} == set()
    keyed = lambda d, p: em._keys(d, p).groupBy("key").agg(F.count("*").alias(p))
    joined = keyed(lc, "l").join(keyed(oc, "o"), "key").agg(F.sum(F.col("l") * F.col("o"))).first()[0]
    assert joined < 0.4 * len(ls) * len(os_)


def test_mixture_decides_on_words_it_never_saw(spark):
    """Roles, places and businesses that no list holds; the blocking loses under 5 %."""
    openings, listings, want = _openings(300, ["machinist", "florist", "paramedic", "surveyor", "upholsterer"], 5)
    o = spark.createDataFrame(openings, "ingest_seq bigint, title string, company string, companyName string, location string, confidence string")
    s = spark.createDataFrame(listings, "listing_id bigint, title string, companyName string, location string, line_no int")
    lc, _ = parsed(s, "listing_id", "title", F.col("companyName"), "location")
    oc, _ = parsed(o, "ingest_seq", "title", F.col("company"), "location")
    blocked = {(r.ofirst, r.lfirst) for r in candidate_pairs(lc, oc).join(lc.selectExpr("id as lid", "first as lfirst"), "lid").collect()}
    assert len(want & blocked) >= 0.95 * len(want)
    got = {(r.ingest_seq, r.listing_id) for r in match_entities(s, o).collect()}
    assert len(want & got) >= 0.93 * len(want) and len(got - want) <= 0.02 * len(got)


def test_pairs(spark):
    random.seed(2)
    syl = lambda: "".join(random.choice("bdfglmnprst") + random.choice("aeiou") for _ in range(4)).capitalize()
    roles, techs, levels, places = [("Analista", "Analyst"), ("Gerente", "Manager")], ["Java", "Go", "Vue"], [("Sr", "Senior"), ("Jr", "Junior")], [("Lima, Perú", "Lima Metropolitana"), ("Madrid, España", "Madrid, Spain")]
    openings, listings, want = [], [], set()
    for i in range(120):
        co, r, t, l, p = f"{syl()} Labs", random.choice(roles), random.choice(techs), random.choice(levels), random.choice(places)
        openings.append((i, f"{r[0]} {t} {l[0]}", co + " S.A." if i % 2 else None, None if i % 2 else co, p[0], "x"))
        if i % 3 == 0:
            listings.append((i, f"{l[1]} {t} {r[1]}", co.lower(), p[1] if i % 2 else None, 0))
            want.add((i, i))
        elif i % 3 == 1:  # another post, or another place
            other = places[1 - places.index(p)][1]
            listings.append((i, f"{l[1]} {t} {r[1]}", co, other, 0) if i % 2 else (i, f"{l[1]} {t} {'Tester'}", co, p[1], 0))
    listings += [(900, None, "X", None, 0), (901, "", "", "", 0), (902, "x" * 5000, "y" * 5000, "z", 0), (0, *listings[0][1:])]
    o = spark.createDataFrame(openings, "ingest_seq bigint, title string, company string, companyName string, location string, confidence string")
    s = spark.createDataFrame(listings, "listing_id bigint, title string, companyName string, location string, line_no int")
    got = match_entities(s, o).collect()
    assert {(r.ingest_seq, r.listing_id) for r in got} == want and all(0.5 <= r.confidence <= 1 for r in got)
    assert match_entities(s.limit(0), o).collect() == [] and match_entities(s, o.limit(0)).collect() == []
