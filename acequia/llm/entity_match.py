"""The same openings matched across sources that share no key, each pair with a confidence.

Titles become words: synonyms, translations and seniorities of the lexicon level out and
single typing errors against it are corrected; words the lexicon lacks stand for
themselves. Company names lose legal suffixes, places become a city and a country. Distinct
openings and listings of equal content are matched once; members come back at the end.

Candidates share the beginning or the end of the company's core name and one word of the
title, or the whole company and the place; no key fixes the title. Each pair has a vector
of graded similarities. A mixture of two Gaussians, matched and unmatched, with regularised
covariance is fitted to the vectors by expectation-maximisation until it stands still,
without any labels. Similarities lie on a grid, so the fit itself needs only the number of
pairs at each of its points, at most a few thousand rows whatever the corpus. Transitivity
is enforced in the E-step: a listing that matched two openings, or an opening two listings,
would make these the same, which distinct contents aren't, so the posteriors of the pairs
of either may not add up to more than one. A pair is a match if its posterior is at least
``ACCEPT``; nothing else decides.

Defined results: a null, empty or blank title or company matches nothing; a missing place
contradicts nothing; of openings with equal content the row that arrived first stands for
them; ties in confidence go to it as well.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from acequia.session import settle

# A lexicon of roles with their words, technologies, seniorities (accents
# removed). It levels synonyms out; words that it lacks are compared as they stand.
ROLES = {
    "developer": ["desarrollador", "desarrolladora", "developer", "dev", "desenvolvedor", "programador"],
    "engineer": ["engineer", "ingeniero", "ingeniera", "engenheiro"],
    "analyst": ["analyst", "analista"],
    "architect": ["architect", "arquitecto", "arquitecta", "arquiteto"],
    "consultant": ["consultant", "consultor", "consultora"],
    "specialist": ["specialist", "especialista"],
    "coordinator": ["coordinator", "coordinador", "coordinadora", "coordenador"],
    "manager": ["manager", "gerente"],
    "designer": ["designer", "disenador", "disenadora"],
    "writer": ["writer", "redactor", "redactora"],
    "administrator": ["administrator", "administrador", "administradora", "admin"],
    "support": ["support", "soporte", "suporte"],
    "tester": ["tester", "testador"],
    "lead": ["techlead", "lidertecnico", "lead", "lider"],
}
TECHNOLOGIES = {
    t: [t] for t in "node angular vue react magento salesforce laravel java php sap wordpress kotlin go devops python seo cloud".split()
} | {"data": ["data", "datos", "dados"], "security": ["cybersecurity", "ciberseguridad", "ciberseguranca"], "dotnet": [".net", "net", "dotnet"]}
SENIORITY = {
    "trainee": r"\btrainee\b|\btrainne\b|\btraine\b|\btainee\b|\brainee\b",
    "semi": r"\bsemi[ -]?(?:senior|sr)\b|\bssr\b|\bsemisr\b|\bsemisenior\b|\bpleno\b",
    "junior": r"\bjunior\b|\bjr\b",
    "senior": r"\bsenior\b|\bsr\b",
}
TITLE_NOISE = re.compile(r"with verification|ingreso inmediato|urgente|\([a-z]\)|/[ao]s?\b")
LEGAL = re.compile(r"(?:\s|^)(?:s\.?r\.?l\.?|s\.?a\.?s?\.?|ltda\.?|inc\.?|l\.?l\.?c\.?|s\.?l\.?u?\.?|latam|argentina|corp\.?|gmbh|ltd\.?|s\.?a\.? de c\.?v\.?)(?=\s|$)")
BUSINESS = ["group", "sistemas", "servicios", "digital", "software", "tech", "consultores", "studio", "soluciones", "labs"]
#: City, country, pattern; the first that fits is taken.
PLACES = [
    ("la plata", "ar", r"la plata"),
    ("cordoba", "ar", r"cordoba|\bcba\b"),
    ("rosario", "ar", r"rosario"),
    ("mendoza", "ar", r"mendoza|\bmza\b"),
    ("buenos aires", "ar", r"buenos aires|\bcaba\b|capital federal|bs\.? ?as"),
    ("santiago", "cl", r"santiago|\bstgo\b|region metropolitana"),
    ("mexico city", "mx", r"ciudad de mexico|\bcdmx\b|mexico city|cd\.? de mexico|mexico d\.?f"),
    ("montevideo", "uy", r"montevideo|\bmvd\b"),
    ("bogota", "co", r"bogota"),
    ("madrid", "es", r"madrid"),
    ("sao paulo", "br", r"sao paulo|\bsp\b"),
    ("barcelona", "es", r"barcelona|\bbcn\b"),
    ("new york", "us", r"new york|nueva york|\bnyc\b|\bny\b"),
    ("lima", "pe", r"\blima\b"),
    ("miami", "us", r"miami"),
]
COUNTRIES = {
    "ar": r"argentina", "cl": r"\bchile\b", "mx": r"mexico", "uy": r"uruguay|\buy\b", "co": r"colombia", "es": r"espana|spain", "br": r"bra[sz]il",
    "us": r"\bfl\b|\bny\b|florida|united states|estados unidos|\beeuu\b|\busa\b", "pe": r"peru",
}

FEATURES = ["company", "level", "place", "title"]
#: Steps of the title's similarity; the other features have fewer values.
GRID = 20
RIDGE = 0.01
#: Candidates' companies resemble at least so much (three edits); else nothing links them.
RESEMBLES = 0.01
#: EM begins with the pairs whose similarities are all at least these, in the order of FEATURES.
START = [0.5, 0.75, 0.5, 0.75]
ACCEPT = 0.5
#: EM ends when the posteriors of all pairs together move by less than this share of the pairs.
STILL = 1e-6
MOST_ROUNDS = 1_000
#: Posterior below which a pair can't bear on the constraints.
ALIVE = 1e-6
POINT = "company double, level double, place double, title double, point int, raw double"


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


def edits(a: str, b: str, most: int = 4) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, up to ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) >= most:
        return most
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(new[-1] + 1, old[j] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            new.append(d)
        if min(new) >= most:
            return most
        older, old = old, new
    return min(old[-1], most)


def _vocabulary(groups: dict[str, list[str]]) -> dict[str, str]:
    return {w: k for k, ws in groups.items() for w in ws}


_ROLE, _TECH = _vocabulary(ROLES), _vocabulary(TECHNOLOGIES)


def _find(words: list[str], vocabulary: dict[str, str]) -> str:
    for w in words:
        if w in vocabulary:
            return vocabulary[w]
    for w in words:  # one typing error
        if len(w) >= 3:
            near = sorted((edits(w, v, 2), v) for v in vocabulary if len(v) >= 4 and abs(len(v) - len(w)) <= 1)
            if near and near[0][0] <= 1:
                return vocabulary[near[0][1]]
    run = "".join(words)  # words run together
    inside = [v for v in vocabulary if len(v) >= 4 and v in run]
    return vocabulary[max(inside, key=len)] if inside else ""


_LEVEL_WORDS = {"trainee": "trainee", "junior": "junior", "jr": "junior", "senior": "senior", "sr": "senior", "ssr": "semi", "semisenior": "semi", "semisr": "semi"}


def _left_over(words: list[str], *known: str) -> str:
    """The letters of a title without the words of its role and technology."""
    run = re.sub(r"[^a-z0-9.+#]", "", "".join(words))
    for k in known:
        forms = [v for group in (ROLES, TECHNOLOGIES) for v in group.get(k, ())]
        hit = max((v for v in forms if v in run), key=len, default="")
        run = run.replace(hit, "", 1) if hit else run
    return re.sub(r"[^a-z]", "", run)


@lru_cache(maxsize=200_000)
def parse_title(title: str) -> tuple[str, str, str]:
    """(role, technology, seniority); what can't be told is ''."""
    s = TITLE_NOISE.sub(" ", fold(title))
    s = s.replace("tech lead", "techlead").replace("lider tecnico", "lidertecnico").replace("lider tecnica", "lidertecnico")
    words = re.findall(r"\.net\b|[a-z0-9+#]+", s)
    flat = " ".join(words)
    level = next((k for k, rx in SENIORITY.items() if re.search(rx, flat)), "")
    if not level:
        names = {"trainee": "trainee", "junior": "junior", "senior": "senior", "semisenior": "semi"}
        level = next((names[v] for w in words if len(w) >= 5 for v in names if w not in _ROLE and w not in _TECH and edits(w, v, 2) <= 1), "")
        if level == "senior" and any(edits(w, "semi", 2) <= 1 and len(w) >= 3 for w in words if w not in _TECH and w not in _ROLE):
            level = "semi"
    tech = _find(words, _TECH)
    if not tech:  # short names with an error or run together: what is left of the title
        rest = re.sub(r"[^a-z0-9.+#]", "", "".join(words))
        for w in sorted([*_ROLE, "semisenior", "semisr", "trainee", "senior", "junior", "ssr", "sr", "jr"], key=len, reverse=True):
            rest = rest.replace(w, "", 1)
        near = sorted((edits(rest, v, 2), v) for v in _TECH)
        tech = _TECH[near[0][1]] if rest and near[0][0] <= 1 else ""
    role = _find(words, _ROLE)
    if level in ("", "senior") and role and tech:  # a seniority with an error, or run into its neighbours
        rest = _left_over(words, role, tech)
        near = sorted((edits(rest, v, 2), -len(v), v) for v in _LEVEL_WORDS if len(rest) >= 2 and (len(v) > 3 or v == rest))
        level = _LEVEL_WORDS[near[0][2]] if near and near[0][0] <= 1 else level
    return role, tech, level


def title_words(title: str, role: str, tech: str) -> list[str]:
    """What a title is compared by: role and technology, else its words but the seniority."""
    if role and tech:
        return sorted({role, tech})
    words = re.findall(r"[\w+#]+", TITLE_NOISE.sub(" ", fold(title)))
    own = {_ROLE.get(w) or _TECH.get(w) or w for w in words if w not in _LEVEL_WORDS and w not in ("semi", "de", "of", "en", "in", "a", "e", "y", "and")}
    return sorted(own | {w for w in (role, tech) if w})


@lru_cache(maxsize=200_000)
def parse_company(name: str) -> tuple[str, str, str]:
    """(whole without spaces and suffixes, core without the line of business, that line)."""
    s = re.sub(r"\s+", " ", fold(name)).strip()
    while True:
        cut = LEGAL.sub(" ", s).strip()
        if cut == s or not cut:
            break
        s = cut
    whole = re.sub(r"[^a-z0-9]", "", s)
    line = next((b for b in BUSINESS if whole.endswith(b) and len(whole) - len(b) >= 4), "")
    return whole, whole[: len(whole) - len(line)] if line else whole, line


@lru_cache(maxsize=50_000)
def parse_place(place: str | None) -> tuple[str, str]:
    """(city, country); '' where it isn't said."""
    s = re.sub(r"\(.*?\)", " ", fold(place or ""))
    for city, country, rx in PLACES:
        if re.search(rx, s):
            return city, country
    country = next((k for k, rx in COUNTRIES.items() if re.search(rx, s)), "")
    rest = "" if country else re.sub(r"[^a-z]+", " ", s.split(",")[0]).strip()
    return rest, country


PARSED = "title string, name string, place string, words array<string>, level string, whole string, core string, line string, city string, country string, mark bigint"
CONTENT = ["words", "level", "whole", "core", "line", "city", "country"]


def parsed(records: DataFrame, key: str, title: str, company, location: str, members: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(contents, members): distinct parsed contents with an id, and which rows have each, if asked for.

    Both come from one pass over distinct strings; rows without title or company drop out.
    """
    raw = records.select(F.col(key).alias("row"), F.col(title).alias("title"), company.alias("name"), F.col(location).alias("place"))
    raw = raw.where("trim(title) <> '' and trim(name) <> ''").withColumn("place", F.coalesce("place", F.lit("")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, n, p in zip(pdf.title, pdf.name, pdf.place):
                role, tech, level = parse_title(t)
                company = parse_company(n)
                out.append((t, n, p, title_words(t, role, tech), level, *company, *parse_place(p), letters(company[0])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PARSED.split(", ")])

    forms = raw.select("title", "name", "place").distinct().mapInPandas(run, PARSED)
    rows = raw.join(forms, ["title", "name", "place"]).select("row", *CONTENT, "mark")
    rows = rows.withColumn("id", F.xxhash64(*CONTENT))
    rows = settle(rows, f"p7-{key}") if members else rows
    contents = rows.groupBy("id").agg(F.min("row").alias("first"), *[F.first(c).alias(c) for c in [*CONTENT, "mark"]])
    return settle(contents, f"p7-contents-{key}"), rows.select("id", "row") if members else None


def _close_lines() -> list[tuple[str, str]]:
    """(longer, shorter) lines of business that names with the one and the other can end in and be within three edits."""
    apart = lambda x, y: min([edits(x, y[j:]) for j in range(len(y) + 1)] + [edits(x[i:], y) for i in range(len(x) + 1)])
    pairs = [sorted(p, key=len, reverse=True) for p in combinations(BUSINESS, 2)]
    return [(x, y) for x, y in pairs if apart(x, y) <= 3]


def _keys(c: DataFrame, side: str) -> DataFrame:
    """A row for each key of a content of ``side`` l or o; hot companies are split by word, by line and by place.

    No pair within three edits is lost. Companies with the same line, or without any, meet
    under it; one with another line comes there only if its end is within three edits of
    that line as well. Where one of two has a line (the tag says which), they meet apart; if
    they only end alike their lengths differ by three at most, as equal cores begin alike.
    """
    k = lambda tag, *cols: F.xxhash64(F.lit(tag), *cols)
    begin, end, other = F.substring("core", 1, 4), F.expr("right(core, 4)"), "o" if side == "l" else "l"
    bare = F.when(F.col("line") == "", F.lit(side)).otherwise(F.lit(other))  # which of the two has no line
    close = _close_lines()
    near = lambda x: f"exists(sequence({len(x) - 3}, {len(x) + 3}), n -> levenshtein(right(whole, n), '{x}', 3) >= 0)"
    others = ", ".join(f"if(line = '{y}' and {near(x)}, '{x}', null)" for x, y in close)
    lines = F.when(F.col("line").isin(*{y for _, y in close}), F.expr(f"filter(array(line, {others}), x -> x is not null)")).otherwise(F.array("line"))
    # rows rather than lambdas, which aren't compiled
    by_line = c.withColumn("z", F.explode(lines)).withColumn("w", F.explode("words"))
    spans = F.expr("sequence(greatest(length(whole) - 3, 0) div 4, (length(whole) + 3) div 4)" if side == "l" else "array(length(whole) div 4)")
    apart = c.withColumn("n", F.explode(spans)).withColumn("w", F.explode("words"))
    placed = c.where("city <> '' or country <> ''").withColumn("key", k("p", "whole", "city", "country"))
    parts = [
        by_line.withColumn("key", F.explode(F.array(k("b", begin, "w", "z"), k("e", end, "w", "z")))),
        c.withColumn("w", F.explode("words")).withColumn("key", k("mb", bare, begin, "w")),
        apart.withColumn("key", k("me", bare, end, "w", F.col("n").cast("bigint"))),
        placed,
    ]
    return reduce(DataFrame.unionByName, [p.select(*c.columns, "key") for p in parts])


@lru_cache(maxsize=50_000)
def letters(name: str) -> int:
    """Bits of a name's letters, first ones apart from further ones; an edit changes two of them at most."""
    marks = 0
    for ch in name:
        bit = 1 << ord(ch) % 32
        marks |= bit << 32 if marks & bit else bit
    return marks - (1 << 64) if marks >> 63 else marks


def _gap(a: str, b: str) -> str:
    """SQL of the edits between two names, up to 4, a swap of neighbours counted once."""
    letters = lambda c: f"array_join(array_sort(split({c}, '')), '')"
    d = f"levenshtein({a}, {b}, 4)"
    return f"case when {a} = {b} then 0 when {d} = 2 and length({a}) = length({b}) and {letters(a)} = {letters(b)} then 1 when {d} < 0 then 4 else {d} end"


def similarities() -> dict[str, Column]:
    """FEATURES of a pair whose sides are prefixed l and o, each on a grid."""
    gap = F.expr(
        f"case when lwhole = owhole then 0 when lline = '' and oline = '' then {_gap('lwhole', 'owhole')}"
        f" when lline = '' or oline = '' then least({_gap('lwhole', 'owhole')}, if(lcore = ocore, 0, 4)) else {_gap('lwhole', 'owhole')} end"
    )
    place = F.expr(
        "case when (lcity = '' and lcountry = '') or (ocity = '' and ocountry = '') then 0.8"
        " when lcity <> '' and ocity <> '' then if(lcity = ocity, 1.0, 0.0)"
        " when lcountry <> '' and ocountry <> '' then if(lcountry = ocountry, 0.9, 0.0) else 0.8 end"  # what isn't said contradicts nothing
    )
    rank = lambda c: f"array_position(array('trainee', 'junior', 'semi', 'senior'), {c})"
    level = F.expr(f"case when llevel = olevel then 1.0 when llevel = '' or olevel = '' then 0.25 else 0.5 - 0.25 * (abs({rank('llevel')} - {rank('olevel')}) - 1) end")
    both = F.size(F.array_intersect("lwords", "owords"))
    mine, theirs = F.array_join(F.array_except("lwords", "owords"), ""), F.array_join(F.array_except("owords", "lwords"), "")
    rest = F.size("lwords") + F.size("owords") - 2 * both
    near = F.greatest(F.lit(0.0), 1 - 2.0 * F.levenshtein(mine, theirs) / F.greatest(F.length(mine), F.length(theirs), F.lit(1)))
    title = F.when(rest == 0, 1.0).otherwise((2 * both + rest * near) / (F.size("lwords") + F.size("owords")))
    on = {"company": F.round(1 / (1 + F.exp(3 * (gap - 1.5))), 2), "level": level, "place": place, "title": F.round(title * GRID) / GRID}
    return {f: c.cast("double") for f, c in on.items()}


def candidate_pairs(listings: DataFrame, openings: DataFrame) -> DataFrame:
    """(lid, oid, ofirst, FEATURES): candidates with their similarity vectors."""
    slim = lambda d: d.select("id", "words", "whole", "core", "line", "city", "country", "mark", F.xxhash64("core").alias("ch"))
    side = lambda d, p: _keys(slim(d), p).select("key", *[F.col(c).alias(p + c) for c in ("id", "whole", "mark", "ch")])
    # what can't resemble goes by the cheapest test first
    resemble = "lch = och or (bit_count(lmark ^ omark) <= 6 and abs(length(lwhole) - length(owhole)) <= 3 and levenshtein(lwhole, owhole, 3) >= 0)"
    pairs = side(listings, "l").join(side(openings, "o"), "key").where(resemble).select("lid", "oid").distinct()
    whole = lambda d, p: d.select(F.col("id").alias(f"{p}id"), F.col("first").alias(f"{p}first"), *[F.col(c).alias(f"{p}{c}") for c in CONTENT])
    near = pairs.join(whole(listings, "l"), "lid").join(whole(openings, "o"), "oid")
    return near.select("lid", "oid", "ofirst", *[c.alias(f) for f, c in similarities().items()]).where(F.col("company") >= RESEMBLES)


class Mixture:
    """Two Gaussians over the grid points ``x`` with ``n`` pairs at each."""

    def __init__(self, x: np.ndarray, n: np.ndarray):
        self.x, self.n = x, n
        self.total = n.sum()

    def m_step(self, g: np.ndarray) -> None:
        """Weights, means and covariances from ``g``, the matched pairs at each point."""
        self.parts = []
        for w in (g, self.n - g):
            k = max(w.sum(), 1e-9)
            mean = w @ self.x / k
            d = self.x - mean
            self.parts.append((k / self.total, mean, (d * w[:, None]).T @ d / k + RIDGE * np.eye(self.x.shape[1])))

    def posterior(self) -> np.ndarray:
        """The posterior of a match at each point."""
        logs = []
        for weight, mean, cov in self.parts:
            d = self.x - mean
            logs.append(np.log(max(weight, 1e-12)) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)))
        return 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))


def fit_posteriors(pairs: DataFrame) -> DataFrame:
    """pairs that may match with column g, the posterior after EM with transitivity."""
    points = pairs.groupBy(*FEATURES).agg(F.count("*").alias("n")).toPandas()  # bounded by the grid
    if not len(points):
        return pairs.withColumn("g", F.lit(0.0))
    points = points.sort_values(FEATURES).reset_index(drop=True)
    x, n = points[FEATURES].to_numpy(float), points.n.to_numpy(float)
    mixture = Mixture(x, n)
    # matched pairs resemble each other throughout; the constraints hold from the first round
    raw = np.where((x >= START).all(axis=1), 0.95, 0.0)
    spark, live, alive = pairs.sparkSession, None, np.zeros(len(x), dtype=bool)
    told = lambda v: spark.createDataFrame(pd.DataFrame(x, columns=FEATURES).assign(point=range(len(x)), raw=v)[v >= ALIVE], POINT)
    for _ in range(MOST_ROUNDS):
        if live is None or (raw[~alive] >= ALIVE).any():
            # only pairs with some posterior bear on the constraints
            alive = raw >= ALIVE
            live = settle(pairs.join(F.broadcast(told(raw).drop("raw")), FEATURES), "p7-live")
        per = lambda side: F.sum("raw").over(W.Window.partitionBy(side))
        now = live.join(F.broadcast(told(raw).select("point", "raw")), "point")
        now = now.withColumn("g", F.col("raw") / F.greatest(F.lit(1.0), per("lid"), per("oid")))
        sums = now.groupBy("point").agg(F.sum("g").alias("g")).toPandas()
        g = np.zeros(len(x))
        g[sums.point.to_numpy(int)] = sums.g
        mixture.m_step(g)
        new = mixture.posterior()
        if np.abs((new - raw) * n).sum() <= STILL * n.sum():
            return now
        raw = new
    raise RuntimeError("the mixture doesn't settle")


def match_entities(listings: DataFrame, openings: DataFrame, opening_key: str = "ingest_seq", listing_key: str = "listing_id") -> DataFrame:
    """(opening_key, listing_key, confidence): at most one opening for each listing."""
    lc, lm = parsed(listings, listing_key, "title", F.col("companyName"), "location")
    company = F.coalesce(F.when(F.trim("company") != "", F.col("company")), F.col("companyName"))
    oc, _ = parsed(openings, opening_key, "title", company, "location", members=False)
    pairs = settle(candidate_pairs(lc, oc), "p7-pairs")
    matched = fit_posteriors(pairs).where(F.col("g") >= ACCEPT)
    best = matched.groupBy("lid").agg(F.max_by(F.struct("ofirst", "g"), F.struct("g", -F.col("ofirst"))).alias("b"))
    out = best.join(lm, F.col("lid") == F.col("id"))
    return out.select(F.col("b.ofirst").alias(opening_key), F.col("row").alias(listing_key), F.col("b.g").alias("confidence"))
