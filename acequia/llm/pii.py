"""Personal details inside free text: found, masked or replaced by surrogates.

Detection gives spans of five kinds (email, phone, id_number, address, person_name) by
patterns of their notations; a name is a known given name with its surnames, in any order
and case, a name-shaped string after words that introduce a person, or what a classifier
of runs of capitalised words takes for one (``names``; it knows no list of names). Labels,
titles and closing punctuation stay outside the spans.

``mask_spans`` puts typed placeholders there. ``surrogates`` generates keyed, type-consistent
replacements instead: a dictionary of all distinct parts (given names, surnames, mailbox
names, streets, and phones and ids as a whole) is built over the corpus, each part gets a
replacement from HMAC(key, kind, part, attempt) that keeps gender, length of numbers and
punctuation; parts whose replacement is already another part's (or a real part) move on to
the next attempt until all are distinct. As parts are replaced one by one, "Ruiz, Ana",
"ANA RUIZ" and "Ana Ruiz" stay the same person, and different people stay different. Phones
and ids are keyed by all their digits and letters, however these are grouped. Digits inside
mail and street addresses and initials are too short for a draw; a keyed permutation of
equal length keeps them apart, and the words beside them keep the whole from being real.

Detection runs once, without a shuffle; its entities are kept for all that follows. The
dictionary is a distributed table, joined back by part.

Defined results: null, empty and blank texts have no spans and come out as they are; of
overlapping candidates the kind earlier in KINDS wins, then the earlier and longer span.
"""

from __future__ import annotations

import hashlib
import hmac
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acequia.llm.names import names_in
from acequia.session import settle

KINDS = ["email", "id_number", "phone", "address", "person_name"]
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person_name": "[PERSON]"}

# Given names by gender (Spanish, Portuguese, English).
FEMALE = (
    "Agustina Alice Alicia Amanda Ana Andrea Beatriz Camila Carla Carmen Carolina Catalina Cecilia Clara Claudia Daniela Diana "
    "Elena Elisa Emily Emma Fernanda Florencia Gabriela Grace Irene Isabel Jimena Juana Julia Juliana Karen Laura Lucía Luisa Mariana "
    "Marina Marta María Miriam Mónica Natalia Noelia Olivia Patricia Paula Renata Rosa Sandra Sara Silvia Sofía Susana Teresa Valentina "
    "Valeria Verónica Victoria Virginia Ximena Yolanda"
).split()
MALE = (
    "Adrián Agustín Alan Alberto Alejandro Álvaro Andrés Ángel Antonio Bruno Carlos Cristian Daniel David Diego Eduardo Emiliano "
    "Enrique Ernesto Esteban Fabián Federico Felipe Fernando Francisco Gael Gabriel Gonzalo Guillermo Gustavo Héctor Hugo Ignacio Iván "
    "Jaime Javier João Joaquín John Jorge José Juan Julián Leandro Leonardo Lucas Luis Manuel Marcelo Marco Martín Mateo Mauricio Maximiliano "
    "Miguel Nathan Nicolás Oliver Oscar Pablo Pedro Rafael Ramiro Raúl Ricardo Roberto Rodrigo Rubén Santiago Sebastián Sergio Thomas Tomás Vicente Víctor William"
).split()
#: Words that introduce a person (fixed values); matched right before the name.
CUES = (
    r"(?:Soy|soy|I am|I'm|Sou|Me llamo|My name is|Hablé con|habl[ée] con|Contacto:|Contato:|Contact:?|Ask for|Firmado:|Signed:|Assinado:|Te entrevista|"
    r"a nombre de|worked with|Gracias a|Thanks to|referente de la búsqueda es|[Ff]ale com|Send your cv to|Atentamente,?|Regards,?|Atte\.)\s+"
)
COMPANY_WORD = (
    r"(?:S\.A\.S?\.|SRL|S\.R\.L\.|Ltda\.|Inc\.|SL|LLC|SA|SAS|Group|Labs|Sistemas|Consultores|Tech|Studio|Software|Digital|Servicios|Soluciones)"
)

EMAIL = regex.compile(
    r"(?<![\w.+-])[\w][\w.+-]*\s?@\s?[\p{L}\d-]+(?:\.[\p{L}\d-]+)+"
    r"|(?<![\w.+-])[\w][\w.+-]*\s*(?:\(|\[|\{)\s*(?:arroba|at)\s*(?:\)|\]|\})\s*[\p{L}\d-]+(?:\s*(?:\(|\[|\{)?\s*\b(?:punto|ponto|dot)\b\s*(?:\)|\]|\})?\s*[\p{L}\d-]+|\.[\p{L}\d-]+)+"
    r"|(?<![\w.+-])[\w][\w.+-]*\s+(?:arroba)\s+[\p{L}\d-]+(?:\s+(?:punto|ponto|dot)\s+[\p{L}\d-]+|\.[\p{L}\d-]+)+",
    regex.I,
)
#: What every written address of a mailbox holds some of; texts without it are passed over.
EMAIL_HINT = regex.compile(r"@|\barroba\b|[(\[{]\s*at\s*[)\]}]", regex.I)
DIGIT = regex.compile(r"\d")
_ID_SHAPES = (
    r"\d{3}\.\d{3}\.\d{3}-\d{2}|\d{1,2}\.\d{3}\.\d{3}(?:-[\dkK])?|\d{2}-\d{8}-\d|\d{3}-\d{2}-\d{4}|\d{7,8}-[\dA-Za-z]|[XYZ]-?\d{7}-?[A-Z]"
)
ID_LABELLED = regex.compile(
    r"\b(?:SSN|DNI|D\.\s?N\.\s?I\.?|NIE|NIF|CUIT|CUIL|RUT|RUN|CPF|RG|CURP|CI|C\.I\.|documento|document|pasaporte|passport|passaporte|c[ée]dula|ID)\s*:?\s*(?:N\.?[°ºo]|nro\.?|n[úu]m\.?|#)?\s*:?\s*"
    r"(?<v>" + _ID_SHAPES + r"|[A-Z]{1,3}\d{6,9}[A-Z]?|\d{6,12}(?!\d))(?![\w])",
    regex.I,
)
ID_BARE = regex.compile(r"(?<![\w.\-/])(?:" + _ID_SHAPES + r"|\d{2}-\d{8}-\d)(?![\w\-]|\.\d)")
PHONE = regex.compile(
    r"(?<![\w.\-/+])(?:"
    r"\+\d{1,3}(?:[\s.\-]?\(\d{1,4}\))?(?:[\s.\-]?\d{1,8}){2,6}"
    r"|\(\+\d{1,3}\)(?:[\s.\-]?\d{1,8}){2,6}"
    r"|\(0?\d{2,4}\)[\s.\-]?(?:15[\s.\-]?)?\d{3,5}[\s.\-]?\d{4}"
    r"|00\d{2}[\s.\-]?(?:9[\s.\-]?)?\d{1,4}[\s.\-]?\d{6,8}(?:[\s.\-]?\d{2,4})?"
    r"|0\d{2,4}[\s.\-](?:15[\s.\-])?\d{3,4}[\s.\-]\d{4}"
    r"|\d{3}[.\-]\d{3}[.\-]\d{4}"
    r"|(?:11|15)[\s.\-]?\d{4}[\s.\-]?\d{4}"
    r")(?![\w]|[\-./]\d)"
)
PHONE_CUED = regex.compile(r"(?i)(?:tel[ée]?(?:fono)?\.?:?|cel(?:ular)?(?: es)?:?|m[óo]vil(?: es)?:?|whatsapp:?|call|phone:?|ll[áa]m\w*(?: al)?)\s+(?<v>\d[\d\s.\-]{6,14}\d)(?!\w)")
#: Account numbers, whose groups of digits are no phones.
ACCOUNT = regex.compile(r"\b[A-Z]{2}\d{2}(?:\s?[A-Z\d]{4}){3,8}(?:\s?[A-Z\d]{1,3})?\b")
NOT_PHONE = regex.compile(r"(?i)(?:\bref(?:erencia)?\.?|c[óo]digo(?: de \w+)?|expediente(?: \w+)?|requisition|vaga|build|versi[óo]n|versão|id|n[°º])\s*:?\s*$")

_CAP = r"\p{Lu}[\p{Ll}']+"
_STREET = r"(?:(?:del|de la|de los|de las|de|los|las|la|el|do|da|dos|das)\s+){0,2}" + _CAP + r"(?:\s+(?:(?:del|de la|de los|de|do|da)\s+)?" + _CAP + r"){0,3}"
_EXTRA = (
    r"(?:,?\s*(?:piso|p\.)\s*\d{1,3}(?:\s*[º°]?\s*[A-Z](?!\w))?|,?\s*(?:d(?:e)?pto\.?|depto\.?|apto\.?|apt\.?|of\.?|oficina|unit)\s*[\dA-Z]{1,4}(?!\w)|,\s*\d{1,2}[º°ª]\s*(?:izq|dcha|der|[A-Z](?!\w))\.?"
    r"|,?\s*\([A-Z]\d{4}[A-Z]{3}\)|,?\s*(?:CP|C\.P\.|CEP)\s*:?\s*[A-Z]?\d{4,5}(?:-\d{3})?[A-Z]{0,3})*"
)
_TYPE = r"(?:[Cc]alle|C/|Avenida|avenida|Avda\.?|Av\.|Av|Pje\.?|Pasaje|Bv\.?|Blvd\.?|Bulevar|Boulevard|Rua|rua|R\.|Travessa|Plaza|Praça|Paseo|Camino|Ruta)"
_MARK = r"(?:N[°ºo]\.?|[Nn]ro\.?|[Nn][úu]m\.?|n[°º]|#)"
ADDRESS = regex.compile(
    r"(?<!\w)(?:"
    + _TYPE + r"\s+" + _STREET + r",?\s+(?:" + _MARK + r"\s*)?\d{1,5}(?!\d)" + _EXTRA
    + r"|(?:calle|avenida|av\.?|pje\.?|bv\.?|rua|c/)\s+(?:\p{L}+\s+){1,4}" + _MARK + r"\s*\d{1,5}(?!\d)" + _EXTRA
    + r"|\d{1,5}\s+" + _STREET + r"\s+(?:Street|St\.?|Avenue|Ave\.?|Lane|Ln\.?|Road|Rd\.?|Drive|Dr\.?|Boulevard|Blvd\.?)(?!\w)" + _EXTRA
    + r"|" + _STREET + r",?\s+\d{1,5}\s*\([A-Z]\d{4}[A-Z]{3}\)" + _EXTRA
    + r"|\d{1,4}(?:\s?bis)?,?\s+(?:rue|boulevard|avenue|via|viale)\s+" + _STREET
    + r"|" + _CAP + r"(?:straße|strasse|weg|allee|platz)\s+\d{1,4}[a-z]?(?!\d)"
    + r")"
)
# A street name and a plain number count after words of place only.
ADDRESS_CUED = regex.compile(
    r"(?:[Vv]ivo en|queda en|[Ee]stamos (?:en|na|no)|held at|papers at|[Dd]omicilio:?|[Dd]irecci[óo]n:?|[Aa]ddress:?|[Ee]ndereço:?)\s+(?<v>" + _STREET + r",?\s+(?:" + _MARK + r"\s*)?\d{1,5}(?!\d)" + _EXTRA + r")"
)

_LOW_PART = r"(?:\s+(?:de|del|de la|da|dos|van|von))?"
_SUR = _LOW_PART + r"\s+" + _CAP
_UP = r"\p{Lu}[\p{Lu}']+"


def _fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()


GIVEN = {_fold(n): "f" for n in FEMALE} | {_fold(n): "m" for n in MALE}
NAME_CUED = regex.compile(
    CUES + r"(?<v>" + _CAP + r",\s+" + _CAP + r"|" + _CAP + r"\s+" + _CAP + r",\s+" + _CAP + r"|(?:\p{Lu}\.\s*){1,2}" + _CAP + r"(?:\s+" + _CAP + r")?|" + _CAP + r"(?:" + _SUR + r"){1,3}|" + _UP + r"(?:\s+" + _UP + r"){1,3})(?!\w)"
)
NAME_SHAPES = regex.compile(
    r"(?<![\w@.])(?:(?<a>" + _CAP + r"(?:\s+" + _CAP + r")?,\s+" + _CAP + r")|(?<b>(?:\p{Lu}\.\s*){1,2}" + _CAP + r"(?:\s+" + _CAP + r")?)|(?<c>" + _CAP + r"(?:" + _SUR + r"){1,3})|(?<d>" + _UP + r"(?:\s+" + _UP + r"){1,3}))(?![\w@])",
)


def _name_start(text: str, m) -> tuple[int, int] | None:
    """The name inside a name-shaped match: from its given name on."""
    kind = next(k for k in "abcd" if m.group(k))
    s = m.group()
    if kind == "a":
        return m.span() if _fold(s.split(",")[1].strip()) in GIVEN else None
    if kind == "b":
        return None
    words = list(regex.finditer(r"\S+", s))
    for i, w in enumerate(words[:-1]):
        if _fold(w.group()) in GIVEN:
            return m.start() + w.start(), m.end()
    return None


def _of_company(text: str, a: int, b: int) -> bool:
    return bool(regex.search(r"(?:^|\s)" + COMPANY_WORD + r"$", text[a:b]) or regex.match(r"\s+" + COMPANY_WORD, text[b : b + 20]))


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every personal detail, in order."""
    if not text or not text.strip():
        return []
    found: list[tuple[int, int, int, str]] = []

    def add(kind: str, a: int, b: int) -> None:
        while b > a and text[b - 1] in " \t\r\n,;:":
            b -= 1
        if b > a:
            found.append((KINDS.index(kind), a, b, kind))

    for m in EMAIL.finditer(text) if EMAIL_HINT.search(text) else ():
        add("email", m.start(), m.end() - (text[m.end() - 1] in ".-"))
    numbers = DIGIT.search(text)
    for m in ID_LABELLED.finditer(text) if numbers else ():
        add("id_number", *m.span("v"))
    for m in ID_BARE.finditer(text) if numbers else ():
        add("id_number", *m.span())
    accounts = [m.span() for m in ACCOUNT.finditer(text)] if numbers else []
    for m in PHONE.finditer(text) if numbers else ():
        if any(a <= m.start() < b for a, b in accounts):
            continue
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15 and not NOT_PHONE.search(text[max(0, m.start() - 30) : m.start()]):
            add("phone", *m.span())
    for m in PHONE_CUED.finditer(text) if numbers else ():
        if 8 <= sum(c.isdigit() for c in m.group("v")) <= 15:
            add("phone", *m.span("v"))
    for m in ADDRESS.finditer(text) if numbers else ():
        add("address", *m.span())
    for m in ADDRESS_CUED.finditer(text) if numbers else ():
        add("address", *m.span("v"))
    for m in NAME_CUED.finditer(text):
        if not regex.match(r"\s+" + COMPANY_WORD, text[m.end() : m.end() + 20]) and not regex.search(COMPANY_WORD + r"$", m.group("v")):
            add("person_name", *m.span("v"))
    for m in NAME_SHAPES.finditer(text):
        at = _name_start(text, m)
        if at and not regex.search(r"(?:^|\s)" + COMPANY_WORD + r"$", text[at[0] : at[1]]) and not regex.match(r"\s+" + COMPANY_WORD, text[at[1] : at[1] + 20]):
            add("person_name", *at)
    for m in regex.finditer(r"(?<=(?:Gracias a|Thanks to|Obrigado a)\s[^.\n]{3,60}?\s(?:y|and|e)\s)(?:(?:\p{Lu}\.\s*){1,2}" + _CAP + r"(?:\s+" + _CAP + r")?)(?!\w)", text):
        add("person_name", *m.span())
    found.sort(key=lambda f: (f[0], f[1], -f[2]))
    kept: list[tuple[int, int, str]] = []
    for _, a, b, kind in found:
        if all(b <= x or a >= y for x, y, _ in kept):
            kept.append((a, b, kind))
    for a, b in names_in(text):
        if all(b <= x or a >= y for x, y, _ in kept) and not _of_company(text, a, b):
            kept.append((a, b, "person_name"))
    return [(k, a, b) for a, b, k in sorted(kept)]


SPAN_SCHEMA = "table_name string, ingest_seq bigint, kind string, start_pos bigint, end_pos bigint"


def detect(rows: DataFrame) -> DataFrame:
    """SPAN_SCHEMA for rows (table_name, ingest_seq, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(t, s, k, a, b) for t, s, x in zip(pdf.table_name, pdf.ingest_seq, pdf.text) for k, a, b in find_spans(x)]
            yield pd.DataFrame(out, columns=["table_name", "ingest_seq", "kind", "start_pos", "end_pos"])

    return rows.select("table_name", "ingest_seq", "text").where("text is not null").mapInPandas(run, SPAN_SCHEMA)


def mask_spans(text: str | None) -> str | None:
    """The text with typed placeholders; all the rest unchanged."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in find_spans(text):
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join(out) + text[at:]


def mask(rows: DataFrame) -> DataFrame:
    """(table_name, ingest_seq, text) with every detail replaced by its placeholder."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(mask_spans, na_action="ignore")

    return rows.select("table_name", "ingest_seq", masked("text").alias("text"))


# ------------------------------------------------------------------------- surrogates

_SYLLABLES = [c + v for c in "b c d f g l m n p r s t v".split() for v in "aeiou"]
#: Dictionaries whose replacements are distinct by construction.
PERMUTED = ("digits", "initial")
_PARTS = regex.compile(r"\p{L}[\p{L}']*|\d+")
_CONNECTORS = frozenset("arroba at punto dot ponto".split())
_KEEP_WORDS = frozenset("de del la los las el calle avenida av avda pje bv c rua piso dpto depto n nro street ave lane road izq dcha arroba at punto dot ponto example test invalid com org net".split())


def _part_kind(kind: str, part: str) -> str | None:
    """Which dictionary a part of an entity belongs to; None if it stays as it is."""
    if part.isdigit():
        return "digits"
    low = _fold(part)
    if kind == "person_name":
        return "initial" if len(part) == 1 else f"given_{GIVEN[low]}" if low in GIVEN else "surname"
    if kind == "address":
        return None if low in _KEEP_WORDS or len(part) < 3 else "street"
    return None if low in _KEEP_WORDS else "mail"


def _plain(c: str) -> str:
    return str(unicodedata.decimal(c)) if c.isdecimal() else (_fold(c) or c)[0]


def entity_parts(kind: str, text: str, a: int, b: int) -> list[tuple[int, int, str, str, int]]:
    """(start, stop, dictionary, part, offset) of what is replaced in an entity.

    ``offset`` is the place in the replacement of a number, which is keyed as a whole; -1
    if the replacement of a part is taken whole.
    """
    runs = list(_PARTS.finditer(text, a, b))
    if kind in ("phone", "id_number"):
        whole = "".join(_plain(c) for m in runs for c in m.group())
        out, at = [], 0
        for m in runs:
            out.append((m.start(), m.end(), "number", whole, at))
            at += m.end() - m.start()
        return out
    kinds = [_part_kind(kind, m.group()) for m in runs]
    if kind != "person_name" and not {"mail", "street"} & set(kinds):
        # nothing but common words and digits: the words are replaced too, else the whole
        # could be another real one
        word = "mail" if kind == "email" else "street"
        kinds = [k or (word if _fold(m.group()) not in _CONNECTORS else None) for k, m in zip(kinds, runs)]
    same = {"digits": lambda p: "".join(map(_plain, p))}
    return [(m.start(), m.end(), k, same.get(k, _fold)(m.group()), -1) for k, m in zip(kinds, runs) if k]


def _draw(secret: bytes, kind: str, part: str, attempt: int) -> Iterator[int]:
    block = 0
    while True:
        yield from hmac.new(secret, f"{kind}|{part}|{attempt}|{block}".encode(), hashlib.sha256).digest()
        block += 1


@lru_cache(maxsize=1_000)
def _script(page: int) -> tuple[str, ...]:
    """Small letters of a page of Unicode (but a to z) that fold to themselves."""
    cs = map(chr, range(page << 8, (page + 1) << 8))
    return tuple(c for c in cs if not "a" <= c <= "z" and c.isalpha() and _fold(c) == c and len(c.upper()) == 1 and c.upper().lower() == c)


def _alphabet(c: str, first: bool) -> tuple[str, ...]:
    """The characters that may stand for c; the alphabets don't overlap."""
    if c.isdigit():
        return ("0",) if first and c == "0" else tuple("123456789") if first else tuple("0123456789")
    if "a" <= c <= "z":
        return tuple("abcdefghijklmnopqrstuvwxyz")
    letters = _script(ord(c) >> 8)
    return letters if c in letters else (c,)


def permuted(secret: bytes, kind: str, part: str) -> str:
    """A keyed permutation of the strings of one length: different parts stay different.

    Every step exchanges one character by a permutation that the others choose.
    """
    out = list(part)
    for step in range(3):
        for i, c in enumerate(out):
            signs = _alphabet(c, i == 0)
            rest = f"{kind}|{step}|{i}|{''.join(out[:i])}|{''.join(out[i + 1 :])}"
            order = sorted(signs, key=lambda x: hmac.new(secret, f"{rest}|{x}".encode(), hashlib.sha256).digest())
            out[i] = order[signs.index(c)]
    return "".join(out)


@lru_cache(maxsize=100_000)
def surrogate_part(secret: bytes, kind: str, part: str, attempt: int) -> str:
    """A keyed replacement of one folded part, in lower case."""
    if kind in PERMUTED:
        return permuted(secret, kind, part)
    rnd = _draw(secret, kind, part, attempt)
    if kind == "number":
        first = "123456789"[next(rnd) % 9] if part[0] in "123456789" else part[0] if part[0] == "0" else chr(97 + next(rnd) % 26)
        return first + "".join(str(next(rnd) % 10) if c.isdigit() else chr(97 + next(rnd) % 26) for c in part[1:])
    ending = {"given_f": "a", "given_m": "o"}.get(kind, "")
    # longer after some attempts, so that there is always room
    size = max(3, min(5, len(part) // 2)) + attempt // 4
    body = "".join(_SYLLABLES[next(rnd) % len(_SYLLABLES)] for _ in range(size))
    return body[:-1] + ending if ending else body + "rnlsz"[next(rnd) % 5]


def _dress(like: str, plain: str) -> str:
    return plain.upper() if like.isupper() and len(like) > 1 else plain.capitalize() if like[0].isupper() else plain


ENTITY = "table_name string, ingest_seq bigint, kind string, start_pos bigint, end_pos bigint, entity string"
_KEY = ["table_name", "ingest_seq", "kind", "start_pos", "end_pos"]


def _entities(rows: DataFrame) -> DataFrame:
    """A row for each part of each entity: its key, its text, where the part is in it, the dictionary, the part."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [*_KEY, "entity", "start", "stop", "part_kind", "part", "offset"]
        for pdf in batches:
            out = []
            for t, s, x in zip(pdf.table_name, pdf.ingest_seq, pdf.text):
                for kind, a, b in find_spans(x):
                    parts = entity_parts(kind, x, a, b) or [(a, a, "none", "", -1)]
                    out += [(t, s, kind, a, b, x[a:b], i - a, j - a, pk, part, at) for i, j, pk, part, at in parts]
            yield pd.DataFrame(out, columns=cols)

    slim = rows.select("table_name", "ingest_seq", "text").where("text is not null")
    return slim.mapInPandas(cut, ENTITY + ", start int, stop int, part_kind string, part string, offset int")


def replacements(rows: DataFrame, secret: bytes, rounds: int = 8) -> DataFrame:
    """(table_name, ingest_seq, kind, start_pos, end_pos, surrogate): every detail with its replacement.

    The collision check goes on until all replacements are distinct and none is real, and
    raises if ``rounds`` rounds in a row get no nearer (numbers that leave no room).
    """

    @F.pandas_udf("string")
    def drawn(kind: pd.Series, part: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([p if k == "none" else surrogate_part(secret, k, p, int(a)) for k, p, a in zip(kind, part, attempt)])

    pieces = settle(_entities(rows), "p3-entities")
    todo = pieces.select(F.col("part_kind").alias("kind"), "part").distinct().withColumn("attempt", F.lit(0))
    fewest, idle = None, 0
    while True:
        named = settle(todo.withColumn("new", drawn("kind", "part", "attempt")), "p3-named")
        rank = F.expr("row_number() over (partition by kind, new order by part)")
        real = named.select("kind", F.col("part").alias("new")).withColumn("taken", F.lit(True))
        judged = named.where(~F.col("kind").isin(*PERMUTED, "none")).withColumn("rank", rank).join(real, ["kind", "new"], "left")
        clash = settle(judged.where("rank > 1 or taken").select("kind", "part", F.lit(1).alias("clash")), "p3-clashes")
        clashes = clash.count()
        if not clashes:
            break
        fewest, idle = (clashes, 0) if fewest is None or clashes < fewest else (fewest, idle + 1)
        if idle >= rounds:
            raise ValueError(f"{clashes} personal details have no distinct surrogate")
        todo = named.join(clash, ["kind", "part"], "left").select("kind", "part", (F.col("attempt") + F.coalesce("clash", F.lit(0))).alias("attempt"))
    final = named.select(F.col("kind").alias("part_kind"), "part", "new")
    new = F.expr("if(offset < 0, new, substring(new, offset + 1, stop - start))").alias("new")
    whole = pieces.join(final, ["part_kind", "part"]).groupBy(*_KEY).agg(F.first("entity").alias("entity"), F.collect_list(F.struct("start", "stop", new)).alias("swaps"))

    @F.pandas_udf("string")
    def rebuilt(texts: pd.Series, swaps: pd.Series) -> pd.Series:
        out = []
        for x, parts in zip(texts, swaps):
            at, bits = 0, []
            for s in sorted(parts, key=lambda s: s["start"]):
                if s["stop"] > s["start"]:
                    bits += [x[at : s["start"]], _dress(x[s["start"] : s["stop"]], s["new"])]
                    at = s["stop"]
            out.append("".join(bits) + x[at:])
        return pd.Series(out)

    return whole.select(*_KEY, rebuilt("entity", "swaps").alias("surrogate"))


def surrogates(rows: DataFrame, secret: bytes, rounds: int = 8) -> DataFrame:
    """(table_name, ingest_seq, text) with keyed surrogates instead of personal details."""
    swaps = replacements(rows, secret, rounds).groupBy("table_name", "ingest_seq").agg(F.collect_list(F.struct("start_pos", "end_pos", "surrogate")).alias("swaps"))

    @F.pandas_udf("string")
    def put_in(texts: pd.Series, swaps: pd.Series) -> pd.Series:
        out = []
        for x, todo in zip(texts, swaps):
            if x is None or todo is None:
                out.append(x)
                continue
            at, bits = 0, []
            for s in sorted(todo, key=lambda s: s["start_pos"]):
                bits += [x[at : s["start_pos"]], s["surrogate"]]
                at = s["end_pos"]
            out.append("".join(bits) + x[at:])
        return pd.Series(out)

    joined = rows.select("table_name", "ingest_seq", "text").join(swaps, ["table_name", "ingest_seq"], "left")
    return joined.select("table_name", "ingest_seq", put_in("text", "swaps").alias("text"))
