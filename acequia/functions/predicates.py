"""Predicates on texts and lines (survey F1-F13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acequia.config import HASHTAGS, PRIMARY_KEYWORDS, SECONDARY_KEYWORDS, UNCHECKED, Site
from acequia.functions.scalars import text_key, truthy

# Interface texts that are no content, as whole-line patterns.
NOISE = (
    r"\d+\s*resultados?$|Crear alerta|Saltar para|Ir al resultado|Visto$|Solicitud sencilla$|\d+\s+antiguos?\s+alumnos?|\d+\s+contacto\s+trabaja|Promocionado$"
    r"|Adelántate|(?:¿)?Estos resultados|Tus comentarios|(?:¿)?Encuentras lo|Mira empleos donde|Reactiv(?:ar|a) Premium|Descartar|Hace \d+\s+(?:minuto|minutos|hora|horas)$"
    r"|En las últimas|Descargar la aplicación|Obtén acceso|Personas con las que|Logotipo de|Antiguos alumnos|Más$|with verification$"
)
# Fixed values.
RELATIVE_DATE = r"Hace\s+\d+\s+(?:día|días|semana|semanas|mes|meses)"
# Fixed values.
PLACE_MARKERS = ["Argentina", "Buenos Aires", "Provincia", "Ciudad Autónoma", "y alrededores", "En remoto", "Presencial", "Híbrido", "América Latina"]
# Fixed values.
STOP_LINES = [
    "Siguiente", "---", "Mostrar más opciones", "Guardar", "Compartir", "Seguir", "Mira una comparación", "Accede a información exclusiva",
    "Me interesa", "Solicitar", "Empezar", "Cancelar", "mostrar más", "Mostrar todo",
]
# Fixed values.
JUNK_TITLES = [
    "Accesibilidad", "Centro de ayuda", "Privacidad y condiciones", "Opciones de publicidad", "Publicidad", "Servicios empresariales",
    "…", "---", "mostrar más", "Mostrar todo",
]


def matches(text: Column, keywords: Sequence[str]) -> Column:
    """The keywords a text contains as substrings, lower case, in list order."""
    low = text_key(text)
    return F.filter(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: low.contains(k))


def intent(
    text: Column, primary: Sequence[str] = (), secondary: Sequence[str] = (), hashtags: Sequence[str] = ()
) -> Column:
    """the validation record of a text; an empty list means the standard one.

    Valid is a text with a primary keyword and any secondary one or hashtag (without #).
    """
    p = matches(text, primary or PRIMARY_KEYWORDS)
    s = matches(text, secondary or SECONDARY_KEYWORDS)
    h = matches(text, [x.lstrip("#") for x in (hashtags or HASHTAGS)])
    context = (F.size(s) > 0) | (F.size(h) > 0)
    empty = F.coalesce(text, F.lit("")) == ""
    none = F.array().cast("array<string>")
    return F.struct(
        (~empty & (F.size(p) > 0) & context).alias("is_valid"),
        (~empty & (F.size(p) > 0)).alias("has_primary"),
        (~empty & context).alias("has_context"),
        F.when(empty, none).otherwise(p).alias("matched_primary"),
        F.when(empty, none).otherwise(s).alias("matched_secondary"),
        F.when(empty, none).otherwise(h).alias("matched_hashtags"),
        F.when(empty, F.lit("no_text_available")).alias("reason"),
    )


def validate(df: DataFrame, keep_unchecked: bool = True, **lists: Sequence[str]) -> DataFrame:
    """rows whose text shows intent, with their record; some categories pass as they are."""
    have = [F.col(c) for c in ("text_ocr", "title", "text") if c in df.columns]
    checked = df.withColumn("validation", intent(truthy(*have), **lists))
    passes = F.col("validation.is_valid")
    if keep_unchecked and "category" in df.columns:
        passes = passes | F.col("category").isin(*UNCHECKED)
    return checked.where(passes)


def is_noise(line: Column) -> Column:
    """interface text or blank."""
    t = F.trim(line)
    return (t == "") | t.rlike(f"(?iu)^(?:{NOISE})")


def is_relative_date(line: Column) -> Column:
    """F5."""
    return F.trim(line).rlike(f"(?iuU)^{RELATIVE_DATE}")


def is_place(line: Column) -> Column:
    """any of the markers, case counts."""
    return F.exists(F.array(*[F.lit(m) for m in PLACE_MARKERS]), lambda m: line.contains(m))


def ends_listing(line: Column, site: Site = Site()) -> Column:
    """the line where a listing ends."""
    t = F.trim(line)
    return t.isin(*STOP_LINES) | (F.length(t) > 200) | t.rlike(r"^\d+\s+\d+\s+\d+") | t.contains(site.foot)


def listing_lines(df: DataFrame, key: str, text: str, site: Site = Site()) -> DataFrame:
    """(key, pos, line): the non-blank lines before the first that ends the listing."""
    from pyspark.sql import window as W

    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"))
    lines = lines.withColumn("line", F.trim("raw")).where("line <> ''")
    stop = F.min(F.when(ends_listing(F.col("line"), site), F.col("pos"))).over(W.Window.partitionBy(key))
    return lines.withColumn("stop", stop).where("stop is null or pos < stop").select(key, "pos", "line")


def is_junk_title(title: Column, site: Site = Site()) -> Column:
    """F8; the title that the site gives to postings without one is junk too."""
    return title.isin(*JUNK_TITLES, site.untitled)


def references_of(refs: Column, kind: str, path: str = "") -> Column:
    """the references of a kind with an address (that holds ``path``)."""
    return F.filter(refs, lambda r: (r["kind"] == kind) & (F.coalesce(r["url"], F.lit("")) != "") & r["url"].contains(path))


def is_person_line(line: Column) -> Column:
    """a line that may be a person's name."""
    low = F.lower(line)
    skip = low.contains("search") | low.contains("filter") | low.contains("result") | low.contains("relevance")
    return ~skip & (F.length(line) > 5) & ~line.startswith("http")


def fetched(status: Column) -> Column:
    """F11."""
    return status == 200


def is_title(title: Column) -> Column:
    """F12."""
    return (F.length(title) < 100) & ~is_noise(title)


def response_state(text: Column) -> Column:
    """why a server gave no data, from the text it answered."""
    low = F.lower(text)
    return (
        F.when(low.contains("login is still in progress"), "login_in_progress")
        .when(low.contains("setup is not complete"), "setup_incomplete")
        .otherwise("ready")
    )
