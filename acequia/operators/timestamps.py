"""Mixed timestamp notations brought to one form through a persistent dictionary.

Raw strings are de-duplicated together with the time zone and the day order of their
source. Each distinct entry is parsed once, by JVM expressions only, and appended to a
dictionary table; later batches parse only what the dictionary lacks. Rows get their
value by a join with the dictionary. A relative age ("Hace 3 días") keeps its number and
unit in the dictionary and is resolved against the row's collection time.

Wall-clock arithmetic is done on TIMESTAMP_NTZ values, so the session time zone has no
effect. Of a wall-clock time that occurs twice the first counts; one that is skipped
moves forward by the gap (java.time rules).

Defined results: null, empty and blank strings, placeholders and impossible dates give no
value; a time without a zone, from a source without a known zone, gives none either, as
does a numeric day/month date of a source whose day order is unknown; an age without a
usable collection time gives none.
"""

from __future__ import annotations

import uuid
import zoneinfo
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names by number (Spanish, English, Portuguese; matched by prefix).
MONTHS = {
    1: "ene|jan",
    2: "feb|fev",
    3: "mar",
    4: "abr|apr",
    5: "may|mai",
    6: "jun",
    7: "jul",
    8: "ago|aug",
    9: "sep|set",
    10: "oct|out",
    11: "nov",
    12: "dic|dec|dez",
}

# Zone abbreviations and their minutes east of Greenwich.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120,
    "ART": -180, "BRT": -180, "BRST": -120, "UYT": -180, "CLT": -240, "CLST": -180,
    "PET": -300, "COT": -300, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

# Units of a relative age in three languages, accents removed.
UNITS = {
    "minute": "minutos?|minutes?|mins?",
    "hour": "horas?|hours?|hrs?",
    "day": "dias?|days?",
    "week": "semanas?|weeks?",
    "month": "mes|meses|months?",
    "year": "anos?|years?",
}

AMPM = r"(?:\s*([AaPp])\.?\s?[Mm]\.?)?"
CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?" + AMPM
#: A zone suffix; a zone's name may follow an offset in brackets and adds nothing to it.
ZONE = r"\s*(?:(Z|[A-Z]{2,5}|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?)(?:\s*[\[(][\w/+-]+[\])])?)?"
WEEKDAY = r"(?:\p{L}+\.?,?\s+)?"
_TAIL = r"(?:(?:T|,?\s+|\s+a las\s+)" + CLOCK + ZONE + r")?$"
#: Notations with a calendar date: the pattern and where year, month, day, hour, minute,
#: second, half and zone stand in it (0: nowhere). A month may be a name. In "numeric" the source's
#: day order tells which of the first two is the day.
NOTATIONS = [
    ("iso", r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TAIL, (1, 2, 3, 4, 5, 6, 7, 8)),
    ("numeric", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})" + _TAIL, (3, 1, 2, 4, 5, 6, 7, 8)),
    ("compact", r"^(\d{4})(\d{2})(\d{2})(?:[T_ ]?(\d{2})(\d{2})(\d{2})?" + ZONE + r")?$", (1, 2, 3, 4, 5, 6, 0, 7)),
    ("day_name", r"^" + WEEKDAY + r"(\d{1,2})(?:\s+de\s+|[-\s]+)(\p{L}{3,})\.?,?(?:\s+de\s+|[-\s]+)(\d{4})" + _TAIL, (3, 2, 1, 4, 5, 6, 7, 8)),
    ("name_day", r"^" + WEEKDAY + r"(\p{L}{3,})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})" + _TAIL, (3, 1, 2, 4, 5, 6, 7, 8)),
    ("asctime", r"^\p{L}{3,}\s+(\p{L}{3,})\s+(\d{1,2})\s+" + CLOCK + r"(?:\s+([A-Z]{1,5}|[+-]\d{2}:?\d{2}))?\s+(\d{4})$", (8, 1, 2, 3, 4, 5, 6, 7)),
]
#: A day of an ISO week: year, week, day.
ISO_WEEK = r"^(\d{4})-?W(\d{2})-?([1-7])$"
AGE = r"(?:^|\s)(?:hace|ha|ago)?\s*(\d{1,6})\s+({unit})(?:\s+(?:ago|atras))?$"

DICTIONARY_SCHEMA = (
    "raw string, zone string, day_first boolean, instant timestamp_ntz, day date, age_n bigint, age_unit string"
)


def _nonblank(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def _month(c: Column) -> Column:
    begin = F.substring(F.lower(c), 1, 3)
    named = F.coalesce(*[F.when(begin.isin(*names.split("|")), F.lit(n)) for n, names in MONTHS.items()])
    return F.coalesce(c.try_cast("int"), named)


def _offset_minutes(c: Column) -> Column:
    """Minutes east of a zone suffix; null where there is none or it is unknown."""
    sign = F.when(c.contains("-"), F.lit(-1)).otherwise(F.lit(1))
    digits = F.regexp_replace(c, "[^0-9]", "")
    padded = F.when(F.length(digits) <= 2, F.concat(digits, F.lit("00"))).otherwise(digits).try_cast("int")
    numeric = F.when((digits != "") & (padded < 1900), sign * (F.floor(padded / 100) * 60 + padded % 100).cast("int"))
    return reduce(lambda acc, kv: acc.when(c == kv[0], F.lit(kv[1])), ABBREVIATIONS.items(), F.when(digits != "", numeric))


def _unaccent(c: Column) -> Column:
    return F.translate(F.lower(c), "áéíóúâêôãõçñ", "aeiouaeoaocn")


def parse_entries(entries: DataFrame) -> DataFrame:
    """Parse dictionary keys (raw, zone, day_first) into DICTIONARY_SCHEMA."""
    raw = F.regexp_replace(F.col("raw"), r"^\s+|\s+$", "")
    # the first notation that fits rewrites the string to its parts, so that each pattern
    # runs once and the parts are cut once
    parts = None
    for name, pattern, groups in NOTATIONS:
        canon = F.regexp_replace("_r", pattern, "|".join([name, *[f"${g}" if g else "" for g in groups]]))
        hit = F.col("_r").rlike(pattern)
        parts = F.when(hit, canon) if parts is None else parts.when(hit, canon)
    df = entries.withColumn("_r", raw).withColumn("_g", F.split(parts, "[|]"))
    g = lambda i: F.get("_g", F.lit(i))
    number = lambda i: g(i).try_cast("int")
    swapped = (g(0) == "numeric") & F.col("day_first")
    unknown = (g(0) == "numeric") & F.col("day_first").isNull()
    year = F.when(F.length(g(1)) == 2, number(1) + 2000).otherwise(number(1))
    df = df.select(
        "*", year.alias("_y"),
        F.when(unknown, F.lit(None)).when(swapped, number(3)).otherwise(_month(g(2))).alias("_m"),
        F.when(unknown, F.lit(None)).when(swapped, number(2)).otherwise(number(3)).alias("_d"),
        number(4).alias("_h"), number(5).alias("_mi"), F.when(g(4) != "", F.coalesce(number(6), F.lit(0))).alias("_s"),
        _nonblank(F.lower(g(7))).alias("_half"), _nonblank(g(8)).alias("_z"),
    )
    hour24 = (
        F.when(F.col("_half").isNull(), F.col("_h"))
        .when((F.col("_h") < 1) | (F.col("_h") > 12), F.lit(None).cast("int"))
        .when(F.col("_half") == "p", F.col("_h") % 12 + 12)
        .otherwise(F.col("_h") % 12)
    )
    known = sorted(zoneinfo.available_timezones())
    zone_ok = F.when(F.col("zone").isin(known), F.col("zone"))
    df = df.withColumn("_h24", hour24).withColumn("_zone", zone_ok)
    valid_clock = (F.col("_h24") < 24) & (F.col("_mi") < 60) & (F.col("_s") < 60)
    week = lambda i: F.regexp_extract("_r", ISO_WEEK, i).try_cast("int")
    monday = F.date_trunc("week", F.make_date(week(1), F.lit(1), F.lit(4))).cast("date")
    in_week = F.date_add(monday, (week(2) - 1) * 7 + week(3) - 1)
    of_week = F.when(F.col("_r").rlike(ISO_WEEK) & (F.weekofyear(in_week) == week(2)), in_week)
    day = F.coalesce(F.expr("cast(try_make_timestamp_ntz(_y, _m, _d, 0, 0, 0) as date)"), F.when(F.col("_g").isNull(), of_week))
    wall = F.when(valid_clock, F.expr("try_make_timestamp_ntz(_y, _m, _d, _h24, _mi, _s)"))
    df = df.withColumn("_wall", wall).withColumn("_off", _offset_minutes(F.col("_z")))
    from_wall = (
        F.when(F.col("_z").isNotNull(), F.expr("timestampadd(MINUTE, -_off, _wall)"))
        .when(F.col("_zone").isNotNull(), F.expr("convert_timezone(_zone, 'UTC', _wall)"))
    )
    epoch = (
        F.when(F.col("_r").rlike(r"^\d{10}$"), F.col("_r").try_cast("bigint"))
        .when(F.col("_r").rlike(r"^\d{13}$"), F.expr("try_cast(_r as bigint) div 1000"))
        .when(F.col("_r").rlike(r"^\d{16}$"), F.expr("try_cast(_r as bigint) div 1000000"))
    )
    df = df.withColumn("_epoch", epoch)
    instant = F.when(F.col("_epoch").isNotNull(), F.expr("timestampadd(SECOND, _epoch, timestamp_ntz'1970-01-01 00:00:00')")).otherwise(from_wall)
    plain = F.when(F.col("_g").isNull() & F.col("_epoch").isNull(), F.regexp_replace(_unaccent(F.col("_r")), r"\s+", " "))
    age = [(u, AGE.replace("{unit}", names)) for u, names in UNITS.items()]
    df = df.withColumn("_plain", plain)
    plain = F.col("_plain")
    age_n = F.coalesce(
        *[F.when(plain.rlike(p), F.regexp_extract(plain, p, 1).try_cast("bigint")) for _, p in age],
        F.when(plain.rlike("^(?:ayer|yesterday|ontem)$"), F.lit(1).cast("bigint")),
        F.when(plain.rlike("^(?:hoy|today|hoje)$"), F.lit(0).cast("bigint")),
    )
    age_unit = F.coalesce(
        *[F.when(plain.rlike(p), F.lit(u)) for u, p in age],
        F.when(plain.rlike("^(?:ayer|yesterday|ontem|hoy|today|hoje)$"), F.lit("day")),
    )
    return df.select(
        "raw",
        "zone",
        "day_first",
        instant.alias("instant"),
        F.when(F.col("_h").isNull() & F.col("_epoch").isNull(), day).alias("day"),
        age_n.alias("age_n"),
        age_unit.alias("age_unit"),
    )


class TimestampDictionary:
    """A table of parsed raw strings that grows with each batch.

    ``path`` lies in a folder all executors share. ``absorb`` parses only the entries the
    table lacks and adds them as one batch, which counts once its marker is there, so a
    string is parsed once for all time and a half-written batch is never read. An entry
    that two sessions added at the same time counts once.
    """

    MARKER = "_PARSED"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def batches(self) -> list[str]:
        p = self._jpath(f"{self.path}/*/{self.MARKER}")
        return sorted(str(x.getPath().getParent()) for x in p.getFileSystem(self._conf).globStatus(p) or [])

    def read(self) -> DataFrame | None:
        every = self.batches()
        if not every:
            return None
        df = self.spark.read.schema(DICTIONARY_SCHEMA).parquet(*every)
        return df if len(every) == 1 else df.dropDuplicates(["raw", "zone", "day_first"])

    def absorb(self, keys: DataFrame) -> DataFrame:
        fresh = keys.select("raw", "zone", "day_first").distinct()
        known = self.read()
        if known is not None:
            k, f = known.alias("k"), fresh.alias("f")
            same = F.expr("f.raw = k.raw and f.zone <=> k.zone and f.day_first <=> k.day_first")
            fresh = f.join(k, same, "left_anti")
        batch = f"{self.path}/{uuid.uuid4().hex}"
        parse_entries(fresh).write.parquet(batch)
        done = self._jpath(f"{batch}/{self.MARKER}")
        done.getFileSystem(self._conf).create(done, True).close()
        return self.read()


def normalise_times(
    rows: DataFrame,
    sources: DataFrame,
    dictionary: TimestampDictionary,
    key: str = "ingest_seq",
    fields: tuple[str, ...] = ("posted_date", "postedDate", "scraped_at"),
    reference: str = "scraped_at",
    source: str = "origin_file",
) -> DataFrame:
    """(key, field, norm): one row per field whose value denotes a time.

    ``sources`` gives ``zone_name`` and ``day_first`` for each value of ``source``; rows
    whose source is not in it have neither. Extra columns of either side play no part.
    """
    side = sources.groupBy(source).agg(F.first("zone_name").alias("zone"), F.first("day_first").alias("day_first"))
    base = rows.select(key, source, F.col(reference).alias("ref"), *[F.col(f).alias(f"v_{f}") for f in fields])
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"v_{f}").alias("raw")) for f in fields]))
    long = (
        base.join(side, source, "left")
        .select(key, "zone", "day_first", "ref", stacked.alias("x"))
        .select(key, "zone", "day_first", "ref", "x.field", "x.raw")
        .where(F.trim("raw") != "")
    )
    d = dictionary.absorb(long)
    l, e = long.alias("l"), d.alias("e")
    hit = l.join(e, F.expr("l.raw = e.raw and l.zone <=> e.zone and l.day_first <=> e.day_first")).select(
        f"l.{key}", "l.zone", "l.day_first", "l.ref", "l.field", "e.instant", "e.day", "e.age_n", "e.age_unit"
    )
    fixed = hit.where("age_unit is null").select(
        key,
        "field",
        F.coalesce(F.date_format("instant", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("day", "yyyy-MM-dd")).alias("norm"),
    )
    ages = hit.where("age_unit is not null and zone is not null and ref is not null").drop("instant", "day")
    a, s = ages.alias("a"), d.where("instant is not null").alias("s")
    local = F.expr("convert_timezone('UTC', a.zone, s.instant)")
    resolved = (
        a.join(s, F.expr("a.ref = s.raw and a.zone <=> s.zone and a.day_first <=> s.day_first"))
        .select(f"a.{key}", "a.field", "a.age_n", "a.age_unit", local.alias("now"))
        .select(
            key,
            "field",
            F.expr(
                "date_format(cast(case age_unit"
                " when 'minute' then timestampadd(MINUTE, -age_n, now)"
                " when 'hour' then timestampadd(HOUR, -age_n, now)"
                " when 'day' then timestampadd(DAY, -age_n, now)"
                " when 'week' then timestampadd(DAY, -7 * age_n, now)"
                " when 'month' then timestampadd(MONTH, -age_n, now)"
                " when 'year' then timestampadd(MONTH, -12 * age_n, now) end as date), 'yyyy-MM-dd')"
            ).alias("norm"),
        )
    )
    return fixed.unionByName(resolved).where("norm is not null")
