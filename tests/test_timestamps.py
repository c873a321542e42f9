"""The timestamp dictionary against hand-made cases and a brute-force clock."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from acequia.operators.timestamps import DICTIONARY_SCHEMA, TimestampDictionary, normalise_times, parse_entries
from acequia.session import scratch_path

MADRID, CHILE = "Europe/Madrid", "America/Santiago"


def parse(spark, *raws, zone=MADRID, day_first=True):
    df = spark.createDataFrame([(i, r, zone, day_first) for i, r in enumerate(raws)], "i int, raw string, zone string, day_first boolean")
    got = {r.raw: r for r in parse_entries(df.select("raw", "zone", "day_first")).collect()}
    return [got[r] for r in raws]


@pytest.mark.parametrize(
    "raw, instant",
    [
        ("2025-01-19T20:16:12.563587", "2025-01-19 19:16:12"),
        ("2025-07-19T20:16:12", "2025-07-19 18:16:12"),
        ("20250119_201612", "2025-01-19 19:16:12"),
        ("2025-01-09T03:32:08-07:00", "2025-01-09 10:32:08"),
        ("2025-01-31T23:57:09-0300", "2025-02-01 02:57:09"),
        ("2025-01-10T17:34:46 UTC", "2025-01-10 17:34:46"),
        ("2025-01-16T08:22:58Z", "2025-01-16 08:22:58"),
        ("2025-03-14 15:09:09 ART", "2025-03-14 18:09:09"),
        ("2025-08-19 20:18:01 CST", "2025-08-20 02:18:01"),
        ("1736967408", "2025-01-15 18:56:48"),
        ("1736475381366", "2025-01-10 02:16:21"),
        ("1738420620391871", "2025-02-01 14:37:00"),
        ("04/01/2025 18:51:14", "2025-01-04 17:51:14"),
        ("25/12/2024 12:47:18 PM", "2024-12-25 11:47:18"),
        ("25/12/2024 12:47:18 AM", "2024-12-24 23:47:18"),
        ("28 de enero de 2025, 15:00:05", "2025-01-28 14:00:05"),
        ("Fri, 16 Aug 2024 12:09:34 GMT", "2024-08-16 12:09:34"),
        ("Thu, 6 Nov 2025 23:36:08 +0100", "2025-11-06 22:36:08"),
        # clock changes: the first of two, and forward by the gap
        ("2024-10-27T02:30:00", "2024-10-27 00:30:00"),
        ("2025-03-30T02:30:00", "2025-03-30 01:30:00"),
    ],
)
def test_instants(spark, raw, instant):
    (r,) = parse(spark, raw)
    assert str(r.instant) == instant and r.day is None


@pytest.mark.parametrize(
    "raw, day",
    [("2025-01-12", "2025-01-12"), ("06/01/2025", "2025-01-06"), ("18-01-25", "2025-01-18"), ("2025/01/11", "2025-01-11"), ("20250108", "2025-01-08"),
     ("Jan 16, 2025", "2025-01-16"), ("9 de enero de 2025", "2025-01-09"), ("21-dic-2024", "2024-12-21"), ("3-ene-2025", "2025-01-03"), ("  2025-01-12 ", "2025-01-12")],
)
def test_days(spark, raw, day):
    (r,) = parse(spark, raw)
    assert str(r.day) == day and r.instant is None


def test_month_first_sources_and_unknown_order(spark):
    assert str(parse(spark, "06/01/2025", day_first=False)[0].day) == "2025-06-01"
    assert parse(spark, "06/01/2025", day_first=None)[0].day is None


def test_no_times(spark):
    for r in parse(spark, "Promocionado", "None", "-", "N/A", "0000-00-00", "31/02/2026", "2025-13-01", "2025-01-01T25:00:00", "x" * 5000):
        assert r.instant is None and r.day is None and r.age_unit is None


def test_unknown_zone_gives_no_instant(spark):
    assert parse(spark, "2025-01-19T20:16:12", zone=None)[0].instant is None
    assert parse(spark, "2025-01-19T20:16:12", zone="Mars/Olympus")[0].instant is None


def rows(spark, *data):
    return spark.createDataFrame(list(data), "ingest_seq bigint, posted_date string, postedDate string, scraped_at string, origin_file string, zone string")


def sources(spark):
    return spark.createDataFrame([("f", MADRID, True), ("g", CHILE, False)], "origin_file string, zone_name string, day_first boolean")


def run(spark, df, dictionary=None):
    d = dictionary or TimestampDictionary(spark, scratch_path(spark, "t"))
    return {(r.ingest_seq, r.field): r.norm for r in normalise_times(df, sources(spark), d).collect()}


def test_ages_count_back_in_local_time(spark):
    got = run(spark, rows(
        spark,
        (1, "Hace 2 semanas", "hace 3  DÍAS", "2025-01-19T00:30:00", "f", "clash"),
        (2, "Reposted 1 month ago", None, "2025-03-31T12:00:00", "f", None),
        (3, "Publicado hace 5 horas", "ayer", "2025-01-19T02:00:00+00:00", "f", None),
        (4, "Hace 2 semanas", None, "-", "f", None),
        (5, "Hace 2 semanas", None, None, "f", None),
        (6, "3 days ago", "", "2025-01-19T00:30:00", "unknown", None),
    ))
    assert got[1, "posted_date"] == "2025-01-05" and got[1, "postedDate"] == "2025-01-16"
    assert got[2, "posted_date"] == "2025-02-28"
    assert got[3, "posted_date"] == "2025-01-18" and got[3, "postedDate"] == "2025-01-18"
    assert not {k for k in got if k[0] in (4, 5)} - {(5, "x")}
    assert (6, "posted_date") not in got and (6, "postedDate") not in got


def test_repeated_rows_and_empty_tables(spark):
    one = (1, "2025-01-12", None, None, "f", None)
    d = TimestampDictionary(spark, scratch_path(spark, "t"))
    twice = normalise_times(rows(spark, one, one), sources(spark), d).collect()
    assert len(twice) == 2 and {r.norm for r in twice} == {"2025-01-12"}
    assert run(spark, rows(spark).limit(0)) == {}


def test_dictionary_parses_only_what_is_new(spark):
    d = TimestampDictionary(spark, scratch_path(spark, "t"))
    run(spark, rows(spark, (1, "2025-01-12", None, None, "f", None)), d)
    run(spark, rows(spark, (2, "2025-01-12", "2025-01-13", None, "f", None)), d)
    assert sorted(r.raw for r in d.read().collect()) == ["2025-01-12", "2025-01-13"]


def test_wall_clock_against_brute_force(spark):
    random.seed(1)
    zones = [MADRID, CHILE, "America/New_York", "America/Argentina/Buenos_Aires"]
    cases = []
    for _ in range(150):
        z = random.choice(zones)
        w = dt.datetime(2024, random.choice([3, 4, 9, 10, 11]), random.randint(1, 30), random.randint(0, 4), random.randint(0, 59), 7)
        cases.append((w.strftime("%Y-%m-%dT%H:%M:%S"), z, w))
    df = spark.createDataFrame([(r, z, True) for r, z, _ in cases], "raw string, zone string, day_first boolean").distinct()
    got = {(r.raw, r.zone): r.instant for r in parse_entries(df).collect()}
    for raw, z, w in cases:
        assert got[raw, z] == w.replace(tzinfo=ZoneInfo(z), fold=0).astimezone(dt.timezone.utc).replace(tzinfo=None), (raw, z)


MORE = [
    ("2024-03-10T14:05Z", "2024-03-10T14:05:00Z"), ("2024-03-10 14:05", "2024-03-10T13:05:00Z"), ("10/03/2024 14:05", "2024-03-10T13:05:00Z"), ("5 Mar 2024 3:05 PM", "2024-03-05T14:05:00Z"),
    ("20240310T140500Z", "2024-03-10T14:05:00Z"), ("20240310 1405", "2024-03-10T13:05:00Z"), ("2024-03-10T14:05:00-03", "2024-03-10T17:05:00Z"), ("2024-03-10 14:05 UTC+3", "2024-03-10T11:05:00Z"),
    ("2024-03-10T14:05:00-05:00[America/Bogota]", "2024-03-10T19:05:00Z"), ("Sun, 10 Mar 2024 14:05:00 +0000", "2024-03-10T14:05:00Z"), ("Sun Mar 10 14:05:00 2024", "2024-03-10T13:05:00Z"),
    ("Sun Mar 10 14:05:00 UTC 2024", "2024-03-10T14:05:00Z"), ("Sunday, March 10th, 2024", "2024-03-10"), ("2024-W10-7", "2024-03-10"), ("2024W107", "2024-03-10"), ("2024-W54-1", None), ("2024.03.10", "2024-03-10"),
    ("2024-03-10 25:05", None), ("2024-03-10 14:61", None), ("2024-02-30", None), ("20241301", None), ("2024-03-10 14:05 XYZ", None),
]


def test_more_notations(spark, tmp_path):
    rows = spark.createDataFrame([(i, "f", raw, None, None) for i, (raw, _) in enumerate(MORE)], "ingest_seq bigint, origin_file string, posted_date string, postedDate string, scraped_at string")
    files = spark.createDataFrame([("f", "Europe/Madrid", True)], "origin_file string, zone_name string, day_first boolean")
    got = {MORE[r.ingest_seq][0]: r.norm for r in normalise_times(rows, files, TimestampDictionary(spark, f"{tmp_path}/d")).collect()}
    assert got == {raw: want for raw, want in MORE if want}


def test_dictionary_parses_nothing_twice_and_ignores_half_written_batches(spark, tmp_path):
    d = TimestampDictionary(spark, f"{tmp_path}/d")
    keys = spark.createDataFrame([("2024-03-10", "UTC", True), ("10/03/2024", "UTC", True)], "raw string, zone string, day_first boolean")
    spark.createDataFrame([("2024-03-10", "UTC", True, None, None, None, None)], DICTIONARY_SCHEMA).write.parquet(f"{tmp_path}/d/left-over")
    assert d.read() is None and d.absorb(keys).count() == 2
    assert d.absorb(keys.union(keys.select(F.lit("x"), "zone", "day_first"))).where("day is not null").count() == 2 and d.read().count() == 3


def test_state_is_found_again_by_the_same_files_only(spark, tmp_path):
    from acequia.session import state_path

    spark.range(3).write.parquet(f"{tmp_path}/a b")
    first = state_path(spark, "x", spark.read.parquet(f"{tmp_path}/a b"))
    assert first == state_path(spark, "x", spark.read.parquet(f"{tmp_path}/a b"))
    spark.range(1).write.mode("append").parquet(f"{tmp_path}/a b")
    assert first != state_path(spark, "x", spark.read.parquet(f"{tmp_path}/a b"))
