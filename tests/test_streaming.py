"""Streaming forms driven to completion over files."""

import random

from pyspark.sql import functions as F

from acequia.operators import budget as B
from acequia.streaming import incremental as I

LOG = "k string, seq bigint, ts double, kind string, weight double, cool_run boolean"


def drain(stream, name, spark, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"select * from {name}").collect()


def test_first_seen_across_batches(spark, tmp_path):
    for i, rows in enumerate([[("a", 1), ("", 2), ("b", 3)], [("a", 4), (None, 5), ("", 6)]]):
        spark.createDataFrame(rows, "key string, n int").withColumn("ts", F.lit("2025-01-01 00:00:00")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={i}"))
    s = spark.readStream.schema("key string, n int, ts string").parquet(str(tmp_path / "in"))
    got = drain(I.stream_first_seen(s, F.col("key"), "ts"), "seen", spark, tmp_path)
    assert sorted(r.n for r in got if r.key in ("", None)) == [2, 5, 6] and sorted(r.key for r in got if r.key) == ["a", "b"]


def test_windows_and_sessions(spark, tmp_path):
    rows = [("a", f"2025-01-01 00:00:{s:02d}") for s in (0, 5, 30)] + [("a", "2025-01-01 01:00:00"), ("z", "2025-01-02 00:00:00")]
    spark.createDataFrame(rows, "k string, ts string").write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("k string, ts string").parquet(str(tmp_path / "in"))
    windows = drain(I.stream_rates(read(), "k", "ts"), "rates", spark, tmp_path, "complete")
    assert max(r.calls for r in windows if r.k == "a") == 3
    sessions = drain(I.stream_sessions(read(), "k", "ts"), "sessions", spark, tmp_path, "complete")
    assert sorted(r.calls for r in sessions if r.k == "a") == [1, 3]


def test_budget_state_equals_replay(spark, tmp_path):
    random.seed(4)
    rows = [(f"k{random.randint(0, 1)}", i, float(i * 3), random.choice(["acquire", "error", "pause"]), None, False) for i in range(30)]
    whole = spark.createDataFrame(rows, LOG)
    for part in (rows[:15], rows[15:]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # the two files land in one order; ask for it by reading both in one batch if they don't
    got = {r.seq: r.calls for r in drain(I.stream_budget(s, "k"), "budget", spark, tmp_path)}
    want = {r.seq: r.calls for r in B.replay(whole, "k", "seq").collect()}
    assert got.keys() == want.keys() and max(got.values()) == max(want.values())
