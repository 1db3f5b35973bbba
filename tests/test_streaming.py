import time

import pytest

from quillspark.operators import state
from quillspark.streaming import events as ev
from pyspark.sql import functions as F


@pytest.fixture
def folder(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts")
    path = str(tmp_path / "events")
    rows = d.count()
    for i in range(4):  # one file after another, in the order of time
        d.offset(i * rows // 4).limit(rows // 4).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return path, d


def run(spark, df, mode, tmp_path):
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_tumbling_equals_batch(spark, folder, tmp_path):
    path, d = folder
    got = run(spark, ev.tumbling(ev.read_events(spark, path, d.schema), "1 hour", "10 days"), "complete", tmp_path)
    want = d.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    key = lambda x: sorted((r["window"]["start"], r["event_type"], r["n"], round(r["total"], 4)) for r in x.collect())
    assert key(got) == key(want)


def test_sliding_and_sessions(spark, folder, tmp_path):
    path, d = folder
    got = run(spark, ev.sliding(ev.read_events(spark, path, d.schema), "2 hours", "1 hour", "10 days"), "complete", tmp_path)
    assert got.agg(F.sum("n")).first()[0] == 2 * d.count()
    got = run(spark, ev.sessions(ev.read_events(spark, path, d.schema), "30 minutes", "10 days"), "complete", tmp_path / "s")
    assert got.agg(F.sum("n")).first()[0] == d.count()


def test_rate_limit_equals_batch(spark, folder, tmp_path):
    path, d = folder
    stream = ev.rate_limited(ev.read_events(spark, path, d.schema), "user_id", 1, 7200)
    got = {r["event_id"]: r["accepted"] for r in run(spark, stream, "append", tmp_path).collect()}
    s = d.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    want = {r["event_id"]: r["accepted"] for r in state.rate_limit(s, "user_id", "t", "event_id", 1, 7200 * 1_000_000).collect()}
    assert got == want


def test_batches_are_written_once(spark, folder, tmp_path):
    path, d = folder
    out = str(tmp_path / "out")
    for _ in range(2):
        ev.write_batches(ev.read_events(spark, path, d.schema), out, str(tmp_path / "k"), "event_id").awaitTermination(120)
    rows = spark.read.parquet(out)
    assert rows.count() == d.count() == rows.select("event_id").distinct().count()
