"""Leases as a stream decide as the batch does, over shuffled, late and repeated deliveries in any micro-batches; leases end by timers."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators import state
from quillspark.streaming import leases

START = datetime(2026, 1, 1, tzinfo=UTC)


@pytest.mark.parametrize("seed", [1])
def test_stream_decides_as_the_batch(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(k, i, 60 * i + rnd.randint(0, 59)) for i in range(120) for k in ("a", "b") if rnd.random() < 0.7]
    rows += [("a", 1000, 60 * 5 + 7), ("b", 1001, 60 * 5 + 7)]
    df = spark.createDataFrame(rows, "k string, id long, s long")
    want = {(r["k"], r["id"]): r["outcome"] for r in state.lease_decisions(df, "k", "s", "id", 300, 4, 1800).collect()}
    assert set(want.values()) == {"granted", "active", "rate"}
    # delivered up to ten minutes late, some twice, in batches of their own; then a row far on, so that all timers fire
    sent = sorted(rows, key=lambda r: r[2] + rnd.uniform(0, 600))
    batches = [sent[i : i + 40] for i in range(0, len(sent), 40)]
    for i, b in enumerate(batches[1:], 1):
        b += rnd.sample(batches[i - 1], 5)
    batches += [[("z", 1, 10**6)], [("z", 2, 10**6 + 1)]]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i, b in enumerate(batches):
            spark.createDataFrame([(k, n, START + timedelta(seconds=s)) for k, n, s in b], "k string, id long, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:03d}")
        stream = spark.readStream.schema("k string, id long, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        out = leases.leases(stream, "k", "at", "id", 300, 4, 1800, "1 hour")
        q = out.writeStream.format("memory").queryName("lease_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.processAllAvailable()
        q.awaitTermination(240)
        got = spark.table("lease_rows").select("k", "id", F.unix_seconds("at").alias("s"), "outcome").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    decided = {(r["k"], r["id"]): r["outcome"] for r in got if r["outcome"] != "expired" and r["k"] != "z"}
    assert decided == want
    at = {(k, n): s + int(START.timestamp()) for k, n, s in rows}
    assert sorted((r["k"], r["id"], r["s"]) for r in got if r["outcome"] == "expired" and r["k"] != "z") == sorted((k, n, at[k, n] + 300) for (k, n), o in want.items() if o == "granted")
