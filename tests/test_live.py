"""The gate of live recordings against the gate of whole ones, for any split into micro-batches and with late packets."""

import datetime
import random

import pytest

from boxwright.operators import dataset
from boxwright.streaming import live

SCHEMA = "recording string, place long, time timestamp, has_idr boolean, has_sps boolean, params_only boolean"


@pytest.mark.parametrize("seed", [1, 2])
def test_live_gate(spark, tmp_path, seed):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    packets = []
    for name in ("q", "r", "s"):
        for place in range(25):
            idr, params = rng.random() < 0.2, rng.random() < 0.25
            packets.append((name, place, start + datetime.timedelta(seconds=place), idr and not params, (idr and rng.random() < 0.4) or params, params))
    # up to four seconds late, in batches of their own
    packets.sort(key=lambda p: p[2].timestamp() + rng.uniform(0, 4))
    cuts = sorted(rng.sample(range(1, len(packets)), 3))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(packets)], strict=True)):
        spark.createDataFrame(packets[a:b], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    # a packet of another recording, long after, lets the watermark pass all others
    last = [("z", 0, start + datetime.timedelta(hours=1), False, False, False)]
    spark.createDataFrame(last, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STORE)
    try:
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = live.gated(stream).writeStream.outputMode("append").format("memory").queryName(f"gate{seed}").start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.recording, r.place) for r in spark.sql(f"select * from gate{seed}").collect())
    whole = spark.createDataFrame(packets, SCHEMA)
    assert got == sorted((r.recording, r.place) for r in dataset.gop_gate(whole, "recording", ["place"]).collect())
    assert got
