"""Streams in any order of arrival: mergeable deltas, dedup in two tiers, jobs over hot invoices."""

import collections
import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerlens.streaming import operations as S
from ledgerlens.streaming.deltas import DeltaStore, drain_into
from ledgerlens.streaming.jobs import job_results, track_jobs

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def files(base, batches, names):
    """One small file for each batch, one after the other."""
    for k, rows in enumerate(batches):
        pq.write_table(pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)}), f"{base}/{k:04d}.parquet")
        os.utime(f"{base}/{k:04d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return str(base)


def stream(spark, base):
    schema = spark.read.parquet(base).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base)


@pytest.fixture(scope="module")
def late_events(spark, tmp_path_factory):
    """Three days of actions, dealt to thirty files at random: nearly every row is late."""
    rng = random.Random(2)
    rows = [(rng.randrange(5), START + dt.timedelta(minutes=rng.randrange(3 * 1440) // 7 * 7 + rng.random())) for _ in range(3000)]
    return files(tmp_path_factory.mktemp("late"), [rows[k::30] for k in range(30)], ["user_id", "ts"]), rows


def test_throughput_of_late_rows(spark, late_events):
    base, rows = late_events
    got = {r.minute: r.n for r in S.throughput(stream(spark, base), 1, merge_every=4).withColumn("minute", F.unix_seconds("minute")).collect()}
    assert got == collections.Counter(int(t.timestamp()) // 60 * 60 for _, t in rows)


def test_sliding_windows_of_late_rows(spark, late_events):
    base, rows = late_events
    want = collections.Counter((u, (int(t.timestamp()) // 300 - k) * 300) for u, t in rows for k in range(6))
    got = {(r.user_id, r.start): r.n for r in S.rate_limits(stream(spark, base), 3, 30, 5, merge_every=7).withColumn("start", F.unix_seconds("start")).collect()}
    assert got == {k: n for k, n in want.items() if n > 3}


def counts(spark, frame, merge_every):
    def shape(rows):
        return rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.max("ts").alias("last")).withColumn("bucket", F.date_format("day", "yyyy-MM-dd"))

    return DeltaStore(frame, "counts", shape, {"n": "sum", "last": "max"}, merge_every)


def test_batches_that_run_twice_and_what_a_merge_rewrites(spark):
    rng = random.Random(4)
    frame = lambda day, n=40: spark.createDataFrame([(rng.randrange(3), START + dt.timedelta(days=day, minutes=rng.randrange(1440))) for _ in range(n)], "user_id long, ts timestamp")
    batches = [frame(k // 4).cache() for k in range(12)]
    store = counts(spark, batches[0], 4)
    for k, b in enumerate(batches):
        store.write(b, k)
        store.write(b, k)  # a batch that failed late and runs again
    total = batches[0]
    for b in batches[1:]:
        total = total.union(b)
    want = sorted(map(tuple, total.groupBy("user_id", F.to_date("ts")).agg(F.count("*"), F.max("ts")).collect()))
    assert sorted(map(tuple, store.table().collect())) == want
    # the first day was merged once, with the batches that touched it, and not again
    assert store.gens == {"2024-01-01": 3, "2024-01-02": 7, "2024-01-03": 11}
    again = counts(spark, batches[0], 4)
    again.folder = store.folder
    assert sorted(map(tuple, again.resume().table().collect())) == want and again.gens == store.gens
    # a late row of the first day rewrites that day alone, and deltas that were merged go in time
    store.write(frame(0, 1), 12)
    store.merge(12)
    assert store.gens == {"2024-01-01": 12, "2024-01-02": 7, "2024-01-03": 11}
    assert store.table().agg(F.sum("n")).first()[0] == 481
    left = [f for f in os.listdir(store.folder.removeprefix("file:") + "/deltas") if f.startswith("batch=")]
    assert left == ["batch=12"]
    assert not any("bucket=2024-01-01" in f or "bucket=2024-01-03" in f for f in store._base(["2024-01-02"]).inputFiles())


def test_empty_stream(spark, tmp_path):
    base = files(tmp_path, [[]], ["user_id", "ts"])
    empty = spark.readStream.schema("user_id long, ts timestamp").parquet(base)
    assert drain_into(counts(spark, empty, 4), empty).table().count() == 0


def test_dedup_of_a_hundred_batches_with_bounded_state(spark, tmp_path):
    rng = random.Random(3)
    pool = [f"{rng.getrandbits(128):032x}" for _ in range(1500)]
    batches = [[(h, START + dt.timedelta(minutes=rng.randrange(10**6))) for h in (*pool[15 * k : 15 * k + 15], *rng.choices(pool[: 15 * k + 15], k=10))] for k in range(100)]
    base = files(tmp_path, batches, ["hash_archivo", "ts"])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        store = S.dedup_uploads(stream(spark, base), recent="2 seconds", merge_every=10, digits=1)
        got = [r.hash_archivo for r in store.table().select("hash_archivo").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(set(got)) == 1500 and set(got) == set(pool)
    state = [p["stateOperators"][0]["numRowsTotal"] for p in store.progress]
    assert len(state) > 90 and max(state) < 400, state  # hashes of a few seconds, not all that were ever seen


def plain_jobs(events, now, stale=900_000, most=2):
    by, out = collections.defaultdict(list), []
    for f, estado, ms in events:
        by[f].append((ms, estado))
    for f, rows in by.items():
        rows.sort()
        times = 0
        for k, (ms, estado) in enumerate(rows):
            if estado in ("COMPLETADO", "ERROR"):
                out.append((f, estado, ms, False))
                times = 0
            limit = ms + stale
            if estado == "EN_PROCESO" and (rows[k + 1][0] > limit if k + 1 < len(rows) else limit <= now):
                times += 1
                out.append((f, "ERROR" if times % most == 0 else "PENDIENTE", limit, True))
    return sorted(out)


def test_jobs_of_hot_and_other_invoices(spark, tmp_path):
    rng = random.Random(7)
    day = 86_400_000
    states = ["PENDIENTE", "EN_PROCESO", "EN_PROCESO", "EN_PROCESO", "COMPLETADO", "ERROR"]
    rows = [(1 if rng.random() < 0.4 else rng.randrange(40), rng.choice(states), rng.randrange(12 * day)) for _ in range(4000)]
    now = max(r[2] for r in rows) - 600_000
    df = spark.createDataFrame(rows, "factura_id long, estado string, ms long")
    got = sorted((r.factura_id, r.estado, r.ms, r.recovered) for r in job_results(df, now).collect())
    assert got == plain_jobs(rows, now)
    assert sorted((r.factura_id, r.estado, r.ms, r.recovered) for r in job_results(df, now, max_recoveries=3).collect()) == plain_jobs(rows, now, most=3)
    assert job_results(df.limit(0), None).count() == 0
    base = files(tmp_path, [rows[k::12] for k in range(12)], ["factura_id", "estado", "ms"])
    streamed = sorted((r.factura_id, r.estado, r.ms, r.recovered) for r in track_jobs(stream(spark, base), merge_every=5).collect())
    assert streamed == got
