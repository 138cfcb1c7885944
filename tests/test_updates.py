"""Updates of bucketed tables and dashboards kept by deltas, against the full rewrite and the batch answer."""

import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import constants as K
from ledgerlens.operators.latency import latency_of_span, latency_sketches
from ledgerlens.operators.patch import apply_patch
from ledgerlens.sources.buckets import bucket_of, read_buckets, touched_buckets, update_buckets, write_buckets
from ledgerlens.streaming.dashboard import rollup_by_state, rollup_rows, state_rollup

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def snapshot(path):
    return {os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_update_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(5000).select("id", (F.col("id") % 7).alias("a"), F.lit("x").alias("b"))
    write_buckets(rows, path, "id", 16)
    assert sorted(map(tuple, read_buckets(spark, path).collect())) == sorted(map(tuple, rows.collect()))
    patch = spark.createDataFrame([(5, None, True), (70, 3, True), (71, 9, False), (9999, 1, True)], "id long, a long, set_a boolean")
    touched = touched_buckets(patch, "id", 16)
    assert 0 < len(touched) < 16
    plan = read_buckets(spark, path, touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    before = snapshot(path)
    change = lambda old, p: apply_patch(old, p, "id", ["a"])
    assert update_buckets(spark, path, "id", patch, change, 16) == touched
    after = snapshot(path)
    of = lambda name: int(name.split("bucket=")[1].split("/")[0])
    assert {k: v for k, v in before.items() if of(k) not in touched} == {k: v for k, v in after.items() if of(k) not in touched}
    assert not {k for k in before if of(k) in touched} & set(after)
    want = sorted(map(str, change(rows, patch).collect()))
    assert sorted(map(str, read_buckets(spark, path).collect())) == want
    update_buckets(spark, path, "id", patch, change, 16)  # once more changes nothing
    assert sorted(map(str, read_buckets(spark, path).collect())) == want
    kept = snapshot(path)
    assert update_buckets(spark, path, "id", patch.limit(0), change, 16) == [] and snapshot(path) == kept
    assert read_buckets(spark, path).where(F.col("id") == 70).first()["a"] == 3
    with pytest.raises(ValueError):
        write_buckets(rows.withColumn("Bucket", F.lit(1)), path, "id")


@pytest.mark.parametrize("merge_every", [1, 3, 100])
def test_rollup_of_moves_in_any_order(spark, tmp_path, merge_every):
    rng = random.Random(merge_every)
    actions = [*K.ACTION_STATE, "EDITADA"]
    rows = [(rng.choice([1, 1, *range(40)]), k, rng.choice(actions), START + dt.timedelta(hours=rng.randrange(90))) for k in range(700)]
    rng.shuffle(rows)
    for k in range(8):
        part = rows[k::8]
        pq.write_table(pa.table({n: [r[i] for r in part] for i, n in enumerate(("factura_id", "id", "accion", "ts"))}), str(tmp_path / f"{k}.parquet"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path)).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    firms = spark.createDataFrame([(i, i % 3) for i in range(39)], "factura_id long, asesoria_id long")
    counts = state_rollup(stream, firms, merge_every, parts=4)
    newest = {}
    for factura, k, action, ts in rows:
        if action in K.ACTION_STATE:
            newest[factura] = max(newest.get(factura, (START, -1, "")), (ts, k, K.ACTION_STATE[action]))
    want, by_state = {}, {}
    for factura, (ts, _, state) in newest.items():
        if factura < 39:
            want[factura % 3, state, ts.strftime("%Y-%m-%d")] = want.get((factura % 3, state, ts.strftime("%Y-%m-%d")), 0) + 1
            by_state[factura % 3, state] = by_state.get((factura % 3, state), 0) + 1
    assert {tuple(r)[:3]: r.n for r in rollup_rows(counts).collect()} == want
    assert {tuple(r)[:2]: r["count"] for r in rollup_by_state(counts).collect()} == by_state


def test_rollup_of_nothing(spark, tmp_path):
    pq.write_table(pa.table({"factura_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "accion": pa.array([], pa.string()), "ts": pa.array([], pa.timestamp("us", "UTC"))}), str(tmp_path / "0.parquet"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path)).schema).parquet(str(tmp_path))
    assert rollup_rows(state_rollup(stream, spark.createDataFrame([], "factura_id long, asesoria_id long"))).count() == 0


def test_latency_of_spans_from_sketches(spark):
    rng = random.Random(4)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    rows = [(rng.choice([1, 1, 1, 2]), day(rng.randrange(20)), int(rng.expovariate(1 / 900))) for _ in range(60000)] + [(3, day(0), 7)]
    sketches = latency_sketches(spark.createDataFrame(rows, "asesoria_id long, day date, s long"))
    assert sketches.count() == 41
    for first, last in ((None, None), (day(3), day(9)), ("2024-01-02", "2024-01-02")):
        got = {r.asesoria_id: r for r in latency_of_span(sketches, 0.95, first, last).collect()}
        lo, hi = dt.date.fromisoformat(str(first or day(0))), dt.date.fromisoformat(str(last or day(30)))
        for firm in (1, 2):
            values = sorted(s for f, d, s in rows if f == firm and lo <= d <= hi)
            below = sum(v < got[firm].quantile for v in values) / len(values)
            upto = sum(v <= got[firm].quantile for v in values) / len(values)
            assert got[firm].n == len(values) and below - 0.01 <= 0.95 <= upto + 0.01
    assert latency_of_span(sketches, 0.95, day(1), day(1)).where("asesoria_id = 3").count() == 0
    assert latency_of_span(sketches.limit(0)).count() == 0
