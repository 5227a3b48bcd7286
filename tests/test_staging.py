"""A staged replay gives each slice whole, in order and to several tasks; capacity exceptions at their limits."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from opslens.operators import capacity as cap
from opslens.streaming import incremental as inc

NOW = datetime(2024, 1, 31)


def batches(spark, df, files, width):
    src, run = inc.stage_as_files(df, "staging", files=files, order_col="at", width=width)
    seen = []
    q = (inc.file_stream(spark, src, df.schema).writeStream.foreachBatch(lambda b, i: seen.append(sorted((r.at is not None, r.at, r.n) for r in b.collect())))
         .option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return src, [s for s in seen if s]


def test_slices_are_whole_and_in_order(spark):
    df = spark.range(200).select((F.lit(NOW).cast("timestamp_ntz") + F.make_interval(mins=F.col("id").cast("int"))).alias("at"), F.col("id").alias("n"))
    src, seen = batches(spark, df, 4, 3)
    assert [len(s) for s in seen] == [50, 50, 50, 50] and len(inc._data_files(spark, src)) == 12
    assert sorted(n for s in seen for _, _, n in s) == list(range(200))
    assert all(a[-1][1] < b[0][1] for a, b in zip(seen, seen[1:]))


def test_few_rows_ties_and_null_times(spark):
    rows = [(None, -1), *[(NOW, i) for i in range(5)], (NOW + timedelta(days=1), 9)]
    df = spark.createDataFrame(rows, "at timestamp_ntz, n bigint")
    src, seen = batches(spark, df.orderBy(F.rand(7)), 2, 4)
    assert len(inc._data_files(spark, src)) == 8 and sorted(n for s in seen for _, _, n in s) == [-1, 0, 1, 2, 3, 4, 9]
    assert -1 in [n for _, _, n in seen[0]] and 9 in [n for _, _, n in seen[-1]]


Q = ("start_time timestamp_ntz, warehouse_name string, warehouse_size string, total_elapsed_time bigint, queued_overload_time bigint, "
     "queued_provisioning_time bigint, bytes_spilled_to_local_storage bigint, bytes_spilled_to_remote_storage bigint")
M = "start_time timestamp_ntz, warehouse_name string, credits_used double, credits_used_compute double"


def test_capacity_ladder(spark):
    at, gb = NOW - timedelta(days=1), 1024 ** 3
    q = [(at, "queue", "S", 10, 1, 0, 0, 0)] * 20 + [(at, "queue", "S", 10, None, None, None, None)] * 20 + [(at, "calm", "S", 10, 0, 0, 0, 0), (at, None, "S", 90_000, 1, 1, 1, 1)]
    q += [(at, "spill", "M", 10, 0, 0, 0, gb)] + [(at, "slow", "L", 30_000, 0, 0, 0, 0), (at, "slow", "L", 29_999, 0, 0, 0, 0)] + [(at, "local", "S", 10, 0, 0, 1, 0)] * 10
    m = [(at, "up", 5.0, 4.0), (NOW - timedelta(days=8), "up", 2.0, None), (at, "more", 1.25, None), (NOW - timedelta(days=8), "more", 1.0, None), (at, "new", 9.0, None), (at, "calm", 1.0, 1.0)]
    qd, md = spark.createDataFrame(q, Q), spark.createDataFrame(m, M)
    got = {r.warehouse_name: r for r in cap.capacity_exceptions(qd, md, NOW, 7).collect()}
    assert {k: (r.severity, r.signal, r.capacity_score) for k, r in got.items()} == {
        "queue": ("Critical", "Queue Pressure", 72.0), "spill": ("Medium", "Memory Spill", 76.0), "slow": ("Medium", "Latency Pressure", 82.0),
        "local": ("High", "Latency Pressure", 76.0), "up": ("High", "Credit Spike", None), "more": ("Medium", "Credit Spike", None)}
    s = cap.capacity_summary(qd, md, NOW, 7).first()
    assert (s.warehouses_active, s.total_queries, s.queued_queries, s.spill_queries, s.high_latency_queries, s.metered_credits, s.prior_credits) == (8, 54, 20, 11, 1, 15.25, 3.0)
    assert tuple(cap.capacity_summary(qd.limit(0), md.limit(0), NOW).first()) == (0, 0, 0, 0, 0, 0.0, 0.0, None, None, 0.0)
