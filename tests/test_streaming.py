"""Streaming operators: each stream result equals the batch computation over
the same rows (STR-4/5/7), and the partition upsert keeps one row per key."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from opslens.sources import testviews as tv
from opslens.streaming import incremental as inc
from tests.conftest import SF_SMALL


def _drain(spark, stream, name, mode="append"):
    q = (stream.writeStream.outputMode(mode).format("memory").queryName(name)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)


def test_sliding_live_operations_match_batch(spark):
    q = tv.load(spark, SF_SMALL, "query_history").select("start_time", "warehouse_name", "queued_overload_time",
                                                         "transaction_blocked_time")
    src, _run = inc.stage_as_files(q, "live-ops", files=2)
    out = _drain(spark, inc.live_operations_stream(inc.file_stream(spark, src, q.schema, 1), watermark="40 days"),
                 "live_ops", mode="complete")
    batch = (q.withColumn("start_time", F.col("start_time").cast("timestamp"))
             .groupBy(F.window("start_time", "10 minutes", "1 minute").alias("w"), "warehouse_name")
             .agg(F.count(F.lit(1)).alias("active")))
    assert out.count() == batch.count()
    assert out.agg(F.sum("active")).first()[0] == batch.agg(F.sum("active")).first()[0]


def test_session_windows_cover_every_statement(spark):
    q = tv.load(spark, SF_SMALL, "query_history").select("start_time", "user_name")
    src, _run = inc.stage_as_files(q, "sessions", files=1)
    out = _drain(spark, inc.activity_sessions_stream(inc.file_stream(spark, src, q.schema, 1), watermark="40 days"),
                 "sessions_out", mode="complete")
    assert out.agg(F.sum("statements")).first()[0] == q.count()
    assert out.filter(F.col("session_end") <= F.col("session_start")).count() == 0


def test_dedup_within_watermark_keeps_one_per_key(spark):
    rows = [(datetime(2024, 1, 1, 0), "WH_1", "COST_SPIKE", "a1"), (datetime(2024, 1, 1, 1), "WH_1", "COST_SPIKE", "a2"),
            (datetime(2024, 1, 1, 2), "WH_2", "COST_SPIKE", "a3")]
    df = spark.createDataFrame(rows, "created_at timestamp_ntz, entity string, alert_type string, alert_id string")
    src, _run = inc.stage_as_files(df, "dedup", files=1)
    out = _drain(spark, inc.open_alert_dedup_stream(inc.file_stream(spark, src, df.schema, 1)), "dedup_out")
    assert sorted(r.entity for r in out.collect()) == ["WH_1", "WH_2"]


def test_partition_upsert_replaces_by_key(spark):
    import uuid
    from opslens.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark)}/opslens-test-upsert-{uuid.uuid4().hex[:8]}"
    s = "d date, k string, v double"
    inc.upsert_partitions(spark.createDataFrame([(datetime(2024, 1, 1).date(), "a", 1.0),
                                                 (datetime(2024, 1, 2).date(), "b", 2.0)], s), path, ["d", "k"], "d")
    batch2 = spark.createDataFrame([(datetime(2024, 1, 2).date(), "b", 5.0), (datetime(2024, 1, 2).date(), "c", 3.0)], s)
    inc.upsert_partitions(batch2, path, ["d", "k"], "d")
    inc.upsert_partitions(batch2, path, ["d", "k"], "d")  # a replayed micro-batch changes nothing
    got = sorted((r.k, r.v) for r in spark.read.parquet(path).collect())
    assert got == [("a", 1.0), ("b", 5.0), ("c", 3.0)]


def test_recovery_pairing_states(spark):
    def h(n):
        return datetime(2024, 1, 1) + timedelta(hours=n)

    rows = [("D", "S", "A", h(0), "FAILED"), ("D", "S", "A", h(2), "SUCCEEDED"),      # within the 4 h SLA
            ("D", "S", "B", h(1), "FAILED"), ("D", "S", "B", h(3), "FAILED"), ("D", "S", "B", h(8), "SUCCEEDED"),  # late, by the last failure
            ("D", "S", "C", h(5), "FAILED"),                                             # never recovers
            ("D", "S", "Z", h(60), "SUCCEEDED")]                                         # moves the watermark on
    df = spark.createDataFrame(rows, "database_name string, schema_name string, name string, scheduled_time timestamp_ntz, state string")
    want = {"A": (inc.WITHIN, h(0), h(2)), "B": (inc.LATE, h(3), h(8)), "C": (inc.OPEN, h(5), None)}
    for files in (1, 4):
        src, run = inc.stage_as_files(df, "pairing", files=files, order_col="scheduled_time")
        out = inc.recovery_summary(spark, src, df.schema, run)
        assert {r.task_name: (r.recovery_state, r.failure_at, r.recovery_at) for r in out.collect()} == want


def test_recovery_of_a_failure_that_comes_late(spark):
    """Inside the watermark, order of arrival doesn't matter."""
    def h(n):
        return datetime(2024, 1, 1) + timedelta(hours=n)

    schema = "database_name string, schema_name string, name string, scheduled_time timestamp_ntz, state string"
    slices = [[("D", "S", "A", h(0), "FAILED"), ("D", "S", "A", h(2), "SUCCEEDED"), ("D", "S", "A", h(7), "SUCCEEDED")],
              [("D", "S", "A", h(6), "FAILED"), ("D", "S", "A", h(1), "FAILED")],
              [("D", "S", "A", h(6.5), "SUCCEEDED")]]
    _src, run = inc.stage_as_files(spark.createDataFrame(slices[0], schema).limit(0), "late", files=1)
    src = f"{run}/slices"
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    out = inc.recovery_summary(spark, src, spark.createDataFrame(slices[0], schema).schema, run)
    assert [(r.failure_at, r.recovery_at, r.recovery_state) for r in out.collect()] == [(h(6), h(6.5), inc.WITHIN)]


def _path(spark):
    import uuid

    from opslens.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/opslens-test-versions-{uuid.uuid4().hex[:8]}"


def test_versioned_upsert_is_exactly_once(spark, monkeypatch):
    """A crash between write and commit leaves the old version; the batch then
    comes again and is taken once; a batch taken before is left out."""
    path, s = _path(spark), "d date, k string, v double"
    day = [datetime(2024, 1, n).date() for n in (1, 2, 3)]
    schema = spark.createDataFrame([], s).schema

    def now():
        return sorted(((r.d, r.k, r.v) for r in inc.read_versioned(spark, path, schema, "d").collect()), key=str)

    assert now() == []
    first = spark.createDataFrame([(day[0], "a", 1.0), (day[1], "b", 2.0), (None, "n", 0.0)], s)
    assert inc.upsert_versioned(first, path, ["d", "k"], "d", 0)
    assert now() == sorted([(day[0], "a", 1.0), (day[1], "b", 2.0), (None, "n", 0.0)], key=str)

    class Lost(Exception):
        pass

    def crash(*_a):
        raise Lost

    second = spark.createDataFrame([(day[1], "b", 5.0), (day[1], "c", 3.0), (None, "n", 9.0)], s)
    with monkeypatch.context() as m:
        m.setattr(inc, "commit_version", crash)
        try:
            inc.upsert_versioned(second, path, ["d", "k"], "d", 1)
        except Lost:
            pass
    assert now() == sorted([(day[0], "a", 1.0), (day[1], "b", 2.0), (None, "n", 0.0)], key=str)
    assert inc.upsert_versioned(second, path, ["d", "k"], "d", 1)
    want = sorted([(day[0], "a", 1.0), (day[1], "b", 5.0), (day[1], "c", 3.0), (None, "n", 9.0)], key=str)
    assert now() == want
    stale = spark.createDataFrame([(day[1], "b", -1.0)], s)
    assert not inc.upsert_versioned(stale, path, ["d", "k"], "d", 1) and now() == want
    assert inc.upsert_versioned(first.limit(0), path, ["d", "k"], "d", 2) and now() == want
    assert inc.upsert_versioned(spark.createDataFrame([(day[2], "z", 7.0)], s), path, ["d", "k"], "d", 3)
    assert now() == sorted([*want, (day[2], "z", 7.0)], key=str)


def test_rows_without_a_time_are_staged(spark):
    rows = [(None, 1), (None, 2)] + [(datetime(2024, 1, 1) + timedelta(hours=n), n) for n in range(20)]
    df = spark.createDataFrame(rows, "at timestamp_ntz, n int")
    src, _run = inc.stage_as_files(df, "nulls", files=3, order_col="at")
    assert sorted(map(str, spark.read.parquet(src).collect())) == sorted(map(str, df.collect()))
    nothing, _run = inc.stage_as_files(df.limit(0), "none", files=3, order_col="at")
    assert spark.read.schema(df.schema).parquet(nothing).count() == 0


def test_append_mode_gives_out_closed_sessions_and_forgets_them(spark):
    # a statement every five minutes for ten users, with a break of an hour after each sixth
    n = F.col("id")
    minutes = F.floor(n / 60) * 90 + F.floor(n % 60 / 10) * 5
    q = spark.range(3600).select((F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))).alias("start_time"),
                                 F.concat(F.lit("U"), (n % 10).cast("string")).alias("user_name"))
    src, run = inc.stage_as_files(q, "append-sessions", files=12, order_col="start_time")
    inc.flush_event(src, spark, q.schema, "start_time", "1 DAY")
    stream = inc.activity_sessions_stream(inc.file_stream(spark, src, q.schema), watermark="2 hours")
    query = (stream.writeStream.outputMode("append").format("memory").queryName("append_sessions")
             .option("checkpointLocation", f"{run}/append").trigger(availableNow=True).start())
    query.awaitTermination()
    got = spark.table("append_sessions").collect()
    # every session once, the flush row's own never
    assert len(got) == 600 == len({(r.user_name, r.session_start) for r in got}) and {r.statements for r in got} == {6}
    assert all(r.user_name is not None for r in got)
    held = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert max(held) < 120 and held[-1] <= 1
