"""Mergeable percentiles (AGG-6 / SUM-8): coarser facts from hourly sketches."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from opslens.operators import boards as bd

AS_OF = datetime(2024, 1, 31)


def _queries(spark, n):
    # a hot warehouse, hours of very different sizes and a heavy tail
    hour = (F.pmod(F.col("id") * F.col("id"), F.lit(24))).cast("int")
    at = F.expr("TIMESTAMP_NTZ '2024-01-29 00:00:00'") + F.make_dt_interval(F.lit(0), hour, F.lit(0), (F.col("id") % 60))
    time = F.when(F.col("id") % 17 > 0, F.floor(F.pow(F.lit(1.5), F.col("id") % 23) * 10 + F.col("id") % 1000)).cast("bigint")
    return spark.range(n).select(at.alias("start_time"), F.when(F.col("id") % 3 > 0, "HOT").otherwise(F.concat(F.lit("WH_"), (F.col("id") % 7).cast("string"))).alias("warehouse_name"),
                                 time.alias("execution_time"))


@pytest.mark.parametrize("keys", [("warehouse_name",), ()])
def test_merged_sketches_stay_within_their_rank_error(spark, keys):
    q = _queries(spark, 60000)
    hourly = bd.query_sketch_fact(q, AS_OF, 7)
    day = bd.query_period_fact(hourly, "day", keys).collect()
    for r in day:
        mine = q.filter(F.col("execution_time").isNotNull())
        if keys:
            mine = mine.filter(F.col("warehouse_name") == r.warehouse_name)
        values = [x[0] for x in mine.select("execution_time").collect()]
        assert r.timed_count == len(values) and r.total_execution_ms == sum(values) and r.max_execution_ms == max(values)
        for p, got in ((0.5, r.p50_execution_ms), (0.95, r.p95_execution_ms), (0.99, r.p99_execution_ms)):
            below, upto = sum(v < got for v in values) / len(values), sum(v <= got for v in values) / len(values)
            assert below - 0.015 <= p <= upto + 0.015
    assert len(day) == (8 if keys else 1)


def test_small_groups_are_exact_and_nulls_count(spark):
    rows = [(datetime(2024, 1, 30, 1), "A", v) for v in (5, 1, 9, 3, None)] + [(datetime(2024, 1, 30, 2), "A", 7), (datetime(2024, 1, 30, 3), "B", None),
                                                                              (datetime(2024, 1, 30, 3), None, 4), (None, "A", 1000)]
    q = spark.createDataFrame(rows, "start_time timestamp_ntz, warehouse_name string, execution_time bigint")
    got = {r.warehouse_name: r for r in bd.query_period_fact(bd.query_sketch_fact(q, AS_OF, 7), "day").collect()}
    assert got["A"].query_count == 6 and got["A"].timed_count == 5 and got["A"].p50_execution_ms == 5.0
    assert got["B"].query_count == 1 and got["B"].p95_execution_ms is None and got["B"].max_execution_ms is None
    assert got[None].p99_execution_ms == 4.0
    assert bd.query_period_fact(bd.query_sketch_fact(q.limit(0), AS_OF, 7), "day").count() == 0
