"""Windows end at ``as_of``, reads that fail raise, graphs have no depth cap,
and summaries count uncut lists."""

import os
import uuid
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opslens.functions.exprs import page
from opslens.operators import anomaly, graph, query, security, summaries, tasks, usage
from opslens.operators.graph import graph_impact
from opslens.operators.task_costs import critical_paths, run_exceptions
from opslens.session import ensure_checkpoint_dir, path_exists
from opslens.sources import feeds
from opslens.sources import testviews as tv
from opslens.streaming import incremental as inc
from tests.conftest import SF_SMALL

MIDDLE = datetime(2024, 1, 15)


def _between(df, col, days, end=MIDDLE):
    return df.where((F.col(col) >= F.lit(end - timedelta(days=days)).cast("timestamp_ntz")) & (F.col(col) < F.lit(end).cast("timestamp_ntz")))


@pytest.fixture(scope="module")
def queries(spark):
    return tv.load(spark, SF_SMALL, "query_history")


def test_lookback_ends_at_as_of_inside_the_data(spark, queries):
    inside = _between(queries, "start_time", 7)
    later = queries.where(F.col("start_time") >= F.lit(MIDDLE).cast("timestamp_ntz")).count()
    assert later > 0 and inside.count() > 0
    counted = usage.query_type_mix(queries, MIDDLE, 7)
    name = next(c for c in counted.columns if "count" in c or "quer" in c and c != "query_type")
    assert counted.agg(F.sum(name)).first()[0] == inside.count()


@pytest.mark.parametrize("run,table,col", [
    (lambda q: query.root_cause(q, MIDDLE, 7, None), "query_history", "start_time"),
    (lambda q: security.failed_logins(q, MIDDLE, 7), "login_history", "event_timestamp"),
    (lambda q: anomaly.query_regressions(q, MIDDLE, 14, 1.2, limit=None), "query_history", "start_time"),
    (lambda q: query.search_history(q, MIDDLE, "select", "contains", 12), "query_history", "start_time"),
])
def test_rows_after_as_of_change_nothing(spark, run, table, col):
    """The same operator over the table cut at ``as_of`` gives the same rows."""
    whole = tv.load(spark, SF_SMALL, table)
    cut = whole.where(F.col(col) < F.lit(MIDDLE).cast("timestamp_ntz"))
    assert cut.count() < whole.count()
    assert sorted(map(str, run(whole).collect())) == sorted(map(str, run(cut).collect()))


def test_task_operators_stop_at_as_of(spark):
    t = tv.load(spark, SF_SMALL, "task_history")
    end = t.agg(F.expr("percentile_approx(scheduled_time, 0.5)")).first()[0]
    cut = t.where(F.col("scheduled_time") < F.lit(end).cast("timestamp_ntz"))
    inventory = tv.load(spark, SF_SMALL, "task_graph")
    impact = graph_impact(inventory).persist()
    statements = tv.load(spark, SF_SMALL, "task_statements")
    for run in (lambda x: tasks.failure_console(x, end, 60), lambda x: critical_paths(x, inventory, impact, end, 60),
                lambda x: run_exceptions(x, statements, inventory, impact, end, 60)):
        assert sorted(map(str, run(t).collect())) == sorted(map(str, run(cut).collect()))


def test_a_failed_read_leaves_the_summary(spark):
    path = f"{ensure_checkpoint_dir(spark)}/opslens-test-broken-{uuid.uuid4().hex[:8]}"
    schema = "d date, k string, v double"
    one = spark.createDataFrame([(date(2024, 1, 1), "a", 1.0), (date(2024, 1, 1), "b", 2.0)], schema)
    inc.upsert_partitions(one, path, ["d", "k"], "d")
    local = path.removeprefix("file://").removeprefix("file:")
    files = [os.path.join(r, f) for r, _, fs in os.walk(local) for f in fs if f.endswith(".parquet")]
    assert files
    kept = open(files[0], "rb").read()
    with open(files[0], "wb") as f:
        f.write(b"not parquet")
    with pytest.raises(Exception):
        inc.upsert_partitions(spark.createDataFrame([(date(2024, 1, 1), "c", 3.0)], schema), path, ["d", "k"], "d")
    assert [os.path.join(r, f) for r, _, fs in os.walk(local) for f in fs if f.endswith(".parquet")] == files
    with pytest.raises(Exception):
        feeds.summary_first(spark, path, lambda: one).collect()
    with open(files[0], "wb") as f:
        f.write(kept)
    for crc in [os.path.join(r, f) for r, _, fs in os.walk(local) for f in fs if f.endswith(".crc")]:
        assert os.path.exists(crc)
    assert not path_exists(spark, path + "-nowhere") and feeds.summary_first(spark, path + "-nowhere", lambda: one).count() == 2


def test_deep_chain_has_no_depth_cap(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(150)], "source string, target string")
    found = graph._bfs(spark.createDataFrame([("n0",)], "node string"), edges.coalesce(1))
    assert found.count() == 151 and found.agg(F.max("depth")).first()[0] == 150


def test_signatures_that_differ_late_stay_apart(spark):
    head = "x" * 300
    df = spark.createDataFrame([(head + "1",), (head + "2",), (head + "1",)], "m string")
    assert df.groupBy(tasks.error_signature(F.col("m"))).count().count() == 2


def test_page(spark):
    df = spark.range(10)
    assert df.transform(page(None, "id")).count() == 10
    assert [r.id for r in df.transform(page(3, F.desc("id"))).collect()] == [9, 8, 7]
