"""Downstream counts are exact however many tasks run below one, also where queries build on them."""

import random
from datetime import datetime

import pytest

from opslens.operators import graph as g
from opslens.operators import task_costs as tc
from test_walks import _plans_of_jobs, plain

NOW = datetime(2024, 1, 31)
INVENTORY = "database_name string, schema_name string, task_name string, state string, predecessors string, warehouse_name string, definition string"
TASKS = ("database_name string, schema_name string, name string, query_id string, scheduled_time timestamp_ntz, completed_time timestamp_ntz, "
         "state string, error_code string, error_message string")
STATEMENTS = "query_id string, start_time timestamp_ntz, total_elapsed_time bigint, warehouse_size string, credits_used_cloud_services double, query_text string"
# top -> mid -> 5000 tasks, every third of which leads to one of 700 tasks with several predecessors
BELOW = {"mid": 5700, "top": 5701}


def wide(spark):
    def task(name, preds, state="started"):
        return ("DB", "S", name, state, "[" + ",".join(f'"{p}"' for p in preds) + "]", "W", "")
    rows = [task("top", [], "suspended"), task("mid", ["top"], "suspended")] + [task(f"c{i}", ["mid"]) for i in range(5000)]
    rows += [task(f"g{i}", [f"c{3 * i}", f"c{3 * (i + 700) % 5000}"]) for i in range(700)]
    return spark.createDataFrame(rows, INVENTORY)


def test_impact_of_a_task_above_thousands(spark):
    got = {r.label: r.downstream_task_count for r in g.graph_impact(wide(spark)).collect()}
    assert {n: c for n, c in got.items() if c > 4096} == BELOW and len(got) == 5702


def test_critical_paths_above_thousands(spark):
    inventory = wide(spark)
    got = {r.root_task_name: r for r in tc.critical_paths(spark.createDataFrame([], TASKS), inventory, g.graph_impact(inventory), NOW, 1).collect()}
    # its own path and the one of its first task below: the most tasks downstream of those two
    assert (got["top"].downstream_task_count, got["top"].critical_path_score) == (5701, 2 * 10 + 5 * 5701.0)


def test_run_exceptions_above_thousands(spark):
    inventory = wide(spark)
    rows = tc.run_exceptions(spark.createDataFrame([], TASKS), spark.createDataFrame([], STATEMENTS), inventory, g.graph_impact(inventory), NOW).collect()
    assert {r.task_name: (r.signal, r.downstream_task_count, r.incident_priority) for r in rows} == {
        n: (tc.SUSPENDED, c, "P2 - Production Risk") for n, c in BELOW.items()}


@pytest.mark.parametrize("seed", range(2))
def test_counts_of_any_graph(spark, monkeypatch, seed):
    monkeypatch.setattr(g, "CHECKPOINT_EVERY", 2)
    monkeypatch.setattr(g, "TALLY_EVERY", 3)
    rnd = random.Random(seed)
    n = 40
    edges = [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range((30, 55)[seed])]
    edges += edges[:5] + [("p", "q"), ("q", "p"), ("q", "leaf"), ("p", "x"), ("s", "s"), ("s", "t"), ("n1", "p")]
    df = spark.createDataFrame([*edges, (None, "n0"), ("n0", None)], "source string, target string")
    want = {a: c for a, c in plain(edges).items() if c}
    assert {r.task_id: r.downstream_task_count for r in g.downstream_counts(df).collect()} == want
    some = [a for a in want if rnd.random() < 0.3] + ["p", "s", "t", "nowhere", None]
    got = g.downstream_counts(df, spark.createDataFrame([(a,) for a in some], "node string"))
    assert {r.task_id: r.downstream_task_count for r in got.collect()} == {a: want[a] for a in some if a in want}


def test_sketches_only_where_asked_for(spark):
    got = {r.label: r.downstream_task_count for r in g.graph_impact(wide(spark), log_k=8).collect()}
    assert got["c0"] == 1 and got["top"] != BELOW["top"] and abs(got["top"] / BELOW["top"] - 1) < 4 / 16


def test_numbers_of_tasks_are_not_broadcast(spark, monkeypatch):
    inventory = wide(spark)
    plans = _plans_of_jobs(monkeypatch, inventory)
    assert g.downstream_counts(g.task_edges(inventory)).where("downstream_task_count > 4096").count() == 2
    assert plans and not [p for p in plans if "Broadcast" in p]
