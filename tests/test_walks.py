"""Graph walks and alert triage: cycles, several hops a job, several rules a type."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from opslens.operators import alert_routing as ar
from opslens.operators import capacity, graph as g


def plain(edges):
    down = {}
    for a in {x for e in edges for x in e}:
        seen, stack = set(), [t for s, t in edges if s == a]
        while stack:
            n = stack.pop()
            if n not in seen:
                seen.add(n)
                stack += [t for s, t in edges if s == n]
        down[a] = len(seen)
    return down


@pytest.mark.parametrize("hops", [1, 2, 5])
def test_downstream_counts_with_cycles_and_long_chains(spark, monkeypatch, hops):
    monkeypatch.setattr(g, "HOPS", hops)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(13)] + [("n2", "n9"), ("n4", "x"), ("x", "y"), ("y", "n4"), ("z", "z"), ("a", "n0"), ("a", "z")]
    df = spark.createDataFrame(edges, "source string, target string")
    want = plain(edges)
    nodes = spark.createDataFrame([(n,) for n in want], "node string")
    got = {r.task_id: r.downstream_task_count for r in g.downstream_counts(df, nodes).collect()}
    assert got == {n: c for n, c in want.items() if c}
    some = g.downstream_counts(df, nodes.where("node IN ('n4', 'a')"))
    assert {r.task_id: r.downstream_task_count for r in some.collect()} == {"n4": want["n4"], "a": want["a"]}
    depth = {r.node: r.depth for r in g._bfs(nodes.where("node = 'n0'"), df).collect()}
    assert depth["n9"] == 3 and depth["n13"] == 7 and depth["y"] == 6 and len(depth) == 16


@pytest.mark.parametrize("hops", [1, 5])
def test_sketches_of_small_graphs_are_exact(spark, monkeypatch, hops):
    monkeypatch.setattr(g, "HOPS", hops)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(13)] + [("n2", "n9"), ("n4", "x"), ("x", "y"), ("y", "n4"), ("z", "z"), ("a", "n0"), ("a", "z"), ("a", "z")]
    df = spark.createDataFrame([*edges, (None, "n1"), ("n1", None)], "source string, target string")
    got = {r.node: (r.downstream_task_count, r.is_exact) for r in g.downstream_sketches(df).collect()}
    assert got == {n: (c, True) for n, c in plain(edges).items() if c}
    assert g.downstream_sketches(df.limit(0)).count() == 0


def test_sketches_of_large_sets_stay_within_their_error(spark):
    # a hot task with 3000 children, each with 3 of 6000 shared grandchildren, behind a chain and back to its start
    edges = [("hot", f"c{i}") for i in range(3000)] + [(f"c{i}", f"g{(i * k) % 6000}") for i in range(3000) for k in (1, 7, 11)]
    edges += [("r0", "r1"), ("r1", "hot"), ("g5999", "r0"), ("g77", "r0")]
    got = {r.node: r for r in g.downstream_sketches(spark.createDataFrame(edges, "source string, target string"), log_k=10).collect()}
    want = plain([e for e in edges])
    for n in ("hot", "r0", "r1"):
        assert not got[n].is_exact and abs(got[n].downstream_task_count / want[n] - 1) < 4 / 32
    small = [n for n, c in want.items() if 0 < c <= 1024]
    assert small and all(got[n].is_exact and got[n].downstream_task_count == want[n] for n in small)


def test_two_active_rules_of_a_type_give_an_alert_once(spark):
    as_of = datetime(2024, 1, 31)
    alerts = spark.createDataFrame([(1, datetime(2024, 1, 30), "E", "cost_spike", "High", "New", None), (2, datetime(2024, 1, 30), "E", None, None, None, None)],
                                   "alert_id long, created_at timestamp_ntz, entity string, alert_type string, severity string, status string, owner string")
    rules = spark.createDataFrame([("COST_SPIKE", "Two", "r2", "b2", 9, True), ("Cost_Spike", "One", "r1", "b1", 6, True), ("COST_SPIKE", "Off", "r0", "b0", 1, False),
                                   (None, "Nobody", None, None, None, True)], ar.RULES)
    got = {r.alert_id: r for r in ar.routed_triage(alerts, rules, spark.createDataFrame([], ar.DIRECTORY), as_of).collect()}
    assert len(got) == 2 and got[1].routed_owner == "One" and got[1].sla_target_hours == 6 and got[2].routed_owner == "DBA"


def test_no_exhaustion_beyond_a_year(spark):
    from opslens.operators.forecast import capacity_exhaustion

    df = spark.createDataFrame([(1.0, 50.0, 100.0), (2.0, 50.0, 100.0)], "g double, c double, k double")
    weeks = capacity_exhaustion(F.col("g"), F.col("c"), F.col("k"), max_weeks=52)[0]
    assert [r[0] for r in df.select(weeks).collect()] == [None, 36]
    assert capacity.capacity_outlook.__doc__


def _plans_of_jobs(monkeypatch, df):
    """The final plans of what is checkpointed from now on."""
    plans, kind = [], type(df)
    run = kind.checkpoint

    def checkpoint(self, *args, **kwargs):
        done = run(self, *args, **kwargs)
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return done

    monkeypatch.setattr(kind, "checkpoint", checkpoint)
    return plans


CHAIN = [("DB", "S", f"T{i}", "started", f'["T{i - 1}"]' if i else "[]") for i in range(9)]
TASKS = "database_name string, schema_name string, task_name string, state string, predecessors string"


@pytest.mark.parametrize("query", ["blast_radius", "graph_members"])
def test_walks_broadcast_neither_nodes_nor_edges(spark, monkeypatch, query):
    tg = spark.createDataFrame(CHAIN, TASKS)
    plans = _plans_of_jobs(monkeypatch, tg)
    rows = getattr(g, query)(tg, "DB.S.T1").collect()
    assert rows[0].downstream_count == 7 if query == "blast_radius" else {r.task_id: r.depth for r in rows} == {f"DB.S.T{i + 1}": i for i in range(8)}
    assert plans and not [p for p in plans if "Broadcast" in p]


def test_a_job_of_a_walk_makes_one_step_once(spark, monkeypatch):
    tg = spark.createDataFrame(CHAIN, TASKS)
    plans = _plans_of_jobs(monkeypatch, tg)
    got = g.graph_impact(tg, spark.createDataFrame([("T0",), ("T6",), ("T8",)], "label string"))
    assert {r.label: r.downstream_task_count for r in got.collect()} == {"T0": 8, "T6": 2, "T8": 0}
    # the step itself and the visited that it leaves out; the plan before it ran follows at the margin
    assert plans[1:] and max(p.split("\n+- == Initial Plan ==")[0].count("Join ") for p in plans[1:]) <= 2


def test_seeds_above_the_same_tasks_share_rows(spark, monkeypatch):
    edges = [(f"s{i}", "c0") for i in range(70)] + [(f"c{i}", f"c{i + 1}") for i in range(5)] + [("s3", "s4"), ("c5", "c1")]
    df = spark.createDataFrame(edges, "source string, target string")
    seeds = spark.createDataFrame([(f"s{i}",) for i in range(70)] + [("c1",), (None,), ("s3",)], "node string").coalesce(1)
    kind, rows = type(df), []
    run = kind.checkpoint

    def checkpoint(self, *args, **kwargs):
        done = run(self, *args, **kwargs)
        rows.append((done.columns, done.count()))
        return done

    monkeypatch.setattr(kind, "checkpoint", checkpoint)
    got = {r.task_id: r.downstream_task_count for r in g.downstream_counts(df, seeds).collect()}
    want = plain(edges)
    assert got == {n: want[n] for n in [f"s{i}" for i in range(70)] + ["c1"]}
    # a step's rows are nodes (of two packs), not pairs of a seed and a node
    steps = [n for columns, n in rows if "node" in columns]
    assert steps and max(steps) < 70
