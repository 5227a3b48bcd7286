"""Dependency graphs (GRF-*): task DAGs from predecessor arrays and object
dependency edge lists.

Reachability is computed breadth-first as a loop of DataFrame joins: each job
joins the frontier to the edge list, anti-joins what was already visited and
stops when it met nothing new: there is no depth cap, and as visited nodes never
return, cycles end too. The driver only issues the joins and one ``isEmpty``
per job.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions.exprs import page
from opslens.session import ensure_checkpoint_dir

CHECKPOINT_EVERY = 4
HOPS = 5  # rounds of sketches in one job
PACK = 64  # seeds that share a row's mask, one bit of a long each
TALLY_EVERY = 16  # steps whose rows are summed at once
ONE, SEVERAL, END = range(3)  # kinds of tasks in a walk from many seeds
SKETCH_LOG_K = 12  # sets of downstream tasks are exact up to 2 ** this many


def task_edges(task_graph: DataFrame) -> DataFrame:
    """GRF-1: one row per (source predecessor -> target task) from the JSON
    predecessor array; bare names are qualified with the task's db.schema."""
    t = task_graph.select(
        F.concat_ws(".", "database_name", "schema_name", "task_name").alias("task_id"),
        "database_name", "schema_name",
        F.explode_outer(F.from_json(F.when(F.trim("predecessors").startswith("["), F.col("predecessors")),
                                    "array<string>")).alias("pred"))
    p = F.trim("pred")
    src = F.when(p.contains("."), p).otherwise(F.concat_ws(".", "database_name", "schema_name", p))
    return t.filter(p.isNotNull() & (p != "")).select(src.alias("source"), F.col("task_id").alias("target")).distinct()


def task_nodes(task_graph: DataFrame) -> DataFrame:
    """GRF-1: every task with label, state, predecessor count and its
    root / leaf flags (root = no predecessor, leaf = nobody depends on it)."""
    nodes = task_graph.select(F.concat_ws(".", "database_name", "schema_name", "task_name").alias("task_id"),
                              F.col("task_name").alias("label"), "state").distinct()
    e = task_edges(task_graph)
    indeg = e.groupBy(F.col("target").alias("task_id")).agg(F.count(F.lit(1)).alias("predecessor_count"))
    outdeg = e.groupBy(F.col("source").alias("task_id")).agg(F.count(F.lit(1)).alias("dependent_count"))
    j = nodes.join(indeg, "task_id", "left").join(outdeg, "task_id", "left")
    pc, dc = F.coalesce("predecessor_count", F.lit(0)), F.coalesce("dependent_count", F.lit(0))
    return j.select("task_id", "label", "state", pc.alias("predecessor_count"), dc.alias("dependent_count"),
                    (pc == 0).alias("is_root"), (dc == 0).alias("is_leaf"))


def _dealt(edges: DataFrame, *more: str) -> DataFrame:
    """The edges, dealt and sorted by source once, for all steps of a walk."""
    return edges.select("source", "target", *more).repartition("source").sortWithinPartitions("source").persist(StorageLevel.MEMORY_AND_DISK)


def _walk(seeds: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Minimum hop count of every (``keys``..., node) over ``source -> target``
    edges, seeds at depth 0.

    One job a step: what is met for the first time is written once to the cluster
    checkpoint directory (which keeps plans short and survives a lost executor) and
    is all that the next step expands; the union of the visited is checkpointed
    every few steps. The frontier, the edges and the visited all grow with the
    graph, so their joins are sort-merge joins: none of the three ever goes through
    the driver as a broadcast."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = _dealt(edges)
    at = [*keys, "node"]
    visited = frontier = seeds.select(*at).distinct().withColumn("depth", F.lit(0)).checkpoint()
    for d in count(1):
        step = frontier.hint("merge").join(e, frontier["node"] == e["source"]).select(*keys, F.col("target").alias("node")).distinct()
        frontier = step.hint("merge").join(visited.select(*at), at, "left_anti").withColumn("depth", F.lit(d)).checkpoint()
        if frontier.isEmpty():
            e.unpersist()
            return visited
        visited = visited.unionByName(frontier)
        if d % CHECKPOINT_EVERY == 0:
            visited = visited.checkpoint()


def _bfs(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Minimum hop count from any seed (``node``): ``node, depth``."""
    return _walk(seeds, edges, [])


def _numbered(edges: DataFrame, seeds: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Numbers in place of names for the walk of :func:`downstream_counts`: the
    edges (source, target, kind and leaves of the target) and the seeds with a
    task below (anc, node, leaves); ``node`` is from 0 on for seeds, below 0 for others.

    A task with one predecessor and nothing below it has no number: it is one of
    the ``leaves`` of its predecessor, and met whenever that one is. The rest are
    of kind :data:`ONE` (predecessor), :data:`SEVERAL` or :data:`END` (several, and
    nothing below)."""
    pairs = edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    asked = pairs.select(F.col("source").alias("anc")) if seeds is None else seeds.select(F.col("node").alias("anc")).where("anc IS NOT NULL")
    # numbered within each partition, so no task sorts all seeds; the checkpoint fixes the numbers
    number = asked.distinct().withColumn("_n", F.monotonically_increasing_id()).checkpoint()
    ends = (pairs.select(F.col("target").alias("task"), F.col("source").alias("pred"))
            .unionByName(pairs.select(F.col("source").alias("task"), F.lit(None).cast("string").alias("pred")))
            .groupBy("task").agg(F.count("pred").alias("preds"), F.min("pred").alias("pred"), F.bool_or(F.col("pred").isNull()).alias("inner")))
    leaf = ~F.col("inner") & (F.col("preds") == 1)
    leaves = ends.where(leaf).groupBy(F.col("pred").alias("task")).agg(F.count(F.lit(1)).alias("leaves"))
    tasks = (ends.where(~leaf).hint("merge").join(leaves, "task", "left").hint("merge").join(number.withColumnRenamed("anc", "task"), "task", "left")
             .select("task", F.coalesce("_n", -1 - F.monotonically_increasing_id()).alias("n"), F.coalesce("leaves", F.lit(0)).alias("leaves"),
                     F.when(~F.col("inner"), END).when(F.col("preds") > 1, SEVERAL).otherwise(ONE).alias("kind")).checkpoint())
    above = tasks.select(F.col("task").alias("source"), F.col("n").alias("s"))
    below = tasks.select(F.col("task").alias("target"), F.col("n").alias("t"), "kind", "leaves")
    e = (pairs.hint("merge").join(above, "source").hint("merge").join(below, "target")
         .select(F.col("s").alias("source"), F.col("t").alias("target"), "kind", "leaves").checkpoint())
    pairs.unpersist()
    return e, tasks.where((F.col("n") >= 0) & (F.col("kind") != END)).select(F.col("task").alias("anc"), F.col("n").alias("node"), "leaves")


def _by_seed(tally: list[DataFrame]) -> DataFrame:
    """Rows of a pack, a mask and a weight, summed to a row for each seed (a mask of its bit)."""
    rows = reduce(DataFrame.unionByName, tally).groupBy("pack", "mask").agg(F.sum("weight").alias("weight"))
    sums = rows.groupBy("pack").agg(*[F.sum(F.getbit("mask", F.lit(b)) * F.col("weight")).alias(f"_{b}") for b in range(PACK)])
    return (sums.select("pack", F.posexplode(F.array(*[f"_{b}" for b in range(PACK)])).alias("_bit", "weight")).where("weight > 0")
            .select("pack", F.expr("shiftleft(1L, _bit)").alias("mask"), "weight"))


def downstream_counts(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """How many tasks run downstream of each seed (column ``node``; without seeds,
    of each task with a dependent), itself not counted unless a cycle leads back
    to it. Exact, and kept for the seeds only.

    The walk of :func:`_walk` from all seeds at once. A row is a task and a mask
    with a bit for each of up to 64 seeds (a pack) that reach it, so seeds that
    lie above the same tasks share their rows. A step hands on only the bits that
    a task had not got before. A task with one predecessor gets a bit once, from
    that one, so only tasks with several meet what they had got, in the step's one
    aggregate; those with nothing below meet it once, after the last step. A seed
    that a cycle leads back to is counted and hands its own bit on no more."""
    ensure_checkpoint_dir(edges.sparkSession)
    numbered, first = _numbered(edges, seeds)
    e = _dealt(numbered, "kind", "leaves")
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    pack, own = F.expr(f"node div {PACK}"), F.expr(f"shiftleft(1L, CAST(node % {PACK} AS INT))")
    back = F.when((F.col("node") >= 0) & (pack == F.col("pack")), F.col("mask").bitwiseAND(own)).otherwise(none)
    frontier = first.select(pack.alias("pack"), "node", own.alias("mask"))
    tally = [first.select(pack.alias("pack"), own.alias("mask"), F.col("leaves").alias("weight"))]
    had = shut = None
    for d in count(1):
        met = (frontier.select("pack", "node", "mask").hint("merge").join(e, F.col("node") == e["source"])
               .select("pack", F.col("target").alias("node"), "mask", none.alias("old"), "kind", "leaves"))
        if had is not None:
            met = met.unionByName(had.select("pack", "node", none.alias("mask"), F.col("mask").alias("old"), "kind", "leaves"))
        fresh = F.col("mask").bitwiseAND(F.bitwise_not("old"))
        step = (met.groupBy("pack", "node").agg(*[F.bit_or(c).alias(c) for c in ("mask", "old")], *[F.max(c).alias(c) for c in ("kind", "leaves")])
                .select("pack", "node", fresh.alias("mask"), "kind", "leaves").where("mask <> 0").checkpoint())
        if step.isEmpty():
            break
        several, closed = step.where(F.col("kind") == SEVERAL), step.where(F.col("kind") == END).select("pack", "node", "mask")
        had, shut = (several, closed) if had is None else (had.unionByName(several), shut.unionByName(closed))
        inner = step.where(F.col("kind") != END)
        frontier = inner.select("pack", "node", F.col("mask").bitwiseXOR(back).alias("mask"), "leaves").where("mask <> 0")
        tally += [frontier.select("pack", "mask", (F.col("leaves") + 1).alias("weight")),
                  inner.select("pack", back.alias("mask"), one.alias("weight")).where("mask <> 0")]
        if d % CHECKPOINT_EVERY == 0:
            had, shut = had.checkpoint(), shut.checkpoint()
        if d % TALLY_EVERY == 0:
            tally = [_by_seed(tally).checkpoint()]
    e.unpersist()
    if shut is not None:
        tally.append(shut.groupBy("pack", "node").agg(F.bit_or("mask").alias("mask")).select("pack", "mask", one.alias("weight")))
    names = first.select("anc", pack.alias("pack"), own.alias("mask"))
    return names.hint("merge").join(_by_seed(tally), ["pack", "mask"]).select(F.col("anc").alias("task_id"), F.col("weight").alias("downstream_task_count"))


def downstream_sketches(edges: DataFrame, log_k: int = SKETCH_LOG_K) -> DataFrame:
    """GRF-6: of every node with a dependent, a sketch of the distinct nodes
    downstream of it (itself only over a cycle), the count it stands for and
    whether that is exact: (node, sketch, downstream_task_count, is_exact).

    A node's sketch is the union of its children and of their sketches, taken
    until no sketch grows; unions of what is in already change nothing, so cycles
    end without being looked for, and two paths to a node count it once. There is
    no row for a pair of nodes: a sketch keeps at most ``2 ** log_k`` hashes (some
    32 KB for 12) and merges map-side, so a node with very many children or
    dependents is as light as any other. Up to ``2 ** log_k`` nodes a sketch is
    the set itself and the count exact; beyond, the relative standard error is
    ``1 / sqrt(2 ** log_k)`` (1.6 % for 12)."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    children = e.groupBy(F.col("source").alias("node")).agg(F.theta_sketch_agg("target", log_k).alias("sketch")).checkpoint()
    size = F.theta_sketch_estimate("sketch")
    now, before = children, children.select("node", size.alias("_before"))
    while True:
        for _ in range(HOPS):
            below = e.join(now, e["target"] == now["node"]).select(F.col("source").alias("node"), "sketch")
            now = children.unionByName(below).groupBy("node").agg(F.theta_union_agg("sketch", log_k).alias("sketch"))
        now = now.checkpoint()
        # sketches only grow: one that stands for as many nodes as before is the same
        if now.join(before, "node").where(size > F.col("_before")).isEmpty():
            break
        before = now.select("node", size.alias("_before"))
    e.unpersist()
    return now.select("node", "sketch", size.cast("bigint").alias("downstream_task_count"), (size <= 2 ** log_k).alias("is_exact"))


def dag_summary(task_graph: DataFrame) -> DataFrame:
    """GRF-1 + GRF-2: one row: nodes, edges, roots, leaves and the depth of
    the graph (largest minimum distance from a root)."""
    n = task_nodes(task_graph)
    e = task_edges(task_graph)
    depth = _bfs(n.filter("is_root").select(F.col("task_id").alias("node")), e)
    counts = n.agg(F.count(F.lit(1)).alias("nodes"), F.count_if("is_root").alias("roots"),
                   F.count_if("is_leaf").alias("leaves"))
    return (counts.crossJoin(e.agg(F.count(F.lit(1)).alias("edges")))
            .crossJoin(depth.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))))


def blast_radius(task_graph: DataFrame, failed_task: str) -> DataFrame:
    """GRF-3: downstream tasks of a failed one and the blast-radius label."""
    e = task_edges(task_graph)
    seeds = task_graph.sparkSession.createDataFrame([(failed_task,)], "node string")
    reach = _bfs(seeds, e).filter(F.col("depth") > 0)
    n = reach.agg(F.count(F.lit(1)).alias("downstream_count"))
    lbl = (F.when(F.col("downstream_count") > 10, "Critical").when(F.col("downstream_count") > 5, "High")
           .when(F.col("downstream_count") > 0, "Medium").otherwise("Isolated"))
    return n.select(F.lit(failed_task).alias("failed_task"), "downstream_count", lbl.alias("blast_radius"))


def downstream_objects(deps: DataFrame, name: str, max_depth: int = 5, limit: int | None = None) -> DataFrame:
    """GRF-4 / JOI-13: objects that depend on ``name`` up to ``max_depth``
    levels, one row per (object, depth, depends_on) as in a recursive CTE."""
    e = deps.select(F.upper("referenced_object_name").alias("_ref"), "referencing_object_name",
                    "referencing_object_domain", "referenced_object_name")
    level = (e.filter(F.col("_ref") == name.upper())
             .select("referencing_object_name", "referencing_object_domain", "referenced_object_name",
                     F.lit(1).alias("dependency_depth")))
    out = level
    for d in range(2, max_depth + 1):
        level = (level.select(F.upper("referencing_object_name").alias("_ref")).distinct()
                 .join(e, "_ref")
                 .select("referencing_object_name", "referencing_object_domain", "referenced_object_name",
                         F.lit(d).alias("dependency_depth")))
        out = out.unionByName(level)
    return (out.distinct()
            .select(F.col("referencing_object_name").alias("object_name"),
                    F.col("referencing_object_domain").alias("object_type"), "dependency_depth",
                    F.col("referenced_object_name").alias("depends_on"))
            .transform(page(limit, "dependency_depth", "object_name", "depends_on")))


def direct_dependents(deps: DataFrame, name: str) -> DataFrame:
    """GRF-5: direct neighbours of an object (last part of a 1-3 part name),
    both directions, with the direction tagged."""
    short = name.split(".")[-1].upper()
    down = deps.filter(F.upper("referenced_object_name") == short).select(
        F.lit("dependent").alias("direction"), F.col("referencing_object_name").alias("object_name"),
        F.col("referencing_object_domain").alias("object_type"))
    up = deps.filter(F.upper("referencing_object_name") == short).select(
        F.lit("depends_on").alias("direction"), F.col("referenced_object_name").alias("object_name"),
        F.col("referenced_object_domain").alias("object_type"))
    return down.unionByName(up)


def graph_impact(task_graph: DataFrame, tasks: DataFrame | None = None, log_k: int | None = None) -> DataFrame:
    """GRF-6: for every task, how many tasks run downstream of it (distinct,
    through any path), its role (Root / Intermediate / Leaf), blast radius
    and retry scope. Counts are exact (:func:`downstream_counts`).
    With ``tasks`` (column ``label``), only for the tasks of those labels, and
    reachability is walked from them alone. Only where ``log_k`` is given, counts
    above ``2 ** log_k`` are the estimates of :func:`downstream_sketches`; roles,
    labels and scopes don't depend on them."""
    e, nodes = task_edges(task_graph), task_nodes(task_graph)
    asked = nodes if tasks is None else nodes.join(tasks.select("label").distinct(), "label", "left_semi")
    if log_k is not None:
        cnt = downstream_sketches(e, log_k).select(F.col("node").alias("task_id"), "downstream_task_count")
    else:
        cnt = downstream_counts(e, None if tasks is None else asked.withColumnRenamed("task_id", "node"))
    in_scope = (e.join(nodes.select(F.col("task_id").alias("source")), "source")
                .select(F.col("target").alias("task_id")).distinct().withColumn("_has_pred", F.lit(True)))
    j = asked.join(cnt, "task_id", "left").join(in_scope, "task_id", "left")
    dc = F.coalesce("downstream_task_count", F.lit(0))
    role = (F.when(F.col("_has_pred").isNull(), "Root").when(F.col("dependent_count") == 0, "Leaf")
            .otherwise("Intermediate"))
    return j.select("task_id", "label", "state", dc.alias("downstream_task_count"), role.alias("graph_role"),
                    F.when(dc >= 5, "High").when(dc >= 1, "Medium").otherwise("Local").alias("blast_radius"),
                    F.when(role == "Root", "Root graph retry").otherwise("Targeted task retry").alias("retry_scope"))


def graph_members(task_graph: DataFrame, root_id: str) -> DataFrame:
    """GRF-7: every task reachable from a root, the root included."""
    seeds = task_graph.sparkSession.createDataFrame([(root_id,)], "node string")
    return _bfs(seeds, task_edges(task_graph)).select(F.col("node").alias("task_id"), "depth")


def topology_edges(queries: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """GRF-8: weighted edges warehouse-user, user-role, database-schema (and
    client-warehouse when sessions are given), as one edge list."""
    def edge(df, a, b, kind):
        return (df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
                .groupBy(F.col(a).alias("source"), F.col(b).alias("target"))
                .agg(F.count(F.lit(1)).alias("weight")).withColumn("edge_type", F.lit(kind)))
    out = (edge(queries, "warehouse_name", "user_name", "warehouse-user")
           .unionByName(edge(queries, "user_name", "role_name", "user-role"))
           .unionByName(edge(queries, "database_name", "schema_name", "database-schema")))
    if sessions is not None:
        cw = (sessions.join(queries.select("user_name", "warehouse_name").distinct(), "user_name")
              .groupBy(F.col("client_application_id").alias("source"), F.col("warehouse_name").alias("target"))
              .agg(F.count(F.lit(1)).alias("weight")).withColumn("edge_type", F.lit("client-warehouse")))
        out = out.unionByName(cw)
    return out
