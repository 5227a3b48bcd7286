"""Task and procedure runs with their credits (TSK-7, 8, 10, 11, 13).

Runs meet the statements that they started by query id. Statements are reduced
to one row an id first, on the key of the join, so both share one shuffle; runs
without an id carry a key of their own and don't meet in one task. All that
follows is a partial aggregate per task, procedure or graph; the latest run is
``max(struct(...))``, so no window ever holds the runs of a task.

Tasks are told apart by database, schema and name; graph attributes are joined
by name, as task inventories of several schemas share one graph. Null or blank
states count as neither failed nor succeeded, null durations and credits as 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.exprs import col, ladder, rounded
from opslens.functions.timeutil import between_ts, boundaries, lookback, ts_lit
from opslens.operators.cost import SIZE_CREDITS_PER_HOUR
from opslens.operators.tasks import PROC_RE, TASK_KEY, recovery_sla

# Run states, and texts that stand for no text.
FAILED_STATES = ["FAILED", "FAILED_WITH_ERROR"]
SUCCESS_STATES = ["SUCCEEDED", "SUCCESS", "COMPLETED"]
NO_TEXT = ["", "NONE", "NULL", "NAN"]
# What stands before an object's name in a statement, in the order in which names are listed.
NAME = r'([A-Za-z0-9_.$"]+)'
OBJECT_PATTERNS = [r"\bFROM\s+", r"\bJOIN\s+", r"\bUSING\s+", r"\bINTO\s+", r"\bUPDATE\s+", r"\bMERGE\s+INTO\s+", r"\bDELETE\s+FROM\s+",
                   r"\bTRUNCATE\s+TABLE\s+", r"\bCREATE(?:\s+OR\s+REPLACE)?\s+(?:TRANSIENT\s+|TEMP(?:ORARY)?\s+)?TABLE\s+", r"\bCALL\s+"]
NOT_OBJECTS = ["SELECT", "TABLE", "VALUES"]
# Signals of a run, with their incident priority where fewer than three tasks run
# downstream, the one from three on, and what blocks the close.
FAILED, SLOW, COST, SUSPENDED, OPEN, LATE = ("Failed Task Run", "Long Running / SLA Risk", "Cost Drift / Release Regression",
                                             "Suspended Task", "Open Recovery SLA", "Recovery SLA Breach")
PRIORITY = {OPEN: ("P2 - Open Recovery", "P1 - Open Graph Recovery"), LATE: ("P3 - Late Recovery", "P2 - Late Graph Recovery"),
            FAILED: ("P2 - Production Risk", "P1 - Graph Incident"),
            SLOW: ("P3 - Performance Regression", "P3 - Performance Regression"),
            COST: ("P3 - Performance Regression", "P3 - Performance Regression")}
READINESS = {OPEN: "Blocked - verify successful recovery run first", LATE: "Blocked - attach late recovery evidence before close",
             FAILED: "Blocked - fix failure root cause first", SUSPENDED: "Blocked - owner approval before resume",
             SLOW: "Blocked - tune or capacity-review before next release handoff",
             COST: "Blocked - explain cost driver before accepting baseline"}
PROC_SLOW, PROC_COST = "Procedure Runtime SLA Breach", "Procedure Cost Regression"


def blank(c: str | Column) -> Column:
    """Null, blank or a word for nothing."""
    return F.upper(F.trim(F.coalesce(col(c), F.lit("")))).isin(*NO_TEXT)


def failed_run(state: str | Column = "state", error: str | Column = "error_message") -> Column:
    """A run in a failure state, or with an error text in any state."""
    return F.coalesce(F.upper(col(state)).isin(*FAILED_STATES), F.lit(False)) | ~blank(error)


def estimated_credits(size: str | Column, elapsed_sec: Column, cloud: Column) -> Column:
    """Credits of a run: the size's hourly rate (any case; 1 when unknown) over
    its seconds, and its cloud-service credits."""
    u, rate = F.upper(F.trim(F.coalesce(col(size), F.lit("")))), None
    for name, credits in SIZE_CREDITS_PER_HOUR.items():
        hit = u == name.upper()
        rate = F.when(hit, F.lit(credits)) if rate is None else rate.when(hit, F.lit(credits))
    compute = F.when(elapsed_sec > 0, rate.otherwise(F.lit(1)) * elapsed_sec / 3600.0).otherwise(0.0)
    return rounded(compute + F.coalesce(cloud, F.lit(0.0)), 6)


def object_names(text: str | Column, limit: int = 12) -> Column:
    """SCA-7: the first ``limit`` distinct object names of a statement, by
    pattern and place; an empty list for null or no name."""
    t = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " ")
    names = F.flatten(F.array(*[F.regexp_extract_all(t, F.lit("(?i)" + p + NAME), F.lit(1)) for p in OBJECT_PATTERNS]))
    names = F.filter(F.transform(names, lambda x: F.replace(x, F.lit('"'), F.lit(""))),
                     lambda x: (x != "") & ~F.upper(x).isin(*NOT_OBJECTS))
    return F.slice(F.array_distinct(names), 1, limit)


def _change_pct(now: Column, mean: Column) -> Column:
    return rounded(F.when(mean > 0, (now - mean) / mean * 100).otherwise(0.0), 1)


# ------------------------------------------------------------------ tasks

def costed_runs(tasks: DataFrame, statements: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Runs scheduled in ``[start, end)`` with seconds, failure and the estimated
    credits of the statement each started (0 where it isn't known). Statements
    are read from ``start`` to a day after ``end``, as runs can go on past it."""
    r = (tasks.filter(between_ts("scheduled_time", start, end)).withColumnRenamed("name", "task_name")
         .select(*TASK_KEY, "query_id", "scheduled_time", "completed_time", "state", "error_code", "error_message",
                 F.coalesce(boundaries("SECOND", "scheduled_time", "completed_time"), F.lit(0)).alias("duration_sec"),
                 failed_run().alias("failed"))
         .withColumn("_id", F.coalesce("query_id", F.concat(F.lit("#"), F.xxhash64(*TASK_KEY, "scheduled_time").cast("string")))))
    s = (statements.filter(between_ts("start_time", start, end + timedelta(days=1)) & F.col("query_id").isNotNull())
         .groupBy(F.col("query_id").alias("_id"))
         .agg(F.max(F.struct("total_elapsed_time", "warehouse_size", "credits_used_cloud_services", "query_text")).alias("_s")))
    credits = estimated_credits("_s.warehouse_size", F.col("_s.total_elapsed_time") / 1000.0, F.col("_s.credits_used_cloud_services"))
    return (r.join(s, "_id", "left")
            .select(*r.columns[:-1], F.when(F.col("_s").isNull(), 0.0).otherwise(credits).alias("est_total_credits"),
                    F.col("_s.query_text").alias("query_text")))


def inventory_by_name(inventory: DataFrame) -> DataFrame:
    """One row a task name: the task it hangs below (its first predecessor, or
    itself), the procedure its definition calls, its warehouse and state."""
    p = F.coalesce("predecessors", F.lit(""))
    first = F.element_at(F.split(F.element_at(F.split(F.regexp_replace(p, r"[\[\]'\"\s]", ""), ","), 1), r"\."), -1)
    none = F.upper(F.trim(p)).isin("", "[]", "NONE", "NULL") | (first == "")
    called = F.replace(F.regexp_extract(F.coalesce("definition", F.lit("")), r"(?i)\bCALL\s+" + NAME, 1), F.lit('"'), F.lit(""))
    return (inventory.filter(~blank("task_name"))
            .select("task_name", F.when(none, F.col("task_name")).otherwise(first).alias("root_task_name"),
                    called.alias("procedure_name"), F.coalesce("warehouse_name", F.lit("")).alias("warehouse_name"),
                    F.upper(F.coalesce("state", F.lit(""))).alias("inventory_state"), F.coalesce("definition", F.lit("")).alias("definition"))
            .groupBy("task_name")
            .agg(F.max(F.struct("root_task_name", "procedure_name", "warehouse_name", "inventory_state", "definition")).alias("_i"))
            .select("task_name", "_i.*"))


def _impact_by_name(impact: DataFrame) -> DataFrame:
    """One row a task name of :func:`opslens.operators.graph.graph_impact`: the one with most tasks downstream."""
    return (impact.groupBy(F.col("label").alias("task_name"))
            .agg(F.max(F.struct("downstream_task_count", "graph_role", "blast_radius", "retry_scope")).alias("_g")).select("task_name", "_g.*"))


def run_exceptions(tasks: DataFrame, statements: DataFrame, inventory: DataFrame, impact: DataFrame, as_of: datetime, days: int = 30,
                   target_hours: float = 4.0) -> DataFrame:
    """TSK-7: a row for each signal of a task's latest run: failed; longer than
    1.5 x its mean and 300 s; dearer than 1.5 x its mean and 0.01 credits (High
    from 2 x on); its last failure still open, or recovered late (an open one
    only where no failed row stands for it); and a row for each suspended task of
    the inventory, which has no run's figures.

    ``impact`` is :func:`opslens.operators.graph.graph_impact`. A task missing
    there or in the inventory keeps its row, with no tasks downstream."""
    last = ["scheduled_time", "query_id", "state", "duration_sec", "est_total_credits", "failed", "query_text"]
    g = (costed_runs(tasks, statements, as_of - timedelta(days=days), as_of).groupBy(*TASK_KEY)
         .agg(F.avg("duration_sec").alias("_sec"), F.avg("est_total_credits").alias("_cr"), F.max(F.struct(*last)).alias("_l")))
    rec = recovery_sla(tasks, as_of, days, target_hours).select(*TASK_KEY, "recovery_state", "recovery_hours")
    g = g.join(rec, TASK_KEY, "left")
    sec, cr, mean, dear = F.col("_l.duration_sec"), F.col("_l.est_total_credits"), F.col("_sec"), F.col("_cr")
    open_, late = F.col("recovery_state") == "Open Failure", F.col("recovery_state") == "Recovered Late"

    def signal(cond, name, severity, own=True):
        return F.when(cond, F.struct(F.lit(name).alias("signal"), severity.alias("severity"), F.lit(own).alias("own")))
    signals = F.array_compact(F.array(
        signal(F.col("_l.failed"), FAILED, F.lit("High")),
        signal((mean > 0) & (sec > mean * 1.5) & (sec > 300), SLOW, F.when(sec > mean * 2, "High").otherwise("Medium")),
        signal((dear > 0) & (cr > dear * 1.5) & (cr >= 0.01), COST, F.when(cr > dear * 2, "High").otherwise("Medium")),
        signal(open_ & ~F.col("_l.failed"), OPEN, F.lit("High"), False),
        signal(late, LATE, F.lit("Late"), False)))
    rows = (g.withColumn("_s", F.explode(signals))
            .select(*TASK_KEY, "_s.signal", "_s.severity", F.col("_l.query_id").alias("query_id"), F.col("_l.state").alias("state"),
                    *[F.when(F.col("_s.own"), x).otherwise(0.0).cast("double").alias(n) for n, x in (
                        ("duration_sec", sec), ("avg_duration_sec", rounded(mean, 1)), ("duration_change_pct", _change_pct(sec, mean)),
                        ("est_total_credits", cr), ("avg_est_credits", rounded(dear, 6)), ("cost_change_pct", _change_pct(cr, dear)))],
                    "recovery_state", "recovery_hours", F.col("_l.query_text").alias("_text")))
    inv = inventory_by_name(inventory)
    zeros = [F.lit(0.0).alias(n) for n in rows.columns[7:13]]
    resting = (inventory.filter(F.upper("state") == "SUSPENDED")
               .select("database_name", "schema_name", "task_name", F.lit(SUSPENDED).alias("signal"), F.lit("Medium").alias("severity"),
                       F.lit("").alias("query_id"), "state", *zeros, F.lit(None).cast("string").alias("recovery_state"),
                       F.lit(None).cast("double").alias("recovery_hours"), F.lit("").alias("_text")))
    j = (rows.unionByName(resting).join(inv.select("task_name", "root_task_name", "procedure_name", "definition"), "task_name", "left")
         .join(_impact_by_name(impact), "task_name", "left"))
    down = F.coalesce("downstream_task_count", F.lit(0)).cast("bigint")
    role = F.coalesce("graph_role", F.lit("Unknown"))
    prio = F.when((F.col("signal") == SUSPENDED) & ((down >= 1) | (role == "Root")), "P2 - Production Risk")
    ready = None
    for name, (few, many) in PRIORITY.items():
        prio = prio.when((F.col("signal") == name) & (down >= 3), many).when(F.col("signal") == name, few)
    for name, label in READINESS.items():
        ready = F.when(F.col("signal") == name, label) if ready is None else ready.when(F.col("signal") == name, label)
    severity = F.when(F.col("severity") != "Late", F.col("severity")).when(down >= 3, "High").otherwise("Medium")
    objects = F.slice(F.array_distinct(F.concat(object_names("definition"), object_names("_text"))), 1, 12)
    return j.select(*TASK_KEY, "signal", severity.alias("severity"), "query_id", "state", *rows.columns[7:13],
                    "recovery_state", "recovery_hours", F.coalesce("root_task_name", F.lit("")).alias("root_task_name"),
                    F.coalesce("procedure_name", F.lit("")).alias("procedure_name"), F.concat_ws(", ", objects).alias("impact_objects"),
                    down.alias("downstream_task_count"), role.alias("graph_role"), F.coalesce("blast_radius", F.lit("Unknown")).alias("blast_radius"),
                    F.coalesce("retry_scope", F.lit("Targeted task retry")).alias("retry_scope"),
                    prio.otherwise("P4 - Review").alias("incident_priority"), ready.alias("recovery_readiness"))


def first_names(df: DataFrame, keys: Sequence[str], value: str, n: int = 5) -> DataFrame:
    """The first ``n`` distinct non-blank values of a group in order, comma-joined.
    The rank limit is applied before the shuffle too, so a group of any size
    reaches its task as ``n`` rows of each map task."""
    w = Window.partitionBy(*keys).orderBy(value)
    d = (df.filter(F.trim(value) != "").select(*keys, value).distinct()
         .withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n))
    return d.groupBy(*keys).agg(F.concat_ws(", ", F.array_sort(F.collect_list(value))).alias(value))


def critical_paths(tasks: DataFrame, inventory: DataFrame, impact: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """TSK-8: for each root of the inventory: tasks, suspended ones, most tasks
    downstream, first five warehouses and procedures; runs, failures, successes,
    last run and longest run of its tasks; score ``12 failures + 10 suspended + 5
    downstream + longest / 300 s (at most 20)`` and state.

    A task's root is its first predecessor, or itself. A root without a run in
    the window has zeros and no last run. Runs are reduced per task before they
    meet the inventory."""
    inv = inventory_by_name(inventory)
    name = F.col("name")
    runs = tasks.filter(between_ts("scheduled_time", as_of - timedelta(days=days), as_of) & ~blank("name"))
    per_task = runs.groupBy(name.alias("task_name")).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(failed_run()).alias("failures"),
        F.count_if(F.coalesce(F.upper("state").isin(*SUCCESS_STATES), F.lit(False))).alias("successes"),
        F.max(F.coalesce("completed_time", "scheduled_time")).alias("last_run_at"),
        F.max(F.coalesce(boundaries("SECOND", "scheduled_time", "completed_time"), F.lit(0))).alias("max_duration_sec"))
    root = inv.select("task_name", "root_task_name")
    hist = (per_task.join(root, "task_name", "left").groupBy(F.coalesce("root_task_name", "task_name").alias("root_task_name"))
            .agg(F.sum("runs").alias("runs"), F.sum("failures").alias("failures"), F.sum("successes").alias("successes"),
                 F.max("last_run_at").alias("last_run_at"), F.max("max_duration_sec").alias("max_duration_sec")))
    j = inv.join(_impact_by_name(impact).select("task_name", "downstream_task_count"), "task_name", "left")
    graph = j.groupBy("root_task_name").agg(
        F.count(F.lit(1)).alias("task_count"), F.count_if(F.col("inventory_state") == "SUSPENDED").alias("suspended_tasks"),
        F.coalesce(F.max("downstream_task_count"), F.lit(0)).cast("bigint").alias("downstream_task_count"))
    out = (graph.join(hist, "root_task_name", "left")
           .join(first_names(inv, ["root_task_name"], "warehouse_name"), "root_task_name", "left")
           .join(first_names(inv, ["root_task_name"], "procedure_name"), "root_task_name", "left"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("runs", "failures", "successes", "max_duration_sec")}
    down, susp = F.col("downstream_task_count"), F.col("suspended_tasks")
    score = rounded(zero["failures"] * 12 + susp * 10 + down * 5 + F.least(zero["max_duration_sec"] / 300.0, F.lit(20.0)), 1)
    state = (F.when((zero["failures"] > 0) | (susp > 0), "Incident Path")
             .when((down >= 3) | (zero["max_duration_sec"] >= 900), "Watch Path").otherwise("Stable Path"))
    return out.select("root_task_name", "task_count", "suspended_tasks", "downstream_task_count",
                      ladder(down, [(5, "High"), (1, "Medium")], "Local").alias("blast_radius"),
                      F.coalesce("warehouse_name", F.lit("")).alias("warehouses"), F.coalesce("procedure_name", F.lit("")).alias("procedures"),
                      *[v.alias(k) for k, v in zero.items()], "last_run_at", score.alias("critical_path_score"), state.alias("critical_path_state"))


# ------------------------------------------------------------------ procedures

def _procedure_runs(q: DataFrame) -> DataFrame:
    calls = q.filter((F.col("query_type") == "CALL") & F.col("query_id").isNotNull()).select(
        F.col("query_id").alias("root_query_id"), F.trim(F.regexp_extract("query_text", PROC_RE, 1)).alias("procedure_name"),
        "database_name", "schema_name", "user_name", "role_name", "warehouse_name", F.col("warehouse_size").alias("_size"), "start_time")
    kids = (q.select(F.coalesce("root_query_id", "query_id").alias("root_query_id"), "query_id", "total_elapsed_time",
                     "credits_used_cloud_services", "warehouse_size", "execution_status")
            .filter(F.col("root_query_id").isNotNull()).groupBy("root_query_id")
            .agg(F.count("query_id").alias("_n"), F.sum(F.coalesce("total_elapsed_time", F.lit(0))).alias("_ms"),
                 F.sum(F.coalesce("credits_used_cloud_services", F.lit(0.0))).alias("_cloud"), F.max("warehouse_size").alias("_kid_size"),
                 F.count_if(F.col("execution_status") != "SUCCESS").alias("_failed")))
    j = calls.join(kids, "root_query_id", "left")
    sec, cloud = F.coalesce("_ms", F.lit(0)) / 1000.0, F.coalesce("_cloud", F.lit(0.0))
    size = F.coalesce("_kid_size", "_size")
    return j.select("root_query_id", "procedure_name", "database_name", "schema_name", "user_name", "role_name", "warehouse_name",
                    size.alias("warehouse_size"), "start_time", F.coalesce("_n", F.lit(0)).alias("downstream_query_count"),
                    sec.alias("total_elapsed_sec"), rounded(cloud, 6).alias("cloud_credits"),
                    estimated_credits(size, sec, cloud).alias("est_total_credits"), (F.coalesce("_failed", F.lit(0)) > 0).alias("failed"))


def procedure_runs(queries: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """TSK-10 / JOI-17: each CALL with the statements under it, itself included
    (they share its id as root): how many, their seconds, cloud-service and
    estimated credits, the largest size name they ran on, and whether any failed.

    Statements are summed per root before they meet the calls, so a call with
    very many of them is as light as any other."""
    return _procedure_runs(queries.filter(lookback("start_time", as_of, days)))


def _scope_key() -> Column:
    """Database, schema and bare procedure name in upper case; parts that the
    statement's context lacks are taken from the called name."""
    name = F.trim(F.element_at(F.split(F.replace(F.coalesce("procedure_name", F.lit("")), F.lit('"'), F.lit("")), r"\("), 1))
    parts = F.filter(F.transform(F.split(F.upper(name), r"\."), lambda x: F.trim(x)), lambda x: x != "")

    def part(context, back):
        own = F.upper(F.trim(F.replace(F.coalesce(context, F.lit("")), F.lit('"'), F.lit(""))))
        return F.when(own != "", own).when(F.size(parts) >= back, F.element_at(parts, -back))
    return F.concat_ws(".", part("database_name", 3), part("schema_name", 2), F.when(F.size(parts) >= 1, F.element_at(parts, -1)))


def procedure_exceptions(runs: DataFrame) -> DataFrame:
    """TSK-11: the latest run of each procedure (by database, schema and name)
    against its mean over :func:`procedure_runs`: a row for a runtime over 1.5 x
    the mean and 300 s, and one for credits over 1.5 x the mean and 0.01 (High
    from 2 x on). Runs of one time go by their id."""
    last = ["start_time", "root_query_id", "total_elapsed_sec", "est_total_credits", "warehouse_name", "warehouse_size", "downstream_query_count"]
    g = runs.groupBy(_scope_key().alias("procedure_key")).agg(
        F.count(F.lit(1)).alias("runs"), F.avg("total_elapsed_sec").alias("_sec"), F.avg("est_total_credits").alias("_cr"),
        F.max(F.struct(*last)).alias("_l"))
    sec, cr, mean, dear = F.col("_l.total_elapsed_sec"), F.col("_l.est_total_credits"), F.col("_sec"), F.col("_cr")

    def signal(now, avg, floor, name):
        return F.when((avg > 0) & (now > avg * 1.5) & floor, F.struct(
            F.lit(name).alias("signal"), F.when(now > avg * 2, "High").otherwise("Medium").alias("severity")))
    found = F.array_compact(F.array(signal(sec, mean, sec > 300, PROC_SLOW), signal(cr, dear, cr >= 0.01, PROC_COST)))
    return (g.withColumn("_s", F.explode(found))
            .select("procedure_key", "_s.signal", "_s.severity", "runs", F.col("_l.root_query_id").alias("root_query_id"),
                    F.col("_l.start_time").alias("latest_call_at"), F.col("_l.warehouse_name").alias("warehouse_name"),
                    F.col("_l.warehouse_size").alias("warehouse_size"), sec.alias("latest_elapsed_sec"), rounded(mean, 3).alias("avg_elapsed_sec"),
                    _change_pct(sec, mean).alias("runtime_change_pct"), cr.alias("est_total_credits"),
                    rounded(dear, 6).alias("avg_est_credits"), _change_pct(cr, dear).alias("cost_change_pct"),
                    F.col("_l.downstream_query_count").alias("downstream_query_count")))


def procedure_summary(runs: DataFrame) -> DataFrame:
    """TSK-11 counters: runs, procedures, runtime and cost breaches (one row, zeros for none)."""
    a = runs.agg(F.count(F.lit(1)).alias("runs"), F.countDistinct(_scope_key()).alias("procedures"))
    b = procedure_exceptions(runs).agg(F.count_if(F.col("signal") == PROC_SLOW).alias("sla_breaches"),
                                       F.count_if(F.col("signal") == PROC_COST).alias("cost_breaches"))
    return a.crossJoin(F.broadcast(b))


# ------------------------------------------------------------------ releases

def compare_release(runs: DataFrame, entity: Sequence[str], time: str, release_at: datetime, runtime_pct: float = 25, runtime_sec: float = 30,
                    credit_pct: float = 25, credit_delta: float = 0) -> DataFrame:
    """TSK-13: before and after a release, for each entity of ``runs`` (columns
    ``duration_sec``, ``est_total_credits``, ``failed``): runs, failures, mean,
    95th percentile and longest seconds, credits, their differences, and a
    severity and signal for more failures, a mean or credits beyond the limits.

    One scan with conditional aggregates; a side without runs counts as zeros,
    so a new entity has a change of 100 %."""
    after = F.col(time) >= ts_lit(release_at)
    aggs = []
    for side, flag in (("before", ~after), ("after", after)):
        sec, cr = F.when(flag, F.col("duration_sec")), F.when(flag, F.col("est_total_credits"))
        aggs += [F.count_if(flag).alias(f"runs_{side}"), F.count_if(flag & F.col("failed")).alias(f"failures_{side}"),
                 F.coalesce(F.avg(sec), F.lit(0.0)).alias(f"avg_sec_{side}"), F.coalesce(F.percentile(sec, F.lit(0.95)), F.lit(0.0)).alias(f"p95_sec_{side}"),
                 F.coalesce(F.max(sec), F.lit(0)).cast("double").alias(f"max_sec_{side}"), F.coalesce(F.sum(cr), F.lit(0.0)).alias(f"credits_{side}")]
    g = runs.groupBy(*entity).agg(*aggs)

    def pct(m):
        b, a = F.col(f"{m}_before"), F.col(f"{m}_after")
        return F.when(b == 0, F.when(a > 0, 100.0).otherwise(0.0)).otherwise(rounded((a - b) / b * 100, 1))
    fails = F.col("failures_after") - F.col("failures_before")
    slower, dearer = F.col("avg_sec_after") - F.col("avg_sec_before"), F.col("credits_after") - F.col("credits_before")
    slow = (pct("avg_sec") >= runtime_pct) & (slower >= runtime_sec)
    dear = (pct("credits") >= credit_pct) & (dearer > credit_delta + 5e-7)  # sums of doubles: no difference below their digits
    severity = (F.when(~((fails > 0) | slow | dear), "Stable")
                .when((fails > 0) | (pct("avg_sec") >= runtime_pct * 2) | (pct("credits") >= credit_pct * 2), "High").otherwise("Medium"))
    text = F.concat_ws("; ", F.when(fails > 0, F.concat(fails.cast("string"), F.lit(" more failures"))),
                       F.when(slow, F.concat(F.lit("runtime +"), pct("avg_sec").cast("decimal(20,1)").cast("string"), F.lit("%"))),
                       F.when(dear, F.concat(F.lit("credits +"), pct("credits").cast("decimal(20,1)").cast("string"), F.lit("%"))))
    sides = [c for c in g.columns if c not in entity]
    shown = [rounded(c, 6 if c.startswith("credits") else 1).alias(c) if c.startswith(("avg", "p95", "credits")) else F.col(c) for c in sides]
    return g.select(*entity, *shown, fails.alias("failures_delta"), rounded(slower, 1).alias("avg_sec_delta"), pct("avg_sec").alias("avg_sec_change_pct"),
                    rounded(dearer, 6).alias("credits_delta"), pct("credits").alias("credits_change_pct"), severity.alias("severity"), text.alias("signal"))


def task_release_comparison(tasks: DataFrame, statements: DataFrame, release_at: datetime, days: int = 7, **limits) -> DataFrame:
    """TSK-13 for tasks: ``days`` before a release and as many after it. A run
    with an error code counts as failed too."""
    lo, hi = release_at - timedelta(days=days), release_at + timedelta(days=days)
    failed = F.coalesce(F.upper("state").isin(*FAILED_STATES), F.lit(False)) | (F.trim(F.coalesce("error_code", F.lit(""))) != "")
    return compare_release(costed_runs(tasks, statements, lo, hi).withColumn("failed", failed), TASK_KEY, "scheduled_time", release_at, **limits)


def procedure_release_comparison(queries: DataFrame, release_at: datetime, days: int = 7, **limits) -> DataFrame:
    """TSK-13 for procedures, over the runs of :func:`procedure_runs` around the release."""
    q = queries.filter(between_ts("start_time", release_at - timedelta(days=days), release_at + timedelta(days=days)))
    r = _procedure_runs(q).withColumnRenamed("total_elapsed_sec", "duration_sec").filter(F.trim("procedure_name") != "")
    return compare_release(r, ["procedure_name"], "start_time", release_at, **limits)
