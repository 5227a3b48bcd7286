"""Boards and remaining roll-ups (BRD-*, CST-4/5/15/18..21/27, TSK-12,
SEC-9, GOV-3/5/6/8, CHG-5/6/8, ACT-6/7, REC-5, SCR-2/3, NET-*, ORG-3,
AIC-2/6, TEL-*, SUM-8..11, FCT-3).

A board is a union of per-signal rows with a state per row and a rank; every
input here is already a reduced (grouped) frame or a one-row aggregate, so
unions and sorts act on small results.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.exprs import page, rounded, safe_div, sorted_distinct_list
from opslens.functions.timeutil import between_ts, boundaries, lookback, trunc, ts_lit

GB = 1024.0 ** 3


# ------------------------------------------------------------------ cost boards

def bill_waterfall(delta: DataFrame, top_n: int = 5) -> DataFrame:
    """BRD-1: prior total, the top-n movers by absolute delta, the remainder
    and the current total, as ordered steps."""
    tot = delta.agg(F.sum("prior_credits").alias("p"), F.sum("current_credits").alias("c"))
    movers = (delta.orderBy(F.desc(F.abs("credit_delta")), "warehouse_name").limit(top_n)
              .select(F.col("warehouse_name").alias("step"), F.col("credit_delta").alias("amount")))
    moved = movers.agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("m"))
    first = tot.select(F.lit(0).alias("step_order"), F.lit("Prior period").alias("step"), rounded("p", 4).alias("amount"))
    mid = movers.select(F.lit(1).alias("step_order"), "step", rounded("amount", 4).alias("amount"))
    rest = tot.crossJoin(moved).select(F.lit(2).alias("step_order"), F.lit("All other").alias("step"),
                                       rounded(F.col("c") - F.col("p") - F.col("m"), 4).alias("amount"))
    last = tot.select(F.lit(3).alias("step_order"), F.lit("Current period").alias("step"), rounded("c", 4).alias("amount"))
    return first.unionByName(mid).unionByName(rest).unionByName(last)


def service_pivot(service: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """BRD-2: service credits per category pivoted into CURRENT / PRIOR columns."""
    from opslens.operators.cost import service_category
    a, b = as_of - timedelta(days=days), as_of - timedelta(days=2 * days)
    s = (service.filter(between_ts("start_time", b, as_of))
         .withColumn("period", F.when(F.col("start_time") >= ts_lit(a), "CURRENT").otherwise("PRIOR"))
         .withColumn("service_category", service_category("service_type")))
    p = s.groupBy("service_category").pivot("period", ["CURRENT", "PRIOR"]).agg(F.sum("credits_used"))
    return p.select("service_category", rounded(F.coalesce("CURRENT", F.lit(0.0)), 4).alias("current_credits"),
                    rounded(F.coalesce("PRIOR", F.lit(0.0)), 4).alias("prior_credits"))


def attribution_gaps(recon: DataFrame) -> DataFrame:
    """BRD-4: reconciliation gap totals, one row."""
    return recon.agg(rounded(F.sum("exact_metered_credits"), 4).alias("metered"),
                     rounded(F.sum("allocated_query_credits"), 4).alias("allocated"),
                     rounded(F.sum("variance_credits"), 4).alias("gap"),
                     F.count_if(F.col("reconciliation_status") == "Variance review").alias("days_in_review"),
                     F.count_if(F.col("reconciliation_status") == "Idle or non-query warehouse usage").alias("idle_days"))


def top_driver(df: DataFrame, dim: str, measure: str) -> DataFrame:
    """BRD-5: the top value of a chosen dimension by a measure, with its share."""
    g = df.groupBy(dim).agg(F.sum(measure).alias("_v"))
    return g.agg(F.max_by(dim, F.struct("_v", dim)).alias("top_value"), rounded(F.max("_v"), 4).alias("top_amount"),
                 rounded(F.max("_v") * 100.0 / F.sum("_v"), 1).alias("top_share_pct"), F.count(F.lit(1)).alias("values"))


def cost_trust(pqc: DataFrame) -> DataFrame:
    """BRD-6: per-query cost rows by trust class: exact (official
    attribution), estimated (allocated from metering), not defensible
    (no metered hour)."""
    cls = (F.when(F.col("credit_source") == "QUERY_ATTRIBUTION", "Exact")
           .when(F.col("metered_credits") > 0, "Estimated").otherwise("Not defensible"))
    return pqc.groupBy(cls.alias("trust_class")).agg(F.count(F.lit(1)).alias("queries"),
                                                     rounded(F.sum("metered_credits"), 6).alias("credits"))


def source_health(sources: dict[str, tuple[DataFrame, str]], as_of: datetime, fresh_hours: int = 24,
                  stale_hours: int = 72) -> DataFrame:
    """BRD-9: latest event per source and a freshness gate."""
    parts = []
    for name, (df, ts) in sources.items():
        parts.append(df.filter(F.col(ts) < ts_lit(as_of)).agg(F.max(ts).alias("last_event"), F.count(F.lit(1)).alias("rows"))
                     .withColumn("source", F.lit(name)))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    h = boundaries("HOUR", "last_event", ts_lit(as_of))
    return u.select("source", "rows", "last_event", h.alias("hours_since_last"),
                    F.when(F.col("last_event").isNull(), "Missing").when(h <= fresh_hours, "Fresh")
                    .when(h <= stale_hours, "Stale").otherwise("Blocked").alias("gate"))


def task_failure_timeline(tasks: DataFrame, queries: DataFrame, task_name: str, as_of: datetime, days: int = 30,
                          changes_as_of: datetime | None = None) -> DataFrame:
    """BRD-10: one task's failures, recoveries and nearby change statements in
    event order; ``changes_as_of`` where the statements end at another time."""
    t = tasks.filter((F.col("name") == task_name) & lookback("scheduled_time", as_of, days))
    f = t.select(F.col("scheduled_time").alias("event_time"), F.when(F.col("state") == "FAILED", "failure")
                 .when(F.col("state") == "SUCCEEDED", "run").otherwise("other").alias("event_type"),
                 F.coalesce("error_message", F.col("state")).alias("detail"))
    c = (queries.filter(lookback("start_time", changes_as_of or as_of, days)
                        & F.col("query_type").isin("ALTER_TABLE", "CREATE_TABLE", "DROP_TABLE"))
         .select(F.col("start_time").alias("event_time"), F.lit("change").alias("event_type"),
                 F.substring("query_text", 1, 120).alias("detail")))
    return f.unionByName(c).withColumn("event_order", F.when(F.col("event_type") == "failure", 0)
                                       .when(F.col("event_type") == "change", 1).otherwise(2))


def incident_board(tri: DataFrame) -> DataFrame:
    """BRD-11: open alerts grouped by incident type and route (owner)."""
    o = tri.filter(~F.upper("status").isin("FIXED", "IGNORED", "RESOLVED"))
    return o.groupBy("alert_type", F.col("owner").alias("route")).agg(
        F.count(F.lit(1)).alias("open"), F.count_if(F.col("severity").isin("Critical", "High")).alias("critical_high"),
        F.count_if(F.col("sla_state") == "Overdue").alias("overdue"), F.min("alert_ts").alias("oldest"))


def queue_route_readiness(queue: DataFrame) -> DataFrame:
    """BRD-12: queue closure and readiness per route (severity as route here)."""
    g = queue.groupBy(F.col("severity").alias("route")).agg(
        F.count(F.lit(1)).alias("actions"), F.count_if(F.col("status") == "Fixed").alias("closed"),
        F.count_if((F.col("status") != "Fixed") & (F.col("seen_count") > 1)).alias("recurring_open"))
    pct = rounded(F.col("closed") * 100.0 / F.col("actions"), 1)
    return g.withColumn("closure_pct", pct).withColumn(
        "readiness", F.when(pct >= 80, "Ready").when(pct >= 40, "Partial").otherwise("Backlog"))


def alert_lifecycle(tri: DataFrame, queue: DataFrame) -> DataFrame:
    """BRD-13: alert lifecycle state, and whether the entity has an open queue item."""
    q = (queue.filter(F.col("status") != "Fixed").select(F.upper("entity").alias("_e")).distinct()
         .withColumn("_queued", F.lit(True)))
    j = tri.join(q, F.upper(tri.entity) == q._e, "left")
    state = (F.when(F.upper("status").isin("FIXED", "RESOLVED"), "Closed").when(F.col("_queued"), "In queue")
             .when(F.col("sla_state") == "Overdue", "Breached").otherwise("Open"))
    return j.groupBy(state.alias("lifecycle_state"), F.col("owner").alias("route")).agg(F.count(F.lit(1)).alias("alerts"))


def alert_signal_counts(tri: DataFrame) -> DataFrame:
    """BRD-14: exception counts by signal, unpivoted with ``stack``."""
    one = tri.agg(F.count_if(F.col("sla_state") == "Overdue").alias("overdue"),
                  F.count_if(F.col("sla_state") == "Due Soon").alias("due_soon"),
                  F.count_if(F.upper("owner") == "DBA").alias("unowned"),
                  F.count_if(F.col("severity") == "Critical").alias("critical"))
    return one.select(F.expr("stack(4, 'overdue', overdue, 'due_soon', due_soon, 'unowned', unowned, "
                             "'critical', critical) AS (signal, alerts)"))


def checklist_history(queue: DataFrame) -> DataFrame:
    """BRD-15: per day and check (category): findings, fixed, recurring."""
    return queue.groupBy(F.to_date("last_seen_at").alias("check_date"), "category").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(F.col("status") == "Fixed").alias("fixed"),
        F.count_if(F.col("seen_count") > 1).alias("recurring"))


def review_execution_match(suspend: DataFrame, queries: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """BRD-16: recommended warehouse changes matched to executed ALTER
    WAREHOUSE statements (two groupBys and a left join)."""
    rec = suspend.groupBy(F.upper("warehouse_name").alias("wh")).agg(F.first("recommendation_type").alias("recommendation"))
    ex = (queries.filter(lookback("start_time", as_of, days) & (F.col("query_type") == "ALTER_WAREHOUSE"))
          .groupBy(F.upper("warehouse_name").alias("wh")).agg(F.count(F.lit(1)).alias("executions"),
                                                             F.max("start_time").alias("last_executed")))
    j = rec.join(ex, "wh", "left")
    return j.select(F.col("wh").alias("warehouse_name"), "recommendation", F.coalesce("executions", F.lit(0)).alias("executions"),
                    "last_executed", F.when(F.col("executions").isNull(), "Not executed").otherwise("Executed").alias("audit_state"))


def warehouse_owner_inventory(queries: DataFrame, owners: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """BRD-17: per warehouse: users, top user, owner from the directory, readiness."""
    u = (queries.filter(lookback("start_time", as_of, days) & F.col("warehouse_name").isNotNull())
         .groupBy("warehouse_name", "user_name").agg(F.count(F.lit(1)).alias("n")))
    g = u.groupBy("warehouse_name").agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("queries"),
                                        F.max_by("user_name", F.struct("n", "user_name")).alias("top_user"))
    j = g.join(owners.select("warehouse_name", "owner_name"), "warehouse_name", "left")
    return j.withColumn("owner_state", F.when(F.col("owner_name").isNull(), "Needs owner").otherwise("Owned"))


def guardrail_coverage(warehouses: DataFrame) -> DataFrame:
    """BRD-18: per warehouse guardrail checks unpivoted (auto-suspend set,
    suspend <= 10 min, multi-cluster capped)."""
    g = warehouses.select("warehouse_name",
                          (F.col("auto_suspend") > 0).alias("auto_suspend_on"),
                          ((F.col("auto_suspend") > 0) & (F.col("auto_suspend") <= 600)).alias("fast_suspend"),
                          (F.col("max_cluster_count") <= 2).alias("cluster_cap"))
    return g.select("warehouse_name", F.expr("stack(3, 'auto_suspend_on', auto_suspend_on, 'fast_suspend', fast_suspend, "
                                             "'cluster_cap', cluster_cap) AS (guardrail, passed)"))


def latest_active_grants(grants: DataFrame) -> DataFrame:
    """BRD-19: latest active grant per user and role (max-struct aggregate)."""
    a = grants.filter(F.col("deleted_on").isNull())
    g = a.groupBy("grantee_name", "role").agg(F.max(F.struct("created_on", "granted_by")).alias("l"))
    return g.select("grantee_name", "role", F.col("l.created_on").alias("granted_on"), F.col("l.granted_by").alias("granted_by"))


def usage_change_explanation(queries: DataFrame, metering: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """BRD-20: current vs prior credits, statements and users as rows (stack)."""
    a, b = as_of - timedelta(days=days), as_of - timedelta(days=2 * days)
    cur_q = F.col("start_time") >= ts_lit(a)
    q = (queries.filter(between_ts("start_time", b, as_of))
         .agg(F.count_if(cur_q).cast("double").alias("q_c"), F.count_if(~cur_q).cast("double").alias("q_p"),
              F.countDistinct(F.when(cur_q, F.col("user_name"))).cast("double").alias("u_c"),
              F.countDistinct(F.when(~cur_q, F.col("user_name"))).cast("double").alias("u_p")))
    m = (metering.filter(between_ts("start_time", b, as_of))
         .agg(F.sum(F.when(cur_q, F.col("credits_used")).otherwise(0.0)).alias("c_c"),
              F.sum(F.when(~cur_q, F.col("credits_used")).otherwise(0.0)).alias("c_p")))
    j = q.crossJoin(m)
    s = j.select(F.expr("stack(3, 'credits', c_c, c_p, 'queries', q_c, q_p, 'users', u_c, u_p) AS (measure, current_value, prior_value)"))
    return s.select("measure", rounded("current_value", 4).alias("current_value"), rounded("prior_value", 4).alias("prior_value"),
                    rounded(safe_div(F.col("current_value") - F.col("prior_value"), "prior_value") * 100, 1).alias("pct_change"))


def realised_value(queue: DataFrame, verification: DataFrame) -> DataFrame:
    """BRD-21: per category: actions, fixed, verified and savings."""
    v = verification.select("action_id", "savings_pct", "outcome")
    j = queue.join(v, "action_id", "left")
    return j.groupBy("category").agg(F.count(F.lit(1)).alias("actions"), F.count_if(F.col("status") == "Fixed").alias("fixed"),
                                     F.count_if(F.col("outcome") == "Savings verified").alias("verified"),
                                     rounded(F.avg("savings_pct"), 1).alias("avg_savings_pct"))


def operations_now(queries: DataFrame, tasks: DataFrame, q_as_of: datetime, t_as_of: datetime,
                   minutes: int = 60) -> DataFrame:
    """BRD-22: active, queued and blocked statements in the last minutes and
    tasks running at ``t_as_of`` (scheduled, not completed), one row."""
    q = queries.filter(between_ts("start_time", q_as_of - timedelta(minutes=minutes), q_as_of))
    a = q.agg(F.count(F.lit(1)).alias("active"), F.count_if(F.col("queued_overload_time") > 0).alias("queued"),
              F.count_if(F.col("transaction_blocked_time") > 0).alias("blocked"))
    t = (tasks.filter((F.col("scheduled_time") <= ts_lit(t_as_of))
                      & (F.col("completed_time").isNull() | (F.col("completed_time") > ts_lit(t_as_of)))
                      & (F.col("scheduled_time") >= ts_lit(t_as_of - timedelta(days=1))))
         .agg(F.count(F.lit(1)).alias("running_tasks")))
    return a.crossJoin(t)


# ------------------------------------------------------------------ remaining cost operators

def monitoring_cost(queries: DataFrame, metering: DataFrame, as_of: datetime, tag_prefix: str = "team:etl",
                    days: int = 7, price: float = 3.68) -> DataFrame:
    """CST-4 / CST-5: cost of the monitoring workload itself (statements
    carrying the app's query tag): allocated credits per component
    (warehouse) unioned with a total row and the component list."""
    from opslens.operators.cost import per_query_credits
    # the shares are of all statements; only then are the tagged ones picked
    pqc = per_query_credits(queries, metering, as_of, days=days, keep=["query_tag"])
    per = pqc.filter(F.col("query_tag").startswith(tag_prefix)).groupBy(F.col("warehouse_name").alias("component")).agg(
        F.count(F.lit(1)).alias("queries"), rounded(F.sum("metered_credits"), 6).alias("credits"))
    tot = per.agg(F.lit("TOTAL").alias("component"), F.sum("queries").alias("queries"), rounded(F.sum("credits"), 6).alias("credits"))
    u = per.unionByName(tot)
    comps = per.agg(sorted_distinct_list("component").alias("components"))
    return u.crossJoin(comps).withColumn("est_cost_usd", rounded(F.col("credits") * price, 2))


def daily_service_spend(service: DataFrame, as_of: datetime, days: int = 30, price: float = 3.68,
                        ai_price: float = 2.20) -> DataFrame:
    """CST-15 / AGG-13: per day, spend in currency (per-service rate), then per day total."""
    from opslens.operators.cost import service_rate
    s = service.filter(lookback("start_time", as_of, days, end=as_of))
    per = s.groupBy(F.to_date("start_time").alias("usage_date"), "service_type").agg(F.sum("credits_used").alias("c"))
    per = per.withColumn("usd", F.col("c") * service_rate("service_type", price, ai_price))
    return per.groupBy("usage_date").agg(rounded(F.sum("c"), 4).alias("credits"), rounded(F.sum("usd"), 2).alias("spend_usd"),
                                         F.count(F.lit(1)).alias("services"))


def cost_explorer(pqc: DataFrame, tags: DataFrame) -> DataFrame:
    """CST-18: allocated credits (with ``company`` and ``environment`` kept) per
    warehouse with its tags pivoted into columns (``max(when)``), tenant,
    environment and department."""
    t = tags.groupBy("warehouse_name").agg(
        F.max(F.when(F.col("tag_name") == "COST_CENTER", F.col("tag_value"))).alias("cost_center"),
        F.max(F.when(F.col("tag_name") == "DEPARTMENT", F.col("tag_value"))).alias("department"))
    per = pqc.groupBy("company", "environment", "warehouse_name").agg(
        F.count(F.lit(1)).alias("queries"), rounded(F.sum("metered_credits"), 6).alias("credits"))
    return per.join(t, "warehouse_name", "left").select(
        "company", "environment", "warehouse_name", "cost_center", "department", "queries", "credits")


def lens_summary(explorer: DataFrame, dims: Sequence[str]) -> DataFrame:
    """CST-19 / AGG-17: the explorer under a chosen dimension set, share of
    total and a readiness label (rows missing owner tags)."""
    g = explorer.groupBy(*dims).agg(F.sum("credits").alias("_c"), F.count_if(F.col("cost_center").isNull()).alias("untagged_rows"))
    t = g.agg(F.sum("_c").alias("_t"))
    return g.crossJoin(F.broadcast(t)).select(
        *dims, rounded("_c", 6).alias("credits"), rounded(safe_div(F.col("_c") * 100, "_t"), 1).alias("share_pct"),
        F.when(F.col("untagged_rows") == 0, "Chargeback ready").otherwise("Needs tags").alias("readiness"))


def cost_gap_board(explorer: DataFrame) -> DataFrame:
    """CST-20: rows and cost per gap rule (exploded rule flags) and the top driver."""
    flags = F.array(F.when(F.col("cost_center").isNull(), F.lit("missing_cost_center")),
                    F.when(F.col("department").isNull(), F.lit("missing_department")),
                    F.when(F.col("company") == "Shared/Unclassified", F.lit("unclassified_tenant")))
    x = explorer.select("*", F.explode(F.array_compact(flags)).alias("gap_rule"))
    return x.groupBy("gap_rule").agg(F.count(F.lit(1)).alias("rows"), rounded(F.sum("credits"), 6).alias("credits"),
                                     F.max_by("warehouse_name", F.struct("credits", "warehouse_name")).alias("top_driver"))


def burn_with_size(metering: DataFrame, queries: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """CST-21 / JOI-21: credits per day and warehouse with the warehouse's
    latest observed size (``max_by`` over its statements)."""
    size = (queries.filter(lookback("start_time", as_of, days)).groupBy("warehouse_name")
            .agg(F.max_by("warehouse_size", F.struct("start_time", "query_id")).alias("current_size")))
    d = (metering.filter(lookback("start_time", as_of, days, end=as_of))
         .groupBy(F.to_date("start_time").alias("usage_date"), "warehouse_name").agg(rounded(F.sum("credits_used"), 4).alias("credits")))
    return d.join(size, "warehouse_name", "left")


def outlier_evidence(pqc: DataFrame, rules: DataFrame, warehouse: str) -> DataFrame:
    """CST-27: evidence for one warehouse (of allocated credits with
    ``user_name`` and ``query_type`` kept): statements, users, credits, top
    statement type and the owner-tag list from the directory rules."""
    from opslens.operators.chargeback import resolve_owner
    j = pqc.filter(F.col("warehouse_name") == warehouse)
    per_type = j.groupBy("warehouse_name", "query_type").agg(F.sum("metered_credits").alias("c"))
    top = per_type.groupBy("warehouse_name").agg(F.max_by("query_type", F.struct("c", "query_type")).alias("top_query_type"))
    g = j.groupBy("warehouse_name").agg(F.count(F.lit(1)).alias("queries"), F.countDistinct("user_name").alias("users"),
                                        rounded(F.sum("metered_credits"), 6).alias("credits"))
    own = resolve_owner(g, "warehouse_name", rules).select("warehouse_name", F.col("owner_name").alias("owner_tag"))
    return g.join(top, "warehouse_name").join(own, "warehouse_name", "left")


# ------------------------------------------------------------------ tasks, security, governance

def procedure_inventory(queries: DataFrame, tasks: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """TSK-12: procedures seen in CALL statements joined to their calls and to
    the tasks of the same schema; orchestration status."""
    from opslens.operators.tasks import PROC_RE
    c = (queries.filter(lookback("start_time", as_of, days) & (F.col("query_type") == "CALL"))
         .select(F.trim(F.regexp_extract("query_text", PROC_RE, 1)).alias("procedure_name"), "database_name", "schema_name",
                 "start_time"))
    calls = c.groupBy("procedure_name", "database_name", "schema_name").agg(
        F.count(F.lit(1)).alias("calls"), F.max("start_time").alias("last_call"))
    t = tasks.groupBy("database_name", "schema_name").agg(F.countDistinct("name").alias("schema_tasks"))
    j = calls.join(t, ["database_name", "schema_name"], "left")
    return j.withColumn("orchestration", F.when(F.col("schema_tasks").isNull(), "Ad hoc").otherwise("Task scheduled"))


def governance_readiness(classification: DataFrame, tags: DataFrame, access: DataFrame) -> DataFrame:
    """GOV-3: readiness score from classification coverage, tag coverage and
    access-history availability, one row."""
    c = classification.agg(F.coalesce(F.avg("classification_pct"), F.lit(0.0)).alias("classified"))
    t = tags.agg(F.coalesce(F.avg("tag_coverage_pct"), F.lit(0.0)).alias("tagged"))
    a = access.agg(F.count(F.lit(1)).alias("access_days"))
    j = c.crossJoin(t).crossJoin(a)
    score = F.col("classified") * 0.4 + F.col("tagged") * 0.4 + F.least(F.col("access_days"), F.lit(7)) / 7 * 20
    return j.select(rounded("classified", 1).alias("classification_pct"), rounded("tagged", 1).alias("tag_coverage_pct"),
                    "access_days", rounded(score, 1).alias("readiness_score"),
                    F.when(score >= 70, "Ready").when(score >= 40, "Developing").otherwise("Initial").alias("readiness"))


def tag_maturity(coverage: DataFrame) -> DataFrame:
    """GOV-5: databases per maturity level."""
    return coverage.groupBy("maturity").agg(F.count(F.lit(1)).alias("databases"), F.sum("untagged_tables").alias("untagged_tables"))


def unclassified_assets(queries: DataFrame, tenant: Column, as_of: datetime, days: int = 30) -> DataFrame:
    """GOV-6: warehouses, databases and users no tenant rule matches."""
    q = queries.filter(lookback("start_time", as_of, days)).withColumn("_t", tenant).filter(F.col("_t") == "Shared/Unclassified")
    parts = [q.select(F.lit(k).alias("asset_type"), F.col(c).alias("asset_name")) for k, c in
             [("warehouse", "warehouse_name"), ("database", "database_name"), ("user", "user_name")]]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("asset_type", "asset_name").agg(F.count(F.lit(1)).alias("statements"))


def owner_route_readiness(resolution: DataFrame) -> DataFrame:
    """GOV-8: routed share and the top unrouted match, one row."""
    return resolution.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("route_state") == "Routed").alias("routed"),
                          rounded(F.count_if(F.col("route_state") == "Routed") * 100.0 / F.count(F.lit(1)), 1).alias("routed_pct"),
                          F.countDistinct("owner_name").alias("owners"))


# ------------------------------------------------------------------ change evidence surfaces

def integration_status(feeds: dict[str, tuple[DataFrame, str]], as_of: datetime) -> DataFrame:
    """CHG-5 / CHG-8: per evidence surface: rows, last event, key coverage, state."""
    parts = []
    for name, (df, ts) in feeds.items():
        parts.append(df.agg(F.count(F.lit(1)).alias("rows"), F.max(ts).alias("last_event")).withColumn("surface", F.lit(name)))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    h = boundaries("DAY", "last_event", ts_lit(as_of))
    return u.withColumn("days_since_last", h).withColumn(
        "state", F.when(F.col("rows") == 0, "Not connected").when(h > 7, "Stale").otherwise("Connected"))


def unmatched_evidence(recon: DataFrame, limit: int | None = None) -> DataFrame:
    """CHG-6: changes without commit or ticket, newest first."""
    return (recon.filter(F.col("reconciliation_state") != "Reconciled")
            .transform(page(limit, F.desc("start_time"), "query_id")))


# ------------------------------------------------------------------ actions, recommendations, scores

def verification_health(verification: DataFrame, queue: DataFrame) -> DataFrame:
    """ACT-6: verification run counters and queue state, one row."""
    v = verification.agg(F.count(F.lit(1)).alias("verified_actions"),
                         F.count_if(F.col("outcome") == "Savings verified").alias("savings_verified"),
                         F.count_if(F.col("outcome") == "Insufficient data").alias("insufficient"))
    q = queue.agg(F.count_if(F.col("status") != "Fixed").alias("open_actions"), F.max("last_seen_at").alias("last_run"))
    return v.crossJoin(q)


def operability_facts(queue: DataFrame, category: str, limit: int | None = None) -> DataFrame:
    """ACT-7: the queue rows of one check, most recent first."""
    return (queue.filter(F.col("category") == category)
            .transform(page(limit, F.desc("last_seen_at"), "action_id")))


def post_fix_evidence(queries: DataFrame, tasks: DataFrame, metering: DataFrame, q_as_of: datetime,
                      t_as_of: datetime, days: int = 7) -> DataFrame:
    """REC-5: after-fix evidence per signal: idle credits, spill, task failures, statement failures."""
    from opslens.operators.cost import idle_warehouse_credits
    idle = idle_warehouse_credits(metering, queries, q_as_of, days, 0.0).agg(
        rounded(F.coalesce(F.sum("idle_credits"), F.lit(0.0)), 4).alias("value")).withColumn("signal", F.lit("idle_credits"))
    sp = queries.filter(lookback("start_time", q_as_of, days)).agg(
        rounded(F.sum("bytes_spilled_to_remote_storage") / GB, 4).cast("double").alias("value")).withColumn("signal", F.lit("remote_spill_gb"))
    tf = tasks.filter(lookback("scheduled_time", t_as_of, days)).agg(
        F.count_if(F.col("state") == "FAILED").cast("double").alias("value")).withColumn("signal", F.lit("task_failures"))
    qf = queries.filter(lookback("start_time", q_as_of, days)).agg(
        F.count_if(F.col("execution_status") != "SUCCESS").cast("double").alias("value")).withColumn("signal", F.lit("query_failures"))
    return idle.unionByName(sp).unionByName(tf).unionByName(qf)


def component_score(components: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """SCR-2 / SCR-3: weighted score over components (rows ``component,
    score``) and the component scores as ``name=score`` text, one row. Without
    ``weights`` all components count alike; with them, those they name."""
    if weights is None:
        j = components.withColumn("weight", F.lit(1.0))
    else:
        w = components.sparkSession.createDataFrame(list(weights.items()), "component string, weight double")
        j = components.join(F.broadcast(w), "component")
    parts = F.array_sort(F.collect_list(F.struct("component", "score")))
    return j.agg(rounded(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 1).alias("score"),
                 F.concat_ws(", ", F.transform(parts, lambda x: F.concat(x["component"], F.lit("="),
                                                                          x["score"].cast("string")))).alias("components"))


# ------------------------------------------------------------------ network, org balances, AI

def transfer_rows(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, supplier: DataFrame,
                  nation: DataFrame) -> DataFrame:
    """NET source: each shipment is a transfer from the supplier's region to
    the customer's region (bytes from the price); the dimension joins are
    left to the planner (small sides broadcast by measured size)."""
    n_s = nation.select(F.col("n_nationkey").alias("s_nk"), F.col("n_regionkey").alias("src_region"))
    n_c = nation.select(F.col("n_nationkey").alias("c_nk"), F.col("n_regionkey").alias("dst_region"))
    l = lineitem.select("l_orderkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return (l.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(customer.select("c_custkey", F.col("c_nationkey").alias("c_nk")), F.col("o_custkey") == F.col("c_custkey"))
            .join(supplier.select("s_suppkey", F.col("s_nationkey").alias("s_nk")), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(n_s, "s_nk").join(n_c, "c_nk")
            .select(F.to_date("l_shipdate").alias("usage_date"), "src_region", "dst_region",
                    F.when(F.col("src_region") == F.col("dst_region"), "SAME_REGION").otherwise("CROSS_REGION").alias("transfer_type"),
                    (F.col("l_extendedprice") * 1e6).alias("bytes_transferred")))


def transfer_daily(transfers: DataFrame, as_of: datetime, days: int = 30, credits_per_tb: float = 1.0) -> DataFrame:
    """NET-1 / NET-3: transfer GB and credits per day and type."""
    t = transfers.filter((F.col("usage_date") >= F.lit((as_of - timedelta(days=days)).date())) & (F.col("usage_date") < F.lit(as_of.date())))
    g = t.groupBy("usage_date", "transfer_type").agg(F.sum("bytes_transferred").alias("_b"), F.count(F.lit(1)).alias("transfers"))
    return g.select("usage_date", "transfer_type", "transfers", rounded(F.col("_b") / GB, 3).alias("gb"),
                    rounded(F.col("_b") / 1024.0 ** 4 * credits_per_tb, 6).alias("credits"))


def replication_cost(transfers: DataFrame, as_of: datetime, days: int = 30, credits_per_tb: float = 2.0) -> DataFrame:
    """NET-2: cross-region volume per source and target region (replication pairs)."""
    t = transfers.filter((F.col("transfer_type") == "CROSS_REGION") & (F.col("usage_date") >= F.lit((as_of - timedelta(days=days)).date()))
                         & (F.col("usage_date") < F.lit(as_of.date())))
    g = t.groupBy("src_region", "dst_region").agg(F.sum("bytes_transferred").alias("_b"), F.countDistinct("usage_date").alias("days"))
    return g.select("src_region", "dst_region", "days", rounded(F.col("_b") / 1024.0 ** 4, 6).alias("tb"),
                    rounded(F.col("_b") / 1024.0 ** 4 * credits_per_tb, 6).alias("credits"))


def account_balances(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """ORG-3: balances per account (nation): total, negative-balance count."""
    j = customer.select("c_nationkey", "c_acctbal").join(nation.select("n_nationkey", "n_name"),
                                                         F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("account_name")).agg(
        rounded(F.sum("c_acctbal"), 2).alias("balance"), F.count_if(F.col("c_acctbal") < 0).alias("negative_balances"),
        F.count(F.lit(1)).alias("holders"))


def ai_budget_exceptions(rollup: DataFrame, budget_30d: float) -> DataFrame:
    """AIC-2: users whose 30-day projection exceeds the budget."""
    return (rollup.filter(F.col("projected_30d_credits") > budget_30d)
            .withColumn("over_budget_pct", rounded((F.col("projected_30d_credits") / budget_30d - 1) * 100, 1)))


def container_credits_daily(service: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """AIC-6: container and query-acceleration credits per day."""
    s = service.filter(lookback("start_time", as_of, days, end=as_of)
                       & F.upper("service_type").isin("SNOWPARK_CONTAINER_SERVICES", "QUERY_ACCELERATION"))
    return s.groupBy(F.to_date("start_time").alias("usage_date"), "service_type").agg(rounded(F.sum("credits_used"), 4).alias("credits"))


def tag_hot_spots(queries: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """TEL-1: statements per query tag (section), user, role and day."""
    q = queries.filter(lookback("start_time", as_of, days) & F.col("query_tag").isNotNull())
    return q.groupBy(F.split("query_tag", ";").getItem(0).alias("section"), "user_name", "role_name",
                     F.to_date("start_time").alias("usage_date")).agg(F.count(F.lit(1)).alias("statements"))


def tag_query_budget(queries: DataFrame, as_of: datetime, days: int = 7, slow_ms: int = 10000) -> DataFrame:
    """TEL-2: per tag section: calls, distinct statements, expensive calls
    (over the slow budget), elapsed, risk label."""
    q = queries.filter(lookback("start_time", as_of, days) & F.col("query_tag").isNotNull())
    g = q.groupBy(F.split("query_tag", ";").getItem(0).alias("section")).agg(
        F.count(F.lit(1)).alias("calls"), F.countDistinct("query_hash").alias("unique_statements"),
        F.count_if(F.col("total_elapsed_time") > slow_ms).alias("expensive"),
        rounded(F.sum("total_elapsed_time") / 1000.0, 1).alias("elapsed_sec"))
    return g.withColumn("risk", F.when(F.col("expensive") * 10 > F.col("calls"), "High")
                        .when(F.col("expensive") > 0, "Medium").otherwise("Low"))


# ------------------------------------------------------------------ summary facts

def query_hourly_fact(queries: DataFrame, tenant: Column, environment: Column, as_of: datetime, days: int = 7,
                      exact: bool = True) -> DataFrame:
    """SUM-8: the hourly query fact with tenant and environment labels."""
    from opslens.functions.exprs import pctl
    q = queries.filter(lookback("start_time", as_of, days))
    return q.groupBy(trunc("hour", "start_time").alias("hour_start"), tenant.alias("company"), environment.alias("environment"),
                     "warehouse_name", "warehouse_size", "user_name", "role_name", "database_name", "query_type").agg(
        F.count(F.lit(1)).alias("query_count"), F.count_if(F.col("execution_status") != "SUCCESS").alias("failed_count"),
        F.sum("total_elapsed_time").alias("total_elapsed_ms"), rounded(F.avg("execution_time"), 3).alias("avg_execution_ms"),
        rounded(pctl("execution_time", 0.95, exact), 3).alias("p95_execution_ms"),
        F.sum(F.col("queued_overload_time") + F.col("queued_provisioning_time")).alias("total_queued_ms"),
        F.sum("bytes_spilled_to_remote_storage").alias("total_spill_bytes"), F.sum("bytes_scanned").alias("total_bytes_scanned"))


def query_sketch_fact(queries: DataFrame, as_of: datetime, days: int = 7, keys: tuple[str, ...] = ("warehouse_name",), k: int = 400) -> DataFrame:
    """SUM-8 / AGG-6: per hour and ``keys``, counters and a KLL quantile sketch of
    the execution times, to be stored and merged into any coarser period later.

    Counters add up, percentiles don't: a mean or a maximum of hourly p95 is not a
    day's p95, a merge of the sketches is, within their rank error (about
    ``2.3 / k ** 0.9``: one part in a hundred for 400). A sketch has a bounded size (some
    ``3 * k`` values), whatever it has seen, and is built map-side. Statements
    without a time count, but don't enter the sketch; a key without any has none."""
    q = queries.filter(lookback("start_time", as_of, days))
    # partial counters are kept by Spark; the sketch takes doubles without NULLs
    return q.groupBy(trunc("hour", "start_time").alias("hour_start"), *keys).agg(
        F.count(F.lit(1)).alias("query_count"), F.count("execution_time").alias("timed_count"), F.sum("execution_time").alias("total_execution_ms"),
        F.max("execution_time").alias("max_execution_ms"), F.kll_sketch_agg_double(F.col("execution_time").cast("double"), F.lit(k)).alias("execution_sketch"))


def query_period_fact(hourly: DataFrame, unit: str = "day", keys: tuple[str, ...] = ("warehouse_name",),
                      percentiles: tuple[float, ...] = (0.5, 0.95, 0.99), k: int = 400) -> DataFrame:
    """AGG-6: a coarser fact (``unit`` of the period, any subset of the keys) from
    the hourly one alone: counters are added, sketches merged, percentiles read
    from the merged sketch. NULL where no statement had a time."""
    g = hourly.groupBy(trunc(unit, "hour_start").alias("period_start"), *keys).agg(
        F.sum("query_count").alias("query_count"), F.sum("timed_count").alias("timed_count"), F.sum("total_execution_ms").alias("total_execution_ms"),
        F.max("max_execution_ms").alias("max_execution_ms"), F.kll_merge_agg_double(F.when(F.col("timed_count") > 0, F.col("execution_sketch")), F.lit(k)).alias("execution_sketch"))
    at = {p: F.when(F.col("timed_count") > 0, F.kll_sketch_get_quantile_double("execution_sketch", F.lit(p))) for p in percentiles}
    return g.select("*", *[c.alias(f"p{round(p * 100)}_execution_ms") for p, c in at.items()])


def warehouse_hourly_fact(metering: DataFrame, tenant: Column, as_of: datetime, days: int = 7) -> DataFrame:
    """SUM-9: the hourly warehouse fact."""
    m = metering.filter(lookback("start_time", as_of, days))
    return m.groupBy(trunc("hour", "start_time").alias("hour_start"), tenant.alias("company"), "warehouse_name").agg(
        rounded(F.sum("credits_used"), 6).alias("credits_used"), rounded(F.sum("credits_used_compute"), 6).alias("credits_used_compute"),
        rounded(F.sum("credits_used_cloud_services"), 6).alias("credits_used_cloud_services"))


def login_daily_fact(logins: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """SUM-10: the daily login fact."""
    l = logins.filter(lookback("event_timestamp", as_of, days))
    return l.groupBy(F.to_date("event_timestamp").alias("login_date"), "user_name", "client_ip", "reported_client_type",
                     "reported_client_version").agg(F.count_if(F.col("is_success") == "YES").alias("success_count"),
                                                    F.count_if(F.col("is_success") == "NO").alias("failure_count"))


def latest_snapshot_per_tenant(facts: DataFrame, key: str, ts: str, as_of: datetime, max_age_hours: int = 24) -> DataFrame:
    """SUM-11: latest snapshot row per tenant within a maximum age."""
    from opslens.functions.exprs import latest_per_key
    f = facts.filter((F.col(ts) <= ts_lit(as_of)) & (F.col(ts) >= ts_lit(as_of - timedelta(hours=max_age_hours))))
    return latest_per_key(f, [key], [ts])


def remaining_balance(balances: DataFrame, days: int = 7) -> DataFrame:
    """FCT-3: remaining contract balance = free + capacity + rollover, last
    ``days`` balance dates."""
    b = balances.withColumn("total_remaining_credits", F.coalesce("free_usage_balance", F.lit(0.0))
                            + F.coalesce("capacity_balance", F.lit(0.0)) + F.coalesce("rollover_balance", F.lit(0.0)))
    return b.orderBy(F.desc("balance_date")).limit(days)



# ------------------------------------------------------------------ remaining boards

def spend_ranking(metering: DataFrame, as_of: datetime, days: int = 30, limit: int = 10) -> DataFrame:
    """BRD-3: warehouses ranked by spend with rank and share (rank over the
    small per-warehouse aggregate; the total is a one-row broadcast)."""
    from pyspark.sql import Window
    g = (metering.filter(lookback("start_time", as_of, days, end=as_of)).groupBy("warehouse_name")
         .agg(F.sum("credits_used").alias("_c")))
    t = g.agg(F.sum("_c").alias("_t"))
    top = g.orderBy(F.desc("_c"), "warehouse_name").limit(limit)
    r = top.withColumn("spend_rank", F.row_number().over(Window.orderBy(F.desc("_c"), "warehouse_name")))
    return r.crossJoin(F.broadcast(t)).select("spend_rank", "warehouse_name", rounded("_c", 4).alias("credits"),
                                              rounded(F.col("_c") * 100.0 / F.col("_t"), 1).alias("share_pct"))


def service_movement(lens: DataFrame, limit: int = 10) -> DataFrame:
    """BRD-3: services ordered by absolute cost movement."""
    return (lens.select("service_category", "service_type", "estimated_cost_usd", "prior_estimated_cost_usd", "cost_delta_usd")
            .orderBy(F.desc(F.abs("cost_delta_usd")), "service_type").limit(limit))


def cost_spike_signals(anomalies: DataFrame, queries: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """BRD-7: for each cost anomaly (warehouse, day): the same day's change
    statements, failures and statement volume against the warehouse's mean
    daily volume, and the strongest signal."""
    q = queries.filter(lookback("start_time", as_of, days) & F.col("warehouse_name").isNotNull())
    from opslens.operators.incidents import CHANGE_TYPES
    day = q.groupBy("warehouse_name", F.to_date("start_time").alias("usage_date")).agg(
        F.count(F.lit(1)).alias("statements"), F.count_if(F.col("query_type").isin(*CHANGE_TYPES)).alias("changes"),
        F.count_if(F.col("execution_status") != "SUCCESS").alias("failures"))
    base = day.groupBy("warehouse_name").agg(F.avg("statements").alias("_avg"))
    j = anomalies.join(day, ["warehouse_name", "usage_date"], "left").join(base, "warehouse_name", "left")
    vol = safe_div(F.col("statements"), "_avg")
    sig = (F.when(F.col("changes") > 0, "Change on spike day").when(vol >= 1.5, "Workload surge")
           .when(F.col("failures") > F.col("statements") * 0.3, "Retry storm").otherwise("No linked signal"))
    return j.select("usage_date", "warehouse_name", "daily_credits", "z_score", F.coalesce("statements", F.lit(0)).alias("statements"),
                    F.coalesce("changes", F.lit(0)).alias("changes"), F.coalesce("failures", F.lit(0)).alias("failures"),
                    rounded(vol, 2).alias("volume_ratio"), sig.alias("root_cause_signal"))


def cost_incident_timeline(anomalies: DataFrame, alerts: DataFrame) -> DataFrame:
    """BRD-8: cost anomalies and cost alerts on one time line."""
    a = anomalies.select(F.col("usage_date").cast("timestamp_ntz").alias("event_time"), F.lit("anomaly").alias("event_type"),
                         F.col("warehouse_name").alias("entity"), F.col("anomaly_severity").alias("severity"))
    b = (alerts.filter(F.col("alert_type") == "COST_SPIKE")
         .select(F.col("created_at").alias("event_time"), F.lit("alert").alias("event_type"), "entity", "severity"))
    return a.unionByName(b)


def architecture_findings(size_recs: DataFrame, isolation: DataFrame, owners: DataFrame) -> DataFrame:
    """BRD-23: architecture findings (sizing, isolation) with the owner from
    the directory and the objective each finding serves."""
    a = (size_recs.filter(F.col("recommendation") != "maintain")
         .select("warehouse_name", F.lit("sizing").alias("finding_type"), F.col("recommendation").alias("finding"),
                 F.lit("Cost / performance balance").alias("objective")))
    b = (isolation.filter(F.col("decision") != "Isolated")
         .select("warehouse_name", F.lit("isolation").alias("finding_type"), F.col("decision").alias("finding"),
                 F.lit("Workload isolation").alias("objective")))
    u = a.unionByName(b)
    j = u.join(owners.select("warehouse_name", "owner_name"), "warehouse_name", "left")
    return j.withColumn("route", F.coalesce("owner_name", F.lit("Unrouted")))


def conversion_readiness(util: DataFrame, warehouses: DataFrame) -> DataFrame:
    """CAP-18: readiness score per warehouse for a conversion pilot: low
    utilisation, no spill and a steady load score points; label by score."""
    j = util.join(warehouses.select("warehouse_name", "warehouse_size", "max_cluster_count"), "warehouse_name", "left")
    steady = F.col("peak_hourly_credits") <= F.col("avg_hourly_credits") * 2
    score = (F.when(F.col("avg_queue_sec") < 1, 30).otherwise(0) + F.when(F.col("total_remote_spill_gb") == 0, 30).otherwise(0)
             + F.when(steady, 25).otherwise(0) + F.when(F.col("max_cluster_count") <= 1, 15).otherwise(0))
    return j.select("warehouse_name", "warehouse_size", score.alias("readiness_score"),
                    F.when(score >= 70, "Pilot ready").when(score >= 40, "Needs review").otherwise("Not ready").alias("readiness"))


def refresh_lag_history(loads: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """PIP-8: per table and day, the last load and the hours since the
    previous day's last load (lag over days per table, so each window
    partition holds at most ``days`` rows)."""
    from pyspark.sql import Window
    d = (loads.filter(lookback("last_load_time", as_of, days) & (F.col("status") == "LOADED"))
         .groupBy("table_name", F.to_date("last_load_time").alias("load_date"))
         .agg(F.max("last_load_time").alias("last_load")))
    prev = F.lag("last_load").over(Window.partitionBy("table_name").orderBy("load_date"))
    return d.withColumn("prev_load", prev).withColumn(
        "refresh_lag_hours", rounded((F.unix_micros(F.col("last_load").cast("timestamp"))
                                      - F.unix_micros(F.col("prev_load").cast("timestamp"))) / 3.6e9, 2))
