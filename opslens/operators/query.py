"""Query performance operators (QRY-*): bottlenecks, root cause, duplicates,
failures, operations summary, search.

Top-k lists use ``orderBy(...).limit(k)`` (TakeOrderedAndProject: each
partition keeps its k best rows), always with the key columns appended to
the sort so ties are deterministic.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.exprs import page, pctl, rounded, safe_div
from opslens.functions.timeutil import between_ts, lookback, trunc, ts_lit

GB = 1024.0 ** 3


def _recent(queries: DataFrame, as_of: datetime, hours: float) -> DataFrame:
    return queries.filter(between_ts("start_time", as_of - timedelta(hours=hours), as_of)
                          & F.col("warehouse_name").isNotNull())


def queued_ms() -> Column:
    return F.coalesce("queued_overload_time", F.lit(0)) + F.coalesce("queued_provisioning_time", F.lit(0))


def is_failed() -> Column:
    return F.col("error_code").isNotNull() | (F.upper(F.coalesce("execution_status", F.lit(""))) != "SUCCESS")


def bottlenecks(queries: DataFrame, as_of: datetime, hours: int = 24, min_elapsed_sec: float = 60,
                limit: int | None = 50) -> DataFrame:
    """QRY-1 / QRY-6: statements above an elapsed threshold with unit-scaled
    measures (PRJ-1) and a text preview (PRJ-2), longest first."""
    q = _recent(queries, as_of, hours).filter(F.col("total_elapsed_time") >= min_elapsed_sec * 1000)
    return (q.select("query_id", "start_time", "user_name", "warehouse_name", "warehouse_size", "database_name",
                     "query_type", "execution_status",
                     rounded(F.col("total_elapsed_time") / 1000.0, 2).alias("elapsed_sec"),
                     rounded(F.col("execution_time") / 1000.0, 2).alias("exec_sec"),
                     rounded(queued_ms() / 1000.0, 2).alias("queued_sec"),
                     rounded(F.col("bytes_scanned") / GB, 3).alias("gb_scanned"),
                     rounded(F.col("bytes_spilled_to_remote_storage") / GB, 3).alias("remote_spill_gb"),
                     F.substring("query_text", 1, 200).alias("query_preview"))
            .transform(page(limit, F.desc("elapsed_sec"), "query_id")))


def root_cause(queries: DataFrame, as_of: datetime, days: int = 7, limit: int | None = 100) -> DataFrame:
    """QRY-2: one root-cause class per slow or failed statement, with the
    impact value and its unit, and a severity from elapsed seconds."""
    q = queries.filter(lookback("start_time", as_of, days) & F.col("warehouse_name").isNotNull())
    el = F.col("total_elapsed_time") / 1000.0
    qs = queued_ms() / 1000.0
    bl = F.coalesce("transaction_blocked_time", F.lit(0)) / 1000.0
    rs = F.coalesce("bytes_spilled_to_remote_storage", F.lit(0)) / GB
    ls = F.coalesce("bytes_spilled_to_local_storage", F.lit(0)) / GB
    gb = F.coalesce("bytes_scanned", F.lit(0)) / GB
    cause = (F.when(is_failed(), "Failure").when(qs >= F.greatest(F.lit(5.0), el * 0.3), "Queueing")
             .when(bl >= 5, "Lock wait").when(rs > 0, "Remote spill").when(ls >= 1, "Local spill")
             .when(gb >= 10, "Large scan").otherwise("Long execution"))
    impact = (F.when(is_failed(), el).when(cause == "Queueing", qs).when(cause == "Lock wait", bl)
              .when(cause == "Remote spill", rs).when(cause == "Local spill", ls).when(cause == "Large scan", gb)
              .otherwise(el))
    unit = F.when(cause.isin("Remote spill", "Local spill", "Large scan"), "GB").otherwise("sec")
    sev = F.when(el >= 600, "Critical").when(el >= 120, "High").when(el >= 30, "Medium").otherwise("Low")
    r = q.filter(is_failed() | (el >= 30)).select(
        "query_id", "start_time", "user_name", "warehouse_name", "query_type", rounded(el, 2).alias("elapsed_sec"),
        cause.alias("root_cause"), rounded(impact, 3).alias("impact_value"), unit.alias("impact_unit"),
        sev.alias("severity"))
    return r.transform(page(limit, F.desc("elapsed_sec"), "query_id"))


def root_cause_summary(rc: DataFrame) -> DataFrame:
    """QRY-2 summary: statements and total seconds per root cause."""
    return rc.groupBy("root_cause").agg(F.count(F.lit(1)).alias("queries"),
                                        rounded(F.sum("elapsed_sec"), 2).alias("total_elapsed_sec"),
                                        F.count_if(F.col("severity").isin("Critical", "High")).alias("high_or_critical"))


def metric_expr(metric: str) -> Column:
    """Diagnosis metrics: elapsed / queue / blocked seconds, spill / scan GB."""
    return {
        "elapsed": lambda: F.col("total_elapsed_time") / 1000.0,
        "queue": lambda: queued_ms() / 1000.0,
        "spill": lambda: F.col("bytes_spilled_to_remote_storage") / GB,
        "scan": lambda: F.col("bytes_scanned") / GB,
        "blocked": lambda: F.col("transaction_blocked_time") / 1000.0,
    }[metric]()


def diagnosis(queries: DataFrame, as_of: datetime, metric: str = "elapsed", days: int = 1, limit: int = 25) -> DataFrame:
    """QRY-3: the statements with the largest value of a chosen metric."""
    m = metric_expr(metric)
    q = queries.filter(lookback("start_time", as_of, days))
    return (q.select("query_id", "start_time", "user_name", "warehouse_name", "query_type",
                     rounded(m, 3).alias("metric_value"))
            .filter(F.col("metric_value") > 0)
            .orderBy(F.desc("metric_value"), "query_id").limit(limit))


def duplicate_queries(queries: DataFrame, as_of: datetime, days: int = 7, min_runs: int = 5,
                      limit: int | None = None) -> DataFrame:
    """QRY-4: identical statement text (told apart by the hash of the whole
    text; the first 200 characters are shown) run at least ``min_runs`` times:
    users, runs, mean and total ("wasted") seconds."""
    q = queries.filter(lookback("start_time", as_of, days) & (F.upper("execution_status") == "SUCCESS")
                       & F.col("warehouse_name").isNotNull())
    g = (q.groupBy(F.sha2("query_text", 256).alias("_text"))
         .agg(F.min(F.substring("query_text", 1, 200)).alias("query_sig"), F.countDistinct("user_name").alias("user_count"), F.count(F.lit(1)).alias("execution_count"),
              rounded(F.sum("total_elapsed_time") / F.count(F.lit(1)) / 1000.0, 3).alias("avg_elapsed_sec"),
              rounded(F.sum("total_elapsed_time") / 1000.0, 3).alias("total_wasted_sec"))
         .filter(F.col("execution_count") >= min_runs).drop("_text"))
    return g.transform(page(limit, F.desc("execution_count"), "query_sig"))


def failed_sample(queries: DataFrame, as_of: datetime, hours: int = 24, limit: int | None = None) -> DataFrame:
    """QRY-5: most recent failed statements."""
    q = _recent(queries, as_of, hours).filter(is_failed())
    return (q.select("query_id", "start_time", "user_name", "warehouse_name", "database_name", "query_type",
                     "error_code", F.substring("error_message", 1, 200).alias("error_message"))
            .transform(page(limit, F.desc("start_time"), "query_id")))


def failure_groups(queries: DataFrame, as_of: datetime, hours: int = 168) -> DataFrame:
    """QRY-5: failures grouped by statement type and error code."""
    q = _recent(queries, as_of, hours).filter(is_failed())
    return (q.groupBy("query_type", "error_code")
            .agg(F.count(F.lit(1)).alias("failures"), F.countDistinct("user_name").alias("users"),
                 F.max("start_time").alias("last_failure")))


def operations_summary(queries: DataFrame, as_of: datetime, hours: int = 24, exact: bool = True) -> DataFrame:
    """QRY-7 / QRY-9: one row of counters over the last hours (AGG-14: an
    empty window still gives one row of zeros)."""
    q = _recent(queries, as_of, hours)
    return q.agg(F.count(F.lit(1)).alias("total_queries"),
                 F.coalesce(F.sum(is_failed().cast("int")), F.lit(0)).cast("bigint").alias("failed_queries"),
                 F.coalesce(F.sum((queued_ms() > 0).cast("int")), F.lit(0)).cast("bigint").alias("queued_queries"),
                 F.coalesce(F.sum((F.coalesce("bytes_spilled_to_remote_storage", F.lit(0)) > 0).cast("int")), F.lit(0))
                 .cast("bigint").alias("remote_spill_queries"),
                 F.coalesce(rounded(F.avg(F.coalesce("total_elapsed_time", F.lit(0))) / 1000.0, 2), F.lit(0.0))
                 .alias("avg_elapsed_sec"),
                 F.coalesce(rounded(pctl(F.coalesce("total_elapsed_time", F.lit(0)) / 1000.0, 0.95, exact), 2), F.lit(0.0))
                 .alias("p95_elapsed_sec"),
                 F.countDistinct("warehouse_name").alias("active_warehouses"),
                 F.countDistinct("user_name").alias("active_users"))


def what_changed(queries: DataFrame, metering: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """QRY-8: query, failure and credit deltas of the last ``hours`` against
    the ``hours`` before, one row (two one-row aggregates, cross joined)."""
    a, b = as_of - timedelta(hours=hours), as_of - timedelta(hours=2 * hours)
    cur = F.col("start_time") >= ts_lit(a)
    q = (queries.filter(between_ts("start_time", b, as_of))
         .agg(F.count_if(cur).alias("queries_now"), F.count_if(~cur).alias("queries_before"),
              F.count_if(cur & is_failed()).alias("failures_now"), F.count_if(~cur & is_failed()).alias("failures_before")))
    m = (metering.filter(between_ts("start_time", b, as_of))
         .agg(F.coalesce(rounded(F.sum(F.when(cur, F.col("credits_used"))), 4), F.lit(0.0)).alias("credits_now"),
              F.coalesce(rounded(F.sum(F.when(~cur, F.col("credits_used"))), 4), F.lit(0.0)).alias("credits_before")))
    j = q.crossJoin(m)
    return j.select("*", (F.col("queries_now") - F.col("queries_before")).alias("query_delta"),
                    (F.col("failures_now") - F.col("failures_before")).alias("failure_delta"),
                    rounded(F.col("credits_now") - F.col("credits_before"), 4).alias("credit_delta"))


def lock_waits(queries: DataFrame, as_of: datetime, hours: int = 24, min_sec: float = 5, limit: int | None = None) -> DataFrame:
    """QRY-10: statements blocked by a transaction lock longer than ``min_sec``."""
    q = _recent(queries, as_of, hours).filter(F.col("transaction_blocked_time") > min_sec * 1000)
    return (q.select("query_id", "start_time", "user_name", "warehouse_name", "query_type",
                     rounded(F.col("transaction_blocked_time") / 1000.0, 2).alias("blocked_sec"))
            .transform(page(limit, F.desc("blocked_sec"), "query_id")))


def status_timeline(queries: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """QRY-11 / AGG-19: statements per hour and status."""
    q = _recent(queries, as_of, hours)
    return q.groupBy(trunc("hour", "start_time").alias("hour_start"), "execution_status").agg(
        F.count(F.lit(1)).alias("query_count"))


def entity_drilldown(queries: DataFrame, as_of: datetime, entity_col: str, entity: str, days: int = 7,
                     limit: int | None = None) -> DataFrame:
    """QRY-12: recent executions of one warehouse / user / database."""
    q = queries.filter(lookback("start_time", as_of, days) & (F.col(entity_col) == entity))
    return (q.select("query_id", "start_time", "user_name", "warehouse_name", "database_name", "query_type",
                     "execution_status", rounded(F.col("total_elapsed_time") / 1000.0, 2).alias("elapsed_sec"))
            .transform(page(limit, F.desc("start_time"), "query_id")))


def looks_like_id(term: str) -> bool:
    """FIL-11: a term of 16 or more characters without blanks that holds a dash or
    starts with two digits is taken for a statement id."""
    t = term.strip()
    return len(t) >= 16 and not any(c.isspace() for c in t) and ("-" in t or t[:2].isdigit())


def search_history(queries: DataFrame, as_of: datetime, term: str, mode: str = "contains", days: int = 7,
                   limit: int | None = None) -> DataFrame:
    """QRY-13 / FIL-11: search over the whole window asked for. ``id``: that
    statement; ``prefix``: the text starts with the term (3 or more characters);
    ``contains``: the term is in the text (6 or more); ``auto``: ``id`` where the
    term looks like one, else ``contains``. Texts match in any case, and ``%``
    and ``_`` stand for themselves. A shorter term raises."""
    days = max(1, int(days))
    if mode == "auto":
        mode = "id" if looks_like_id(term) else "contains"
    shortest = {"id": 1, "prefix": 3, "contains": 6}
    if mode not in shortest:
        raise ValueError(f"no search mode {mode!r}")
    if len(term) < shortest[mode]:
        raise ValueError(f"a {mode} search takes {shortest[mode]} characters or more")
    text = F.lower("query_text")
    cond = F.col("query_id") == term if mode == "id" else text.startswith(term.lower()) if mode == "prefix" else text.contains(term.lower())
    q = queries.filter(lookback("start_time", as_of, days) & cond)
    return (q.select("query_id", "start_time", "user_name", "warehouse_name", "query_type", "execution_status",
                     F.substring("query_text", 1, 200).alias("query_preview"))
            .transform(page(limit, F.desc("start_time"), "query_id")))


def failure_share(queries: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Failure share per warehouse (feeds REC-4)."""
    q = queries.filter(lookback("start_time", as_of, days) & F.col("warehouse_name").isNotNull())
    g = q.groupBy("warehouse_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(is_failed()).alias("failed"))
    return g.withColumn("failure_pct", rounded(safe_div(F.col("failed") * 100, "total"), 2))
