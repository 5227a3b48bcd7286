"""As-of joins: the last event at or before a row, per key (JOI-15).

Time is cut in buckets (an hour by default). Inside a bucket a window over
(key, bucket) finds the last event; what comes from before the bucket is carried
over from a series that holds one row a key and bucket. So no window ever holds
the raw rows of a key, and a hot key is split by its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.exprs import rounded
from opslens.functions.timeutil import lookback


def last_before(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str, out: str, bucket: str = "HOUR") -> DataFrame:
    """``left`` with ``out``: the ``value`` of the last row of ``right`` of the
    same ``key`` with ``right_ts`` at or before ``left_ts`` (of equal times the
    largest value); null where there is none, or where key or time is null."""
    events = right.where(F.col(key).isNotNull() & F.col(right_ts).isNotNull() & F.col(value).isNotNull()) \
        .groupBy(F.col(key).alias("_k"), F.col(right_ts).alias("_at")).agg(F.max(value).alias("_v")) \
        .select("_k", F.date_trunc(bucket, "_at").alias("_b"), "_at", "_v")
    rows = left.withColumns({"_k": F.col(key), "_at": F.col(left_ts), "_b": F.date_trunc(bucket, F.col(left_ts))})
    # the last event before a bucket, from one row a key and bucket
    last = events.groupBy("_k", "_b").agg(F.max(F.struct("_at", "_v")).alias("_l"))
    marks = rows.where("_k IS NOT NULL AND _b IS NOT NULL").select("_k", "_b").distinct().withColumn("_asked", F.lit(True))
    series = marks.join(last, ["_k", "_b"], "full")
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = series.withColumn("_c", F.last("_l._v", ignorenulls=True).over(before)).where("_asked AND _c IS NOT NULL").select("_k", "_b", "_c")
    # inside a bucket: events go before rows of the same time
    both = rows.select(*left.columns, "_k", "_b", "_at", F.lit(1).alias("_kind"), F.lit(None).cast(events.schema["_v"].dataType).alias("_v")).unionByName(
        events.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy("_k", "_b").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_i", F.last("_v", ignorenulls=True).over(inside)).where("_kind = 1")
    found = found.withColumn("_i", F.when(F.col("_k").isNotNull() & F.col("_b").isNotNull(), F.col("_i")))
    return found.join(carried, ["_k", "_b"], "left").select(*left.columns, F.coalesce("_i", "_c").alias(out))


def statement_programs(queries: DataFrame, sessions: DataFrame, logins: DataFrame, as_of, days: int = 7) -> DataFrame:
    """JOI-15 / SEC-13: statements by connected program. A statement's program is
    the client of its user's last session before it, else the client type of the
    last successful login before it, else its query tag; the source is kept."""
    q = queries.filter(lookback("start_time", as_of, days)).select("query_id", "user_name", "start_time", "query_tag", "total_elapsed_time")
    s = sessions.select("user_name", "created_on", "client_application_id")
    lo = logins.filter(F.col("is_success") == "YES").select("user_name", "event_timestamp", "reported_client_type")
    j = last_before(q, s, "user_name", "start_time", "created_on", "client_application_id", "session_client")
    j = last_before(j, lo, "user_name", "start_time", "event_timestamp", "reported_client_type", "login_client")
    tag = F.nullif(F.col("query_tag"), F.lit(""))
    source = (F.when(F.col("session_client").isNotNull(), "session").when(F.col("login_client").isNotNull(), "login")
              .when(tag.isNotNull(), "query tag").otherwise("unknown"))
    return (j.groupBy(F.coalesce("session_client", "login_client", tag, F.lit("UNTAGGED")).alias("program"), source.alias("identity_source"))
            .agg(F.count(F.lit(1)).alias("statements"), F.countDistinct("user_name").alias("users"),
                 rounded(F.sum(F.coalesce("total_elapsed_time", F.lit(0)).cast("double")) / 1000.0, 3).alias("elapsed_sec")))
