"""Sources and sinks (SRC-*): windowed scans, external CSV/JSON change
feeds, summary-first reads, ledgers, exports and tagged unions."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslens.functions.exprs import page
from opslens.functions.timeutil import between_ts, lookback, ts_lit
from opslens.session import path_exists


def scan(df: DataFrame, ts_col: str, as_of: datetime, days: float, floor_days: float = 0,
         settled_hours: float | None = None) -> DataFrame:
    """SRC-1 / FIL-1 / FIL-2: the rows of a usage table in a look-back
    window, optionally ending ``settled_hours`` before ``as_of``. The bounds
    are literals on the raw column, so they are pushed to the scan and prune
    date partitions."""
    end = as_of - timedelta(hours=settled_hours) if settled_hours else None
    return df.filter(lookback(ts_col, as_of, days, floor_days=floor_days, end=end))


def live_scan(df: DataFrame, ts_col: str, as_of: datetime, minutes: int = 10, limit: int | None = None,
              order: str | None = None) -> DataFrame:
    """SRC-12: a bounded live window (last minutes); with ``limit``, its
    newest rows."""
    w = df.filter(between_ts(ts_col, as_of - timedelta(minutes=minutes), as_of + timedelta(seconds=1)))
    return w.transform(page(limit, F.desc(ts_col), *([order] if order else [])))


# Tokens read as NULL in feed files.
NULL_TOKENS = ["", "NULL", "null", "None", "N/A"]
TS_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd"]


def tolerant_ts(col: str):
    """First timestamp format that parses; NULL when none does (try_to_timestamp)."""
    return F.coalesce(*[F.try_to_timestamp(F.col(col), F.lit(f)) for f in TS_FORMATS]).cast("timestamp_ntz")


COMMIT_FEED = T.StructType([T.StructField("commit_id", T.StringType()), T.StructField("object_fqn", T.StringType()),
                            T.StructField("committed_at", T.StringType()), T.StructField("author", T.StringType())])
TICKET_FEED = T.StructType([T.StructField("ticket_key", T.StringType()), T.StructField("opened_at", T.StringType()),
                            T.StructField("ticket_status", T.StringType())])


def read_csv_feed(spark: SparkSession, path: str, schema: T.StructType, ts_cols: list[str],
                  null_value: str = "NULL") -> DataFrame:
    """SRC-4 / SRC-5: header row skipped, quoted fields, a null token,
    FAILFAST on malformed rows, timestamps parsed tolerantly afterwards."""
    df = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
          .option("nullValue", null_value).option("mode", "FAILFAST").schema(schema).csv(path))
    for c in ts_cols:
        df = df.withColumn(c, tolerant_ts(c))
    return df


SCHEDULER_JOB = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("job_name", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("started_at", T.StringType()),
    T.StructField("ended_at", T.StringType()), T.StructField("duration_sec", T.StringType()),
    T.StructField("source_system", T.StringType())])


def read_scheduler_json(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """SRC-6: a JSON feed of scheduler jobs; a file holding one outer array
    is read with ``multiLine`` (each element becomes a row); typed paths
    with tolerant casts and defaults; the raw payload is kept as JSON."""
    raw = spark.read.option("multiLine", multiline).schema(SCHEDULER_JOB).json(path)
    return raw.select(
        F.coalesce("source_system", F.lit("external")).alias("source_system"), "job_id",
        F.coalesce("job_name", F.lit("unnamed")).alias("job_name"), F.upper(F.coalesce("status", F.lit("UNKNOWN"))).alias("status"),
        tolerant_ts("started_at").alias("started_at"), tolerant_ts("ended_at").alias("ended_at"),
        F.expr("try_cast(duration_sec AS DOUBLE)").alias("duration_sec"),
        F.to_json(F.struct(*[F.col(f.name) for f in SCHEDULER_JOB.fields])).alias("raw_payload"))


def read_variant_feed(spark: SparkSession, path: str, wholetext: bool = False) -> DataFrame:
    """SRC-6: the objects of a JSON feed, one VARIANT ``raw_payload`` a row, with
    every field they came with.

    Files are split by lines, so a large one is read by many tasks. A line may
    hold an object, several of them, or a piece of an outer array cut at its
    commas: the outer brackets and commas at its ends are taken off, and the rest
    is parsed as an array. Blank lines and nulls give no row; a line that is no
    JSON raises. Objects that run over several lines need ``wholetext`` (a file is
    one row then)."""
    lines = spark.read.text(path, wholetext=wholetext).select(F.trim(F.translate("value", "\r\n\t\ufeff", "   ")).alias("line"))
    # objects end in a brace: brackets and commas behind the last one are the outer array's
    inner = F.regexp_replace(F.regexp_replace("line", r"^[\[,\s]+", ""), r"[\],\s]+$", "")
    items = lines.select(inner.alias("inner")).filter(F.col("inner") != "").select(
        F.explode(F.parse_json(F.concat(F.lit("["), "inner", F.lit("]"))).cast("array<variant>")).alias("raw_payload"))
    return items.filter(F.col("raw_payload").isNotNull() & ~F.is_variant_null("raw_payload"))


def _text(path: str):
    return F.try_variant_get("raw_payload", "$." + path, "string")


def control_feed(payloads: DataFrame, feed_ts: datetime, source_system: str) -> DataFrame:
    """SRC-6: the rows of an external scheduler's feed from its payloads
    (:func:`read_variant_feed`): typed paths, tolerant casts, defaults, and the
    payload itself with the fields that have no column. A value that
    doesn't fit (a word as a count or a time) is the default or NULL. Rows without
    an id are kept with a NULL ``external_id``, as the caller's upsert decides."""
    seen = F.coalesce(*[F.try_to_timestamp(_text("last_seen_at"), F.lit(f)) for f in TS_FORMATS]).cast("timestamp_ntz")
    return payloads.select(
        F.lit(source_system).alias("source_system"), F.coalesce(_text("job_id"), _text("external_id")).alias("external_id"),
        _text("company").alias("company"), _text("environment").alias("environment"), F.coalesce(_text("object_type"), F.lit("TASK")).alias("object_type"),
        *[_text(c).alias(c) for c in ("object_name", "status", "severity", "owner", "ticket_id", "evidence", "next_action")],
        seen.alias("last_seen_at"), F.coalesce(_text("seen_count").try_cast("bigint"), F.lit(1).cast("bigint")).alias("seen_count"),
        ts_lit(feed_ts).alias("feed_ts"), "raw_payload")


def merge_control_feed(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """SRC-6 / UPS-2: the feed after a batch: of each (source system, external id)
    the row of the latest ``feed_ts``, of equal ones the last seen. The batch
    carries its own repeats; rows without an id are left out, as no key finds them.

    One partial aggregate over ``max(struct)``: the payload rides as JSON text,
    since variants can't be ordered."""
    rows = (batch if stored is None else stored.unionByName(batch)).filter(F.col("external_id").isNotNull())
    cols = [c for c in batch.columns if c not in ("source_system", "external_id", "raw_payload")]
    first = ["feed_ts", "last_seen_at"]
    packed = F.struct(*first, *[c for c in cols if c not in first], F.to_json("raw_payload").alias("raw_payload"))
    g = rows.groupBy("source_system", "external_id").agg(F.max(packed).alias("m"))
    return g.select("source_system", "external_id", *[F.col(f"m.{c}").alias(c) for c in cols], F.parse_json(F.col("m.raw_payload")).alias("raw_payload"))


def summary_first(spark: SparkSession, summary_path: str, fallback: Callable[[], DataFrame]) -> DataFrame:
    """SRC-3: read the pre-built summary when it exists, else aggregate the
    detail with ``fallback`` (same output schema)."""
    return spark.read.parquet(summary_path) if path_exists(spark, summary_path) else fallback()


def covered_days(manifest: DataFrame, first: date, last: date) -> list[date]:
    """The days from ``first`` to ``last`` that the manifest names as complete:
    as many values as the window has days."""
    days = manifest.where(F.col("complete") & F.col("usage_date").between(F.lit(first), F.lit(last)))
    return sorted(r[0] for r in days.select("usage_date").distinct().collect())


def stitched(spark: SparkSession, summary_path: str, manifest_path: str, detail: DataFrame, ts_col: str,
             aggregate: Callable[[DataFrame], DataFrame], first: date, last: date) -> DataFrame:
    """SRC-3: complete days from the pre-built daily summary, all other days of
    the window aggregated from the detail (``aggregate`` gives the summary's
    columns, ``usage_date`` among them).

    The manifest (usage_date, complete), written when a day's summary is closed,
    says which days count; without one every day comes from the detail. The
    days are literals on both sides: the summary reads only its partitions of
    covered days, and the detail only the ranges between them."""
    have = covered_days(spark.read.parquet(manifest_path), first, last) if path_exists(spark, manifest_path) else []
    if have and not path_exists(spark, summary_path):
        raise ValueError(f"{manifest_path} names covered days, but there is no summary at {summary_path}")
    missing, day = [], first
    while day <= last:
        if day not in have:
            missing.append(day)
        day += timedelta(days=1)
    # runs of missing days as ranges on the raw time column
    ranges: list[list[date]] = []
    for day in missing:
        if ranges and ranges[-1][1] == day:
            ranges[-1][1] = day + timedelta(days=1)
        else:
            ranges.append([day, day + timedelta(days=1)])
    wanted = F.lit(False)
    for lo, hi in ranges:
        wanted = wanted | between_ts(ts_col, datetime.combine(lo, time()), datetime.combine(hi, time()))
    fresh = aggregate(detail.where(wanted))
    if not have:
        return fresh
    return spark.read.parquet(summary_path).where(F.col("usage_date").isin(have)).select(*fresh.columns).unionByName(fresh)


def append_ledger(df: DataFrame, path: str, partition_col: str | None = None) -> None:
    """SRC-8: append rows to a ledger (verification runs, audit)."""
    w = df.write.mode("append")
    if partition_col:
        w = w.partitionBy(partition_col)
    w.parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """SRC-11: CSV export of a result (distributed write, one file per partition)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def tagged_union(parts: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """SRC-13 / SET-1: union of same-shaped sources with a source tag."""
    out = None
    for name, df in parts.items():
        t = df.withColumn(tag, F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out
