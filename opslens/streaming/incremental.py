"""Structured Streaming operators (STR-*) and keyed upserts (UPS-*).

The reference refreshes its summaries by scheduled MERGE statements over a
look-back window and treats rows older than 24 h as settled. Here the same
summaries are streaming aggregations with a watermark (late rows inside the
watermark update their window; later ones are left to the batch re-merge),
and ``foreachBatch`` merges each micro-batch into a date-partitioned summary
with a dynamic partition overwrite of only the dates the batch touched.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opslens.functions.exprs import rounded
from opslens.session import ensure_checkpoint_dir, path_exists

SETTLE_WATERMARK = "24 hours"


# ------------------------------------------------------------------ STR-*

def event_time(df: DataFrame, col: str) -> DataFrame:
    """Watermarks need ``timestamp`` (not ``timestamp_ntz``) event time; the
    session time zone is UTC, so the cast keeps the wall-clock value."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def hourly_credits_stream(metering: DataFrame, watermark: str = SETTLE_WATERMARK) -> DataFrame:
    """STR-1: tumbling hourly credits per warehouse."""
    return (event_time(metering, "start_time").withWatermark("start_time", watermark)
            .groupBy(F.window("start_time", "1 hour").alias("w"), "warehouse_name")
            .agg(F.sum("credits_used").alias("credits_used"), F.sum("credits_used_compute").alias("credits_compute"),
                 F.count(F.lit(1)).alias("metering_rows"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("hour_start"), "warehouse_name", "credits_used",
                    "credits_compute", "metering_rows"))


def daily_task_states_stream(tasks: DataFrame, watermark: str = SETTLE_WATERMARK) -> DataFrame:
    """STR-2: tumbling daily run counters per task state."""
    return (event_time(tasks, "scheduled_time").withWatermark("scheduled_time", watermark)
            .groupBy(F.window("scheduled_time", "1 day").alias("w"), "state")
            .agg(F.count(F.lit(1)).alias("runs"))
            .select(F.to_date(F.col("w.start")).alias("run_date"), "state", "runs"))


def failure_bursts_stream(tasks: DataFrame, threshold: int = 3, watermark: str = SETTLE_WATERMARK) -> DataFrame:
    """STR-3: failures per task and day as they arrive, kept when at or above
    the threshold (the filter runs on the aggregate, so update mode emits a
    burst as soon as it crosses the threshold)."""
    f = event_time(tasks.filter(F.col("state") == "FAILED"), "scheduled_time").withWatermark("scheduled_time", watermark)
    return (f.groupBy(F.window("scheduled_time", "1 day").alias("w"), "database_name", "schema_name",
                      F.col("name").alias("task_name"))
            .agg(F.count(F.lit(1)).alias("failure_count"))
            .filter(F.col("failure_count") >= threshold)
            .select(F.to_date(F.col("w.start")).alias("failure_date"), "database_name", "schema_name", "task_name",
                    "failure_count"))


def live_operations_stream(queries: DataFrame, watermark: str = "30 minutes") -> DataFrame:
    """STR-4: sliding 10-minute windows every minute: statements, queued and
    lock-blocked counts per warehouse."""
    return (event_time(queries, "start_time").withWatermark("start_time", watermark)
            .groupBy(F.window("start_time", "10 minutes", "1 minute").alias("w"), "warehouse_name")
            .agg(F.count(F.lit(1)).alias("active"), F.count_if(F.col("queued_overload_time") > 0).alias("queued"),
                 F.count_if(F.col("transaction_blocked_time") > 0).alias("blocked"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "warehouse_name", "active", "queued", "blocked"))


def open_alert_dedup_stream(alerts: DataFrame, watermark: str = "24 hours") -> DataFrame:
    """STR-5: one open alert per (entity, type) within the watermark."""
    return (event_time(alerts, "created_at").withWatermark("created_at", watermark)
            .dropDuplicatesWithinWatermark(["entity", "alert_type"]))


def activity_sessions_stream(queries: DataFrame, gap: str = "30 minutes", watermark: str = "2 hours") -> DataFrame:
    """STR-7: user activity sessions by an idle gap (session windows). In append
    mode a session is given out once, when the watermark has passed its end, and
    leaves the state then."""
    return (event_time(queries, "start_time").withWatermark("start_time", watermark)
            .groupBy(F.session_window("start_time", gap).alias("s"), "user_name")
            .agg(F.count(F.lit(1)).alias("statements"))
            .select("user_name", F.col("s.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("s.end").cast("timestamp_ntz").alias("session_end"), "statements"))


def flush_event(source: str, spark: SparkSession, schema, order_col: str, after: str) -> None:
    """Add a last file to a staged replay whose one row lies ``after`` (an
    interval) behind all others, all other columns NULL: the watermark passes
    every window of the data, so append mode gives out each of them. The row's own
    window stays open and is never given out."""
    last = F.max(order_col) + F.expr(f"INTERVAL {after}")
    row = spark.read.schema(schema).parquet(source).agg(last.alias(order_col)).filter(F.col(order_col).isNotNull())
    row.select(*[F.col(f.name) if f.name == order_col else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]) \
        .write.mode("append").parquet(source)


RECOVERY_OUT = ("database_name string, schema_name string, task_name string, failure_at timestamp, "
                "recovery_at timestamp, recovery_state string")
#: Labels of a task's recovery.
OPEN, WITHIN, LATE, PAST = "Open Failure", "Recovered Within SLA", "Recovered Late", "Open past SLA"


class RecoveryPairing(StatefulProcessor):
    """STR-6 state of a task: its latest failure with the first success after
    it, and the successes of the watermark's span, as a failure that comes late
    may be answered by one that came before it. An event-time timer at the SLA
    reports a failure that is still open. Rows of a micro-batch may come in any
    order and in any number of pieces; what is emitted last for a task depends
    on the events alone."""

    def __init__(self, sla_hours: float, keep_hours: float):
        self.sla, self.keep = pd.Timedelta(hours=sla_hours), pd.Timedelta(hours=keep_hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pair = handle.getValueState("pair", "failure_at timestamp, recovery_at timestamp")
        self.recent = handle.getMapState("recent", "at timestamp", "seen boolean")

    def _row(self, key, failure, recovery, label):
        return pd.DataFrame({"database_name": [key[0]], "schema_name": [key[1]], "task_name": [key[2]], "failure_at": [failure],
                             "recovery_at": pd.Series([recovery], dtype="datetime64[ns]"), "recovery_state": [label]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        failure = recovery = None
        if self.pair.exists():
            failure, recovery = (None if pd.isna(x) else pd.Timestamp(x) for x in self.pair.get())
        before, newest, successes = (failure, recovery), failure, []
        for piece in rows:
            at = piece["scheduled_time"]
            failed = at[piece["state"] == "FAILED"].max()
            if not pd.isna(failed) and (newest is None or failed > newest):
                newest = failed
            successes += [t for t in at[piece["state"] == "SUCCEEDED"] if not pd.isna(t)]
        if newest != failure:  # a later failure: the answer may have come before it
            recovery = None
            successes += [pd.Timestamp(k[0]) for k in self.recent.keys()]
        failure = newest
        if failure is not None:
            after = [t for t in successes if t > failure] + ([recovery] if recovery is not None else [])
            recovery = min(after) if after else None
        self._remember(successes, timerValues.getCurrentWatermarkInMs())
        if (failure, recovery) == before or failure is None:
            return
        self.pair.update((failure.to_pydatetime(), None if recovery is None else recovery.to_pydatetime()))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if recovery is None:
            due = int((failure + self.sla).timestamp() * 1000)
            past = due <= timerValues.getCurrentWatermarkInMs()
            if not past:
                self.handle.registerTimer(due)
            yield self._row(key, failure, None, PAST if past else OPEN)
        else:
            yield self._row(key, failure, recovery, LATE if recovery - failure > self.sla else WITHIN)

    def _remember(self, successes, watermark_ms) -> None:
        floor = pd.Timestamp(max(0, watermark_ms), unit="ms") - self.keep
        for t in successes:
            if t >= floor:
                self.recent.updateValue((t.to_pydatetime(),), (True,))
        for k in list(self.recent.keys()):
            if pd.Timestamp(k[0]) < floor:
                self.recent.removeKey(k)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pair.exists():
            failure, recovery = self.pair.get()
            if recovery is None or pd.isna(recovery):
                yield self._row(key, pd.Timestamp(failure), None, PAST)

    def close(self) -> None:
        pass


def recovery_pairing_stream(tasks: DataFrame, sla_hours: float = 4.0, watermark: str = SETTLE_WATERMARK, keep_hours: float = 24.0) -> DataFrame:
    """STR-6: failure-to-recovery pairing per task (``transformWithState``: value
    and map state in RocksDB, event-time timers). In update mode the last row of
    a task is its state; the session needs the RocksDB state store
    (:data:`ROCKSDB`)."""
    t = (tasks.select("database_name", "schema_name", F.col("name").alias("task_name"),
                      F.col("scheduled_time").cast("timestamp").alias("scheduled_time"), "state")
         .withWatermark("scheduled_time", watermark))
    return t.groupBy("database_name", "schema_name", "task_name").transformWithStateInPandas(
        RecoveryPairing(sla_hours, keep_hours), RECOVERY_OUT, "Update", "EventTime")


ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def recovery_summary(spark: SparkSession, source: str, schema, run: str, sla_hours: float = 4.0) -> DataFrame:
    """Run :func:`recovery_pairing_stream` over all files of ``source`` and keep
    each task's last row; the label of an unanswered failure is ``OPEN``."""
    was = spark.conf.get(ROCKSDB[0])
    spark.conf.set(*ROCKSDB)
    try:
        paired = recovery_pairing_stream(file_stream(spark, source, schema), sla_hours).withColumn("part", F.pmod(F.xxhash64("task_name"), F.lit(8)).cast("int"))
        out = run_available_now(paired, run, ["database_name", "schema_name", "task_name"], "part")
    finally:
        spark.conf.set(ROCKSDB[0], was)
    return out.drop("part").withColumn("recovery_state", F.when(F.col("recovery_at").isNull(), OPEN).otherwise(F.col("recovery_state")))


# ------------------------------------------------------------------ UPS-*

def latest_by_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """SRC-10 / UPS-2: the latest row per key as a max-struct aggregate."""
    rest = [c for c in df.columns if c not in keys and c != order]
    g = df.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_m"))
    return g.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in [order, *rest]])


def upsert_partitions(batch: DataFrame, path: str, keys: Sequence[str], partition_col: str,
                      version_col: str = "_version") -> None:
    """UPS-1: merge a batch into a parquet summary partitioned by
    ``partition_col``: rows of the touched partitions are read back, the
    batch wins per key, and only those partitions are overwritten (dynamic
    partition overwrite). The merged result is checkpointed to the cluster
    checkpoint directory first, which cuts the lineage to the files that
    are about to be replaced."""
    spark = batch.sparkSession
    ensure_checkpoint_dir(spark)
    b = batch.withColumn(version_col, F.lit(1))
    if path_exists(spark, path):
        # the schema is given, as a batch without rows leaves a folder without files
        existing = spark.read.schema(batch.schema).parquet(path)
        # only the partitions this batch touches (semi join: runtime partition pruning, no driver collect)
        old = (existing.join(b.select(partition_col).distinct(), partition_col, "left_semi")
               .withColumn(version_col, F.lit(0)))
        merged = latest_by_key(old.unionByName(b, allowMissingColumns=True), keys, version_col)
    else:
        merged = b
    merged = merged.drop(version_col).checkpoint()
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(path))


LEDGER = "batch long, partition string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def committed(spark: SparkSession, path: str, batch_id: int) -> bool:
    """Whether the versioned table at ``path`` holds the batch."""
    return path_exists(spark, f"{path}/ledger/batch={batch_id}.json")


def read_versioned(spark: SparkSession, path: str, schema, partition_col: str) -> DataFrame:
    """The current rows of a versioned table: of each partition, those of the
    last batch in the ledger that wrote it. Files of a batch that never reached
    the ledger are not seen."""
    if not path_exists(spark, f"{path}/ledger"):
        return spark.createDataFrame([], schema)
    ledger = spark.read.schema(LEDGER).json(f"{path}/ledger")
    now = ledger.groupBy("partition").agg(F.max("batch").alias("_version"))
    fields = T.StructType([*[f for f in schema.fields if f.name != partition_col], schema[partition_col], T.StructField("_version", T.LongType())])
    data = spark.read.schema(fields).option("basePath", f"{path}/data").parquet(f"{path}/data")
    name = F.coalesce(F.col(partition_col).cast("string"), F.lit(NO_VALUE))
    return (data.withColumn("_partition", name).join(now.withColumnRenamed("partition", "_partition"), ["_version", "_partition"], "left_semi")
            .select(*schema.fieldNames()))


NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def upsert_versioned(batch: DataFrame, path: str, keys: Sequence[str], partition_col: str, batch_id: int) -> bool:
    """UPS-1: merge a batch into a summary exactly once.

    The touched partitions, merged with the batch (which wins per key), are
    written as a new version of their own (``data/_version=<batch>``); nothing
    that readers see is touched. One ledger file then names the partitions, and
    its rename is the switch: before it all readers see the old version, after it
    the new one. A batch that comes again is left out if the ledger has it, and
    else written anew over what a lost attempt left. Returns whether it wrote."""
    spark = batch.sparkSession
    if committed(spark, path, batch_id):
        return False
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if path_exists(spark, f"{path}/ledger"):
            old = read_versioned(spark, path, batch.schema, partition_col)
            touched = batch.select(F.col(partition_col).alias("_touched")).distinct()
            old = old.join(touched, old[partition_col].eqNullSafe(F.col("_touched")), "left_semi").withColumn("_fresh", F.lit(0))
            # the batch wins per key (null-safe, as grouping is)
            merged = latest_by_key(old.unionByName(batch.withColumn("_fresh", F.lit(1))), keys, "_fresh").drop("_fresh").select(*batch.columns)
        else:
            merged = batch
        target = f"{path}/data/_version={batch_id}"
        merged.write.mode("overwrite").partitionBy(partition_col).parquet(target)
        commit_version(spark, path, batch_id)
    finally:
        batch.unpersist()
    return True


def commit_version(spark: SparkSession, path: str, batch_id: int) -> None:
    """Name the written partitions of a batch in the ledger: one rename."""
    fs, root = _fs(spark, f"{path}/data/_version={batch_id}")
    names = [str(f.getPath().getName()) for f in fs.listStatus(root) if f.isDirectory()]
    lines = "".join(json.dumps({"batch": batch_id, "partition": unquote(n.split("=", 1)[1])}) + "\n" for n in names)
    _, waiting = _fs(spark, f"{path}/pending/batch={batch_id}.json")
    _, final = _fs(spark, f"{path}/ledger/batch={batch_id}.json")
    out = fs.create(waiting, True)
    try:
        out.write(lines.encode())
    finally:
        out.close()
    fs.mkdirs(final.getParent())
    if not fs.rename(waiting, final):
        raise RuntimeError(f"the ledger of {path} has batch {batch_id} already")


def stage_as_files(df: DataFrame, name: str, files: int = 4, order_col: str | None = None, width: int | None = None) -> tuple[str, str]:
    """Write a DataFrame (derived from the given tables) as parquet files under
    the shared checkpoint directory so a file stream can replay it. Returns
    (source dir, run dir); every run gets a new directory.

    With ``order_col`` the rows are written as ``files`` consecutive time
    slices, one append each, so the stream sees them in event-time order the
    way a live feed arrives (slice bounds come from an approximate quantile:
    a handful of numbers, not data). Rows without a time go with the first.

    Each slice is written by ``width`` tasks (the session's parallelism) into as
    many files, and :func:`file_stream` reads that many a micro-batch: one slice,
    whole. The bounds are literals on the raw column, so a slice's scan skips the
    row groups of the others."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    run = f"{base}/opslens-stream/{name}-{uuid.uuid4().hex[:12]}"
    source = f"{run}/source"
    if order_col is None or files <= 1:
        df.repartition(files).write.parquet(source)
        return source, run
    width = max(1, width or spark.sparkContext.defaultParallelism)
    time = F.col(order_col)
    key = F.unix_micros(time.cast("timestamp")).cast("double")
    cuts = df.select(key.alias("_k")).approxQuantile("_k", [i / files for i in range(1, files)], 0.0001)
    edges = [None, *[F.timestamp_micros(F.lit(int(c))).cast(df.schema[order_col].dataType) for c in cuts], None]
    for lo, hi in zip(edges[:-1], edges[1:]):
        inside = F.lit(True) if hi is None else time <= hi
        slice_ = df.filter(inside | time.isNull() if lo is None else inside & (time > lo))
        held = len(_data_files(spark, source))
        slice_.repartition(width).write.mode("append").parquet(source)
        # a task without rows writes no file: a slice of few rows is filled up, so that the next one starts a micro-batch
        for _ in range(width - (len(_data_files(spark, source)) - held)):
            slice_.limit(0).coalesce(1).write.mode("append").parquet(source)
    fs, mark = _fs(spark, f"{source}/{WIDTH_MARK}{width}")
    fs.mkdirs(mark)
    return source, run


WIDTH_MARK = "_width-"           # names that start so are no data to Spark's readers


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [str(f.getPath().getName()) for f in fs.listStatus(p)] if fs.exists(p) else []


def _data_files(spark: SparkSession, path: str) -> list[str]:
    return [n for n in _names(spark, path) if n.endswith(".parquet")]


def run_available_now(stream: DataFrame, run: str, keys: Sequence[str], partition_col: str,
                      max_files: int | None = None, mode: str = "update") -> DataFrame:
    """Drive a streaming aggregation over all available input
    (``trigger(availableNow=True)``), merging every micro-batch into the
    summary with :func:`upsert_versioned`; return the summary as a batch
    DataFrame."""
    out = f"{run}/summary"

    def merge(batch_df, batch_id):
        upsert_versioned(batch_df, out, keys, partition_col, batch_id)

    q = (stream.writeStream.outputMode(mode).foreachBatch(merge)
         .option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return read_versioned(stream.sparkSession, out, stream.schema, partition_col)


def file_stream(spark: SparkSession, src: str, schema, max_files: int | None = None) -> DataFrame:
    """A parquet file stream over staged files: a slice per micro-batch, or
    ``max_files``; one file where the folder holds no slices."""
    if max_files is None:
        max_files = next((int(n.removeprefix(WIDTH_MARK)) for n in _names(spark, src) if n.startswith(WIDTH_MARK)), 1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(src)


def apply_verification(queue: DataFrame, results: DataFrame) -> DataFrame:
    """UPS-4: apply verification results to the queue (UPDATE ... FROM):
    a left join on the action id; verified outcomes overwrite status."""
    r = results.select("action_id", F.col("outcome").alias("_outcome"), F.col("savings_pct").alias("_savings"))
    j = queue.join(r, "action_id", "left")
    status = F.when(F.col("_outcome") == "Savings verified", "Verified").otherwise(F.col("status"))
    return j.withColumn("status", status).withColumn("verified_savings_pct", rounded("_savings", 1)).drop("_outcome", "_savings")
