"""File feeds: tolerant timestamp parsing, scheduler JSON arrays, CSV null
tokens and tagged unions (SRC-4/5/6/13)."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from opslens.sources import feeds


def test_tolerant_ts_formats_and_garbage(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("2024-01-02T03:04:05",), ("2024-01-02",), ("soon",), (None,)],
                               "t string")
    got = [r[0] for r in df.select(feeds.tolerant_ts("t")).collect()]
    assert got == [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2), None, None]


def test_scheduler_json_array_defaults(spark, tmp_path):
    jobs = [{"job_id": "j1", "job_name": "load", "status": "success", "started_at": "2024-01-01 00:00:00",
             "ended_at": "2024-01-01T00:10:00", "duration_sec": "600"},
            {"job_id": "j2", "duration_sec": "n/a", "source_system": "airflow"}]
    (tmp_path / "jobs.json").write_text(json.dumps(jobs))
    out = {r.job_id: r for r in feeds.read_scheduler_json(spark, str(tmp_path)).collect()}
    assert out["j1"].status == "SUCCESS" and out["j1"].duration_sec == 600.0 and out["j1"].source_system == "external"
    assert out["j1"].ended_at == datetime(2024, 1, 1, 0, 10)
    assert out["j2"].job_name == "unnamed" and out["j2"].status == "UNKNOWN" and out["j2"].duration_sec is None
    assert json.loads(out["j2"].raw_payload)["source_system"] == "airflow"


def test_csv_feed_null_token_and_quotes(spark, tmp_path):
    (tmp_path / "t.csv").write_text('ticket_key,opened_at,ticket_status\n"CHG-1, urgent",2024-01-05,Open\nCHG-2,NULL,NULL\n')
    rows = sorted(feeds.read_csv_feed(spark, str(tmp_path), feeds.TICKET_FEED, ["opened_at"]).collect())
    assert rows[0].ticket_key == "CHG-1, urgent" and rows[0].opened_at == datetime(2024, 1, 5)
    assert rows[1].opened_at is None and rows[1].ticket_status is None


def test_tagged_union_fills_missing_columns(spark):
    a = spark.createDataFrame([("x", 1)], "name string, n int")
    b = spark.createDataFrame([("y",)], "name string")
    out = feeds.tagged_union({"first": a, "second": b})
    got = sorted((r.source, r.name, r.n) for r in out.collect())
    assert got == [("first", "x", 1), ("second", "y", None)]
    assert out.filter(F.col("source") == "second").count() == 1


def test_summary_first_falls_back_then_reads_summary(spark, tmp_path):
    detail = spark.createDataFrame([("WH", 1.0), ("WH", 2.0)], "warehouse_name string, credits double")

    def fallback():
        return detail.groupBy("warehouse_name").agg(F.sum("credits").alias("credits"))

    path = str(tmp_path / "summary")
    assert feeds.summary_first(spark, path, fallback).first().credits == 3.0
    spark.createDataFrame([("WH", 9.0)], "warehouse_name string, credits double").write.parquet(path)
    assert feeds.summary_first(spark, path, fallback).first().credits == 9.0
