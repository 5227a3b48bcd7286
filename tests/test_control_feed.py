"""The scheduler feed (SRC-6) from outer arrays, lines and whole files, with
every field kept in the payload."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from opslens.sources import feeds

AT = datetime(2024, 1, 31)
A = '{"job_id": "a", "status": "OK", "seen_count": 3, "tags": ["x", "y"], "last_seen_at": "2024-01-30T10:00:00"}'
B = '{"external_id": "b", "object_type": "CHAIN", "seen_count": "many", "note": "ends in ],"}'


def write(tmp_path, text):
    p = tmp_path / "feed"
    p.mkdir(exist_ok=True)
    (p / "part.json").write_text(text)
    return str(p)


@pytest.mark.parametrize("text", [
    f"[{A},{B}]", f"[\n{A},\n{B}\n]\n", f"{A}\n{B}", f"﻿[{A}\n,{B}]\r\n\n", f"[\n\n{A},{B},\n]", f"[{A}, {B}, null]"])
def test_every_layout_gives_the_same_rows(spark, tmp_path, text):
    rows = feeds.read_variant_feed(spark, write(tmp_path, text)).select(F.to_json("raw_payload").alias("j"), F.try_variant_get("raw_payload", "$.note", "string").alias("note"))
    got = rows.collect()
    assert len(got) == 2 and {r.note for r in got} == {None, "ends in ],"}


def test_pretty_printed_objects_need_whole_files(spark, tmp_path):
    path = write(tmp_path, '[\n {\n  "job_id": "a"\n },\n {\n  "job_id": "b"\n }\n]')
    assert feeds.read_variant_feed(spark, path, wholetext=True).count() == 2
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        feeds.read_variant_feed(spark, path).collect()


def test_typed_paths_defaults_and_payload(spark, tmp_path):
    path = write(tmp_path, f'[{A},{B},{{"job_id": 7, "last_seen_at": "soon", "extra": {{"deep": [1, 2]}}}},{{}}]')
    got = {r.external_id: r for r in feeds.control_feed(feeds.read_variant_feed(spark, path), AT, "S")
           .withColumn("deep", F.try_variant_get("raw_payload", "$.extra.deep[1]", "int")).collect()}
    assert set(got) == {"a", "b", "7", None}
    assert got["a"].last_seen_at == datetime(2024, 1, 30, 10) and got["a"].seen_count == 3 and got["a"].object_type == "TASK"
    assert got["b"].seen_count == 1 and got["b"].object_type == "CHAIN"
    assert got["7"].last_seen_at is None and got["7"].deep == 2


def test_merge_keeps_the_latest_row_of_a_key(spark, tmp_path):
    def batch(text, at):
        return feeds.control_feed(feeds.read_variant_feed(spark, write(tmp_path, text)), at, "S").cache()
    old = batch(f'[{A},{B},{{"status": "no key"}}]', datetime(2024, 1, 30))
    old.count()
    stored = feeds.merge_control_feed(None, old)
    new = batch('{"job_id": "a", "status": "LATE", "last_seen_at": "2024-01-01", "owner": "o"}\n{"job_id": "a", "status": "NEW", "last_seen_at": "2024-01-02", "x": 9}', AT)
    got = {r.external_id: r for r in feeds.merge_control_feed(stored, new).withColumn("x", F.try_variant_get("raw_payload", "$.x", "int")).collect()}
    assert set(got) == {"a", "b"}
    # the whole row is replaced, its repeats in the batch included
    assert (got["a"].status, got["a"].owner, got["a"].x) == ("NEW", None, 9)


def test_an_empty_feed(spark, tmp_path):
    rows = feeds.control_feed(feeds.read_variant_feed(spark, write(tmp_path, "[\n]\n")), AT, "S")
    assert rows.count() == 0 and feeds.merge_control_feed(None, rows).count() == 0
