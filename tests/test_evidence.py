"""Containment join, role hierarchy and stitched summary reads."""

from datetime import date, datetime

from pyspark.sql import functions as F

from opslens.operators import change, security
from opslens.sources import feeds
from opslens.session import ensure_checkpoint_dir


def test_texts_that_hold_any_key(spark):
    texts = ["abc-12_x", "zzz", "", None, "ab", "needle at the end KEY-9", "KEY-9", "é-KEY-é"]
    keys = ["c-12", "KEY-9", "", None, "ab", "KEY-é", "not there", "a text longer than all of those that are looked at"]
    df = spark.createDataFrame([(t,) for t in texts] * 2, "text string")
    got = {r[0] for r in change.texts_that_hold(df, spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    assert got == {hashes[t] for t in texts if t and any(k and k in t for k in keys)}
    assert change.texts_that_hold(df, spark.createDataFrame([], "key string")).count() == 0


def test_every_branch_matches_and_no_change_is_multiplied(spark):
    at = datetime(2024, 1, 30)
    rows = [(1, "team:x;sha-1_a2 done", "CREATE TABLE A.B.C", "D", "S", "A.B.C", "OPS-1"), (2, "run abc-9_f", "DROP x", "D", "S", "", ""), (3, None, "ALTER VIEW q.w.e add", "D", "S", "", ""),
            (4, "", "GRANT x", "DB1", "S1", "", ""), (5, "", "GRANT y", "DB2", "ANY", "", ""), (6, None, None, None, None, None, None)]
    ch = spark.createDataFrame([(i, "u", tag, text, db, sch, fqn, key, at, "OBJECT") for i, tag, text, db, sch, fqn, key in rows],
                               "query_id int, user_name string, query_tag string, query_text string, database_name string, schema_name string, "
                               "object_fqn string, ticket_key string, start_time timestamp_ntz, change_family string")
    commits = spark.createDataFrame([("abc-9_f", "no.such.thing", ""), ("abc-9_f", "Q.W.E", "ops-1"), ("zz", "Q.W.E", "OPS-1"), ("", "DB1.S1.T", None), ("yy", "DB2", "")],
                                    "commit_id string, object_fqn string, change_ticket_id string")
    tickets = spark.createDataFrame([("OPS-1",), ("ops-1",)], "ticket_key string")
    out = change.reconcile_changes(ch, commits, tickets).collect()
    assert {r.query_id: r.commit_match for r in out} == {1: "ticket", 2: "commit", 3: "object", 4: "schema", 5: "schema", 6: None} and len(out) == 6
    assert change.reconcile_changes(ch, commits.drop("change_ticket_id"), tickets).count() == 6


def test_roles_are_inherited_over_chains_and_cycles(spark):
    now = datetime(2024, 1, 1)
    grants = spark.createDataFrame([(now, "R1", "ann", None), (now, "R2", "bob", None), (now, "R3", "ann", None), (now, "R3", "cy", None), (now, "R4", "dan", now)],
                                   "created_on timestamp_ntz, role string, grantee_name string, deleted_on timestamp_ntz")
    # R1 is granted to R2, R2 to R3, R3 to R1 (a cycle); R5 to R1
    roles = spark.createDataFrame([("R1", "R2"), ("R2", "R3"), ("R3", "R1"), ("R5", "R1"), ("R5", "R5")], "name string, grantee_name string")
    got = {r.role: (r.users, r.inheriting_roles, r.impacted_users) for r in security.grant_blast_radius(grants, roles).collect()}
    assert got == {"R1": (1, 2, 3), "R2": (1, 2, 3), "R3": (2, 2, 3), "R5": (0, 3, 3)}


def test_stitched_reads(spark):
    import uuid

    path = f"{ensure_checkpoint_dir(spark)}/opslens-test-stitch-{uuid.uuid4().hex[:8]}"
    detail = spark.createDataFrame([(datetime(2024, 1, d, h), float(d)) for d in range(1, 8) for h in (0, 12, 23)], "at timestamp_ntz, v double")

    def by_day(df):
        return df.groupBy(F.to_date("at").alias("usage_date")).agg(F.sum("v").alias("v"))

    def read():
        out = feeds.stitched(spark, f"{path}/s", f"{path}/m", detail, "at", by_day, date(2024, 1, 2), date(2024, 1, 6))
        return out, {r.usage_date.day: r.v for r in out.collect()}

    assert read()[1] == {d: 3.0 * d for d in range(2, 7)}  # neither manifest nor summary
    by_day(detail).where("day(usage_date) IN (1, 3, 4, 6)").withColumn("v", F.col("v") + 1000).write.partitionBy("usage_date").parquet(f"{path}/s")
    spark.createDataFrame([(date(2024, 1, d), d != 6) for d in (1, 3, 4, 6)], "usage_date date, complete boolean").write.parquet(f"{path}/m")
    out, got = read()
    assert got == {2: 6.0, 3: 1009.0, 4: 1012.0, 5: 15.0, 6: 18.0}
