"""Tenant and environment scope helpers (FIL-6..8, SCA-21/22)."""

from pyspark.sql import functions as F

from opslens.functions import scope


def test_tenant_and_environment_labels(spark):
    rows = [("WH_1", "DB_0", "USER_1"), ("WH_55", "DB_9", "USER_2"), ("WH_9", "DB_5", "USER_3"),
            ("WH_9", "DB_4", "USER_90"), ("WH_9", None, "USER_4"), ("WH_9", "OTHER", "USER_4")]
    df = spark.createDataFrame(rows, "warehouse_name string, database_name string, user_name string")
    tenants = [scope.Tenant("NORTH", ["WH_0", "WH_1"]), scope.Tenant("SOUTH", ["WH_5%"], ["DB_5"], "USER_9")]
    envs = scope.Environments(prod=["DB_0"], dev=["DB_2"], other_prefix="DB_")
    got = [(r[0], r[1]) for r in df.select(scope.tenant_label(tenants), scope.environment_label(envs)).collect()]
    assert got == [("NORTH", "PROD"), ("SOUTH", "Other Non-Prod"), ("SOUTH", "Other Non-Prod"),
                   ("SOUTH", "Other Non-Prod"), ("Shared/Unclassified", "No Database Context"),
                   ("Shared/Unclassified", "Other / Shared")]


def test_scope_predicates(spark):
    df = spark.createDataFrame([("WH_1", "R1"), ("WH_12", "R1"), ("WH_2", None), (None, None), (None, "X")],
                               "warehouse_name string, role_name string")
    inc = df.filter(scope.tenant_scope(["WH_1*", "WH_2"], ["WH_12"], keep_null=True)).collect()
    assert sorted(str(r.warehouse_name) for r in inc) == ["None", "None", "WH_1", "WH_2"]
    sig = df.filter(scope.signal_scope({"warehouse_name": ["WH_1", "WH_2"], "role_name": ["R%"]})).collect()
    # at least one scope column present and every present one allowed
    assert sorted((str(r.warehouse_name), str(r.role_name)) for r in sig) == [("WH_1", "R1"), ("WH_2", "None")]
    allowed = spark.createDataFrame([("wh_1",), ("WH_2",)], "name string")
    semi = scope.scope_semi_join(df, allowed, "warehouse_name").select("warehouse_name").collect()
    assert sorted(r[0] for r in semi) == ["WH_1", "WH_2"]
    assert df.filter(scope.match_any(F.col("warehouse_name"), [])).count() == 0
