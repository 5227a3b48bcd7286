"""Projections of the driver's fixed tables into warehouse-telemetry sources.

The checks run on TPC-H-like tables (``events``, ``orders``, ``lineitem``,
``part``, ``customer``, ``supplier``, ``nation`` ...). Each source the
operators read (query history, metering, task runs, logins, grants, loads,
storage, alerts ...) is projected from one of them with integer arithmetic,
string concatenation and ``CASE`` only, so the same expressions run in Spark
and in the DuckDB oracle. The few spellings that differ between the two
engines go through :class:`Dialect`.

Every view reads the whole base table; nothing is sampled or capped.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed "now" per base table: the day after the newest row, valid at all scales.
EVENTS_AS_OF = datetime(2024, 1, 31)
LINEITEM_AS_OF = datetime(2001, 11, 5)
ORDERS_AS_OF = datetime(2001, 8, 2)


class Dialect:
    name = "spark"

    def idiv(self, a, b) -> str:
        return f"(({a}) div ({b}))"

    def add_seconds(self, ts, n) -> str:
        return f"timestampadd(SECOND, {n}, {ts})"

    def ts(self, x) -> str:
        return f"CAST({x} AS TIMESTAMP_NTZ)"

    def trunc(self, unit, x) -> str:
        return f"CAST(date_trunc('{unit}', {x}) AS TIMESTAMP_NTZ)"


class DuckDialect(Dialect):
    name = "duckdb"

    def idiv(self, a, b) -> str:
        return f"(({a}) // ({b}))"

    def add_seconds(self, ts, n) -> str:
        return f"({ts} + to_seconds(CAST({n} AS BIGINT)))"

    def ts(self, x) -> str:
        return f"CAST({x} AS TIMESTAMP)"

    def trunc(self, unit, x) -> str:
        return f"date_trunc('{unit}', {x})"


SPARK = Dialect()
DUCK = DuckDialect()


@dataclass
class View:
    base: str
    cols: list[str]                      # first projection (may contain aggregates if keys set)
    keys: list[str] = field(default_factory=list)  # grouping expressions (aliased) for aggregated views
    where: str | None = None
    derived: list[str] = field(default_factory=list)  # second projection over the first


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _views(d: Dialect) -> dict[str, View]:
    hour = lambda n: f"({n}) * 3600"
    v: dict[str, View] = {}

    # -- query_history: one statement per event ---------------------------
    v["query_history"] = View(
        base="events",
        cols=[
            f"{_s('event_id')} AS query_id",
            "event_id AS query_seq",
            "ts AS start_time",
            f"'USER_' || {_s('user_id')} AS user_name",
            f"'ROLE_' || {_s('user_id % 7')} AS role_name",
            f"'WH_' || {_s('user_id % 10')} AS warehouse_name",
            "CASE (user_id % 10) % 4 WHEN 0 THEN 'X-Small' WHEN 1 THEN 'Small' "
            "WHEN 2 THEN 'Medium' ELSE 'Large' END AS warehouse_size",
            f"'DB_' || {_s('user_id % 6')} AS database_name",
            f"'SCH_' || {_s('user_id % 4')} AS schema_name",
            "CASE event_type WHEN 'view' THEN 'SELECT' WHEN 'error' THEN 'SELECT' "
            "WHEN 'purchase' THEN 'INSERT' "
            "WHEN 'click' THEN CASE event_id % 4 WHEN 0 THEN 'UPDATE' WHEN 1 THEN 'MERGE' ELSE 'SELECT' END "
            "ELSE CASE event_id % 6 WHEN 0 THEN 'CREATE_TABLE' WHEN 1 THEN 'ALTER_TABLE' WHEN 2 THEN 'GRANT' "
            "WHEN 3 THEN 'CREATE_ROLE' WHEN 4 THEN 'DROP_TABLE' ELSE 'CALL' END END AS query_type",
            "CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'SUCCESS' END AS execution_status",
            "CAST(round(value * 1000) AS BIGINT) AS total_elapsed_time",
            "CASE WHEN event_type = 'error' THEN 'ERR' || " + _s("100 + event_id % 5") + " END AS error_code",
            "CASE WHEN event_type = 'error' THEN CASE event_id % 4 "
            "WHEN 0 THEN 'Statement reached its statement or warehouse timeout' "
            "WHEN 1 THEN 'Object does not exist or not authorized' "
            "WHEN 2 THEN 'Insufficient privileges to operate on table' "
            "ELSE 'SQL compilation error: invalid identifier' END END AS error_message",
            "'QH_' || regexp_extract(props, '\"k\": ([0-9]+)', 1) AS query_hash",
            "CASE WHEN user_id % 5 = 0 THEN 'team:etl;ticket:OPS-' || " + _s("event_id % 50") + " END AS query_tag",
            "CASE WHEN event_type = 'view' THEN " + _s("event_id - event_id % 6 + 5") + " END AS root_query_id",
            "CASE WHEN event_id % 10 = 0 THEN 'SESSION_UNKNOWN' END AS session_marker",
            "event_id % 40 AS obj_no",
            "user_id % 5 AS proc_no",
        ],
        derived=[
            f"{d.idiv('total_elapsed_time * 8', 10)} AS execution_time",
            f"CASE WHEN query_seq % 10 = 0 THEN {d.idiv('total_elapsed_time', 5)} ELSE CAST(0 AS BIGINT) END AS queued_overload_time",
            "CASE WHEN query_seq % 17 = 0 THEN CAST(2000 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS queued_provisioning_time",
            "CASE WHEN query_seq % 23 = 0 THEN CAST(6000 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS transaction_blocked_time",
            "CASE WHEN query_seq % 7 = 0 THEN query_seq * 1000 ELSE CAST(0 AS BIGINT) END AS bytes_spilled_to_local_storage",
            "CASE WHEN query_seq % 13 = 0 THEN query_seq * 500 ELSE CAST(0 AS BIGINT) END AS bytes_spilled_to_remote_storage",
            "query_seq * 10000 + 7 AS bytes_scanned",
            "CASE WHEN query_seq % 3 = 0 THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS percentage_scanned_from_cache",
            "CAST(query_seq % 11 AS DOUBLE) / 10000 AS credits_used_cloud_services",
            # statement text = verb prefix || object || suffix (one short CASE each, so the
            # expression stays small when the optimizer inlines it into several predicates)
            "CASE query_type WHEN 'SELECT' THEN 'SELECT * FROM ' WHEN 'INSERT' THEN 'INSERT INTO ' WHEN 'UPDATE' THEN 'UPDATE ' "
            "WHEN 'MERGE' THEN 'MERGE INTO ' WHEN 'CREATE_TABLE' THEN 'CREATE TABLE ' WHEN 'ALTER_TABLE' THEN 'ALTER TABLE ' "
            "WHEN 'GRANT' THEN CASE WHEN query_seq % 4 = 0 THEN 'GRANT ROLE ACCOUNTADMIN TO USER ' ELSE 'GRANT SELECT ON TABLE ' END "
            "WHEN 'CREATE_ROLE' THEN 'CREATE ROLE ' WHEN 'DROP_TABLE' THEN 'DROP TABLE ' ELSE 'CALL ' END "
            "|| CASE WHEN query_type = 'CREATE_ROLE' THEN 'R_' || " + _s("obj_no") + " "
            "WHEN query_type = 'GRANT' AND query_seq % 4 = 0 THEN user_name "
            "ELSE database_name || '.' || schema_name || CASE WHEN query_type = 'CALL' THEN '.PROC_' || " + _s("proc_no") + " "
            "ELSE '.T_' || " + _s("obj_no") + " END END "
            "|| CASE query_type WHEN 'INSERT' THEN ' SELECT 1' WHEN 'UPDATE' THEN ' SET c = 1' WHEN 'MERGE' THEN ' USING S ON 1 = 1' "
            "WHEN 'CREATE_TABLE' THEN ' (id INT)' WHEN 'ALTER_TABLE' THEN ' ADD COLUMN c INT' "
            "WHEN 'GRANT' THEN CASE WHEN query_seq % 4 = 0 THEN '' ELSE ' TO ROLE ' || role_name END "
            "WHEN 'CALL' THEN '(1)' ELSE '' END AS query_text",
        ],
    )

    # -- warehouse_metering: hourly credits from events; the warehouse key is
    # not the query's, so some metered hours have no query (idle hours) ------
    v["warehouse_metering"] = View(
        base="events",
        keys=[f"{d.trunc('hour', 'ts')} AS start_time",
              f"'WH_' || {_s('(user_id + event_id) % 10')} AS warehouse_name"],
        cols=[
            "CAST(round(sum(value) / 100 + count(*) * 0.002, 4) AS DOUBLE) AS credits_used",
            "CAST(round(sum(value) / 100, 4) AS DOUBLE) AS credits_used_compute",
            "CAST(round(count(*) * 0.002, 4) AS DOUBLE) AS credits_used_cloud_services",
        ],
    )

    # -- metering_long: seven years of per-shipment credits from lineitem ---
    v["metering_long"] = View(
        base="lineitem",
        cols=[
            "l_shipdate AS start_time",
            f"'WH_' || {_s('l_suppkey % 20')} AS warehouse_name",
            "CAST(l_quantity / 10 AS DOUBLE) AS credits_used",
            "CAST(round(l_quantity * (1 - l_discount) / 10, 6) AS DOUBLE) AS credits_used_compute",
            "CAST(round(l_quantity * l_tax / 10, 6) AS DOUBLE) AS credits_used_cloud_services",
        ],
    )

    # -- service_metering: credits per service type from lineitem ----------
    v["service_metering"] = View(
        base="lineitem",
        cols=[
            "l_shipdate AS start_time",
            "CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'WAREHOUSE_METERING' "
            "WHEN 'AO' THEN 'AUTOMATIC_CLUSTERING' WHEN 'NF' THEN 'SNOWPIPE' WHEN 'NO' THEN 'SERVERLESS_TASK' "
            "WHEN 'RF' THEN 'AI_SERVICES' ELSE 'SNOWPARK_CONTAINER_SERVICES' END AS service_type",
            "CAST(round(l_extendedprice / 10000, 6) AS DOUBLE) AS credits_used",
        ],
    )

    # -- task_history: one scheduled task run per order --------------------
    v["task_history"] = View(
        base="orders",
        cols=[
            f"'T' || {_s('o_orderkey')} AS query_id",
            f"'DB_' || {_s('o_custkey % 6')} AS database_name",
            f"'SCH_' || {_s('o_custkey % 4')} AS schema_name",
            f"'TASK_' || {_s('o_custkey % 50')} AS name",
            f"'ROOT_' || {_s('o_custkey % 5')} AS root_task_id",
            f"{d.add_seconds('o_orderdate', hour('o_orderkey % 24'))} AS scheduled_time",
            "CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'FAILED' "
            "ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'SUCCEEDED' ELSE 'CANCELLED' END END AS state",
            "30 + (o_orderkey * 37) % 600 AS run_seconds",
            "o_orderpriority AS prio",
        ],
        derived=[
            "CASE WHEN state = 'CANCELLED' THEN NULL ELSE " + d.add_seconds("scheduled_time", "run_seconds") + " END AS completed_time",
            "CASE WHEN state = 'FAILED' THEN 'E' || substr(prio, 1, 1) END AS error_code",
            "CASE WHEN state = 'FAILED' THEN CASE prio "
            "WHEN '1-URGENT' THEN 'Statement reached its statement or warehouse timeout' "
            "WHEN '2-HIGH' THEN 'Object does not exist or not authorized' "
            "WHEN '3-MEDIUM' THEN 'Insufficient privileges on warehouse' "
            "WHEN '4-NOT SPECIFIED' THEN 'Upstream task dependency failed' "
            "ELSE 'Out of memory during execution' END END AS error_message",
        ],
    )

    # -- task_statements: the statement that each task run started (orders) --
    v["task_statements"] = View(
        base="orders",
        cols=[
            f"'T' || {_s('o_orderkey')} AS query_id",
            f"{d.add_seconds('o_orderdate', hour('o_orderkey % 24') + ' + 5')} AS start_time",
            f"'WH_' || {_s('o_custkey % 10')} AS warehouse_name",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'LARGE' WHEN '2-HIGH' THEN 'Medium' WHEN '5-LOW' THEN NULL ELSE 'Small' END AS warehouse_size",
            "CAST(25000 + (o_orderkey * 37) % 600 * 1000 AS BIGINT) AS total_elapsed_time",
            "CAST(o_orderkey % 13 AS DOUBLE) / 10000 AS credits_used_cloud_services",
            f"'MERGE INTO DB_' || {_s('o_custkey % 6')} || '.SCH_' || {_s('o_custkey % 4')} || '.T_' || {_s('o_orderkey % 40')} || "
            f"' USING \"STAGE\".S_' || {_s('o_custkey % 9')} || ' ON 1 = 1' AS query_text",
        ],
    )

    # -- task_graph: task inventory with predecessor arrays (customer) ------
    v["task_graph"] = View(
        base="customer",
        cols=[
            "'DB' AS database_name",
            "'SCH_0' AS schema_name",
            f"'TASK_' || {_s('c_custkey')} AS task_name",
            "CASE WHEN c_custkey % 13 = 0 THEN 'suspended' ELSE 'started' END AS state",
            "CASE WHEN c_custkey < 3 THEN '[]' "
            f"WHEN c_custkey % 5 = 0 AND {d.idiv('c_custkey', 5)} >= 3 AND {d.idiv('c_custkey', 5)} <> {d.idiv('c_custkey', 3)} "
            f"THEN '[\"DB.SCH_0.TASK_' || {_s(d.idiv('c_custkey', 3))} || '\",\"DB.SCH_0.TASK_' || {_s(d.idiv('c_custkey', 5))} || '\"]' "
            f"ELSE '[\"DB.SCH_0.TASK_' || {_s(d.idiv('c_custkey', 3))} || '\"]' END AS predecessors",
            f"'WH_' || {_s('c_nationkey')} AS warehouse_name",
            f"CASE WHEN c_mktsegment = 'BUILDING' THEN 'INSERT INTO DB.SCH_0.T_' || {_s('c_custkey % 40')} || ' SELECT 1 FROM DB.SCH_0.V_1' "
            f"ELSE 'CALL DB.SCH_0.PROC_' || {_s('c_custkey % 17')} || '(1)' END AS definition",
        ],
    )

    # -- object_dependencies: edge list over part --------------------------
    v["object_dependencies"] = View(
        base="part",
        where="p_partkey > 0",
        cols=[
            f"'T_' || {_s('p_partkey')} AS referencing_object_name",
            "CASE WHEN p_partkey % 3 = 0 THEN 'VIEW' ELSE 'TABLE' END AS referencing_object_domain",
            f"'T_' || {_s(d.idiv('p_partkey', 2))} AS referenced_object_name",
            "'TABLE' AS referenced_object_domain",
        ],
    )

    # -- login_history: sign-ups succeed, errors fail (events) -------------
    v["login_history"] = View(
        base="events",
        where="event_type IN ('signup', 'error')",
        cols=[
            "event_id",
            "ts AS event_timestamp",
            f"'USER_' || {_s('user_id')} AS user_name",
            "CASE WHEN event_type = 'error' THEN 'NO' ELSE 'YES' END AS is_success",
            f"'10.0.' || {_s('user_id % 8')} || '.' || {_s('event_id % 4')} AS client_ip",
            "CASE user_id % 3 WHEN 0 THEN 'JDBC_DRIVER' WHEN 1 THEN 'PYTHON_DRIVER' ELSE 'WEB_UI' END AS reported_client_type",
            f"'1.' || {_s('event_id % 3')} AS reported_client_version",
            "CASE WHEN event_type = 'error' THEN '390100' END AS error_code",
            "CASE WHEN user_id % 3 = 0 THEN 'DUO' END AS second_authentication_factor",
        ],
    )

    # -- sessions: one per user and day (events) ---------------------------
    v["sessions"] = View(
        base="events",
        keys=[f"'S' || {_s('user_id')} || '_' || {_s('CAST(ts AS DATE)')} AS session_id",
              f"'USER_' || {_s('user_id')} AS user_name",
              "CASE user_id % 3 WHEN 0 THEN 'JDBC' WHEN 1 THEN 'PYTHON' ELSE 'WEB' END AS client_application_id"],
        cols=["min(ts) AS created_on", "max(ts) AS last_access_time", "count(*) AS statement_count"],
    )

    # -- users (customer) ---------------------------------------------------
    v["users"] = View(
        base="customer",
        cols=[
            f"'USER_' || {_s('c_custkey')} AS name",
            "CASE WHEN c_custkey % 17 = 0 THEN 'true' ELSE 'false' END AS disabled",
            "CASE WHEN c_custkey % 4 = 0 THEN 'false' ELSE 'true' END AS has_password",
            "CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END AS ext_authn_duo",
            d.ts("DATE '2023-06-01' + CAST(c_custkey % 200 AS INTEGER)") + " AS created_on",
            "lower(c_mktsegment) AS department",
        ],
    )

    # -- grants_to_users (customer) ----------------------------------------
    # -- grants_to_roles: role hierarchy with a cycle (supplier) ------------
    v["grants_to_roles"] = View(
        base="supplier",
        keys=[f"'ROLE_' || {_s('s_suppkey % 7')} AS name",
              f"CASE WHEN s_suppkey % 7 = 6 THEN 'SYSADMIN' WHEN s_suppkey % 7 = 2 THEN 'ROLE_0' ELSE 'ROLE_' || {_s('s_suppkey % 7 + 1')} END AS grantee_name"],
        cols=["count(*) AS grants"],
    )

    v["grants_to_users"] = View(
        base="customer",
        cols=[
            d.ts("DATE '2022-01-01' + CAST((c_custkey * 7) % 700 AS INTEGER)") + " AS created_on",
            "CASE c_custkey % 9 WHEN 0 THEN 'ACCOUNTADMIN' WHEN 1 THEN 'SECURITYADMIN' WHEN 2 THEN 'SYSADMIN' "
            f"ELSE 'ROLE_' || {_s('c_custkey % 7')} END AS role",
            f"'USER_' || {_s('c_custkey')} AS grantee_name",
            "CASE WHEN c_custkey % 2 = 0 THEN 'SECURITYADMIN' ELSE 'USERADMIN' END AS granted_by",
            "c_custkey AS grant_seq",
        ],
        derived=[
            "CASE WHEN grant_seq % 11 = 0 THEN " + d.add_seconds("created_on", "30 * 86400") + " END AS deleted_on",
        ],
    )

    # -- role_grants: roles given to users in the month (events) ------------
    v["role_grants"] = View(
        base="events",
        where="event_type = 'signup'",
        cols=["ts AS created_on", f"'USER_' || {_s('user_id')} AS grantee_name", f"'ROLE_' || {_s('event_id % 7')} AS role",
              "event_id AS grant_seq"],
        derived=["CASE WHEN grant_seq % 11 = 0 THEN " + d.add_seconds("created_on", "3600") + " END AS deleted_on"],
    )

    # -- object_grants: privileges on objects given to roles (part) ---------
    v["object_grants"] = View(
        base="part",
        cols=[
            d.ts("DATE '2024-01-30' - CAST(p_partkey % 60 AS INTEGER)") + " AS created_on",
            f"CASE WHEN p_partkey % 29 <> 0 THEN 'DB_' || {_s('p_partkey % 6')} END AS table_catalog",
            f"CASE WHEN p_partkey % 31 <> 0 THEN 'SCH_' || {_s('p_partkey % 4')} END AS table_schema",
            f"'T_' || {_s('p_partkey % 8')} AS name",
            "CASE p_partkey % 7 WHEN 0 THEN 'OWNERSHIP' WHEN 1 THEN 'SELECT' WHEN 2 THEN 'create table' WHEN 3 THEN 'APPLY MASKING POLICY' "
            "WHEN 4 THEN 'MANAGE GRANTS' ELSE 'USAGE' END AS privilege",
            "CASE WHEN p_partkey % 19 = 0 THEN 'true' WHEN p_partkey % 19 > 1 THEN 'false' END AS grant_option",
            f"'ROLE_' || {_s('p_partkey % 5')} AS grantee_name",
            "CASE WHEN p_partkey % 2 = 0 THEN 'SECURITYADMIN' ELSE 'SYSADMIN' END AS granted_by",
            "p_partkey AS grant_seq",
        ],
        derived=["CASE WHEN grant_seq % 11 = 0 THEN " + d.add_seconds("created_on", "3600") + " END AS deleted_on"],
    )

    # -- databases, some shared by another account (supplier) ---------------
    v["databases"] = View(
        base="supplier",
        cols=[
            f"'DB_' || {_s('s_suppkey')} AS database_name",
            "CASE WHEN s_suppkey % 4 = 0 THEN 'IMPORTED DATABASE' WHEN s_suppkey % 7 = 0 THEN 'SHARE' ELSE 'STANDARD' END AS type",
            d.ts("DATE '2023-03-01' + CAST(s_suppkey % 90 AS INTEGER)") + " AS created",
            "s_suppkey AS database_seq",
        ],
        derived=["CASE WHEN database_seq % 8 = 0 THEN " + d.add_seconds("created", "86400") + " END AS deleted"],
    )

    # -- copy_history: file loads (lineitem) -------------------------------
    v["copy_history"] = View(
        base="lineitem",
        cols=[
            f"'DB_' || {_s('l_partkey % 6')} AS table_catalog_name",
            f"'SCH_' || {_s('l_partkey % 4')} AS table_schema_name",
            f"'T_' || {_s('l_partkey % 40')} AS table_name",
            f"{d.add_seconds('l_shipdate', hour('l_orderkey % 24'))} AS last_load_time",
            "CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'LOAD_FAILED' "
            "WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN 'PARTIALLY_LOADED' ELSE 'LOADED' END AS status",
            f"'f_' || {_s('l_orderkey')} || '_' || {_s('l_linenumber')} || '.csv' AS file_name",
            "CAST(l_quantity AS BIGINT) * 100 AS row_count",
            "CASE WHEN l_returnflag = 'R' AND l_linenumber <= 2 THEN CAST(l_linenumber AS BIGINT) ELSE CAST(0 AS BIGINT) END AS error_count",
            "CAST(floor(l_extendedprice) AS BIGINT) * 10 AS file_size",
            "CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'Number of columns in file does not match table' "
            "WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN 'Numeric value is not recognized' END AS first_error_message",
            f"CASE WHEN l_partkey % 3 = 0 THEN 'PIPE_' || {_s('l_partkey % 9')} END AS pipe_name",
        ],
    )

    # -- table_storage (part) ----------------------------------------------
    v["table_storage"] = View(
        base="part",
        cols=[
            f"'DB_' || {_s('p_partkey % 6')} AS table_catalog",
            f"'SCH_' || {_s('p_partkey % 4')} AS table_schema",
            f"'T_' || {_s('p_partkey')} AS table_name",
            "CAST(p_size AS BIGINT) * CAST(floor(p_retailprice) AS BIGINT) * 100000 AS active_bytes",
            "CAST(p_size AS BIGINT) * 1000 AS row_count",
            "CASE WHEN p_partkey % 5 = 0 THEN 'LINEAR(id)' END AS clustering_key",
            "p_partkey AS part_seq",
        ],
        derived=[
            f"{d.idiv('active_bytes', 10)} AS time_travel_bytes",
            f"{d.idiv('active_bytes', 7)} AS failsafe_bytes",
            f"CASE WHEN part_seq % 10 = 0 THEN {d.idiv('active_bytes', 3)} ELSE CAST(0 AS BIGINT) END AS retained_for_clone_bytes",
        ],
    )

    # -- table_snapshots: two size snapshots per table (part) ---------------
    # snapshot 1 is the base size, snapshot 2 grows or shrinks by a rule on the key
    v["table_snapshots"] = View(
        base="part",
        cols=[
            f"'DB_' || {_s('p_partkey % 6')} AS database_name",
            f"'T_' || {_s('p_partkey')} AS table_name",
            "CAST(p_size AS BIGINT) * 1000 AS rows_1",
            "CAST(p_size AS BIGINT) * (1000 + ((p_partkey * 131) % 900) - 300) AS rows_2",
        ],
    )

    # -- database_storage: daily bytes per database (lineitem) -------------
    v["database_storage"] = View(
        base="lineitem",
        keys=["CAST(l_shipdate AS DATE) AS usage_date",
              f"'DB_' || {_s('l_suppkey % 6')} AS database_name"],
        cols=[
            "CAST(round(sum(l_extendedprice), 2) * 1000000 AS DOUBLE) AS average_database_bytes",
            "CAST(round(sum(l_extendedprice), 2) * 100000 AS DOUBLE) AS average_failsafe_bytes",
        ],
    )

    # -- alerts (orders) -----------------------------------------------------
    v["alerts"] = View(
        base="orders",
        cols=[
            f"'A' || {_s('o_orderkey')} AS alert_id",
            f"{d.add_seconds('o_orderdate', hour('o_orderkey % 24'))} AS created_at",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' "
            "WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity",
            "CASE o_orderstatus WHEN 'F' THEN 'RESOLVED' "
            "WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'ESCALATED' ELSE 'OPEN' END "
            "ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'NEW' ELSE 'ACKNOWLEDGED' END END AS status",
            f"'WH_' || {_s('o_custkey % 10')} AS entity",
            "CASE o_orderkey % 5 WHEN 0 THEN 'COST_SPIKE' WHEN 1 THEN 'TASK_FAILURE' WHEN 2 THEN 'QUERY_REGRESSION' "
            "WHEN 3 THEN 'LOGIN_FAILURE' ELSE 'STALE_TABLE' END AS alert_type",
            "o_orderkey % 72 AS resolve_hours",
            "o_totalprice AS metric_value",
            "CASE o_orderkey % 5 WHEN 1 THEN 'Task TASK_' || " + _s("o_custkey % 50") + " || ' failed ' || " + _s("1 + o_orderkey % 6")
            + " || ' times; duration ' || " + _s("60 + o_orderkey % 900") + " || 's vs baseline ' || " + _s("60 + o_orderkey % 300")
            + " || 's' WHEN 0 THEN 'Credits ' || " + _s("10 + o_orderkey % 90") + " || ' vs baseline ' || " + _s("10 + o_orderkey % 40")
            + " ELSE 'Alert on WH_' || " + _s("o_custkey % 10") + " END AS message",
            "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'team' || " + _s("o_custkey % 3") + " END AS owner",
        ],
        derived=[
            "CASE WHEN status = 'RESOLVED' THEN " + d.add_seconds("created_at", "resolve_hours * 3600") + " END AS resolved_at",
        ],
    )

    # -- maintenance_windows (nation): global and per-entity windows --------
    v["maintenance_windows"] = View(
        base="nation",
        cols=[
            d.ts("DATE '1995-01-01' + CAST(n_nationkey * 97 AS INTEGER)") + " AS window_start",
            f"CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE 'WH_' || {_s('n_nationkey % 10')} END AS entity",
            "n_nationkey AS window_seq",
        ],
        derived=[f"{d.add_seconds('window_start', '(24 + 24 * (window_seq % 3)) * 3600')} AS window_end"],
    )

    # -- warehouses: settings per warehouse (supplier) ----------------------
    v["warehouses"] = View(
        base="supplier",
        keys=[f"'WH_' || {_s('s_suppkey % 20')} AS warehouse_name"],
        cols=[
            "CASE min(s_suppkey % 20) % 4 WHEN 0 THEN 'X-Small' WHEN 1 THEN 'Small' WHEN 2 THEN 'Medium' ELSE 'Large' END AS warehouse_size",
            "CASE min(s_suppkey % 20) % 3 WHEN 0 THEN CAST(60 AS BIGINT) WHEN 1 THEN CAST(600 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS auto_suspend",
            "CAST(1 + min(s_suppkey % 20) % 3 AS BIGINT) AS max_cluster_count",
            "CAST(count(*) AS BIGINT) AS tag_count",
        ],
    )

    # -- access_history: objects read per statement, as a JSON array (events)
    obj = ("'DB_' || " + _s("user_id % 6") + " || '.SCH_' || " + _s("user_id % 4") + " || '.' || "
           "CASE WHEN event_id % 7 = 0 THEN 'CUSTOMER_PII_' ELSE 'T_' END || " + _s("event_id % 40"))
    v["access_history"] = View(
        base="events",
        where="event_type IN ('view', 'click', 'purchase')",
        cols=[
            f"{_s('event_id')} AS query_id",
            f"'USER_' || {_s('user_id')} AS user_name",
            f"'ROLE_' || {_s('user_id % 7')} AS role_name",
            "ts AS query_start_time",
            "CASE event_type WHEN 'purchase' THEN 'INSERT' ELSE 'SELECT' END AS query_type",
            "'[{\"objectName\":\"' || " + obj + " || '\",\"objectDomain\":\"Table\",\"columns\":[{\"columnName\":\"C_' || "
            + _s("event_id % 5") + " || '\"}]}' || CASE WHEN event_id % 3 = 0 THEN ',{\"objectName\":\"DB_0.SCH_0.SALES_' || "
            + _s("event_id % 9") + " || '\",\"objectDomain\":\"View\",\"columns\":[]}' ELSE '' END || ']' AS direct_objects_accessed",
        ],
    )

    # -- columns / tag_references: column inventory and classification tags (lineitem)
    v["columns"] = View(
        base="lineitem",
        keys=[f"'DB_' || {_s('l_partkey % 6')} AS table_catalog", f"'SCH_' || {_s('l_partkey % 4')} AS table_schema",
              f"'T_' || {_s('l_partkey % 40')} AS table_name", f"'C_' || {_s('l_linenumber')} AS column_name"],
        cols=["count(*) AS observations"],
    )
    v["tag_references"] = View(
        base="lineitem",
        where="l_linenumber <= 2",  # the first two columns of every table carry a classification tag
        keys=[f"'DB_' || {_s('l_partkey % 6')} AS table_catalog", f"'SCH_' || {_s('l_partkey % 4')} AS table_schema",
              f"'T_' || {_s('l_partkey % 40')} AS table_name", f"'C_' || {_s('l_linenumber')} AS column_name",
              "CASE WHEN l_returnflag = 'R' THEN 'PII' ELSE 'SEMANTIC_CATEGORY' END AS tag_name"],
        cols=["'COLUMN' AS domain", "count(*) AS tag_uses"],
    )

    # -- source_commits / change_tickets: change evidence feeds -------------
    v["source_commits"] = View(
        base="part",
        cols=[
            f"'c' || {_s('p_partkey')} AS commit_id",
            f"'DB_' || {_s('p_partkey % 6')} || '.SCH_' || {_s('p_partkey % 4')} || '.T_' || {_s('p_partkey % 40')} AS object_fqn",
            d.add_seconds(d.ts("DATE '2024-01-01' + CAST(p_partkey % 30 AS INTEGER)"), "(p_partkey % 24) * 3600") + " AS committed_at",
            f"'dev' || {_s('p_partkey % 7')} AS author",
            f"CASE WHEN p_partkey % 5 = 0 THEN 'OPS-' || {_s('p_partkey % 40')} ELSE '' END AS change_ticket_id",
        ],
    )
    v["change_tickets"] = View(
        base="orders",
        cols=[
            f"'OPS-' || {_s('o_orderkey % 60 + 20')} AS ticket_key",
            d.ts("DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER)") + " AS opened_at",
            "CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Open' ELSE 'In Progress' END AS ticket_status",
        ],
    )

    # -- warehouse_tags: cost-center / department tags (supplier) -----------
    v["warehouse_tags"] = View(
        base="supplier",
        keys=[f"'WH_' || {_s('s_suppkey % 20')} AS warehouse_name",
              "CASE WHEN s_suppkey % 2 = 0 THEN 'COST_CENTER' ELSE 'DEPARTMENT' END AS tag_name"],
        cols=[f"min(CASE WHEN s_suppkey % 2 = 0 THEN 'CC' || {_s('s_suppkey % 5')} ELSE 'DEPT' || {_s('s_suppkey % 3')} END) AS tag_value"],
    )

    # -- object_tags: owner and class tags of databases and warehouses (supplier)
    v["object_tags"] = View(
        base="supplier",
        keys=["CASE WHEN s_suppkey % 2 = 0 THEN 'Warehouse' ELSE 'DATABASE' END AS domain",
              f"CASE WHEN s_suppkey % 2 = 0 THEN 'wh_' || {_s('s_suppkey % 20')} ELSE 'DB_' || {_s('s_suppkey % 60')} END AS object_name",
              "CASE s_nationkey % 7 WHEN 0 THEN 'COST_OWNER' WHEN 1 THEN 'DATA_OWNER' WHEN 2 THEN 'APP_OWNER' WHEN 3 THEN 'SERVICE_TIER' "
              "WHEN 4 THEN 'SENSITIVITY' ELSE 'PROJECT' END AS tag_name"],
        cols=["count(*) AS tag_uses"],
    )

    # -- policy_references: masking and row access policies on columns (part) -
    v["policy_references"] = View(
        base="part",
        cols=[
            "'GOV' AS policy_catalog", f"'P_' || {_s('p_partkey % 3')} AS policy_schema", f"'POL_' || {_s('p_partkey % 11')} AS policy_name",
            "CASE p_partkey % 4 WHEN 0 THEN 'ROW_ACCESS_POLICY' WHEN 1 THEN 'Masking_Policy' WHEN 2 THEN 'MASKING_POLICY' ELSE 'TAG_POLICY' END AS policy_kind",
            f"'DB_' || {_s('p_partkey % 6')} AS ref_database_name", f"'SCH_' || {_s('p_partkey % 4')} AS ref_schema_name",
            f"'T_' || {_s('p_partkey % 40')} AS ref_entity_name", f"'C_' || {_s('p_size % 7')} AS ref_column_name",
            "CASE WHEN p_partkey % 13 = 0 THEN DATE '2024-01-02' END AS deleted",
        ],
    )

    # -- stage_storage: daily bytes of stages (orders) -----------------------
    v["stage_storage"] = View(
        base="orders",
        keys=["CAST(o_orderdate AS DATE) + CAST(95 AS INTEGER) AS usage_date"],
        cols=["CAST(round(sum(o_totalprice), 2) * 100000 AS DOUBLE) AS average_stage_bytes"],
    )

    # -- contract_balances: daily remaining balance parts (customer) --------
    v["contract_balances"] = View(
        base="customer",
        keys=["DATE '2024-01-01' + CAST(c_custkey % 30 AS INTEGER) AS balance_date"],
        cols=["CAST(round(sum(greatest(c_acctbal, 0)), 2) AS DOUBLE) AS capacity_balance",
              "CAST(round(sum(CASE WHEN c_acctbal < 0 THEN -c_acctbal ELSE 0 END), 2) AS DOUBLE) AS rollover_balance",
              "CAST(count(*) AS DOUBLE) AS free_usage_balance"],
    )

    # -- ai_usage: model calls per conversation turn (conversations) --------
    v["ai_usage"] = View(
        base="conversations",
        cols=[
            d.ts("DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER)") + " AS start_time",
            f"'USER_' || {_s('conv_id % 150')} AS user_name",
            "CASE conv_id % 3 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'SUMMARIZE' ELSE 'EMBED' END AS function_name",
            "CASE role WHEN 'user' THEN 'CHAT' ELSE 'API' END AS interface",
            "CAST(length(text) AS BIGINT) AS tokens",
        ],
        derived=["CAST(tokens AS DOUBLE) / 100000 AS credits_used"],
    )
    return v


VIEWS_SPARK = _views(SPARK)
VIEWS_DUCK = _views(DUCK)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one projected source view from the driver parquet in ``sf_dir``."""
    spec = VIEWS_SPARK[name]
    df = spark.read.parquet(f"{sf_dir}/{spec.base}.parquet")
    if spec.where:
        df = df.filter(F.expr(spec.where))
    if spec.keys:
        df = df.groupBy(*[F.expr(k) for k in spec.keys]).agg(*[F.expr(c) for c in spec.cols])
    else:
        df = df.selectExpr(*spec.cols)
    if spec.derived:
        df = df.selectExpr("*", *spec.derived)
    return df


def duck_cte(name: str) -> str:
    """The same projection as DuckDB SQL, for the oracle."""
    spec = VIEWS_DUCK[name]
    where = f" WHERE {spec.where}" if spec.where else ""
    if spec.keys:
        n = len(spec.keys)
        inner = (f"SELECT {', '.join(spec.keys + spec.cols)} FROM {spec.base}{where} "
                 f"GROUP BY {', '.join(str(i + 1) for i in range(n))}")
    else:
        inner = f"SELECT {', '.join(spec.cols)} FROM {spec.base}{where}"
    if spec.derived:
        inner = f"SELECT *, {', '.join(spec.derived)} FROM ({inner}) _b"
    return f"{name} AS ({inner})"


def with_views(sql: str, *names: str) -> str:
    """Prefix an oracle query with the CTEs of the views it reads. A query
    that starts with its own ``WITH`` gets the views prepended to its list."""
    ctes = ",\n".join(duck_cte(n) for n in names)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ctes + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ctes + ",\n" + body[5:]
    return "WITH " + ctes + "\n" + body
