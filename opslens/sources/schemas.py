"""Source schemas with required and optional columns (SRC-2).

Telemetry tables differ between accounts and versions; a missing optional
column becomes a typed NULL, a missing required column is an error, and
every present column is cast to its declared type. Names are matched
case-insensitively and returned lower-case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Col:
    name: str
    type: str
    required: bool = False


def _s(*cols: Col) -> list[Col]:
    return list(cols)


# required/optional columns of the usage-history sources.
SOURCES: dict[str, list[Col]] = {
    "query_history": _s(
        Col("query_id", "string", True), Col("start_time", "timestamp_ntz", True), Col("user_name", "string", True),
        Col("role_name", "string", True), Col("warehouse_name", "string", True), Col("database_name", "string", True),
        Col("schema_name", "string", True), Col("query_type", "string", True), Col("execution_status", "string", True),
        Col("total_elapsed_time", "bigint", True), Col("execution_time", "bigint", True),
        Col("warehouse_size", "string"), Col("queued_overload_time", "bigint"), Col("queued_provisioning_time", "bigint"),
        Col("transaction_blocked_time", "bigint"), Col("bytes_spilled_to_local_storage", "bigint"),
        Col("bytes_spilled_to_remote_storage", "bigint"), Col("bytes_scanned", "bigint"), Col("query_tag", "string"),
        Col("root_query_id", "string"), Col("error_code", "string"), Col("error_message", "string"),
        Col("query_text", "string"), Col("query_hash", "string"), Col("credits_used_cloud_services", "double")),
    "warehouse_metering": _s(
        Col("start_time", "timestamp_ntz", True), Col("warehouse_name", "string", True), Col("credits_used", "double", True),
        Col("credits_used_compute", "double"), Col("credits_used_cloud_services", "double")),
    "service_metering": _s(
        Col("start_time", "timestamp_ntz", True), Col("service_type", "string", True), Col("credits_used", "double", True)),
    "task_history": _s(
        Col("scheduled_time", "timestamp_ntz", True), Col("database_name", "string", True), Col("schema_name", "string", True),
        Col("query_id", "string", True), Col("root_task_id", "string"), Col("name", "string"), Col("state", "string"),
        Col("completed_time", "timestamp_ntz"), Col("error_code", "string"), Col("error_message", "string")),
    "login_history": _s(
        Col("event_timestamp", "timestamp_ntz", True), Col("user_name", "string", True), Col("is_success", "string", True),
        Col("event_id", "bigint"), Col("client_ip", "string"), Col("reported_client_type", "string"),
        Col("reported_client_version", "string"), Col("error_code", "string")),
    "copy_history": _s(
        Col("last_load_time", "timestamp_ntz", True), Col("table_name", "string", True), Col("status", "string", True),
        Col("table_catalog_name", "string"), Col("table_schema_name", "string"), Col("file_name", "string"),
        Col("row_count", "bigint"), Col("error_count", "bigint"), Col("file_size", "bigint"),
        Col("first_error_message", "string"), Col("pipe_name", "string")),
    "grants_to_users": _s(
        Col("created_on", "timestamp_ntz", True), Col("role", "string", True), Col("grantee_name", "string", True),
        Col("deleted_on", "timestamp_ntz"), Col("granted_by", "string")),
    "users": _s(Col("name", "string", True), Col("disabled", "string", True), Col("has_password", "string"),
                Col("ext_authn_duo", "string"), Col("created_on", "timestamp_ntz"), Col("last_success_login", "timestamp_ntz"),
                Col("deleted_on", "timestamp_ntz")),
}


class MissingColumns(ValueError):
    pass


def conform(df: DataFrame, source: str, schema: dict[str, list[Col]] | None = None) -> DataFrame:
    """SRC-2: project ``df`` onto the declared columns of ``source``: case-folded
    names, declared types, typed NULLs for absent optional columns; extra
    columns are dropped (column pruning reaches the scan)."""
    cols = (schema or SOURCES)[source]
    present = {c.lower(): c for c in df.columns}
    missing = [c.name for c in cols if c.required and c.name.lower() not in present]
    if missing:
        raise MissingColumns(f"{source}: missing required columns {missing}")
    out = []
    for c in cols:
        if c.name.lower() in present:
            out.append(F.col(f"`{present[c.name.lower()]}`").cast(c.type).alias(c.name))
        else:
            out.append(F.lit(None).cast(c.type).alias(c.name))
    return df.select(*out)
