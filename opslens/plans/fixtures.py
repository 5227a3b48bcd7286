"""Fixed configuration relations used by the registered queries.

These are rule tables a user supplies (owner directory, tenant rules, rate
sheets), not data: each is a handful of rows, rendered once as a Spark
DataFrame and once as a SQL ``VALUES`` list for the oracle.
"""

from __future__ import annotations

# Owner directory rows
# (entity_type, entity_pattern, owner_name, owner_email, service_tier, match_priority, is_active)
OWNER_RULES = [
    ("WAREHOUSE", "WH_0", "Platform", "platform@example.com", "Gold", 100, True),
    ("WAREHOUSE", "WH_1*", "Finance", "finance@example.com", "Silver", 50, True),
    ("WAREHOUSE", "WH_5", "Data Science", "ds@example.com", "Gold", 100, True),
    ("WAREHOUSE", "*3", "Operations", "ops@example.com", "Silver", 30, True),
    ("WAREHOUSE", "WH_7", "Retired Team", "old@example.com", "Bronze", 90, False),
    ("WAREHOUSE", "*", "Shared Services", "shared@example.com", "Bronze", 1, True),
    ("DATABASE", "DB_*", "Data Office", "data@example.com", "Gold", 10, True),
]

# Service rate sheet (USD per credit)
RATE_SHEET = {"WAREHOUSE_METERING": 3.68, "SNOWPIPE": 1.25, "AUTOMATIC_CLUSTERING": 2.5}


def sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def values_cte(name: str, cols: list[str], rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(sql_value(x) for x in r) + ")" for r in rows)
    return f"{name}({', '.join(cols)}) AS (VALUES {body})"


OWNER_RULES_CTE = values_cte(
    "owner_rules",
    ["entity_type", "entity_pattern", "owner_name", "owner_email", "service_tier", "match_priority", "is_active"],
    OWNER_RULES)


# Environment and tenant rules over the projected names.
PROD_DATABASES = ["DB_0", "DB_1"]
DEV_DATABASES = ["DB_2", "DB_3"]
OTHER_PREFIX = "DB_"


def environments():
    from opslens.functions.scope import Environments
    return Environments(prod=PROD_DATABASES, dev=DEV_DATABASES, other_prefix=OTHER_PREFIX)


ENV_SQL = ("CASE WHEN upper(database_name) IN ('DB_0', 'DB_1') THEN 'PROD' WHEN upper(database_name) IN ('DB_2', 'DB_3') THEN 'DEV' "
           "WHEN starts_with(upper(database_name), 'DB_') THEN 'Other Non-Prod' "
           "WHEN database_name IS NULL OR trim(database_name) = '' THEN 'No Database Context' ELSE 'Other / Shared' END")


def tenants():
    from opslens.functions.scope import Tenant
    return [Tenant("NORTH", ["WH_0", "WH_1", "WH_2"], [], None),
            Tenant("SOUTH", ["WH_5%"], ["DB_5"], "USER_9")]


TENANT_SQL = ("CASE WHEN upper(warehouse_name) IN ('WH_0', 'WH_1', 'WH_2') THEN 'NORTH' "
              "WHEN upper(warehouse_name) LIKE 'WH_5%' OR upper(database_name) = 'DB_5' OR starts_with(upper(user_name), 'USER_9') "
              "THEN 'SOUTH' ELSE 'Shared/Unclassified' END")
