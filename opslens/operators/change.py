"""Change control (CHG-*)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.exprs import page, rounded
from opslens.functions.timeutil import lookback

FQN_RE = r"(?i)(?:TABLE|VIEW|INTO|FROM|UPDATE)\s+([A-Z0-9_]+\.[A-Z0-9_]+\.[A-Z0-9_]+)"
TICKET_RE = r"(?i)\b([A-Z]{2,10}-[0-9]+)\b"


def _ilike(c: Column, pattern: str) -> Column:
    return F.upper(c).like(pattern.upper())


def change_family(text: str | Column) -> Column:
    """SCA-23: change family from statement text, first match wins. Each
    family is one case-insensitive regex over the text (LIKE 'DROP%' is
    ``^DROP``, '%TAG%' is ``TAG``), so the text is referenced five times."""
    t = F.col(text) if isinstance(text, str) else text
    return (F.when(t.rlike("(?is)^DROP"), "DESTRUCTIVE")
            .when(t.rlike("(?i)MASKING POLICY|ROW ACCESS POLICY|TAG"), "POLICY")
            .when(t.rlike("(?i)OWNERSHIP"), "OWNER")
            .when(t.rlike("(?is)^(GRANT|REVOKE)|^(CREATE|ALTER|DROP).*ROLE"), "ACCESS")
            .when(t.rlike("(?is)^(CREATE|ALTER)"), "OBJECT")
            .otherwise("OTHER"))


def _is_change(t: Column) -> Column:
    return t.rlike("(?is)^(CREATE|ALTER|DROP|GRANT|REVOKE)|OWNERSHIP|MASKING POLICY|ROW ACCESS POLICY|TAG")


def changes(queries: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Observed change statements with family, object and ticket key."""
    q = queries.filter(lookback("start_time", as_of, days) & _is_change(F.col("query_text")))
    return q.select("query_id", "user_name", "role_name", "warehouse_name", "database_name", "schema_name", "start_time",
                    "query_tag", "query_text", change_family("query_text").alias("change_family"),
                    F.upper(F.regexp_extract("query_text", FQN_RE, 1)).alias("object_fqn"),
                    F.upper(F.regexp_extract(F.coalesce("query_tag", F.lit("")), TICKET_RE, 1)).alias("ticket_key"))


def change_summary(ch: DataFrame, manual: Column | None = None) -> DataFrame:
    """CHG-1: counters by family, manual drift (changes without a ticket),
    actors and affected databases, one row."""
    fam = F.col("change_family")
    manual = manual if manual is not None else (F.col("ticket_key") == "")
    return ch.agg(F.count_if(fam.isin("OBJECT", "DESTRUCTIVE")).alias("object_changes"),
                  F.count_if(fam.isin("ACCESS", "OWNER")).alias("access_changes"),
                  F.count_if(fam == "OWNER").alias("owner_changes"), F.count_if(fam == "POLICY").alias("policy_changes"),
                  F.count_if(fam == "DESTRUCTIVE").alias("destructive_changes"),
                  F.count_if((fam != "OTHER") & manual).alias("manual_drift"),
                  F.countDistinct("user_name").alias("actors"), F.countDistinct("database_name").alias("affected_databases"),
                  F.count_if(F.col("database_name").isNull()).alias("account_scope_changes"))


def change_exceptions(ch: DataFrame, environment: Column, limit: int | None = None) -> DataFrame:
    """CHG-2: every classified change with its severity (destructive, policy and
    owner changes high, grants and roles medium, other objects low), entity,
    environment and how sure its scope is."""
    env = environment
    fam = F.col("change_family")
    sev = F.when(fam.isin("DESTRUCTIVE", "POLICY", "OWNER"), "High").when(fam == "ACCESS", "Medium").otherwise("Low")
    entity = F.coalesce(F.concat(F.col("database_name"), F.lit("."), F.col("schema_name")), "database_name", "query_id")
    scoped = F.col("database_name").isNotNull()
    return (ch.filter(fam != "OTHER")
            .select("query_id", "start_time", "user_name", "role_name", "database_name", "change_family", "object_fqn", "ticket_key",
                    env.alias("environment"), sev.alias("severity"), entity.alias("entity"),
                    F.when(scoped, "Database Context").otherwise("Account/Role Context").alias("scope_confidence"))
            .transform(page(limit, F.when(F.col("severity") == "High", 1).when(F.col("severity") == "Medium", 2).otherwise(3),
                            F.desc("start_time"), "query_id")))


def object_change_list(queries: DataFrame, as_of: datetime, days: int = 7, limit: int | None = None) -> DataFrame:
    """CHG-3: DDL on tables, views, procedures and tasks with the change
    type. ``verb%kind%`` with the verb at the start is the leading verb plus
    the first kind (in TABLE, VIEW, PROCEDURE, TASK order) found in the text."""
    t = F.col("query_text")
    verb = F.upper(F.regexp_extract(t, "(?i)^(CREATE|ALTER|DROP)", 1))
    u = F.upper(t)
    kind = (F.when(u.contains("TABLE"), "TABLE").when(u.contains("VIEW"), "VIEW")
            .when(u.contains("PROCEDURE"), "PROCEDURE").when(u.contains("TASK"), "TASK"))
    # the row filter is one regex over the text; verb and kind are projections
    ddl = t.rlike("(?is)^(CREATE|ALTER|DROP).*(TABLE|VIEW|PROCEDURE|TASK)")
    q = (queries.filter(lookback("start_time", as_of, days) & ddl)
         .select("query_id", "user_name", "role_name", "warehouse_name", "database_name", "schema_name", "start_time",
                 "query_type", t.alias("query_text"), verb.alias("_verb"), kind.alias("_kind")))
    return (q.select("query_id", "user_name", "role_name", "warehouse_name", "database_name", "schema_name", "start_time",
                     F.concat_ws(" ", "_verb", "_kind").alias("change_type"), F.substring("query_text", 1, 1500).alias("query_text"))
            .transform(page(limit, F.desc("start_time"), "query_id")))


def texts_that_hold(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """JOI-20: (text_hash), one row for each distinct ``text`` that holds any
    ``key`` as a substring.

    The keys have few different lengths, so a text is cut into its substrings of
    those lengths, and these meet the keys in an equi join: no nested loop and no
    candidate that isn't a match, however many keys there are. Only hashes of the
    texts travel with the substrings."""
    k = keys.select("key").where("key <> ''").distinct()
    lengths = k.agg(F.collect_set(F.length("key")).alias("lengths"))  # one row, as many numbers as there are lengths
    t = texts.select("text").where("text <> ''").distinct()
    cut = (t.crossJoin(F.broadcast(lengths)).select("text", F.xxhash64("text").alias("text_hash"), F.explode("lengths").alias("n"))
           .where(F.length("text") >= F.col("n"))
           .select("text_hash", "n", "text", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("n") + 1)).alias("at"))
           .select("text_hash", F.col("text").substr(F.col("at"), F.col("n")).alias("key")).distinct())
    return cut.join(k, "key", "left_semi").select("text_hash").distinct()


def reconcile_changes(ch: DataFrame, commits: DataFrame, tickets: DataFrame) -> DataFrame:
    """CHG-4 / JOI-6 / JOI-20: every observed change with the evidence for it: a
    source-control commit (of the same ticket, or its id stands in the query tag,
    or its object's name in the statement, or it is of the same database and
    schema) and a ticket for the tag's key.

    The OR-ed match of the reference is one equi join per branch, each against
    *distinct* keys, so no change is multiplied and there is no nested loop.
    ``commit_match`` is the first branch that held."""
    own_ticket = F.upper(F.coalesce("change_ticket_id", F.lit(""))) if "change_ticket_id" in commits.columns else F.lit("")
    named = commits.select(F.upper("object_fqn").alias("_fqn"), F.upper("commit_id").alias("_sha"), own_ticket.alias("_own"))
    parts = F.split("_fqn", r"\.")
    by_ticket = named.select("_own").where("_own <> ''").distinct().withColumn("_ticketed", F.lit(True))
    by_schema = named.select(F.get(parts, F.lit(0)).alias("_db"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("_sch")).distinct() \
        .where("_db <> ''").withColumn("_near", F.lit(True))
    tag, text = F.upper(F.coalesce("query_tag", F.lit(""))), F.upper(F.coalesce("query_text", F.lit("")))
    in_tag = texts_that_hold(ch.select(tag.alias("text")), named.select(F.col("_sha").alias("key"))) \
        .select(F.col("text_hash").alias("_tag_hash"), F.lit(True).alias("_tag"))
    in_text = texts_that_hold(ch.select(text.alias("text")), named.select(F.col("_fqn").alias("key"))) \
        .select(F.col("text_hash").alias("_text_hash"), F.lit(True).alias("_obj"))
    t = tickets.select(F.upper("ticket_key").alias("ticket_key")).distinct().withColumn("has_ticket", F.lit(True))
    db, sch = F.upper(F.coalesce("database_name", F.lit(""))), F.upper(F.coalesce("schema_name", F.lit("")))
    whole_db = by_schema.where("_sch = ''").select(F.col("_db").alias("_db2"), F.lit(True).alias("_near2"))
    j = (ch.join(t, "ticket_key", "left").join(by_ticket, F.col("ticket_key") == F.col("_own"), "left")
         .join(in_tag, F.xxhash64(tag) == F.col("_tag_hash"), "left").join(in_text, F.xxhash64(text) == F.col("_text_hash"), "left")
         .join(by_schema, (db == F.col("_db")) & (sch == F.col("_sch")), "left").join(whole_db, db == F.col("_db2"), "left"))
    how = (F.when(F.col("_ticketed"), "ticket").when(F.col("_tag"), "commit").when(F.col("_obj"), "object")
           .when(F.col("_near") | F.col("_near2"), "schema"))
    hc, ht = how.isNotNull(), F.coalesce("has_ticket", F.lit(False))
    state = (F.when(hc & ht, "Reconciled").when(hc, "Commit without ticket").when(ht, "Ticket without commit")
             .otherwise("Unmatched drift"))
    return j.select("query_id", "start_time", "user_name", "change_family", "object_fqn", "ticket_key", how.alias("commit_match"),
                    hc.alias("has_commit"), ht.alias("has_ticket"), state.alias("reconciliation_state"))


def change_timeline(ch: DataFrame, commits: DataFrame, tickets: DataFrame) -> DataFrame:
    """CHG-7: events per day and source (observed, commits, tickets)."""
    a = ch.groupBy(F.to_date("start_time").alias("event_date")).agg(F.count(F.lit(1)).alias("events")) \
        .withColumn("source", F.lit("observed"))
    b = commits.groupBy(F.to_date("committed_at").alias("event_date")).agg(F.count(F.lit(1)).alias("events")) \
        .withColumn("source", F.lit("source_control"))
    c = tickets.groupBy(F.to_date("opened_at").alias("event_date")).agg(F.count(F.lit(1)).alias("events")) \
        .withColumn("source", F.lit("tickets"))
    return a.unionByName(b).unionByName(c)


def object_usage(access: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """CHG-9: per object: statements, users and roles that read it (exploded
    access history)."""
    from opslens.operators.security import ACCESS_SCHEMA
    a = access.filter(lookback("query_start_time", as_of, days))
    x = a.select("query_id", "user_name", "role_name",
                 F.explode(F.from_json("direct_objects_accessed", ACCESS_SCHEMA)).alias("o"))
    return (x.groupBy(F.upper("o.objectName").alias("object_fqn"))
            .agg(F.countDistinct("query_id").alias("query_count"), F.countDistinct("user_name").alias("unique_users"),
                 F.countDistinct("role_name").alias("unique_roles")))


def impact_score(usage: DataFrame, dependents: DataFrame, tier: Column, key: str = "object_fqn") -> DataFrame:
    """CHG-10: additive impact score (queries, users, dependents) with a tier
    multiplier, severity."""
    j = usage.join(dependents, key, "left")
    qc, uu = F.col("query_count"), F.col("unique_users")
    dep = F.coalesce("dependent_objects", F.lit(0))
    base = (F.when(qc > 1000, 35).when(qc > 100, 20).when(qc > 10, 10).otherwise(0)
            + F.when(uu > 20, 20).when(uu > 5, 10).otherwise(0)
            + F.when(dep > 10, 25).when(dep > 3, 15).when(dep > 0, 5).otherwise(0))
    score = (F.when(tier == "Tier 0", F.least(F.lit(100), F.floor(base * 1.5)))
             .when(tier == "Tier 1", F.least(F.lit(100), F.floor(base * 1.2))).otherwise(base)).cast("int")
    sev = F.when(score >= 75, "Critical").when(score >= 50, "High").when(score >= 25, "Medium").otherwise("Low")
    return j.select("object_fqn", "query_count", "unique_users", "unique_roles", dep.alias("dependent_objects"),
                    tier.alias("database_tier"), score.alias("impact_score"), sev.alias("severity"))


def control_readiness(ch: DataFrame, environment: Column) -> DataFrame:
    """CHG-11: per environment: changes, ticketed share, unmatched drift."""
    g = ch.groupBy(environment.alias("environment")).agg(
        F.count(F.lit(1)).alias("changes"), F.count_if(F.col("ticket_key") != "").alias("ticketed"),
        F.count_if(F.col("change_family") == "DESTRUCTIVE").alias("destructive"),
        F.countDistinct("user_name").alias("actors"))
    pct = rounded(F.col("ticketed") * 100.0 / F.col("changes"), 1)
    return g.withColumn("ticketed_pct", pct).withColumn(
        "readiness", F.when(pct >= 90, "Controlled").when(pct >= 50, "Partial").otherwise("Uncontrolled"))
