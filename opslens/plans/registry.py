"""Registry of named queries: a Spark builder plus its DuckDB oracle.

A plan module declares::

    @register("cost_anomalies", "warehouse_metering", sql=\"\"\"SELECT ...\"\"\")
    def _(spark, sf_dir): ...

The SQL is written against the source-view names; the projections of the
driver tables are prepended as CTEs (:func:`opslens.sources.testviews.with_views`).
``sql=None`` marks an operator that is not SQL-expressible (rows-only check).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opslens.sources.testviews import with_views

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}
TAGS: dict[str, str] = {}


def _split_call(sql: str, start: int) -> tuple[list[str], int]:
    """Arguments of the call whose '(' is at ``start``; returns (args, end)."""
    depth, args, cur, i, quote = 0, [], [], start, None
    while i < len(sql):
        ch = sql[i]
        if quote:
            cur.append(ch)
            if ch == quote:
                quote = None
        elif ch == "'":
            quote = ch
            cur.append(ch)
        elif ch == "(":
            depth += 1
            if depth > 1:
                cur.append(ch)
        elif ch == ")":
            depth -= 1
            if depth == 0:
                args.append("".join(cur))
                return args, i
            cur.append(ch)
        elif ch == "," and depth == 1:
            args.append("".join(cur))
            cur = []
        else:
            cur.append(ch)
        i += 1
    raise ValueError("unbalanced parentheses in oracle SQL")


def nudge_rounds(sql: str) -> str:
    """Rewrite ``round(x, d)`` to ``round(x + sign(x) * 1e-(6+d), d)``: the
    same near-tie rule as :func:`opslens.functions.exprs.rounded`."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        args, end = _split_call(sql, j + 5)
        x = nudge_rounds(args[0])
        d = int(args[1].strip()) if len(args) > 1 else 0
        out.append(sql[i:j])
        out.append(f"round(({x}) + sign({x}) * 1e-{6 + d}, {d})")
        i = end + 1


def bigint_counts(sql: str) -> str:
    """DuckDB's ``count_if`` returns HUGEINT; Spark's returns bigint."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("count_if(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            out.append(sql[i:j + 9])
            i = j + 9
            continue
        args, end = _split_call(sql, j + 8)
        out.append(sql[i:j])
        out.append(f"CAST(count_if({bigint_counts(args[0])}) AS BIGINT)")
        i = end + 1


def register(name: str, *views: str, sql: str | None = None, op: str = ""):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            # event times are naive (timestamp_ntz); windows, day buckets and the
            # streaming event-time casts are defined in UTC
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        build.__name__ = f"query_{name}"
        build.__doc__ = fn.__doc__
        QUERIES[name] = build
        TAGS[name] = op
        if sql is not None:
            body = bigint_counts(nudge_rounds(sql))
            ORACLES[name] = with_views(body, *views) if views else body
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so its queries register."""
    import importlib
    import pkgutil

    import opslens.plans as pkg

    for m in pkgutil.iter_modules(pkg.__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"opslens.plans.{m.name}")
