"""Column-expression helpers shared by the operators.

All of these return JVM-side ``Column`` expressions (no Python UDFs), so they
stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: str | Column, b: str | Column) -> Column:
    """``a / NULLIF(b, 0)``: NULL instead of an ANSI divide-by-zero error."""
    return col(a) / F.nullif(col(b), F.lit(0))


def ladder(value: str | Column, steps: Sequence[tuple[float, str]], default: str | None,
           op: str = ">=") -> Column:
    """First-match classification ladder: ``CASE WHEN v >= t1 THEN l1 ...``."""
    v = col(value)
    out = None
    for threshold, label in steps:
        cond = v >= threshold if op == ">=" else (v > threshold if op == ">" else
                                                  (v <= threshold if op == "<=" else v < threshold))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


# Severity order used to sort findings (fixed values).
SEVERITY_ORDER = ["Critical", "High", "Medium", "Low", "Watch"]


def severity_rank(c: str | Column) -> Column:
    """Rank of a severity label, case-insensitive; unknown labels last."""
    u = F.upper(col(c))
    out = F.when(u == "CRITICAL", 0).when(u == "HIGH", 1).when(u == "MEDIUM", 2) \
        .when(u.isin("LOW", "WATCH", "WARNING"), 3)
    return out.otherwise(4)


def rounded(c: str | Column, digits: int = 0) -> Column:
    """Round half away from zero, treating near-ties as ties.

    The warehouse computes in decimals, so an average of 68.835 is a true tie
    and rounds up. In doubles the same value is 68.83499... or 68.83500...
    depending on summation order, and Spark's ``round`` (shortest decimal
    string) and DuckDB's (scaled binary value) then disagree. Scaling, adding
    a nudge of 1e-6 units of the last digit away from zero, and rounding
    settles every near-tie the decimal way in both engines; the oracle SQL
    applies the same rule (:func:`opslens.plans.registry.nudge_rounds`)."""
    p = float(10 ** digits)
    y = col(c).cast("double") * F.lit(p)
    return F.round(y + F.signum(y) * F.lit(1e-6)) / F.lit(p)


def blank_to_null(c: str | Column) -> Column:
    v = col(c)
    return F.when(F.trim(v) == "", F.lit(None).cast("string")).otherwise(v)


def one_row_total(df: DataFrame, value: str, alias: str = "_grand_total") -> DataFrame:
    """Attach the grand total of ``value`` to every row (WIN-8).

    Spark plans ``sum(x) OVER ()`` as a single-partition window; a one-row
    aggregate cross-joined back is a broadcast of exactly one row instead.
    """
    total = df.agg(F.sum(value).alias(alias))
    return df.crossJoin(F.broadcast(total))


def sorted_distinct_list(c: str | Column, sep: str = ", ", limit: int | None = None) -> Column:
    """``LISTAGG(DISTINCT c, sep) WITHIN GROUP (ORDER BY c)`` (AGG-10).

    ``collect_set`` keeps one copy per distinct value and merges map-side.
    """
    arr = F.array_sort(F.collect_set(col(c)))
    if limit is not None:
        arr = F.slice(arr, 1, limit)
    return F.concat_ws(sep, arr)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   cols: Sequence[str] | None = None) -> DataFrame:
    """Latest row per key (WIN-1 / SRC-10) as an aggregate, not a window.

    ``max(struct(order..., cols...))`` is a partial (map-side) aggregate, so a
    hot key does not pull all its rows into one task the way
    ``row_number() OVER (PARTITION BY key)`` would. Ties on ``order`` are broken
    by the remaining columns, which keeps the result deterministic.
    """
    cols = [c for c in (cols or df.columns) if c not in keys]
    rest = [c for c in cols if c not in order]
    packed = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])).alias("_m")
    out = df.groupBy(*keys).agg(packed)
    return out.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in list(order) + rest if c in cols])


def pctl(c: str | Column, p: float, exact: bool = True) -> Column:
    """Percentile with linear interpolation (``PERCENTILE_CONT``).

    Exact ``percentile`` keeps one counter per *distinct* value and merges
    partial buffers, so memory is bounded by distinct values, not rows. For
    continuous measures at very large scale pass ``exact=False`` for the
    bounded-memory sketch.
    """
    if exact:
        return F.percentile(col(c), F.lit(p))
    return F.percentile_approx(col(c), p, 10000)


def page(limit: int | None, *order):
    """For ``DataFrame.transform``: the whole frame, or its first ``limit`` rows
    by ``order`` where a caller asks for a page of it."""
    return lambda df: df if limit is None else df.orderBy(*order).limit(limit)
