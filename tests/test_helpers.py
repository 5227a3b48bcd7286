"""Expression helpers: rounding rule, boundary counting, weekday, oracle rewrites."""

from datetime import datetime

from pyspark.sql import functions as F

from opslens.functions.exprs import ladder, rounded, safe_div, severity_rank
from opslens.functions.timeutil import boundaries, dow0
from opslens.plans.registry import bigint_counts, nudge_rounds


def test_rounded_settles_near_ties_away_from_zero(spark):
    df = spark.createDataFrame([(68.835,), (2.25,), (-2.25,), (1.005,), (0.1 + 0.2,)], "x double")
    got = [r[0] for r in df.select(rounded("x", 2)).collect()]
    assert got == [68.84, 2.25, -2.25, 1.01, 0.3]
    got1 = [r[0] for r in df.select(rounded("x", 1)).collect()]
    assert got1 == [68.8, 2.3, -2.3, 1.0, 0.3]


def test_safe_div_returns_null_on_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_div("a", "b")).collect()] == [None, 1.5]


def test_boundaries_count_crossed_units(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 59), datetime(2024, 1, 1, 1, 1))], "a timestamp_ntz, b timestamp_ntz")
    r = df.select(boundaries("HOUR", "a", "b").alias("h"), boundaries("DAY", "a", "b").alias("d"),
                  F.timestamp_diff("HOUR", "a", "b").alias("elapsed")).first()
    assert (r.h, r.d, r.elapsed) == (1, 0, 0)


def test_dow0_sunday_is_zero(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 7),), (datetime(2024, 1, 8),)], "d timestamp_ntz")
    assert [r[0] for r in df.select(dow0("d")).collect()] == [0, 1]


def test_ladder_and_severity_rank(spark):
    df = spark.createDataFrame([(3.0,), (2.0,), (1.4,), (1.39,)], "z double")
    got = [r[0] for r in df.select(ladder("z", [(3.0, "Critical"), (2.0, "High"), (1.4, "Medium")], "Normal")).collect()]
    assert got == ["Critical", "High", "Medium", "Normal"]
    s = spark.createDataFrame([("critical",), ("High",), ("x",)], "s string")
    assert [r[0] for r in s.select(severity_rank("s")).collect()] == [0, 1, 4]


def test_oracle_rewrites():
    assert nudge_rounds("SELECT round(a, 2) FROM t") == "SELECT round((a) + sign(a) * 1e-8, 2) FROM t"
    assert nudge_rounds("SELECT ground(x)") == "SELECT ground(x)"
    assert bigint_counts("count_if(x > 1)") == "CAST(count_if(x > 1) AS BIGINT)"


def test_latest_per_key_and_distinct_list(spark):
    from opslens.functions import exprs as ex
    df = spark.createDataFrame([("a", 1, "old"), ("a", 3, "new"), ("b", 2, "only"), ("a", 2, "mid")],
                               "k string, t int, v string")
    got = {r.k: r.v for r in ex.latest_per_key(df, ["k"], ["t"], ["v"]).collect()}
    assert got == {"a": "new", "b": "only"}
    lst = df.groupBy().agg(ex.sorted_distinct_list("k").alias("l")).first().l
    assert lst == "a, b"


def test_pctl_exact_interpolates(spark):
    from opslens.functions import exprs as ex
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4]], "x double")
    assert df.agg(ex.pctl("x", 0.5).alias("p")).first().p == 2.5
    assert df.agg(ex.pctl("x", 0.5, exact=False).alias("p")).first().p in (2.0, 3.0)


def test_lookback_window_and_seconds_between(spark):
    from opslens.functions.timeutil import between_ts, lookback, seconds_between, trunc
    as_of = datetime(2024, 1, 31)
    rows = [(datetime(2024, 1, 23, 23, 59), datetime(2024, 1, 24, 0, 0, 30)), (datetime(2024, 1, 24), datetime(2024, 1, 24)),
            (datetime(2024, 1, 31), datetime(2024, 1, 31, 1))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    out = df.select(lookback("a", as_of, 7).alias("in7"), lookback("a", as_of, 7, end=as_of).alias("settled"),
                    between_ts("a", datetime(2024, 1, 24), as_of).alias("btw"), seconds_between("a", "b").alias("s"),
                    trunc("hour", "b").alias("h")).collect()
    assert [r.in7 for r in out] == [False, True, False]
    assert [r.settled for r in out] == [False, True, False] and [r.btw for r in out] == [False, True, False]
    assert [r.s for r in out] == [90.0, 0.0, 3600.0]
    assert out[0].h == datetime(2024, 1, 24)
