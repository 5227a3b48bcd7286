"""As-of join against a plain search: ties, nulls, carry-over, hot keys."""

import random
from datetime import datetime, timedelta

from opslens.operators.asof import last_before


def test_last_event_before_each_row(spark):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)

    def when():
        return start + timedelta(minutes=rng.randrange(0, 60 * 30, 7))

    users = ["hot"] * 6 + ["a", "b", None]
    left = [(i, rng.choice(users), None if rng.random() < 0.05 else when()) for i in range(400)]
    right = [(rng.choice(users), None if rng.random() < 0.05 else when(), rng.choice(["x", "y", "z", None])) for _ in range(120)]
    a = spark.createDataFrame(left, "id int, u string, t timestamp_ntz")
    b = spark.createDataFrame(right, "u string, s timestamp_ntz, v string")
    want = {}
    for i, u, t in left:
        found = [(s, v) for k, s, v in right if None not in (u, t, k, s, v) and k == u and s <= t]
        want[i] = max(found)[1] if found else None
    for bucket in ("HOUR", "DAY", "MINUTE"):
        out = last_before(a, b, "u", "t", "s", "v", "found", bucket)
        assert out.columns == ["id", "u", "t", "found"]
        assert {r.id: r.found for r in out.collect()} == want
    assert last_before(a.limit(0), b, "u", "t", "s", "v", "found").count() == 0
    assert {r.found for r in last_before(a, b.limit(0), "u", "t", "s", "v", "found").collect()} == {None}
