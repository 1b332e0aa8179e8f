"""Cases of many events: replayed in ranges of time, joined by their outcomes."""

import random

from riskloom.operators import review

KINDS = ["ENQUEUED", "ASSIGNED", "REQUEUED", "RESOLVED", "TIMED_OUT", "UNKNOWN", None]


def log_of(rng, case, n, times):
    weights = [2, 9, 8, rng.choice([0, 1]), rng.choice([0, 1]), 1, 1]
    return [(case, rng.choices(KINDS, weights)[0], rng.choice(["x", "y", None]), rng.randrange(times)) for _ in range(n)]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_ranges_joined_equal_one_replay(spark):
    rng = random.Random(5)
    rows = [r for k in range(12) for r in log_of(rng, f"c{k:02}", 60, 400)] + log_of(rng, "tied", 80, 3) + [(None, "ASSIGNED", "x", 1)] * 2 + [("late", "ASSIGNED", "z", None), ("late", "REQUEUED", "z", 4)]
    events = spark.createDataFrame(rows, "case_id string, event string, analyst string, us long")
    whole = rows_of(review.case_state(events.where("case_id is not null")))
    for fan in (3, 16):
        parted = rows_of(review.case_state(events.where("case_id is not null"), hot_rows=50, fan=fan))
        assert parted == whole and len(whole) == 14


def test_a_case_of_many_events(spark):
    n = 300_000
    kind = "case id % 4 when 0 then 'ASSIGNED' when 1 then 'REQUEUED' when 2 then 'ASSIGNED' else 'REQUEUED' end"
    one = spark.range(n).selectExpr("'big' as case_id", f"{kind} as event", "concat('a', id) as analyst", "id as us")
    rest = spark.range(3000).selectExpr("concat('c', id) as case_id", "'ASSIGNED' as event", "'b' as analyst", "id as us")
    got = {r.case_id: r for r in review.case_state(one.union(rest).union(spark.createDataFrame([("big", "RESOLVED", "a", n)], one.schema))).where("case_id = 'big' or case_id = 'c7'").collect()}
    assert (got["big"].status, got["big"].resolved_us, got["big"].applied) == ("RESOLVED", n, n + 1)
    assert got["big"].assigned_us is None and got["big"].analyst is None
    assert (got["c7"].status, got["c7"].assigned_us) == ("IN_REVIEW", 7)
