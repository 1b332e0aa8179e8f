"""Users with many rows in slices of time give the rows of plain windows."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import patterns, velocity
from riskloom.plans.adapters import Tables


@pytest.fixture(scope="module")
def skewed(spark, sf_dir):
    """A user with a third of all rows, ties in time, a NULL amount, and gaps longer than a frame."""
    rows = Tables(spark, sf_dir)("v_txn")
    n = F.col("transaction_id")
    user = F.when(n % 3 == 0, "big").otherwise(F.col("user_id"))
    at = F.when(n % 10 == 0, F.col("us") - F.col("us") % velocity.HOUR).when(n % 7 == 0, F.col("us") + 100 * velocity.DAY).otherwise(F.col("us"))
    amount = F.when(n % 101 == 0, None).otherwise(F.col("amount"))
    return rows.withColumns({"user_id": user, "us": at, "amount": amount}).cache()


def values(df, columns):
    return {r.transaction_id: tuple(r[1:]) for r in df.select("transaction_id", *columns).collect()}


def same(a, b):
    """Equal but for the order of floating-point sums."""
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k], strict=True):
            assert x == y or x == pytest.approx(y, rel=1e-9, abs=1e-9), k
    return True


def test_block_in_slices(skewed):
    plain = velocity.velocity_block(skewed)
    made = [c for c in plain.columns if c not in skewed.columns]
    assert len(made) == 16
    cut = velocity.velocity_block(skewed, hot_rows=20)
    assert cut.columns == plain.columns and same(values(cut, made), values(plain, made))


def test_trailing_in_slices(skewed):
    spans = {"1h": velocity.HOUR, "24h": velocity.DAY}
    made = ["count_1h", "count_24h", "amount_1h", "amount_24h"]
    cut = velocity.trailing(skewed, spans, hot_rows=20)
    assert same(values(cut, made), values(velocity.trailing(skewed, spans), made))


def test_a_hot_user_is_many_keys(skewed):
    rows, keys = velocity.sliced(skewed, velocity.DAY, hot_rows=20)
    assert keys == ["user_id", "_slice"]
    big = rows.where("user_id = 'big'").groupBy("_slice").count()
    n = skewed.where("user_id = 'big'").count()
    assert big.count() > 30 and big.agg(F.max("count")).first()[0] < n / 10
    assert rows.where("_home").count() == skewed.count()


def test_patterns_in_slices(skewed, monkeypatch):
    made = lambda: [values(patterns.velocity_attack(skewed, 3, 86400, 200.0), ["pattern_velocity"]), values(patterns.card_testing(skewed, 2, 2880, 50.0, 100.0), ["pattern_card_testing"])]
    plain = made()
    monkeypatch.setattr(velocity.sliced, "__defaults__", ("user_id", "us", 20, 4))
    assert made() == plain
