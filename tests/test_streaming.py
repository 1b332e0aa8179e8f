"""Streams give what the batch form gives, over several micro-batches too."""

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskloom.operators import velocity
from riskloom.plans.adapters import Tables
from riskloom.streaming import jobs


def in_batches(spark, rows, folder, n):
    """rows as a stream of n micro-batches in order of time."""
    timed = rows.withColumn("ts", F.timestamp_micros("us")).orderBy("us")
    kept = timed.toPandas()
    for k in range(n):
        part = kept.iloc[k * len(kept) // n : (k + 1) * len(kept) // n]
        spark.createDataFrame(part, timed.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def trail(df):
    return {r.transaction_id: (r.count_1h, r.count_24h, r.amount_1h, r.amount_24h) for r in df.collect()}


def test_warm_start_and_a_user_with_a_third_of_the_rows(spark, sf_dir, tmp_path):
    rows = Tables(spark, sf_dir)("v_txn").where("cast(user_id as int) % 3 = 0 or transaction_id % 3 = 0")
    rows = rows.withColumn("user_id", F.when(F.col("transaction_id") % 3 == 0, "big").otherwise(F.col("user_id"))).cache()
    half = rows.agg(F.expr("(min(us) + max(us)) div 2")).first()[0]
    want = trail(velocity.trailing(rows, {"1h": velocity.HOUR, "24h": velocity.DAY}).where(F.col("us") > half))
    stream = in_batches(spark, rows.where(F.col("us") > half), str(tmp_path / uuid.uuid4().hex), 3)
    assert trail(jobs.finished(jobs.trailing_stream(stream, warm=jobs.warm_events(rows, half)), "test-warm")) == want


def test_frames_of_a_hot_user_are_small(spark):
    at = np.sort(np.random.default_rng(2).integers(0, 30 * jobs.HOUR, 5000))
    cents = np.random.default_rng(3).integers(1, 10**6, 5000)
    n, total = jobs._trailing(at, cents, at, jobs.HOUR)
    for k in (0, 17, 2500, 4999):
        own = (at > at[k] - jobs.HOUR) & (at <= at[k])
        assert n[k] == len(set(at[own])) and total[k] == round(int(cents[own].sum()) / jobs.PLACES, 2)


def test_trailing_windows_over_many_batches(spark, sf_dir, tmp_path):
    rows = Tables(spark, sf_dir)("v_txn").where("cast(user_id as int) % 5 = 0")
    want = {r.transaction_id: (r.count_1h, r.count_24h, r.amount_1h, r.amount_24h) for r in velocity.trailing(rows, {"1h": velocity.HOUR, "24h": velocity.DAY}).collect()}
    timed = rows.withColumn("ts", F.timestamp_micros("us")).orderBy("us")
    folder = str(tmp_path / uuid.uuid4().hex)
    kept = timed.toPandas()
    for k in range(3):
        part = kept.iloc[k * len(kept) // 3 : (k + 1) * len(kept) // 3]
        spark.createDataFrame(part, timed.schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = jobs.finished(jobs.trailing_stream(stream), "test-velocity")
    assert {r.transaction_id: (r.count_1h, r.count_24h, r.amount_1h, r.amount_24h) for r in out.collect()} == want


class HeldState:
    """A map and a value of a user's state, with the writes counted."""

    def __init__(self):
        self.map, self.value, self.writes = {}, None, 0

    containsKey = lambda self, k: k in self.map
    getValue = lambda self, k: self.map.get(k)
    keys = lambda self: list(self.map)
    iterator = lambda self: list(self.map.items())
    exists = lambda self: self.value is not None
    get = lambda self: self.value
    removeKey = lambda self, k: self.map.pop(k)
    registerTimer = lambda self, at: None

    def updateValue(self, k, v):
        self.map[k], self.writes = v, self.writes + 1

    def update(self, v):
        self.value = v


def test_a_month_in_one_batch_writes_the_last_hours_only():
    rng = np.random.default_rng(4)
    at = np.sort(rng.integers(0, 30 * jobs.DAY, 800))
    rows = pd.DataFrame({"transaction_id": np.arange(800), "at": at, "amount": rng.integers(1, 10**6, 800) / 100})
    made = []
    for cuts in ((0, 800), (0, 300, 301, 560, 800)):
        windows, hours, newest = jobs.TrailingWindows(), HeldState(), HeldState()
        windows.hours, windows.newest, windows.handle = hours, newest, HeldState()
        out = [f for a, b in zip(cuts, cuts[1:]) for f in windows.handleInputRows(("u",), iter([rows[a:b]]), None)]
        assert hours.writes <= 27 * (len(cuts) - 1) and len(hours.map) <= 27
        made.append(pd.concat(out, ignore_index=True))
    assert made[0].equals(made[1])
    for k in (0, 300, 799):
        own = (at > at[k] - jobs.DAY) & (at <= at[k])
        assert made[0]["count_24h"][k] == len(set(at[own])) and made[0]["amount_24h"][k] == round(rows["amount"][own].sum(), 2)


def test_state_is_written_as_changes(spark, tmp_path):
    import glob

    rows = [(k, f"u{k % 3}", 1.0 * k, f"2024-01-0{1 + k % 4} 10:00:00") for k in range(12)]
    spark.createDataFrame(rows, "transaction_id long, user_id string, amount double, at string").selectExpr("transaction_id", "user_id", "amount", "to_timestamp(at) as ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("transaction_id long, user_id string, amount double, ts timestamp").parquet(f"{tmp_path}/in")
    name = f"changes-{tmp_path.name}"
    assert jobs.finished(jobs.hopping_totals(stream), name).count() > 0
    assert glob.glob(f"{jobs.shared_folder(spark)}/{name}-*/checkpoint/state/**/*.changelog", recursive=True)
    assert all(spark.conf.get(k, None) != v for k, v in jobs.STATE.items() if "trackTotal" in k)


def test_hopping_totals_hold_hours_and_not_windows(spark, tmp_path):
    """The windows of the built-in aggregate, with rows that are late, NULL and NaN, from a state of one row a user."""
    import json

    hour, base = 3600, 1_704_067_200
    times = [[100, 5000, 10 * hour], [36 * hour, 9 * hour + 1, 60], [30 * hour, 14 * hour, 49 * hour], [50 * hour, 26 * hour], [70 * hour - 1, 26 * hour, 50 * hour], [110 * hour, 50 * hour]]
    amounts, kind, seen = [1.25, None, float("nan"), 3.5, 2.0], "user_id string, amount double, s long", 0
    for k, batch in enumerate(times):
        rows = [(user, amounts[(j + k) % 5] if user != "w" else None, base + at) for user in ("u", None, "w") for j, at in enumerate(batch) if user or j != 1]
        spark.createDataFrame([*rows, ("v", 1.0, None)], kind).selectExpr("user_id", "amount", "timestamp_seconds(s) as ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id string, amount double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    plain = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "24 hours", "1 hour"), "user_id").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    got = lambda df, name: sorted(map(str, jobs.finished(df, name).selectExpr("window.start", "window.end", "user_id", "n", "amount").collect()))
    ours, want = got(jobs.hopping_totals(stream), f"hours-{tmp_path.name}"), got(plain, f"plain-{tmp_path.name}")
    assert len(ours) == len(set(ours)) > 150 and not set(ours) ^ set(want)

    query = jobs.hopping_totals(spark.readStream.schema(stream.schema).parquet(f"{tmp_path}/in"))
    before = {k: spark.conf.get(k, None) for k in jobs.STATE}
    try:
        for k, v in jobs.STATE.items():
            spark.conf.set(k, v)
        run = query.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # Three users, a mark and two entries of a timer for each group, where there were 24 windows a row.
    assert max(json.loads(p.json)["stateOperators"][0]["numRowsUpdated"] for p in run.recentProgress) <= 15
