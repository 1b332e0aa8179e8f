"""Tables that change in steps, lists that are tables."""

import uuid

import pytest
from pyspark.sql import functions as F

from riskloom.operators import graph, lists, profiles, rules
from riskloom.plans.adapters import Tables
from riskloom.plans.decisions import RULE_LISTS_SQL, _rule_rows
from riskloom.sources import versioned
from riskloom.streaming import jobs


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def people(spark, ids, status, n):
    kind = "user_id string, account_status string, fraud_flag_count long, device_count int, country_of_residence string"
    return spark.createDataFrame([(f"U{i}", status, n, i % 5, None if i % 3 else "FR") for i in ids], kind)


def test_upsert_rewrites_the_buckets_it_touches(spark, root):
    current, incoming = people(spark, range(300), "Active", 1), people(spark, [5, 7, 900], "Review", 2)
    versioned.create(current, root, "user_id", 32)
    before = versioned.manifest(spark, root)["paths"]
    touched = versioned.upsert(incoming, root, profiles.upsert_profiles)
    after = versioned.manifest(spark, root)["paths"]
    assert 1 <= len(touched) <= 3 and {int(b) for b in after if after[b] != before.get(b)} == set(touched)
    want = rows_of(profiles.upsert_profiles(current, incoming))
    assert rows_of(versioned.read(spark, root).select(*current.columns)) == want
    versioned.upsert(incoming, root, profiles.upsert_profiles)
    assert rows_of(versioned.read(spark, root).select(*current.columns)) == want  # once more changes nothing
    assert versioned.upsert(incoming.limit(0), root, profiles.upsert_profiles) == []


def test_a_crash_before_the_manifest_leaves_the_old_table(spark, root, monkeypatch):
    current = people(spark, range(50), "Active", 1)
    versioned.create(current, root, "user_id", 8)
    with monkeypatch.context() as m:
        m.setattr(versioned, "publish", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            versioned.upsert(people(spark, range(9), "Review", 2), root, profiles.upsert_profiles)
    assert rows_of(versioned.read(spark, root)) == rows_of(current)
    state = versioned.manifest(spark, root)
    versioned.publish(spark, root, state, **{k: v for k, v in state.items() if k != "number"})
    with pytest.raises(RuntimeError):  # a second writer of the same number
        versioned.publish(spark, root, state)


def test_counters_of_a_stream(spark, sf_dir, root):
    rows = Tables(spark, sf_dir)("v_txn").withColumn("ts", F.timestamp_micros("us")).cache()
    update = jobs.graph_updater(root, {"USES": ("user_id", "device_id")}, every=2)
    parts = [rows.where(F.col("transaction_id") % 5 == k) for k in range(5)]
    for k in range(5):
        update(parts[k], k)
        update(parts[k], k)  # run twice: also after a snapshot holds it
    assert versioned.manifest(spark, f"{root}/counters")["upto"] == 3
    update(parts[1], 1)
    found = {r.account: (r.transactions, r.fraud, float(r.amount)) for r in jobs.counters_so_far(spark, root).collect()}
    history = {r.user_id: (r.total, r.fraud) for r in graph.account_history(rows).collect()}
    amounts = dict(rows.groupBy("user_id").agg(F.sum("amount")).collect())
    assert {k: v[:2] for k, v in found.items()} == history
    assert all(v[2] == pytest.approx(amounts[k]) for k, v in found.items())
    assert rows_of(jobs.edges_so_far(spark, root)) == rows_of(graph.transaction_edges(rows, {"USES": ("user_id", "device_id")}).select("src", "dst", "rel_type", "transaction_id"))


def test_long_lists_by_a_bloom_filter(spark, sf_dir):
    rows = _rule_rows(Tables(spark, sf_dir)).cache()
    held = Tables(spark, sf_dir).sql(RULE_LISTS_SQL)
    many = spark.range(1_000_000).select(F.lit("stolen_cards").alias("list"), F.concat(F.lit("none_"), "id").alias("entity"))
    long = held.select("list", "entity").unionAll(many)
    columns = rules.list_columns(None)
    short = lists.listed(rows, held, columns)
    made = [f"_in_{n}" for n in columns]
    for bits in (lists.BITS, 1 << 12):  # the second lets nearly all pass
        out = lists.listed(rows, long, columns, small=1000, bits=bits)
        assert out.columns == short.columns
        assert rows_of(out.select("transaction_id", *made)) == rows_of(short.select("transaction_id", *made))
    words = lists.bloom_filter(held, 1 << 16)
    assert len(words) == 1 << 10
    flat = spark.createDataFrame(rows.limit(20).collect(), rows.schema)
    plan = lists.listed(flat, long, columns, small=1000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "CartesianProduct" not in plan  # only of what the filter lets pass
