"""Queries that run a streaming job over the events table, to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import append_labels, shared_folder
from ..streaming import jobs
from .adapters import Tables
from .decisions import TRAIL_SQL
from .registry import query


def _stream(t: Tables) -> DataFrame:
    schema = t("events").schema
    rows = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{'events.parquet'}*")
    device = F.concat(F.lit("dev_"), F.regexp_extract("props", "[0-9]+", 0))
    return rows.select(F.col("event_id").alias("transaction_id"), F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("amount"), F.col("event_type").alias("merchant_category"), device.alias("device_id"), (F.col("event_type") == "error").cast("int").alias("is_fraud"))


@query("stream_velocity", TRAIL_SQL + " select transaction_id, user_id, count_1h, count_24h, amount_1h, amount_24h from w")
def _(t: Tables) -> DataFrame:
    return jobs.finished(jobs.trailing_stream(_stream(t)), "stream-velocity").select("transaction_id", "user_id", "count_1h", "count_24h", "amount_1h", "amount_24h")


@query("stream_velocity_warm", TRAIL_SQL + " select transaction_id, user_id, count_1h, count_24h, amount_1h, amount_24h from w where us > (select (min(us) + max(us)) // 2 from v_txn)")
def _(t: Tables) -> DataFrame:
    """The second half of the time as a stream, started from the last day of the first half."""
    rows = t("v_txn")
    half = rows.agg(F.expr("(min(us) + max(us)) div 2")).first()[0]
    stream = _stream(t).where(F.unix_micros("ts") > half)
    return jobs.finished(jobs.trailing_stream(stream, warm=jobs.warm_events(rows, half)), "stream-warm").select("transaction_id", "user_id", "count_1h", "count_24h", "amount_1h", "amount_24h")


@query(
    "stream_hopping",
    """select start, user_id, count(*) as n, round(sum(amount), 4) as amount from (select user_id, amount, (us // 3600000000 - k) * 3600 as start from v_txn, range(0, 24) r(k))
where (start + 86400) * 1000000 <= (select max(us) - 3600000000 from v_txn) group by 1, 2""",
)
def _(t: Tables) -> DataFrame:
    out = jobs.finished(jobs.hopping_totals(_stream(t)), "stream-hopping")
    return out.select(F.unix_seconds("window.start").alias("start"), "user_id", "n", F.round("amount", 4).alias("amount"))


@query("stream_scoring", "select final_decision, count(*) as n from (select case when amount < 5 then 'LEGIT' when s >= 0.85 then 'FRAUD' when s >= 0.5 then 'UNCERTAIN' else 'LEGIT' end as final_decision from (select *, least(1.0, cast((transaction_id * 7919) % 10000 as double) / 10000.0 * 0.7 + is_fraud * 0.3) as s from v_txn)) group by 1")
def _(t: Tables) -> DataFrame:
    kinds = {"card_limit": "double", "card_number_hash": "string", "email": "string", "email_domain": "string", "billing_country": "string", "ip_country": "string", "country_code": "string", "is_tor": "string", "tor_exit_node": "string", "transactions_last_minute": "bigint", "transactions_last_hour": "bigint", "failed_attempts_last_hour": "bigint", "account_age_hours": "double", "is_first_transaction": "boolean", "transaction_hour": "int", "transaction_lat": "double", "transaction_lon": "double", "last_transaction_lat": "double", "last_transaction_lon": "double", "transaction_time": "timestamp", "last_transaction_time": "timestamp"}
    rows = _stream(t).withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
    rows = rows.withColumn("fraud_score", F.least(F.lit(1.0), ((F.col("transaction_id") * 7919) % 10000).cast("double") / 10000.0 * 0.7 + F.col("is_fraud") * 0.3))
    block = t("v_txn").where("transaction_id % 50 = 0").select(F.lit("device").alias("entity_type"), F.col("device_id").alias("entity"))
    scored = jobs.score_stream(rows, block).select("transaction_id", "final_decision", "blocked")
    return jobs.finished(scored, "stream-scores").groupBy("final_decision").agg(F.count("*").alias("n"))


@query(
    "stream_sla",
    """with recursive e as (select concat('C', user_id) as case_id, us // 1000 as ms, case when merchant_category = 'purchase' then 'RESOLVED' else 'ENQUEUED' end as event,
  row_number() over (partition by user_id order by us // 1000, case when merchant_category = 'purchase' then 1 else 0 end) as n from v_txn),
s as (select distinct case_id, 0::bigint as n, null::bigint as due, null::bigint as alarm from e
  union all select s.case_id, e.n, case when event = 'RESOLVED' then null when due is null or ms > due then ms + 3600000 else due end, case when ms > due then due end from s join e on e.case_id = s.case_id and e.n = s.n + 1),
z as (select case_id, due from s qualify row_number() over (partition by case_id order by n desc) = 1)
select case_id, alarm as due_ms from s where alarm is not null union all select case_id, due from z where due <= (select max(us) // 1000 - 600000 from v_txn)""",
)
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("merchant_category") == "purchase", "RESOLVED").otherwise("ENQUEUED")
    rows = _stream(t).select(F.concat(F.lit("C"), "user_id").alias("case_id"), kind.alias("event"), "ts", F.lit(60).alias("sla_minutes"))
    return jobs.finished(jobs.sla_alarms(rows), "stream-sla")


def _graph(t: Tables) -> str:
    """A folder with the edges and counters of the whole stream."""
    root = f"{shared_folder(t.spark)}/stream-graph-{uuid.uuid4().hex}"
    update = jobs.graph_updater(root, {"USES": ("user_id", "device_id"), "AT": ("user_id", "merchant_category")})
    _stream(t).writeStream.foreachBatch(update).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return root


@query("stream_graph", "select rel_type, count(*) as n from (select distinct user_id, device_id, 'USES' as rel_type, transaction_id from v_txn union all select distinct user_id, merchant_category, 'AT', transaction_id from v_txn) group by 1")
def _(t: Tables) -> DataFrame:
    return jobs.edges_so_far(t.spark, _graph(t)).groupBy("rel_type").agg(F.count("*").alias("n"))


@query("stream_counters", "select user_id as account, count(*) as transactions, cast(sum(is_fraud) as bigint) as fraud, round(sum(amount), 4) as amount, min(us) as first_us, max(us) as last_us from v_txn group by 1")
def _(t: Tables) -> DataFrame:
    return jobs.counters_so_far(t.spark, _graph(t)).withColumn("amount", F.round(F.col("amount").cast("double"), 4))


@query("stream_labels", "select transaction_id, is_fraud as label from v_txn")
def _(t: Tables) -> DataFrame:
    labels = jobs.without_duplicates(_stream(t)).select("transaction_id", F.col("is_fraud").alias("label"))
    out = jobs.finished(labels, "stream-labels")
    root = f"{shared_folder(t.spark)}/labels-{uuid.uuid4().hex}"
    append_labels(out, root)
    return t.spark.read.schema("transaction_id bigint, label int").json(root)
