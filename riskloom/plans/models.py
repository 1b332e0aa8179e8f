"""Queries of baselines, drift, saved models, the quality report and what goes in and out of
files, and of ledger steps that stand alone."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import graph, lists, quality, tables
from ..operators import ml as M
from ..operators import review as R
from ..sources import io
from .adapters import Tables
from .ledger import DECISIONS_SQL, FEATURES, NORMAL, REPLAY_SQL, _filled
from .registry import query
from .tables import LISTS_SQL, _stats_sql

BASE = ("avg_transaction_amount", "transaction_count", "total_lifetime_value")


def _folder(t: Tables, name: str) -> str:
    return f"{io.shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


# Drift.
DRIFT_SQL = """l as (select 'amount' as feature, amount as x, (transaction_id % 2) as side from v_txn union all select 'value', case when transaction_id % 2 = 0 then amount else amount * 1.3 end, transaction_id % 2 from v_txn),
b as (select feature, x, sum(1 - side) as a, sum(side) as b from l group by 1, 2),
g as (select feature, abs(sum(a) over w / sum(a) over e - sum(b) over w / sum(b) over e) as gap, sum(a) over e as na, sum(b) over e as nb from b window w as (partition by feature order by x), e as (partition by feature)),
d as (select feature, max(gap) as d, max(na) as na, max(nb) as nb from g group by 1), m as (select *, d * sqrt(na * nb / (na + nb)) as lam from d),
p as (select feature, least(1, greatest(0, 2 * (select sum(case when k % 2 = 1 then 1.0 else -1.0 end * exp(-2.0 * k * k * lam * lam)) from range(1, 101) r(k)))) as p_value from m)"""


@query("drift_report", f"with {DRIFT_SQL}, s as (select count(*) as tested, avg((p_value < 0.05)::int) as drift_score from p) select tested, drift_score, case when drift_score > 0.3 then 'high' when drift_score > 0.1 then 'moderate' else 'low' end as level from s")
def _(t: Tables) -> DataFrame:
    rows = t("v_txn")
    base = rows.where("transaction_id % 2 = 0").select("amount", F.col("amount").alias("value"))
    new = rows.where("transaction_id % 2 = 1").select("amount", (F.col("amount") * 1.3).alias("value"))
    return M.drift_summary(M.ks_two_sample(base, new, ["amount", "value"]))


@query("baseline_written", " union all ".join(map(_stats_sql, BASE)))
def _(t: Tables) -> DataFrame:
    """The baseline statistics as a report, written and read again."""
    stats = tables.baseline_stats(t("v_features"), list(BASE))
    path = _folder(t, "baseline")
    io.write_report(stats, path)
    return t.spark.read.schema(stats.schema).json(path).withColumns({c: F.round(c, 4) for c in ("mean", "std", "median", "q25", "q75")})


def _normal_sql(z: str) -> str:
    """The normal distribution in SQL, by the same approximation."""
    powers = lambda terms: reduce(lambda sum_, term: f"({sum_} * {z} + {term!r}::double)", terms[1:], f"{terms[0]!r}::double")
    fraction = reduce(lambda sum_, k: f"({z} + {k} / {sum_})", (4, 3, 2, 1), f"({z} + 0.65)")
    return f"exp(-{z} * {z} / 2) * case when {z} < 7.07106781186547 then {powers(M.ABOVE)} / {powers(M.BELOW)} else 1 / {fraction} / 2.506628274631::double end"


@query(
    "drift_baseline",
    "with b as ("
    + " union all ".join(f"select '{c}' as feature, avg(cast({c} as double)) as mean, stddev_pop(cast({c} as double)) as std from v_features" for c in BASE)
    + "), l as ("
    + " union all ".join(f"select '{c}' as feature, cast({c} as double) as x from v_features where account_age_days > 60" for c in BASE)
    + f"""), g as (select feature, x, count(*) as k from l where x is not null group by 1, 2),
r as (select feature, x, k, sum(k) over (partition by feature order by x) as upto, sum(k) over (partition by feature) as n from g),
t as (select r.*, (x - mean) / std as z, abs((x - mean) / std) as far from r join b using (feature) where std > 0),
c as (select *, case when z > 0 then 1 - tail else tail end as f from (select *, {_normal_sql('far')} as tail from t)),
d as (select feature, max(greatest(abs(f - upto / n), abs(f - (upto - k) / n))) as d, max(n) as n from c group by 1),
m as (select feature, d, d * (sqrt(n) + 0.12 + 0.11 / sqrt(n)) as lam from d),
p as (select feature, d, least(1, greatest(0, 2 * (select sum(case when k % 2 = 1 then 1.0 else -1.0 end * exp(-2.0 * k * k * lam * lam)) from range(1, 101) r(k)))) as p_value from m)
select feature, round(d, 6) as d, round(p_value, 6) as p_value, p_value < 0.05 as drifted from p""",
)
def _(t: Tables) -> DataFrame:
    """New rows against a normal distribution of the written baseline."""
    path = _folder(t, "baseline")
    io.write_report(tables.baseline_stats(t("v_features"), list(BASE)), path)
    new = t("v_features").where("account_age_days > 60")
    out = M.ks_normal(new, t.spark.read.schema("feature string, mean double, std double").json(path))
    return out.withColumns({c: F.round(c, 6) for c in ("d", "p_value")})


# Models.
@query("model_roundtrip")
def _(t: Tables) -> DataFrame:
    """Two fitted pipelines written with their features and metadata; the scores of the newest,
    read again, and the trees that its metadata name."""
    rows, root = io.stored(_filled(t), "train"), _folder(t, "models")
    for stamp, trees in (("20240101_000000", 2), ("20240102_000000", 3)):
        M.save_model(M.fit_trees(rows, FEATURES, maxIter=trees, maxDepth=3), FEATURES, {"trees": trees, "features": len(FEATURES)}, root, stamp)
    model, features, about = M.newest_model(t.spark, root)
    scored = model.transform(rows.select("transaction_id", *features))
    return scored.select("transaction_id", F.round(M.probability(scored), 6).alias("score"), F.lit(about["trees"]).alias("trees"))


@query("calibration_sample", "select transaction_id from v_txn where cast('0x' || substr(md5(concat(cast(transaction_id as string), ':7')), 1, 8) as bigint) / 4294967296.0 < 0.2")
def _(t: Tables) -> DataFrame:
    return tables.hash_split(t("v_txn"), "transaction_id", 0.2, 7, "held").where("held").select("transaction_id")


# Files.
@query("card_csv", "select v.transaction_id, v.amt, v.product, i.card1, i.domain from v_card v left join (select transaction_id, card1, domain from v_card where transaction_id % 3 = 0) i on i.transaction_id = v.transaction_id")
def _(t: Tables) -> DataFrame:
    """Transactions and identities as two CSV files, scanned and joined."""
    rows, root = t("v_card"), _folder(t, "card-csv")
    parts = {"tx": rows.select("transaction_id", "amt", "product"), "id": rows.where("transaction_id % 3 = 0").select("transaction_id", "card1", "domain")}
    for name, df in parts.items():
        io.write_importances(df, f"{root}/{name}")
    nullable = lambda df: T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
    return io.read_card_csv(t.spark, f"{root}/tx", f"{root}/id", nullable(parts["tx"]), nullable(parts["id"]), "transaction_id")


# Lists and ledger.
@query("blocklist_added", f"with l as ({LISTS_SQL}), n as (select distinct 'user' as entity_type, user_id as entity from v_txn where transaction_id % 33 = 0 union select 'device', device_id from v_txn where transaction_id % 35 = 0) select entity_type, count(*) as added from n where not exists (select 1 from l where l.entity_type = n.entity_type and l.entity = n.entity) group by 1")
def _(t: Tables) -> DataFrame:
    rows = t("v_txn")
    more = [rows.where(f"transaction_id % {k} = 0").select(F.lit(kind).alias("entity_type"), F.col(c).alias("entity")) for k, kind, c in ((33, "user", "user_id"), (35, "device", "device_id"))]
    return lists.added_count(t.sql(LISTS_SQL), more[0].unionAll(more[1]))


@query("case_duplicates", "select case_id, count(*) as n from v_case_events where event = 'ENQUEUED' group by 1 having count(*) > 1")
def _(t: Tables) -> DataFrame:
    return R.duplicate_cases(t("v_case_events").where("event = 'ENQUEUED'"))


@query(
    "case_assign_named",
    REPLAY_SQL + """, z as (select max(us) + 1 as at from v_case_events), k as (select min(case_id) as case_id from f where status = 'PENDING')
select f.case_id, case when f.case_id = k.case_id then 'IN_REVIEW' else status end as status, case when f.case_id = k.case_id then 'analyst_named' else analyst end as analyst, case when f.case_id = k.case_id then z.at else assigned_us end as assigned_us from f, z, k""",
)
def _(t: Tables) -> DataFrame:
    events = t("v_case_events").drop("event_id")
    case_id = R.case_state(events).where("status = 'PENDING'").agg(F.min("case_id")).first()[0]
    return R.case_state(R.assigned(events, case_id or "", "analyst_named", events.agg(F.max("us")).first()[0] + 1)).where(F.col("case_id") != "").select("case_id", "status", "analyst", "assigned_us")


@query("case_audit", "select case_id, event, analyst, us, row_number() over (partition by case_id order by us, case event when 'ENQUEUED' then 0 when 'ASSIGNED' then 1 when 'REQUEUED' then 2 when 'RESOLVED' then 3 else 4 end, event, analyst) as n from v_case_events")
def _(t: Tables) -> DataFrame:
    return R.audit_log(t("v_case_events")).select("case_id", "event", "analyst", "us", "n")


@query(
    "risk_from_decisions",
    f"with d as (select account_id, arg_max(case when {NORMAL} = 'CONFIRM_FRAUD' then score else 0.1 end, (decided_us, transaction_id)) as new_risk from ({DECISIONS_SQL}) group by 1) select account_id, coalesce(least(greatest(new_risk, 0), 1), risk_score) as risk_score from v_accounts left join d using (account_id)",
)
def _(t: Tables) -> DataFrame:
    """Accounts after the last decision on each."""
    d = t.sql(DECISIONS_SQL).withColumn("decision", R.normalised_decision(F.col("decision")))
    last = d.groupBy("account_id").agg(F.max_by(F.struct("decision", "score"), F.struct("decided_us", "transaction_id")).alias("d")).select("account_id", "d.*")
    return graph.update_risk(t("v_accounts"), R.risk_changes(last)).select("account_id", "risk_score")


# Quality.
_CELLS = ("us", "avg_transaction_amount", "transaction_count", "total_lifetime_value", "account_type", "device_id", "email_domain")


@query(
    "quality_report",
    """with f as (from v_features), s as (select case when count(*) >= 1000000 then 10 else 5 end as size, case when avg(is_fraud) between 0.01 and 0.15 then 15 else 8 end as balance, case when count(distinct case when is_fraud = 1 then fraud_scenario end) >= 5 then 15 else 8 end as variety,
  ((avg(avg_transaction_amount) between 20 and 500 and quantile_cont(avg_transaction_amount, 0.5) between 10 and 300)::int + (avg(account_age_days) between 30 and 3650)::int + (avg(transaction_count) between 10 and 5000)::int + (min(fraud_score) >= 0 and max(fraud_score) <= 1)::int) * 20 / 4 as "values",
  5 * ((sum((fraud_scenario = 'impossible_travel')::int) > 0)::int + (sum((fraud_scenario = 'velocity_attack')::int) > 0)::int + (sum((fraud_scenario in ('card_testing', 'card_testing_final'))::int) > 0)::int) as scenarios,
  case when (corr(is_vpn, is_fraud) > 0.05)::int + (corr(is_high_risk_country, is_fraud) > 0.05)::int >= 2 then 15 else 8 end as correlations from f),
m as (select 100.0 * (MISSING) / (count(*) * 16) as missing_pct from f), u as (select 100.0 * (count(*) - (select count(*) from (select distinct * from f))) / count(*) as duplicate_pct from f),
r as (select s.*, missing_pct, duplicate_pct, case when missing_pct < 1 then 5 when missing_pct < 5 then 3 else 0 end + case when duplicate_pct < 0.1 then 5 else 3 end as completeness from s, m, u),
x as (select *, size + balance + variety + "values" + scenarios + correlations + completeness as total from r)
select cast(size as double) as size, cast(balance as double) as balance, cast(variety as double) as variety, cast("values" as double) as "values", cast(scenarios as double) as scenarios, cast(correlations as double) as correlations, cast(completeness as double) as completeness, round(missing_pct, 4) as missing_pct, round(duplicate_pct, 4) as duplicate_pct, cast(total as double) as total,
  case when total >= 90 then 'A+' when total >= 80 then 'A' when total >= 70 then 'B' when total >= 60 then 'C' else 'D' end as grade, concat_ws(',', case when missing_pct >= 1 then 'missing data' end, case when duplicate_pct >= 0.1 then 'duplicates' end) as issues from x""".replace("MISSING", " + ".join(f"sum(({c} is null)::int)" for c in _CELLS)),
)
def _(t: Tables) -> DataFrame:
    q = quality.quality_report(t("v_features"))
    points = ("size", "balance", "variety", "values", "scenarios", "correlations", "completeness")
    return q.select(*points, *(F.round(c, 4).alias(c) for c in ("missing_pct", "duplicate_pct")), "total", "grade", F.array_join("issues", ",").alias("issues"))
