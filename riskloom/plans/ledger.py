"""Queries of reviews, findings, patterns, features, metrics and the quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings as I
from ..operators import ml as M
from ..operators import patterns as P
from ..operators import review as R
from ..operators import routing, tables, trees
from ..sources import io
from .adapters import Tables
from .registry import query

OPEN_SQL = """select concat('HITL-', substr(md5(cast(transaction_id as string)), 1, 12)) as case_id, transaction_id, user_id, amount, score,
  case when score >= 0.9 or amount >= 10000 then 'CRITICAL' when score >= 0.75 or amount >= 5000 then 'HIGH' when score >= 0.5 or amount >= 1000 then 'MEDIUM' else 'LOW' end as priority, us as created_us from v_scored where score >= 0.5 and score < 0.85"""


def _open(t: Tables) -> DataFrame:
    rows = t("v_scored").withColumns({"recommended_action": F.when((F.col("score") >= 0.5) & (F.col("score") < 0.85), "ESCALATE_TO_HITL").otherwise("X"), "reasoning": F.array().cast("array<string>")})
    return R.open_cases(rows)


@query("cases_opened", f"select case_id, transaction_id, priority, 'Low confidence, human review required' as escalation_reason from ({OPEN_SQL})")
def _(t: Tables) -> DataFrame:
    return _open(t).select("case_id", "transaction_id", "priority", "escalation_reason")


RANK = "case priority when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end"


@query("review_order", f"select case_id, row_number() over (order by {RANK}, created_us, case_id) as position from v_cases")
def _(t: Tables) -> DataFrame:
    return R.review_order(t("v_cases")).select("case_id", "position")


@query("case_assign", f"select case_id, concat('analyst_', cast(row_number() over (order by {RANK}, created_us, case_id) as string)) as assigned_to from v_cases order by {RANK}, created_us, case_id limit 5")
def _(t: Tables) -> DataFrame:
    return R.assign_next(t("v_cases"), [f"analyst_{k}" for k in range(1, 6)]).select("case_id", "assigned_to")


@query("case_list", "select case_id, created_us from v_cases where priority = 'HIGH' order by created_us, case_id limit 100")
def _(t: Tables) -> DataFrame:
    return R.list_cases(t("v_cases"), 100, priority="HIGH").select("case_id", "created_us")


REPLAY_SQL = """with recursive e as (
  select *, row_number() over (partition by case_id order by us, case event when 'ENQUEUED' then 0 when 'ASSIGNED' then 1 when 'REQUEUED' then 2 when 'RESOLVED' then 3 else 4 end, event, analyst) as n from v_case_events
), s as (
  select distinct case_id, 0::bigint as n, 'PENDING' as status, null::varchar as analyst, null::bigint as assigned_us, null::bigint as resolved_us, 0 as applied from e
  union all
  select s.case_id, e.n,
    case when ok then case when event in ('ENQUEUED', 'REQUEUED') then 'PENDING' when event = 'ASSIGNED' then 'IN_REVIEW' else event end else status end,
    case when ok and event = 'ASSIGNED' then e.analyst when ok and event = 'REQUEUED' then null else s.analyst end,
    case when ok and event = 'ASSIGNED' then e.us when ok and event = 'REQUEUED' then null else assigned_us end,
    case when ok and event = 'RESOLVED' then e.us else resolved_us end, applied + ok::int
  from s join e on e.case_id = s.case_id and e.n = s.n + 1,
    lateral (select (event = 'ASSIGNED' and status = 'PENDING') or (event = 'REQUEUED' and status = 'IN_REVIEW') or event = 'RESOLVED' or (event = 'TIMED_OUT' and status not in ('RESOLVED', 'TIMED_OUT')) as ok)
), f as (select case_id, status, analyst, assigned_us, resolved_us, applied from s qualify row_number() over (partition by case_id order by n desc) = 1)"""


@query("case_state", REPLAY_SQL + " select * from f")
def _(t: Tables) -> DataFrame:
    return R.case_state(t("v_case_events"))


def _states(t: Tables) -> DataFrame:
    e = t("v_case_events")
    made = e.groupBy("case_id").agg(F.min("us").alias("created_us")).withColumn("sla_minutes", F.lit(60))
    return R.case_state(e).join(made, "case_id")


@query(
    "queue_stats",
    REPLAY_SQL + """, m as (select case_id, min(us) as created_us from v_case_events group by 1), z as (select max(us) as now from v_case_events)
select count(*) as total, count(*) filter (where status = 'PENDING') as pending, count(*) filter (where status = 'IN_REVIEW') as in_review, count(*) filter (where status = 'RESOLVED') as resolved, count(*) filter (where status = 'TIMED_OUT') as timed_out,
  count(*) filter (where status <> 'RESOLVED' and now - created_us > 3600000000) as breaches,
  round(coalesce(avg((resolved_us - assigned_us) / 1e6) filter (where status = 'RESOLVED' and assigned_us is not null and resolved_us is not null), 0), 2) as mean_review_seconds,
  round((max(now) - min(created_us) filter (where status = 'PENDING')) / 60000000, 2) as oldest_pending_minutes from f join m using (case_id), z""",
)
def _(t: Tables) -> DataFrame:
    return R.queue_stats(_states(t), t("v_case_events").agg(F.max("us")).first()[0])


@query("sla_breaches", REPLAY_SQL + ", m as (select case_id, min(us) as created_us from v_case_events group by 1) select case_id from f join m using (case_id) where status <> 'RESOLVED' and (select max(us) from v_case_events) - created_us > 3600000000")
def _(t: Tables) -> DataFrame:
    as_of = t("v_case_events").agg(F.max("us")).first()[0]
    return _states(t).where(R.sla_breached(F.col("created_us"), F.col("sla_minutes"), F.col("status"), F.lit(as_of))).select("case_id")


DECISIONS_SQL = "select o_orderkey as transaction_id, concat('C', cast(o_custkey as string)) as case_id, concat('analyst_', cast(o_orderkey % 7 as string)) as analyst, case o_orderkey % 6 when 0 then 'DECLINE' when 1 then 'APPROVE' when 2 then '' when 3 then 'ESCALATE' when 4 then 'CONFIRM_FRAUD' else 'CLEAR' end as decision, o_orderkey % 4 = 0 as block_account, o_orderkey % 5 = 0 as flag_ring, o_orderkey % 3 > 0 as retrain, MICROS(o_orderdate) as decided_us, concat('A', cast(o_custkey as string)) as account_id, cast(o_orderkey % 100 as double) / 100 as score from orders"


@query("decision_validation", REPLAY_SQL + f", d as ({DECISIONS_SQL}) select transaction_id, case when f.case_id is null then 'unknown case' when status = 'RESOLVED' then 'already resolved' when status = 'TIMED_OUT' then 'timed out' when f.analyst is not null and f.analyst <> d.analyst then 'wrong analyst' when decision = '' then 'empty decision' end as error from d left join f using (case_id)")
def _(t: Tables) -> DataFrame:
    return R.validate_decisions(t.sql(DECISIONS_SQL), R.case_state(t("v_case_events"))).select("transaction_id", "error")


NORMAL = "case decision when 'DECLINE' then 'CONFIRM_FRAUD' when 'APPROVE' then 'CLEAR' when 'ESCALATE' then 'ESCALATE_FURTHER' else decision end"


@query("retrain_labels", f"select transaction_id, case_id, ({NORMAL} = 'CONFIRM_FRAUD')::int as label, 'review' as label_source, decided_us from ({DECISIONS_SQL})")
def _(t: Tables) -> DataFrame:
    return R.retrain_labels(t.sql(DECISIONS_SQL).withColumn("decision", R.normalised_decision(F.col("decision"))))


@query("decision_ledger", f"select transaction_id, concat_ws(',', concat('decision:', {NORMAL}), case when block_account then 'account_blocked' end, case when flag_ring then 'ring_flagged' end, case when retrain then 'label_stored' end) as actions, case when {NORMAL} = 'CONFIRM_FRAUD' then score else 0.1 end as new_risk from ({DECISIONS_SQL})")
def _(t: Tables) -> DataFrame:
    d = t.sql(DECISIONS_SQL).withColumn("decision", R.normalised_decision(F.col("decision")))
    actions = F.array_join(R.decision_actions(F.col("decision"), F.col("block_account"), F.col("flag_ring"), F.col("retrain")), ",")
    return d.select("transaction_id", actions.alias("actions"), F.when(F.col("decision") == "CONFIRM_FRAUD", F.col("score")).otherwise(0.1).alias("new_risk"))


@query("retrain_set", f"with l as (select transaction_id, arg_max(({NORMAL} = 'CONFIRM_FRAUD')::int, (decided_us, case_id)) as label from ({DECISIONS_SQL}) group by 1) select v.transaction_id, amt, label from v_card v join l using (transaction_id)")
def _(t: Tables) -> DataFrame:
    d = t.sql(DECISIONS_SQL).withColumn("decision", R.normalised_decision(F.col("decision")))
    return R.retrain_set(R.retrain_labels(d), t("v_card").select("transaction_id", "amt"))


# Findings.
PARSED_SQL = """with p as (select case_no, step, case when step = 0 then 'detective' when step = 1 then 'analyst' when step = 2 then 'verifier' else 'other' end as name, case when json_valid(response) then response::json end as j from v_findings),
q as (select case_no, step, name, j is null as is_fallback,
  case when j is null then 'MEDIUM' when j->>'risk_level' in ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') then j->>'risk_level' when j->>'risk_level' is null then null else 'MEDIUM' end as risk_level,
  case when j is null then 0 else least(greatest((j->>'confidence')::double, 0), 1) end as confidence, case when j is null then 0 else least(greatest((j->>'anomaly_score')::double, 0), 1) end as anomaly_score,
  case when j is null then 1 else (j->>'n_flags')::int end as n_flags, case when j is null then true else (j->>'deeper')::boolean end as deeper, j->>'fraud_type' as fraud_type,
  case when j->>'final_decision' in ('FRAUD', 'LEGIT', 'UNCERTAIN') then j->>'final_decision' else 'UNCERTAIN' end as final_decision,
  case when j->>'recommended_action' in ('APPROVE', 'DECLINE', 'REVIEW', 'ESCALATE_TO_HITL') then j->>'recommended_action' else 'ESCALATE_TO_HITL' end as recommended_action,
  case when j is not null and j->>'final_decision' is null then 'final_decision' else '' end as missing from p)"""


def _findings(t: Tables) -> DataFrame:
    name = F.when(F.col("step") == 0, "detective").when(F.col("step") == 1, "analyst").when(F.col("step") == 2, "verifier").otherwise("other")
    return I.with_fallback(I.parsed(t("v_findings"))).withColumn("turn", F.col("step")).withColumn("step", name)


@query("findings_parsed", PARSED_SQL + " select case_no, step as turn, is_fallback, risk_level, round(confidence, 4) as confidence, round(anomaly_score, 4) as anomaly_score, final_decision, recommended_action, missing from q")
def _(t: Tables) -> DataFrame:
    f = _findings(t)
    return f.select("case_no", "turn", "is_fallback", "finding.risk_level", F.round("finding.confidence", 4).alias("confidence"), F.round("finding.anomaly_score", 4).alias("anomaly_score"), "finding.final_decision", "finding.recommended_action", F.coalesce(F.array_join("missing", ","), F.lit("")).alias("missing"))


@query("findings_route", PARSED_SQL + """ select case_no, step as turn, case when case_no % 9 = 0 then 'end' when name = 'detective' then case when confidence > 0.9 and not coalesce(deeper, true) then 'end' when confidence > 0.9 or coalesce(n_flags, 0) = 0 then 'verifier' else 'analyst' end when name = 'analyst' then 'verifier' else 'end' end as next_step,
  case when final_decision = 'UNCERTAIN' then 'ESCALATE_TO_HITL' when confidence > 0.85 then case when final_decision = 'FRAUD' then 'DECLINE' else 'APPROVE' end when confidence >= 0.5 then 'REVIEW' else 'ESCALATE_TO_HITL' end as action from q""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    f = _findings(t)
    c = lambda n: F.col(f"finding.{n}")
    return f.select("case_no", "turn", I.next_step(F.col("step"), F.col("case_no") % 9 == 0, c("confidence"), c("deeper"), c("n_flags")).alias("next_step"), I.action_for(c("final_decision"), c("confidence")).alias("action"))


OUTCOME_SQL = PARSED_SQL + """, w as (select case_no, max(case when name = 'detective' then confidence end) as d, max(case when name = 'analyst' then confidence end) as a, max(case when name = 'verifier' then confidence end) as v,
  max(case when name = 'detective' then risk_level end) as level, max(case when name = 'verifier' then final_decision end) as fd, count(*) filter (where name = 'detective') as nd, count(*) filter (where name = 'analyst') as na, count(*) filter (where name = 'verifier') as nv from q group by 1),
o as (select *, case when nv > 0 then fd when nd > 0 then case when level in ('HIGH', 'CRITICAL') then 'FRAUD' else 'LEGIT' end else 'UNCERTAIN' end as final_decision, round((nd > 0)::int * 0.002 + (na > 0)::int * 0.015 + (nv > 0)::int * 0.01, 6) as cost from w)"""


@query("findings_outcome", OUTCOME_SQL + " select case_no, final_decision, cost, concat_ws(',', case when nd > 0 then 'detective' end, case when na > 0 then 'analyst' end, case when nv > 0 then 'verifier' end) as steps_run, round((0.3 * 0.4 + coalesce(0.2 * d, 0) + coalesce(0.3 * a, 0) + coalesce(0.2 * v, 0)) / (0.3 + case when d is not null then 0.2 else 0 end + case when a is not null then 0.3 else 0 end + case when v is not null then 0.2 else 0 end), 6) as combined from o")
def _(t: Tables) -> DataFrame:
    o = I.outcomes(_findings(t))
    combined = I.combined_confidence(F.lit(0.7), F.col("detective_confidence"), F.col("analyst_confidence"), F.col("verifier_confidence"))
    return o.select("case_no", "final_decision", F.round("cost", 6).alias("cost"), F.array_join("steps_run", ",").alias("steps_run"), F.round(combined, 6).alias("combined"))


@query("batch_review_stats", OUTCOME_SQL + " select count(*) as cases, round(sum(cost), 6) as total_cost, count(*) filter (where final_decision = 'FRAUD') as flagged, round(avg((final_decision = 'FRAUD')::int), 6) as flagged_share from o")
def _(t: Tables) -> DataFrame:
    return I.batch_summary(I.outcomes(_findings(t))).withColumns({c: F.round(c, 6) for c in ("total_cost", "flagged_share")})


@query("review_cost", "select conv_id as case_no, round(sum(case role when 'user' then length(text) / 1000 * 0.005 + 0.2 * 0.015 else length(text) / 1000 * 0.00015 + 0.2 * 0.0006 end), 8) as cost from conversations where role in ('user', 'assistant') group by 1")
def _(t: Tables) -> DataFrame:
    tokens = t("conversations").select(F.col("conv_id").alias("case_no"), F.col("role").alias("model"), F.length("text").alias("tokens_in"), F.lit(200).alias("tokens_out"))
    prices = t.spark.createDataFrame([("user", 0.005, 0.015), ("assistant", 0.00015, 0.0006)], "model string, price_in double, price_out double")
    return I.token_cost(tokens, prices).withColumn("cost", F.round("cost", 8))


@query("findings_severity", PARSED_SQL + " select case when fraud_type = 'account_takeover' then 'CRITICAL' when fraud_type = 'card_testing' then 'HIGH' when fraud_type = 'time_anomaly' then 'LOW' else 'MEDIUM' end as severity, count(*) as n from q group by 1")
def _(t: Tables) -> DataFrame:
    return _findings(t).groupBy(I.severity(F.col("finding.fraud_type")).alias("severity")).agg(F.count("*").alias("n"))


@query("agent_prefilter", "select coalesce(case when amount < 5 then 'micro' when score < 0.2 then 'low score' when score > 0.8 then 'high score' end, 'investigate') as route, count(*) as n from v_scored group by 1")
def _(t: Tables) -> DataFrame:
    return t("v_scored").groupBy(F.coalesce(I.prefilter(F.col("amount"), F.col("score")), F.lit("investigate")).alias("route")).agg(F.count("*").alias("n"))


@query("scalar_json_array", PARSED_SQL + " select case_no, count(*) as steps, string_agg(risk_level, ',' order by step) as levels, bool_or(risk_level = 'HIGH') as any_high from q group by 1")
def _(t: Tables) -> DataFrame:
    f = _findings(t).groupBy("case_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "finding.risk_level"))), lambda x: x["risk_level"]).alias("l"))
    return f.select("case_no", F.size("l").alias("steps"), F.array_join("l", ",").alias("levels"), F.array_contains("l", "HIGH").alias("any_high"))


# Patterns.
LAG = "window o as (partition by user_id order by us, transaction_id), p as (partition by user_id order by us, transaction_id rows between unbounded preceding and 1 preceding)"


@query("pattern_travel", f"select transaction_id from (select transaction_id, location <> lag(location) over o and device_id <> lag(device_id) over o and us - lag(us) over o <= 10800000000 as hit from v_txn {LAG}) where hit")
def _(t: Tables) -> DataFrame:
    return P.impossible_travel(t("v_txn"), 180).where("pattern_travel").select("transaction_id")


@query("pattern_velocity", "select transaction_id from (select transaction_id, sum((amount <= 200)::int) over (partition by user_id order by us range between 86400000000 preceding and current row) >= 3 as hit from v_txn) where hit")
def _(t: Tables) -> DataFrame:
    return P.velocity_attack(t("v_txn"), 3, 86400, 200.0).where("pattern_velocity").select("transaction_id")


@query("pattern_card_testing", "select transaction_id from (select transaction_id, amount >= 100 and coalesce(sum((amount <= 50)::int) over (partition by user_id order by us range between 172800000000 preceding and 1 preceding), 0) >= 2 as hit from v_txn) where hit")
def _(t: Tables) -> DataFrame:
    return P.card_testing(t("v_txn"), 2, 2880, 50.0, 100.0).where("pattern_card_testing").select("transaction_id")


@query("pattern_time", f"select transaction_id from (select transaction_id, night and amount >= 100 and count(*) over p >= 10 and avg(night::int) over p <= 0.25 as hit from (select *, (us % 86400000000) // 3600000000 between 0 and 5 as night from v_txn) {LAG}) where hit")
def _(t: Tables) -> DataFrame:
    return P.time_anomaly(t("v_txn"), rare=0.25, large=100.0).where("pattern_time").select("transaction_id")


@query("pattern_spike", f"select transaction_id from (select transaction_id, count(*) over p >= 10 and amount > 3 * avg(amount) over p as hit from v_txn {LAG}) where hit")
def _(t: Tables) -> DataFrame:
    return P.amount_spike(t("v_txn"), 3.0).where("pattern_spike").select("transaction_id")


def _unseen_sql(c: str) -> str:
    return f"select transaction_id from (select transaction_id, row_number() over (partition by user_id, {c} order by us, transaction_id) = 1 and count(*) over p >= 3 and amount >= 100 as hit from v_txn {LAG}) where hit"


@query("pattern_category", _unseen_sql("merchant_category"))
def _(t: Tables) -> DataFrame:
    return P.category_anomaly(t("v_txn"), 100.0, 3).where("pattern_category").select("transaction_id")


@query("pattern_device", _unseen_sql("device_id"))
def _(t: Tables) -> DataFrame:
    return P.device_switch(t("v_txn"), 100.0, 3).where("pattern_device").select("transaction_id")


# Features and metrics.
@query("card_features", "select transaction_id, dt // 86400 as tx_day, dt % 86400 // 3600 as tx_hour, (dt // 86400) % 7 as tx_weekday, ((dt // 86400) % 7 >= 5)::int as is_weekend, (dt % 86400 // 3600 >= 22 or dt % 86400 // 3600 < 6)::int as is_night, case m1 when 'T' then 1 when 'F' then 0 else -1 end as m1_code, dense_rank() over (order by domain) - 1 as domain_code from (select * exclude (dt), cast(floor(dt) as bigint) as dt from v_card)")
def _(t: Tables) -> DataFrame:
    rows = t("v_card").withColumn("dt", F.floor("dt").cast("bigint"))
    coded = M.indexer(["domain"]).fit(rows).transform(rows)
    return coded.withColumns(M.card_time(F.col("dt"))).select("transaction_id", "tx_day", "tx_hour", "tx_weekday", "is_weekend", "is_night", M.flag_code(F.col("m1")).alias("m1_code"), F.col("domain_code").cast("long").alias("domain_code"))


@query("missing_policy", "select transaction_id, coalesce(card1, -999) as card1, coalesce(addr1, -999) as addr1, amt from v_card")
def _(t: Tables) -> DataFrame:
    rows = t("v_card")
    gone = M.sparse_columns(rows, ["card1", "addr1", "sparse", "amt"])
    return M.drop_and_fill(rows.select("transaction_id", "card1", "addr1", "sparse", "amt"), gone).select("transaction_id", *(c for c in ("card1", "addr1", "sparse", "amt") if c not in gone))


@query("interactions", "select transaction_id, round(amt * card1, 4) as amt_x_card1 from v_card")
def _(t: Tables) -> DataFrame:
    return M.interactions(t("v_card"), [("amt", "card1"), ("amt", "absent")]).select("transaction_id", F.round("amt_x_card1", 4).alias("amt_x_card1"))


PRODUCTION_SQL = """with r as (select user_id, avg(is_fraud) as rate from v_txn where transaction_id % 5 <> 0 group by 1),
c as (select *, dense_rank() over (order by location) - 1 as location_code, dense_rank() over (order by merchant_category) - 1 as merchant_category_code, dense_rank() over (order by device_id) - 1 as device_id_code,
  us % 86400000000 // 3600000000 as hour, (us // 86400000000 + 3) % 7 as day_of_week, transaction_id % 4 as device_changes, transaction_id % 9 as velocity_1h from v_txn)
select transaction_id, round(coalesce(rate, 0), 6) as user_fraud_rate, location_code, merchant_category_code, device_id_code, round(amount * velocity_1h, 4) as amount_x_velocity, hour * merchant_category_code as hour_x_merchant, device_changes * location_code as device_x_location,
  day_of_week, (day_of_week >= 5)::int as is_weekend, (hour between 9 and 17 and day_of_week < 5)::int as is_business_hours from c left join r using (user_id)"""


@query("production_features", PRODUCTION_SQL)
def _(t: Tables) -> DataFrame:
    """Codes of three columns, three products, calendar flags, and rates from other rows."""
    rows = t("v_txn")
    names = ["location", "merchant_category", "device_id"]
    coded = M.indexer(names).fit(rows).transform(rows)
    coded = coded.withColumns({f"{c}_code": F.col(f"{c}_code").cast("long") for c in names} | M.calendar(F.col("us")) | {"device_changes": F.col("transaction_id") % 4, "velocity_1h": F.col("transaction_id") % 9})
    coded = M.interactions(coded, [("amount", "velocity_1h"), ("hour_of_day", "merchant_category_code"), ("device_changes", "location_code")])
    rates = rows.where("transaction_id % 5 <> 0").groupBy("user_id").agg(F.avg("is_fraud").alias("rate"))
    return coded.join(rates, "user_id", "left").select(
        "transaction_id", F.round(F.coalesce("rate", F.lit(0.0)), 6).alias("user_fraud_rate"), *(f"{c}_code" for c in names), F.round("amount_x_velocity_1h", 4).alias("amount_x_velocity"),
        F.col("hour_of_day_x_merchant_category_code").alias("hour_x_merchant"), F.col("device_changes_x_location_code").alias("device_x_location"), "day_of_week", "is_weekend", "is_business_hours",
    )


def _rank_sql(score: str, tag: str) -> str:
    return f"""g{tag} as (select {score} as s, sum(label) as p, sum(1 - label) as n from v_scored group by 1),
r{tag} as (select *, coalesce(sum(p) over (order by s desc rows between unbounded preceding and 1 preceding), 0) as tp0, sum(p) over (order by s desc) as tp, sum(n) over (order by s desc) as fp, sum(p) over () as pp, sum(n) over () as nn from g{tag}),
m{tag} as (select sum(n * tp0 + 0.5 * p * n) / max(pp * nn) as auc, sum(p / pp * (tp / (tp + fp))) as ap, arg_min(tp / (tp + fp), (abs(tp / pp - 0.5), s)) as half from r{tag}),
b{tag} as (select avg(pow({score} - label, 2)) as brier, avg(-(label * ln(greatest(2.2e-16, least(1 - 2.2e-16, {score}))) + (1 - label) * ln(1 - greatest(2.2e-16, least(1 - 2.2e-16, {score}))))) as log_loss from v_scored)"""


@query("ranking_metrics", f"with {_rank_sql('score', 'x')} select round(auc, 6) as auc, round(ap, 6) as average_precision, round(brier, 6) as brier, round(log_loss, 6) as log_loss, round(half, 6) as precision_at_half_recall from mx, bx")
def _(t: Tables) -> DataFrame:
    m = M.ranking_metrics(t("v_scored"))
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@query("calibration_compare", f"with {_rank_sql('score', 'x')}, {_rank_sql('score_b', 'y')} select round(bx.brier, 6) as brier_before, round(bx.log_loss, 6) as log_loss_before, round(by_.brier, 6) as brier_after, round(by_.log_loss, 6) as log_loss_after, round((bx.brier - by_.brier) / bx.brier * 100, 4) as brier_improvement_pct from bx, by_".replace("by as (", "by_ as ("))
def _(t: Tables) -> DataFrame:
    m = M.calibration_compare(t("v_scored"), "label", "score", "score_b")
    return m.select(*(F.round(c, 4 if c.endswith("pct") else 6).alias(c) for c in m.columns))


def _conf_sql(score: str, tag: str) -> str:
    return f"c{tag} as (select tp / nullif(tp + fp, 0) as pr, tp / nullif(tp + fn, 0) as rc, 2 * tp / nullif(2 * tp + fp + fn, 0) as f1, fp / nullif(fp + tn, 0) as fpr, fp from (select count(*) filter (where {score} >= 0.5 and label = 1) as tp, count(*) filter (where {score} >= 0.5 and label = 0) as fp, count(*) filter (where {score} < 0.5 and label = 0) as tn, count(*) filter (where {score} < 0.5 and label = 1) as fn from v_scored))"


@query(
    "model_compare",
    f"""with {_rank_sql('score', 'x')}, {_rank_sql('score_b', 'z')}, {_conf_sql('score', 'x')}, {_conf_sql('score_b', 'z')},
k as (select cx.fp as fp_a, cz.fp as fp_b, round(cx.fpr, 6) as fpr_a, round(cz.fpr, 6) as fpr_b, round(mx.auc, 6) as auc_a, round(mz.auc, 6) as auc_b,
 (cx.pr > cz.pr)::int + (cx.rc > cz.rc)::int + (cx.f1 > cz.f1)::int + (mx.auc > mz.auc)::int + (cx.fpr < cz.fpr)::int + (cx.fp < cz.fp)::int as points_a,
 (cx.pr < cz.pr)::int + (cx.rc < cz.rc)::int + (cx.f1 < cz.f1)::int + (mx.auc < mz.auc)::int + (cx.fpr > cz.fpr)::int + (cx.fp > cz.fp)::int as points_b from cx, cz, mx, mz)
select *, case when points_a > points_b then 'a' when points_b > points_a then 'b' else 'tie' end as winner from k""",
)
def _(t: Tables) -> DataFrame:
    m = M.model_compare(t("v_scored"), "label", "score", "score_b")
    return m.select("fp_a", "fp_b", *(F.round(c, 6).alias(c) for c in ("fpr_a", "fpr_b", "auc_a", "auc_b")), "points_a", "points_b", "winner")


@query(
    "drift_ks",
    """with l as (select 'amount' as feature, amount as x, (transaction_id % 2) as side from v_txn union all select 'value', case when transaction_id % 2 = 0 then amount else amount * 1.3 end, transaction_id % 2 from v_txn),
b as (select feature, x, sum(1 - side) as a, sum(side) as b from l group by 1, 2),
g as (select feature, abs(sum(a) over w / sum(a) over e - sum(b) over w / sum(b) over e) as gap, sum(a) over e as na, sum(b) over e as nb from b window w as (partition by feature order by x), e as (partition by feature)),
d as (select feature, max(gap) as d, max(na) as na, max(nb) as nb from g group by 1), m as (select *, d * sqrt(na * nb / (na + nb)) as lam from d)
select feature, round(d, 6) as d, round(least(1, greatest(0, 2 * (select sum(case when k % 2 = 1 then 1.0 else -1.0 end * exp(-2.0 * k * k * lam * lam)) from range(1, 101) r(k)))), 6) as p_value from m""",
)
def _(t: Tables) -> DataFrame:
    rows = t("v_txn")
    base = rows.where("transaction_id % 2 = 0").select("amount", F.col("amount").alias("value"))
    new = rows.where("transaction_id % 2 = 1").select("amount", (F.col("amount") * 1.3).alias("value"))
    return M.ks_two_sample(base, new, ["amount", "value"]).select("feature", F.round("d", 6).alias("d"), F.round("p_value", 6).alias("p_value"))


FEATURES = ["amt", "card1", "addr1", "dt"]


def _filled(t: Tables) -> DataFrame:
    """All rows, missing values filled as in missing_policy."""
    return M.drop_and_fill(t("v_card").select("transaction_id", F.col("is_fraud").cast("double").alias("label"), *(F.col(c).cast("double").alias(c) for c in FEATURES)), [])


def _train(t: Tables, k: int = 3) -> DataFrame:
    """The filled rows in k stratified folds."""
    return io.stored(tables.folds(_filled(t), "transaction_id", "label", k).withColumn("fold", F.col("fold").cast("int")), "train")


@query("gbt_scores")
def _(t: Tables) -> DataFrame:
    rows = _train(t)
    model = M.fit_trees(rows.where("fold <> 0"), FEATURES)
    return model.transform(rows.where("fold = 0")).withColumn("score", M.probability(rows)).select("transaction_id", "label", F.round("score", 6).alias("score"))


@query("gbt_weighted")
def _(t: Tables) -> DataFrame:
    """Frauds weigh as much as all else in the fit; the held-out fold is scored from flat tables."""
    rows = _train(t)
    model = M.fit_trees(M.class_weighted(rows.where("fold <> 0")), FEATURES, weight="weight")
    margin = trees.margin(trees.exported(model), FEATURES)
    return rows.where("fold = 0").select("transaction_id", "label", F.round(trees.probability(margin), 6).alias("score"))


def _calibrated(t: Tables) -> DataFrame:
    """Fold 0 with the margin, score and calibrated score of trees fitted on fold 2, whose margins
    on fold 1 gave the sigmoid."""
    rows = _train(t)
    model = M.fit_trees(rows.where("fold = 2"), FEATURES)
    margin = trees.margin(trees.exported(model), FEATURES)
    slope, intercept = M.platt_fit(rows.where("fold = 1").withColumn("margin", margin))
    held = rows.where("fold = 0").withColumn("margin", margin)
    return held.withColumns({"score": trees.probability(F.col("margin")), "calibrated": M.sigmoid(F.col("margin"), slope, intercept)})


@query("gbt_calibrated")
def _(t: Tables) -> DataFrame:
    return _calibrated(t).select("transaction_id", "label", *(F.round(c, 6).alias(c) for c in ("margin", "score", "calibrated")))


@query("gbt_calibration_gain")
def _(t: Tables) -> DataFrame:
    """One row: Brier score and log loss of the held-out fold before and after calibration."""
    m = M.calibration_compare(io.stored(_calibrated(t).select("label", "score", "calibrated"), "calibrated"), "label", "score", "calibrated")
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@query("platt_scores")
def _(t: Tables) -> DataFrame:
    rows = t("v_scored").withColumn("margin", F.log((F.col("score") + 0.01) / (1.01 - F.col("score"))))
    slope, intercept = M.platt_fit(rows)
    return rows.select("transaction_id", F.round(M.sigmoid(F.col("margin"), slope, intercept), 6).alias("calibrated"))


@query("importances")
def _(t: Tables) -> DataFrame:
    return M.importances(M.fit_trees(io.stored(_filled(t), "train"), FEATURES), FEATURES, t.spark)


@query("cv_scores")
def _(t: Tables) -> DataFrame:
    """metric, scores, mean, std and band over the folds."""
    return M.cross_validated(_train(t, 5), FEATURES, 5, maxIter=10, maxDepth=4)


@query("random_search")
def _(t: Tables) -> DataFrame:
    return M.random_search(_train(t), FEATURES, {"maxDepth": [2, 3, 4], "maxIter": [2, 4, 8], "stepSize": [0.05, 0.1, 0.3]}, 20, 3)


@query("read_back", "select transaction_id, amount, is_fraud, merchant_category from v_txn")
def _(t: Tables) -> DataFrame:
    """Parquet, CSV and JSON written and read in turn."""
    import uuid

    rows = t("v_txn").select("transaction_id", "amount", "is_fraud", "merchant_category")
    root = f"{io.shared_folder(t.spark)}/readback-{uuid.uuid4().hex}"
    io.write_features(rows, f"{root}/parquet")
    io.write_importances(io.read_features(t.spark, f"{root}/parquet", rows.schema), f"{root}/csv")
    io.append_labels(t.spark.read.schema(rows.schema).csv(f"{root}/csv", header=True), f"{root}/json")
    return t.spark.read.schema(rows.schema).json(f"{root}/json")
