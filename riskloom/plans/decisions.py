"""Queries of rules, velocity, routing and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import routing, rules, velocity
from .adapters import Tables
from .registry import query

RULES_SQL = """
with r as (
  select *, coalesce(amount, 0) as a, coalesce(nullif(billing_country, ''), nullif(ip_country, ''), nullif(country_code, '')) as country,
    case when is_tor is not null and is_tor not in ('', '0', 'false', 'False') then lower(is_tor) else lower(tor_exit_node) end as tor,
    case when nullif(email, '') is null then lower(email_domain) else lower(string_split(email, '@')[2]) end as dom,
    2 * 6371 * asin(sqrt(pow(sin(radians(transaction_lat - last_transaction_lat) / 2), 2)
      + cos(radians(last_transaction_lat)) * cos(radians(transaction_lat)) * pow(sin(radians(transaction_lon - last_transaction_lon) / 2), 2))) as km,
    (txn_us - last_us) / 3.6e9 as hours
  from v_rule_input
), h as (
  select *, list_filter([
    case when card_number_hash in ('4532123456789012', '5425233430109903') then 'C:check_stolen_card' end,
    case when country in ('KP', 'IR', 'SY', 'CU') then 'C:check_sanctioned_country' end,
    case when device_id in ('device_fraud_001', 'device_fraud_002') then 'C:check_fraud_device' end,
    case when tor in ('1', 'true') then 'C:check_tor' end,
    case when dom in ('tempmail.com', '10minutemail.com', 'guerrillamail.com', 'throwaway.email', 'fakeinbox.com') then 'C:check_email_domain' end,
    case when a > coalesce(card_limit, 10000) then 'C:check_amount_exceeds_limit' end,
    case when coalesce(transactions_last_hour, 0) > 5 or coalesce(failed_attempts_last_hour, 0) > 3 then 'H:check_velocity_limits' end,
    case when a in (100, 200, 500, 1000, 5000) and coalesce(transactions_last_minute, 0) >= 3 then 'H:check_card_testing_pattern' end,
    case when user_id in ('user_vip_001', 'user_vip_002') and a <= 500 then 'A:check_vip_user' end,
    case when a < 5 then 'A:check_micro_transaction' end,
    case when hours > 0 and km / hours > 800 then 'H:check_impossible_travel' end,
    case when coalesce(account_age_hours, 999999) < 24 and a > 500 then 'H:check_new_account_risk'
         when coalesce(is_first_transaction, false) and a > 1000 then 'M:check_new_account_risk' end,
    case when coalesce(transaction_hour, 12) between 2 and 6 and a > 1000 then 'M:check_behavioral_anomalies' end
  ], lambda x: x is not null) as hits from r
), s as (
  select *, list_position(list_transform(hits, lambda x: x[1] in ('C', 'A')), true) as stop from h
), t as (
  select *, case when stop > 0 then hits[1:stop] else hits end as kept from s
), d as (
  select *, len(list_filter(kept, lambda x: x[1] = 'H')) as n_high,
    case when stop > 0 and kept[-1][1] = 'A' then 'APPROVE' when stop > 0 or len(list_filter(kept, lambda x: x[1] = 'H')) >= 2 then 'DECLINE' else 'PASS_TO_ML' end as rules_decision from t
)"""


def _rule_rows(t: Tables) -> DataFrame:
    at = lambda c: F.timestamp_micros(c)
    return t("v_rule_input").withColumns({"transaction_time": at("txn_us"), "last_transaction_time": at("last_us")})


def decided(t: Tables) -> DataFrame:
    return rules.evaluate_rules(_rule_rows(t))


@query("rules_decisions", RULES_SQL + " select transaction_id, rules_decision, array_to_string(list_transform(kept, lambda x: x[3:]), ',') as triggered, rules_decision = 'PASS_TO_ML' as continue_to_ml from d")
def _(t: Tables) -> DataFrame:
    return decided(t).select("transaction_id", "rules_decision", rules.rule_names().alias("triggered"), "continue_to_ml")


RULE_LISTS_SQL = """
select 'stolen_cards' as list, concat('card_', cast(c_custkey as string)) as entity from customer where c_acctbal < -500
union all select 'fraud_devices', concat('D', cast(p_size * 20 as string)) from part where p_size < 10
union all select 'vip_users', concat('U', cast(c_custkey as string)) from customer where c_acctbal > 9000
union all select 'sanctioned_countries', n from (select case when n_nationkey % 5 = 0 then 'SY' else 'KP' end as n from nation)
union all select 'fraud_domains', 'fakeinbox.com' from region"""
#: What the SQL compares with the five lists of the configuration, and the lists' names.
IN_LISTS = {
    "card_number_hash in ('4532123456789012', '5425233430109903')": "card_number_hash in (select entity from rl where list = 'stolen_cards')",
    "country in ('KP', 'IR', 'SY', 'CU')": "country in (select entity from rl where list = 'sanctioned_countries')",
    "device_id in ('device_fraud_001', 'device_fraud_002')": "device_id in (select entity from rl where list = 'fraud_devices')",
    "dom in ('tempmail.com', '10minutemail.com', 'guerrillamail.com', 'throwaway.email', 'fakeinbox.com')": "dom in (select entity from rl where list = 'fraud_domains')",
    "user_id in ('user_vip_001', 'user_vip_002')": "user_id in (select entity from rl where list = 'vip_users')",
}


def _listed_sql() -> str:
    sql = RULES_SQL.replace("with r as", f"with rl as ({RULE_LISTS_SQL}), r as", 1)
    for said, held in IN_LISTS.items():
        assert said in sql
        sql = sql.replace(said, held)
    return sql


@query("rules_listed", _listed_sql() + " select transaction_id, rules_decision, array_to_string(list_transform(kept, lambda x: x[3:]), ',') as triggered from d")
def _(t: Tables) -> DataFrame:
    """The rules over lists that are tables."""
    return rules.evaluate_rules(_rule_rows(t), tables=t.sql(RULE_LISTS_SQL)).select("transaction_id", "rules_decision", "triggered_names").withColumnRenamed("triggered_names", "triggered")


REASONS_SQL = """ select transaction_id, case when stop > 0 then case kept[-1][3:]
    when 'check_stolen_card' then 'Card is on the stolen list' when 'check_sanctioned_country' then concat('Sanctioned country: ', country)
    when 'check_fraud_device' then 'Device is on the fraud list' when 'check_tor' then 'TOR exit node' when 'check_email_domain' then concat('Disposable e-mail domain: ', dom)
    when 'check_amount_exceeds_limit' then printf('Amount %.2f over card limit %.2f', a, coalesce(card_limit, 10000)) when 'check_vip_user' then 'VIP user under the VIP amount'
    when 'check_micro_transaction' then printf('Micro amount %.2f', a) end
  when n_high >= 2 then printf('Multiple high-severity violations (%d)', n_high) end as reason from d"""


@query("rules_reasons", RULES_SQL + REASONS_SQL)
def _(t: Tables) -> DataFrame:
    return decided(t).select("transaction_id", F.col("primary_reason").alias("reason"))


@query("rules_hits", RULES_SQL + " select rule_name[3:] as rule_name, count(*) as hits from (select unnest(kept) as rule_name from d) group by 1")
def _(t: Tables) -> DataFrame:
    return rules.rule_hits(decided(t))


@query(
    "rules_stats",
    RULES_SQL + " select count(*) as total, round(avg((rules_decision='DECLINE')::int), 6) as decline_rate, round(avg((rules_decision='APPROVE')::int), 6) as approve_rate, round(avg((rules_decision='PASS_TO_ML')::int), 6) as pass_rate from d",
)
def _(t: Tables) -> DataFrame:
    return rules.engine_stats(decided(t)).select("total", *(F.round(c, 6).alias(c) for c in ("decline_rate", "approve_rate", "pass_rate")))


TRAIL_SQL = """
with once as (
  select *, row_number() over (partition by user_id, us order by transaction_id) = 1 as first_time,
    row_number() over (partition by user_id, us, round(amount, 4) order by transaction_id) = 1 as first_part
  from v_txn
), w as (
  select *, cast(sum(case when first_time then 1 else 0 end) over (partition by user_id order by us range between 3599999999 preceding and current row) as bigint) as count_1h,
    cast(sum(case when first_time then 1 else 0 end) over (partition by user_id order by us range between 86399999999 preceding and current row) as bigint) as count_24h,
    round(sum(case when first_part then round(amount, 4) else 0 end) over (partition by user_id order by us range between 3599999999 preceding and current row), 2) as amount_1h,
    round(sum(case when first_part then round(amount, 4) else 0 end) over (partition by user_id order by us range between 86399999999 preceding and current row), 2) as amount_24h
  from once
)"""


def with_trail(t: Tables) -> DataFrame:
    return velocity.trailing(t("v_txn"), {"1h": velocity.HOUR, "24h": velocity.DAY})


@query("velocity_1h_24h", TRAIL_SQL + " select transaction_id, user_id, count_1h, count_24h, amount_1h, amount_24h from w")
def _(t: Tables) -> DataFrame:
    return with_trail(t).select("transaction_id", "user_id", "count_1h", "count_24h", "amount_1h", "amount_24h")


FLAGSHIP_SQL = TRAIL_SQL + """, x as (
  select *, least(1.0, cast((transaction_id * 7919) % 10000 as double) / 10000.0 * 0.7 + is_fraud * 0.3) as s,
    case when amount > 10000 then 'DECLINE' when amount < 5 then 'APPROVE'
      when (count_1h > 5)::int + (amount in (100, 200, 500, 1000, 5000) and 0 >= 3)::int >= 2 then 'DECLINE' else 'PASS_TO_ML' end as d
  from w
), y as (
  select case when d = 'DECLINE' then 'rules_decline' when d = 'APPROVE' then 'rules_approve' when s >= 0.85 then 'xgboost_high' when s < 0.2 then 'xgboost_low' else 'full_pipeline' end as layer_stopped_at, s from x
), z as (
  select case when layer_stopped_at in ('rules_decline', 'xgboost_high') then 'FRAUD' when layer_stopped_at in ('rules_approve', 'xgboost_low') or s < 0.5 then 'LEGIT' else 'UNCERTAIN' end as final_decision, layer_stopped_at from y
)
select final_decision, layer_stopped_at, count(*) as n, round(count(*) / (select count(*) from z), 6) as share from z group by 1, 2"""


def flagship(t: Tables) -> DataFrame:
    """Velocity, adapter, rules, fallback score and route of every event."""
    seen = with_trail(t).withColumn("transactions_last_hour", F.col("count_1h"))
    missing = {"card_limit": "double", "card_number_hash": "string", "email": "string", "email_domain": "string", "billing_country": "string", "ip_country": "string", "country_code": "string", "is_tor": "string", "tor_exit_node": "string", "transactions_last_minute": "bigint", "failed_attempts_last_hour": "bigint", "account_age_hours": "double", "is_first_transaction": "boolean", "transaction_hour": "int", "transaction_lat": "double", "transaction_lon": "double", "last_transaction_lat": "double", "last_transaction_lon": "double", "transaction_time": "timestamp", "last_transaction_time": "timestamp"}
    rows = seen.withColumns({c: F.lit(None).cast(kind) for c, kind in missing.items()})
    score = F.least(F.lit(1.0), ((F.col("transaction_id") * 7919) % 10000).cast("double") / 10000.0 * 0.7 + F.col("is_fraud") * 0.3)
    scored = routing.fallback_score(rules.evaluate_rules(rows).withColumn("fraud_score", score))
    return routing.route(scored)


@query("flagship_decisions", FLAGSHIP_SQL)
def _(t: Tables) -> DataFrame:
    return routing.shares(flagship(t), "final_decision", "layer_stopped_at").withColumn("share", F.round("share", 6))


@query(
    "velocity_block",
    """select transaction_id, count(*) over h as transactions_last_hour, count(*) over d as transactions_last_day, count(*) over w as transactions_last_week,
  round(sum(amount) over h, 8) as amount_last_hour, round(sum(amount) over d, 8) as amount_last_day, round(sum(amount) over w, 8) as amount_last_week,
  round(avg(amount) over w, 8) as avg_amount_7d, max(amount) over m as max_amount_30d, round(stddev_samp(amount) over m, 8) as std_amount_30d,
  round(avg(amount) over l, 8) as avg_transaction_amount, count(*) over l as transaction_count,
  round(avg(case when (us // 86400000000 + 3) % 7 >= 5 then 1.0 else 0.0 end) over l, 8) as weekend_share,
  round(avg(case when (us % 86400000000) // 3600000000 >= 22 or (us % 86400000000) // 3600000000 < 6 then 1.0 else 0.0 end) over l, 8) as night_share,
  round((us - lag(us) over o) / 86400000000.0, 8) as days_since_last, round(cast(us - min(us) over l as double) / 86400000000.0 / nullif(count(*) over l - 1, 0), 8) as mean_days_between,
  round(case when stddev_samp(amount) over m > 0 then (amount - avg(amount) over l) / stddev_samp(amount) over m end, 8) as amount_z_score
from v_txn window o as (partition by user_id order by us, transaction_id), h as (partition by user_id order by us range between 3599999999 preceding and current row),
  d as (partition by user_id order by us range between 86399999999 preceding and current row),
  w as (partition by user_id order by us range between 604799999999 preceding and current row),
  m as (partition by user_id order by us range between 2591999999999 preceding and current row),
  l as (partition by user_id order by us range between unbounded preceding and current row)""",
)
def _(t: Tables) -> DataFrame:
    out = velocity.velocity_block(t("v_txn"))
    whole = ("transactions_last_hour", "transactions_last_day", "transactions_last_week", "max_amount_30d", "transaction_count")
    parts = ("amount_last_hour", "amount_last_day", "amount_last_week", "avg_amount_7d", "std_amount_30d", "avg_transaction_amount", "weekend_share", "night_share", "days_since_last", "mean_days_between", "amount_z_score")
    return out.select("transaction_id", *whole, *(F.round(c, 8).alias(c) for c in parts))


@query(
    "warm_window",
    "select user_id, count(*) as events, min(us) as oldest, max(us) as newest, round(sum(amount), 4) as amount from v_txn where us > (select max(us) from v_txn) - 86400000000 group by 1",
)
def _(t: Tables) -> DataFrame:
    rows = t("v_txn")
    return velocity.warm_windows(rows, rows.agg(F.max("us")).first()[0]).withColumn("amount", F.round("amount", 4))


@query("last_row_per_user", "select user_id, transaction_id, us, amount from v_txn qualify row_number() over (partition by user_id order by us desc, transaction_id desc) = 1")
def _(t: Tables) -> DataFrame:
    return velocity.last_row(t("v_txn"), "user_id", "us", "transaction_id").select("user_id", "transaction_id", "us", "amount")


@query("route_decisions", """select transaction_id, case when score >= 0.85 then 'FRAUD' when score < 0.5 then 'LEGIT' else 'UNCERTAIN' end as final_decision,
  case when score >= 0.85 then 'DECLINE' when score < 0.5 then 'APPROVE' else 'ESCALATE_TO_HITL' end as recommended_action,
  case when score >= 0.85 then 'xgboost_high' when score < 0.2 then 'xgboost_low' else 'full_pipeline' end as layer_stopped_at, round(score, 6) as score from v_scored""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    rows = t("v_scored").withColumns({"rules_decision": F.lit("PASS_TO_ML"), "model_score": F.col("score"), "confidence": F.lit(0.5)})
    return routing.route(rows).select("transaction_id", "final_decision", "recommended_action", "layer_stopped_at", F.round("model_score", 6).alias("score"))


@query("grey_zone", "select cast(sum((score >= 0.2 and score < 0.85)::int) as bigint) as grey_rows, round(avg((score >= 0.2 and score < 0.85)::int), 6) as grey_share from v_scored")
def _(t: Tables) -> DataFrame:
    return routing.grey_zone(t("v_scored")).withColumn("grey_share", F.round("grey_share", 6))


@query("risk_band", "select case when score >= 0.8 then 'high' when score >= 0.5 then 'medium' when score >= 0.2 then 'low' else 'minimal' end as band, count(*) as n from v_scored group by 1")
def _(t: Tables) -> DataFrame:
    return t("v_scored").groupBy(routing.risk_band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


CONFUSION = """count(*) filter (where p and a) as tp, count(*) filter (where p and not a) as fp, count(*) filter (where not p and not a) as tn, count(*) filter (where not p and a) as fn"""


@query("confusion_report", f"""with c as (select merchant_category, {CONFUSION} from (select merchant_category, score >= 0.5 as p, label = 1 as a from v_scored) group by 1)
select *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1,
  round(coalesce(fp / nullif(fp + tn, 0), 0), 6) as fpr, round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0), 6) as accuracy from c""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    out = routing.confusion(t("v_scored"), F.col("score") >= 0.5, F.col("label") == 1, ["merchant_category"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "fpr", "accuracy")})


@query("review_impact", f"""with o as (select transaction_id, case when transaction_id % 3 = 0 then 'FRAUD' else 'LEGIT' end as r from v_scored where transaction_id % 2 = 0 and score >= 0.2 and score < 0.85),
b as (select {CONFUSION} from (select score >= 0.5 as p, label = 1 as a from v_scored)),
e as (select {CONFUSION} from (select case when r is not null then r = 'FRAUD' else score >= 0.5 end as p, label = 1 as a from v_scored left join o using (transaction_id)))
select b.fp as fp_before, e.fp as fp_after, round(b.fp / nullif(b.fp + b.tn, 0), 6) as fpr_before, round(e.fp / nullif(e.fp + e.tn, 0), 6) as fpr_after,
  round((b.fp - e.fp) / nullif(b.fp, 0) * 100, 4) as fp_reduction_pct from b, e""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    rows = t("v_scored")
    outcomes = rows.where("transaction_id % 2 = 0 and score >= 0.2 and score < 0.85").select("transaction_id", F.when(F.col("transaction_id") % 3 == 0, "FRAUD").otherwise("LEGIT").alias("review_decision"))
    out = routing.review_impact(rows, outcomes)
    return out.select("fp_before", "fp_after", F.round("fpr_before", 6).alias("fpr_before"), F.round("fpr_after", 6).alias("fpr_after"), F.round("fp_reduction_pct", 4).alias("fp_reduction_pct"))


@query("value_shares", "select merchant_category, count(*) as n, round(count(*) / (select count(*) from v_txn), 6) as share from v_txn group by 1")
def _(t: Tables) -> DataFrame:
    return routing.shares(t("v_txn"), "merchant_category").withColumn("share", F.round("share", 6))
