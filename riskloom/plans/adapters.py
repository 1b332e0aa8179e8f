"""Tables of the domain, made from the given ones by SQL that Spark and DuckDB both read.

MICROS(x) stands for microseconds since 1970, in each engine's words."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_txn": """
select event_id as transaction_id, cast(user_id as string) as user_id, MICROS(ts) as us, value as amount,
  event_type as merchant_category, concat('dev_', regexp_extract(props, '[0-9]+', 0)) as device_id,
  concat('city_', cast((event_id * 7 + user_id) % 12 as string)) as location,
  case when event_type = 'error' then 1 else 0 end as is_fraud
from events""",
    "v_rule_input": """
select concat('T', cast(o_orderkey as string)) as transaction_id,
  case when o_orderkey % 97 = 0 then 'user_vip_001' else concat('U', cast(o_custkey as string)) end as user_id,
  case when o_orderkey % 61 = 0 then 200.0 when o_orderkey % 59 = 0 then 2.5 when o_orderkey % 53 = 0 then null else cast(round(cast(o_totalprice / 50 as decimal(18, 6)), 2) as double) end as amount,
  cast(case when o_orderkey % 13 = 0 then null else 8000 end as double) as card_limit,
  case when o_orderkey % 89 = 0 then '4532123456789012' when o_orderkey % 17 = 0 then null else concat('card_', cast(o_custkey as string)) end as card_number_hash,
  case when o_orderkey % 83 = 0 then 'device_fraud_001' else concat('D', cast(o_orderkey % 1000 as string)) end as device_id,
  case when o_orderkey % 79 = 0 then 'x@TempMail.com' when o_orderkey % 73 = 0 then 'x@tempmail.com@y.org' when o_orderkey % 7 = 0 then null else concat('u', cast(o_custkey as string), '@gmail.com') end as email,
  case when o_orderkey % 77 = 0 then 'fakeinbox.com' else 'gmail.com' end as email_domain,
  case when o_orderkey % 5 = 0 then '' when o_orderkey % 6 = 0 then null when o_orderkey % 71 = 0 then 'unknown' else 'US' end as billing_country,
  case when c_nationkey = 3 then 'KP' when c_nationkey = 4 then 'IR' else null end as ip_country,
  case when c_nationkey = 5 then 'SY' when c_nationkey = 6 then 'CU' else 'FR' end as country_code,
  case when o_orderkey % 67 = 0 then 'True' when o_orderkey % 9 = 0 then '0' else null end as is_tor,
  case when o_orderkey % 101 = 0 then '1' else null end as tor_exit_node,
  cast(o_orderkey % 4 as bigint) as transactions_last_minute,
  cast(case when o_orderkey % 19 = 0 then null else o_orderkey % 8 end as bigint) as transactions_last_hour,
  cast(o_orderkey % 5 as bigint) as failed_attempts_last_hour,
  cast(case when o_orderkey % 3 = 0 then o_orderkey % 48 else null end as double) as account_age_hours,
  o_orderkey % 23 = 0 as is_first_transaction,
  cast(case when o_orderkey % 31 = 0 then null else o_orderkey % 24 end as int) as transaction_hour,
  cast(40 + c_nationkey as double) as transaction_lat, cast(c_nationkey * 3 as double) as transaction_lon,
  cast(case when o_orderkey % 10 = 0 then null else 40 + (c_nationkey + o_orderkey) % 20 end as double) as last_transaction_lat, cast(10.0 as double) as last_transaction_lon,
  MICROS(o_orderdate) + 7200000000 as txn_us, MICROS(o_orderdate) as last_us
from orders join customer on o_custkey = c_custkey""",
    "v_entity_edges": """
select distinct concat('A', cast(o_custkey as string)) as src, concat('D', cast(l_partkey as string)) as dst, 'USES' as rel_type
from orders join lineitem on o_orderkey = l_orderkey""",
    "v_ip_edges": """
select distinct concat('A', cast(o_custkey as string)) as src, concat('I', cast(o_orderkey % 300 as string)) as dst, 'CONNECTED_FROM' as rel_type from orders""",
    "v_transfers": """
select * from (
  select o_orderkey as transaction_id, concat('A', cast(o_custkey as string)) as src,
    concat('A', cast((o_custkey * 31 + o_orderkey) % (select count(*) from customer) as string)) as dst,
    'SENT_TO' as rel_type, o_totalprice as amount, MICROS(o_orderdate) as us
  from orders) x
where src <> dst""",
    "v_accounts": """
select concat('A', cast(c_custkey as string)) as account_id, c_nationkey as country,
  count(o_orderkey) as total_transactions,
  sum(case when o_orderstatus = 'P' and o_orderkey % 5 = 0 then 1 else 0 end) as fraud_transaction_count,
  cast(round(cast(coalesce(cast(sum(case when o_orderstatus = 'P' then 1 else 0 end) as double) / nullif(count(o_orderkey), 0), 0) as decimal(18, 8)), 4) as double) as risk_score
from customer left join orders on c_custkey = o_custkey group by c_custkey, c_nationkey""",
    "v_scored": """
select transaction_id, user_id, us, amount, merchant_category, is_fraud as label,
  least(1.0, cast((transaction_id * 7919) % 10000 as double) / 10000.0 * 0.7 + is_fraud * 0.3) as score,
  least(1.0, cast((transaction_id * 104729) % 10000 as double) / 10000.0 * 0.8 + is_fraud * 0.2) as score_b
from v_txn""",
    "v_features": """
select concat('U', cast(c_custkey as string)) as user_id, MICROS(max(o_orderdate)) as us,
  case when c_custkey % 11 = 0 then null else max(o_totalprice) end as avg_transaction_amount,
  case when c_custkey % 13 = 0 then null else count(o_orderkey) end as transaction_count,
  cast(case when c_custkey % 17 = 0 then null else c_acctbal end as double) as total_lifetime_value,
  c_custkey % 400 + 20 as account_age_days, c_custkey % 3 as device_count,
  case when c_custkey % 7 = 0 then 1 else 0 end as is_vpn, case when c_custkey % 9 = 0 then 1 else 0 end as is_high_risk_country,
  case when c_custkey % 5 = 0 then null else c_mktsegment end as account_type,
  case when c_custkey % 4 = 0 then null else concat('D', cast(c_custkey % 97 as string)) end as device_id,
  case when c_custkey % 6 = 0 then null else concat('mail', cast(c_custkey % 9 as string), '.com') end as email_domain,
  case when c_custkey % 14 = 0 then 1 when c_custkey % 9 = 0 and c_custkey % 2 = 0 then 1 else 0 end as is_fraud,
  case when c_custkey % 14 = 0 then 'velocity_attack' when c_custkey % 18 = 0 then 'card_testing' else 'normal' end as fraud_scenario,
  c_nationkey as country_key,
  round(cast((c_custkey * 7919) % 1000 as double) / 1000, 3) as fraud_score
from customer left join orders on c_custkey = o_custkey
group by c_custkey, c_acctbal, c_mktsegment, c_nationkey""",
    "v_findings": """
select conv_id as case_no, turn as step, role,
  case when (conv_id + turn) % 13 = 0 then 'not json' when (conv_id + turn) % 17 = 0 then null
    else concat('{"risk_level":"', case when conv_id % 5 = 0 then 'SEVERE' when conv_id % 5 = 1 then 'HIGH' when conv_id % 5 = 2 then 'CRITICAL' else 'LOW' end,
      '","confidence":', cast(round(cast((conv_id * 37 + turn * 11) % 140 as double) / 100 - 0.2, 2) as string),
      ',"anomaly_score":', cast(round(cast((conv_id * 13 + turn) % 150 as double) / 100, 2) as string),
      ',"n_flags":', cast(conv_id % 3 as string), ',"deeper":', case when conv_id % 2 = 0 then 'true' else 'false' end,
      ',"fraud_type":"', case when conv_id % 4 = 0 then 'card_testing' when conv_id % 4 = 1 then 'account_takeover' else 'time_anomaly' end,
      case when conv_id % 6 = 0 then '"' else concat('","final_decision":"', case when conv_id % 7 = 0 then 'MAYBE' when conv_id % 7 < 3 then 'FRAUD' else 'LEGIT' end, '"') end,
      ',"recommended_action":"', case when conv_id % 8 = 0 then 'NOTHING' else 'REVIEW' end, '"}') end as response
from conversations""",
    "v_case_events": """
select event_id, concat('C', cast(user_id as string)) as case_id, MICROS(ts) as us,
  case event_type when 'signup' then 'ENQUEUED' when 'view' then 'ASSIGNED' when 'click' then 'REQUEUED' when 'purchase' then 'RESOLVED' else 'TIMED_OUT' end as event,
  concat('analyst_', cast(event_id % 7 as string)) as analyst
from events""",
    "v_cases": """
select concat('C', cast(transaction_id as string)) as case_id, transaction_id, user_id, amount, score, us as created_us, 30 + transaction_id % 60 as sla_minutes,
  case when score >= 0.9 or amount >= 10000 then 'CRITICAL' when score >= 0.75 or amount >= 5000 then 'HIGH' when score >= 0.5 or amount >= 1000 then 'MEDIUM' else 'LOW' end as priority
from v_scored where score >= 0.5 and score < 0.85""",
    "v_card": """
select o_orderkey as transaction_id, (MICROS(o_orderdate) - 694224000000000) / 1000000 as dt, cast(round(cast(o_totalprice / 100 as decimal(18, 6)), 2) as double) as amt, o_orderpriority as product,
  case when o_custkey % 10 = 0 then null else o_custkey % 200 end as card1, case when o_orderkey % 8 = 0 then null else c_nationkey end as addr1,
  case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then 'T' else 'F' end as m1,
  case when o_orderkey % 40 = 0 then 1.0 else null end as sparse, c_mktsegment as domain,
  case when o_orderstatus = 'P' then 1 else 0 end as is_fraud
from orders join customer on o_custkey = c_custkey""",
}


def spark_sql(sql: str) -> str:
    """MICROS in Spark's words; it does not read the session's zone."""
    return re.sub(r"MICROS\(((?:[^()]|\([^()]*\))*)\)", r"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(\1 as timestamp_ntz))", sql)


def oracle(sql: str) -> str:
    """sql with the views that it reads in front, in DuckDB's words."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bv_\w+\b", text):
            if name in VIEWS and name not in order:
                need(VIEWS[name])
                order.append(name)

    need(sql)
    made = ", ".join(f"{n} as ({VIEWS[n]})" for n in order)
    body, recursive = sql.strip(), ""
    if body[:14].lower() == "with recursive":
        body, recursive = "with" + body[14:], "recursive "
    text = f"with {recursive}{made}, {body[4:]}" if made and body[:4].lower() == "with" else f"with {made} {body}" if made else sql
    if recursive and not made:
        text = sql
    return re.sub(r"MICROS\(((?:[^()]|\([^()]*\))*)\)", r"epoch_us(\1)", text)


class Tables:
    """The given tables and the views over them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        used = {n: self(n) for n in [*TABLES, *VIEWS] if n not in frames and f" {n}" in f" {text}".replace("\n", " ").replace("(", " ")}
        names = {n: f"{n}_{abs(hash((self.sf_dir, n))) % 10**9}" for n in used | frames}
        for n, df in (used | frames).items():
            df.createOrReplaceTempView(names[n])
            text = re.sub(rf"(?i)\b(from|join)\s+{n}\b(?!_)", rf"\1 {names[n]} as {n}" if n in TABLES else rf"\1 {names[n]}", text)
        return self.spark.sql(spark_sql(text))
