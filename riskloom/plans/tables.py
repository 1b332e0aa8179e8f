"""Queries of projections, joins, aggregates, samples, lists and profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S
from ..operators import lists, profiles, tables, velocity
from ..sources import database, versioned
from ..sources.io import shared_folder
from .adapters import Tables
from .registry import query

DAY = velocity.DAY


@query("filter_eval", "select user_id, fraud_scenario, is_fraud from v_features where is_fraud = 1 and fraud_scenario = 'velocity_attack'")
def _(t: Tables) -> DataFrame:
    return t("v_features").where("is_fraud = 1 and fraud_scenario = 'velocity_attack'").select("user_id", "fraud_scenario", "is_fraud")


@query(
    "model_matrix",
    """select cast(us as double) as us, coalesce(cast(avg_transaction_amount as double), 0) as avg_transaction_amount, coalesce(cast(transaction_count as double), 0) as transaction_count,
  coalesce(total_lifetime_value, 0) as total_lifetime_value, cast(account_age_days as double) as account_age_days, cast(device_count as double) as device_count, cast(is_vpn as double) as is_vpn,
  cast(is_high_risk_country as double) as is_high_risk_country, cast(country_key as double) as country_key from v_features where us is not null""",
)
def _(t: Tables) -> DataFrame:
    return tables.model_matrix(t("v_features").where("us is not null"), ("is_fraud", "fraud_score"))


DEFAULTS = {"user_id": "unknown", "avg_transaction_amount": 0.0, "transaction_count": 0, "account_type": "unknown", "email_domain": "unknown", "velocity_score": 0.0, "3d_secure_status": "unknown"}


@query(
    "defaults_applied",
    """select user_id, coalesce(avg_transaction_amount, 0.0) as avg_transaction_amount, coalesce(transaction_count, 0) as transaction_count, coalesce(account_type, 'unknown') as account_type,
  coalesce(email_domain, 'unknown') as email_domain, 0.0 as velocity_score, 'unknown' as "3d_secure_status" from v_features""",
)
def _(t: Tables) -> DataFrame:
    return tables.apply_defaults(t("v_features"), DEFAULTS)


MESSY = "case when c_custkey % 6 = 0 then 'abc' when c_custkey % 6 = 1 then '' when c_custkey % 6 = 2 then null when c_custkey % 6 = 3 then cast(c_custkey as string) when c_custkey % 6 = 4 then concat(cast(c_custkey as string), '.75') else '-1' end"


@query(
    "typed_decode",
    f"""select c_custkey, coalesce(try_cast(x as double), 0.5) as as_double, coalesce(cast(trunc(try_cast(x as double)) as bigint), 7) as as_long,
  coalesce(trunc(try_cast(x as double)) <> 0, false) as as_flag from (select c_custkey, {MESSY} as x from customer)""",
)
def _(t: Tables) -> DataFrame:
    x = F.expr(MESSY)
    return t("customer").select("c_custkey", S.safe_double(x, 0.5).alias("as_double"), S.safe_long(x, 7).alias("as_long"), S.safe_flag(x).alias("as_flag"))


@query(
    "feature_check",
    "select * from (values ('avg_transaction_amount', 'ok', 0), ('account_type', 'wrong type', (select count(*) from v_features where account_type is not null)), ('velocity_score', 'missing', 0)) v(feature, state, failed_casts)",
)
def _(t: Tables) -> DataFrame:
    return tables.feature_report(t("v_features"), {"avg_transaction_amount": "double", "account_type": "double", "velocity_score": "double"})


@query(
    "catalogue_summary",
    """select 'velocity' as grp, 2 as features, count(avg_transaction_amount) + count(transaction_count) as filled from v_features union all select 'device', 2, count(device_count) + count(is_vpn) from v_features
union all select 'network', 1, count(email_domain) from v_features union all select 'geo', 1, count(is_high_risk_country) from v_features union all select 'identity', 1, count(account_age_days) from v_features""",
)
def _(t: Tables) -> DataFrame:
    return schema.filled_by_group(t("v_features"))


@query(
    "catalogue_defaults",
    "select user_id, coalesce(avg_transaction_amount, 0.0) as avg_transaction_amount, coalesce(transaction_count, 0) as transaction_count, coalesce(email_domain, 'unknown') as email_domain, 'unknown' as \"3d_secure_status\", 174 as n_features from v_features",
)
def _(t: Tables) -> DataFrame:
    """Every feature of the catalogue, its default where the table has no value."""
    rows = t("v_features")
    made = tables.apply_defaults(rows, {"user_id": "unknown"} | schema.defaults())
    return made.select("user_id", "avg_transaction_amount", "transaction_count", "email_domain", "3d_secure_status", F.lit(len(made.columns) - 1).alias("n_features"))


@query("entity_projection", "select distinct user_id, device_id from v_features where device_id is not null")
def _(t: Tables) -> DataFrame:
    return t("v_features").where("device_id is not null").select("user_id", "device_id").distinct()


@query("transaction_adapter", "select transaction_id, user_id, round(amount, 2) as amount, merchant_category as merchant, device_id, is_fraud = 1 as ground_truth from v_txn")
def _(t: Tables) -> DataFrame:
    return t("v_txn").select("transaction_id", "user_id", F.round("amount", 2).alias("amount"), F.col("merchant_category").alias("merchant"), "device_id", (F.col("is_fraud") == 1).alias("ground_truth"))


@query("identity_join", "select d.doc_id, d.n_chars, l.quality, l.toxic from documents d left join labels l using (doc_id)")
def _(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", "n_chars").join(t("labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


@query("rate_by_key", "select card1, round(avg(is_fraud), 6) as rate from v_card where card1 is not null group by 1")
def _(t: Tables) -> DataFrame:
    return tables.mean_by(t("v_card").where("card1 is not null"), ["card1"], "is_fraud").withColumn("rate", F.round("rate", 6))


@query(
    "target_rate",
    "with r as (select card1, avg(is_fraud) as rate from v_card where transaction_id % 5 <> 0 and card1 is not null group by 1) select transaction_id, round(coalesce(rate, 0.035), 6) as rate from v_card left join r using (card1) where transaction_id % 5 = 0",
)
def _(t: Tables) -> DataFrame:
    cards = t("v_card")
    rates = tables.mean_by(cards.where("transaction_id % 5 <> 0 and card1 is not null"), ["card1"], "is_fraud")
    return tables.with_rate(cards.where("transaction_id % 5 = 0"), rates, ["card1"], 0.035).select("transaction_id", F.round("rate", 6).alias("rate"))


@query("semi_top_users", "select count(*) as n, round(sum(amount), 2) as amount from v_txn where user_id in (select user_id from v_txn group by 1 order by max(amount) desc, user_id limit 20)")
def _(t: Tables) -> DataFrame:
    rows = t("v_txn")
    return rows.join(tables.top_users(rows, "user_id", "amount", 20), "user_id", "left_semi").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query("top_users", "select user_id, max(amount) as amount from v_txn group by 1 order by 2 desc, 1 limit 20")
def _(t: Tables) -> DataFrame:
    return tables.top_users(t("v_txn"), "user_id", "amount", 20)


@query("holdout_rows", "select transaction_id from v_txn where transaction_id not in (select event_id from events where event_id % 5 = 0)")
def _(t: Tables) -> DataFrame:
    rows = t("v_txn")
    return rows.join(rows.where("transaction_id % 5 = 0").select("transaction_id"), "transaction_id", "left_anti").select("transaction_id")


@query("latency_percentiles", "select round(quantile_cont(amount, 0.5), 6) as p50, round(quantile_cont(amount, 0.95), 6) as p95, round(quantile_cont(amount, 0.99), 6) as p99 from v_txn")
def _(t: Tables) -> DataFrame:
    return tables.percentiles(t("v_txn"), "amount").select(*(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


def _stats_sql(c: str) -> str:
    x = f"cast({c} as double)"
    return f"select '{c}' as feature, count({c}) as \"rows\", round(avg({x}), 4) as mean, round(stddev_pop({x}), 4) as std, min({x}) as \"min\", max({x}) as \"max\", round(quantile_cont({x}, 0.5), 4) as median, round(quantile_cont({x}, 0.25), 4) as q25, round(quantile_cont({x}, 0.75), 4) as q75 from v_features"


@query("baseline_stats", " union all ".join(map(_stats_sql, ("avg_transaction_amount", "transaction_count", "total_lifetime_value"))))
def _(t: Tables) -> DataFrame:
    out = tables.baseline_stats(t("v_features"), ["avg_transaction_amount", "transaction_count", "total_lifetime_value"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "median", "q25", "q75")})


@query("class_balance", "select sum(is_fraud) as fraud, sum(1 - is_fraud) as legit, round(avg(is_fraud), 6) as fraud_rate, round(sum(1 - is_fraud) / sum(is_fraud), 6) as imbalance from v_txn")
def _(t: Tables) -> DataFrame:
    return tables.class_balance(t("v_txn"), "is_fraud").withColumns({c: F.round(c, 6) for c in ("fraud_rate", "imbalance")})


_MISSING = ("avg_transaction_amount", "transaction_count", "account_type", "device_id", "email_domain")


@query(
    "missing_share",
    " union all ".join(f"select '{c}' as \"column\", round(avg(({c} is null)::int), 6) as missing from v_features" for c in _MISSING)
    + " union all select '*', round((" + " + ".join(f"avg(({c} is null)::int)" for c in _MISSING) + ") / 5, 6) from v_features",
)
def _(t: Tables) -> DataFrame:
    return tables.missing_share(t("v_features").select(*_MISSING)).withColumn("missing", F.round("missing", 6))


@query("duplicate_rows", "select cast(sum(n - 1) as bigint) as duplicates, cast(sum(n) as bigint) as total from (select count(*) as n from v_txn group by user_id, device_id, merchant_category)")
def _(t: Tables) -> DataFrame:
    return tables.duplicate_rows(t("v_txn").select("user_id", "device_id", "merchant_category"))


@query("label_correlation", "select round(corr(is_vpn, is_fraud), 6) as vpn, round(corr(is_high_risk_country, is_fraud), 6) as country from v_features")
def _(t: Tables) -> DataFrame:
    return t("v_features").agg(F.round(F.corr("is_vpn", "is_fraud"), 6).alias("vpn"), F.round(F.corr("is_high_risk_country", "is_fraud"), 6).alias("country"))


@query("seeded_sample", "select transaction_id from v_txn order by md5(concat(cast(transaction_id as string), ':42')), transaction_id limit 100")
def _(t: Tables) -> DataFrame:
    return tables.seeded_sample(t("v_txn"), "transaction_id", 100).select("transaction_id")


@query(
    "stratified_split",
    "select transaction_id, row_number() over (partition by is_fraud order by md5(concat(cast(transaction_id as string), ':42')), transaction_id) <= round(count(*) over (partition by is_fraud) * 0.2) as is_test from v_txn",
)
def _(t: Tables) -> DataFrame:
    return tables.stratified_split(t("v_txn"), "transaction_id", "is_fraud").select("transaction_id", "is_test")


@query("folds", "select transaction_id, (row_number() over (partition by is_fraud order by md5(concat(cast(transaction_id as string), ':42')), transaction_id) - 1) % 5 as fold from v_txn")
def _(t: Tables) -> DataFrame:
    return tables.folds(t("v_txn"), "transaction_id", "is_fraud", 5).select("transaction_id", "fold")


@query("category_codes", "select value, row_number() over (order by value) - 1 as code from (select distinct c_mktsegment as value from customer)")
def _(t: Tables) -> DataFrame:
    return tables.category_codes(t("customer"), "c_mktsegment")


@query(
    "prev_txn_travel",
    """select transaction_id, round(2 * 6371 * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))), 3) as km, us - pus as gap_us
from (select *, lag(lat) over w as plat, lag(lon) over w as plon, lag(us) over w as pus
  from (select *, cast(transaction_id % 60 as double) as lat, cast(transaction_id % 90 as double) as lon from v_txn) window w as (partition by user_id order by us, transaction_id))""",
)
def _(t: Tables) -> DataFrame:
    own = Window.partitionBy("user_id").orderBy("us", "transaction_id")
    rows = t("v_txn").withColumns({"lat": (F.col("transaction_id") % 60).cast("double"), "lon": (F.col("transaction_id") % 90).cast("double")})
    rows = rows.withColumns({f"p{c}": F.lag(c).over(own) for c in ("lat", "lon", "us")})
    km = S.haversine_km(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))
    return rows.select("transaction_id", F.round(km, 3).alias("km"), (F.col("us") - F.col("pus")).alias("gap_us"))


@query("scenario_union", "select transaction_id, amount, scenario from (select transaction_id, amount, null as scenario from v_txn union all select -transaction_id, null, merchant_category from v_txn where is_fraud = 1)")
def _(t: Tables) -> DataFrame:
    rows = t("v_txn")
    extra = rows.where("is_fraud = 1").select((-F.col("transaction_id")).alias("transaction_id"), F.col("merchant_category").alias("scenario"))
    return rows.select("transaction_id", "amount").unionByName(extra, allowMissingColumns=True)


# Block lists.
LISTS_SQL = "select 'user' as entity_type, user_id as entity, max(us) as added_at from v_txn where transaction_id % 50 = 0 group by 2 union all select 'device', device_id, max(us) from v_txn where transaction_id % 31 = 0 group by 2"


@query(
    "blocklist_screen",
    f"""with l as ({LISTS_SQL}) select transaction_id, u.entity is not null or d.entity is not null as blocked,
  concat_ws('|', case when u.entity is not null then concat('user: ', user_id) end, case when d.entity is not null then concat('device: ', device_id) end) as reasons
from v_txn left join (select distinct entity from l where entity_type = 'user') u on u.entity = user_id left join (select distinct entity from l where entity_type = 'device') d on d.entity = device_id""",
)
def _(t: Tables) -> DataFrame:
    out = lists.screen(t("v_txn"), t.sql(LISTS_SQL), {"user": F.col("user_id"), "device": F.col("device_id"), "email_domain": F.lit("x@Clean.org")})
    return out.select("transaction_id", "blocked", F.array_join("block_reasons", "|").alias("reasons"))


@query(
    "blocklist_seed",
    "with r as (select * from v_txn where is_fraud = 1 and us > (select max(us) from v_txn) - 2592000000000) select 'user' as entity_type, user_id as entity, (select max(us) from v_txn) as added_at from r union select 'device', device_id, (select max(us) from v_txn) from r where device_id <> ''",
)
def _(t: Tables) -> DataFrame:
    rows = t("v_txn")
    as_of = rows.agg(F.max("us")).first()[0]
    return lists.seeded(rows, as_of, 30 * DAY, {"user": F.col("user_id"), "device": F.col("device_id")})


@query(
    "blocklist_add_remove",
    f"with l as ({LISTS_SQL}), n as (select 'user' as entity_type, user_id as entity, us + 1 as added_at from v_txn where transaction_id % 33 = 0) select entity_type, entity, max(added_at) as added_at from (select * from l union all select * from n) where not (entity_type = 'device' and entity in (select device_id from v_txn where transaction_id % 62 = 0)) group by 1, 2",
)
def _(t: Tables) -> DataFrame:
    rows = t("v_txn")
    more = rows.where("transaction_id % 33 = 0").select(F.lit("user").alias("entity_type"), F.col("user_id").alias("entity"), (F.col("us") + 1).alias("added_at"))
    gone = rows.where("transaction_id % 62 = 0").select(F.lit("device").alias("entity_type"), F.col("device_id").alias("entity")).distinct()
    return lists.remove(lists.add(t.sql(LISTS_SQL), more), gone)


@query("ttl_expired", "select transaction_id, us + 604800000000 - (select max(us) from v_txn) as left_us from v_txn where us > (select max(us) from v_txn) - 604800000000")
def _(t: Tables) -> DataFrame:
    rows = t("v_txn")
    return profiles.expired(rows, rows.agg(F.max("us")).first()[0], 7 * DAY, "us").select("transaction_id", "left_us")


# Profiles.
PROFILE_ROWS = """select cast(o_custkey as string) as user_id, o_orderkey as transaction_id, MICROS(o_orderdate) as us, o_totalprice as amount_avg, o_orderkey % 30 as n,
  case when o_orderkey % 4 = 0 then null else o_orderkey % 5 end as declined, o_orderkey % 3 as chargebacks, o_orderkey % 4 as devices, o_orderkey % 2 = 0 as verified,
  o_orderpriority as account_type, concat('country_', cast(o_orderkey % 25 as string)) as country, concat('D', cast(o_orderkey % 97 as string)) as device_id from orders"""
BUILT_SQL = f"""select user_id, round(arg_max(coalesce(amount_avg * n, 0), (us, transaction_id)), 2) as total_lifetime_value, round(arg_max(coalesce(amount_avg * n / 24, 0), (us, transaction_id)), 2) as avg_monthly_spend,
  arg_max(coalesce(declined, 0), (us, transaction_id)) as fraud_flag_count, arg_max(chargebacks, (us, transaction_id)) as chargeback_count, arg_max(coalesce(declined, 0) > 2 or chargebacks >= 2, (us, transaction_id)) as is_high_risk,
  arg_max(n, (us, transaction_id)) as total_transactions, arg_min(verified, (us, transaction_id)) as kyc_verified, arg_min(account_type, (us, transaction_id)) as account_type,
  arg_min(substr(country, 1, 8), (us, transaction_id)) as country_of_residence, arg_min(device_id, (us, transaction_id)) as primary_device_id, max(greatest(devices, 1)) as device_count, max(us) as last_transaction_at from r group by 1"""


@query("profiles_built", f"with r as ({PROFILE_ROWS}) {BUILT_SQL}")
def _(t: Tables) -> DataFrame:
    return profiles.build_profiles(t.sql(PROFILE_ROWS))


@query("profile_rollup", f"with r as ({PROFILE_ROWS}), b as ({BUILT_SQL}) select account_type, count(*) as users, cast(sum(total_transactions) as bigint) as transactions from b group by 1")
def _(t: Tables) -> DataFrame:
    return profiles.build_profiles(t.sql(PROFILE_ROWS)).groupBy("account_type").agg(F.count("*").alias("users"), F.sum("total_transactions").alias("transactions"))


def _two(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.sql(PROFILE_ROWS)
    made = [profiles.build_profiles(rows.where(f"transaction_id % 3 {op} 0")).withColumn("account_status", F.lit(s)) for op, s in (("=", "Active"), ("<>", "Review"))]
    return made[0], made[1].withColumn("account_type", F.when(F.col("total_transactions") % 2 == 0, F.col("account_type")))


UPSERTED_SQL = f"""with a as (select *, 'Active' as account_status from (with r as (select * from ({PROFILE_ROWS}) where transaction_id % 3 = 0) {BUILT_SQL})),
b as (select *, 'Review' as account_status from (with r as (select * from ({PROFILE_ROWS}) where transaction_id % 3 <> 0) {BUILT_SQL}))
select user_id, coalesce(case when b.total_transactions % 2 = 0 then b.account_type end, a.account_type) as account_type, coalesce(b.account_status, a.account_status) as account_status,
  coalesce(b.fraud_flag_count, a.fraud_flag_count) as fraud_flag_count, greatest(a.device_count, b.device_count) as device_count, greatest(a.last_transaction_at, b.last_transaction_at) as last_transaction_at
from a full join b using (user_id)"""


@query("profiles_upserted", UPSERTED_SQL)
def _(t: Tables) -> DataFrame:
    return profiles.upsert_profiles(*_two(t)).select("user_id", "account_type", "account_status", "fraud_flag_count", "device_count", "last_transaction_at")


@query("profiles_stored", UPSERTED_SQL)
def _(t: Tables) -> DataFrame:
    """The same, into a stored table in hash buckets."""
    current, incoming = _two(t)
    root = f"{shared_folder(t.spark)}/profiles-{uuid.uuid4().hex}"
    versioned.create(current, root, "user_id")
    versioned.upsert(incoming, root, profiles.upsert_profiles)
    return versioned.read(t.spark, root).select("user_id", "account_type", "account_status", "fraud_flag_count", "device_count", "last_transaction_at")


@query("profiles_in_database", UPSERTED_SQL)
def _(t: Tables) -> DataFrame:
    """The same, merged into a table of a database and read back in ranges of the last time. The
    database is that of spark.riskloom.jdbc.url; where all work is done on this machine and none
    is named, one in memory."""
    url = t.spark.conf.get("spark.riskloom.jdbc.url", None)
    if not url:
        if not t.spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.riskloom.jdbc.url to a database that the driver and all executors reach")
        url = "jdbc:derby:memory:riskloom;create=true"
    columns = ["user_id", "account_type", "account_status", "fraud_flag_count", "device_count", "last_transaction_at"]
    current, incoming = (p.select(*columns) for p in _two(t))
    table = f"profiles_{uuid.uuid4().hex}"
    database.create_table(current, url, table, profiles.DATABASE_TYPES, ["user_id"])
    for rows in (current, incoming):
        database.merge_table(rows, url, table, profiles.DATABASE_TYPES, ["user_id"], profiles.DATABASE_MERGE)
    return database.read_table(t.spark, url, table, by="last_transaction_at", parts=t.spark.sparkContext.defaultParallelism)


@query(
    "profiles_flagged_frozen",
    f"""with r as ({PROFILE_ROWS}), b as ({BUILT_SQL}) select user_id, fraud_flag_count + (cast(user_id as int) % 7 = 0)::int as fraud_flag_count, is_high_risk or cast(user_id as int) % 7 = 0 as is_high_risk,
  case when cast(user_id as int) % 11 = 0 then 'Frozen' when cast(user_id as int) % 7 = 0 then 'Flagged' else 'Active' end as account_status from b""",
)
def _(t: Tables) -> DataFrame:
    p = profiles.build_profiles(t.sql(PROFILE_ROWS)).withColumn("account_status", F.lit("Active"))
    pick = lambda n: p.where(F.col("user_id").cast("int") % n == 0).select("user_id")
    return profiles.freeze_users(profiles.flag_users(p, pick(7)), pick(11)).select("user_id", "fraud_flag_count", "is_high_risk", "account_status")


@query("profile_lookup", f"with r as ({PROFILE_ROWS}), b as ({BUILT_SQL}) select c_custkey, b.total_transactions, b.account_type from customer join b on cast(c_custkey as string) = b.user_id where c_custkey % 2 = 0")
def _(t: Tables) -> DataFrame:
    wanted = t("customer").where("c_custkey % 2 = 0").select("c_custkey", F.col("c_custkey").cast("string").alias("user_id"))
    return wanted.join(profiles.build_profiles(t.sql(PROFILE_ROWS)), "user_id").select("c_custkey", "total_transactions", "account_type")


HOT_SQL = """with h as (select user_id, us, transaction_id, count(*) over a as transactions_last_hour, count(*) over b as transactions_last_day, count(*) over c as transaction_count from v_txn
  window a as (partition by user_id order by us range between 3599999999 preceding and current row), b as (partition by user_id order by us range between 86399999999 preceding and current row), c as (partition by user_id order by us range between unbounded preceding and current row)),
top as (select user_id from h group by 1 order by max(transaction_count) desc, user_id limit 50),
hot as (select user_id, transactions_last_hour, transactions_last_day from h where user_id in (from top) qualify row_number() over (partition by user_id order by us desc, transaction_id desc) = 1)"""


def _hot(t: Tables) -> DataFrame:
    return profiles.hot_table(velocity.velocity_block(t("v_txn")), 50, order=("us", "transaction_id"), columns=("transactions_last_hour", "transactions_last_day"))


@query("hot_table", HOT_SQL + " select * from hot")
def _(t: Tables) -> DataFrame:
    return _hot(t)


@query("hot_update", HOT_SQL + " select user_id, case when cast(user_id as int) % 2 = 0 then 99 else transactions_last_hour end as transactions_last_hour, transactions_last_day from hot")
def _(t: Tables) -> DataFrame:
    changes = t("v_txn").select("user_id").distinct().where(F.col("user_id").cast("int") % 2 == 0).withColumns({"transactions_last_hour": F.lit(99).cast("long"), "other": F.lit(1)})
    return profiles.hot_update(_hot(t), changes)


@query("hot_deleted", HOT_SQL + " select * from hot where cast(user_id as int) % 3 <> 0")
def _(t: Tables) -> DataFrame:
    hot = _hot(t)
    return hot.join(t("v_txn").select("user_id").distinct().where(F.col("user_id").cast("int") % 3 == 0), "user_id", "left_anti")


@query(
    "feature_resolution",
    HOT_SQL + f""", r as ({PROFILE_ROWS}), b as ({BUILT_SQL}) select transaction_id, coalesce(hot.transactions_last_hour, 0) as transactions_last_hour, coalesce(b.total_transactions, 0) as total_transactions_ever,
  coalesce(b.country_of_residence, 'unknown') as country, amount, 0 as device_age_days from v_txn left join hot using (user_id) left join b using (user_id)""",
)
def _(t: Tables) -> DataFrame:
    defaults = {"transactions_last_hour": 0, "total_transactions_ever": 0, "country": "unknown", "amount": 0.0, "device_age_days": 0}
    out = profiles.resolve_features(t("v_txn").select("transaction_id", "user_id", "amount"), _hot(t).select("user_id", "transactions_last_hour"), profiles.build_profiles(t.sql(PROFILE_ROWS)), defaults)
    return out.drop("user_id")


@query("review_context", f"with r as ({PROFILE_ROWS}), b as ({BUILT_SQL}) select c.user_id, b.total_transactions, case when b.user_id is null then 'not_found' else 'found' end as status from (select cast(c_custkey as string) as user_id from customer) c left join b using (user_id)")
def _(t: Tables) -> DataFrame:
    users = t("customer").select(F.col("c_custkey").cast("string").alias("user_id"))
    return profiles.review_context(users, profiles.build_profiles(t.sql(PROFILE_ROWS))).select("user_id", "total_transactions", "status")


@query("scalar_text", "select o_orderkey, lower(string_split(e, '@')[2]) as second, case when contains(e, '@') then lower(string_split(e, '@')[-1]) else '' end as last, concat(substr(e, 1, 4), '...') as prefix from (select o_orderkey, case when o_orderkey % 3 = 0 then concat('u', cast(o_orderkey as string), '@Mail.com') when o_orderkey % 3 = 1 then 'a@B.com@C.org' else 'plain' end as e from orders)")
def _(t: Tables) -> DataFrame:
    e = F.expr("case when o_orderkey % 3 = 0 then concat('u', cast(o_orderkey as string), '@Mail.com') when o_orderkey % 3 = 1 then 'a@B.com@C.org' else 'plain' end")
    return t("orders").select("o_orderkey", S.domain_second(e).alias("second"), S.domain_last(e).alias("last"), S.masked(e, 4).alias("prefix"))


@query("scalar_calendar", "select transaction_id, us // 86400000000 as day, (us % 86400000000) // 3600000000 as hour, (us // 86400000000 + 3) % 7 as weekday, (us // 86400000000 + 3) % 7 >= 5 as weekend, (us % 86400000000) // 3600000000 between 9 and 17 as business, (us % 86400000000) // 3600000000 >= 22 or (us % 86400000000) // 3600000000 < 6 as night from v_txn")
def _(t: Tables) -> DataFrame:
    rows = t("v_txn").selectExpr("transaction_id", "us div 86400000000 as day", "(us % 86400000000) div 3600000000 as hour").withColumn("weekday", (F.col("day") + 3) % 7)
    return rows.withColumns({"weekend": F.col("weekday") >= 5, "business": F.col("hour").between(9, 17), "night": (F.col("hour") >= 22) | (F.col("hour") < 6)})


@query("scalar_numeric", "select transaction_id, round(least(greatest(amount / 300 - 0.2, 0), 1), 4) as clamped, round(2 * abs(score - 0.5), 6) as model_confidence, greatest(score, 1 - score) >= 0.8 as sure from v_scored")
def _(t: Tables) -> DataFrame:
    s = F.col("score")
    return t("v_scored").select("transaction_id", F.round(S.clamp(F.col("amount") / 300 - 0.2), 4).alias("clamped"), F.round(2 * F.abs(s - 0.5), 6).alias("model_confidence"), (F.greatest(s, 1 - s) >= 0.8).alias("sure"))


@query("top_scores", "select transaction_id, round(score, 6) as score from v_scored order by v_scored.score desc, transaction_id limit 50")
def _(t: Tables) -> DataFrame:
    return t("v_scored").orderBy(F.desc("score"), "transaction_id").limit(50).select("transaction_id", F.round("score", 6).alias("score"))


HOT_FLAT = "select 'hot' as part, count(*) as n from hot union all select 'windows', count(distinct user_id) from v_txn where us > (select max(us) from v_txn) - 86400000000 union all select 'lists', count(*) from l"


@query("warm_report", HOT_SQL + f", l as ({LISTS_SQL}) {HOT_FLAT}")
def _(t: Tables) -> DataFrame:
    rows = t("v_txn")
    parts = {"hot": _hot(t), "windows": velocity.warm_windows(rows, rows.agg(F.max("us")).first()[0]), "lists": t.sql(LISTS_SQL)}
    counts = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, d in parts.items()]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


@query("hot_from_records", "select user_id, coalesce(transaction_count, 0) as transaction_count from v_features where user_id <> '' and user_id is not null and account_type is not null")
def _(t: Tables) -> DataFrame:
    rows = t("v_features").withColumn("user_id", F.when(F.col("account_type").isNull(), "").otherwise(F.col("user_id")))
    return rows.where("user_id is not null and user_id <> ''").select("user_id", F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"))


@query("profiles_serialised", f"with r as ({PROFILE_ROWS}), b as ({BUILT_SQL}) select user_id, strftime(make_timestamp(last_transaction_at), '%Y-%m-%dT%H:%M:%S') as last_transaction_at from b")
def _(t: Tables) -> DataFrame:
    return profiles.serialised(profiles.build_profiles(t.sql(PROFILE_ROWS)), ("last_transaction_at",)).select("user_id", "last_transaction_at")
