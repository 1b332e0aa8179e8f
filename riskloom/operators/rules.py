"""Thirteen ordered rules as column expressions, and how they combine.

NULL input means missing: the rule's default applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RULE_ORDER, RuleConfig
from ..functions.scalars import domain_second, first_filled, haversine_km, masked
from . import lists


class Hit:
    """A way in which a rule fires, and what it says then."""

    def __init__(self, name: str, fired: Column, decision: str, severity: str | None, reason: Column, confidence: float, **metadata: Column):
        self.fired, self.reason = F.coalesce(fired, F.lit(False)), reason
        self.stops = severity == "CRITICAL" or decision == "APPROVE"
        self.decision, self.high = decision, severity == "HIGH"
        meta = F.create_map(*(x for k, v in metadata.items() for x in (F.lit(k), v.cast("string")))) if metadata else F.create_map().cast("map<string,string>")
        self.struct = F.struct(
            F.lit(name).alias("rule_name"),
            F.lit(decision).alias("decision"),
            F.lit(severity).cast("string").alias("severity"),
            reason.alias("reason"),
            F.lit(confidence).alias("confidence"),
            meta.alias("metadata"),
        )


def list_columns(c: RuleConfig) -> dict[str, Column]:
    """The lists of the rules, and what each holds of a row."""
    col = F.col
    return {
        "stolen_cards": col("card_number_hash"),
        "sanctioned_countries": first_filled(col("billing_country"), col("ip_country"), col("country_code")),
        "fraud_devices": col("device_id"),
        "fraud_domains": F.coalesce(domain_second(F.nullif(col("email"), F.lit(""))), F.when(first_filled(col("email")).isNull(), F.lower(col("email_domain")))),
        "vip_users": col("user_id"),
    }


def rule_hits_of(c: RuleConfig, on_list: dict[str, Column] | None = None) -> dict[str, list[Hit]]:
    """The ways in which each rule fires; the first that applies counts. on_list: whether a row
    is on a list, for lists that are tables; the others are those of the configuration."""
    col = F.col
    held = {name: value.isin(*getattr(c, name)) for name, value in list_columns(c).items()} | (on_list or {})
    amount = F.coalesce(col("amount"), F.lit(0.0))
    limit = F.coalesce(col("card_limit"), F.lit(c.card_limit))
    count = lambda name: F.coalesce(col(name), F.lit(0))
    country = first_filled(col("billing_country"), col("ip_country"), col("country_code"))
    onion = lambda name: F.lower(col(name).cast("string")).isin("1", "true") & col(name).isNotNull()
    truthy = lambda name: col(name).isNotNull() & ~col(name).cast("string").isin("", "0", "false", "False")
    tor = F.when(truthy("is_tor"), onion("is_tor")).otherwise(onion("tor_exit_node"))
    domain = F.coalesce(domain_second(F.nullif(col("email"), F.lit(""))), F.when(first_filled(col("email")).isNull(), F.lower(col("email_domain"))))
    hours = (F.unix_micros(col("transaction_time").cast("timestamp")) - F.unix_micros(col("last_transaction_time").cast("timestamp"))) / 3.6e9
    km = haversine_km(col("last_transaction_lat"), col("last_transaction_lon"), col("transaction_lat"), col("transaction_lon"))
    age = F.coalesce(col("account_age_hours"), F.lit(999999.0))
    hour = F.coalesce(col("transaction_hour"), F.lit(12))
    money = lambda x: F.format_string("%.2f", x)
    young, first = age < c.new_account_hours, F.coalesce(col("is_first_transaction"), F.lit(False))
    many, failed = count("transactions_last_hour") > c.per_hour_limit, count("failed_attempts_last_hour") > c.failed_limit
    return {
        "check_stolen_card": [Hit("check_stolen_card", held["stolen_cards"], "DECLINE", "CRITICAL", F.lit("Card is on the stolen list"), 1.0, card_hash=masked(col("card_number_hash"), 8))],
        "check_sanctioned_country": [Hit("check_sanctioned_country", held["sanctioned_countries"], "DECLINE", "CRITICAL", F.concat(F.lit("Sanctioned country: "), country), 1.0, country=country)],
        "check_fraud_device": [Hit("check_fraud_device", held["fraud_devices"], "DECLINE", "CRITICAL", F.lit("Device is on the fraud list"), 1.0, device_id=masked(col("device_id"), 10))],
        "check_tor": [Hit("check_tor", tor, "DECLINE", "CRITICAL", F.lit("TOR exit node"), 1.0, is_tor=F.lit("true"))],
        "check_email_domain": [Hit("check_email_domain", held["fraud_domains"], "DECLINE", "CRITICAL", F.concat(F.lit("Disposable e-mail domain: "), domain), 0.9, domain=domain)],
        "check_amount_exceeds_limit": [Hit("check_amount_exceeds_limit", amount > limit, "DECLINE", "CRITICAL", F.concat(F.lit("Amount "), money(amount), F.lit(" over card limit "), money(limit)), 1.0, amount=amount, limit=limit)],
        "check_velocity_limits": [
            Hit("check_velocity_limits", many, "DECLINE", "HIGH", F.concat(count("transactions_last_hour").cast("string"), F.lit(f" transactions an hour (limit {c.per_hour_shown})")), 0.95, txn_per_hour=count("transactions_last_hour")),
            Hit("check_velocity_limits", failed, "DECLINE", "HIGH", F.concat(count("failed_attempts_last_hour").cast("string"), F.lit(" failed attempts")), 0.92, failed_attempts=count("failed_attempts_last_hour")),
        ],
        "check_card_testing_pattern": [Hit("check_card_testing_pattern", amount.isin(*c.round_amounts) & (count("transactions_last_minute") >= c.round_per_minute), "DECLINE", "HIGH", F.lit("Card testing: round amount in a burst"), 0.93, amount=amount, txn_per_minute=count("transactions_last_minute"))],
        "check_vip_user": [Hit("check_vip_user", held["vip_users"] & (amount <= c.vip_amount), "APPROVE", None, F.lit("VIP user under the VIP amount"), 0.99, user_id=col("user_id"))],
        "check_micro_transaction": [Hit("check_micro_transaction", amount < c.micro_amount, "APPROVE", None, F.concat(F.lit("Micro amount "), money(amount)), 0.95, amount=amount)],
        "check_impossible_travel": [Hit("check_impossible_travel", (hours > 0) & (km / hours > c.travel_kmh), "DECLINE", "HIGH", F.concat(F.format_string("%.0f", km), F.lit(" km in "), F.format_string("%.1f", hours), F.lit(" h")), 0.98, distance_km=km, hours=hours)],
        "check_new_account_risk": [
            Hit("check_new_account_risk", young & (amount > c.new_account_amount), "DECLINE", "HIGH", F.concat(F.lit("New account, amount "), money(amount)), 0.88, account_age_hours=age, amount=amount),
            Hit("check_new_account_risk", first & (amount > c.first_amount), "DECLINE", "MEDIUM", F.concat(F.lit("First transaction, amount "), money(amount)), 0.82, amount=amount),
        ],
        "check_behavioral_anomalies": [Hit("check_behavioral_anomalies", hour.between(*c.night_hours) & (amount > c.night_amount), "PASS_TO_ML", "MEDIUM", F.concat(F.lit("High amount at hour "), hour.cast("string")), 0.65, hour=hour, amount=amount)],
    }


def evaluate_rules(df: DataFrame, config: RuleConfig = RuleConfig(), tables: DataFrame | None = None, id: str = "transaction_id") -> DataFrame:
    """df with triggered (array of hits), triggered_names, rules_decision, primary_reason and
    continue_to_ml.

    The first CRITICAL hit declines and the first APPROVE hit approves, whichever stands
    first; later rules are not listed. Else two HIGH hits decline; else the row passes on.
    Which rules fire is worked out as plain flags; reasons are made for hits only, and only
    where a reader asks for them. tables: list, entity: rows of the lists of list_columns in
    place of those of the configuration; a list without a row is empty."""
    on_list = None
    if tables is not None:
        df = lists.listed(df, tables, list_columns(config), id)
        on_list = {name: F.col(f"_in_{name}") for name in list_columns(config)}
    made = rule_hits_of(config, on_list)
    rules = [made[name] for name in RULE_ORDER if name not in config.disabled]
    names = [name for name in RULE_ORDER if name not in config.disabled]

    def which(ways: list[Hit]) -> Column:
        out = F.when(ways[0].fired, 0)
        for k, w in enumerate(ways[1:], 1):
            out = out.when(w.fired, k)
        return out

    def any_of(way: Column, ways: list[Hit], wanted) -> Column:
        some = [k for k, w in enumerate(ways) if wanted(w)]
        return F.coalesce(way.isin(*some), F.lit(False)) if some else F.lit(False)

    out = df.withColumns({f"_way{i}": which(ways) for i, ways in enumerate(rules)})
    way = [F.col(f"_way{i}") for i in range(len(rules))]
    stop = F.coalesce(*(F.when(any_of(way[i], ways, lambda w: w.stops), i) for i, ways in enumerate(rules)), F.lit(len(rules)))
    high = sum((any_of(way[i], ways, lambda w: w.high).cast("int") for i, ways in enumerate(rules)), F.lit(0))
    out = out.withColumns({"_stop": stop, "_high": high})
    stopped = F.col("_stop") < len(rules)
    shown = [way[i].isNotNull() & (F.col("_stop") >= i) for i in range(len(rules))]
    chosen = lambda i, field: F.coalesce(*(F.when(way[i] == k, field(w)) for k, w in enumerate(rules[i])))
    last = lambda field: F.coalesce(*(F.when(F.col("_stop") == i, chosen(i, field)) for i, ways in enumerate(rules) if any(w.stops for w in ways)))
    many = F.concat(F.lit("Multiple high-severity violations ("), F.col("_high").cast("string"), F.lit(")"))
    out = out.withColumns(
        {
            "triggered": F.array_compact(F.array(*(F.when(shown[i], chosen(i, lambda w: w.struct)) for i in range(len(rules))))),
            "triggered_names": F.concat_ws(",", *(F.when(shown[i], names[i]) for i in range(len(rules)))),
            "rules_decision": F.when(stopped, last(lambda w: F.lit(w.decision))).when(F.col("_high") >= 2, "DECLINE").otherwise("PASS_TO_ML"),
            "primary_reason": F.when(stopped, last(lambda w: w.reason)).when(F.col("_high") >= 2, many),
        }
    )
    return out.withColumn("continue_to_ml", F.col("rules_decision") == "PASS_TO_ML").drop("_stop", "_high", *(f"_way{i}" for i in range(len(rules))), *(f"_in_{name}" for name in on_list or ()))


def rule_names() -> Column:
    """The names of the hits, joined."""
    return F.col("triggered_names")


def engine_stats(decided: DataFrame) -> DataFrame:
    """Counts and rates over all rows."""
    n = F.count("*")
    share = lambda d: F.coalesce(F.try_divide(F.sum((F.col("rules_decision") == d).cast("long")), n), F.lit(0.0))
    return decided.agg(n.alias("total"), share("DECLINE").alias("decline_rate"), share("APPROVE").alias("approve_rate"), share("PASS_TO_ML").alias("pass_rate"))


def rule_hits(decided: DataFrame) -> DataFrame:
    return decided.select(F.explode("triggered").alias("h")).groupBy(F.col("h.rule_name").alias("rule_name")).agg(F.count("*").alias("hits"))
