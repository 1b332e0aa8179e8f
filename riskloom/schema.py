"""The feature catalogue: names, kinds, groups and defaults, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name, kind and default of the features of each group.
CATALOGUE = {
    "velocity": (
        ("avg_transaction_amount", "float", 0.0),
        ("transaction_count", "int", 0),
        ("transactions_last_hour", "int", 0),
        ("transactions_last_day", "int", 0),
        ("transactions_last_week", "int", 0),
        ("amount_last_hour", "float", 0.0),
        ("amount_last_day", "float", 0.0),
        ("amount_last_week", "float", 0.0),
        ("avg_amount_last_7_days", "float", 0.0),
        ("max_amount_last_30_days", "float", 0.0),
        ("std_amount_last_30_days", "float", 0.0),
        ("declined_transaction_count", "int", 0),
        ("chargeback_count", "int", 0),
        ("refund_count", "int", 0),
        ("transaction_diversity_score", "float", 0.0),
        ("avg_days_between_transactions", "float", 30.0),
        ("weekend_transaction_ratio", "float", 0.0),
        ("night_transaction_ratio", "float", 0.0),
        ("cross_border_transaction_ratio", "float", 0.0),
        ("large_transaction_count", "int", 0),
        ("transaction_amount_z_score", "float", 0.0),
    ),
    "device": (
        ("device_count", "int", 1),
        ("browser_type", "str", "unknown"),
        ("os_type", "str", "unknown"),
        ("is_mobile", "int", 0),
        ("is_vpn", "int", 0),
        ("is_proxy", "int", 0),
        ("is_tor", "int", 0),
        ("ip_reputation_score", "float", 0.5),
        ("device_age_days", "int", 0),
        ("screen_resolution_width", "int", 1920),
        ("screen_resolution_height", "int", 1080),
        ("browser_language", "str", "en"),
        ("plugins_count", "int", 0),
        ("cookies_enabled", "int", 1),
        ("javascript_enabled", "int", 1),
        ("session_duration_seconds", "int", 0),
        ("device_fingerprint_changes", "int", 0),
        ("ip_changes_last_week", "int", 0),
        ("unique_ips_last_month", "int", 1),
        ("device_os_mismatch", "int", 0),
        ("browser_version_outdated", "int", 0),
        ("timezone_mismatch", "int", 0),
        ("user_agent_anomaly_score", "float", 0.0),
        ("device_reputation_score", "float", 0.5),
        ("incognito_mode_usage_ratio", "float", 0.0),
        ("screen_orientation_changes", "int", 0),
        ("touch_capability", "int", 0),
        ("webrtc_enabled", "int", 0),
        ("canvas_fingerprint_changes", "int", 0),
    ),
    "behavioral": (
        ("time_on_site_seconds", "int", 0),
        ("pages_viewed", "int", 0),
        ("products_viewed", "float", 0.0),
        ("cart_additions", "int", 0),
        ("cart_removals", "int", 0),
        ("form_fill_time_seconds", "int", 0),
        ("paste_events_count", "int", 0),
        ("autocomplete_usage_count", "int", 0),
        ("typing_speed_wpm", "float", 0.0),
        ("mouse_movement_speed", "float", 0.0),
        ("click_hesitation_avg_ms", "float", 0.0),
        ("scroll_events_count", "int", 0),
        ("scroll_depth_avg", "float", 0.0),
        ("back_button_clicks", "int", 0),
        ("failed_login_attempts", "int", 0),
        ("password_reset_count", "int", 0),
        ("session_replay_anomaly_score", "float", 0.0),
        ("bot_detection_score", "float", 0.0),
        ("keyboard_rhythm_consistency", "float", 0.5),
        ("mouse_trajectory_smoothness", "float", 0.5),
        ("form_field_order_anomaly", "int", 0),
        ("copy_events_count", "int", 0),
        ("right_click_count", "int", 0),
        ("tab_switches", "int", 0),
        ("idle_time_seconds", "int", 0),
    ),
    "network": (
        ("shared_device_count", "int", 0),
        ("shared_ip_count", "int", 0),
        ("shared_billing_address_count", "int", 0),
        ("shared_shipping_address_count", "int", 0),
        ("email_domain", "str", "unknown"),
        ("email_age_days", "int", 0),
        ("email_domain_reputation", "float", 0.5),
        ("phone_verified", "int", 0),
        ("phone_carrier_type", "str", "unknown"),
        ("social_media_linked", "int", 0),
        ("referral_source", "str", "direct"),
        ("marketing_channel", "str", "unknown"),
        ("connected_accounts_count", "int", 0),
        ("network_centrality_score", "float", 0.0),
        ("shared_payment_method_count", "int", 0),
        ("email_pattern_similarity_score", "float", 0.0),
        ("phone_shared_count", "int", 0),
        ("address_history_count", "int", 0),
        ("account_linking_anomaly_score", "float", 0.0),
        ("graph_community_fraud_rate", "float", 0.0),
    ),
    "geo": (
        ("location_lat", "float", 0.0),
        ("location_lon", "float", 0.0),
        ("ip_country", "str", "unknown"),
        ("billing_country", "str", "unknown"),
        ("shipping_country", "str", "unknown"),
        ("is_high_risk_country", "int", 0),
        ("country_risk_score", "float", 0.0),
        ("distance_from_last_transaction_km", "float", 0.0),
        ("billing_shipping_distance_km", "float", 0.0),
        ("impossible_travel_flag", "int", 0),
        ("location_consistency_score", "float", 1.0),
        ("timezone", "str", "UTC"),
        ("ip_billing_country_match", "int", 1),
        ("is_international", "int", 0),
        ("address_verification_status", "str", "unknown"),
        ("zip_code_match", "int", 1),
        ("urban_vs_rural", "str", "unknown"),
        ("location_change_frequency", "float", 0.0),
        ("avg_distance_per_transaction", "float", 0.0),
        ("max_distance_last_month_km", "float", 0.0),
    ),
    "identity": (
        ("account_age_days", "int", 0),
        ("email_verified", "int", 0),
        ("identity_verified", "int", 0),
        ("customer_lifetime_value", "float", 0.0),
        ("loyalty_program_member", "int", 0),
        ("return_rate", "float", 0.0),
        ("customer_service_contacts", "int", 0),
        ("complaints_count", "int", 0),
        ("previous_fraud_flags", "int", 0),
        ("successful_order_rate", "float", 1.0),
        ("profile_completeness_score", "float", 0.0),
        ("account_updates_count", "int", 0),
        ("suspicious_activity_count", "int", 0),
        ("positive_feedback_count", "int", 0),
        ("negative_feedback_count", "int", 0),
    ),
    "payment": (
        ("card_type", "str", "unknown"),
        ("card_brand", "str", "unknown"),
        ("is_prepaid_card", "int", 0),
        ("card_country", "str", "unknown"),
        ("card_billing_country_match", "int", 1),
        ("cvv_match", "int", 1),
        ("avs_match", "int", 1),
        ("3d_secure_status", "str", "unknown"),
        ("is_saved_card", "int", 0),
        ("card_age_days", "int", 0),
        ("failed_payment_count", "int", 0),
        ("card_shared_accounts_count", "int", 0),
        ("card_velocity_24h", "int", 0),
        ("card_bin_risk_score", "float", 0.0),
        ("card_issuer_country", "str", "unknown"),
        ("payment_method_changes", "int", 0),
        ("digital_wallet_used", "int", 0),
        ("tokenized_payment", "int", 0),
        ("card_expiry_months_remaining", "int", 12),
        ("card_issuer_reputation", "float", 0.5),
    ),
    "merchant": (
        ("merchant_category", "str", "unknown"),
        ("is_high_risk_merchant_category", "int", 0),
        ("merchant_risk_score", "float", 0.0),
        ("is_digital_goods", "int", 0),
        ("is_international_merchant", "int", 0),
        ("merchant_account_age_days", "int", 0),
        ("merchant_chargeback_rate", "float", 0.0),
        ("merchant_fraud_rate", "float", 0.0),
        ("product_price_vs_market_ratio", "float", 1.0),
        ("bulk_purchase_flag", "int", 0),
        ("rush_delivery_flag", "int", 0),
        ("gift_card_purchase", "int", 0),
        ("merchant_fraud_history", "int", 0),
        ("merchant_reputation_score", "float", 0.5),
    ),
    "temporal": (
        ("hour_of_day", "int", 12),
        ("day_of_week", "int", 1),
        ("is_weekend", "int", 0),
        ("is_business_hours", "int", 1),
        ("is_night_time", "int", 0),
        ("days_since_last_transaction", "float", 30.0),
        ("hours_since_last_login", "float", 24.0),
        ("is_holiday", "int", 0),
        ("time_to_checkout_seconds", "int", 0),
        ("session_to_purchase_ratio", "float", 0.0),
    ),
}
#: Columns that no model sees.
LABELS = ("fraud_score", "is_fraud", "fraud_scenario")
META = ("user_id", "timestamp", "amount", "location", "device_id")

KINDS = {"int": "bigint", "float": "double", "str": "string"}


def features() -> list[tuple[str, str, str, object]]:
    """(name, type, group, default) in order."""
    return [(name, KINDS[kind], group, default) for group, each in CATALOGUE.items() for name, kind, default in each]


def defaults() -> dict[str, object]:
    return {name: value for name, _, _, value in features()}


def feature_schema() -> T.StructType:
    kinds = {"bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind, _, _ in features()])


def catalogue(spark: SparkSession) -> DataFrame:
    """One row for each feature; a small table of fixed size."""
    return spark.createDataFrame([(n, k, g, str(v)) for n, k, g, v in features()], "name string, dtype string, grp string, default_value string")


def filled_by_group(df: DataFrame) -> DataFrame:
    """grp, features (columns of df in the catalogue), filled (their cells that are not NULL)."""
    known = [(n, g) for n, _, g, _ in features() if n in df.columns]
    counts = df.agg(*(F.count(F.col(f"`{n}`")).alias(n) for n, _ in known))
    each: list[Column] = [F.struct(F.lit(g).alias("grp"), F.col(f"`{n}`").alias("n")) for n, g in known]
    return counts.select(F.inline(F.array(*each))).groupBy("grp").agg(F.count("*").alias("features"), F.sum("n").alias("filled"))
