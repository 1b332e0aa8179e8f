"""Limits and lists of the decision layers. Every operator takes them as an argument."""

from __future__ import annotations

from dataclasses import dataclass, field

# The rule names in their order.
RULE_ORDER = (
    "check_stolen_card",
    "check_sanctioned_country",
    "check_fraud_device",
    "check_tor",
    "check_email_domain",
    "check_amount_exceeds_limit",
    "check_velocity_limits",
    "check_card_testing_pattern",
    "check_vip_user",
    "check_micro_transaction",
    "check_impossible_travel",
    "check_new_account_risk",
    "check_behavioral_anomalies",
)


@dataclass(frozen=True)
class RuleConfig:
    """Default lists and limits."""

    stolen_cards: tuple[str, ...] = ("4532123456789012", "5425233430109903")
    sanctioned_countries: tuple[str, ...] = ("KP", "IR", "SY", "CU")
    fraud_devices: tuple[str, ...] = ("device_fraud_001", "device_fraud_002")
    fraud_domains: tuple[str, ...] = ("tempmail.com", "10minutemail.com", "guerrillamail.com", "throwaway.email", "fakeinbox.com")
    vip_users: tuple[str, ...] = ("user_vip_001", "user_vip_002")
    #: The hourly count is held against per_hour_limit; the reason text prints per_hour_shown.
    per_hour_limit: int = 5
    per_hour_shown: int = 20
    failed_limit: int = 3
    round_amounts: tuple[float, ...] = (100.0, 200.0, 500.0, 1000.0, 5000.0)
    round_per_minute: int = 3
    micro_amount: float = 5.0
    vip_amount: float = 500.0
    card_limit: float = 10000.0
    travel_kmh: float = 800.0
    new_account_hours: float = 24.0
    new_account_amount: float = 500.0
    first_amount: float = 1000.0
    night_hours: tuple[int, int] = (2, 6)
    night_amount: float = 1000.0
    disabled: tuple[str, ...] = ()


@dataclass(frozen=True)
class RouteConfig:
    high: float = 0.85
    low: float = 0.20
    grey_split: float = 0.5
    bands: tuple[float, float, float] = (0.8, 0.5, 0.2)


@dataclass(frozen=True)
class GraphConfig:
    damping: float = 0.85
    rounds: int = 20
    hub_score: float = 1.0
    max_hops: int = 5
    path_hops: int = 6
    risky: float = 0.7
    similar: float = 0.5
    min_group: int = 3
    fraud_rate: float = 0.3
    mean_risk: float = 0.5


@dataclass(frozen=True)
class QualityConfig:
    full_size: int = 1_000_000
    fraud_rate: tuple[float, float] = (0.01, 0.15)
    scenarios: int = 5
    correlations: tuple[tuple[str, float], ...] = field(default=(("is_vpn", 0.05), ("is_high_risk_country", 0.05), ("impossible_travel_flag", 0.1)))
