"""The review ledger: immutable cases and case events; a case's state is derived from them.

events: case_id, event (ENQUEUED, ASSIGNED, REQUEUED, RESOLVED, TIMED_OUT), analyst, us."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks
from .velocity import HOT_ROWS, hot_users

MINUTE = 60_000_000


def priority(score: Column, amount: Column) -> Column:
    return F.when((score >= 0.9) | (amount >= 10000), "CRITICAL").when((score >= 0.75) | (amount >= 5000), "HIGH").when((score >= 0.5) | (amount >= 1000), "MEDIUM").otherwise("LOW")


def priority_rank(p: Column) -> Column:
    return F.when(p == "CRITICAL", 0).when(p == "HIGH", 1).when(p == "MEDIUM", 2).otherwise(3)


def open_cases(decisions: DataFrame) -> DataFrame:
    """Cases of escalated decisions. decisions: transaction_id, user_id, amount, score, us,
    recommended_action, reasoning (array). The id is a hash, so a rerun opens the same cases."""
    reason = F.coalesce(F.try_element_at("reasoning", F.lit(-1)), F.lit("Low confidence, human review required"))
    return decisions.where("recommended_action = 'ESCALATE_TO_HITL'").select(
        F.concat(F.lit("HITL-"), F.substring(F.md5(F.col("transaction_id").cast("string")), 1, 12)).alias("case_id"),
        "transaction_id", "user_id", "amount", "score", priority(F.col("score"), F.col("amount")).alias("priority"), reason.alias("escalation_reason"), F.col("us").alias("created_us"),
    )


def duplicate_cases(cases: DataFrame) -> DataFrame:
    return cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1")


def review_order(cases: DataFrame) -> DataFrame:
    """cases with position in the queue: by priority, then age, then id. Ranks are counted in
    ranges of the age within each priority."""
    made = cases.withColumn("_r", priority_rank(F.col("priority")))
    placed = ranks.ranked(made, ["_r"], F.col("created_us"), [F.col("created_us"), F.col("case_id")], "_n")
    sizes = made.groupBy("_r").agg(F.count("*").alias("_k"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_k").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_r", "_before")
    return placed.join(F.broadcast(before), "_r").withColumn("position", F.col("_n") + F.col("_before")).drop("_r", "_n", "_n_all", "_before")  # four rows


def assign_next(cases: DataFrame, analysts: list[str]) -> DataFrame:
    """The first cases of the queue, one for each analyst in the order given."""
    slots = cases.sparkSession.createDataFrame([(k + 1, a) for k, a in enumerate(analysts)], "position long, assigned_to string")
    first = cases.orderBy(priority_rank(F.col("priority")), "created_us", "case_id").limit(len(analysts))
    placed = first.withColumn("position", F.row_number().over(Window.orderBy(priority_rank(F.col("priority")), "created_us", "case_id")).cast("long"))
    return placed.join(F.broadcast(slots), "position").drop("position")


def assigned(events: DataFrame, case_id: str, analyst: str, us: int) -> DataFrame:
    """events and the assignment of a named case; it counts only if the case is pending then."""
    row = events.sparkSession.createDataFrame([(case_id, "ASSIGNED", analyst, us)], "case_id string, event string, analyst string, us bigint")
    return events.unionByName(row, allowMissingColumns=True)


def audit_log(events: DataFrame, case_id: str | None = None) -> DataFrame:
    """The events, of one case or of all, with their place in the case."""
    own = events if case_id is None else events.where(F.col("case_id") == case_id)
    return own.withColumn("n", F.row_number().over(Window.partitionBy("case_id").orderBy("us", event_rank(F.col("event")), "event", "analyst")))


def event_rank(event: Column) -> Column:
    return F.when(event == "ENQUEUED", 0).when(event == "ASSIGNED", 1).when(event == "REQUEUED", 2).when(event == "RESOLVED", 3).otherwise(4)


#: The states of a case; a case opens in the first.
STATES = ("PENDING", "IN_REVIEW", "RESOLVED", "TIMED_OUT")


def _step(state: Column, e: Column) -> Column:
    s, kind = state["status"], e["event"]
    ok = F.coalesce(
        ((kind == "ASSIGNED") & (s == "PENDING"))
        | ((kind == "REQUEUED") & (s == "IN_REVIEW"))
        | (kind == "RESOLVED")
        | ((kind == "TIMED_OUT") & ~s.isin("RESOLVED", "TIMED_OUT")),
        F.lit(False),
    )
    held = F.when(kind == "ASSIGNED", F.struct(e["analyst"].alias("analyst"), e["us"].alias("assigned_us"))).when(kind == "REQUEUED", F.struct(F.lit(None).cast("string").alias("analyst"), F.lit(None).cast("bigint").alias("assigned_us")))
    return F.struct(
        F.when(ok, F.when(kind == "REQUEUED", "PENDING").when(kind == "ASSIGNED", "IN_REVIEW").otherwise(kind)).otherwise(s).alias("status"),
        F.when(ok & held.isNotNull(), held).otherwise(state["held"]).alias("held"),
        F.when(ok & (kind == "RESOLVED"), F.struct(e["us"].alias("us"))).otherwise(state["resolved"]).alias("resolved"),
        (state["applied"] + ok.cast("int")).alias("applied"),
    )


def _start(status: str) -> Column:
    """A state before any event: held and resolved are NULL until an event sets what they hold."""
    held, resolved = F.lit(None).cast("struct<analyst:string,assigned_us:bigint>"), F.lit(None).cast("struct<us:bigint>")
    return F.struct(F.lit(status).alias("status"), held.alias("held"), resolved.alias("resolved"), F.lit(0).alias("applied"))


def _then(state: Column, change: Column) -> Column:
    """What a state becomes by a change: a struct with the outcome from each of STATES."""
    pick = lambda f: reduce(lambda w, s: w.when(state["status"] == s, change[s][f]), STATES[1:], F.when(state["status"] == STATES[0], change[STATES[0]][f]))
    return F.struct(
        pick("status").alias("status"),
        F.coalesce(pick("held"), state["held"]).alias("held"),
        F.coalesce(pick("resolved"), state["resolved"]).alias("resolved"),
        (state["applied"] + pick("applied")).alias("applied"),
    )


def _changes(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change: what the events of each key, in order, make of a case in each state."""
    ordered = events.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("us", event_rank(F.col("event")).alias("rank"), "event", "analyst"))).alias("e"))
    each = F.struct(*(F.aggregate("e", _start(s), _step).alias(s) for s in STATES))
    return ordered.select(*keys, each.alias("change"))


def _hot_states(events: DataFrame, fan: int) -> DataFrame:
    """The states of cases of many events: their events meet in ranges of time, each range is
    made into its change, and changes are joined fan at a time, so no case is one row."""
    cut = ranks.ranged(events, ["case_id"], F.col("us").cast("double")).withColumnRenamed("_range", "_at")
    many = _changes(cut, ["case_id", "_at"])
    width = ranks.PARTS
    while width > fan:
        width = -(-width // fan)
        parts = many.groupBy("case_id", F.floor(F.col("_at") / fan).alias("_at")).agg(F.sort_array(F.collect_list(F.struct("_at", "change"))).alias("c"))
        joined = F.struct(*(F.aggregate("c", _start(s), lambda x, c: _then(x, c["change"])).alias(s) for s in STATES))
        many = parts.select("case_id", "_at", joined.alias("change"))
    whole = many.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("_at", "change"))).alias("c"))
    return whole.select("case_id", F.aggregate("c", _start(STATES[0]), lambda x, c: _then(x, c["change"])).alias("s"))


def case_state(events: DataFrame, hot_rows: int = HOT_ROWS, fan: int = 16) -> DataFrame:
    """case_id, status, analyst, assigned_us, resolved_us, applied (events that counted). The
    events of a case are replayed in order; those not allowed in its state are ignored. A
    case opens with its first event if it has no ENQUEUED. Cases above the bounds of hot users
    are replayed in ranges of time, whose outcomes from each state are joined."""
    hot = hot_users(events, "case_id", hot_rows)
    few = events if hot is None else events.join(F.broadcast(hot), "case_id", "left_anti")  # at most 1 / HOT_SHARE cases
    ordered = few.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("us", event_rank(F.col("event")).alias("rank"), "event", "analyst"))).alias("e"))
    states = ordered.select("case_id", F.aggregate("e", _start(STATES[0]), _step).alias("s"))
    if hot is not None:
        states = states.unionByName(_hot_states(events.join(F.broadcast(hot), "case_id", "left_semi"), fan))
    return states.select("case_id", "s.status", "s.held.analyst", "s.held.assigned_us", F.col("s.resolved.us").alias("resolved_us"), "s.applied")


def list_cases(cases: DataFrame, limit: int = 100, **equal: str) -> DataFrame:
    kept = reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), equal.items(), cases)
    return kept.orderBy(priority_rank(F.col("priority")), "created_us", "case_id").limit(limit)


def sla_breached(created: Column, sla_minutes: Column, status: Column, as_of: Column) -> Column:
    return (status != "RESOLVED") & (as_of - created > sla_minutes.cast("long") * MINUTE)


def queue_stats(states: DataFrame, as_of: int) -> DataFrame:
    """states: status, created_us, sla_minutes, assigned_us, resolved_us. One row."""
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    done = (F.col("status") == "RESOLVED") & F.col("assigned_us").isNotNull() & F.col("resolved_us").isNotNull()
    seconds = F.avg(F.when(done, (F.col("resolved_us") - F.col("assigned_us")) / 1e6))
    oldest = (F.lit(as_of) - F.min(F.when(F.col("status") == "PENDING", F.col("created_us")))) / MINUTE
    breached = sla_breached(F.col("created_us"), F.col("sla_minutes"), F.col("status"), F.lit(as_of))
    return states.agg(
        F.count("*").alias("total"), n("PENDING").alias("pending"), n("IN_REVIEW").alias("in_review"), n("RESOLVED").alias("resolved"), n("TIMED_OUT").alias("timed_out"),
        F.sum(breached.cast("long")).alias("breaches"), F.round(F.coalesce(seconds, F.lit(0.0)), 2).alias("mean_review_seconds"), F.round(oldest, 2).alias("oldest_pending_minutes"),
    )


def validate_decisions(decisions: DataFrame, states: DataFrame) -> DataFrame:
    """decisions (case_id, analyst, decision) with error: the first that applies, else NULL."""
    known = states.select("case_id", "status", F.col("analyst").alias("_owner"), F.lit(True).alias("_known"))
    joined = decisions.join(known, "case_id", "left")
    error = (
        F.when(F.col("_known").isNull(), "unknown case")
        .when(F.col("status") == "RESOLVED", "already resolved")
        .when(F.col("status") == "TIMED_OUT", "timed out")
        .when(F.col("_owner").isNotNull() & (F.col("_owner") != F.col("analyst")), "wrong analyst")
        .when(F.coalesce(F.trim("decision"), F.lit("")) == "", "empty decision")
    )
    return joined.withColumn("error", error).drop("_owner", "_known", "status")


def normalised_decision(d: Column) -> Column:
    return F.when(d == "DECLINE", "CONFIRM_FRAUD").when(d == "APPROVE", "CLEAR").when(d == "ESCALATE", "ESCALATE_FURTHER").otherwise(d)


def decision_actions(decision: Column, block: Column, ring: Column, retrain: Column) -> Column:
    """Actions taken, in order."""
    yes = lambda c, a: F.when(F.coalesce(c, F.lit(False)), a)
    return F.array_compact(F.array(F.concat(F.lit("decision:"), decision), yes(block, "account_blocked"), yes(ring, "ring_flagged"), yes(retrain, "label_stored")))


def risk_changes(decisions: DataFrame) -> DataFrame:
    """account_id, new_risk: the case score where fraud was confirmed, else 0.1."""
    return decisions.select("account_id", F.when(F.col("decision") == "CONFIRM_FRAUD", F.col("score")).otherwise(0.1).alias("new_risk"))


def retrain_labels(decisions: DataFrame, drop_undecided: bool = False) -> DataFrame:
    kept = decisions.where("decision <> 'ESCALATE_FURTHER'") if drop_undecided else decisions
    return kept.select("transaction_id", "case_id", (F.col("decision") == "CONFIRM_FRAUD").cast("int").alias("label"), F.lit("review").alias("label_source"), "decided_us")


def retrain_set(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Features of labelled transactions with the newest label of each."""
    newest = labels.groupBy("transaction_id").agg(F.max_by("label", F.struct("decided_us", "case_id")).alias("label"))
    return features.join(newest, "transaction_id")
