"""The stateful behaviour of the engine on Structured Streaming. Every job reads a stream of
transactions (transaction_id, user_id, ts timestamp, amount, ...)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import domain_last
from ..operators import graph, lists, routing, rules
from ..sources import versioned
from ..sources.io import shared_folder

HOUR, DAY = 3_600_000_000, 86_400_000_000
TRAIL = "transaction_id bigint, user_id string, at bigint, count_1h bigint, count_24h bigint, amount_1h double, amount_24h double"
SPANS = (("1h", HOUR), ("24h", DAY))
#: Amounts are summed as integers of this many places, so sums are exact and have no order.
PLACES = 10_000


def _trailing(at: np.ndarray, cents: np.ndarray, times: np.ndarray, span: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each of times t: the different times and the sum of the pairs in (t - span, t]. at is sorted.
    Pairs of time and amount may take the place of at and cents."""
    if span is None:
        (at, amount), times, span = np.array(at, float).T, np.asarray(cents), times
        cents = np.round(amount * PLACES).astype(np.int64)
    new = np.concatenate([[True], at[1:] != at[:-1]])
    n, total = (np.concatenate([[0], np.cumsum(x)]) for x in (new, cents))
    low, high = np.searchsorted(at, times - span, "right"), np.searchsorted(at, times, "right")
    return n[high] - n[low], np.array([round(x, 2) for x in ((total[high] - total[low]) / PLACES).tolist()])


def _distinct(at: np.ndarray, cents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different (time, amount) pairs, in order."""
    order = np.lexsort((cents, at))
    at, cents = at[order], cents[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (cents[1:] != cents[:-1])
    return at[new], cents[new]


def _pairs(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return rows["at"].to_numpy(np.int64), np.round(rows["amount"].to_numpy(float) * PLACES).astype(np.int64)


class TrailingWindows(StatefulProcessor):
    """A user's last 24 hours and the time that rows may be late. The state is a map from an hour
    to the (time, amount) pairs in it: a micro-batch reads the hours that are there in one go and
    writes those of its rows that later rows can see; hours that have passed are removed. So a user
    costs a few calls to the store, however many hours a micro-batch spans. One timer stands for a
    user: it moves on while there are rows, then clears the state. Rows come in frames of bounded
    size, of which ids, times and amounts are held as numbers until the pairs of all are in.

    A row sees what lies in (t - span, t], whichever frame brings it. Equal times count once,
    equal (amount to 4 places, time) are summed once, as in the batch form. The state can start
    from a table of the pairs of the last day."""

    def __init__(self, late: int = HOUR, most: int = 100_000):
        self.late, self.most = late, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour bigint", "at array<bigint>, cents array<bigint>")
        self.newest = handle.getValueState("newest", "at bigint")

    def _add(self, at: np.ndarray, cents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs that are known once these are in. Keeps what rows from now on can see, and sees
        that a timer stands."""
        found = self.newest.get()
        before = found[0] if found else None
        held = {k[0]: (np.array(v[0], np.int64), np.array(v[1], np.int64)) for k, v in self.hours.iterator()} if found else {}
        newest = max(int(at.max()), before if found else int(at.max()))
        own = np.unique(at // HOUR)
        at, cents = _distinct(*(np.concatenate([x, *(v[k] for v in held.values())]) for k, x in enumerate((at, cents))))
        passed = lambda h: (h + 1) * HOUR <= newest - DAY - self.late
        for h in own.tolist():
            low, high = np.searchsorted(at, [h * HOUR, (h + 1) * HOUR])
            if not passed(h) and high - low > (len(held[h][0]) if h in held else 0):
                self.hours.updateValue((h,), (at[low:high].tolist(), cents[low:high].tolist()))
        for h in held:
            if passed(h):
                self.hours.removeKey((h,))
        if newest != before:
            self.newest.update((newest,))
        if before is None:
            self.handle.registerTimer((newest + DAY) // 1000 + 1)
        return at, cents

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        known = initialState.dropna(subset=["at", "amount"])
        if len(known):
            self._add(*_pairs(known))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ids, pairs = [], []
        for frame in rows:
            ids.append(frame["transaction_id"].to_numpy())
            pairs.append(_pairs(frame))
        ids, (times, cents) = np.concatenate(ids), (np.concatenate(x) for x in zip(*pairs, strict=True))
        at, cents = self._add(times, cents)
        order = np.lexsort((ids, times))
        for k in range(0, len(order), self.most):
            some = order[k : k + self.most]
            own = times[some]
            out = pd.DataFrame({"transaction_id": ids[some], "user_id": key[0], "at": own})
            for name, span in SPANS:
                out[f"count_{name}"], out[f"amount_{name}"] = _trailing(at, cents, own, span)
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()
        due = newest is not None and (newest[0] + DAY) // 1000 + 1
        if due and due > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(due)
        else:
            self.hours.clear()
            self.newest.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def trailing_stream(txn: DataFrame, late: str = "1 hour", warm: DataFrame | None = None) -> DataFrame:
    """transaction_id, user_id, at and what lies in the trailing hour and day of each row.
    warm: user_id, at (microseconds), amount of the last day before the stream (warm_events)."""
    rows = txn.withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    start = warm.select("user_id", "at", "amount").groupBy("user_id") if warm is not None else None
    return rows.groupBy("user_id").transformWithStateInPandas(TrailingWindows(pd.Timedelta(late) // pd.Timedelta(microseconds=1)), TRAIL, "append", "EventTime", start)


def warm_events(df: DataFrame, as_of: int, span: int = DAY, user: str = "user_id", at: str = "us") -> DataFrame:
    """The events that a stream which begins after as_of looks back on: those of the table of
    warm windows, one row an event."""
    return df.where((F.col(at) > as_of - span) & (F.col(at) <= as_of)).select(F.col(user).alias("user_id"), F.col(at).alias("at"), "amount")


#: Users are dealt to so many groups, and the windows of a group are summed for about so many of its hours at a time.
GROUPS, SOME_HOURS = 2_048, 20_000


def _by_hour(user: np.ndarray, hours: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sums of the values by user and hour (or other time), in their order."""
    order = np.lexsort((hours, user))
    user, hours = user[order], hours[order]
    new = np.ones(len(user), bool)
    new[1:] = (user[1:] != user[:-1]) | (hours[1:] != hours[:-1])
    place = np.cumsum(new) - 1
    return user[new], hours[new], [np.bincount(place, v[order], int(new.sum())) for v in values]


class HoppingTotals(StatefulProcessor):
    """The day-long windows of a group of users. The state holds, for each user, the hours in which
    there are rows, with their number, that of filled amounts and their sum, and not a row for
    each of 24 windows; a micro-batch writes the users that it has rows of. One timer stands for a
    group, at the end of the first window that is open: those that are over are then summed and
    given out. Rows are complete up to a day past the watermark (see hopping_totals), so a window is over
    when that reaches its start. closed: windows that start by then are over; seen: the watermark at the last visit."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.users = handle.getMapState("users", self.key, "hours array<bigint>, n array<double>, filled array<double>, amounts array<double>")
        self.marks = handle.getValueState("marks", "closed bigint, seen bigint, due bigint")

    def __init__(self, kind: str = "string"):
        self.key = f"user {kind}"

    def _wait(self, hours: np.ndarray, closed: int, now: int, before: int | None) -> None:
        """Keeps the marks and sees that a timer stands for the first open window."""
        hours = hours[hours > closed]
        first = max(int(hours.min()) - DAY + HOUR, (closed // HOUR + 1) * HOUR) if len(hours) else None
        due = min((x for x in (first, before) if x is not None), default=None)
        if due is not None and due != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000 - 1)
            self.handle.registerTimer(due // 1000 - 1)
        self.marks.update((closed, now, due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, found = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000, self.marks.get()
        closed, due = (found[1], found[2]) if found else (now, None)
        names, user, hours, values = {}, np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0)] * 3
        for frame in rows:
            code, own = pd.factorize(frame["user_id"], use_na_sentinel=False)
            codes = np.array([names.setdefault(None if pd.isna(u) else u, len(names)) for u in own.tolist()], np.int64)
            filled = frame["filled"].to_numpy(bool)
            new = [np.ones(len(frame)), filled.astype(float), np.where(filled, frame["amount"].to_numpy(float), 0.0)]
            at = frame["at"].to_numpy(np.int64) // HOUR * HOUR
            user, hours, values = _by_hour(np.concatenate([user, codes[code]]), np.concatenate([hours, at]), [np.concatenate(v) for v in zip(values, new, strict=True)])
        if not found:
            held = {}
        elif len(names) > 16:
            held = {k[0]: v for k, v in self.users.iterator()}
        else:
            held = {u: self.users.getValue((u,)) for u in names if self.users.containsKey((u,))}
        known = [(code, held[u]) for u, code in names.items() if u in held]
        if known:
            before = [np.repeat([code for code, _ in known], [len(v[0]) for _, v in known]), *(np.concatenate([np.array(v[k]) for _, v in known]) for k in range(4))]
            user, hours, values = _by_hour(np.concatenate([user, before[0]]), np.concatenate([hours, before[1]]).astype(np.int64), [np.concatenate(v) for v in zip(values, before[2:], strict=True)])
        still = hours > closed
        user, hours, values = user[still], hours[still], [v[still] for v in values]
        ends = np.searchsorted(user, np.arange(len(names) + 1)).tolist()
        for u, code in names.items():
            low, high = ends[code], ends[code + 1]
            if low < high:
                self.users.updateValue((u,), tuple(x[low:high].tolist() for x in (hours, *values)))
        self._wait(hours, closed, now, due)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, (closed, _, _) = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000, self.marks.get()
        names, held = [], []
        for k, v in self.users.iterator():
            names.append(k[0])
            held.append([np.array(v[0], np.int64), *(np.array(x, float) for x in v[1:])])
        sizes = np.array([len(v[0]) for v in held], np.int64)
        some = (np.cumsum(sizes) // SOME_HOURS).tolist()
        low = 0
        for high in range(1, len(held) + 1):
            if high == len(held) or some[high] != some[low]:
                yield from self._over(names[low:high], held[low:high], sizes[low:high], closed, now)
                low = high
        for u, v in zip(names, held, strict=True):
            still = v[0] > now
            if not still.any():
                self.users.removeKey((u,))
            elif 2 * still.sum() < len(still):
                self.users.updateValue((u,), tuple(x[still].tolist() for x in v))
        self._wait(np.concatenate([np.zeros(0, np.int64), *(v[0] for v in held)]), now, now, None)

    def _over(self, names: list, held: list[list[np.ndarray]], sizes: np.ndarray, closed: int, now: int) -> Iterator[pd.DataFrame]:
        hours, *values = (np.concatenate(x) for x in zip(*held, strict=True))
        user = np.repeat(np.arange(len(names)), sizes)
        starts = (hours[:, None] - np.arange(0, DAY, HOUR)).ravel()
        inside = np.flatnonzero((starts > closed) & (starts <= now))
        if len(inside):
            at = inside // (DAY // HOUR)
            user, starts, (n, filled, amount) = _by_hour(user[at], starts[inside], [v[at] for v in values])
            yield pd.DataFrame({"user_id": np.array(names, object)[user], "start": starts, "n": n.astype(np.int64), "filled": filled > 0, "amount": amount})

    def close(self) -> None:
        pass


def hopping_totals(txn: DataFrame, late: str = "1 hour") -> DataFrame:
    """Totals of each user's 24-hour windows that start every hour; rows later than late are left
    out of windows that are over. The watermark is a day behind, so that rows come in while one of
    their windows is open."""
    dealt = F.pmod(F.xxhash64("user_id"), F.lit(GROUPS)).cast("int").alias("dealt")
    rows = txn.where("ts is not null").select(dealt, "user_id", "ts", F.unix_micros("ts").alias("at"), F.col("amount").cast("double"), F.col("amount").isNotNull().alias("filled"))
    kind, delay = txn.schema["user_id"].dataType.simpleString(), int(pd.Timedelta(late).total_seconds() * 1000) + DAY // 1000
    each = rows.withWatermark("ts", f"{delay} milliseconds").groupBy("dealt")
    out = each.transformWithStateInPandas(HoppingTotals(kind), f"user_id {kind}, start bigint, n bigint, filled boolean, amount double", "append", "EventTime")
    window = F.struct(F.timestamp_micros("start").alias("start"), F.timestamp_micros(F.col("start") + DAY).alias("end"))
    amount = F.when(F.col("filled"), F.coalesce("amount", F.lit(float("nan"))))  # NaN comes out of pandas as NULL
    return out.select(window.alias("window"), "user_id", "n", amount.alias("amount"))


def score_stream(txn: DataFrame, block: DataFrame, score: str = "fraud_score") -> DataFrame:
    """Screening, rules, score and route of each row: stateless, lists joined as static tables.
    txn has the columns that the rules read; users, devices, addresses (if there is a column
    ip_address) and e-mail domains are screened. block: entity_type, entity."""
    domain = domain_last(F.coalesce("email", F.lit("")))
    entities = {"user": F.col("user_id"), "device": F.col("device_id"), "email_domain": F.when(domain != "", domain).otherwise(F.lower("email_domain"))}
    if "ip_address" in txn.columns:
        entities["ip"] = F.col("ip_address")
    screened = txn
    for kind, entity in entities.items():
        held = block.where(F.col("entity_type") == kind).select(F.col("entity").alias(f"_{kind}"), F.lit(kind).alias(f"_hit_{kind}")).distinct()
        screened = screened.join(held, entity == F.col(f"_{kind}"), "left").drop(f"_{kind}")
    hits = F.array_compact(F.array(*(F.col(f"_hit_{k}") for k in entities)))
    screened = screened.withColumns({"blocked": F.size(hits) > 0, "blocked_by": hits}).drop(*(f"_hit_{k}" for k in entities))
    return routing.route(routing.fallback_score(rules.evaluate_rules(screened), score))


class SlaAlarms(StatefulProcessor):
    """One alarm at created + sla unless the case was resolved by then. Rows are taken in the order
    of their times, whichever micro-batch brings them: a row past the due time raises the alarm
    first, and a case that is enqueued after its alarm gets a new due time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, alarms = self.due.get()[0] if self.due.exists() else None, []
        before = due
        for r in pd.concat(rows).sort_values(["at_ms", "event"], kind="stable").itertuples():
            if due is not None and r.at_ms > due:
                alarms.append(due)
                due = None
            if r.event == "ENQUEUED" and due is None:
                due = int(r.at_ms) + int(r.sla_minutes) * 60_000
            elif r.event == "RESOLVED":
                due = None
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is None:
                self.due.clear()
            else:
                self.due.update((due,))
                self.handle.registerTimer(due)
        yield pd.DataFrame({"case_id": [key[0]] * len(alarms), "due_ms": alarms}).astype({"due_ms": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.due.get()[0] if self.due.exists() else expiredTimerInfo.getExpiryTimeInMs()
        self.due.clear()
        yield pd.DataFrame({"case_id": [key[0]], "due_ms": [due]})

    def close(self) -> None:
        pass


def sla_alarms(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """events: case_id, event, ts, sla_minutes."""
    rows = events.withColumn("at_ms", F.unix_millis("ts")).withWatermark("ts", late)
    return rows.groupBy("case_id").transformWithStateInPandas(SlaAlarms(), "case_id string, due_ms bigint", "append", "EventTime")


def without_duplicates(txn: DataFrame, late: str = "24 hours") -> DataFrame:
    return txn.withWatermark("ts", late).dropDuplicatesWithinWatermark(["transaction_id"])


EDGES = "src string, dst string, rel_type string, transaction_id bigint"
COUNTERS = "account string, transactions bigint, fraud bigint, amount decimal(38,4), first_us bigint, last_us bigint"


def batch_counters(batch: DataFrame, account: str = "user_id") -> DataFrame:
    """What a batch adds to the counters of its accounts."""
    us = F.unix_micros("ts")
    return batch.groupBy(F.col(account).cast("string").alias("account")).agg(
        F.count("*").alias("transactions"),
        F.sum(F.coalesce("is_fraud", F.lit(0)).cast("long")).alias("fraud"),
        F.sum(F.coalesce(F.col("amount").cast("decimal(28,4)"), F.lit(0))).cast("decimal(38,4)").alias("amount"),
        F.min(us).alias("first_us"),
        F.max(us).alias("last_us"),
    )


def summed_counters(rows: DataFrame) -> DataFrame:
    total = [F.sum(c).cast(kind).alias(c) for c, kind in (("transactions", "long"), ("fraud", "long"), ("amount", "decimal(38,4)"))]
    return rows.groupBy("account").agg(*total, F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def graph_updater(path: str, ends: dict[str, tuple[str, str]], every: int = 20) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds a batch's edges and what it adds to the counters of its
    accounts, as deltas of its batch id: a batch that is run again replaces its own or, once a
    snapshot holds it, changes nothing. Every so many batches the deltas before are folded."""

    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        versioned.add_delta(graph.transaction_edges(batch, ends).select("src", "dst", "rel_type", "transaction_id"), f"{path}/edges", batch_id)
        versioned.add_delta(batch_counters(batch), f"{path}/counters", batch_id)
        batch.unpersist()
        if batch_id % every == every - 1:
            versioned.fold_deltas(spark, f"{path}/edges", EDGES, DataFrame.distinct, batch_id)
            versioned.fold_deltas(spark, f"{path}/counters", COUNTERS, summed_counters, batch_id)

    return update


def edges_so_far(spark: SparkSession, path: str) -> DataFrame:
    return versioned.read_folded(spark, f"{path}/edges", EDGES, DataFrame.distinct)


def counters_so_far(spark: SparkSession, path: str) -> DataFrame:
    """account, transactions, fraud, amount, first_us, last_us over all batches."""
    return versioned.read_folded(spark, f"{path}/counters", COUNTERS, summed_counters)


#: State lies in RocksDB. A put does not look whether its key is new, and a batch writes what it
#: has changed, not the whole store.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def finished(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end into Parquet in the shared folder and read it."""
    import uuid

    spark = df.sparkSession
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(f"{root}/out")


__all__ = ["counters_so_far", "edges_so_far", "finished", "graph_updater", "hopping_totals", "lists", "score_stream", "sla_alarms", "trailing_stream", "warm_events", "without_duplicates"]
