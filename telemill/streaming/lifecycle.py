"""Stateful streaming: the delivery ledger, the collector fleet, and collectors that fall silent.

State is kept per key in Spark's state store. Moves may arrive in any order: each key holds back what came too early,
and applies its moves by ``seq``. The keys are dealt into buckets, whose rows are one value of the store each, so a
micro-batch costs as much as the buckets it touches, and a key costs no message of its own (:class:`Bucketed`).
The batch operators ``ledger_apply`` and ``fleet_fold`` give the same states from the same transition tables.

``transformWithState`` needs the RocksDB state store; start such streams inside :func:`state_store`.
"""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from telemill.operators.fleet import has_reason, identity, next_owner, transitions
from telemill.operators.ledger import DEAD_LETTERED, DELIVERED, QUEUED, RESULTS, RETRYING, UPLOADING

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

LEDGER_OUT = "event_id string, seq bigint, action string, accepted boolean, state int, attempts int, failure_code string"
FLEET_OUT = (
    "collector_id string, seq bigint, kind string, outcome string, status string, version string, queue_depth bigint, "
    "delivery_status string, last_seen_at timestamp"
)
STALE_OUT = "collector_id string, status string, last_seen_at timestamp"

#: How long rows that are done are remembered, in event time, to refuse later moves.
KEEP = 24 * 3600 * 1000
#: Buckets that the keys of a stream are dealt into; a stream that goes on from its state keeps their number.
BUCKETS = 2048
#: Stands for null among whole numbers, which pandas would turn into floats.
_NULL = -(2**63)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session's own setting comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


def _micros(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as microseconds, which pass between Spark and Python without a time zone."""
    return df.withColumns({f"{c}_us": F.unix_micros(c) for c in columns})


class InOrder(StatefulProcessor):
    """Applies the moves of a key by ``seq``, whatever order they arrive in.

    A move is applied once all smaller numbers from ``first_seq`` on have been, or once the watermark has passed
    its time, so that nothing before it can come any more. Until then it waits in the key's row. A number that
    was passed over is refused when it comes after all. ``STATE`` names the columns of a key's row. All that is kept
    of a key is one value: each access to the store is a message, and those cost more than the moves.

    As a processor of its own it is one key a group. The streams below keep the keys of a bucket together instead
    (:class:`Bucketed`), with the same rules.
    """

    STATE = ""

    def __init__(self, move: str, out: str, first_seq: int):
        self.move, self.out, self.first_seq = move, _names(out), first_seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names, self.columns = _names(self.STATE), _names(self.move)
        fields = ", ".join(c.replace(" ", ":", 1) for c in self.move.split(", "))
        self.row = handle.getValueState("row", f"next_seq bigint, waiting array<struct<{fields}>>, last_ms bigint, {self.STATE}")
        self.as_move, self.as_out = Row(*self.columns), Row(*self.out)

    def step(self, state: tuple | None, move: Row) -> tuple[tuple, tuple | None]:
        """The output of a move and the state after it."""
        raise NotImplementedError

    def refused(self, state: tuple | None, move: Row) -> tuple:
        """The output of a move that comes too late."""
        raise NotImplementedError

    def done(self, state: tuple | None) -> bool:
        """Whether a key's row is to be forgotten some time after its last move."""
        return False

    def timers(self, state: tuple | None) -> list[int]:
        """Times at which :meth:`passed` is to be called."""
        return []

    def passed(self, state: tuple | None, time: int) -> list[tuple]:
        """What to put out when such a time has passed."""
        return []

    def _read(self) -> tuple[int, list[Row], int, tuple | None]:
        kept = self.row.get()
        if kept is None:
            return self.first_seq, [], 0, None
        state = tuple(kept[3:])
        # The state gives the moves that wait back as plain tuples.
        return kept[0], [self.as_move(*m) for m in kept[1] or ()], kept[2], None if all(x is None for x in state) else state

    def _due(self, key: str, state: tuple | None, times: list[int], now: int) -> list[tuple]:
        """What times that have passed already put out; no timer would fire for them before the next batch."""
        return [(key, *o) for t in times if t <= now for o in self.passed(state, t)]

    def _apply(self, key: str, moves: list, number: int, state: tuple | None, until: int | None) -> tuple:
        """Applies moves while they follow each other, or up to the last whose time is ``until`` or before."""
        out, last = [], 0
        moves.sort(key=lambda m: m.seq)
        sure = -1 if until is None else max((i for i, m in enumerate(moves) if m.at_us // 1000 <= until), default=-1)
        taken = 0
        for i, move in enumerate(moves):
            if move.seq < number:
                out.append((key, *self.refused(state, move)))
            elif move.seq == number or i <= sure:
                shown, state = self.step(state, move)
                out.append((key, *shown))
                number = move.seq + 1
                last = max(last, move.at_us // 1000)
            else:
                break
            taken += 1
        return out, moves[taken:], number, state, last

    def _keep(self, number: int, waiting: list, held: list, last: int, state: tuple | None, times: list[int]) -> None:
        if waiting:
            first = min(m.at_us for m in waiting)
            # The timer of the first of those that wait is set already if that has not changed.
            if not held or first != min(m.at_us for m in held):
                self.handle.registerTimer(first // 1000)
        elif self.done(state):
            self.handle.registerTimer(last + KEEP)
        for time in times:
            self.handle.registerTimer(time)
        self.row.update((number, [tuple(m[c] for c in self.columns) for m in waiting], last, *(state or (None,) * len(self.names))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        number, held, last, state = self._read()
        before = self.timers(state)
        out, waiting, number, state, newest = self._apply(key[0], [*rows, *held], number, state, None)
        last = max(last, newest)
        new, now = [t for t in self.timers(state) if t not in before], timerValues.getCurrentWatermarkInMs()
        out += self._due(key[0], state, new, now)
        self._keep(number, waiting, held, last, state, [t for t in new if t > now])
        return iter([self.as_out(*o) for o in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        number, held, last, state = self._read()
        now, time = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        out = [(key[0], *o) for o in self.passed(state, time)]
        if held:
            more, waiting, number, state, newest = self._apply(key[0], list(held), number, state, now)
            out += more + self._due(key[0], state, [t for t in self.timers(state) if t != time], now)
            last = max(last, newest)
            self._keep(number, waiting, held, last, state, [t for t in self.timers(state) if t > now])
        elif self.done(state) and last + KEEP <= now:
            self.row.clear()
        return iter([self.as_out(*o) for o in out])


class Bucketed:
    """Keeps the keys of a bucket as one value of the state, and applies their moves as :class:`InOrder` does.

    A group per key costs some messages to the state store and an Arrow batch of its results, a hundred times what its
    moves cost. Here a bucket's rows come as columns, its state beside them, and its results leave as columns. Of a key
    the next number, the moves that wait, the time of the last, the state and the times still to come are kept.
    The bucket has one timeout, for the first of all times of its keys.
    """

    def __init__(self, rules: InOrder):
        self.rules, self.columns = rules, _names(rules.move)
        self.whole = [c.split()[1] == "bigint" for c in rules.move.split(", ")]
        # Members of a Row are looked up by their names, which costs more than the rules.
        self.as_move = namedtuple("Move", self.columns)._make

    def _came(self, frames: Iterator[pd.DataFrame]) -> dict[str | None, list[tuple]]:
        """The moves of a micro-batch by key."""
        moves: dict[str | None, list[tuple]] = {}
        for frame in frames:
            columns = []
            for name, whole in zip(self.columns, self.whole):
                values = frame[name].tolist()
                columns.append([None if x == _NULL else x for x in values] if whole and _NULL in values else values)
            for key, move in zip(frame["key"].tolist(), map(self.as_move, zip(*columns))):
                moves.setdefault(key, []).append(move)
        return moves

    def _step(self, key: str | None, kept: tuple, moves: list[tuple], now: int) -> tuple[list[tuple], tuple]:
        """What the moves of a key put out, and what is kept of it then."""
        number, held, last, state, times = kept
        before = self.rules.timers(state)
        out, waiting, number, state, newest = self.rules._apply(key, [*moves, *map(self.as_move, held)], number, state, None)
        after = self.rules.timers(state)
        new = [t for t in after if t not in before]
        out += self.rules._due(key, state, new, now)
        times = [t for t in times if t in after] + [t for t in new if t > now]
        return out, (number, [tuple(m) for m in waiting], max(last, newest), state, times)

    def _first(self, kept: tuple) -> int | None:
        """The first time at which something is to be done for a key without a move of it."""
        _, held, last, state, times = kept
        at = self.columns.index("at_us")
        every = list(times)
        if held:
            every.append(min(m[at] for m in held) // 1000)
        elif self.rules.done(state):
            every.append(last + KEEP)
        return min(every, default=None)

    def _pass(self, key: str | None, kept: tuple, now: int) -> tuple[list[tuple], tuple | None]:
        """What times up to ``now`` put out for a key, and what is kept of it then; None if it is forgotten."""
        out = []
        while (time := self._first(kept)) is not None and time <= now:
            number, held, last, state, times = kept
            if time in times:
                out += [(key, *o) for o in self.rules.passed(state, time)]
                times = [t for t in times if t != time]
            if held:
                before = self.rules.timers(state)
                more, waiting, number, state, newest = self.rules._apply(key, [*map(self.as_move, held)], number, state, now)
                after = self.rules.timers(state)
                new = [t for t in after if t not in before]
                out += more + self.rules._due(key, state, new, now)
                times = [t for t in times if t in after] + [t for t in new if t > now]
                kept = (number, [tuple(m) for m in waiting], max(last, newest), state, times)
            elif self.rules.done(state) and last + KEEP <= now:
                return out, None
            else:
                kept = (number, held, last, state, times)
        return out, kept

    def __call__(self, bucket: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        # The first time of each key stands beside what is kept of it.
        keys: dict[str | None, tuple[tuple, int | None]] = pickle.loads(group.get[0]) if group.exists else {}
        now, out = group.getCurrentWatermarkMs(), []
        for key, moves in ({} if group.hasTimedOut else self._came(frames)).items():
            kept = keys[key][0] if key in keys else (self.rules.first_seq, [], 0, None, [])
            shown, kept = self._step(key, kept, moves, now)
            out += shown
            keys[key] = (kept, self._first(kept))
        for key in [k for k, (_, first) in keys.items() if first is not None and first <= now]:
            shown, kept = self._pass(key, keys[key][0], now)
            out += shown
            if kept is None:
                del keys[key]
            else:
                keys[key] = (kept, self._first(kept))
        if keys:
            group.update((pickle.dumps(keys, pickle.HIGHEST_PROTOCOL),))
            first = min((first for _, first in keys.values() if first is not None), default=None)
            if first is not None:
                # A group times out when the watermark is beyond its time; a key is due when it is reached.
                group.setTimeoutTimestamp(max(first - 1, now, 1))
        elif group.exists:
            group.remove()
        if out:
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(self.rules.out, zip(*out))})


def _in_buckets(slim: DataFrame, key: str, rules: InOrder, out: str) -> DataFrame:
    """The results of the moves ``slim`` of the column ``key``, which have ``at`` as their time."""
    whole = [c.split()[0] for c in rules.move.split(", ") if c.split()[1] == "bigint"]
    dealt = slim.withColumns({c: F.coalesce(c, F.lit(_NULL)) for c in whole}).select(
        F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket"), F.col(key).alias("key"), "at", *_names(rules.move)
    )
    return dealt.groupBy("bucket").applyInPandasWithState(Bucketed(rules), out, "keys binary", "append", GroupStateTimeout.EventTimeTimeout)


class Deliveries(InOrder):
    """The delivery states of a ledger row. The action ``enqueue`` creates it."""

    STATE = "state int, attempts int, lease_until_ms bigint, next_attempt_us bigint, failure_code string"

    def step(self, state, move):
        action, new = move.action, None
        if action == "enqueue":
            new = (QUEUED, 0, None, None, None) if state is None else None
        elif action == "lease":
            if state is not None and self._may_lease(state, move.at_us):
                until = None if move.lease_until_us is None else move.lease_until_us // 1000
                new = (UPLOADING, state[1] + 1, until, state[3], state[4])
        elif action in RESULTS and state is not None and state[0] == UPLOADING:
            to, needs = RESULTS[action]
            if getattr(move, needs):
                code = move.failure_code if needs == "failure_code" else None
                new = (to, state[1], None, move.next_attempt_at_us if to == RETRYING else None, code)
        return self._shown(move.seq, action, new is not None, new or state), new or state

    def refused(self, state, move):
        return self._shown(move.seq, move.action, False, state)

    def done(self, state):
        return state is None or state[0] in (DELIVERED, DEAD_LETTERED)

    def timers(self, state):
        return [state[2]] if state is not None and state[0] == UPLOADING and state[2] is not None else []

    def passed(self, state, time):
        # The row may be leased again.
        return [self._shown(None, "lease-expired", True, state)] if time in self.timers(state) else []

    @staticmethod
    def _may_lease(state: tuple, at: int) -> bool:
        number, _, lease_until, next_attempt, _ = state
        if number == RETRYING:
            return next_attempt is None or next_attempt <= at
        return number == QUEUED or (number == UPLOADING and lease_until is not None and lease_until * 1000 <= at)

    @staticmethod
    def _shown(seq, action, accepted, state):
        return (seq, action, accepted, *((None, None, None) if state is None else (state[0], state[1], state[4])))


def ledger_stream(moves: DataFrame, delay: str = "10 minutes", first_seq: int = 0) -> DataFrame:
    """Outcome and resulting state of every move ``event_id, seq, action, at, lease_until, next_attempt_at,
    failure_code, acknowledgement``, in the order of ``seq`` from ``first_seq`` on.

    Moves of one row may lie in different micro-batches in any order, ``delay`` apart at most in event time. A
    lease that runs out gives a row of the action ``lease-expired``. A row that is delivered or dead-lettered, or
    was never enqueued, is forgotten a day after its last move.
    """
    move = "seq bigint, action string, failure_code string, acknowledgement string, at_us bigint, lease_until_us bigint, next_attempt_at_us bigint"
    slim = _micros(moves.withWatermark("at", delay), "at", "lease_until", "next_attempt_at")
    slim = slim.select("event_id", "at", *_names(move))
    return _in_buckets(slim, "event_id", Deliveries(move, LEDGER_OUT, first_seq), LEDGER_OUT)


class Collectors(InOrder):
    """The life cycle of a collector, by the transition table of the batch fold."""

    STATE = "status string, principal string, version string, queue_depth bigint, delivery_status string, last_seen_us bigint"

    def step(self, state, move):
        status, owner, version, depth, delivery, seen = state or (None,) * 6
        moves = transitions(move.kind, move.action, move.target_status, has_reason(move.reason), identity(owner, move.principal))
        outcome, status = moves[status]
        owner = next_owner(owner, move.kind, move.principal)
        if outcome == "ok" and move.kind == "register":
            version, seen = move.version, move.at_us
            depth, delivery = 0 if depth is None else depth, delivery or "unknown"
        elif outcome == "ok" and move.kind == "heartbeat":
            version, depth, delivery, seen = move.version, move.queue_depth, move.delivery_status, move.at_us
        new = None if status is None else (status, owner, version, depth, delivery, seen)
        return self._shown(move, outcome, new), new

    def refused(self, state, move):
        return self._shown(move, "late", state)

    @staticmethod
    def _shown(move, outcome, state):
        status, _, version, depth, delivery, seen = state or (None,) * 6
        return (move.seq, move.kind, outcome, status, version, depth, delivery, seen)


def fleet_stream(events: DataFrame, delay: str = "10 minutes", first_seq: int = 1) -> DataFrame:
    """Outcome and resulting state of every fleet event, as :func:`telemill.operators.fleet.fleet_fold`.

    Events of a collector may arrive in any order, see :func:`ledger_stream`; one that comes after the watermark has
    let its successors pass has the outcome ``late``.
    """
    move = (
        "seq bigint, kind string, principal string, version string, queue_depth bigint, delivery_status string, action string, "
        "target_status string, reason string, at_us bigint"
    )
    slim = _micros(events.withWatermark("at", delay), "at").select("collector_id", "at", *_names(move))
    out = FLEET_OUT.replace("last_seen_at timestamp", "last_seen_us bigint")
    done = _in_buckets(slim, "collector_id", Collectors(move, out, first_seq), out)
    return done.withColumn("last_seen_us", F.timestamp_micros("last_seen_us")).withColumnRenamed("last_seen_us", "last_seen_at")


_SILENCE = Row("collector_id", "status", "last_seen_us")


class Silence(StatefulProcessor):
    """Tells when a collector has not been heard of for some time, and when it is heard of again.

    One timer per collector; contact moves it on. A timer needs no input to fire.
    """

    def __init__(self, after_ms: int, event_time: bool):
        self.after_ms, self.event_time = after_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", "last_seen_us bigint, timer_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        seen, timer = self.row.get() if self.row.exists() else (None, None)
        newest = max(r.at_us for r in rows)
        back = seen is not None and timer is None and newest > seen
        seen = newest if seen is None else max(seen, newest)
        due = (seen // 1000 if self.event_time else timerValues.getCurrentProcessingTimeInMs()) + self.after_ms
        if timer is None and not back and self.row.exists():
            # Old news of a silent collector.
            return iter([])
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.row.update((seen, due))
        return iter([_SILENCE(key[0], "heard", seen)] if back else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        seen, _ = self.row.get()
        self.row.update((seen, None))
        return iter([_SILENCE(key[0], "stale", seen)])


def stale_stream(contacts: DataFrame, after: str = "15 minutes", delay: str = "1 minute", clock: str = "event") -> DataFrame:
    """Rows ``collector_id, at`` to changes: ``stale`` when a collector was last heard of ``after`` ago, ``heard`` when
    it is heard of again.

    With the clock ``event`` time is that of the watermark, so a replay tells the same; with ``processing`` it is
    the machine's, and silence is told without any input.
    """
    if clock not in ("event", "processing"):
        raise ValueError("clock must be 'event' or 'processing'")
    spark = contacts.sparkSession
    after_ms = spark.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + INTERVAL {after}) AS ms").first().ms
    marked = contacts.withWatermark("at", delay) if clock == "event" else contacts
    slim = _micros(marked, "at").select("collector_id", "at", "at_us").where("at IS NOT NULL")
    mode = "EventTime" if clock == "event" else "ProcessingTime"
    out = StructType.fromDDL(STALE_OUT.replace("last_seen_at timestamp", "last_seen_us bigint"))
    done = slim.groupBy("collector_id").transformWithState(Silence(after_ms, clock == "event"), out, "append", mode)
    return done.withColumn("last_seen_us", F.timestamp_micros("last_seen_us")).withColumnRenamed("last_seen_us", "last_seen_at")
