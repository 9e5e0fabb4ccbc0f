"""Keyed state with timers: the first answer to each call of a key within a limit, or that none came.

Keys are dealt over a fixed number of buckets, and a bucket's calls and answers are kept in state by ticks of their time: what is asked of the
state and its timers grows with buckets and ticks, not with keys. When the watermark has passed the limit of a tick's calls, all answers
that could count have come, whatever the order of arrival: a timer decides the calls of all ticks that are due, removes what no later
call can need, and sets the bucket's next timer. So the rows are those of the batch form, `first_answers`, and state holds
about two limits of a bucket's rows, which is also what a timer reads at once. One key's state belongs to one task, as keyed state does.
The number of buckets is part of a stream's checkpoint: go on with the number that it began with.

Cases: an answer at the same time as the call doesn't count, one at the limit does; of answers at one time the smallest id counts; calls that repeat are
decided each; null keys, times and ids are left out; rows behind the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from lumenfold.operators.asof import asof_join

RESULT = "key long, call_id long, called_micros long, answer_id long, micros_to_answer long"
COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
#: Ticks of a limit: how finely state and timers are cut.
TICKS = 8
#: Buckets of keys.
BUCKETS = 256


def _arrays(parts: Iterable[tuple]) -> np.ndarray:
    """Keys, times and ids (rows) of all entries of state."""
    return np.concatenate([np.zeros((3, 0), np.int64), *[np.array(list(x), np.int64) for x in parts]], axis=1)


def decided(calls: np.ndarray, answers: np.ndarray, limit: int) -> pd.DataFrame:
    """RESULT of calls, given all answers that could count (keys, times and ids each)."""
    key, at, ids = np.concatenate([calls, answers], axis=1)
    is_call = np.arange(len(key)) < calls.shape[1]
    order = np.lexsort((ids, is_call, at, key))  # answers at the time of a call stand before it
    call, answer = order[is_call[order]], order[~is_call[order]]
    after = np.searchsorted(np.flatnonzero(~is_call[order]), np.flatnonzero(is_call[order]))
    found = np.append(answer, -1)[after]
    gone = at[found] - at[call]
    fits = (found >= 0) & (key[found] == key[call]) & (gone >= 0) & (gone <= limit)
    return pd.DataFrame(dict(zip(COLUMNS, (key[call], ids[call], at[call], np.where(fits, ids[found], -1), np.where(fits, gone, -1)), strict=True)))


class FirstAnswer(StatefulProcessor):
    """Rows key, at (micros), id and is_call of a bucket of keys (without key: of the group's own); emits RESULT, with -1 where no answer came."""

    def __init__(self, limit_micros: int):
        self.limit, self.tick = limit_micros, max(1, -(-limit_micros // TICKS))

    def init(self, handle) -> None:
        self.handle = handle
        kept = "key array<bigint>, at array<bigint>, id array<bigint>"
        self.calls = handle.getMapState("calls", "tick bigint", kept)
        self.answers = handle.getMapState("answers", "tick bigint", kept)
        self.timer = handle.getValueState("timer", "ms bigint")

    def _due_ms(self, tick: int) -> int:
        """When all calls of a tick have passed their limit, in the milliseconds that timers know."""
        return -(-((tick + 1) * self.tick + self.limit) // 1_000)

    def _wake_for(self, tick: int, set_: int | None) -> None:
        """See that a timer is set for a tick; set_: when the next one is set."""
        due = self._due_ms(tick)
        if set_ is None or due < set_:
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            at, is_call = batch["at"].to_numpy(np.int64), batch["is_call"].to_numpy(bool)
            keys = batch["key"].to_numpy(np.int64) if "key" in batch else np.full(len(batch), key[0])
            new, ticks = np.stack([keys, at, batch["id"].to_numpy(np.int64)]), at // self.tick
            order = np.lexsort((ticks, is_call))
            for some in np.split(order, np.flatnonzero(np.diff(ticks[order]) | np.diff(is_call[order])) + 1) if len(order) else []:
                state, tick = self.calls if is_call[some[0]] else self.answers, int(ticks[some[0]])
                held = state.getValue((tick,)) or ([], [], [])
                state.updateValue((tick,), tuple([*old, *x] for old, x in zip(held, new[:, some].tolist(), strict=True)))
                first = tick if first is None else min(first, tick)
        if first is not None:
            self._wake_for(first, (self.timer.get() or (None,))[0])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, left = timerValues.getCurrentWatermarkInMs(), []
        calls, answers = ({k[0]: v for k, v in state.iterator()} for state in (self.calls, self.answers))
        due = [v for tick, v in calls.items() if self._due_ms(tick) <= now]
        for state, ticks in ((self.calls, calls), (self.answers, answers)):  # calls that an answer of a tick that is due could answer are decided now, or were before
            stay = [t for t in ticks if self._due_ms(t) > now]
            if not stay:
                state.clear()
            for t in set(ticks) - set(stay) if stay else []:
                state.removeKey((t,))
            left += stay
        self.timer.clear()
        if left:
            self._wake_for(min(left), None)
        if due:
            yield decided(_arrays(due), _arrays(answers.values()), self.limit)

    def close(self) -> None:
        pass


def _rows(events: DataFrame, by: str, on: str, id_: str, is_call, is_answer) -> DataFrame:
    named = events.select(F.col(by).cast("long").alias("key"), F.col(on).cast("timestamp").alias("time"), F.col(id_).cast("long").alias("id"), is_call.alias("is_call"), is_answer.alias("is_answer"))
    return named.where("(is_call or is_answer) and key is not null and time is not null and id is not null")


def stream_first_answers(events: DataFrame, by: str, on: str, id_: str, is_call, is_answer, limit_seconds: int, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """RESULT of a stream: each call once its limit has passed. Needs RocksDB as the provider of state (`replay.STATE`)."""
    rows = _rows(events, by, on, id_, is_call, is_answer).withWatermark("time", late).withColumn("at", F.unix_micros("time"))
    sides = F.filter(F.array(F.when(F.col("is_call"), F.lit(True)), F.when(F.col("is_answer"), F.lit(False))), lambda x: x.isNotNull())
    split = rows.select("key", "time", "at", "id", F.explode(sides).alias("is_call"))  # a row may be both
    return split.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).groupBy("bucket").transformWithStateInPandas(FirstAnswer(limit_seconds * 1_000_000), RESULT, "Append", "EventTime")


def first_answers(events: DataFrame, by: str, on: str, id_: str, is_call, is_answer, limit_seconds: int) -> DataFrame:
    """RESULT of a table: an as-of join with the first later answer."""
    rows = _rows(events, by, on, id_, is_call, is_answer).withColumn("at", F.unix_micros("time"))
    found = asof_join(rows.where("is_call"), rows.where("is_answer"), "at", ["key"], {"answer": "id", "answered": "at"}, tie=("id",), strict=True, later=True, within=F.lit(limit_seconds * 1_000_000))
    return found.select("key", F.col("id").alias("call_id"), F.col("at").alias("called_micros"), F.coalesce("answer", F.lit(-1)).cast("long").alias("answer_id"), F.coalesce(F.col("answered") - F.col("at"), F.lit(-1)).cast("long").alias("micros_to_answer"))
