"""Replays of events in several batches, out of order, against the batch form of each operator."""

import datetime as dt
import os
import random

import pandas as pd
import pytest
from lumenfold.operators.sessions import sessions
from lumenfold.streaming.pairs import followed_by
from lumenfold.streaming.pending import FirstAnswer, first_answers, stream_first_answers
from lumenfold.streaming.replay import run_to_end, streamed
from lumenfold.streaming.windows import events_by_window, sessions_of
from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value long"
END = (9_999, START + dt.timedelta(days=60), 99, "end", 0)  # moves the watermark past all others


def asked(seconds=6 * 3600):
    return "user_id", "ts", "event_id", F.col("event_type") == "view", F.col("event_type") == "purchase", seconds


def events(seed, n=300):
    r = random.Random(seed)
    rows = [(k, START + dt.timedelta(seconds=r.randrange(2 * 86_400)), r.choice([1, 1, 2, 3]), r.choice(["view", "view", "purchase", "click"]), r.randrange(9)) for k in range(n)]
    same = START + dt.timedelta(hours=5)
    return rows + [(n + k, same, 1, kind, 1) for k, kind in enumerate(["view", "purchase", "purchase", "view"])] + [(n + 4, None, 1, "view", 1), (n + 5, same, None, "view", 1)]


class Folder:
    """Files that a stream reads in the order in which they were added."""

    def __init__(self, spark, path):
        self.spark, self.path, self.files = spark, str(path), 0
        os.makedirs(self.path)

    def add(self, rows):
        self.files += 1
        name = f"{self.path}/{self.files:04}.parquet"
        self.spark.createDataFrame(rows, SCHEMA).toPandas().astype({"user_id": "Int64"}).to_parquet(name, coerce_timestamps="us")
        os.utime(name, (1_700_000_000 + self.files,) * 2)

    def add_shuffled(self, rows, parts, seed=0):
        """In order of time, but for up to an hour's delay, in `parts` files."""
        r = random.Random(seed)
        arrived = sorted(rows, key=lambda x: (x[1] or START) + dt.timedelta(seconds=r.randrange(3_500)))
        for k in range(parts):
            self.add(arrived[k * len(rows) // parts : (k + 1) * len(rows) // parts])

    def stream(self, files=1):
        return streamed(self.spark, self.path, self.spark.createDataFrame([], SCHEMA), files)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def batch(spark):
    return spark.createDataFrame(events(1), SCHEMA)


def test_first_answers_against_plain(batch):
    listed, want = events(1), []
    micros = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    for i, at, user, kind, _ in listed:
        if kind == "view" and None not in (at, user):
            fits = [(t, j) for j, t, u, k, _ in listed if k == "purchase" and u == user and t is not None and at < t <= at + dt.timedelta(hours=6)]
            want.append((user, i, micros(at), min(fits)[1] if fits else -1, micros(min(fits)[0]) - micros(at) if fits else -1))
    got = first_answers(batch, *asked())
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_first_answers_in_batches_and_after_a_restart(spark, batch, tmp_path):
    folder, into, state = Folder(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: run_to_end(stream_first_answers(folder.stream(), *asked()), state, into)
    listed = events(1)
    folder.add_shuffled(listed[:200] + listed[300:], 1)
    early = sorted(listed[200:300])
    want = first_answers(batch, *asked())
    assert run().count() < want.count()
    # started again from its checkpoint: what came before is kept, what is late of the rest would be dropped, so only rows within the watermark follow
    newest = max(x[1] for x in listed[:200] if x[1]) - dt.timedelta(hours=1)
    later = [x for x in early if x[1] > newest]
    folder.add(later or [END])
    folder.add([END[:3] + ("view", 0)])
    seen = spark.createDataFrame(listed[:200] + listed[300:] + later, SCHEMA)
    assert rows(run()) == rows(first_answers(seen, *asked()))
    assert rows(run()) == rows(first_answers(seen, *asked()))  # nothing twice


def test_first_answers_of_shuffled_files(spark, batch, tmp_path):
    folder = Folder(spark, tmp_path / "in")
    folder.add_shuffled(events(1), 3)
    folder.add([END[:3] + ("view", 0)])
    folder.add([(7_000, START, 1, "view", 0), (7_001, START + dt.timedelta(minutes=1), 1, "purchase", 0)])  # far behind the watermark
    found = run_to_end(stream_first_answers(folder.stream(), *asked()))
    assert rows(found) == rows(first_answers(batch, *asked()))


class State:
    """Stands for the state of one key: a map, or a value."""

    def __init__(self):
        self.at = {}

    def getValue(self, key):
        return self.at.get(key)

    def updateValue(self, key, value):
        self.at[key] = value

    def removeKey(self, key):
        del self.at[key]

    def iterator(self):
        return iter(list(self.at.items()))

    def clear(self):
        self.at.clear()

    def get(self):
        return self.at.get("value")

    def update(self, value):
        self.at["value"] = value


class Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):
        return State()

    getValueState = getMapState

    def registerTimer(self, ms):
        self.timers.add(ms)


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


@pytest.mark.parametrize("limit", [5, 7_000, 40_000_000])
def test_state_is_empty_in_the_end(limit):
    """Limits down to ticks shorter than the milliseconds of timers; rows in order but for a fifth of the limit, the watermark behind them."""
    r = random.Random(2)
    listed = [(r.randrange(20 * limit), k, r.random() < 0.5) for k in range(300)]
    arrived = sorted(listed, key=lambda x: x[0] + r.randrange(limit // 5 + 1))
    p, handle, out, largest = FirstAnswer(limit), Handle(), [], 0
    p.init(handle)

    def fire(watermark):
        for ms in sorted(t for t in handle.timers if t <= watermark):
            handle.timers.discard(ms)
            for frame in p.handleExpiredTimer((1,), Clock(watermark), None):
                out.extend(frame.itertuples(index=False, name=None))

    for k in range(0, 300, 10):
        assert not list(p.handleInputRows((1,), iter([pd.DataFrame(arrived[k : k + 10], columns=["at", "id", "is_call"])]), None))
        fire((max(x[0] for x in arrived[: k + 10]) - limit // 5 - 1) // 1_000)
        largest = max(largest, len(p.calls.at) + len(p.answers.at))
    fire(1 << 50)
    want = []
    for at, i, is_call in listed:
        if is_call:
            fits = [(t, j) for t, j, c in listed if not c and at < t <= at + limit]
            want.append((1, i, at, min(fits)[1] if fits else -1, min(fits)[0] - at if fits else -1))
    assert sorted(out) == sorted(want) and not p.calls.at and not p.answers.at and not p.timer.at and not handle.timers
    assert limit < 40_000_000 or largest < 60  # of 2 * 20 * 8 ticks


def test_many_keys_ask_little_of_the_state(monkeypatch):
    """2,000 keys of a bucket: as many reads and writes as ticks, and each key's own answers."""
    r, limit, asked_for = random.Random(6), 8_000, []
    listed = [(r.randrange(2_000), r.randrange(5 * limit), k, r.random() < 0.5) for k in range(20_000)] + [(7, limit, k, k > 20_004) for k in range(20_000, 20_008)]
    for name in ("getValue", "updateValue"):
        call = getattr(State, name)
        monkeypatch.setattr(State, name, lambda self, *x, call=call: asked_for.append(x) or call(self, *x))
    p, handle = FirstAnswer(limit), Handle()
    p.init(handle)
    assert not list(p.handleInputRows((3,), iter([pd.DataFrame(listed, columns=["key", "at", "id", "is_call"])]), None))
    out = [x for frame in p.handleExpiredTimer((3,), Clock(1 << 50), None) for x in frame.itertuples(index=False, name=None)]
    answers = {}
    for key, at, i, is_call in listed:
        if not is_call:
            answers.setdefault(key, []).append((at, i))
    want = []
    for key, at, i, is_call in listed:
        if is_call:
            first = min((x for x in answers.get(key, []) if at < x[0] <= at + limit), default=None)
            want.append((key, i, at, first[1] if first else -1, first[0] - at if first else -1))
    assert sorted(out) == sorted(want) and len(asked_for) <= 2 * 2 * 5 * 8 and not p.calls.at and not p.answers.at


def test_sessions_of_shuffled_files(spark, batch, tmp_path):
    folder = Folder(spark, tmp_path / "in")
    folder.add_shuffled(events(1), 3)
    folder.add([END])
    folder.add([(7_000, START, 1, "view", 0)])
    found = run_to_end(sessions_of(folder.stream(), ["user_id"], "ts", 1_800, {"total": F.col("value")}))
    assert rows(found) == rows(sessions(batch, ["user_id"], "ts", 1_800, {"total": F.col("value")}))


def sides(df):
    of = lambda kind: df.where((F.col("event_type") == kind) | (F.col("event_type") == "end")).select("user_id", F.col("event_id").alias(f"{kind}_id"), F.col("ts").alias(f"{kind}_at"))
    return of("view"), of("purchase"), ["user_id"], ("view_at", "purchase_at"), "6 HOURS"


@pytest.mark.parametrize("how", ["inner", "left_outer"])
def test_pairs_of_shuffled_files(spark, batch, tmp_path, how):
    folder = Folder(spark, tmp_path / "in")
    folder.add_shuffled([x for x in events(1) if x[1]], 3)
    folder.add([END])
    folder.add([(7_000, START, 1, "view", 0), (7_001, START + dt.timedelta(minutes=1), 1, "purchase", 0)])
    found = run_to_end(followed_by(*sides(folder.stream()), how=how)).where("user_id is null or user_id < 99")
    assert rows(found) == rows(followed_by(*sides(batch.where("ts is not null")), how=how))


def test_pairs_cases(batch):
    left, right, *rest = sides(batch)
    listed = [x for x in events(1) if None not in (x[1], x[2])]
    want = {(a[0], b[0]) for a in listed for b in listed if a[3] == "view" and b[3] == "purchase" and a[2] == b[2] and a[1] < b[1] <= a[1] + dt.timedelta(hours=6)}
    found = followed_by(left, right, *rest).collect()
    assert {(x.view_id, x.purchase_id) for x in found} == want and len(found) == len(want)
    with pytest.raises(ValueError, match="names that are in both"):
        followed_by(left, left, *rest)


def test_windows_in_append_mode(spark, batch, tmp_path):
    folder = Folder(spark, tmp_path / "in")
    folder.add_shuffled([x for x in events(1) if x[1]], 3)
    folder.add([END])
    found = run_to_end(events_by_window(folder.stream())).where("event_type <> 'end'")
    assert rows(found) == rows(events_by_window(batch.where("ts is not null")))
