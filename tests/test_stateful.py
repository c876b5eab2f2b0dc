"""Stateful streams, stopped half-way and started again from their checkpoint, against the batch folds."""

import datetime as dt
import random

import pandas as pd
import pytest

from rubicost.plans.history import Card, Queue
from rubicost.streaming.stateful import CardDeck, RunLog, card_stream, cost_stream, job_stream
from tests.test_operators import stepped

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(n=400):
    rng = random.Random(13)
    at, rows = dt.datetime(2024, 1, 1), []
    for i in range(n):
        at += dt.timedelta(seconds=rng.choice((1, 5, 60, 900, 4000)), microseconds=rng.randrange(1000))
        rows.append((i, at, rng.randrange(6), rng.choice(("view", "click", "error", "purchase")), round(rng.random() * 5, 2), f'{{"k": {rng.randrange(30)}}}'))
    return rows


def in_two_runs(spark, tmp_path, make, rows, cut):
    """What a stream writes that runs over the first rows, stops, and runs again from its checkpoint over the rest."""
    for part in (rows[:cut], rows[cut:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]


def micros(at):
    return int((at - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


@pytest.mark.parametrize("cut", [137])
def test_jobs(spark, tmp_path, cut):
    rows = events()
    got = in_two_runs(spark, tmp_path, job_stream, rows, cut)
    steps, want, ends = {}, [], {}
    for event_id, at, user, _, value, _ in rows:
        lasts = round(value * 600_000_000)
        (taken,) = steps.setdefault(user, stepped(Queue()))(micros(at), lasts)
        want.append((user, event_id, micros(at), "taken" if taken else "held"))
        if taken:
            ends[event_id] = (user, event_id, micros(at) + lasts, "freed")
    assert sorted(r for r in got if r[3] != "freed") == sorted(want)
    freed = [r for r in got if r[3] == "freed"]
    # each job frees its key once; only the keys' last jobs may still run
    assert len(freed) == len(set(freed)) and set(freed) <= set(ends.values()) and len(ends) - len(freed) <= 6


def test_cards(spark, tmp_path):
    rows = events()
    got = in_two_runs(spark, tmp_path, card_stream, rows, 211)
    steps, begun, want, led = {}, {}, [], {}
    for event_id, at, user, kind, _, _ in rows:
        card = user * 100 + at.day
        t = micros(at) / 1e6
        action = "undo" if kind == "error" else "allowed" if kind in ("view", "click") else "denied"
        said = steps.setdefault(card, stepped(Card()))(t, action, begun.setdefault(card, t))
        want.append((card, event_id, *said))
        led[card] = said[0]
    assert sorted(r for r in got if r[1] is not None) == sorted(want)
    expired = [r[0] for r in got if r[1] is None]
    assert len(expired) == len(set(expired)) and all(led[c] in ("open", "expired") for c in expired)


def test_second_entries_are_passed_over_and_costs_add_up(spark, tmp_path):
    rows = events()
    got = in_two_runs(spark, tmp_path, cost_stream, rows, 200)
    seen, cents, want = set(), {}, []
    for event_id, _, user, _, value, props in rows:
        seq = int(props[6:-1])
        if (user, seq) not in seen:
            seen.add((user, seq))
            cents[user] = cents.get(user, 0) + round(value * 100)
            want.append((user, seq, event_id, value, cents[user] / 100))
    assert sorted(got) == sorted(want)


class Store:
    """Stands in for a state handle and counts calls to its states and timers."""

    def __init__(self, nothing):
        self.nothing = nothing
        self.calls, self.timers, self.kept = 0, set(), {}

    def state(self, *_, **__):
        return self

    getValueState = getListState = getMapState = state

    def call(self, got=None):
        self.calls += 1
        return got

    def get(self):
        return self.call(self.kept.get("all", self.nothing))

    def put(self, values):
        self.call(self.kept.update(all=values))

    update = put

    def getValue(self, key):
        return self.call(self.kept.get(key))

    containsKey = getValue

    def updateValue(self, key, value):
        self.call(self.kept.update({key: value}))

    def exists(self):
        return self.call("all" in self.kept)

    def registerTimer(self, at):
        self.call(self.timers.add(at))


def test_calls_to_the_store_grow_with_decks_and_blocks_not_with_cards_and_rows():
    deck, store = CardDeck(), Store(())
    deck.init(store)
    rows = pd.DataFrame([(c, c * 10 + i, c * 1000.0 + i, "allowed" if i else "undo") for c in range(30) for i in range(3)], columns=["card_id", "event_id", "at", "action"])
    (out,) = deck.handleInputRows((1,), iter([rows[50:], rows[:50]]), None)
    assert len(out) == 90 and store.calls <= 3 and (out["effect"] == "applied").sum() == 30
    log, store = RunLog(), Store(None)
    log.init(store)
    rows = pd.DataFrame([(i % 100, i, 1.5) for i in range(250)], columns=["seq", "event_id", "cost"])
    (out,) = log.handleInputRows((1,), iter([rows]), None)
    assert len(out) == 100 and out["total"].iloc[-1] == 150 and store.calls <= 6
