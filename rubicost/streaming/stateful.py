"""Stateful streams with timers: a queue of jobs, cards that expire, run logs with costs.

Each is a ``StatefulProcessor`` of ``transformWithStateInPandas``: the state lives
in the stream's state store and survives restarts from the checkpoint. Rows of a
key are taken in order of time within a micro-batch; batches have to follow each
other in time, up to the watermark. The batch folds of ``plans.history`` define
what comes out.

The queue frees a key and the deck expires a card by event-time timers, so state
of keys that are never seen again goes too. A run log keeps the numbers it has
seen; ``ttl`` (milliseconds) lets it forget them when late copies can't come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rubicost.plans.history import Card
from rubicost.registry import query
from rubicost.streaming.log import event_stream, run_available
from rubicost.tables import Tables

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def whole(rows: Iterator[pd.DataFrame], order: list[str], columns: list[str]) -> list[tuple]:
    """The rows of a key in one micro-batch, in order; plain tuples, as a frame for each key costs more than its rows."""
    names = order + [c for c in columns if c not in order]
    got = [r for part in rows for r in zip(*(part[c].tolist() for c in names), strict=True)]
    got.sort(key=lambda r: r[: len(order)])
    at = [names.index(c) for c in columns]
    return [tuple(r[i] for i in at) for r in got]


class JobQueue(StatefulProcessor):
    """One job for each key at a time. A timer at a job's end frees its key and reports that.

    Out: key, event_id, at (microseconds), what: taken, held, or freed by the timer.
    """

    OUT = "key long, event_id long, at long, what string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "event_id long, free long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.running.get() if self.running.exists() else None
        out = []
        for event_id, at, lasts in whole(rows, ["at", "event_id"], ["event_id", "at", "lasts"]):
            if held is not None and at >= held[1]:
                # its end comes before this row, whether the timer has fired or not
                self.handle.deleteTimer(_millis(held[1]))
                out.append((key[0], held[0], held[1], "freed"))
                held = None
            if held is None:
                held = (int(event_id), int(at + lasts))
                self.handle.registerTimer(_millis(held[1]))
                out.append((key[0], event_id, at, "taken"))
            else:
                out.append((key[0], event_id, at, "held"))
        if held is not None:
            self.running.update(held)
        yield pd.DataFrame(out, columns=["key", "event_id", "at", "what"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.running.exists():
            event_id, free = self.running.get()
            if _millis(free) <= expiredTimerInfo.getExpiryTimeInMs():
                out = [(key[0], event_id, free, "freed")]
                self.running.clear()
        yield pd.DataFrame(out, columns=["key", "event_id", "at", "what"])

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    """The first whole millisecond at or after a time."""
    return int(-(-micros // 1000))


class CardDeck(StatefulProcessor):
    """Decisions on the cards of a deck by ``plans.history.Card``. A timer expires cards that are still open.

    A deck's cards are one state, read and written once for each micro-batch, and
    have one timer, at the first time an open one expires: calls to the store grow
    with decks, not with cards. A deck has to stay small.

    Out: card_id, event_id (null for a timer), state, effect (expired for a timer).
    """

    OUT = "card_id long, event_id long, state string, effect string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.card = handle, Card()
        self.cards = handle.getListState("cards", "card_id long, name string, decided double, begun double")

    def expires(self, begun: float) -> int:
        return _millis(int((begun + self.card.expiry) * 1_000_000) + 1)

    def put(self, cards: dict[int, tuple]) -> None:
        self.cards.put([(card_id, *state) for card_id, state in cards.items()])
        if due := [self.expires(begun) for name, _, begun in cards.values() if name == "open"]:
            self.handle.registerTimer(min(due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cards = {card_id: state for card_id, *state in self.cards.get()}
        out = []
        for card_id, event_id, at, action in whole(rows, ["at", "event_id"], ["card_id", "event_id", "at", "action"]):
            name, decided, begun = cards.get(card_id) or (*Card.start, float(at))
            (name, decided), said = self.card.step((name, decided), float(at), action, begun)
            cards[card_id] = (name, decided, begun)
            out.append((card_id, event_id, *said))
        self.put(cards)
        yield pd.DataFrame(out, columns=["card_id", "event_id", "state", "effect"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cards = {card_id: state for card_id, *state in self.cards.get()}
        by = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        gone = [card_id for card_id, (name, _, begun) in cards.items() if name == "open" and self.expires(begun) <= by]
        if gone:
            self.put(cards | {card_id: ("expired", None, cards[card_id][2]) for card_id in gone})
        yield pd.DataFrame([(card_id, None, "expired", "expired") for card_id in gone], columns=["card_id", "event_id", "state", "effect"]).astype({"event_id": "Int64"})

    def close(self) -> None:
        pass


class RunLog(StatefulProcessor):
    """A run's log and its costs: the second row with a number is passed over, the others add up.

    Seen numbers are kept as bits of ``BLOCK`` neighbours, each block read and
    written once for a run's rows of a micro-batch.

    Out: run_id, seq, event_id, cost, total so far.
    """

    OUT = "run_id long, seq long, event_id long, cost double, total double"
    #: numbers of a block; their bits are a long that isn't negative
    BLOCK = 62

    def __init__(self, ttl: int | None = None) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "block long", "bits long", ttlDurationMs=self.ttl)
        self.total = handle.getValueState("total", "cents long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.total.get()
        cents = held[0] if held else 0
        before, bits, out = {}, {}, []
        for seq, event_id, cost in whole(rows, ["event_id"], ["seq", "event_id", "cost"]):
            block, place = divmod(int(seq), self.BLOCK)
            if block not in before:
                known = self.seen.getValue((block,)) if held else None
                before[block] = bits[block] = known[0] if known else 0
            if not bits[block] >> place & 1:
                bits[block] |= 1 << place
                cents += round(cost * 100)
                out.append((key[0], seq, event_id, cost, cents / 100))
        for block, now in bits.items():
            if now != before[block]:
                self.seen.updateValue((block,), (now,))
        self.total.update((cents,))
        yield pd.DataFrame(out, columns=["run_id", "seq", "event_id", "cost", "total"])

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, key: str, processor: StatefulProcessor, timed: bool = False) -> DataFrame:
    """The stream through a processor, by key; ``timed`` for event-time timers, which need a watermark."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return stream.groupBy(key).transformWithStateInPandas(processor, processor.OUT, "Append", "EventTime" if timed else "None")


def job_stream(events: DataFrame) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    rows = events.select((F.col("user_id") % 50).alias("key"), "event_id", at.alias("time"), F.unix_micros(at).alias("at"), F.round(F.col("value") * 600_000_000).cast("long").alias("lasts"))
    return stateful(rows.withWatermark("time", "1 hour"), "key", JobQueue(), timed=True)


def card_stream(events: DataFrame) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    action = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type").isin("view", "click"), "allowed").otherwise("denied")
    # a user's cards are a deck: one for each day of the month
    rows = events.select(F.col("user_id").alias("deck"), (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("card_id"), "event_id", at.alias("time"), (F.unix_micros(at) / 1e6).alias("at"), action.alias("action"))
    return stateful(rows.withWatermark("time", "1 hour"), "deck", CardDeck(), timed=True)


def cost_stream(events: DataFrame) -> DataFrame:
    rows = events.select(F.col("user_id").alias("run_id"), F.get_json_object("props", "$.k").cast("long").alias("seq"), "event_id", F.col("value").alias("cost")).where("seq IS NOT NULL")
    return stateful(rows, "run_id", RunLog())


@query("""WITH RECURSIVE e AS (SELECT user_id % 50 AS key, event_id, epoch_us(ts) AS tm, round(value * 600000000)::BIGINT AS lasts, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT key, event_id, k, tm, 'taken' AS what, tm + lasts AS free FROM e WHERE k = 1
    UNION ALL SELECT e.key, e.event_id, e.k, e.tm, CASE WHEN e.tm >= s.free THEN 'taken' ELSE 'held' END, CASE WHEN e.tm >= s.free THEN e.tm + e.lasts ELSE s.free END FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1)
SELECT key, event_id, tm AS at, what FROM s""")
def streamed_jobs(t: Tables):
    """Which jobs of the event stream are taken: a key frees when its job ends, by a timer."""
    return run_available(job_stream(event_stream(t))).where("what <> 'freed'")


@query("""WITH RECURSIVE e AS (SELECT user_id * 100 + day(ts) AS card_id, event_id, epoch_us(ts) / 1e6 AS tm, CASE WHEN event_type = 'error' THEN 'undo' WHEN event_type IN ('view', 'click') THEN 'allowed' ELSE 'denied' END AS action FROM events),
n AS (SELECT *, row_number() OVER w AS k, first_value(tm) OVER w AS start FROM e WINDOW w AS (PARTITION BY card_id ORDER BY tm, event_id)),
s AS (SELECT card_id, event_id, k, CASE WHEN action = 'undo' THEN 'open' ELSE action END AS state, CASE WHEN action <> 'undo' THEN tm END AS decided, CASE WHEN action = 'undo' THEN 'ignored' ELSE 'applied' END AS effect FROM n WHERE k = 1
    UNION ALL SELECT card_id, event_id, k, CASE WHEN action = 'undo' THEN CASE WHEN was IN ('allowed', 'denied') AND tm - decided <= 10 THEN 'open' ELSE was END WHEN was = 'open' THEN action ELSE was END,
        CASE WHEN action = 'undo' THEN CASE WHEN was IN ('allowed', 'denied') AND tm - decided <= 10 THEN NULL ELSE decided END WHEN was = 'open' THEN tm ELSE decided END,
        CASE WHEN action = 'undo' THEN CASE WHEN was IN ('allowed', 'denied') AND tm - decided <= 10 THEN 'undone' ELSE 'ignored' END WHEN was = 'open' THEN 'applied' ELSE 'ignored' END
        FROM (SELECT n.card_id, n.event_id, n.k, n.tm, n.action, s.decided, CASE WHEN s.state = 'open' AND n.tm - n.start > 1800 THEN 'expired' ELSE s.state END AS was FROM s JOIN n ON n.card_id = s.card_id AND n.k = s.k + 1))
SELECT card_id, event_id, state, effect FROM s""")
def streamed_cards(t: Tables):
    """Decisions on cards from the event stream; open cards expire by a timer."""
    return run_available(card_stream(event_stream(t))).where("event_id IS NOT NULL")


@query("""WITH e AS (SELECT user_id AS run_id, json_extract_string(props, '$.k')::BIGINT AS seq, event_id, value AS cost FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY run_id, seq ORDER BY event_id) AS k FROM e WHERE seq IS NOT NULL)
SELECT run_id, seq, event_id, cost, (sum(cost::DECIMAL(18,2)) OVER (PARTITION BY run_id ORDER BY event_id))::DOUBLE AS total FROM f WHERE k = 1""")
def streamed_run_costs(t: Tables):
    """Costs of runs as they add up; an entry with a number that its run has already is passed over."""
    return run_available(cost_stream(event_stream(t)))
