"""Conversations, event logs and the job queue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rubicost.operators.scan import FAR, Machine, Numeric, Pieces, called, composed_fold
from rubicost.operators.topk import first_of
from rubicost.registry import query
from rubicost.tables import Tables


@query("""WITH d AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last_at, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS doc_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS doc_status,
    bool_or(o_orderstatus = 'P') AS active, max(o_orderdate) FILTER (WHERE o_orderpriority = '1-URGENT') AS sent_at FROM orders GROUP BY o_custkey)
SELECT c_custkey AS id, coalesce(n, 0) AS messages, doc_id, doc_status, last_at, coalesce(active, false) AS active_run,
    CASE WHEN sent_at IS NOT NULL THEN 'Sent' WHEN doc_id IS NOT NULL AND NOT coalesce(active, false) THEN 'Done' ELSE 'In progress' END AS status
FROM customer LEFT JOIN d ON o_custkey = c_custkey WHERE c_nationkey = 3""")
def history_list(t: Tables):
    """A user's conversations with their latest document and a status; four lateral look-ups become one aggregate."""
    latest = F.struct("o_orderdate", "o_orderkey")
    docs = t("orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("o_orderdate").alias("last_at"),
        F.max_by("o_orderkey", latest).alias("doc_id"),
        F.max_by("o_orderstatus", latest).alias("doc_status"),
        F.bool_or(F.col("o_orderstatus") == "P").alias("active"),
        F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate"))).alias("sent_at"),
    )
    active = F.coalesce("active", F.lit(False))
    status = F.when(F.col("sent_at").isNotNull(), "Sent").when(F.col("doc_id").isNotNull() & ~active, "Done").otherwise("In progress")
    mine = t("customer").where("c_nationkey = 3").select("c_custkey")
    return mine.join(docs, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("id"), F.coalesce("n", F.lit(0)).alias("messages"), "doc_id", "doc_status", "last_at", active.alias("active_run"), status.alias("status"))


@query("""WITH c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id FROM c WHERE EXISTS (SELECT 1 FROM conversations m WHERE m.conv_id = c.conv_id AND m.text ILIKE '%ation%')""")
def conversation_search(t: Tables):
    """Conversations with a message that holds the text, whatever its case."""
    rows = t("conversations")
    hits = rows.where(F.col("text").ilike("%ation%")).select("conv_id")
    return rows.select("conv_id").distinct().join(hits, "conv_id", "left_semi")


@query("""SELECT user_id AS run_id, event_id AS seq, event_type AS type FROM events WHERE event_type IN ('signup', 'error')
UNION ALL SELECT run_id, seq, type FROM (SELECT user_id AS run_id, event_id AS seq, event_type AS type, row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k')::BIGINT % 4 ORDER BY event_id DESC) AS r
    FROM events WHERE event_type = 'view') WHERE r = 1""")
def step_events(t: Tables):
    """Step events of every run, and of the many progress events only the last of each step."""
    e = t("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), (F.get_json_object("props", "$.k").cast("bigint") % 4).alias("step"))
    last = e.where("type = 'view'").groupBy("run_id", "step").agg(F.max_by(F.struct("seq", "type"), "seq").alias("x")).select("run_id", "x.seq", "x.type")
    return e.where(F.col("type").isin("signup", "error")).select("run_id", "seq", "type").unionByName(last)


@query("""WITH have AS (SELECT user_id, count(*) AS last_seq FROM events WHERE event_id % 2 = 0 GROUP BY user_id)
SELECT e.event_id, e.user_id, (coalesce(h.last_seq, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id))::BIGINT AS seq
FROM events e LEFT JOIN have h ON h.user_id = e.user_id WHERE e.event_id % 2 = 1""")
def sequence_numbers(t: Tables):
    """New log entries go on after the last number of their run."""
    e = t("events").select("event_id", "user_id", "ts")
    have = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("last_seq"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.where("event_id % 2 = 1").join(have, "user_id", "left").select("event_id", "user_id", (F.coalesce("last_seq", F.lit(0)) + place).cast("long").alias("seq"))


@query("""SELECT o_orderkey AS job_id, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)::BIGINT AS ahead FROM orders WHERE o_orderstatus = 'P'""")
def queue_positions(t: Tables):
    """Jobs ahead of each job: those of earlier days, summed over a row per day, and the day's own."""
    jobs = t("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("at"), F.to_date("o_orderdate").alias("day"))
    days = jobs.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    before = days.select("day", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    place = F.row_number().over(Window.partitionBy("day").orderBy("at", "job_id")) - 1
    return jobs.withColumn("place", place).join(before, "day").select("job_id", (F.col("earlier") + F.col("place")).cast("long").alias("ahead"))


@query("""SELECT o_orderpriority AS kind, count(*) FILTER (WHERE o_orderstatus = 'O') AS queued, count(*) FILTER (WHERE o_orderstatus = 'P') AS running, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed,
    min(o_orderdate) FILTER (WHERE o_orderstatus = 'O') AS oldest, arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus = 'O') AS next_job FROM orders GROUP BY 1""")
def queue_health(t: Tables):
    """Counts by state and the job that would be claimed next."""
    queued = F.col("o_orderstatus") == "O"
    return t("orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(
        F.count_if(queued).alias("queued"),
        F.count_if(F.col("o_orderstatus") == "P").alias("running"),
        F.count_if(F.col("o_orderstatus") == "F").alias("failed"),
        F.min(F.when(queued, F.col("o_orderdate"))).alias("oldest"),
        F.min_by(F.when(queued, F.col("o_orderkey")), F.when(queued, F.struct("o_orderdate", "o_orderkey"))).alias("next_job"),
    )


@query("""WITH l AS (SELECT l_orderkey, max(l_shipdate) AS locked_at FROM lineitem GROUP BY 1)
SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'P' AND locked_at < o_orderdate + INTERVAL 30 DAY THEN 'queued' ELSE o_orderstatus END AS state,
    o_orderdate + to_seconds(5 * 2 ** (o_orderkey % 3)) AS run_after FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def stale_requeue(t: Tables):
    """Jobs whose lock is too old are queued again; retries wait 5 * 2^n seconds."""
    lock = t("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("locked_at"))
    stale = (F.col("o_orderstatus") == "P") & (F.col("locked_at") < F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    wait = F.expr("make_dt_interval(0, 0, 0, 5 * shiftleft(1, CAST(o_orderkey % 3 AS INT)))")
    return t("orders").join(lock, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("job_id"), F.when(stale, "queued").otherwise(F.col("o_orderstatus")).alias("state"), (F.col("o_orderdate") + wait).alias("run_after"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT unnest([c_custkey, c_custkey + 1]) FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def referenced_rows(t: Tables):
    """Rows that any of the arrays refers to."""
    refs = t("customer").where("c_mktsegment = 'MACHINERY'").select(F.explode(F.array(F.col("c_custkey"), F.col("c_custkey") + 1)).alias("r"))
    return t("orders").join(refs, F.col("o_custkey") == F.col("r"), "left_semi").select("o_orderkey", "o_custkey")


@query("""WITH x AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS s FROM documents), h AS (SELECT doc_id, s, left(s, 60) AS h FROM x),
p AS (SELECT *, 60 - strpos(reverse(h), ' ') AS cut FROM h)
SELECT doc_id, CASE WHEN length(s) <= 60 THEN s WHEN strpos(reverse(h), ' ') > 0 AND cut > 30 THEN left(h, cut::BIGINT) || '…' ELSE h || '…' END AS title FROM p""")
def titles(t: Tables):
    """A title of at most 60 characters, cut at the last space beyond the 30th."""
    rows = t("documents").select("doc_id", F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " ")).alias("s")).withColumn("h", F.substring("s", 1, 60))
    back = F.instr(F.reverse("h"), F.lit(" "))
    at = 60 - back
    return rows.select("doc_id", F.when(F.length("s") <= 60, F.col("s")).when((back > 0) & (at > 30), F.concat(F.substring("h", F.lit(1), at), F.lit("…"))).otherwise(F.concat("h", F.lit("…"))).alias("title"))


@query("""SELECT event_id AS seq, user_id AS run_id, event_type AS type FROM events WHERE user_id = 8 AND event_id > 500 ORDER BY event_id LIMIT 500""")
def event_replay(t: Tables):
    """Entries of a run after the last one seen, in order, at most a batch."""
    return t("events").where("user_id = 8 AND event_id > 500").orderBy("event_id").limit(500).select(F.col("event_id").alias("seq"), F.col("user_id").alias("run_id"), F.col("event_type").alias("type"))


class Deltas(Machine):
    """Number of the flush that each entry belongs to. States are (flush, held characters, time of the first held).

    Text is held until ``size`` characters or ``wait`` seconds since the first
    held one are reached, and goes out before any other entry.

    What was held before some rows goes out with the first of them that fills or
    outlasts it, or is no text; from there on everything begins anew. A summary
    holds these rows, which are at most as many as fill an empty buffer, and
    where each beginning leads.
    """

    start = (0, 0, None)

    def __init__(self, size: int = 48, wait: float = 0.12) -> None:
        self.size, self.wait = size, wait

    def step(self, state: tuple, length: int, at: float, is_text: bool) -> tuple[tuple, tuple[int]]:
        flush, held, since = state
        if not is_text:
            flush += held > 0
            return (flush + 1, 0, None), (flush,)
        since = at if since is None else since
        held += length
        if held >= self.size or at - since >= self.wait:
            return (flush + 1, 0, None), (flush,)
        return (flush, held, since), (flush,)

    def summary(self) -> tuple:
        return self.start, 0, True, []

    def extend(self, summary: tuple, length: int, at: float, is_text: bool) -> tuple:
        fresh, filled, going, ends = summary
        ends = [(c, t, text, self.step(led, length, at, is_text)[0]) for c, t, text, led in ends]
        if going:
            filled += length if is_text else 0
            ends.append((filled, at, is_text, self.start))
            going = is_text and filled < self.size
        return self.step(fresh, length, at, is_text)[0], filled, going, ends

    def apply(self, summary: tuple, state: tuple) -> tuple:
        (more, *rest), filled, _, ends = summary
        flush, held, since = state
        if held == 0:
            return flush + more, *rest
        for c, t, text, (later, *left) in ends:
            if not text or held + c >= self.size or t - since >= self.wait:
                return flush + later + (1 if text else 2), *left
        return flush, held + filled, since


@query("""WITH RECURSIVE e AS (SELECT conv_id, turn, coalesce(length(text), 0) % 40 + 1 AS n, turn * 0.05::DOUBLE AS tm, role IS DISTINCT FROM 'system' AS is_text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations),
s AS (SELECT conv_id, turn, k, CASE WHEN is_text THEN 0 ELSE 0 END AS flush, CASE WHEN NOT is_text OR n >= 48 THEN 1 ELSE 0 END AS next, CASE WHEN is_text AND n < 48 THEN n ELSE 0 END AS held, CASE WHEN is_text AND n < 48 THEN tm END AS since FROM e WHERE k = 1
    UNION ALL SELECT e.conv_id, e.turn, e.k, CASE WHEN is_text THEN s.next ELSE s.next + (s.held > 0)::INTEGER END,
        CASE WHEN NOT is_text THEN s.next + (s.held > 0)::INTEGER + 1 WHEN s.held + n >= 48 OR tm - coalesce(since, tm) >= 0.12 THEN s.next + 1 ELSE s.next END,
        CASE WHEN NOT is_text OR s.held + n >= 48 OR tm - coalesce(since, tm) >= 0.12 THEN 0 ELSE s.held + n END, CASE WHEN NOT is_text OR s.held + n >= 48 OR tm - coalesce(since, tm) >= 0.12 THEN NULL ELSE coalesce(since, tm) END
        FROM s JOIN e ON e.conv_id = s.conv_id AND e.k = s.k + 1)
SELECT conv_id, turn, flush::INTEGER AS flush FROM s""")
def delta_flushes(t: Tables):
    """Flushes of the text deltas of each conversation; a very long one has many tasks."""
    rows = t("conversations").select("conv_id", "turn", "text", (F.coalesce(F.length("text"), F.lit(0)) % 40 + 1).alias("n"), (F.col("turn") * F.lit(0.05)).alias("at"), (~F.col("role").eqNullSafe(F.lit("system"))).alias("is_text"))
    return composed_fold(rows, "conv_id", ["turn", "text"], Deltas, ["conv_id", "turn", "text"], "conv_id long, turn long, text string, flush int").drop("text")


class Bucket(Numeric):
    """Whether a token bucket lets each request pass; times in microseconds, a token takes ``token`` of them.

    The state is the held amount less the time, so it only changes when a
    request passes, or where the bucket is full.
    """

    start = FAR

    def __init__(self, capacity: int = 3, token: int = 20_000_000_000) -> None:
        self.full, self.token = capacity * token, token

    def effect(self, at: int) -> Pieces:
        return [(self.token - at, 1, 0), (self.full - at, 1, -self.token), (2 * FAR, 0, self.full - self.token - at)]

    def step(self, state: int, at: int) -> tuple[int, tuple[bool]]:
        return called(self.effect(at), state), (state + at >= self.token,)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT user_id, event_id, k, tm, true AS passed, 2.0::DOUBLE AS tokens FROM e WHERE k = 1
    UNION ALL SELECT e.user_id, e.event_id, e.k, e.tm, least(3.0, s.tokens + (e.tm - s.tm) * (1.0::DOUBLE / 20000)) >= 1, least(3.0, s.tokens + (e.tm - s.tm) * (1.0::DOUBLE / 20000)) - (least(3.0, s.tokens + (e.tm - s.tm) * (1.0::DOUBLE / 20000)) >= 1)::INTEGER
        FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id, event_id, passed FROM s""")
def rate_limits(t: Tables):
    """Token bucket for each user over the ordered requests; a busy user has many tasks."""
    rows = t("events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return composed_fold(rows, "user_id", ["at", "event_id"], Bucket, ["user_id", "event_id"], "user_id long, event_id long, passed boolean")


class Card(Machine):
    """State of a card after each action, and what became of the action.

    A card is open from its first action's time (``begun``) on; a decision counts
    once, may be undone within ``undo`` seconds, and nothing counts after
    ``expiry``. States are (name, time of the decision).

    Of a decision made before some rows, only the first undo among them matters:
    if that comes too late, so do the others. A summary hence holds where an open
    card leads, that undo's time, and where the card leads that it reopened.
    """

    start = ("open", None)

    def __init__(self, undo: float = 10, expiry: float = 1800) -> None:
        self.undo, self.expiry = undo, expiry

    def step(self, state: tuple, at: float, action: str, begun: float) -> tuple[tuple, tuple[str, str]]:
        name, decided = state
        if name == "open" and at - begun > self.expiry:
            name = "expired"
        if action == "undo" and decided is not None and at - decided <= self.undo:
            return self.start, ("open", "undone")
        if action != "undo" and name == "open":
            return (action, at), (action, "applied")
        return (name, decided), (name, "ignored")

    def summary(self) -> tuple:
        return self.start, None, None

    def extend(self, summary: tuple, at: float, action: str, begun: float) -> tuple:
        led, first_undo, undone = summary
        if first_undo is not None:
            undone = self.step(undone, at, action, begun)[0]
        elif action == "undo":
            first_undo, undone = at, self.start
        return self.step(led, at, action, begun)[0], first_undo, undone

    def apply(self, summary: tuple, state: tuple) -> tuple:
        led, first_undo, undone = summary
        if state[0] == "open":
            return led
        if state[1] is not None and first_undo is not None and first_undo - state[1] <= self.undo:
            return undone
        return state


@query("""WITH RECURSIVE e AS (SELECT user_id * 100 + day(ts) AS card_id, event_id, epoch_us(ts) / 1e6 AS tm, CASE WHEN event_type = 'error' THEN 'undo' WHEN event_type IN ('view', 'click') THEN 'allowed' ELSE 'denied' END AS action FROM events),
n AS (SELECT *, row_number() OVER w AS k, first_value(tm) OVER w AS start FROM e WINDOW w AS (PARTITION BY card_id ORDER BY tm, event_id)),
s AS (SELECT card_id, event_id, k, CASE WHEN action = 'undo' THEN 'open' ELSE action END AS state, CASE WHEN action <> 'undo' THEN tm END AS decided, CASE WHEN action = 'undo' THEN 'ignored' ELSE 'applied' END AS effect FROM n WHERE k = 1
    UNION ALL SELECT card_id, event_id, k, CASE WHEN action = 'undo' THEN CASE WHEN was IN ('allowed', 'denied') AND tm - decided <= 10 THEN 'open' ELSE was END WHEN was = 'open' THEN action ELSE was END,
        CASE WHEN action = 'undo' THEN CASE WHEN was IN ('allowed', 'denied') AND tm - decided <= 10 THEN NULL ELSE decided END WHEN was = 'open' THEN tm ELSE decided END,
        CASE WHEN action = 'undo' THEN CASE WHEN was IN ('allowed', 'denied') AND tm - decided <= 10 THEN 'undone' ELSE 'ignored' END WHEN was = 'open' THEN 'applied' ELSE 'ignored' END
        FROM (SELECT n.card_id, n.event_id, n.k, n.tm, n.action, s.decided, CASE WHEN s.state = 'open' AND n.tm - n.start > 1800 THEN 'expired' ELSE s.state END AS was FROM s JOIN n ON n.card_id = s.card_id AND n.k = s.k + 1))
SELECT card_id, event_id, state, effect FROM s""")
def card_decisions(t: Tables):
    """Decisions on cards: a fold over the ordered actions of each card; a card with very many has many tasks."""
    action = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type").isin("view", "click"), "allowed").otherwise("denied")
    rows = t("events").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("card_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), action.alias("action"))
    begun = rows.groupBy(F.col("card_id").alias("of")).agg(F.min("at").alias("begun"))
    timed = rows.join(begun, F.col("card_id") == F.col("of")).drop("of")
    return composed_fold(timed, "card_id", ["at", "event_id"], Card, ["card_id", "event_id"], "card_id long, event_id long, state string, effect string")


class Queue(Numeric):
    """Whether a job is taken: one with its key that is queued or running holds it off until it is done. The state is when the key frees.

    With ``longest``, the longest that a job of any row lasts, a summary passes
    over states that no row before its first can lead to.
    """

    start = -FAR

    def __init__(self, longest: int | None = None) -> None:
        self.longest = longest

    def effect(self, at: int, lasts: int) -> Pieces:
        return [(at + 1, 0, at + lasts), (2 * FAR, 1, 0)]

    def step(self, state: int, at: int, lasts: int) -> tuple[int, tuple[bool]]:
        return (at + lasts, (True,)) if state <= at else (state, (False,))

    def extend_all(self, summary: Pieces, rows: list[list]) -> Pieces:
        if self.longest is not None and rows and summary == self.summary():
            summary = [(rows[0][0] + max(self.longest, 0) + 1, 1, 0), (2 * FAR, 0, self.start)]
        return super().extend_all(summary, rows)


@query("""WITH RECURSIVE e AS (SELECT user_id % 50 AS key, event_id, epoch_us(ts) / 1e6 AS tm, value * 600 AS lasts, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT key, event_id, k, true AS taken, tm + lasts AS free FROM e WHERE k = 1
    UNION ALL SELECT e.key, e.event_id, e.k, e.tm >= s.free, CASE WHEN e.tm >= s.free THEN e.tm + e.lasts ELSE s.free END FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1)
SELECT key, event_id, taken FROM s""")
def enqueued_jobs(t: Tables):
    """One queued or running job for each key; a key frees when its job is done. Few keys have many tasks all the same."""
    rows = t("events").select((F.col("user_id") % 50).alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.round(F.col("value") * 600_000_000).cast("long").alias("lasts"))
    # one number
    longest = rows.agg(F.max("lasts").alias("longest")).first()["longest"]
    return composed_fold(rows, "key", ["at", "event_id"], lambda: Queue(longest), ["key", "event_id"], "key long, event_id long, taken boolean")


@query("""WITH e AS (SELECT event_id, user_id AS run_id, json_extract_string(props, '$.k')::BIGINT AS seq FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY run_id, seq ORDER BY event_id) AS k FROM e),
m AS (SELECT run_id, max(seq) AS last FROM e GROUP BY 1)
SELECT event_id, r.run_id, seq FROM r WHERE k = 1 UNION ALL SELECT event_id, r.run_id, last + row_number() OVER (PARTITION BY r.run_id ORDER BY event_id) FROM r JOIN m ON m.run_id = r.run_id WHERE k > 1""")
def renumbered_log(t: Tables):
    """Log entries whose number is taken in their run, late or sent twice, go on after its last number."""
    e = t("events").select("event_id", F.col("user_id").alias("run_id"), F.get_json_object("props", "$.k").cast("bigint").alias("seq"))
    r = e.withColumn("k", F.row_number().over(Window.partitionBy("run_id", "seq").orderBy("event_id")))
    last = e.groupBy("run_id").agg(F.max("seq").alias("last"))
    late = r.where("k > 1").join(last, "run_id").withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("event_id")))
    return r.where("k = 1").select("event_id", "run_id", "seq").unionByName(late.select("event_id", "run_id", (F.col("last") + F.col("place")).alias("seq")))


@query("""WITH j AS (SELECT o_orderkey AS job_id, o_orderdate AS tm, o_orderkey % 4 AS failures FROM orders), a AS (SELECT job_id, tm, failures, unnest(range(1, least(failures + 1, 3) + 1)) AS attempt FROM j)
SELECT job_id, attempt::INTEGER AS attempt, tm + to_seconds(5 * (2 ** (attempt - 1) - 1)) AS started, CASE WHEN attempt <= failures AND attempt < 3 THEN 'retried' WHEN attempt <= failures THEN 'failed' ELSE 'done' END AS result FROM a""")
def job_attempts(t: Tables):
    """Attempts of jobs: a failed one is retried after 5 * 2^(n-1) seconds, three times at most."""
    j = t("orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("at"), (F.col("o_orderkey") % 4).cast("int").alias("failures"))
    a = j.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.least(F.col("failures") + 1, F.lit(3)))))
    wait = F.expr("make_dt_interval(0, 0, 0, 5 * (shiftleft(1, attempt - 1) - 1))")
    failed = F.col("attempt") <= F.col("failures")
    return a.select("job_id", "attempt", (F.col("at") + wait).alias("started"), F.when(failed & (F.col("attempt") < 3), "retried").when(failed, "failed").otherwise("done").alias("result"))


@query("""WITH r AS (SELECT event_id, user_id, ts, props, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS k FROM events)
SELECT event_id, user_id FROM r WHERE k = 1""")
def deduplicated_enqueue(t: Tables):
    """One job for each key and hour: the first stays."""
    rows = t("events").select("event_id", "user_id", "ts", F.date_trunc("hour", "ts").alias("hour"))
    return first_of(rows, ["user_id", "hour"], F.col("ts"), F.col("event_id")).select("event_id", "user_id")
