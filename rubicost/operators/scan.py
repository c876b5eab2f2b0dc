"""Scans of ordered rows in which no key, however hot, has to go through one task.

``composed_fold`` gives what ``fold.ordered_fold`` gives, for folds whose effect
on an unknown state can be written down: rows are placed by range of (key,
order), so a hot key covers many partitions. Only a partition's first key may
have begun before it. For that key the effects of its rows are composed into one
function from state to state; the other keys are folded at once. One function or
final state for each partition goes through the driver, which applies them in
order; then the rows of first keys are replayed from their start state.

``ranks`` and ``running_totals`` number and sum all rows of a frame in order: by
range partitions, a count or sum for each, and offsets. ``carried`` takes the
last value along within keys, in pieces of a numeric order.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rubicost.sources.files import stored

FAR = 1 << 62


class Machine:
    """A fold with a composable effect: ``step`` runs a row, ``extend`` adds a row to a summary, ``apply`` runs a summary."""

    start = None

    def step(self, state, *values) -> tuple:
        """The next state and the row's outputs."""
        raise NotImplementedError

    def summary(self):
        """The summary of no rows."""
        raise NotImplementedError

    def extend(self, summary, *values):
        raise NotImplementedError

    def extend_all(self, summary, rows: list[list]):
        """The summary with many rows more, in order."""
        for values in rows:
            summary = self.extend(summary, *values)
        return summary

    def apply(self, summary, state):
        raise NotImplementedError


class Finite(Machine):
    """A machine of few states: ``move(state, *values)`` gives the next state and the outputs. A summary is where each state leads."""

    def __init__(self, states: list, move: Callable[..., tuple]) -> None:
        self.states, self.step, self.start = states, move, states[0]

    def summary(self) -> dict:
        return {s: s for s in self.states}

    def extend(self, summary: dict, *values) -> dict:
        led = {s: self.step(s, *values)[0] for s in set(summary.values())}
        return {s: led[at] for s, at in summary.items()}

    def apply(self, summary: dict, state):
        return summary[state]


#: pieces (below, slope, value) of a function from whole numbers to whole numbers: slope * x + value for x < below, in order
Pieces = list[tuple[int, int, int]]


def composed(f: Pieces, g: Pieces) -> Pieces:
    """What f and then g do to a number; neighbours that agree are one piece."""
    out: Pieces = []

    def add(below: int, slope: int, value: int) -> None:
        if out and out[-1][1:] == (slope, value):
            out.pop()
        out.append((below, slope, value))

    low = -2 * FAR
    ends = [below for below, _, _ in g]
    for below, slope, value in f:
        if slope:
            for g_below, g_slope, g_value in islice(g, bisect_right(ends, low + value), None):
                end = min(below, g_below - value)
                if end > low:
                    add(end, g_slope, g_slope * value + g_value)
                    low = end
                if end == below:
                    break
        else:
            _, g_slope, g_value = g[bisect_right(ends, value)]
            add(below, 0, g_slope * value + g_value)
        low = below
    return out


def called(f: Pieces, x: int) -> int:
    slope, value = next((slope, value) for below, slope, value in f if x < below)
    return slope * x + value


class Numeric(Machine):
    """A machine whose state is a whole number that a row keeps, shifts or sets, by ranges of it: ``effect`` returns Pieces."""

    def effect(self, *values) -> Pieces:
        raise NotImplementedError

    def summary(self) -> Pieces:
        return [(2 * FAR, 1, 0)]

    def extend(self, summary: Pieces, *values) -> Pieces:
        return composed(summary, self.effect(*values))

    def extend_all(self, summary: Pieces, rows: list[list]) -> Pieces:
        """Effects are composed in pairs, so many rows whose pieces differ for long cost n log(n)^2, not n times the pieces."""
        effects = [self.effect(*values) for values in rows]
        while len(effects) > 1:
            effects = [composed(*effects[i : i + 2]) if i + 1 < len(effects) else effects[i] for i in range(0, len(effects), 2)]
        return composed(summary, effects[0]) if effects else summary

    def apply(self, summary: Pieces, state: int) -> int:
        return called(summary, state)


def composed_fold(df: DataFrame, key: str, order: list[str], machine: Callable[[], Machine], keep: list[str], schema: str, parts: int | None = None) -> DataFrame:
    """For each row the columns ``keep`` and the outputs of the machine, as ``ordered_fold`` gives them.

    Rows of a key that are equal in ``order`` lie in one partition, so an order
    that tells rows apart splits best. A null key is a key of its own.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    target = T._parse_datatype_string(schema)
    given = [c for c in df.columns if c != key and c not in keep]
    made = target.fields[len(keep) :]
    # placed names, so that no column of the frame can clash
    named = {"k": [key], "g": given, "c": keep}
    columns = [F.col(f"`{c}`").alias(f"{kind}{i}") for kind, cs in named.items() for i, c in enumerate(cs)]
    places = [F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)]
    by = ["k0", *[f"o{i}" for i in range(len(order))]]
    rows = df.select(*columns, *places).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop(*by[1:])
    inner = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("pos", T.LongType()), T.StructField("pending", T.BooleanType()), *[T.StructField(f.name, f.dataType) for f in rows.schema.fields], *[T.StructField(f"m{i}", f.dataType) for i, f in enumerate(made)], T.StructField("info", T.BinaryType())])
    arrow = to_arrow_schema(inner)
    n_given, n_keep, n_made = len(given), len(keep), len(made)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, piece, pos = machine(), TaskContext.get().partitionId(), 0
        first = last = state = summary = None
        seen, single = False, True
        nothing = (None,) * n_made
        for batch in batches:
            lists = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            pending, outputs, begun = [], [], []
            for i, k in enumerate(lists[0]):
                if not seen:
                    seen, first, last, summary = True, k, k, m.summary()
                elif k != last:
                    last, single, state = k, False, m.start
                values = [x[i] for x in lists[1 : 1 + n_given]]
                if single:
                    begun.append(values)
                    outputs.append(nothing)
                else:
                    state, out = m.step(state, *values)
                    outputs.append(out)
                pending.append(single)
            if begun:
                summary = m.extend_all(summary, begun)
            n = batch.num_rows
            new = list(zip(*outputs, strict=True)) or [[]] * n_made
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip([[piece] * n, range(pos, pos + n), pending, *lists, *new, [None] * n], arrow, strict=True)], schema=arrow)
            pos += n
        if seen:
            info = pickle.dumps((first, last, single, summary, state))
            yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip([piece, pos, False, *[None] * (len(arrow) - 4), info], arrow, strict=True)], schema=arrow)

    done = stored(rows.mapInArrow(first_pass, inner))
    # one row for each partition
    infos = sorted((r["piece"], pickle.loads(r["info"])) for r in done.where("info IS NOT NULL").select("piece", "info").collect())
    begun, m, before = {}, machine(), None
    for piece, (first, last, single, summary, state) in infos:
        begun[piece] = before[1] if before is not None and before[0] == first else m.start
        before = (last, m.apply(summary, begun[piece]) if single else state)
    starts = spark.sparkContext.broadcast(begun)

    out_schema = to_arrow_schema(target)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, piece, state = machine(), None, None
        for batch in batches:
            lists = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            outputs = []
            for at, *values in zip(lists[0], *lists[2 : 2 + n_given], strict=True):
                if at != piece:
                    piece, state = at, starts.value[at]
                state, out = m.step(state, *values)
                outputs.append(out)
            new = list(zip(*outputs, strict=True)) or [[]] * n_made
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip([*lists[2 + n_given :], *new], out_schema, strict=True)], schema=out_schema)

    names = [f.name for f in target.fields]
    kept = [f"c{i}" for i in range(n_keep)]
    waiting = done.where("pending").select("piece", "pos", *[f"g{i}" for i in range(n_given)], *kept)
    replayed = waiting.repartitionByRange(parts, "piece").sortWithinPartitions("piece", "pos").mapInArrow(replay, schema)
    ready = done.where("NOT pending AND info IS NULL").select(*[F.col(c).cast(f.dataType).alias(f.name) for c, f in zip([*kept, *[f"m{i}" for i in range(n_made)]], target.fields, strict=True)])
    return ready.unionByName(replayed.toDF(*names))


def numbered(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """The frame placed by range of ``order``, with ``_piece`` and, within it, ``_pos`` from 0; written once."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # the partition's number in the high bits, the row's in the lower 33
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", at)
    return stored(placed.select(*df.columns, F.shiftright("_at", 33).cast("int").alias("_piece"), (F.col("_at") % (1 << 33)).alias("_pos")))


def ranks(df: DataFrame, order: list[Column], out: str = "rank", parts: int | None = None) -> DataFrame:
    """The frame with each row's place in the order of all, from 1; equal rows get places of their own."""
    placed = numbered(df, order, parts)
    counts = placed.groupBy(F.col("_piece").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", before)  # one row for each partition
    return placed.join(F.broadcast(offsets), F.col("_piece") == F.col("_of")).select(*df.columns, (F.col("_before") + F.col("_pos") + 1).alias(out))


def running_totals(df: DataFrame, order: list[Column], amount: str, out: str, parts: int | None = None) -> DataFrame:
    """The frame with the sum of ``amount`` over all rows up to each in the order of all."""
    placed = numbered(df, order, parts)
    sums = placed.groupBy(F.col("_piece").alias("_of")).agg(F.sum(amount).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumn("_before", before)  # one row for each partition
    own = F.sum(amount).over(Window.partitionBy("_piece").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_own", own).join(F.broadcast(offsets), F.col("_piece") == F.col("_of")).select(*df.columns, (F.col("_before") + F.col("_own")).alias(out))


#: places of a piece
WIDTH = 4096


def pieces(df: DataFrame, at: str, width: int = WIDTH) -> DataFrame:
    """The frame with ``_b``, the number of the piece of ``width`` places that a row is in."""
    return df.withColumn("_b", F.floor(F.col(at) / width))


def carried(df: DataFrame, keys: list[str], at: str, values: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """The frame with, for each name, the last value that isn't null at or above a row of its key; null if there is none.

    ``at`` is a whole number that tells the rows of a key apart. Pieces of
    ``width`` places are scanned by themselves; what a piece ends with is carried
    on over pieces, of which a key has few. A frame that ``pieces`` has numbered
    keeps its pieces, so calls one after the other place its rows once.
    """
    cut = df if "_b" in df.columns else pieces(df, at, width)
    for name, value in values.items():
        cut = cut.withColumn(f"_v_{name}", value)
    within = Window.partitionBy(*keys, "_b").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    ends = cut.groupBy(*keys, "_b").agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(at))).alias(f"_e_{n}") for n in values])
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*keys, "_b", *[F.last(f"_e_{n}", ignorenulls=True).over(over).alias(f"_p_{n}") for n in values])
    # only pieces behind a key's first have something before them; written, so that the join knows how few they are
    some = before.where(F.coalesce(*[F.when(F.col(f"_p_{n}").isNotNull(), F.lit(True)) for n in values], F.lit(False)))
    before = stored(some.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_kb"), *[f"_p_{n}" for n in values]))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_b") == F.col("_kb")]
    own = cut.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(within).alias(f"_o_{n}") for n in values])
    return own.join(before, same, "left").select(*df.columns, *[F.coalesce(f"_o_{n}", f"_p_{n}").alias(n) for n in values])
