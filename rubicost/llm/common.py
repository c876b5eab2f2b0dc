"""Helpers that the training-data operators share.

Words are runs of characters other than the six ASCII white-space characters.
Hashes are 64-bit and computed with NumPy inside tasks; no helper here moves
data through the driver.
"""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; none for null. ``bytes.split`` parts at those six characters."""
    return text.encode().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BASE = U64(0xD6E8FEB86659FD93)  # odd, so that it has an inverse modulo 2**64
BASE_INVERSE = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
BYTE_VALUES = mix64(np.arange(1, 257, dtype=U64) * GOLDEN)
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


class Powers:
    """Powers of a base modulo 2**64, as many as were needed so far."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.held = base, np.ones(1, dtype=U64)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.held):
            grown = np.full(max(n, 4096), self.base, dtype=U64)
            grown[0] = 1
            self.held = np.cumprod(grown, dtype=U64)
        return self.held[:n]


UP, DOWN = Powers(BASE), Powers(BASE_INVERSE)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text: a polynomial over its bytes, cut at the words, then scrambled."""
    raw = np.frombuffer(text.encode() if text else b"", dtype=np.uint8)
    inside = ~SPACES[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=U64)
    sums = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(BYTE_VALUES[raw] * UP(len(raw)), out=sums[1:])
    return mix64((sums[end] - sums[start]) * DOWN(len(raw))[start] + (end - start).astype(U64))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of each run of ``width`` hashes, modulo 2**64."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    sums = np.zeros(len(hashes) + 1, dtype=U64)
    np.cumsum(hashes * UP(len(hashes)), out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * DOWN(n))


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's bigint."""
    return x.astype(U64).view(np.int64)


def plain(column: pa.Array) -> list:
    """The column as Python values; lists of whole numbers without nulls by way of NumPy, which is much faster."""
    if not pa.types.is_list(column.type) or not pa.types.is_integer(column.type.value_type):
        return column.to_pylist()
    values = column.flatten()
    if values.null_count:
        return column.to_pylist()
    flat = values.to_numpy().tolist()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    ends = np.cumsum(sizes).tolist()
    out = [flat[b - n : b] for b, n in zip(ends, sizes.tolist(), strict=True)]
    return out if not column.null_count else [x if ok else None for x, ok in zip(out, column.is_valid().to_pylist(), strict=True)]


def slices(batch: pa.RecordBatch, rows: int, volume: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of at most ``rows`` rows; halved while they hold more than ``volume`` bytes."""
    todo = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
    while todo:
        part = todo.pop()
        if part.num_rows > 1 and part.nbytes > volume:
            half = part.num_rows // 2
            todo += [part.slice(half), part.slice(0, half)]
        else:
            yield part


def map_slices(
    df: DataFrame,
    fn: Callable[[], Callable[[dict[str, list]], dict[str, Iterable]]],
    schema: str,
    rows: int = 256,
    volume: int = 4 << 20,
) -> DataFrame:
    """Maps a frame by slices of few rows, so that memory stays bounded.

    ``fn()`` is called once for each task and returns a function from columns
    (name to list) to output columns (lists or Arrow arrays). A slice has at most ``rows`` rows and
    about ``volume`` bytes, or a single row that is larger.
    """
    target = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(target)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for batch in batches:
            for part in slices(batch, rows, volume):
                out = work({n: plain(part.column(i)) for i, n in enumerate(part.schema.names)})
                made = [x if isinstance(x := out[f.name], pa.Array) else pa.array(x, type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(made, schema=arrow)
        pa.default_memory_pool().release_unused()  # workers live on

    return df.mapInArrow(task, schema)


def keep_slices(df: DataFrame, column: str, fn: Callable[[], Callable[[list], list[bool]]], rows: int = 256, volume: int = 4 << 20) -> DataFrame:
    """The rows that ``fn()`` says true for, by the values of one column; all columns pass through, whatever their names."""
    at = df.columns.index(column)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for batch in batches:
            for part in slices(batch, rows, volume):
                yield part.filter(pa.array(work(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(task, df.schema)


def whole_row(df: DataFrame) -> Column:
    """A hash of all columns of a row that have one (maps have none); orders rows that are alike otherwise."""
    return F.xxhash64(*[F.col(f"`{f.name.replace('`', '``')}`") for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; a local one only for ``local`` masters where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return root or "/tmp/checkpoints/rubicost"


#: folders of saved frames that ``discard`` may delete
FOLDERS: WeakKeyDictionary = WeakKeyDictionary()


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the frame is computed once, written to the shared checkpoint folder and read from there.

    Executors that are lost later cost nothing that was computed before. The
    files stay for lazy results that read them; ``discard`` deletes those that
    nothing reads any more.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/rubicost-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    FOLDERS[out] = path
    return out


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that no frame refers to any more; it does so when the driver collects its garbage.

    Spark's listeners hold the last query until another one ends, hence the empty one.
    """
    gc.collect()
    spark.createDataFrame([], "x int").collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes the files of a frame that ``saved`` returned and that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(FOLDERS.pop(df))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ddl(df: DataFrame) -> str:
    """The columns of a frame as a schema string, whatever their names."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def text_key(text: str = "text"):
    """A 64-bit key of a text column; tells rows with one id and different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


SIEVE_BITS = 1 << 22


def sieve(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose id may be among ``ids`` (one bigint column): none of those is lost, most others are.

    A bit map of fixed size (512 KB) goes to the tasks, so wide rows that an exact
    join would drop need not be shuffled for it. The exact join has to follow.
    """
    spark = df.sparkSession
    (name,) = ids.columns
    at = F.pmod(F.xxhash64(name), F.lit(SIEVE_BITS))
    words = ids.select(F.shiftright(at, 5).alias("w"), F.pmod(at, F.lit(32)).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    bitmap = np.zeros(SIEVE_BITS >> 5, dtype=np.uint32)
    found = words.toPandas()  # at most SIEVE_BITS / 32 rows
    bitmap[found["w"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    shared = spark.sparkContext.broadcast(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    @F.pandas_udf("boolean")
    def may(place: pd.Series) -> pd.Series:
        return pd.Series(shared.value[place.to_numpy()].astype(bool))

    return df.where(F.col(column).isNotNull()).where(may(F.pmod(F.xxhash64(column), F.lit(SIEVE_BITS))))
