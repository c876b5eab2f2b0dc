"""Folds over ordered rows of a key, streamed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def ordered_fold(df: DataFrame, key: str, order: list[str], steps: Callable[[], Callable[..., tuple]], keep: list[str], schema: str) -> DataFrame:
    """For each row the columns ``keep`` and what a step function returns for it.

    ``steps()`` makes a step function that holds the state of one key; it gets
    the values of the other columns, row by row in order. Rows of a key stream
    through one task in order: only the state is held, never the key's rows. A
    null key is a key of its own. ``schema`` names the kept and the new columns.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    given = [c for c in df.columns if c != key and c not in keep]
    rows = df.select(key, *[c for c in keep if c != key], *given)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, step = object(), None
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            made = []
            for k, *values in zip(cols[key], *(cols[c] for c in given), strict=True):
                if step is None or k != held:
                    held, step = k, steps()
                made.append(step(*values))
            new = list(zip(*made, strict=True)) or [[]] * (len(arrow) - len(keep))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip([*(cols[c] for c in keep), *new], arrow, strict=True)], schema=arrow)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(task, schema)
