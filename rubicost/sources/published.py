"""A table that is replaced by file as one transaction: a Python data source writes layers, a manifest publishes them.

A write makes a layer: the rows of some files, and for each of its files a key
row, with the reason where the file could not be read. Tasks write both as
Parquet below ``data``; on commit the driver publishes ``manifest/<n>.json``, which lists
the layers that count, in one step that fails if another writer was faster. A
reader follows the last manifest: of each file the rows of the latest layer that
has its key. A write that dies leaves no manifest, so the version before stays
readable, whole. ``compacted`` makes one layer of all.

Layers are few, so the manifest is small, however many files and rows they hold.

Rows with a ``fail_reason`` (if the frame has that column) are no data: they
say that a file was tried in vain. Its old rows go, and the reason is kept until
the file is read again, so nobody tries it anew for nothing.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

REASON = "fail_reason"
FORMAT = "replaced_by_file"


class Conflict(RuntimeError):
    """Another writer published first; nothing of this write counts."""


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: the paths of its rows and keys below the table's folder, and whether it has any."""

    data: str | None
    keys: str | None


class Folder:
    """The table's folder, in any file system that Arrow knows."""

    def __init__(self, path: str) -> None:
        # Spark writes file:/x where Arrow reads file:///x
        uri = re.sub(r"^file:/+", "file:///", path)
        self.fs, self.root = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def versions(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(self.at("manifest"), allow_not_found=True))
        return sorted(int(m.group(1)) for x in found if (m := re.fullmatch(r"(\d+)\.json", x.base_name)))

    def manifest(self, version: int) -> dict:
        with self.fs.open_input_stream(self.at(f"manifest/{version}.json")) as f:
            return json.loads(f.read())

    def publish(self, version: int, manifest: dict) -> None:
        """Makes a manifest visible whole, or fails if that version is there."""
        self.fs.create_dir(self.at("manifest"))
        final, draft = self.at(f"manifest/{version}.json"), self.at(f"manifest/.{uuid.uuid4().hex}")
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(manifest).encode())
        try:
            if isinstance(self.fs, pafs.LocalFileSystem):
                os.link(draft, final)  # fails where a rename would overwrite
                os.unlink(draft)
            elif self.fs.get_file_info(final).type != pafs.FileType.NotFound:
                raise FileExistsError(final)
            else:
                self.fs.move(draft, final)
        except FileExistsError as e:
            self.fs.delete_file(draft)
            raise Conflict(final) from e


class Layers(DataSource):
    """The sink. Options: path, key (file_id if not given), alone (true: the new layer replaces all others)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: T.StructType, overwrite: bool) -> LayerWriter:
        return LayerWriter(dict(self.options), schema, overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> StreamedLayers:
        return StreamedLayers(dict(self.options), schema, overwrite)


class Tasks:
    """Writing of a task's rows and keys, commit and abort."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool) -> None:
        self.path, self.key = options["path"], options.get("key", "file_id")
        self.alone = overwrite or options.get("alone", "false").lower() == "true"
        self.schema, self.layer = schema, uuid.uuid4().hex
        # the version that this write builds upon
        self.base = max(Folder(self.path).versions(), default=0)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder = Folder(self.path)
        folder.fs.create_dir(folder.at(f"data/{self.layer}"))
        stem = f"data/{self.layer}/{uuid.uuid4().hex}"
        kept = [f for f in to_arrow_schema(self.schema) if f.name != REASON]
        keys: dict = {}
        writer, rows = None, 0
        for batch in iterator:
            names = batch.schema.names
            reasons = batch.column(names.index(REASON)).to_pylist() if REASON in names else [None] * batch.num_rows
            for k, why in zip(batch.column(names.index(self.key)).to_pylist(), reasons, strict=True):
                keys[k] = why if keys.get(k) is None else keys[k]
            ok = batch.filter(pa.array([why is None for why in reasons], pa.bool_())).select([f.name for f in kept])
            if ok.num_rows:
                if writer is None:
                    writer = pq.ParquetWriter(folder.fs.open_output_stream(folder.at(f"{stem}.rows.parquet")), ok.schema)
                writer.write_batch(ok)
                rows += ok.num_rows
        if writer is not None:
            writer.close()
        if keys:
            kind = next(f.type for f in kept if f.name == self.key)
            table = pa.table({self.key: pa.array(list(keys), kind), REASON: pa.array(list(keys.values()), pa.string())})
            with folder.fs.open_output_stream(folder.at(f"{stem}.keys.parquet")) as f:
                pq.write_table(table, f)
        return Written(f"{stem}.rows.parquet" if rows else None, f"{stem}.keys.parquet" if keys else None)

    def add(self, messages: list[Written | None], batch: int | None = None) -> None:
        folder = Folder(self.path)
        told = [m for m in messages if m is not None]
        before = folder.manifest(self.base)["layers"] if self.base and not self.alone else []
        layer = {"id": self.layer, "batch": batch, "data": [m.data for m in told if m.data], "keys": [m.keys for m in told if m.keys]}
        folder.publish(self.base + 1, {"key": self.key, "schema": self.schema.json(), "layers": [*before, layer]})

    def undo(self, messages: list[Written | None]) -> None:
        """Deletes what the write's tasks left; no manifest names it."""
        folder = Folder(self.path)
        where = folder.at(f"data/{self.layer}")
        if folder.fs.get_file_info(where).type != pafs.FileType.NotFound:
            folder.fs.delete_dir(where)


class LayerWriter(Tasks, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.add(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self.undo(messages)


class StreamedLayers(Tasks, DataSourceStreamArrowWriter):
    """A layer for each micro-batch; one that is run again after a failure is published once."""

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        folder = Folder(self.path)
        self.base = max(folder.versions(), default=0)
        done = {x["batch"] for x in folder.manifest(self.base)["layers"]} if self.base else set()
        if batchId in done:
            self.undo(messages)
        elif any(m is not None and m.keys for m in messages):
            self.add(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.undo(messages)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Layers)


def publish(df: DataFrame, path: str, key: str = "file_id", alone: bool = False) -> None:
    """Replaces the files that df has rows of; with ``alone`` all others go."""
    register(df.sparkSession)
    df.write.format(FORMAT).mode("append").option("path", path).option("key", key).option("alone", str(alone).lower()).save()


def _read(spark: SparkSession, path: str, version: int | None, what: str, schema: T.StructType | None = None) -> tuple[DataFrame | None, dict]:
    folder = Folder(path)
    versions = folder.versions()
    if not versions:
        return None, {}
    told = folder.manifest(version or versions[-1])
    base = path.rstrip("/")
    frames = [(spark.read.schema(schema) if schema else spark.read).parquet(*[f"{base}/{x}" for x in layer[what]]).withColumn("_layer", F.lit(i)) for i, layer in enumerate(told["layers"]) if layer[what]]
    out = frames[0] if frames else None
    for x in frames[1:]:
        out = out.unionByName(x)
    return out, told


def latest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """key, fail_reason, _layer: for each file the latest layer that has it."""
    keys, told = _read(spark, path, version, "keys")
    k = told["key"]
    return keys.groupBy(k).agg(F.max(F.struct("_layer", REASON)).alias("_x")).select(k, f"_x.{REASON}", "_x._layer")


def failures(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Files that could not be read when they were last tried, and why."""
    return latest(spark, path, version).where(F.col(REASON).isNotNull()).drop("_layer")


def published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows that the last manifest (or a given one) publishes."""
    versions = Folder(path).versions()
    if not versions:
        raise FileNotFoundError(f"nothing is published at {path}")
    told = Folder(path).manifest(version or versions[-1])
    schema = T.StructType([f for f in T.StructType.fromJson(json.loads(told["schema"])).fields if f.name != REASON])
    rows, _ = _read(spark, path, version, "data", schema)
    if rows is None:
        return spark.createDataFrame([], schema)
    now = latest(spark, path, version).select(F.col(told["key"]).alias("_k"), F.col("_layer").alias("_now"))
    same = F.col(told["key"]).eqNullSafe(F.col("_k")) & (F.col("_layer") == F.col("_now"))
    return rows.join(now, same, "left_semi").select(*schema.names)


def compacted(spark: SparkSession, path: str) -> None:
    """Publishes all current rows, and the failures, as the only layer."""
    rows = published(spark, path)
    key = Folder(path).manifest(Folder(path).versions()[-1])["key"]
    failed = failures(spark, path)
    publish(rows.withColumn(REASON, F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True), path, key, alone=True)
