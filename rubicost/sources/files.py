"""Files of a folder, clean cell values, and sinks that replace what belongs to a file."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: kinds of files by extension; a parameter of ``listed``
KINDS = {"xlsx": "workbook", "xlsm": "workbook", "csv": "text", "txt": "text", "docx": "document", "pdf": "pdf", "parquet": "table", "json": "text"}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one only for ``local`` masters where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (root or "/tmp/checkpoints/rubicost").rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The frame written once to the shared folder and read from there: what is parsed from texts is not parsed again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def listed(spark: SparkSession, folder: str, kinds: dict[str, str] = KINDS) -> DataFrame:
    """path, name, extension, length, kind and, where a file can't be read, why.

    Contents are not loaded: the column is pruned from the scan. A reason takes
    the place of an error, so one bad file stops nothing. Files without a byte
    have no row: Spark's scans pass them over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), extension)
    reason = F.when(kind.isNull(), "unsupported")
    return files.select("path", name.alias("name"), extension.alias("extension"), "length", kind.alias("kind"), reason.alias("fail_reason"))


def clean_value(value: Column) -> Column:
    """A cell's text: no-break spaces are spaces, ends are trimmed, nothing is null."""
    return F.nullif(F.trim(F.translate(value, "   ", "   ")), F.lit(""))


def clean_number(value: Column) -> Column:
    """A cell's number: not-a-number is null."""
    return F.when(~F.isnan(value), value)


def replace_files(df: DataFrame, path: str, key: str = "file_id") -> None:
    """Writes rows below a folder for each key; folders of keys that df doesn't have stay as they are.

    The folders of one write appear together when its job commits.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
