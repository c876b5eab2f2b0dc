import pytest
from pyspark.sql import functions as F

from rubicost.sources.published import Conflict, Folder, Tasks, compacted, failures, publish, published

SCHEMA = "file_id long, row_no int, hours double"


def rows(spark, files, hours):
    return spark.createDataFrame([(f, i, hours) for f in files for i in range(3)], SCHEMA).repartition(3)


def state(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_files_are_replaced_whole_and_versions_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    publish(rows(spark, [1, 2, 3], 1.0), path)
    publish(rows(spark, [2], 2.0).where("row_no < 2"), path)
    got = state(published(spark, path))
    assert got == sorted([(f, i, 1.0) for f in (1, 3) for i in range(3)] + [(2, 0, 2.0), (2, 1, 2.0)], key=repr)
    assert state(published(spark, path, version=1)) == state(rows(spark, [1, 2, 3], 1.0))
    compacted(spark, path)
    assert state(published(spark, path)) == got and len(Folder(path).manifest(3)["layers"]) == 1


def test_a_write_that_dies_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "t")
    publish(rows(spark, [1, 2], 1.0), path)
    dying = rows(spark, [1, 2], 5.0).withColumn("hours", F.when((F.col("file_id") == 2) & (F.col("row_no") == 2), F.raise_error(F.lit("dies"))).otherwise(F.col("hours")))
    with pytest.raises(Exception, match="dies"):
        publish(dying, path)
    assert state(published(spark, path)) == state(rows(spark, [1, 2], 1.0)) and Folder(path).versions() == [1]
    # nothing of it is left
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_the_slower_of_two_writers_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    publish(rows(spark, [1], 1.0), path)
    slow = Tasks({"path": path}, rows(spark, [1], 1.0).schema, False)
    publish(rows(spark, [1], 2.0), path)
    with pytest.raises(Conflict):
        slow.add([])
    assert state(published(spark, path)) == state(rows(spark, [1], 2.0)) and Folder(path).versions() == [1, 2]


def test_failures_are_entries_too(spark, tmp_path):
    path = str(tmp_path / "t")
    publish(rows(spark, [1, 2, None], 1.0), path)
    failed = spark.createDataFrame([(2, None, None, "encrypted"), (7, None, None, "empty")], SCHEMA + ", fail_reason string")
    publish(failed, path)
    assert state(published(spark, path)) == state(rows(spark, [1, None], 1.0))
    assert state(failures(spark, path)) == [(2, "encrypted"), (7, "empty")]
    publish(rows(spark, [2], 3.0), path)
    assert state(failures(spark, path)) == [(7, "empty")] and published(spark, path).where("file_id = 2").count() == 3
    compacted(spark, path)
    assert state(failures(spark, path)) == [(7, "empty")] and published(spark, path).count() == 9


def test_streamed_layers_are_published_once(spark, tmp_path):
    from rubicost.sources.published import FORMAT, register

    path = str(tmp_path / "t")
    register(spark)
    for files, hours in (([1, 2], 1.0), ([2, 3], 2.0)):
        rows(spark, files, hours).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        stream.writeStream.format(FORMAT).option("path", path).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert state(published(spark, path)) == state(rows(spark, [1], 1.0).unionByName(rows(spark, [2, 3], 2.0)))
    with pytest.raises(FileNotFoundError):
        published(spark, str(tmp_path / "other"))
