"""Files in the folder that the cluster shares: written tables that cut lineage, small state files, size-aware joins.

Executors may be lost at any time, so nothing here relies on their local disks: a cut is a Parquet table in the
folder of ``spark.checkpoint.dir``, which every executor can read again.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import urllib.parse
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than 1/HOT_SHARE of the rows is hot; so there are fewer than HOT_SHARE of them, whatever the input.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of this machine only where the session names none and runs on this machine alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cardmill-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small state file: written beside it, then renamed over it."""
    fs, p = _fs(spark, path)
    _, new = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(new, p):
        raise OSError(f"cannot write {path}")


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within it a query's shuffle files go when the query ends; else they stay until the driver happens to collect its garbage.

    For steps that end in written tables: a result that is asked for twice without one would be shuffled again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Scratch:
    """A folder of written tables for one run of an operator; removed when Python ends, or earlier by ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._quietly_remove)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` and read it back: later plans start from the files."""
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))

    def _quietly_remove(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # the session is gone already: only a folder of this machine can still be removed
            if self.root.startswith("file:"):
                shutil.rmtree(urllib.parse.urlparse(self.root).path, ignore_errors=True)


def join_by_size(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int | Column) -> DataFrame:
    """Inner join of many rows with one row per key, where single keys may hold a large part of ``rows``.

    ``groups`` knows the number of rows of each key (``size``). Keys above ``total / HOT_SHARE`` number fewer than
    ``HOT_SHARE`` and are broadcast; the rest, none of which is hot, are joined by a shuffle.
    """
    is_hot = F.col(size) * HOT_SHARE > total
    hot = F.broadcast(groups.filter(is_hot))
    cold_rows = rows.join(F.broadcast(groups.filter(is_hot).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold_rows.join(groups.filter(~is_hot), key))


class BucketTable:
    """A persisted table in hash buckets of its key, of which an update reads and writes only those that its keys fall into.

    ``manifest.json`` names the version of each bucket and the last update; it is replaced after an update's files are
    complete, and what it no longer names is removed then. So an update that dies leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets

    def manifest(self) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/manifest.json") or '{"version": 0, "done": -1, "buckets": {}}')

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        return [r[0] for r in keys.select(self._bucket()).distinct().collect()]  # at most one row per bucket

    def read(self, only: list[int] | None = None) -> DataFrame:
        held = self.manifest()["buckets"]
        paths = [f"{self.path}/v={v}/bucket={b}" for b, v in held.items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame, only: list[int], done: int) -> None:
        """Put ``rows`` in the place of all rows of the buckets ``only``; ``done`` numbers the update."""
        state = self.manifest()
        version = state["version"] + 1
        folder = f"{self.path}/v={version}"
        rows.withColumn("bucket", self._bucket()).repartition(max(1, len(only)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        gone = [f"{self.path}/v={v}/bucket={b}" for b, v in state["buckets"].items() if int(b) in only]
        held = {b: v for b, v in state["buckets"].items() if int(b) not in only} | {str(b): version for b in only if exists(self.spark, f"{folder}/bucket={b}")}
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps({"version": version, "done": done, "buckets": held}))
        for path in gone:
            delete(self.spark, path)


#: A key of fewer rows is never treated as hot, whatever its share.
HUB = 50_000


def hot_keys(rows: DataFrame, columns: list[str], total: int, scratch: Scratch, name: str, least: int = HUB) -> DataFrame | None:
    """``v``: the values of ``columns`` (of one kind) that hold more than ``least`` rows and 1/HOT_SHARE of all; None if none does.

    At most HOT_SHARE of them in each column, so they may be broadcast.
    """
    limit = max(least, total // HOT_SHARE)
    if total <= limit:  # no value has more rows than there are
        return None
    counted = rows.select(F.explode(F.array(*columns)).alias("v")).groupBy("v").count()
    held = scratch.cut(counted.filter(F.col("count") > limit).select("v"), name)
    return None if held.isEmpty() else F.broadcast(held)


def join_at(rows: DataFrame, by: str, values: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``rows`` with the columns of ``values`` (one row per ``v``) for the value in column ``by``: hot ones by a broadcast, so that their rows stay where they are."""
    cold = values.withColumnRenamed("v", by)
    if hot is None:
        return rows.join(cold, by)
    few = F.broadcast(values.join(hot, "v", "left_semi").withColumnRenamed("v", by))
    return rows.join(hot.withColumnRenamed("v", by), by, "left_anti").join(cold, by).unionByName(rows.join(few, by))
