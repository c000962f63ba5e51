"""Session-level helpers: table access, lineage cuts on shared storage, and
size-checked broadcasts and skew-safe attachment of group aggregates."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only after a count shows it holds at most this many rows.
BROADCAST_ROWS = 50_000
#: A key is hot when it holds more rows than this, and more than total / HOT_KEYS.
HOT_ROWS = 100_000
HOT_KEYS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table; Parquet pushdown and column pruning are left to Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    master = spark.conf.get("spark.master", "local")
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: ``spark.checkpoint.dir`` of the session.

    Where it is unset (tests, a laptop) a temporary folder is used, which is
    refused on a cluster because executors would not share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="calyx-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A file of any file system that Spark knows; None if there is none."""
    fs, at = _filesystem(spark, path)
    if not fs.exists(at):
        return None
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0][0])


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file of any file system that Spark knows, beside its place, and move it there when complete."""
    fs, at = _filesystem(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs.setWriteChecksum(False)
    try:
        out = fs.create(beside, True)
        out.write(bytearray(data))
        out.close()
        fs.delete(at, False)
        if not fs.rename(beside, at):
            raise OSError(f"{path} could not be put in its place")
    finally:
        if fs.exists(beside):
            fs.delete(beside, False)


class Folder:
    """A place of its own in the shared folder. ``drop`` removes the files."""

    def __init__(self, spark: SparkSession, label: str = "stage"):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _STAGES.append(self)

    def mapped(self) -> str | None:
        """Its path for files that workers map into memory; None if it lies on no mounted file system."""
        at = urlparse(self.path)
        return at.path if at.scheme in ("", "file") else None

    def size(self) -> int:
        """Bytes of its files."""
        fs, path = _filesystem(self.spark, self.path)
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def drop(self, part: str = "") -> None:
        """Remove the files, or those of one part of a partitioned stage."""
        if not part and self in _STAGES:
            _STAGES.remove(self)
        try:
            fs, path = _filesystem(self.spark, f"{self.path}/{part}" if part else self.path)
            fs.delete(path, True)
        except Exception:  # the session may be gone at exit
            pass


class Stage(Folder):
    """A DataFrame written to the shared folder: recomputing lost tasks reads the
    files again instead of the whole lineage."""

    def __init__(self, df: DataFrame, label: str = "stage", partition_by: Sequence[str] = ()):
        super().__init__(df.sparkSession, label)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)


_STAGES: list[Folder] = []


@atexit.register
def _drop_stages() -> None:
    for stage in list(_STAGES):
        stage.drop()


@contextmanager
def session_settings(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """The session's settings changed inside, and put back after."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def cut(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write and read back: a lineage cut that survives the loss of executors."""
    return Stage(df, label).df


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a bounded count proves it small, else unchanged."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def hot_threshold(total_rows: int) -> int:
    return max(HOT_ROWS, total_rows // HOT_KEYS)


def attach_group(rows: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], hot_rows: int | None = None, held: list[Stage] | None = None) -> DataFrame:
    """``rows`` with the aggregates of their group attached, safe for hot keys.

    The aggregates combine map-side, once, and are kept in a stage. Keys with more
    than ``hot_rows`` rows (by default ``hot_threshold`` of all rows), of which there
    are at most total / hot_rows, reach their rows by broadcast, so no hot group is
    gathered in one task; all other keys go by a shuffle join, the only one if no key
    is hot. Rows with a null key get no match and are dropped. ``held`` takes the
    stage, for callers that drop it once the result is written.
    """
    keys = list(keys)
    stage = Stage(rows.groupBy(*keys).agg(*aggregates, F.count(F.lit(1)).alias("_group_rows")), "groups")
    if held is not None:
        held.append(stage)
    total, most = stage.df.agg(F.sum("_group_rows"), F.max("_group_rows")).first()
    limit = hot_threshold(int(total or 0)) if hot_rows is None else hot_rows
    if int(most or 0) <= limit:
        return rows.join(stage.df, keys).drop("_group_rows")
    hot = stage.df.where(F.col("_group_rows") > limit)
    cold = stage.df.where(F.col("_group_rows") <= limit)
    warm_rows = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    joined = rows.join(F.broadcast(hot), keys).unionByName(warm_rows.join(cold, keys))
    return joined.drop("_group_rows")


def numbered_within(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``rows`` numbered from 1 within their keys, in the order of columns that, with the keys, are unique.

    No group is gathered in one task: rows are put in ranges of keys and order, each
    range numbers its part of a group, and parts move up by the rows of the group in
    ranges before. Only the first and last group of a range can reach into another,
    so what is broadcast is at most two rows for each pair of a range and such a group.
    """
    keys = list(keys)
    placed = rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    stage = cut(placed, "ranges")
    group = F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_"))
    ends = stage.groupBy("_range").agg(F.min(group).alias("first"), F.max(group).alias("last"))
    reaching = ends.select(F.explode(F.array("first", "last")).alias("_group")).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_group.{k}"))
    parts = stage.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_rows"))
    parts = parts.join(F.broadcast(reaching), same).select("_range", "_group", "_rows") if keys else parts.select("_range", group.alias("_group"), "_rows")
    ahead = F.sum("_rows").over(Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select(F.col("_range").alias("_at"), "_group", ahead.alias("_before")).where("_before is not null")
    counted = stage.join(F.broadcast(offsets), (F.col("_range") == F.col("_at")) & same, "left")
    inside = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    return counted.withColumn(name, (inside + F.coalesce("_before", F.lit(0))).cast("long")).select(*rows.columns, name)


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` with consecutive numbers from 0 in the order of a unique column, without gathering them in one task.

    Rows are put in ranges; each range is numbered by itself and moved up by the
    rows before it. The driver sees one count per range.
    """
    stage = cut(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = sorted(tuple(r) for r in stage.groupBy("_range").agg(F.count(F.lit(1))).collect())
    start, starts = 0, []
    for number, size in sizes:
        starts.append((number, start))
        start += size
    before = rows.sparkSession.createDataFrame(starts, "_range int, _before long")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    counted = stage.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + inside - 1)
    return counted.drop("_range", "_before")
