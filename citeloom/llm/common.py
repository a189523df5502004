"""Helpers that several operators share: tables, shared storage, row keys."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from contextlib import suppress
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts: space and the five controls from tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"

#: Ids that may be broadcast for a filter: 8 bytes each, so 4 MB at most; beyond it a shuffled join is used.
BROADCAST_IDS = 500_000
#: Rows of a key from which it counts as hot.
HOT = 1024

_own_dirs: dict[str, str] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where it is unset and all of Spark lives in this process (local mode)
    does a temporary folder of this machine take its place.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="citeloom-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return "file://" + _own_dirs[app]


def _folder(spark: SparkSession, path: str):
    """The path and its file system, as the JVM knows them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    A lost executor then costs at most the tasks since this table; the files
    survive the loss of any executor, and go when the driver ends.
    ``instead_of`` is an earlier such table that nothing needs any more: its
    files go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/citeloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, files = _folder(spark, path)
    files.deleteOnExit(place)
    if instead_of is not None and instead_of in _paths:
        place, files = _folder(spark, _paths.pop(instead_of))
        files.delete(place, True)
    saved = spark.read.schema(df.schema).parquet(path)
    _paths[saved] = path
    return saved


def idle() -> None:
    """At the end of a Python task: what Arrow and the allocator hold for later goes back, so that a worker that waits is small."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, unique: Sequence[str], how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` with ``groups``, one row for each key, of which ``size`` tells how many rows it has.

    Groups of HOT rows or more, a HOT-th of all rows at most, are broadcast if
    they are no more than BROADCAST_IDS; their rows, spread by ``unique`` columns,
    fill no task of the shuffled join that serves all others.
    """
    others = [c for c in groups.columns if c not in keys]
    packed = groups.select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)], F.struct(*others).alias("__v"), (F.col(size) >= HOT).alias("__hot"))
    hot = packed.filter("__hot").select(*[F.col(f"__g{i}").alias(f"__h{i}") for i in range(len(keys))], F.col("__v").alias("__w"))
    if not 0 < hot.count() <= BROADCAST_IDS:
        return rows.join(groups, list(keys), how)
    met = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"__h{i}") for i, k in enumerate(keys)], "left")
    own = F.col("__w").isNull()
    spread = met.select("*", F.when(own, F.xxhash64(*keys)).otherwise(F.xxhash64(*unique)).alias("__s"), own.alias("__own"))
    cold = packed.filter(~F.col("__hot")).withColumn("__t", F.xxhash64(*[f"__g{i}" for i in range(len(keys))]))
    equal = [F.col(k) == F.col(f"__g{i}") for i, k in enumerate(keys)]
    both = spread.join(cold, [F.col("__s") == F.col("__t"), *equal, F.col("__own") == ~F.col("__hot")], "left")
    value = F.coalesce("__w", "__v")
    return (both.filter(value.isNotNull()) if how == "inner" else both).select(*rows.columns, *[value[c].alias(c) for c in others])


def running(df: DataFrame, order: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """``df`` with __place, each row's place from 0 in the order, and __before_<c>, the sum of each c over all rows before.

    Rows are range-partitioned and summed by partition; one task sees one row of
    each partition, never all rows.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = save(placed.withColumn("__pid", F.spark_partition_id()).withColumn("__pos", F.monotonically_increasing_id()), "running")
    numbers = {"__place": F.lit(1).cast("bigint")} | {f"__before_{c}": F.col(c) for c in sums}
    above = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("__pid").agg(*[F.sum(x).alias(name) for name, x in numbers.items()])
    offsets = parts.select("__pid", *[F.sum(name).over(above).alias(f"{name}_0") for name in numbers])
    own = Window.partitionBy("__pid").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    both = placed.join(F.broadcast(offsets), "__pid")
    none = F.lit(0)
    return both.select(*df.columns, *[(F.coalesce(F.col(f"{name}_0"), none) + F.coalesce(F.sum(x).over(own), none)).alias(name) for name, x in numbers.items()])


def text_of(column: str) -> Column:
    """A text with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart where an id may be null or occur twice with other texts."""
    return [F.col(id_col).alias("__id"), F.xxhash64(text_of(text_col)).alias("__tx")]


def keep_rows(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` whose (id, text hash) occurs in ``rows`` (columns __id, __tx), columns unchanged.

    The join is shuffled unless Spark finds the ids small at run time.
    """
    rows = rows.select(F.col("__id").alias("__k_id"), F.col("__tx").alias("__k_tx")).distinct()
    return docs.join(rows, F.col(id_col).eqNullSafe(F.col("__k_id")) & (F.xxhash64(text_of(text_col)) == F.col("__k_tx")), "left_semi")
