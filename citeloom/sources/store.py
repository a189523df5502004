"""Stored tables of which a rerun replaces only its own rows.

A table is partitioned by a hash of its placing columns and bucketed by them, so
tables that are placed alike are joined without a shuffle. Replacing rewrites the
partitions that hold rows which go or come, by dynamic partition overwrite; all
others, and their files, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citeloom.operators.extract import Extraction
from citeloom.storage import Kept, file_system

#: Lets a join on more columns than the bucketing ones use the buckets, too.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
DYNAMIC = "spark.sql.sources.partitionOverwriteMode"


class StoredTable:
    """One table below ``path``, known to the session's catalog as ``name``."""

    def __init__(self, spark: SparkSession, name: str, path: str, placed_by: Sequence[str], parts: int = 16, buckets: int = 8):
        self.spark, self.name, self.path, self.placed_by, self.parts, self.buckets = spark, name, path, list(placed_by), parts, buckets
        self._declared = self._held = False
        spark.conf.set(CO_PARTITION, "false")

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.placed_by), F.lit(self.parts)).cast("int")

    def declare(self, schema: StructType) -> StoredTable:
        """Makes the table known, with the partitions that are there."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        keys = ", ".join(f"`{c}`" for c in self.placed_by)
        place, files = file_system(self.spark, self.path)
        files.mkdirs(place)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, part int) USING parquet PARTITIONED BY (part) CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        self.spark.catalog.recoverPartitions(self.name)
        self._declared, self._held = True, any(s.getPath().getName().startswith("part=") for s in files.listStatus(place))
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name).drop("part")

    def _first(self, rows: DataFrame) -> list[int]:
        """Into an empty table."""
        placed = rows.withColumn("part", self.part()).select(*self.spark.table(self.name).columns)
        placed.hint("rebalance", "part", *self.placed_by).write.insertInto(self.name)
        self._held = True
        return sorted(int(r[0].partition("=")[2]) for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect())

    @contextmanager
    def _dynamic(self) -> Iterator[None]:
        """Overwrites reach only the partitions that get rows."""
        before = self.spark.conf.get(DYNAMIC)
        self.spark.conf.set(DYNAMIC, "dynamic")
        try:
            yield
        finally:
            self.spark.conf.set(DYNAMIC, before)

    def replace(self, rows: DataFrame, gone: DataFrame, on: Sequence[str]) -> list[int]:
        """Puts ``rows`` in place of all stored rows that agree with a row of ``gone`` in the columns ``on``; returns the parts that were rewritten.

        Parts are numbers below ``parts``: these, no rows, reach the driver. A
        run that is tried again ends in the same table.
        """
        if not self._declared:
            self.declare(rows.schema)
        if not self._held:
            return self._first(rows)
        stored, keys = self.spark.table(self.name), gone.select(*on).distinct()
        same = lambda: reduce(Column.__and__, [stored[c].eqNullSafe(keys[c]) for c in on])
        fresh = rows.withColumn("part", self.part())
        stale = stored.join(keys, same(), "left_semi").select("part")
        touched = sorted(r.part for r in fresh.select("part").unionByName(stale).distinct().collect())
        if not touched:
            return []
        stays = stored.filter(F.col("part").isin(touched)).join(keys, same(), "left_anti")
        held = {r.part for r in stays.select("part").unionByName(fresh.select("part")).distinct().collect()}
        kept = Kept(self.spark)  # a table cannot be read while it is overwritten
        whole = kept(stays.unionByName(fresh.select(*stored.columns)))
        with self._dynamic():
            whole.hint("rebalance", "part", *self.placed_by).write.mode("overwrite").insertInto(self.name)
        kept.close()
        for part in set(touched) - held:  # no row is left, so no overwrite has reached it
            place, files = file_system(self.spark, f"{self.path}/part={part}")
            files.delete(place, True)
        self.spark.sql(f"MSCK REPAIR TABLE {self.name} SYNC PARTITIONS")
        return touched


class CitationStore:
    """The extraction's tables, placed by citing document: ``documents``, ``mentions``, ``summary``, ``sources``.

    Joins of them on doc_key, alone or with other columns, need no shuffle.
    """

    NAMES = ("documents", "mentions", "summary", "sources")

    def __init__(self, spark: SparkSession, path: str, prefix: str = "citations", parts: int = 16, buckets: int = 8):
        self.tables = {name: StoredTable(spark, f"{prefix}_{name}", f"{path.rstrip('/')}/{name}", ["doc_key"], parts, buckets) for name in self.NAMES}

    def replace(self, extraction: Extraction) -> dict[str, list[int]]:
        """Rows of the extracted documents replace what is stored of them; other documents stay. Returns the rewritten parts of each table."""
        return {name: table.replace(getattr(extraction, name), extraction.sources, ["doc_key"]) for name, table in self.tables.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def cited(self) -> DataFrame:
        """Each mention with its document's attributes, joined where the rows lie."""
        told = self["documents"].select("doc_key", "document_id", "key", "document_type", "title", "short_title", "identifier", "date", "year")
        return self["mentions"].join(told.hint("shuffle_merge"), ["doc_key", "document_id"])
