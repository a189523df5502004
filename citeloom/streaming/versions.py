"""Stateful ingestion: of files that name one document, in one batch or many, only what is new or corrected is extracted.

State is one row for each document: digest and time of its last accepted file.
It outlives the batches, is kept in RocksDB beside the checkpoint, and goes after
``ttl_days`` without a file of the document; one that comes later counts as new,
and replaces what is stored as any correction does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from citeloom.operators.extract import Extraction
from citeloom.sources.store import CitationStore
from citeloom.sources.tables import PAGES

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: With a TTL every batch would be followed by an empty one, for ever; state is aged by batches with files instead.
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
VERSION = "doc_key string, content string, version bigint"


def files_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """One row for each <stem>.pages.json file in ``folder`` (a path or pattern) or arriving there: doc_key, content, digest, modified."""
    files = spark.readStream.schema(PAGES).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(folder)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.pages\.json$", 1)
    content = F.to_json(F.struct("pages"), {"ignoreNullFields": "false"})
    rows = files.select(stem.alias("doc_key"), content.alias("content"), F.col("_metadata.file_modification_time").cast("double").alias("modified"))
    return rows.withColumn("digest", F.sha2("content", 256))


class _Versions(StatefulProcessor):
    """Hands a document's last file on if it differs from the one before; files older than that are dropped."""

    def __init__(self, ttl_ms: int):
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "digest string, modified double, version bigint", self._ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = max((row for batch in rows for row in batch.itertuples()), key=lambda r: (r.modified, r.digest))
        digest, modified, version = self._last.get() if self._last.exists() else (None, float("-inf"), 0)
        if latest.modified < modified:
            return
        changed = latest.digest != digest
        self._last.update((latest.digest, float(latest.modified), int(version) + changed))
        if changed:
            yield pd.DataFrame({"doc_key": [key[0]], "content": [latest.content], "version": [int(version) + 1]})

    def close(self) -> None:
        pass


def versions(files: DataFrame, ttl_days: int = 365) -> DataFrame:
    """New and corrected documents of a stream of files: doc_key, content, version (1 for the first)."""
    return files.groupBy("doc_key").transformWithStateInPandas(_Versions(ttl_days * 86_400_000), VERSION, "append", "ProcessingTime")


def paragraphs_of(rows: DataFrame) -> DataFrame:
    """doc_key, page_number, para_no, paragraph_id, text of (doc_key, content)."""
    pages = rows.select("doc_key", F.explode(F.from_json("content", PAGES)["pages"]).alias("p"))
    each = pages.select("doc_key", "p.page_number", F.posexplode("p.paragraphs").alias("n", "q"))
    return each.select("doc_key", "page_number", (F.col("n") + 1).alias("para_no"), "q.paragraph_id", "q.text")


def ingest(spark: SparkSession, folder: str, store: CitationStore, checkpoint: str, ttl_days: int = 365, files_per_batch: int = 1000) -> StreamingQuery:
    """Takes what has arrived into ``store`` and ends; a document's rows are those of its last version.

    A batch that is tried again replaces the same documents by the same rows.
    """

    spark.conf.set(PROVIDER, ROCKSDB)
    spark.conf.set(NO_DATA, "false")

    def batch(rows: DataFrame, number: int) -> None:
        arrived = rows.persist()
        found = Extraction(paragraphs_of(arrived))
        store.replace(found)
        found.close()
        arrived.unpersist()

    stream = versions(files_stream(spark, folder, files_per_batch), ttl_days)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
