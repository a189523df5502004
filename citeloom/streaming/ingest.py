"""Structured Streaming over arriving <stem>.pages.json files.

A citing document arrives whole, as one file, and its state ends with it, so
each micro-batch is extracted by itself; no watermark is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citeloom.operators.extract import Extraction
from citeloom.sources.tables import PAGES


def pages_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Paragraphs of the files in ``folder`` and of those that arrive: doc_key, page_number, para_no, paragraph_id, text."""
    files = spark.readStream.schema(PAGES).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(folder)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.pages\.json$", 1)
    pages = files.select(stem.alias("doc_key"), F.explode("pages").alias("p"))
    rows = pages.select("doc_key", "p.page_number", F.posexplode("p.paragraphs").alias("n", "q"))
    return rows.select("doc_key", "page_number", (F.col("n") + 1).alias("para_no"), "q.paragraph_id", "q.text")


def extract_stream(paragraphs: DataFrame, sink: str, checkpoint: str, each: Callable[[Extraction, int], None] | None = None) -> StreamingQuery:
    """Writes documents and mentions of every batch below ``sink``; a batch that is tried again replaces its own files."""

    def batch(rows: DataFrame, number: int) -> None:
        found = Extraction(rows)
        for name in ("documents", "mentions", "summary"):
            getattr(found, name).write.mode("overwrite").parquet(f"{sink}/{name}/batch={number}")
        if each:
            each(found, number)
        found.close()

    return paragraphs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
