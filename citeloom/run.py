"""Whole runs over folders: pages to results, and predictions with gold sets to a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import assemble, discover, evaluate, resolve
from citeloom.operators.extract import Extraction
from citeloom.sources import tables
from citeloom.sources.store import CitationStore


def extract_folder(
    spark: SparkSession, pages: str, out: str, discoveries: DataFrame | None = None, listing: DataFrame | None = None, store: CitationStore | None = None, strict: bool = False, parser: str = "",
) -> int:
    """Extracts <stem>.pages.json files, merges discoveries, resolves against a listing, and writes <stem>.references.json files; returns their number.

    ``discoveries`` as ``tables.read_discoveries`` gives them; ``listing`` as
    ``resolve`` takes it; ``store`` gets the extraction's tables, too. Each step
    is stored once, so none is computed for the next one again.
    """
    found = Extraction(tables.read_pages(spark, pages), strict=strict)
    docs, refs = found.documents, found.mentions
    if discoveries is not None:
        docs, refs = discover.merge_discoveries(docs, refs, discoveries, found.sources)
    if listing is not None:
        asked = docs.select(F.concat_ws("|", "doc_key", "document_id").alias("ref"), "document_type", "title", "short_title", "identifier", "date")
        told = resolve.resolve(asked, listing).select("ref", "resolved_url", "resolution_status")
        docs = docs.withColumn("ref", F.concat_ws("|", "doc_key", "document_id")).join(told, "ref", "left").drop("ref")
    if store is not None:
        store.replace(found)
    results = assemble.references(found, docs, refs, parser, discovered=discoveries is not None, resolved=listing is not None)
    written = tables.write_files(tables.json_files(results, ".references.json"), out)
    found.close()
    return written


def predict_folder(spark: SparkSession, pages: str, out: str) -> int:
    """Extracts <stem>.pages.json files and writes each one's documents as a prediction file <stem>.json of the fixture of that name."""
    paragraphs = tables.read_pages(spark, pages)
    found = Extraction(paragraphs)
    fixtures = paragraphs.select("doc_key", F.col("doc_key").alias("fixture_id")).distinct()
    nested = discover.predictions_by_fixture(evaluate.as_predictions(found, fixtures))
    files = tables.json_files(nested.withColumn("name", F.col("fixture_id")), ".json", "name")
    written = tables.write_files(files, out)
    found.close()
    return written


def evaluate_folder(spark: SparkSession, predictions: str, golds: str) -> DataFrame:
    """Scores prediction files against gold files: one row for each gold fixture; ``evaluate.report`` renders it."""
    gold = evaluate.gold_rows(tables.read_gold(spark, golds))
    return evaluate.evaluate(evaluate.prediction_rows(tables.read_predictions(spark, predictions)), gold)
