"""One nested result per citing document, as it is handed on: source, cited documents, mentions, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.extract import Extraction

VERSION = "1.0.0"
STATUSES = ("resolved", "resolved_approx", "unresolved")


def _listed(rows: DataFrame, order: Column, fields: list[Column], name: str, *also: Column) -> DataFrame:
    """Rows of each document as one array of structs, in order; and ``also``, named aggregates of them."""
    packed = rows.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(*fields).alias("r")))).alias("l"), *also)
    return packed.withColumn(name, F.transform("l", lambda x: x["r"])).drop("l")


def references(extraction: Extraction, documents: DataFrame | None = None, mentions: DataFrame | None = None, parser: str = "", discovered: bool = False, resolved: bool = False) -> DataFrame:
    """Per citing document the whole result: schema_version, extraction_method, source_document, ai_discovery,
    url_resolution, referenced_documents, reference_mentions, summary.

    ``documents`` and ``mentions`` stand in for the extraction's own, for instance
    with discovered ones; documents may carry resolution_status and
    resolved_url. A document without citations has empty lists.
    """
    docs = documents if documents is not None else extraction.documents
    refs = mentions if mentions is not None else extraction.mentions
    if "resolution_status" not in docs.columns:
        docs = docs.withColumns({"resolution_status": F.lit("unresolved"), "resolved_url": F.lit(None).cast("string")})
    named = ["document_id", "document_type", "title", "short_title", "identifier", "date", "year", "issuing_body", "aliases", "title_source", "resolution_status", "resolved_url"]
    told = ["document_id", "source_page", "source_paragraph_id", "match_texts", "evidence_text", "relation_type", "target_locators", "confidence", "confidence_label", "confidence_reason", "mention_id"]
    number = F.regexp_extract("mention_id", r"(\d+)$", 1).cast("int")
    listed = _listed(docs, F.col("document_no"), [F.col(c) for c in named], "referenced_documents", *[F.count_if(F.col("resolution_status") == s).alias(s) for s in STATUSES])
    listed_refs = _listed(refs, number, [F.col(c) for c in told], "reference_mentions")
    rows = extraction.sources.join(listed, "doc_key", "left").join(listed_refs, "doc_key", "left")
    empty = lambda name: F.coalesce(F.col(name), F.array().cast(rows.schema[name].dataType))
    rows = rows.withColumns({"referenced_documents": empty("referenced_documents"), "reference_mentions": empty("reference_mentions")})
    mode = "deterministic_with_ai_discovery" if discovered else "deterministic"
    found = F.size(F.filter("referenced_documents", lambda d: d["title_source"] == "ai_discovered"))
    return rows.select(
        "doc_key", F.lit(VERSION).alias("schema_version"), F.struct(F.lit(mode).alias("mode"), F.lit(parser).alias("layout_parser"), F.lit(discovered).alias("llm_used")).alias("extraction_method"),
        F.struct(F.col("doc_key").cast("string").alias("source_pdf"), F.col("doc_key").cast("string").alias("file_name"), "page_count", "circular_number", "issue_date", "title").alias("source_document"),
        F.when(F.lit(discovered), F.struct(found.alias("documents"))).alias("ai_discovery"), F.when(F.lit(resolved), F.struct(*[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in STATUSES])).alias("url_resolution"),
        "referenced_documents", "reference_mentions",
        F.struct(
            F.size("referenced_documents").alias("referenced_document_count"), F.size("reference_mentions").alias("reference_mention_count"),
            F.array_sort(F.array_distinct(F.transform("reference_mentions", lambda m: m["source_page"]))).alias("pages_with_references"),
        ).alias("summary"),
    )


def response(results: DataFrame, structured: DataFrame, urls: DataFrame) -> DataFrame:
    """What a service answers: results with the structured pages, and the source named by the urls it was asked for (doc_key, source_url, pdf_url, file_name)."""
    rows = results.join(structured.select("doc_key", F.col("pages").alias("pages_data")), "doc_key", "left").join(urls, "doc_key", "left")
    source = F.col("source_document").withField("source_pdf", F.coalesce("pdf_url", "source_document.source_pdf")).withField("file_name", F.coalesce(F.col("file_name"), "source_document.file_name")).withField("source_url", F.col("source_url"))
    return rows.withColumn("source_document", source).drop("source_url", "pdf_url", "file_name")
