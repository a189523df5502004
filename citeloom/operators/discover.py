"""Discovered references: the text that a reader is asked about, and the merge of what it finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import patterns as P
from citeloom.functions import text as T
from citeloom.operators.resolve import clean_discoveries


def page_prompt(paragraphs: DataFrame) -> DataFrame:
    """Per citing document: its pages in order, each under a heading, paragraphs joined by spaces."""
    rows = paragraphs.withColumn("text", T.compact("text")).filter("text <> ''")
    page = rows.groupBy("doc_key", "page_number").agg(F.array_sort(F.collect_list(F.struct("para_no", "text"))).alias("p"))
    told = F.concat(F.lit("=== PAGE "), F.col("page_number").cast("string"), F.lit(" ===\n"), F.array_join(F.transform("p", lambda x: x["text"]), " "))
    page = page.select("doc_key", F.struct("page_number", told.alias("t")).alias("page"))
    return page.groupBy("doc_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda x: x["t"]), "\n").alias("prompt"))


def merge_discoveries(documents: DataFrame, mentions: DataFrame, found: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and mentions with discovered ones added, numbered after those that are there.

    found: doc_key, pos, exact_quote, evidence_text, document_type, title, identifier, year_or_date, source_page.
    A discovery whose key is known refers to that document; others become documents in order of pos.
    """
    titled = found.join(sources.select("doc_key", F.col("title").alias("__own")), "doc_key", "left")
    clean = clean_discoveries(titled, F.coalesce("__own", F.lit(""))).drop("__own")
    clean = clean.withColumn("key", T.document_key(F.col("document_type"), T.tidy_title("title"), F.col("identifier"), F.col("date"), F.col("year")))
    known = documents.select("doc_key", "key", "document_no")
    most = documents.groupBy("doc_key").agg(F.max("document_no").alias("__most"))
    fresh = clean.join(known, ["doc_key", "key"], "left_anti").groupBy("doc_key", "key").agg(
        F.min("pos").alias("pos"), *[F.min_by(c, "pos").alias(c) for c in ("document_type", "title", "identifier", "date", "year", "issuing_body")]
    )
    number = F.coalesce("__most", F.lit(0)) + F.row_number().over(Window.partitionBy("doc_key").orderBy("pos"))
    fresh = fresh.join(most, "doc_key", "left").withColumn("document_no", number).select(
        "doc_key", F.format_string("doc_%03d", "document_no").alias("document_id"), "document_no", "key", "document_type", "title", F.lit(None).cast("string").alias("short_title"), "identifier", "date", "year",
        "issuing_body", F.array().cast("array<string>").alias("aliases"), F.lit("ai_discovered").alias("title_source"),
    )
    every = documents.unionByName(fresh)
    counts = mentions.groupBy("doc_key").agg(F.count(F.lit(1)).alias("__n"))
    place = F.coalesce("__n", F.lit(0)) + F.row_number().over(Window.partitionBy("doc_key").orderBy("pos"))
    quote, evidence = F.coalesce("exact_quote", F.lit("")), F.coalesce("evidence_text", F.lit(""))
    at = F.instr(evidence, quote)
    loc = T.locators(F.when((quote != "") & (at > 0), F.substring(evidence, F.lit(1), at - 1)).otherwise(""))
    value, label, reason = P.DISCOVERED
    added = clean.join(every.select("doc_key", "key", "document_id"), ["doc_key", "key"]).join(counts, "doc_key", "left").withColumn("__l", loc).select(
        "doc_key", F.format_string("ref_%03d", place).alias("mention_id"), "document_id", F.coalesce("source_page", F.lit(1)).alias("source_page"), F.lit(None).cast("string").alias("source_paragraph_id"),
        F.when(quote != "", F.array(quote)).otherwise(F.array().cast("array<string>")).alias("match_texts"), evidence.alias("evidence_text"), T.relation_type(evidence).alias("relation_type"),
        F.struct(F.when(F.col("__l.raw").isNotNull(), F.array("__l.raw")).alias("raw"), *[F.col(f"__l.{n}").alias(n) for n in ("paragraphs", "regulations", "sections", "chapters", "annexures", "clauses")]).alias("target_locators"),
        F.lit(value).alias("confidence"), F.lit(label).alias("confidence_label"), F.lit(reason).alias("confidence_reason"),
    )
    return every, mentions.unionByName(added.select(*mentions.columns))


def listing_rows(html: Column) -> Column:
    """Rows of a listing page: array of (url, title, pos)."""
    urls, titles = F.regexp_extract_all(html, F.lit(P.LISTING_ROW), F.lit(1)), F.regexp_extract_all(html, F.lit(P.LISTING_ROW), F.lit(2))
    return F.transform(F.arrays_zip(urls.alias("url"), titles.alias("title")), lambda r, i: F.struct(r["url"].alias("url"), F.trim(r["title"]).alias("title"), i.alias("pos")))


def citation_counts(findings: DataFrame) -> DataFrame:
    """Cited documents over all citing ones, by their key: how many cite them, how often."""
    return findings.groupBy("key").agg(F.count_distinct("doc_key").alias("citing_documents"), F.count(F.lit(1)).alias("citations"))


def predictions_by_fixture(predictions: DataFrame) -> DataFrame:
    """Prediction rows in the nested form of prediction files."""
    fields = F.struct(F.col("title").alias("canonical_title"), F.col("identifier").alias("official_identifier"), "document_type", F.col("pages").alias("source_pages"), F.col("url").alias("resolved_url"))
    rows = predictions.groupBy("fixture_id").agg(F.array_sort(F.collect_list(F.struct("idx", fields.alias("r")))).alias("l"))
    return rows.select("fixture_id", F.transform("l", lambda x: x["r"]).alias("references"))
