"""Readers and writers of the extraction's JSON and Parquet forms."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.storage import file_system

PAGES = "pages array<struct<page_number:int,paragraphs:array<struct<paragraph_id:string,text:string>>>>"
LOCATORS = "struct<raw:array<string>,paragraphs:array<string>,regulations:array<string>,sections:array<string>,chapters:array<string>,annexures:array<string>,clauses:array<string>>"
REFERENCES = (
    "source_document struct<source_pdf:string,file_name:string,page_count:int,circular_number:string,issue_date:string,title:string>,"
    "referenced_documents array<struct<document_id:string,document_type:string,title:string,short_title:string,identifier:string,date:string,year:int,issuing_body:string,aliases:array<string>,"
    "title_source:string,resolution_status:string,resolved_url:string>>,"
    f"reference_mentions array<struct<document_id:string,source_page:int,source_paragraph_id:string,match_texts:array<string>,evidence_text:string,relation_type:string,target_locators:{LOCATORS},"
    "confidence:double,confidence_label:string,confidence_reason:string,mention_id:string>>,"
    "summary struct<referenced_document_count:int,reference_mention_count:int,pages_with_references:array<int>>"
)
GOLD = (
    "fixture_id string, source_pdf string, scored_references array<struct<canonical_key:string,document_type:string,canonical_title:string,aliases:array<string>,official_identifier:string,"
    "source_pages:array<int>,resolved_url:string>>"
)
DISCOVERIES = "references array<struct<exact_quote:string,evidence_text:string,document_type:string,title:string,identifier:string,year_or_date:string,source_page:int>>"
PREDICTIONS = "fixture_id string, references array<string>"


def _json(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _stem(suffix: str):
    return F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*?){suffix}$", 1)


def read_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """<stem>.pages.json files as paragraphs: doc_key (the stem), page_number, para_no, paragraph_id, text."""
    pages = _json(spark, path, PAGES).select(_stem(r"\.pages\.json").alias("doc_key"), F.explode("pages").alias("p"))
    rows = pages.select("doc_key", "p.page_number", F.posexplode("p.paragraphs").alias("para_no", "q"))
    return rows.select("doc_key", "page_number", (F.col("para_no") + 1).alias("para_no"), "q.paragraph_id", "q.text")


def read_references(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _json(spark, path, REFERENCES).withColumn("doc_key", _stem(r"\.references\.json"))


def read_gold(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Gold files: fixture_id, source_pdf, scored_references; of files with one id the last by name counts."""
    rows = _json(spark, path, GOLD).withColumn("__f", F.col("_metadata.file_name"))
    return rows.groupBy("fixture_id").agg(F.max_by("source_pdf", "__f").alias("source_pdf"), F.max_by("scored_references", "__f").alias("scored_references"))


def read_discoveries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """<stem>.discovered.json files: doc_key (the stem), pos (order in the file), exact_quote, evidence_text, document_type, title, identifier, year_or_date, source_page."""
    rows = _json(spark, path, DISCOVERIES).select(_stem(r"\.discovered\.json").alias("doc_key"), F.posexplode("references").alias("pos", "r"))
    return rows.select("doc_key", "pos", "r.*")


def read_predictions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Prediction files: fixture_id (else the file's stem), references, each as its JSON text, for which keys are there matters; none where nothing is there."""
    try:
        rows = _json(spark, path, PREDICTIONS)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "fixture_id string, references array<string>")
    rows = rows.withColumn("__f", F.col("_metadata.file_name"))
    named = rows.withColumn("fixture_id", F.coalesce(F.nullif("fixture_id", F.lit("")), _stem(r"\.json")))
    return named.groupBy("fixture_id").agg(F.max_by("references", "__f").alias("references"))


def paragraphs_by_page(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs in the nested form of <stem>.pages.json, one row per document; blank ones are left out."""
    from citeloom.functions.text import compact

    rows = paragraphs.withColumn("text", compact("text")).filter("text <> ''")
    page = rows.groupBy("doc_key", "page_number").agg(F.array_sort(F.collect_list(F.struct("para_no", "paragraph_id", "text"))).alias("p"))
    page = page.select("doc_key", "page_number", F.transform("p", lambda x: F.struct(x["paragraph_id"].alias("paragraph_id"), x["text"].alias("text"))).alias("paragraphs"))
    return page.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("page_number", "paragraphs"))).alias("pages"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line; null fields are kept."""
    df.write.option("ignoreNullFields", False).json(path)


def json_files(df: DataFrame, suffix: str, key: str = "doc_key") -> DataFrame:
    """(name, content): a file's name and its text for each row, indented, null fields and letters beyond ASCII kept."""
    fields = F.struct(*[c for c in df.columns if c != key])
    return df.select(F.concat(F.col(key).cast("string"), F.lit(suffix)).alias("name"), F.to_json(fields, {"ignoreNullFields": "false", "pretty": "true"}).alias("content"))


def write_files(files: DataFrame, folder: str) -> int:
    """Writes (name, content) rows as files of these names, one line feed after each; returns their number.

    Contents are written by the tasks, through Spark's writer, so ``folder`` may be
    in any store that Spark knows; the driver then only renames. A file that is
    there is replaced; of rows with one name the last content in order stays.
    """
    spark = files.sparkSession
    parts = f"{folder.rstrip('/')}/.parts-{uuid.uuid4().hex}"
    files.groupBy("name").agg(F.max("content").alias("content")).write.partitionBy("name").text(parts)
    place, store = file_system(spark, parts)
    jvm, done = spark.sparkContext._jvm, 0
    for named in store.listStatus(place):
        if not named.isDirectory():
            continue
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(named.getPath().getName().partition("=")[2])
        for part in store.listStatus(named.getPath()):
            target = jvm.org.apache.hadoop.fs.Path(folder, name)
            store.delete(target, False)
            if not store.rename(part.getPath(), target):
                raise OSError(f"could not move a file to {folder}/{name}")
            done += 1
    store.delete(place, True)
    return done
