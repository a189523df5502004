"""What an archive of numbered circulars lacks: serial numbers without a document, cited documents without one, documents that nobody cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.graph import identifier_form


def numbered(value: Column) -> Column:
    """An identifier as struct (series, year, serial): the last part is the serial number, the last four-digit year among the others the year, the rest the series; null without either."""
    parts = F.split(identifier_form(value), r"\|")
    whole = F.get(parts, F.size(parts) - 1)
    before = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    years = F.filter(before, lambda p: p.rlike("^(?:19|20)[0-9]{2}$"))
    year = F.get(years, F.size(years) - 1)
    series = F.array_join(F.filter(before, lambda p: p != year), "/")
    fits = whole.rlike("^[0-9]{1,9}$") & year.isNotNull()
    return F.when(fits, F.struct(series.alias("series"), year.cast("int").alias("year"), whole.cast("int").alias("serial")))


def missing_ranges(numbers: DataFrame) -> DataFrame:
    """Gaps between serial numbers of a series and year: series, year, first, last, missing.

    ``numbers`` has a column identifier. Serials that follow one another are an
    island; between two neighbours that do not, a range is missing. Nothing is
    known to be missing before the first or after the last one. Identifiers
    without a serial number and year take no part; repeated ones count once.
    """
    told = numbers.select(numbered(F.col("identifier")).alias("n")).filter("n IS NOT NULL").select("n.*").distinct()
    after = F.lead("serial").over(Window.partitionBy("series", "year").orderBy("serial"))
    gaps = told.withColumn("next", after).filter(F.col("next") > F.col("serial") + 1)
    return gaps.select("series", "year", (F.col("serial") + 1).alias("first"), (F.col("next") - 1).alias("last"), (F.col("next") - F.col("serial") - 1).alias("missing"))


def cited_but_missing(cited: DataFrame, own: DataFrame) -> DataFrame:
    """Identifiers that documents cite and no document bears: code, citing_documents. Both tables have doc_key and identifier."""
    bears = own.select(identifier_form("identifier").alias("code")).distinct()
    told = cited.select("doc_key", identifier_form("identifier").alias("code")).filter("code <> ''")
    return told.join(bears, "code", "left_anti").groupBy("code").agg(F.countDistinct("doc_key").alias("citing_documents"))


def orphans(cited: DataFrame, own: DataFrame) -> DataFrame:
    """Documents whose number no other document cites: doc_key, identifier. A document's citation of itself does not count."""
    told = cited.select("doc_key", identifier_form("identifier").alias("code")).filter("code <> ''")
    # One row a code: if its first and last citing document are the bearer itself, no other one cites it.
    told = told.groupBy("code").agg(F.min("doc_key").alias("first"), F.max("doc_key").alias("last"))
    rows = own.select("doc_key", "identifier", identifier_form("identifier").alias("code"))
    other = (rows["doc_key"] != told["first"]) | (rows["doc_key"] != told["last"])
    return rows.join(told, (rows["code"] == told["code"]) & other, "left_anti").select("doc_key", "identifier")
