"""Provisions of cited documents: paths such as regulation 13(2)(a), an inverted index over them, and their state over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One item of a locator: a number with letters, dotted or bracketed parts, or bracketed parts alone.
ITEM = r"(?:[0-9]+[A-Z]{0,2}(?:\.[0-9]+)*(?:\s?\([0-9A-Za-z]{1,5}\))*|(?:\([0-9A-Za-z]{1,5}\))+|\b[IVXLC]+\b)"
KINDS = ("para", "regulation", "section", "chapter", "clause", "annexure")
GROUP = rf"(?i)\b({'|'.join(KINDS)})s?[\s-]+({ITEM}(?:\s*(?:,|and|or|to)\s*{ITEM})*)"
#: "clause (a) of regulation 13(2)" is regulation 13(2)(a).
NESTED = rf"(?i)\bclauses?\s+((?:\([0-9A-Za-z]{{1,5}}\))+)\s+of\s+(?:the\s+)?((?:regulation|section|para)s?\s+{ITEM})"
PART = r"[0-9]+[A-Za-z]*|[A-Za-z]+"

BUCKETS = 64


def paths(raw: Column) -> Column:
    """The provisions that a raw locator names: array of struct (kind, path), path an array of lower-case parts; null gives none.

    Every item of a list is a path of its own. What stands before a last "of"
    belongs to another document: "section 5 of the X Act read with regulation 13".
    """
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), NESTED, "$2$1"), r"(?is)^.*\bof\b", "")
    groups = F.arrays_zip(F.regexp_extract_all(plain, F.lit(GROUP), F.lit(1)).alias("kind"), F.regexp_extract_all(plain, F.lit(GROUP), F.lit(2)).alias("items"))

    def items(group: Column) -> Column:
        each = F.regexp_extract_all(group["items"], F.lit(rf"(?i){ITEM}"), F.lit(0))
        return F.transform(each, lambda i: F.struct(F.lower(group["kind"]).alias("kind"), F.transform(F.regexp_extract_all(i, F.lit(PART), F.lit(0)), F.lower).alias("path")))

    return F.array_distinct(F.flatten(F.transform(groups, items)))


def path_key(path: Column) -> Column:
    """A path as text that every path below it starts with: 13/2/a/."""
    return F.concat(F.array_join(path, "/"), F.lit("/"))


def prefixes(path: Column) -> Column:
    """A path and all above it, shortest first."""
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(path, 1, n))


def postings(edges: DataFrame) -> DataFrame:
    """One row for each provision that a mention names: entity, entity_id, kind, path, path_key, and the edge's other columns but its locators.

    Mentions without a locator, or with one that names no item, have none.
    """
    named = edges.withColumn("p", F.explode(F.array_distinct(F.flatten(F.transform(F.col("target_locators.raw"), paths))))).drop("target_locators")
    return named.select("*", "p.kind", "p.path").drop("p").filter(F.size("path") > 0).withColumn("path_key", path_key(F.col("path")))


def _bucket(entity: Column, kind: Column, first: Column) -> Column:
    return F.pmod(F.xxhash64(entity, kind, first), F.lit(BUCKETS)).cast("int")


class ProvisionIndex:
    """Postings in stored partitions: by a hash of entity, kind and first part, in each sorted by provision.

    A look-up reads one partition, and there the row groups whose keys can start
    with the path. A provision that most documents cite lies in several files of
    its partition, dealt by range with the citing document as last key.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, rows: DataFrame, mode: str = "overwrite") -> ProvisionIndex:
        keys = ["bucket", "entity_id", "kind", "path_key", "doc_key"]
        placed = rows.withColumn("bucket", _bucket(F.col("entity_id"), F.col("kind"), F.get("path", F.lit(0))))
        placed.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).partitionBy("bucket").parquet(self.path)
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def find(self, entity_id: int, kind: str, path: list[str]) -> DataFrame:
        """Postings of a provision and of all below it: 13 finds 13(2)(a), 1 does not find 13."""
        parts = [p.lower() for p in path]
        if not parts:
            raise ValueError("a provision has one part or more")
        bucket = self.spark.range(1).select(_bucket(F.lit(entity_id).cast("bigint"), F.lit(kind.lower()), F.lit(parts[0]))).first()[0]
        rows = self.spark.read.parquet(self.path).filter((F.col("bucket") == bucket) & (F.col("entity_id") == entity_id) & (F.col("kind") == kind.lower()))
        return rows.filter(F.col("path_key").startswith("/".join(parts) + "/")).drop("bucket")


def citations(rows: DataFrame) -> DataFrame:
    """For every provision, with all below it: entity, kind, provision, citing_documents, mentions."""
    each = rows.select("entity", "kind", F.explode(F.transform(prefixes(F.col("path")), path_key)).alias("provision"), "doc_key", "mention_id")
    once = each.groupBy("entity", "kind", "provision", "doc_key").agg(F.countDistinct("mention_id").alias("m"))
    return once.groupBy("entity", "kind", "provision").agg(F.count(F.lit(1)).alias("citing_documents"), F.sum("m").alias("mentions"))


# --- state over time -------------------------------------------------------------------


def changes(rows: DataFrame) -> DataFrame:
    """Amendments by provision: entity, kind, provision, direct, issued, doc_key.

    An amendment of 13(2)(a) changes that, directly, and with it 13(2) and 13.
    ``rows`` are postings with ``issued``, the citing document's date.
    """
    told = rows.filter("relation_type = 'amends_or_modifies' AND issued IS NOT NULL").select("entity", "kind", "path", "path_key", "issued", "doc_key").distinct()
    return told.select("entity", "kind", F.explode(F.transform(prefixes(F.col("path")), path_key)).alias("provision"), "path_key", "issued", "doc_key").select("entity", "kind", "provision", (F.col("provision") == F.col("path_key")).alias("direct"), "issued", "doc_key").distinct()


def validity(amendments: DataFrame) -> DataFrame:
    """Intervals of a provision's states: entity, kind, provision, since, until (null: still), amended_by.

    A state holds from its amendment's day to before the next one's; of several on
    one day the one by the largest doc_key holds.
    """
    day = amendments.groupBy("entity", "kind", "provision", F.col("issued").alias("since")).agg(F.max("doc_key").alias("amended_by"))
    return day.withColumn("until", F.lead("since").over(Window.partitionBy("entity", "kind", "provision").orderBy("since")))


def _as_of(asked: DataFrame, events: DataFrame, keys: list[str], period: str) -> DataFrame:
    """``asked`` (keys, on) with the latest of ``events`` (keys, since, amended_by) up to that day, in __s (struct since, amended_by) or null.

    Days meet events within one period, in one order and without pairs; what a
    period starts with is the last event of the periods before, of which a key
    has one row each. So a key that lives for decades is dealt by period.
    """
    told = F.struct("since", "amended_by")
    cut = lambda day: F.trunc(day, period)
    inside = events.withColumn("__p", cut(F.col("since")))
    lasts = inside.groupBy(*keys, "__p").agg(F.max(told).alias("__last"))
    # What each asked period starts with, over one row a period.
    periods = asked.select(*keys, cut(F.col("on")).alias("__p")).distinct().withColumn("__ask", F.lit(True))
    both = lasts.join(periods, [*keys, "__p"], "full_outer")
    before = F.last("__last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = both.withColumn("__start", before).filter("__ask").select(*keys, "__p", "__start")
    rows = asked.withColumn("__p", cut(F.col("on"))).withColumn("__e", F.lit(None).cast(lasts.schema["__last"].dataType)).withColumn("__day", F.col("on"))
    marks = inside.select(*keys, "__p", told.alias("__e"), F.col("since").alias("__day"))
    every = rows.unionByName(marks, allowMissingColumns=True)
    running = F.max("__e").over(Window.partitionBy(*keys, "__p").orderBy("__day").rangeBetween(Window.unboundedPreceding, 0))
    seen = every.withColumn("__s", running).filter("on IS NOT NULL").join(starts, [*keys, "__p"], "left")
    return seen.withColumn("__s", F.coalesce("__s", "__start")).drop("__p", "__e", "__day", "__start")


def states(asked: DataFrame, amendments: DataFrame, period: str = "month") -> DataFrame:
    """The state of provisions on days: ``asked`` (entity, kind, path, on) with amended_by and since, null before any amendment.

    What counts for a provision are amendments of itself and of its parts, and
    amendments that name a provision above it. Rows that ask the same are one.
    """
    asked = asked.select("entity", "kind", "path", "on").filter("on IS NOT NULL").distinct()
    own = asked.select("entity", "kind", path_key(F.col("path")).alias("provision"), "on", "path", F.lit(False).alias("above"))
    above = asked.select("entity", "kind", F.explode(F.transform(F.slice(prefixes(F.col("path")), 1, F.size("path") - 1), path_key)).alias("provision"), "on", "path", F.lit(True).alias("above"))
    events = amendments.select("entity", "kind", "provision", F.lit(False).alias("above"), F.col("issued").alias("since"), F.col("doc_key").alias("amended_by"))
    direct = amendments.filter("direct").select("entity", "kind", "provision", F.lit(True).alias("above"), F.col("issued").alias("since"), F.col("doc_key").alias("amended_by"))
    found = _as_of(own.unionByName(above.filter("provision IS NOT NULL")), events.unionByName(direct), ["entity", "kind", "provision", "above"], period)
    return found.groupBy("entity", "kind", "path", "on").agg(F.max("__s").alias("s")).select("entity", "kind", path_key(F.col("path")).alias("provision"), "on", "s.amended_by", "s.since")
