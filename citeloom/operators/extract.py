"""Paragraphs to citation findings, documents, alias bindings and mentions.

Everything is partitioned by ``doc_key``: one citing document's paragraphs are
ordered, and state that a sequential reader would carry along (first-seen
documents, alias bindings) is computed as of each paragraph instead.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import patterns as P
from citeloom.functions import text as T
from citeloom.operators import spans
from citeloom.storage import Kept

#: The pattern of citations by number.
CIRCULARS = 1
#: Most paragraphs, on average, of a part that a task orders or groups: what a task holds does not grow with the table.
PART_ROWS = 500_000
SPAN_LISTS = ("paragraphs", "regulations", "sections", "chapters", "annexures", "clauses")


def dealt(rows: DataFrame, parts: int | None = None, *keys: str) -> DataFrame:
    """Rows dealt out by citing document, or by ``keys``, into ``parts`` (None: Spark's own number).

    What is grouped, ordered or put together below a citing document needs no further shuffle.
    """
    by = keys or ("doc_key",)
    return rows.repartition(parts, *by) if parts else rows.repartition(*by)


def merge_split_dates(paragraphs: DataFrame) -> DataFrame:
    """Joins a paragraph that ends in "Month d," with a next one, on the same page, that starts with a year.

    Pairs are taken from the left: in a run of candidates every other one starts a pair.
    One order of a document's paragraphs tells all of it; no run leaves its page,
    as the last paragraph of a page is no candidate.
    """
    order = Window.partitionBy("doc_key").orderBy("page_number", "para_no")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = paragraphs.withColumn("text", T.compact("text"))
    rows = rows.select("*", F.lead(F.when(F.col("text").rlike(P.YEAR_START), F.col("text"))).over(order).alias("__next"), F.lead("page_number").over(order).alias("__page"), F.row_number().over(order).alias("__n"))
    starts = F.col("__next").isNotNull() & F.col("__page").eqNullSafe(F.col("page_number")) & F.col("text").endswith(",") & F.col("text").rlike(P.PARTIAL_DATE_END)
    rows = rows.withColumn("__c", F.coalesce(starts, F.lit(False)))
    # The last row before that is no candidate: a run starts after it.
    rows = rows.select("*", F.max(F.when(~F.col("__c"), F.col("__n"))).over(earlier).alias("__gap"), F.coalesce(F.lag("__c").over(order), F.lit(False)).alias("__after"))
    place = F.col("__n") - F.coalesce("__gap", F.lit(0))
    merged = F.when(F.col("__c") & (place % 2 == 1), F.concat_ws(" ", "text", "__next")).otherwise(F.col("text"))
    # The row before is the place - 1st of its run, if it is a candidate.
    second = F.col("__after") & (place % 2 == 0)
    return rows.filter(~second).select(*[merged.alias("text") if c == "text" else F.col(c) for c in paragraphs.columns])


def sequenced(paragraphs: DataFrame, merge_dates: bool = True) -> DataFrame:
    """Non-empty paragraphs with para_seq, their order in the document."""
    order = Window.partitionBy("doc_key").orderBy("page_number", "para_no")
    rows = merge_split_dates(paragraphs) if merge_dates else paragraphs.withColumn("text", T.compact("text"))
    return rows.filter("text <> ''").withColumn("para_seq", F.row_number().over(order).cast("int"))


def stitched(paragraphs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each page as one text: doc_key, page_number, unit (its first para_seq), text, marks (start, para_seq, para_no, says_this, size of each paragraph).

    Paragraphs are joined by a blank, or by a line feed after one that ends a
    sentence, which no title or locator crosses.
    """
    rows = dealt(paragraphs, parts, "doc_key", "page_number").groupBy("doc_key", "page_number").agg(F.array_sort(F.collect_list(F.struct("para_seq", _para_no(paragraphs), "text"))).alias("p"))
    gap = lambda p: F.when(p["text"].rlike("[.;:!?]$"), "\n").otherwise(" ")
    text = F.array_join(F.transform("p", lambda p: F.concat(p["text"], gap(p))), "")
    ends = spans.bound(F.transform("p", lambda p: F.length(p["text"]) + 1), spans.running_sums)
    mark = lambda p, end: F.struct((end - F.length(p["text"]) - 1).alias("start"), p["para_seq"].alias("para_seq"), p["para_no"].alias("para_no"), F.lower(p["text"]).contains("this circular").alias("says_this"), F.length(p["text"]).alias("size"))
    return rows.select("doc_key", "page_number", F.get("p", F.lit(0))["para_seq"].alias("unit"), text.alias("text"), F.zip_with("p", ends, mark).alias("marks"))


def _para_no(paragraphs: DataFrame) -> Column:
    """A paragraph's place on its page, null where the table does not have it."""
    return (F.col("para_no") if "para_no" in paragraphs.columns else F.lit(None)).cast("int").alias("para_no")


def _units(paragraphs: DataFrame, strict: bool, parts: int | None = None) -> DataFrame:
    """What patterns are searched in: paragraphs, or pages with ``marks``."""
    return stitched(paragraphs, parts) if strict else paragraphs.select("doc_key", "page_number", F.col("para_seq").alias("unit"), _para_no(paragraphs), "text")


def _place(start: Column, strict: bool) -> Column:
    """Struct (para_seq, para_no, says_this) of a match in a unit."""
    if strict:
        return F.element_at(F.filter("marks", lambda m: m["start"] <= start), -1)
    return F.struct(F.col("unit").alias("para_seq"), "para_no", F.lower("text").contains("this circular").alias("says_this"))


def _relation(strict: bool) -> Column:
    """The relation that a match's paragraph tells; ``at`` is its place."""
    return T.relation_type(F.substring(F.col("text"), F.col("at.start") + 1, F.col("at.size")) if strict else F.col("text"), strict)


def _searches(text: Column) -> list[tuple[str, Column]]:
    """(pattern, cheap guard): master circulars, circulars, instruments, notifications, in this order."""
    low = F.lower(text)
    return [
        (P.MASTER_CIRCULAR, low.contains("master") & low.contains("dated")), (P.CIRCULAR, low.contains("circular") & text.contains("/")),
        (P.INSTRUMENT, (low.contains("regulation") | low.contains("act")) & text.rlike(r"(?:19|20)\d{2}")), (P.NOTIFICATION, low.contains("notification") & low.contains("dated")),
    ]


FIELDS = ("document_type", "title", "short_title", "identifier", "date", "year", "issuing_body", "aliases", "title_source", "key", "match_text", "locators")


def _steps(strict: bool) -> list:
    """From a match to its finding: each step gives further columns by name, of those that are there (text, pattern, start, end, hit, and of earlier steps).

    In steps, as what a step gives is used more than once by the next ones and costs a search.
    """
    by = lambda c, *values: F.element_at(F.array(*[F.lit(v) for v in values]), c["pattern"] + 1)
    master, circular, instrument, notification = range(4)
    prefix, body, suffix = range(3)
    of = lambda c, part: F.get(c["parts"], F.lit(part))

    def groups(c) -> dict[str, Column]:
        is_a, part = lambda rank: c["pattern"] == rank, lambda pattern, i: F.regexp_extract(c["hit"], pattern, i)
        of_master = [F.when(is_a(master), part(P.MASTER_CIRCULAR, i)) for i in (1, 2, 4)]
        dated = F.when(is_a(master), part(P.MASTER_CIRCULAR, 3)).when(is_a(circular), T.extract(c["hit"], P.CIRCULAR, 2)).when(is_a(notification), part(P.NOTIFICATION, 2))
        named = F.when(is_a(circular), part(P.CIRCULAR, 1)).when(is_a(instrument), part(P.INSTRUMENT, 1)).when(is_a(notification), part(P.NOTIFICATION, 1))
        return {"found": F.array(*of_master), "day": dated, "said": named, "locator": T.locator_text(F.substring(c["text"], F.lit(1), c["start"]), strict)}

    def compacted(c) -> dict[str, Column]:
        return {"parts": F.transform(c["found"], T.compact), "day": T.compact(c["day"]), "said": T.compact(c["said"]), "raw": F.coalesce(T.compact(c["locator"]), F.lit("")), "bare": T.compact(c["hit"])}

    def names(c) -> dict[str, Column]:
        is_a = lambda rank: c["pattern"] == rank
        return {
            "given": F.when(is_a(circular), c["said"]).when(is_a(instrument), T.plural_regulations(c["bare"])).when(is_a(notification), F.initcap(c["said"])),
            "on": F.when(is_a(circular), T.strip(c["day"], " .,:;")).otherwise(c["day"]),
            "inside": F.array(F.when(is_a(master), T.extract(of(c, suffix), P.TRAILER_ALIAS, 1)).when(is_a(instrument), T.extract(F.substring(c["text"], c["end"] + 1, F.lit(40)), P.FOLLOWING_ALIAS, 1))),
            "trailer": F.when(is_a(master), T.extract(of(c, suffix), P.TRAILER, 1)),
        }

    def named(c) -> dict[str, Column]:
        is_a, given = lambda rank: c["pattern"] == rank, c["given"]
        return {
            "alias": F.get(F.transform(c["inside"], T.clean_alias), F.lit(0)),
            "document_type": F.when(is_a(instrument), T.document_type(given, strict)).otherwise(by(c, "master_circular", "circular", "", "notification")),
            "whole": F.when(is_a(master), T.master_circular_title(of(c, prefix), of(c, body), c["trailer"])).when(~is_a(circular), given),
            "code": F.when(is_a(circular), given),
            "year": F.when(is_a(instrument), c["said"].try_cast("int")).otherwise(T.parse_year(F.when(is_a(circular), F.coalesce(c["on"], given)).otherwise(c["on"]))),
        }

    def tidied(c) -> dict[str, Column]:
        is_a = lambda rank: c["pattern"] == rank
        dated = F.concat(F.lit("SEBI Circular "), c["given"], F.coalesce(F.concat(F.lit(" dated "), c["on"]), F.lit("")))
        short = F.when(is_a(master), F.coalesce(c["alias"], F.lit("Master Circular"))).when(is_a(circular), dated).when(is_a(notification), c["given"])
        return {"title": T.tidy_title(c["whole"]), "short": short}

    def told(c) -> dict[str, Column]:
        is_a = lambda rank: c["pattern"] == rank
        always = F.when(is_a(master), F.array(F.lit("Master Circular"))).otherwise(F.array().cast("array<string>"))
        return {
            "short_title": T.tidy_title(c["short"]), "identifier": T.tidy_title(c["code"]), "date": T.tidy_title(c["on"]),
            "issuing_body": F.when(~is_a(instrument) | F.upper(c["given"]).startswith(P.ISSUER), P.ISSUER), "aliases": F.when(c["alias"].isNull(), always).otherwise(F.concat(F.array(c["alias"]), always)),
            "title_source": by(c, "explicit_in_text", "not_present_in_text", "explicit_in_text", "generic_only"), "key": T.document_key(c["document_type"], c["title"], c["code"], c["on"], c["year"]),
            "match_text": F.when(is_a(master), F.regexp_replace(c["bare"], P.VERB_CUT, "")).otherwise(c["bare"]), "locators": T.located(c["raw"]),
        }

    return [groups, compacted, names, named, tidied, told]


def _ranked(rank: int):
    return lambda m, i: F.struct(F.lit(rank).alias("pattern"), i.alias("pos"), m["start"].alias("start"), m["end"].alias("end"), m["hit"].alias("hit"))


def text_findings(text: Column, strict: bool = False) -> Column:
    """All citations in full form of a text: array of struct (pattern, pos, start, end, the finding's fields, locators)."""
    lists = []
    for rank, (pattern, guard) in enumerate(_searches(text)):
        lists.append(F.when(guard, F.transform(spans.find_all(text, pattern), _ranked(rank))))
    spot = ("pattern", "pos", "start", "end")

    def told(known: dict[str, Column], steps: list) -> Column:
        if not steps:
            return F.struct(*[known[c].alias(c) for c in (*spot, *FIELDS)])
        more = steps[0](known)
        return spans.bound(F.struct(*[value.alias(name) for name, value in more.items()]), lambda g: told(known | {name: g[name] for name in more}, steps[1:]))

    return F.transform(F.flatten(F.array_compact(F.array(*lists))), lambda m: told({"text": text} | {c: m[c] for c in (*spot, "hit")}, _steps(strict)))


def explicit_findings(paragraphs: DataFrame, strict: bool = False, parts: int | None = None) -> DataFrame:
    """One row for each citation in full form, before overlaps are dropped: these make the documents.

    Columns doc_key, page_number, unit, para_seq, pattern, pos (order within a unit), start, end (in the unit), the finding's
    fields, locators, says_this. A unit is a paragraph; with ``strict`` it is a page, so that a citation that runs from one
    paragraph into the next is found, at the paragraph in which it starts.
    """
    return _told(paragraphs, strict, parts).select("doc_key", "page_number", "unit", "at.para_seq", "pattern", "pos", "start", "end", *FIELDS, "at.says_this")


def _told(paragraphs: DataFrame, strict: bool, parts: int | None) -> DataFrame:
    """Matches with all that the steps tell of them."""
    rows = spans.search(_units(paragraphs, strict, parts), _searches(F.col("text"))).withColumn("at", _place(F.col("start"), strict))
    for step in _steps(strict):
        rows = rows.withColumns(step({c: F.col(c) for c in rows.columns}))
    return rows


def citations(paragraphs: DataFrame, titles: DataFrame, strict: bool = False, parts: int | None = None) -> DataFrame:
    """Findings without their lists, for what is told of the whole archive: raw, the words of the locator, in place of locators; relation_type of the
    paragraph; counted, whether a finding lies in no other and does not mean the citing document itself.

    Of paragraphs that are dealt out by citing document this takes no further
    shuffle of them: only ``titles``, the citing documents' own (doc_key, title), are brought to them.
    """
    rows = _told(paragraphs, strict, parts).withColumn("relation_type", _relation(strict))
    names = ["key", "document_type", "title", "identifier", "date", "year", "aliases", "match_text", F.nullif("raw", F.lit("")).alias("raw"), "relation_type"]
    rows = rows.select("doc_key", "page_number", "unit", "at.para_seq", "at.para_no", "pattern", "pos", "start", "end", *names, "at.says_this")
    rows = rows.withColumn("__apart", spans.apart(["doc_key", "unit"], "pattern", "pos"))
    rows = rows.join(dealt(titles.filter("title <> ''").select("doc_key", F.col("title").alias("__title")), parts), "doc_key", "left")
    return rows.withColumn("counted", F.col("__apart") & ~_own("__title")).drop("__apart", "__title")


def _own(title: str) -> Column:
    return self_reference(F.col("match_text"), F.col("says_this"), F.coalesce(title, F.lit("")))


def numbered(findings: DataFrame) -> DataFrame:
    """Findings with document_no: the number, by first sight, of the document that they cite.

    Both orders are of a whole citing document, so its findings are dealt out once.
    """
    by_key = Window.partitionBy("doc_key").orderBy("key", "para_seq", "pattern", "pos")
    other = ~F.lag("key").over(by_key).eqNullSafe(F.col("key"))
    rows = findings.withColumn("__first", F.when(other, F.struct("para_seq", "pattern", "pos")))
    rows = rows.withColumn("__first", F.last("__first", ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("document_no", F.dense_rank().over(Window.partitionBy("doc_key").orderBy("__first"))).drop("__first")


def document_id(number: Column) -> Column:
    return F.format_string("doc_%03d", number)


def documents(findings: DataFrame, *also: Column, parts: int | None = None) -> DataFrame:
    """One row per cited document of each citing one: attributes as first seen, all aliases, number by first sight; and ``also``, named aggregates of its findings."""
    order = F.struct("para_seq", "pattern", "pos")
    fields = ["document_type", "title", "identifier", "date", "year", "issuing_body", "title_source"]
    # The first finding as one value: its place comes first in the struct, and no two have one.
    rows = dealt(findings, parts).groupBy("doc_key", "key").agg(
        F.min(F.struct("para_seq", "pattern", "pos", *fields)).alias("__seen"), F.min_by("short_title", F.when(F.col("short_title").isNotNull(), order)).alias("short_title"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"), *also,
    )
    rows = rows.select("*", *[F.col("__seen")[c].alias(c) for c in fields])
    number = F.row_number().over(Window.partitionBy("doc_key").orderBy("__seen.para_seq", "__seen.pattern", "__seen.pos"))
    more = [c for c in rows.columns if c not in {"doc_key", "key", "short_title", "aliases", "__seen", *fields}]
    rows = rows.withColumn("document_no", number).withColumn("document_id", document_id(number))
    return rows.select("doc_key", "document_id", "document_no", "key", "document_type", "title", "short_title", "identifier", "date", "year", "issuing_body", "aliases", "title_source", *more)


def _bound(findings: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_key, alias, para_seq, document_no, key: what each alias means from a paragraph on that binds it.

    Each finding of a document binds all aliases that the document has by then;
    a paragraph's last binding holds. The findings are read once: a document's own are
    gathered in one row, from which its aliases, and what binds them, are told.
    """
    at = F.struct("para_seq", "pattern", "pos").alias("at")
    rows = dealt(findings.select("doc_key", "key", at, "aliases"), parts).groupBy("doc_key", "key").agg(F.array_sort(F.collect_list(F.struct("at", "aliases"))).alias("events"))
    rows = rows.withColumn("document_no", F.row_number().over(Window.partitionBy("doc_key").orderBy(F.get("events", F.lit(0))["at"])))
    low = lambda aliases: F.transform(aliases, F.lower)
    named = rows.withColumn("alias", F.explode(F.array_distinct(low(F.flatten(F.transform("events", _field("aliases")))))))
    since = F.get(F.filter("events", lambda e: F.array_contains(low(e["aliases"]), F.col("alias"))), F.lit(0))["at"]
    each = named.select("doc_key", "alias", F.struct("document_no", "key").alias("document"), F.explode(F.filter(F.transform("events", _field("at")), lambda t: t >= since)).alias("at"))
    last = each.groupBy("doc_key", "alias", F.col("at.para_seq").alias("para_seq")).agg(F.max_by("document", "at").alias("document"))
    return last.select("doc_key", "alias", "para_seq", "document.document_no", "document.key")


def alias_bindings(findings: DataFrame) -> DataFrame:
    """Which document an alias means, from which paragraph to before which: doc_key, alias, document_id, from_seq, to_seq."""
    until = F.lead("para_seq").over(Window.partitionBy("doc_key", "alias").orderBy("para_seq"))
    return _bound(findings).select("doc_key", "alias", document_id(F.col("document_no")).alias("document_id"), F.col("para_seq").alias("from_seq"), F.coalesce(until, F.lit(2147483647)).alias("to_seq"))


def kept_findings(findings: DataFrame) -> DataFrame:
    return spans.drop_contained(findings, ["doc_key", "unit"], "pattern", "pos")


def alias_findings(paragraphs: DataFrame, findings: DataFrame, strict: bool = False, parts: int | None = None) -> DataFrame:
    """Uses of bound aliases that overlap no full citation: doc_key, unit, para_seq, start, end, document_no, document_id, alias, match_text, says_this, raw (null for none), locators, key, page_number, para_no, relation_type.

    A unit is searched for its document's aliases at once, and only what is
    found goes on. A use takes the last binding up to its paragraph: bindings and
    uses of an alias are put in one order and the document is carried along, so
    the work grows with their number, not with the product. Uses and citations of
    a unit are put in one order as well: of the citations that start before a use
    ends, the furthest end tells whether one overlaps it; those that lie in
    others change nothing there. Through these orders go the words of a locator; its lists are told of what is left.
    """
    text = F.col("text")
    named = findings.select("doc_key", F.explode("aliases").alias("alias")).select("doc_key", F.lower("alias").alias("alias"))
    names = dealt(named, parts).groupBy("doc_key").agg(F.collect_set("alias").alias("names"))
    units = dealt(_units(paragraphs, strict, parts), parts).join(names, "doc_key").withColumn("low", F.lower(text)).withColumn("names", F.filter("names", lambda n: F.col("low").contains(n)))
    met = units.filter(F.size("names") > 0).drop("low").withColumn("alias", F.explode("names")).drop("names")
    quoted = F.concat(F.lit("(?iU)\\b\\Q"), "alias", F.lit("\\E\\b"))
    uses = spans.search(met, [(quoted, F.lit(True))]).withColumn("at", _place(F.col("start"), strict))
    uses = uses.withColumns({"match_text": T.compact("hit"), "locator": T.locator_text(F.substring(text, F.lit(1), F.col("start")), strict)})
    uses = uses.withColumn("raw", F.nullif(T.compact("locator"), F.lit("")))
    uses = uses.select("doc_key", "alias", "at.para_seq", F.struct("unit", "start", "end", "match_text", "at.says_this", "raw", "page_number", "at.para_no", _relation(strict).alias("relation_type")).alias("use"))
    bound = _bound(findings, parts).select("doc_key", "alias", "para_seq", F.lit(None).cast(uses.schema["use"].dataType).alias("use"), F.struct("document_no", "key").alias("document"))
    events = uses.withColumn("document", F.lit(None).cast(bound.schema["document"].dataType)).unionByName(bound)
    # Bindings come first at their paragraph: nulls do.
    last = Window.partitionBy("doc_key", "alias").orderBy("para_seq", F.col("use").isNotNull()).rangeBetween(Window.unboundedPreceding, 0)
    carried = events.withColumn("document", F.last("document", ignorenulls=True).over(last)).filter("use IS NOT NULL AND document IS NOT NULL")
    carried = carried.select("doc_key", "use.unit", (F.col("use.end") - 1).alias("__at"), F.lit(None).cast("int").alias("__end"), F.struct("para_seq", "alias", "document", "use").alias("__use"))
    cited = dealt(findings.select("doc_key", "unit", F.col("start").alias("__at"), F.col("end").alias("__end")), parts).withColumn("__use", F.lit(None).cast(carried.schema["__use"].dataType))
    furthest = F.max("__end").over(Window.partitionBy("doc_key", "unit").orderBy("__at").rangeBetween(Window.unboundedPreceding, 0))
    free = carried.unionByName(cited).withColumn("__end", furthest).filter("__use IS NOT NULL").filter(F.col("__end").isNull() | (F.col("__end") <= F.col("__use.use.start")))
    told = ("match_text", "says_this", "raw", "page_number", "para_no", "relation_type")
    found = free.select("doc_key", "unit", "__use.para_seq", "__use.use.start", "__use.use.end", "__use.document.*", "__use.alias", *[f"__use.use.{c}" for c in told])
    rows = spans.drop_contained(found, ["doc_key", "unit"], "alias")
    locators = T.located(F.coalesce("raw", F.lit(""))).alias("locators")
    return rows.select("doc_key", "unit", "para_seq", "start", "end", "document_no", document_id(F.col("document_no")).alias("document_id"), "alias", "match_text", "says_this", "raw", locators, "key", "page_number", "para_no", "relation_type")


def self_reference(match: Column, says_this: Column, source_title: Column) -> Column:
    """Whether a match means the citing document itself; ``says_this``: its paragraph has the words "this circular"."""
    low = F.lower(match)
    own = F.coalesce((source_title != "") & low.contains(F.lower(T.compact(source_title))), F.lit(False))
    return low.contains("this circular") | (low.startswith("annexure-a") & says_this) | own


def _field(name: str):
    return lambda x: x[name]


def merged_locators(ordered: Column) -> Column:
    """Union of locator structs in order, each value once; raw as a list, or null."""
    lists = [F.array_distinct(F.flatten(F.transform(ordered, _field(n)))).alias(n) for n in SPAN_LISTS]
    raw = F.array_distinct(F.filter(F.transform(ordered, lambda x: x["raw"]), lambda r: r.isNotNull()))
    return F.struct(F.when(F.size(raw) > 0, raw).alias("raw"), *lists)


def _target(items: Column) -> Column:
    """The merged locators of ordered items, of the words (raw) that these have: words that repeat are read once."""
    raws = F.array_distinct(F.filter(F.transform(items, _field("raw")), lambda r: r.isNotNull()))
    return spans.bound(F.transform(raws, T.located), merged_locators)


def mentions(paragraphs: DataFrame, findings: DataFrame, aliased: DataFrame, titles: DataFrame, strict: bool = False, parts: int | None = None) -> DataFrame:
    """One row per paragraph and cited document, numbered in reading order; ``titles`` are the citing documents' own (doc_key, title).

    All is dealt out by citing document until the mentions have their numbers; the
    paragraphs' texts come last. How sure a mention by full citation is follows
    from what the key of its document holds, and so from any finding of it.
    """
    columns = ["doc_key", "para_seq", "document_no", "alias_only", "start", "end", "match_text", "says_this", "raw", "sure"]
    known = findings.select("doc_key", "unit", "pattern", "pos", "para_seq", "key", "start", "end", "match_text", "says_this", "locators.raw", "document_type", "title", "identifier", "date")
    sure = lambda alias_only: T.confidence(F.lit(alias_only), F.col("document_type"), F.col("title"), F.col("identifier"), F.col("date"))
    full = kept_findings(numbered(dealt(known, parts)).drop("key")).withColumn("alias_only", F.lit(False)).withColumn("sure", sure(False)).select(*columns)
    none = {c: F.lit(None).cast("string") for c in ("document_type", "title", "identifier", "date")}
    short = dealt(aliased, parts).withColumns({"alias_only": F.lit(True)} | none).withColumn("sure", sure(True)).select(*columns)
    order = F.struct("alias_only", "start", (-F.col("end")).alias("e"))
    found = full.unionByName(short).join(dealt(titles.filter("title <> ''").select("doc_key", F.col("title").alias("source_title")), parts), "doc_key", "left")
    found = found.filter(~_own("source_title"))
    # The first item is a full citation, if there is one.
    grouped = found.groupBy("doc_key", "para_seq", "document_no").agg(
        F.array_sort(F.collect_set("match_text")).alias("match_texts"), F.array_sort(F.collect_list(F.struct(order.alias("o"), "raw", "sure"))).alias("items"),
    )
    rows = grouped.withColumn("__n", F.row_number().over(Window.partitionBy("doc_key").orderBy("para_seq", "document_no")))
    rows = rows.join(dealt(paragraphs.select("doc_key", "para_seq", "page_number", "paragraph_id", "text"), parts, "doc_key", "para_seq"), ["doc_key", "para_seq"])
    return rows.select(
        "doc_key", F.format_string("ref_%03d", "__n").alias("mention_id"), document_id(F.col("document_no")).alias("document_id"), F.col("page_number").alias("source_page"), F.col("paragraph_id").alias("source_paragraph_id"), "match_texts",
        F.col("text").alias("evidence_text"), T.relation_type(F.col("text"), strict).alias("relation_type"), _target(F.col("items")).alias("target_locators"), F.get("items", F.lit(0))["sure"].alias("sure"),
    ).select("*", "sure.*").drop("sure")


def cited(citations: DataFrame, aliased: DataFrame | None, titles: DataFrame, located: bool = False) -> DataFrame:
    """What ``mentions`` has, by key and without numbers and texts: one row per paragraph and cited document, with doc_key, para_seq, key, source_page,
    relation_type and raws, the words of its locators; with ``located`` those that have such words.

    Rows are dealt out once, by citing document; ``aliased`` is None where there are no aliases.
    """
    columns = ["doc_key", "para_seq", "key", F.col("page_number").alias("source_page"), "relation_type"]
    found = citations.filter("counted").select(*columns, "raw")
    if aliased is not None:
        found = found.unionByName(_others(aliased, titles).select(*columns, "raw"))
    found = found.filter("raw IS NOT NULL") if located else found
    return found.groupBy("doc_key", "para_seq", "key", "source_page", "relation_type").agg(F.array_sort(F.collect_set("raw")).alias("raws"))


def _others(aliased: DataFrame, titles: DataFrame) -> DataFrame:
    """Uses of aliases that do not mean the citing document itself."""
    return aliased.join(titles.filter("title <> ''").select("doc_key", F.col("title").alias("__title")), "doc_key", "left").filter(~_own("__title"))


def named_mentions(citations: DataFrame, aliased: DataFrame | None, titles: DataFrame, parts: int | None = None) -> DataFrame:
    """What ``mentions`` has, by key and with what the key's document is called, without numbers and evidence: one row per paragraph and cited document, with
    doc_key, key, para_seq, para_no, source_page, relation_type, document_type and title as first seen, match_texts, target_locators, confidence.

    One group of a citing document's findings tells its documents and mentions at
    once: a document's first finding, counted or not, comes no later than any use of its aliases.
    """
    columns = ["doc_key", "key", "para_seq", "para_no", F.col("page_number").alias("source_page"), "relation_type"]
    seen = F.struct("pattern", "pos", "document_type", "title").alias("seen")
    sure = F.when(F.col("counted"), T.confidence(F.lit(False), F.col("document_type"), F.col("title"), F.col("identifier"), F.col("date"))["confidence"]).alias("sure")
    found = citations.select(*columns, "counted", F.lit(False).alias("alias_only"), "start", "end", "match_text", "raw", seen, sure)
    if aliased is not None:
        none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("seen", "sure")]
        short = _others(aliased, titles).select(*columns, F.lit(True).alias("counted"), F.lit(True).alias("alias_only"), "start", "end", "match_text", "raw", *none)
        found = found.unionByName(short)
    item = F.when(F.col("counted") & F.col("raw").isNotNull(), F.struct("alias_only", "start", (-F.col("end")).alias("e"), "raw"))
    grouped = dealt(found, parts).groupBy("doc_key", "key", "para_seq", "para_no", "source_page", "relation_type").agg(
        F.min("seen").alias("seen"), F.array_sort(F.collect_set(F.when(F.col("counted"), F.col("match_text")))).alias("match_texts"), F.array_sort(F.collect_list(item)).alias("items"), F.max("sure").alias("sure"), F.max("counted").alias("counted"),
    )
    by_then = Window.partitionBy("doc_key", "key").orderBy("para_seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = grouped.withColumn("seen", F.first("seen", ignorenulls=True).over(by_then)).filter("counted")
    return rows.select(
        "doc_key", "key", "para_seq", "para_no", "source_page", "relation_type", "seen.document_type", "seen.title", "match_texts", _target(F.col("items")).alias("target_locators"), F.coalesce("sure", F.lit(P.CONFIDENCE["alias"][0])).alias("confidence")
    )


def first_pages(paragraphs: DataFrame) -> DataFrame:
    """Circular number, first date and subject of page 1, for citing documents that have one."""
    return _headed(paragraphs.filter("page_number = 1").groupBy("doc_key").agg(F.collect_list(F.struct("para_no", "text")).alias("p")))


def _headed(rows: DataFrame) -> DataFrame:
    """``rows`` with what their first page, the paragraphs in p, says of the document."""
    others = [c for c in rows.columns if c != "p"]
    page = rows.select(*others, T.compact(F.array_join(F.transform(F.array_sort("p"), _field("text")), " ")).alias("t"))
    return page.select(
        *others, T.extract(F.col("t"), P.CIRCULAR_NUMBER, 1).alias("circular_number"), T.extract(F.col("t"), f"{P.I}{P.DATE}").alias("issue_date"), T.strip(T.extract(F.col("t"), P.SUBJECT, 1), " .").alias("title")
    )


def source_metadata(paragraphs: DataFrame) -> DataFrame:
    """Per citing document: circular number, first date and subject of page 1, and the page count."""
    first = F.when(F.col("page_number") == 1, F.struct("para_no", "text"))
    return _headed(paragraphs.groupBy("doc_key").agg(F.max("page_number").alias("page_count"), F.collect_list(first).alias("p")))


def summary(numbered: DataFrame, mentioned: DataFrame) -> DataFrame:
    docs = numbered.groupBy("doc_key").agg(F.count(F.lit(1)).alias("referenced_document_count"))
    refs = mentioned.groupBy("doc_key").agg(F.count(F.lit(1)).alias("reference_mention_count"), F.array_sort(F.collect_set("source_page")).alias("pages_with_references"))
    return docs.join(refs, "doc_key", "full_outer").select(
        "doc_key", F.coalesce("referenced_document_count", F.lit(0)).alias("referenced_document_count"), F.coalesce("reference_mention_count", F.lit(0)).alias("reference_mention_count"),
        F.coalesce("pages_with_references", F.array().cast("array<int>")).alias("pages_with_references"),
    )


class Extraction:
    """The tables of one extraction; ``paragraphs`` has doc_key, page_number, para_no, paragraph_id, text.

    A table is made when it is first asked for. With ``store`` the sequenced
    paragraphs, the findings, the documents, the alias uses and the mentions are
    each computed once, written to shared storage and read back, so no plan
    searches a text twice and a lost executor costs no earlier step; ``close()``
    removes them. Without it every table is a lazy plan down to the paragraphs.
    ``strict`` mends what the compatible rules miss or take wrongly: citations
    across paragraphs of a page, dotted locators, kinds and relations by whole words.
    ``parts`` tells that the paragraphs come dealt out by citing document into so many.
    """

    def __init__(self, paragraphs: DataFrame, merge_dates: bool = True, store: bool = True, strict: bool = False, parts: int | None = None):
        self._given, self._merge_dates, self._strict, self._dealt = paragraphs, merge_dates, strict, parts
        self._store = Kept(paragraphs.sparkSession) if store else None

    def _once(self, df: DataFrame) -> DataFrame:
        return self._store(df) if self._store else df

    @cached_property
    def sources(self) -> DataFrame:
        return source_metadata(self._given)

    @cached_property
    def parts(self) -> int | None:
        """How many parts rows are dealt into, by the number of paragraphs; None where Spark's own number is no smaller."""
        if self._dealt or not self._store:
            return self._dealt
        parts = -(-self._given.count() // PART_ROWS)
        return parts if parts > int(self._given.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None

    def _sequenced(self) -> DataFrame:
        return sequenced(dealt(self._given, self.parts) if self.parts and not self._dealt else self._given, self._merge_dates)

    @cached_property
    def paragraphs(self) -> DataFrame:
        return self._once(self._sequenced())

    @cached_property
    def findings(self) -> DataFrame:
        return self._once(explicit_findings(self.paragraphs, self._strict, self.parts))

    @cached_property
    def heads(self) -> DataFrame:
        """Numbers, dates and titles of the citing documents that have a first page."""
        return self._once(first_pages(self._given))

    @cached_property
    def citations(self) -> DataFrame:
        """Of the given paragraphs, in the pass that puts them in order: neither is stored between."""
        return self._once(citations(self._sequenced(), self.heads.select("doc_key", "title"), self._strict, self.parts))

    @cached_property
    def _uses(self) -> DataFrame | None:
        """Uses of aliases. Only where a citation gives an alias are the paragraphs stored and searched for them."""
        if self.citations.filter(F.size("aliases") > 0).isEmpty():
            return None
        # Where the given paragraphs are dealt out they are put in order again, which shuffles no text; stored ones would be dealt out once more.
        paragraphs = self._sequenced() if self._dealt else self.paragraphs
        return self._once(alias_findings(paragraphs, self.citations, self._strict, self.parts))

    def named(self) -> DataFrame:
        """Mentions by key with their documents' kinds and titles, not stored."""
        return named_mentions(self.citations, self._uses, self.heads.select("doc_key", "title"), self.parts)

    def cited(self, located: bool = False) -> DataFrame:
        """Mentions by key, not stored: each plan computes what it asks for."""
        return cited(self.citations, self._uses, self.heads.select("doc_key", "title"), located)

    @cached_property
    def documents(self) -> DataFrame:
        return self._once(documents(self.findings, parts=self.parts))

    @cached_property
    def kept(self) -> DataFrame:
        return kept_findings(dealt(self.findings, self.parts))

    @cached_property
    def bindings(self) -> DataFrame:
        return alias_bindings(self.findings)

    @cached_property
    def aliased(self) -> DataFrame:
        return self._once(alias_findings(self.paragraphs, self.findings, self._strict, self.parts))

    @cached_property
    def mentions(self) -> DataFrame:
        # Of the stored paragraphs: they make the same first pages as the given ones.
        titles = first_pages(self.paragraphs).select("doc_key", "title")
        return self._once(mentions(self.paragraphs, self.findings, self.aliased, titles, self._strict, self.parts))

    @cached_property
    def summary(self) -> DataFrame:
        return summary(self.documents, self.mentions)

    def close(self) -> None:
        if self._store:
            self._store.close()
