"""Match spans: recovery of offsets, containment and overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMPTY = "array<struct<start:int,end:int,hit:string>>"
#: A character that is set aside for use inside programs.
_MARK = "\ufdd0"
#: Distances at which running sums are doubled; arrays are shorter than the last one's double.
_POWERS = [1 << k for k in range(31)]


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a one-element array binds it to a variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Inclusive prefix sums of an array, by doubling: a pass for each power of two below its size."""
    needed = F.filter(F.array(*[F.lit(p) for p in _POWERS]), lambda p: p < F.size(numbers))
    return F.aggregate(needed, numbers, lambda sums, p: F.transform(sums, lambda x, i: x + F.when(i >= p, F.get(sums, i - p)).otherwise(F.lit(0))))


def _parts(text: Column, regex: Column) -> Column:
    """A text cut before and after every match: gaps and matches in turns."""
    # A text that holds the mark is split at the pattern instead: gaps and hits in turns, as between marks.
    apart = lambda gaps, hits: F.flatten(F.zip_with(gaps, hits, lambda g, h: F.when(h.isNull(), F.array(g)).otherwise(F.array(g, h))))
    marked = F.split(F.regexp_replace(text, regex, F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    return F.when(text.contains(_MARK), apart(F.split(text, regex, -1), F.regexp_extract_all(text, regex, F.lit(0)))).otherwise(marked)


def _placed(parts: Column) -> Column:
    """The matches among parts with their offsets; null for none."""
    ends = bound(F.transform(parts, lambda part: F.length(part)), running_sums)
    spans = F.zip_with(ends, parts, lambda end, h: F.struct((end - F.length(h)).alias("start"), end.alias("end"), h.alias("hit")))
    return F.when(F.size(parts) > 1, F.filter(spans, lambda s, i: i % 2 == 1))


def find_all(text: Column, pattern: str | Column) -> Column:
    """All matches of a pattern that cannot be empty: array of (start, end, hit), offsets from 0, end exclusive.

    Spark gives matches without offsets; the gaps between them restore these: a
    match ends where the lengths of all gaps and matches so far sum up to. Every
    match is put between marks and the text is cut there, which compiles no
    pattern anew for each row, as a split at the pattern would.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.coalesce(bound(_parts(text, regex), _placed), F.from_json(F.lit("[]"), EMPTY))


def search(rows: DataFrame, searches: list[tuple[str | Column, Column]]) -> DataFrame:
    """``rows`` once for each match in their ``text``, with pattern (its place in ``searches``), pos, start, end, hit.

    ``searches`` are (pattern, guard): a text is searched where the guard holds.
    As ``find_all``, but in steps between which rows without a match are gone and
    Spark compiles what is left; a text's only match needs no sums.
    """
    regex = lambda p: F.lit(p) if isinstance(p, str) else p
    cut = [F.struct(F.lit(i).alias("pattern"), F.when(guard, _parts(F.col("text"), regex(p))).alias("parts")) for i, (p, guard) in enumerate(searches)]
    # Outer explodes, as plain ones make Spark infer a filter on the array's size, which searches each text once more.
    each = rows.withColumn("__cut", F.array(*cut)).select(*rows.columns, F.explode_outer("__cut").alias("__c")).filter(F.get("__c.parts", F.lit(1)).isNotNull())
    parts = F.col("__c.parts")
    before = F.length(F.get(parts, F.lit(0)))
    only = F.array(F.struct(before.alias("start"), (before + F.length(F.get(parts, F.lit(1)))).alias("end"), F.get(parts, F.lit(1)).alias("hit")))
    placed = each.select(*rows.columns, F.col("__c.pattern").alias("pattern"), F.when(F.size(parts) == 3, only).otherwise(_placed(parts)).alias("__all"))
    return placed.select(*rows.columns, "pattern", F.posexplode_outer("__all").alias("pos", "__m")).select(*rows.columns, "pattern", "pos", "__m.*")


def drop_contained(findings: DataFrame, within: list[str], *tie: str) -> DataFrame:
    """Findings that do not lie inside another of their group (earlier start, or same start and longer, or earlier by ``tie``).

    Sorted that way a span lies inside a kept one exactly if it ends no later
    than the furthest end before it: its container, if dropped itself, lies in
    one that is kept.
    """
    return findings.withColumn("__apart", apart(within, *tie)).filter("__apart").drop("__apart")


def apart(within: list[str], *tie: str) -> Column:
    """Whether ``drop_contained`` keeps a finding."""
    before = Window.partitionBy(*within).orderBy("start", F.col("end").desc(), *tie).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.col("end") > F.max("end").over(before), F.lit(True))


def overlaps_none(start: Column, end: Column, spans: Column) -> Column:
    """Whether [start, end) overlaps no (start, end) of an array; null counts as no spans."""
    return ~F.coalesce(F.exists(spans, lambda s: (start < s["end"]) & (s["start"] < end)), F.lit(False))
