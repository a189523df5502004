"""Operator 1, line dedup by a deletion-neighbourhood join, edit bound 1.

Lines are what newlines separate. A line goes if an earlier line (by document
id, then position) is equal to it or, if both have ``min_near`` characters or
more, within one insertion, deletion or substitution (1 compares all lines so;
the default, 16, spares short ones, where one edit is often another word). The earliest of each such pair stays, so
what a line is compared with is every earlier line, dropped ones too. Blank
lines are never dropped.

1. Equal lines meet by a 128-bit hash and count; texts do not move.
2. Two lines within one edit agree outside the half that holds it. Lines whose
   halves, by hash, nobody shares have no neighbour and leave; the same again
   with BLOCKS parts of the rest. Nothing is lost by this.
3. The rest emit their deletion variants within the shared parts as hashed
   keys: (variant, position) meets in substitutions, (variant) meets the line
   that is the variant. Each key yields its earliest line only, by
   pre-aggregation: two lines that share (variant, position) are within one
   substitution of each other, so the earliest is a neighbour of all others;
   the line that equals a variant is one.
4. Pairs are verified by edit distance on the texts.

Defined results: null text counts as empty, with no lines to drop; rows with a
null id come after all others and, like rows that repeat an id, are told apart
by their text's hash; rows that repeat in full lose the same lines (an equal
line at the same place is not earlier). Line ends other than newline belong to
the line. An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import BROADCAST_IDS, join_groups, save, text_of
from citeloom.operators.spans import bound

#: Characters from which lines may differ by an edit; parts of a line in the second round.
MIN_NEAR, BLOCKS = 16, 16

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_UNBASE = np.uint64(pow(_BASE, -1, 1 << 64))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, tx, line_no (from 0), line: the lines that are not blank."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tx"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return rows.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _place(df: DataFrame) -> Column:
    """Order of lines: id with null last, position, text hash."""
    return F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("line_no").alias("line_no"), F.col("tx").alias("tx"))


def _half_keys() -> Column:
    """For L, the shorter length of a pair (own, or own - 1): the hash of what lies outside each half."""
    keys = []
    for less in (0, 1):
        size = F.col("n") - less
        mid = F.floor(size / 2).cast("int")
        keys.append(F.struct(F.lit(0).alias("half"), F.xxhash64(size, F.lit(0), F.expr(f"right(line, cast(n - {less} - floor((n - {less}) / 2) as int))")).alias("key")))
        keys.append(F.struct(F.lit(1).alias("half"), F.xxhash64(size, F.lit(1), F.substring(F.col("line"), F.lit(1), mid)).alias("key")))
    return F.array(*keys)


# --- deletion variants, in numpy ----------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(_BASE))
    out[0] = 1
    return np.cumprod(out)


def _sums(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points, and running sums G[i] of symbol * base**position, from which the hash of any variant follows."""
    symbols = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    weighted = _mix(symbols.astype(np.uint64) * _GOLD + _GOLD) * _powers(len(symbols))[: len(symbols)]
    return symbols, np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)])


def _cuts(size: int, parts: int) -> np.ndarray:
    return np.arange(parts + 1) * size // parts


def block_keys(line: str, parts: int = BLOCKS) -> list[tuple[int, int, int]]:
    """(less, part, key) for L = n - less: the hash of what lies outside each part of a pair of shorter length L."""
    symbols, g = _sums(line)
    n, out = len(symbols), []
    for less in (0, 1):
        size = n - less
        cut = _cuts(size, parts)
        tail = size - cut[1:]  # symbols after the part, taken from the end
        back = (g[n] - g[n - tail]) * _inverse_powers(n - tail)
        keys = _mix(_mix(g[cut[:-1]] * _GOLD + back) * _GOLD + np.uint64(size) * np.uint64(64) + np.arange(parts, dtype=np.uint64))
        out += [(less, j, k) for j, k in enumerate(keys.view(np.int64).tolist())]
    return out


def _inverse_powers(exponents: np.ndarray) -> np.ndarray:
    top = int(exponents.max(initial=0))
    out = np.full(top + 1, _UNBASE)
    out[0] = 1
    return np.cumprod(out)[exponents]


def variant_keys(line: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the variants that delete one symbol at a position within ``spans``: (kinds, keys).

    Kind 0: the line itself, 1: a variant, 2: a variant and its position.
    """
    symbols, g = _sums(line)
    n = len(symbols)
    at = np.unique(np.concatenate([np.arange(max(0, a), min(n, b)) for a, b in spans])) if spans else np.empty(0, int)
    variant = g[at] + (g[n] - g[at + 1]) * _UNBASE
    fresh = (at == 0) | (symbols[at] != symbols[at - 1]) | ~np.isin(at - 1, at)
    whole = _mix(g[n : n + 1] * _GOLD)
    plain, placed = _mix(variant[fresh] * _GOLD), _mix(variant * _GOLD + (at + 1).astype(np.uint64))
    kinds = np.concatenate([np.zeros(1, np.int32), np.ones(len(plain), np.int32), np.full(len(placed), 2, np.int32)])
    return kinds, np.concatenate([whole, plain, placed]).view(np.int64)


# --- the operator -----------------------------------------------------------------------


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs more than once; counts are pre-aggregated, and skewed keys split, by Spark."""
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1").drop("__c")
    return rows.join(twice, keys, "left_semi")


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_near: int = MIN_NEAR) -> DataFrame:
    """One row for each line that goes: id, tx, line_no, keep_id, keep_line, distance (0 or 1)."""
    lines = lines_of(docs, id_col, text_col).select(
        "id", "tx", "line_no", "line", F.length("line").alias("n"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")
    )
    slim = lines.select("id", "tx", "line_no", "n", "h1", "h2", F.when(F.col("n") >= min_near, _half_keys()).alias("halves"))
    distinct = slim.groupBy("h1", "h2").agg(F.min(_place(slim)).alias("first"), F.count(F.lit(1)).alias("c"), F.any_value("n").alias("n"), F.any_value("halves").alias("halves"))
    distinct = save(distinct, "lines")

    # Near lines. A distinct line is named by (h1, h2).
    halves = distinct.select("h1", "h2", F.inline("halves"))
    halves = _shared(halves.distinct(), ["key"]).select("h1", "h2").distinct()
    some = save(distinct.join(halves, ["h1", "h2"], "left_semi").select("h1", "h2", "first"), "line-some")
    count = some.count()
    places = some.select("h1", "h2", F.col("first.id").alias("f_id"), F.col("first.line_no").alias("f_no"), F.col("first.tx").alias("f_tx"))
    places = F.broadcast(places) if count <= BROADCAST_IDS // 4 else places
    texts = lines.select("id", "tx", "line_no", "line", F.col("h1").alias("a1"), F.col("h2").alias("a2")).join(
        places, (F.col("a1") == F.col("h1")) & (F.col("a2") == F.col("h2")) & (F.col("line_no") == F.col("f_no")) & (F.col("tx") == F.col("f_tx")) & F.col("id").eqNullSafe(F.col("f_id"))
    )
    place = _place(texts)
    texts = save(texts.select("h1", "h2", place.alias("place"), "line").dropDuplicates(["h1", "h2"]), "line-texts")

    def blocks(batches):
        for batch in batches:
            rows = [(a, b, *k) for a, b, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()) for k in block_keys(t)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["h1", "h2", "less", "part", "key"])

    parts = texts.select("h1", "h2", "line").mapInArrow(blocks, "h1 bigint, h2 bigint, less int, part int, key bigint")
    parts = _shared(parts, ["key"]).groupBy("h1", "h2").agg(F.collect_set(F.struct("less", "part")).alias("parts"))

    def variants(batches):
        for batch in batches:
            names, kinds, keys = [[], []], [], []
            for a, b, t, its in zip(*(batch.column(i).to_pylist() for i in range(4))):
                spans = []
                for p in its:
                    cut = _cuts(len(t) - p["less"], BLOCKS)
                    spans.append((int(cut[p["part"]]), int(cut[p["part"] + 1]) + 1))
                kind, key = variant_keys(t, spans)
                names[0].append(np.full(len(key), a))
                names[1].append(np.full(len(key), b))
                kinds.append(kind)
                keys.append(key)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (*names, kinds, keys)], names=["h1", "h2", "kind", "key"])

    near = texts.join(parts, ["h1", "h2"]).select("h1", "h2", "line", "parts").mapInArrow(variants, "h1 bigint, h2 bigint, kind int, key bigint")
    near = near.join(texts.select("h1", "h2", "place"), ["h1", "h2"])
    near = save(near, "line-variants")
    whole, cut_, put = (F.col("kind") == i for i in range(3))
    met = near.groupBy(F.col("key").alias("k")).agg(
        F.min(F.when(whole, F.struct("place", "h1", "h2"))).alias("whole"), F.min(F.when(cut_, F.struct("place", "h1", "h2"))).alias("cut"), F.min(F.when(put, F.struct("place", "h1", "h2"))).alias("put"), F.count(F.lit(1)).alias("c")
    ).filter("c > 1")
    both = near.join(met, F.col("key") == F.col("k"))
    mate = F.when(whole, F.col("cut")).when(cut_, F.col("whole")).otherwise(F.col("put"))
    pairs = both.select("h1", "h2", "place", mate.alias("mate")).filter("mate.place < place").select("h1", "h2", F.col("mate.h1").alias("m1"), F.col("mate.h2").alias("m2")).distinct()
    left = texts.select("h1", "h2", "line")
    right = texts.select(F.col("h1").alias("m1"), F.col("h2").alias("m2"), F.col("line").alias("mate"), F.col("place").alias("mate_place"))
    close = pairs.join(left, ["h1", "h2"]).join(right, ["m1", "m2"]).filter(F.levenshtein("line", "mate", 1) == 1)
    close = close.groupBy("h1", "h2").agg(F.min("mate_place").alias("mate_place"))

    # Every line with its distinct line's first place, and with a near one that is earlier still; a very common line fills no task.
    moved = distinct.join(close, ["h1", "h2"], "left").filter("c > 1 OR mate_place IS NOT NULL").select("h1", "h2", "c", "first", "mate_place")
    moved = save(moved, "line-moved")
    each = join_groups(slim.select("id", "tx", "line_no", "h1", "h2"), moved, ["h1", "h2"], "c", ["id", "tx", "line_no"])
    here = _place(each)
    equal = F.col("first") < here
    keep = F.when(equal, F.col("first")).when(F.col("mate_place") < here, F.col("mate_place"))
    return each.select("id", "tx", "line_no", keep.alias("keep"), F.when(equal, 0).otherwise(1).alias("distance")).filter("keep IS NOT NULL").select(
        F.col("id").alias(id_col), F.col("tx").alias("__tx"), "line_no", F.col("keep.id").alias("keep_id"), F.col("keep.line_no").alias("keep_line"), "distance"
    )


def _cleaned(docs: DataFrame, id_col: str, text_col: str, min_near: int) -> DataFrame:
    """``docs`` with __ld: its n_lines, n_equal, n_near and the text without the lines that go (the text itself where none goes)."""
    gone = line_groups(docs, id_col, text_col, min_near)
    # A document's own line numbers: as many as it has lines, however common these are elsewhere.
    count = lambda d: F.count_distinct(F.when(F.col("distance") == d, F.col("line_no")))
    own = gone.groupBy(F.col(id_col).alias("__ld_id"), F.col("__tx").alias("__ld_tx")).agg(F.collect_set("line_no").alias("__ld_gone"), count(0).alias("__ld_equal"), count(1).alias("__ld_near"))
    text = text_of(text_col)
    joined = docs.join(own, F.col(id_col).eqNullSafe(F.col("__ld_id")) & (F.xxhash64(text) == F.col("__ld_tx")), "left")
    lines = F.split(text, "\n", -1)
    # The numbers that stay, by hash, and then their lines: in proportion to the lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__ld_gone"))
    some = bound(F.struct(lines.alias("lines"), stay.alias("stay")), lambda d: F.array_join(F.transform(d["stay"], lambda i: F.get(d["lines"], i)), "\n"))
    kept = F.when(F.col("__ld_gone").isNull(), F.col(text_col)).otherwise(some)
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    report = F.struct(F.size(lines).cast("bigint").alias("n_lines"), number("__ld_equal").alias("n_equal"), number("__ld_near").alias("n_near"), kept.alias("text"))
    return joined.select(*[F.col(c) for c in docs.columns], report.alias("__ld"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_near: int = MIN_NEAR) -> DataFrame:
    """Every row, columns as they were, with the lines that go taken out of its text; lines from ``min_near`` characters on may differ by an edit."""
    rows = _cleaned(docs, id_col, text_col, min_near)
    return rows.select(*[F.col("__ld.text").alias(c) if c == text_col else F.col(c) for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_near: int = MIN_NEAR) -> DataFrame:
    """Per row: id, n_lines, n_equal, n_near and the cleaned text."""
    return _cleaned(docs.select(id_col, text_col), id_col, text_col, min_near).select(id_col, "__ld.n_lines", "__ld.n_equal", "__ld.n_near", F.col("__ld.text").alias("text"))


#: What line_report returns, by the common ends that two lines within one edit have: for small tables with unique ids. MIN_NEAR stands for the length.
ORACLE = r"""
WITH doc AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), line AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM doc
), place AS (SELECT *, row_number() OVER (ORDER BY doc_id, i) AS p FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), firsts AS (SELECT line, min(p) AS p, length(line) AS n FROM place GROUP BY line
), ends AS (
  SELECT line, p, n, unnest([0, 1]) AS half, m, CASE WHEN unnest([0, 1]) = 0 THEN left(line, m // 2) ELSE right(line, m - m // 2) END AS k
  FROM (SELECT *, unnest([n, n - 1]) AS m FROM firsts WHERE n >= MIN_NEAR)
), near AS (
  SELECT DISTINCT a.line AS a, b.line AS b, a.p AS pa, b.p AS pb, a.n AS na, b.n AS nb FROM ends a JOIN ends b ON a.half = b.half AND a.m = b.m AND a.k = b.k AND b.p < a.p AND abs(a.n - b.n) <= 1
), met AS (
  SELECT *, coalesce(list_position(list_transform(range(1, least(na, nb) + 1), lambda j: substr(a, j, 1) <> substr(b, j, 1)), true) - 1, least(na, nb)) AS same FROM near
), mate AS (
  SELECT a AS line, min(pb) AS p FROM met WHERE left(a, same) || substr(a, same + CASE WHEN na < nb THEN 1 ELSE 2 END) = left(b, same) || substr(b, same + CASE WHEN nb < na THEN 1 ELSE 2 END) GROUP BY a
), told AS (
  SELECT x.doc_id, x.i, f.p < x.p AS equal, f.p = x.p AND m.p < x.p AS near FROM place x JOIN firsts f USING (line) LEFT JOIN mate m USING (line)
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (equal) AS n_equal, count(*) FILTER (near) AS n_near, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT coalesce(equal, false) AND NOT coalesce(near, false)), '') AS text
  FROM line LEFT JOIN told USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, n_lines, n_equal, n_near, sha256(text) AS text_sha256 FROM kept
"""
