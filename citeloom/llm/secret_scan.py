"""Operator 6, secret scan: fixed patterns and sliding-window entropy. DataFrame functions only.

Base patterns are found leftmost and without overlaps, each kind by itself; a
match that fails its length test is dropped after matching. The method adds
spans: candidate strings are the maximal runs of a character class; a window
slides over each, its symbol counts (packed into a few integers) and the sum of
n*log2(n) updated by the symbol that enters and the one that leaves, which gives
its Shannon entropy in constant time. Windows at or above the class's threshold
are joined into spans. The allow-list suppresses whole candidates, and, within
others, the windows that overlap a listed part.

Everything is one narrow projection: nothing is shuffled, whatever the skew.
Work grows in proportion to a text's length: offsets are prefix sums, and a long
candidate is scanned in stretches of STRETCH windows.
Defined results: null text counts as empty (no spans); offsets are code points,
end exclusive; repeated rows are scanned alike; null ids pass through; an empty
table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import text_of
from citeloom.operators.spans import bound, find_all

#: The base patterns. Only whole runs are long enough, so the last two hold their length tests.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
ASSIGN_LEAST = 8

#: Windows of a candidate that are scanned in one go; counters of a 64-bit integer and bits of each.
STRETCH, COUNTERS, BITS = 1024, 12, 5


@dataclass(frozen=True)
class CharacterClass:
    """Candidates are runs of ``symbols`` (inside of a regex class) as long as a window; a window of ``width`` symbols counts as secret from ``bits`` of entropy."""

    kind: str
    symbols: str
    alphabet: str
    width: int
    bits: float
    fold: bool = False
    skip: str = r"(?!)"

    def __post_init__(self):
        if not 1 < self.width < (1 << BITS) - 1:
            raise ValueError(f"a window has 2 to {(1 << BITS) - 2} symbols")

    @property
    def run(self) -> str:
        return f"(?<![{self.symbols}])[{self.symbols}]{{{self.width},}}+"


_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Words joined by marks or by capitals, without digits.
_WORDS = r"[-_/+=]*+(?:(?:[A-Z]?[a-z]++|[A-Z]++)(?:[A-Z][a-z]++)*+(?:[-_/+=]++|$))++"
#: Random base64 has about 4.0 bits in 20 symbols, prose and joined words under 3.7; random hex about 3.5 in 24.
CLASSES = (
    CharacterClass("entropy_hex", "0-9A-Fa-f", "0123456789abcdef", 24, 3.0, fold=True, skip=r"^(?:[0-9]++|[A-Fa-f]++)$"),
    CharacterClass("entropy_base64", "A-Za-z0-9+/_=-", _B64, 20, 3.85, skip=rf"^(?:{_WORDS}|[^A-Za-z]++|[0-9A-Fa-f]++)$"),
)
#: Candidates that match are never secrets: UUIDs, words joined by marks with numbers at the end.
ALLOW = (
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]++(?:[-_/][A-Za-z]++)*+[-_/]?[0-9]{1,4}$",
)
#: Windows that overlap one of these, in either case, are never secrets: stand-ins and runs of the alphabet.
ALLOW_PARTS = ("example", "placeholder", "changeme", "dummy", "xxxx", "yourkey", "your-key", "your_key", "yourtoken", "your-token", "your_token", "yoursecret", "your-secret", "your_secret", "abcdefgh", "hgfedcba", "01234567", "76543210")
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _none() -> Column:
    return F.from_json(F.lit("[]"), _SPAN)


def _base(text: Column, guard: Column, pattern: str, kind: str, rank: int, passes=None) -> Column:
    hits = find_all(text, pattern)
    hits = F.filter(hits, lambda m: passes(m["hit"])) if passes else hits
    spans = F.transform(hits, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(guard, spans.cast(_SPAN)).otherwise(_none())


def _shift(direction: str, value: Column, by: Column) -> Column:
    return F.call_function(f"shift{direction}", value, by)


def _joined(spans: Column) -> Column:
    """Sorted spans (start, end) with those that touch or overlap made one: a span opens where the one before it has ended."""
    firsts = F.filter(spans, lambda s, i: (i == 0) | (s["start"] > F.get(spans, i - 1)["end"]))
    lasts = F.filter(spans, lambda s, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["start"] > s["end"]))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))


def window_spans(candidate: Column, cls: CharacterClass) -> Column:
    """Joined windows of a candidate whose entropy reaches the class's threshold: array of (start, end) within it.

    Symbols outside the alphabet have code 0; no window that holds one counts.
    """
    width, slots = cls.width, len(cls.alphabet) // COUNTERS + 1
    weigh = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(width + 2)])
    symbols = F.filter(F.split(F.lower(candidate) if cls.fold else candidate, ""), lambda c: c != "")
    codes = F.transform(symbols, lambda c: F.instr(F.lit(cls.alphabet), c))
    span = "array<struct<start:int,end:int>>"
    slot = lambda code: F.floor(code / COUNTERS).cast("int")
    place = lambda code: (F.pmod(code, F.lit(COUNTERS)) * BITS).cast("int")
    unit = lambda code: _shift("left", F.lit(1).cast("bigint"), place(code))
    count = lambda n, code: _shift("right", F.get(n, slot(code)), place(code)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def stretch(codes: Column, at: Column) -> Column:
        """Spans among the windows that start at ``at`` and the STRETCH - 1 places after it."""
        zero = F.struct(
            F.array_repeat(F.lit(0).cast("bigint"), slots).alias("n"), F.lit(0.0).alias("sum"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.from_json(F.lit("[]"), span).alias("out")
        )

        def moved(acc: Column, i: Column, s: Column) -> Column:
            into, gone, full = s["into"], s["gone"], s["full"]
            n_in, n_out = count(acc["n"], into), count(acc["n"], gone)
            change = F.get(weigh, n_in + 1) - F.get(weigh, n_in) + F.when(full, F.get(weigh, F.greatest(n_out - 1, F.lit(0))) - F.get(weigh, n_out)).otherwise(0.0)
            total = F.when(full & (into == gone), acc["sum"]).otherwise(acc["sum"] + change)
            others = count(acc["n"], F.lit(0)) + (into == 0).cast("int") - (full & (gone == 0)).cast("int")
            return F.struct(total.alias("sum"), ((i >= at + width - 1) & (others == 0) & (math.log2(width) - total / width >= cls.bits - 1e-9)).alias("high"))

        def step(acc: Column, i: Column) -> Column:
            full = i >= at + width
            symbol = F.struct(F.get(codes, i).alias("into"), F.when(full, F.get(codes, i - width)).otherwise(0).alias("gone"), full.alias("full"))

            def after(s: Column) -> Column:
                counts = F.transform(
                    acc["n"], lambda v, k: v + F.when(k == slot(s["into"]), unit(s["into"])).otherwise(0) - F.when(s["full"] & (k == slot(s["gone"])), unit(s["gone"])).otherwise(0)
                )

                def result(m: Column) -> Column:
                    first = i - (width - 1)
                    opens = m["high"] & (first > acc["end"])
                    out = F.when(opens & (acc["end"] >= 0), F.array_append(acc["out"], F.struct(acc["start"].alias("start"), acc["end"].alias("end")))).otherwise(acc["out"])
                    return F.struct(
                        counts.alias("n"), m["sum"].alias("sum"), F.when(opens, first).otherwise(acc["start"]).alias("start"), F.when(m["high"], i + 1).otherwise(acc["end"]).alias("end"), out.alias("out")
                    )

                return bound(moved(acc, i, s), result)

            return bound(symbol, after)

        def finish(acc: Column) -> Column:
            return F.when(acc["end"] >= 0, F.array_append(acc["out"], F.struct(acc["start"].alias("start"), acc["end"].alias("end")))).otherwise(acc["out"])

        last = F.least(at + (STRETCH + width - 1), F.size(codes)) - 1
        return F.aggregate(F.sequence(at, last), zero, step, finish)

    def scan(codes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(codes) - width, F.lit(0)), F.lit(STRETCH))
        return bound(F.flatten(F.transform(starts, lambda at: stretch(codes, at))), _joined)

    return bound(codes, scan)


def _entropy(text: Column, cls: CharacterClass, rank: int, allow: Sequence[str], parts: Sequence[str]) -> Column:
    def wanted(m: Column) -> Column:
        allowed = m["hit"].rlike(cls.skip)
        for pattern in allow:
            allowed = allowed | m["hit"].rlike(pattern)
        return ~allowed

    def masked(hit: Column) -> Column:
        out = hit
        for part in parts:
            out = F.regexp_replace(out, F.lit("(?i)" + part), F.lit("#" * len(part)))
        return F.when(hit.rlike("(?i)" + "|".join(parts)), out).otherwise(hit) if parts else hit

    per_candidate = F.transform(
        F.filter(find_all(text, cls.run), wanted),
        lambda m: F.transform(
            window_spans(masked(m["hit"]), cls),
            lambda w: F.struct((m["start"] + w["start"]).alias("start"), F.lit(rank).alias("rank"), (m["start"] + w["end"]).alias("end"), F.lit(cls.kind).alias("kind")),
        ),
    )
    return F.when(text.rlike(cls.run), F.flatten(per_candidate).cast(_SPAN)).otherwise(_none())


def secret_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: Sequence[CharacterClass] = CLASSES, allow: Sequence[str] = ALLOW, allow_parts: Sequence[str] = ALLOW_PARTS
) -> DataFrame:
    """Per row: id, base and added, arrays of (start, rank, end, kind) in order of start and kind.

    ``allow`` are patterns of candidates, ``allow_parts`` plain letters and marks.
    """
    text = text_of(text_col)
    # Cheap tests first: a text without the marks that a pattern needs is never searched for it.
    assign = _base(text, text.contains("=") | text.contains(":"), ASSIGN, "assign", 0, lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= ASSIGN_LEAST)
    access = _base(text, text.contains("AKIA"), ACCESS, "access", 1)
    hexes = _base(text, text.rlike(HEX), HEX, "hex", 2)
    base = docs.select(F.col(id_col), F.col(text_col), F.array_sort(F.concat(assign, access, hexes)).alias("base"))
    added = F.array_sort(F.concat(_none(), *[_entropy(text, cls, 3 + i, allow, allow_parts) for i, cls in enumerate(classes)]))
    return base.select(id_col, "base", added.alias("added"))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of each base kind, the digest of the base spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return spans.select(
        id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(_told(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _told(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
