"""Operator 13, PII: detection through offset-preserving deobfuscation.

Base identifiers (email, ip, card, phone) are found on the text as it stands,
leftmost and without overlaps, each kind by itself; a match that fails its test
is dropped after matching. The method adds spans: a chain of transducers
rewrites the text (lookalike and styled characters to ASCII, at/dot disguises to
their marks, digits in words or in lookalike letters to digits). Each one keeps,
for every character that it emits, which source characters it stands for, so
the identifiers of the rewritten text are mapped back to spans of the source.
A found span is added if rewriting had a part in it and no base span of its kind
covers it.

Everything is one narrow map over Arrow batches: nothing is shuffled, whatever
the skew. Every pattern reads a text in time proportional to its length: runs
are possessive, or anchored at a mark and bounded. Only what disguises bound: a
local part of LOCAL characters, a domain of LABELS labels, NUMBER digit words.
Defined results: null text counts as empty (no spans); offsets are code points,
end exclusive; repeated rows are scanned alike; null ids pass through; an empty
table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from citeloom.llm.common import idle

KINDS = ("email", "ip", "card", "phone")
LOCAL, LABELS, NUMBER = 64, 8, 40

#: The base patterns, written so that no run is read twice. An email is anchored at its mark, see ``_emails``.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]++(?=@)")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("АВЕКМНОРСТХІЈЅаеорсухіјѕԁԛԝһɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν。․‧∙", "ABEKMHOPCTXIJSaeopcyxijsdqwhgABEZHIKMNOPTYXoav....", strict=True))
#: The digits' names in English, French, German and Spanish.
DIGIT_WORDS = {
    word: str(n)
    for n, words in enumerate(("zero zéro null cero", "one un une eins uno", "two deux zwei zwo dos", "three trois drei tres", "four quatre vier cuatro", "five cinq fünf cinco", "six sechs seis", "seven sept sieben siete", "eight huit acht ocho", "nine neuf neun nueve"))
    for word in words.split()
}
#: Names of the marks.
AT_WORDS, DOT_WORDS, PLUS_WORDS = "at|arobase|arroba|ät", "dot|point|punkt|punto", "plus|más|mas"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def digits_of(hit: str) -> str:
    return "".join(c for c in hit if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: a match holds the longest run before its mark that no earlier match has taken."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        end = max(end, at + 1)
        at = text.find("@", end)


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _address(hit: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or "0") <= 255 for p in hit.split("."))


def _card(hit: str) -> bool:
    digits = digits_of(hit)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _phone(hit: str) -> bool:
    return 9 <= len(digits_of(hit)) <= 15


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the base identifiers, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _HAS_DIGIT(text):
        for rank, pattern, passes in ((1, IP, _address), (2, CARD, _card), (3, PHONE, _phone)):
            if rank != 3 or "+" in text:
                out += [(m.start(), rank, m.end()) for m in pattern.finditer(text) if passes(m.group())]
    return sorted(out)


_HAS_DIGIT = re.compile("[0-9]").search


@dataclass
class Mapped:
    """A rewritten text; character i of it stands for source characters starts[i] to ends[i], None where nothing was rewritten."""

    text: str
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None
    touched: np.ndarray | None = field(default=None)

    def edited(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """With [start, end) replaced, for each edit in order, offsets composed with those that are there."""
        edits = [e for e in edits if self.text[e[0] : e[1]] != e[2]]
        if not edits:
            return self
        size = len(self.text)
        starts = np.arange(size, dtype=np.int32) if self.starts is None else self.starts
        ends = np.arange(1, size + 1, dtype=np.int32) if self.ends is None else self.ends
        touched = np.zeros(size, bool) if self.touched is None else self.touched
        text, s, e, t, at, gone, length = [], [], [], [], 0, [], 0
        for start, end, new in edits:
            text += self.text[at:start], new
            length += start - at + len(new)
            gone += [] if new else [length]  # what follows a deletion counts as rewritten
            s += starts[at:start], np.full(len(new), starts[start])
            e += ends[at:start], np.full(len(new), ends[end - 1])
            t += touched[at:start], np.ones(len(new), bool)
            at = end
        text.append(self.text[at:])
        touched = np.concatenate([*t, touched[at:]])
        touched[[i for i in gone if i < len(touched)]] = True
        return Mapped("".join(text), np.concatenate([*s, starts[at:]]), np.concatenate([*e, ends[at:]]), touched)

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start]), int(self.ends[end - 1])


@lru_cache(maxsize=1 << 16)
def plain(character: str) -> str:
    """The ASCII form of one character, itself if it has none: lookalikes, digits of other scripts, wide, styled and enclosed forms, blanks, dashes; nothing for invisible ones."""
    if character in LOOKALIKES:
        return LOOKALIKES[character]
    kind = unicodedata.category(character)
    if kind == "Cf":
        return ""
    if kind == "Nd":
        return str(unicodedata.decimal(character))
    if kind == "Zs":
        return " "
    if kind == "Pd" or character == "−":
        return "-"
    if unicodedata.decomposition(character).startswith(("<wide>", "<font>", "<small>", "<circle>")):
        form = unicodedata.normalize("NFKC", character)
        return form if len(form) == 1 and form.isascii() else character
    return character


def homoglyphs(mapped: Mapped) -> Mapped:
    """Each lookalike, styled or invisible character to its ASCII form."""
    if mapped.text.isascii():
        return mapped
    changed = [c for c in set(mapped.text) if not c.isascii() and plain(c) != c]
    if not changed:
        return mapped
    return mapped.edited([(m.start(), m.end(), plain(m.group())) for m in re.finditer("[" + "".join(map(re.escape, changed)) + "]", mapped.text)])


_GAP = r"[ \t]{1,4}"
_OPEN, _SHUT = r"[ \t]{0,4}[\[({<][ \t]{0,4}", r"[ \t]{0,4}[\])}>][ \t]{0,4}"
_MARKED_AT = rf"{_OPEN}(?:@|{AT_WORDS}){_SHUT}|[ \t]{{0,4}}(?:&#0{{0,4}}64;|&#x0{{0,4}}40;|&commat;)[ \t]{{0,4}}"
_MARKED_DOT = rf"{_OPEN}(?:\.|{DOT_WORDS}){_SHUT}|&#0{{0,4}}46;|&period;"
_ANY_DOT = rf"(?:{_MARKED_DOT}|{_GAP}(?:{DOT_WORDS}){_GAP}|\.)"
#: Where a disguised email may have its mark; a marked one, a spaced one and a plain one differ in what must follow.
AT = re.compile(rf"(?i)(?P<marked>{_MARKED_AT})|(?P<spaced>{_GAP}(?:{AT_WORDS}){_GAP}|[ \t]{{1,4}}@[ \t]{{0,4}}|@[ \t]{{1,4}})|(?P<plain>@)")
AFTER = re.compile(rf"(?i)[A-Z0-9-]{{1,63}}+(?:{_ANY_DOT}[A-Z0-9-]{{1,63}}+){{1,{LABELS}}}")
BEFORE = re.compile(rf"(?i)(?:(?<![A-Z0-9._%+-])|^)[A-Z0-9_%+-]{{1,{LOCAL}}}(?:{_ANY_DOT}[A-Z0-9_%+-]{{1,{LOCAL}}}){{0,{LABELS}}}$")
DOT = re.compile(rf"(?i){_MARKED_DOT}|{_GAP}(?:{DOT_WORDS}){_GAP}")
#: Words that follow a plain "at" in sentences and are no host.
ARTICLES = frozenset("the a an this that le la les der die das el los las".split())
TOP = re.compile(r"[A-Za-z]{2,24}$")
#: An address whose dots are disguised.
DOTTED = re.compile(rf"(?i)(?<![0-9.])[0-9]{{1,3}}+(?:{_ANY_DOT}[0-9]{{1,3}}+){{3}}(?![0-9])")
#: Without one of these no mark is disguised; the first are plain searches, which cost least.
DOT_NAMES = tuple(DOT_WORDS.split("|"))
BRACKETED = re.compile(rf"(?i)[\[({{<][ \t]{{0,4}}(?:[@.]|{AT_WORDS}|{DOT_WORDS})|&(?:#|commat|period)")


def disguises(mapped: Mapped) -> Mapped:
    """At and dot marks that are written out, in brackets or as entities, to the marks, inside what then reads as an email or an address.

    A bare " at " counts only with a disguised dot after it, so that ordinary sentences stay.
    """
    text = mapped.text
    low = text.lower()
    if not any(name in low for name in DOT_NAMES) and not BRACKETED.search(text):
        return mapped
    edits: list[tuple[int, int, str]] = []
    done = 0
    for at in AT.finditer(text):
        after = AFTER.match(text, at.end()) if at.start() >= done else None
        if not after or not TOP.search(after.group()):
            continue
        dots = list(DOT.finditer(text, at.end(), after.end()))
        if at.lastgroup != "marked" and (not dots or text[at.end() : dots[0].start()].lower() in ARTICLES):
            continue
        least = max(done, at.start() - 2 * LOCAL)
        before = BEFORE.search(text[least : at.start()])
        if not before:
            continue
        edits += [(m.start(), m.end(), ".") for m in DOT.finditer(text, least + before.start(), at.start())]
        edits.append((at.start(), at.end(), "@"))
        edits += [(m.start(), m.end(), ".") for m in dots]
        done = after.end()
    for address in DOTTED.finditer(text):
        edits += [(m.start(), m.end(), ".") for m in DOT.finditer(text, address.start(), address.end())]
    edits.sort()
    return mapped.edited([e for i, e in enumerate(edits) if not i or e[0] >= edits[i - 1][1]])


_NAMES = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_NAME = rf"(?:{_NAMES})(?![^\W_])"
_LINK = rf"(?:{_GAP}(?:{DOT_WORDS}){_GAP}|\.|[ ,/-]{{1,3}})"
#: Seven or more digits in a row, as words or numbers, a plus before them or not.
SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:(?:{PLUS_WORDS}){_GAP}|\+[ ]?)?(?:{_NAME}|[0-9]{{1,4}}(?![^\W_]))(?:{_LINK}(?:{_NAME}|[0-9]{{1,4}}(?![^\W_]))){{6,{NUMBER}}}")
NAMED = re.compile(rf"(?i)(?<![^\W_]){_NAME}")
PART = re.compile(rf"(?i)(?P<name>{_NAME})|(?P<number>[0-9]+)|(?P<plus>(?:{PLUS_WORDS}){_GAP}|\+[ ]?)|(?P<dot>{_GAP}(?:{DOT_WORDS}){_GAP}|\.)|(?P<gap>[ ,/-]+)")
#: Digits with letters among them that look like digits.
CONFUSED = re.compile(r"(?<![A-Za-z0-9+])\+?[0-9OolI](?:[ -]?[0-9OolI]){8,21}+(?![A-Za-z0-9])")
CONFUSION = {"O": "0", "o": "0", "l": "1", "I": "1"}


TOKENS = re.compile(r"[^\W_]+")


def _in_a_row(text: str) -> bool:
    """Whether a digit's name stands next to another one or to a number, without which no run has one."""
    last = named = False
    for token in TOKENS.findall(text.lower()):
        if token in DIGIT_WORDS:
            if last:
                return True
            last = named = True
        else:
            number = token[0] <= "9"
            if number and named:
                return True
            last, named = number or (last and token in DOT_NAMES), named and token in DOT_NAMES
    return False


def digit_words(mapped: Mapped) -> Mapped:
    """Runs of digits' names, or of numbers with some, to plain digits; letters that stand for digits in a number that is mostly digits likewise."""
    text = mapped.text
    edits: list[tuple[int, int, str]] = []
    if _in_a_row(text):
        for run in SPELLED.finditer(text):
            if NAMED.search(run.group()):
                for p in PART.finditer(text, run.start(), run.end()):
                    new = {"name": DIGIT_WORDS.get(p.group().lower(), ""), "number": p.group(), "plus": "+", "dot": ".", "gap": ""}[p.lastgroup]
                    edits.append((p.start(), p.end(), new))
    if _HAS_DIGIT(text):
        for run in CONFUSED.finditer(text):
            letters = [i for i, c in enumerate(run.group()) if c in CONFUSION]
            if letters and 3 * len(letters) <= len(digits_of(run.group())):
                edits += [(run.start() + i, run.start() + i + 1, CONFUSION[text[run.start() + i]]) for i in letters]
    edits.sort()
    return mapped.edited([e for i, e in enumerate(edits) if not i or e[0] >= edits[i - 1][1]])


TRANSDUCERS: tuple[Callable[[Mapped], Mapped], ...] = (homoglyphs, digit_words, disguises)


def normalised(text: str) -> Mapped:
    mapped = Mapped(text)
    for transducer in TRANSDUCERS:
        mapped = transducer(mapped)
    return mapped


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base and added spans of a text, each (start, rank of kind, end), sorted."""
    base, mapped = detect(text), normalised(text)
    if mapped.starts is None:
        return base, []
    added = set()
    for start, rank, end in detect(mapped.text):
        if not mapped.touched[start:end].any() or (rank == 0 and not TOP.search(mapped.text[start:end])):
            continue
        s, e = mapped.source(start, end)
        if not any(r == rank and a <= s and e <= b for a, r, b in base):
            added.add((s, rank, e))
    return base, sorted(added)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[rank]}:{start}:{end}" for start, rank, end in spans)


_SPAN = "array<struct<start:int,end:int,kind:string>>"


def _mapped(docs: DataFrame, id_col: str, text_col: str, columns: str, row: Callable[[str], tuple]) -> DataFrame:
    """Per row the id and ``row(text)``, in a narrow map."""
    kept = docs.select(id_col, text_col)
    made = f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, {columns}"

    schema = to_arrow_schema(StructType.fromDDL(made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.string())
            rows = [row(texts[i].as_py() or "") for i in range(batch.num_rows)]
            told = list(zip(*rows)) or [()] * (len(schema) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema[0].type), *(pa.array(c, f.type) for c, f in zip(told, list(schema)[1:]))], schema=schema)
        idle()

    return kept.mapInArrow(run, made)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base and added, arrays of (start, end, kind) in order of start and kind."""

    def row(text: str) -> tuple:
        return tuple([{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in spans] for spans in scan(text))

    return _mapped(docs, id_col, text_col, f"base {_SPAN}, added {_SPAN}", row)


def redacted(text: str, mask: str = "[{}]") -> str:
    """The text with every span, overlapping ones joined, replaced by its first kind's mask."""
    out, at = [], 0
    for start, kind, end in sorted(sum(scan(text), [])):
        if start >= at:
            out += text[at:start], mask.format(KINDS[kind])
        at = max(at, end)
    return "".join([*out, text[at:]])


def pii_redacted(docs: DataFrame, mask: str = "[{}]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and the text without what was found; a null text becomes empty."""
    return _mapped(docs, id_col, text_col, "text string", lambda text: (redacted(text, mask),))


def pii_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of each base kind, the digest of the base spans and all spans as text."""

    def row(text: str) -> tuple:
        base, added = scan(text)
        counts = [sum(rank == k for _, rank, _ in base) for k in range(len(KINDS))]
        return *counts, sha256(told(base).encode()).hexdigest(), told(sorted(base + added))

    return _mapped(docs, id_col, text_col, ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string", row)
