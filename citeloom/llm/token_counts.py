"""Operator 5, token counts by a prefix dynamic program.

For every distinct pre-token the merge list's prefix program
(``MergeList.closed``) stores the exact token count at each of its prefixes; for
a text, one walk stores the pre-tokens' ends and the exact counts there, running
sums of these. Both levels together hold the exact token count at every prefix,
so the total, the budget test and the truncation point are looked up; nothing is
encoded again. Only where a limit falls into a special string, a contraction or
a pre-token that normalisation changes, and whose prefixes therefore split in
other ways, that one pre-token's prefixes are counted by themselves.

Defined results: a null text counts as empty (0 tokens, 0 bytes); special
strings in a text are single tokens, as the library treats them by default;
white space has no tokens, so a prefix that fits takes what follows it;
repeated rows are counted each by itself; null ids pass through; an empty
table gives an empty result. Only the id and the text column are read, so
other columns may have any names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import PreTokenizedString

from citeloom.llm.common import idle
from citeloom.llm.merges import LETTER, NUMBER, PLAIN, Kept, MergeList, blocks, merge_list, spelled, unspelled

#: The contractions that the tokenizer's pattern splits off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
PIECES = re.compile("|".join(CONTRACTIONS) + f"|[{LETTER}]+|[{NUMBER}]|[^\\s{LETTER}{NUMBER}]+")


#: Tables of pre-tokens in each of two generations; a worker keeps them from task to task, some 100 bytes each.
KEPT_TABLES = 1 << 19


@dataclass
class Prefixes:
    """The stored table of a text: its pre-tokens ("" for a special string), where they start and end, the exact token count at each end."""

    pieces: list[str]
    starts: list[int]
    ends: list[int]
    counts: list[int]

    @property
    def total(self) -> int:
        return self.counts[-1] if self.counts else 0


class PrefixCounter:
    """Exact counts for a tokenizer whose words end in a suffix symbol and whose white space is dropped."""

    def __init__(self, path: str):
        self.merges: MergeList = merge_list(path)
        self._known = Kept(self._within, KEPT_TABLES)

    # --- one pre-token ----------------------------------------------------------------

    def _within(self, piece: str) -> bytes | list[int]:
        """Tokens of each prefix of a pre-token, by characters; entry 0 is 0, the last one the whole's."""
        if piece in CONTRACTIONS:
            # Cut short, it is a mark and letters.
            counts = [sum(self._known[p][-1] for p in PIECES.findall(piece[:i])) for i in range(len(piece))] + [self.merges.closed(piece)[-1]]
        else:
            counts = self.merges.closed(spelled(piece))
            if not piece.isascii():
                counts = [counts[e] for e in accumulate((len(c.encode("utf-8", "surrogateescape")) for c in piece), initial=0)]
        return bytes(counts) if max(counts) < 256 else counts

    def within(self, piece: str) -> list[int]:
        return list(self._known[piece])

    # --- a text -----------------------------------------------------------------------

    def _spans(self, segment: str) -> Iterator[tuple[list[str], list[int], list[int]]]:
        """Pre-tokens of a text without special strings, their starts and ends, block by block."""
        for start, end in blocks(segment):
            low = segment[start:end].lower()
            if len(low) == end - start and not PLAIN.search(segment, start, end):
                found = list(PIECES.finditer(low))
                yield [m.group() for m in found], [start + m.start() for m in found], [start + m.end() for m in found]
            else:
                library = self.merges.library
                whole = PreTokenizedString(segment[start:end])
                whole.normalize(library.normalizer.normalize)
                library.pre_tokenizer.pre_tokenize(whole)
                splits = whole.get_splits("original", "char")
                yield [unspelled(p) for p, _, _ in splits], [start + a for _, (a, _), _ in splits], [start + b for _, (_, b), _ in splits]

    def prefixes(self, text: str) -> Prefixes:
        """One walk over the text."""
        pieces: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        sizes: list[int] = []
        at, known = 0, self._known
        for i, segment in enumerate(self.merges.segments(text)):
            if i % 2:
                pieces.append("")
                starts.append(at)
                ends.append(at + len(segment))
                sizes.append(1)
            else:
                for some, first, last in self._spans(segment):
                    pieces += some
                    starts += [at + x for x in first] if at else first
                    ends += [at + x for x in last] if at else last
                    sizes += [known[p][-1] for p in some]
            at += len(segment)
        return Prefixes(pieces, starts, ends, list(accumulate(sizes)))

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return self.prefixes(text).total

    def fit(self, text: str, limit: int, table: Prefixes | None = None) -> int:
        """Characters of the longest prefix with at most ``limit`` tokens, from the text's table."""
        table = table or self.prefixes(text)
        k = bisect_right(table.counts, limit)
        if k == len(table.counts):
            return len(text)
        piece, start, end = table.pieces[k], table.starts[k], table.ends[k]
        before = table.counts[k - 1] if k else 0
        if piece and piece not in CONTRACTIONS and text[start:end].lower() == piece:
            return start + max(i for i, n in enumerate(self._known[piece]) if before + n <= limit)
        # Prefixes of this one may join the pre-token that touches it; what normalisation joined may reach up to the next.
        first = k - 1 if k and table.ends[k - 1] >= start else k
        while first and table.ends[first - 1] > table.starts[first]:  # two pre-tokens of one character
            first -= 1
        base = table.counts[first - 1] if first else 0
        after = table.starts[k + 1] if k + 1 < len(table.starts) else len(text)
        for stop in range(max(end, after) - 1, start, -1):
            if base + self.count(text[table.starts[first] : stop]) <= limit:
                return stop
        return start


@lru_cache(maxsize=4)
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit and fit_chars, the characters that ``limit`` tokens hold; all from one prefix table.

    A narrow map over Arrow batches: no shuffle, memory of one batch and one text's table.
    """
    kept = docs.select(id_col, text_col)
    schema = f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(tokenizer_path)
        for batch in batches:
            texts, rows = batch.column(1).cast(pa.string()), []
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                table = counter.prefixes(text)
                rows.append((len(text.encode()), table.total, table.total > limit, counter.fit(text, limit, table)))
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"])
        idle()

    return kept.mapInArrow(run, schema)


def prefix_token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, prefix_ends (characters) and prefix_tokens (exact counts there), one entry for each pre-token."""
    kept = docs.select(id_col, text_col)
    schema = f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, prefix_ends array<int>, prefix_tokens array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).cast(pa.string())
            rows = [counter.prefixes(texts[i].as_py() or "") for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.ends for r in rows], pa.list_(pa.int32())), pa.array([r.counts for r in rows], pa.list_(pa.int32()))],
                names=[id_col, "prefix_ends", "prefix_tokens"],
            )
        idle()

    return kept.mapInArrow(run, schema)
