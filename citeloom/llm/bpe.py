"""Operator 10, BPE encoding and decoding as streaming transducers.

Encoding splits a text into pre-tokens, span by span, and streams each through
the prefix program (``MergeList.stream``): a token is emitted once the merge
list's sufficient lookahead (``MergeList.lookahead``) lies to its right, or the
pre-token's end, which is a stable place as well, and what stands before it is
forgotten. What the transducer emitted for a short pre-token is kept in a bounded
memory; a long one is fed and emitted in parts. Decoding feeds each token's
bytes to an incremental UTF-8 state machine. Beside the row itself, state is
bounded by the span, the lookahead and the longest token, whatever the length of
the text; a span without any border (``merges.BORDER``) is read by offsets, but,
if it also holds characters from U+0250 on, by the library's splitter as a whole.

Defined results: null texts count as empty (no ids, empty text); special
strings in a text become their own id, as the library does by default; bytes
that are not UTF-8 decode to U+FFFD, as in the library; null ids and repeated
rows pass through; an empty table gives an empty result. Only the id and text
columns are read.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from citeloom.llm.common import idle
from citeloom.llm.merges import BLOCK, BYTE_OF, KEPT, LETTER, NUMBER, PLAIN, Kept, MergeList, blocks, merge_list, spelled, unspelled

#: The pattern of the tokenizer's byte-level pre-tokenizer, for the plain characters.
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\\s{LETTER}{NUMBER}]+|\\s+(?!\\S)|\\s+")
#: Characters of a long pre-token that are fed at once, and ids of it that are handed on at once.
PART = 1024


def _spelled(text: str, start: int, end: int) -> Iterator[str]:
    for at in range(start, end, PART):
        yield spelled(text[at : min(end, at + PART)])


def _ids(data: bytes) -> list[int]:
    return np.frombuffer(data, np.int32).tolist()


class Transducer:
    def __init__(self, path: str):
        self.merges: MergeList = merge_list(path)
        self.bytes_of = [b""] * (max(self.merges.size - 1, *self.merges.special.values(), 0) + 1)
        for token, i in self.merges.vocab.items():
            self.bytes_of[i] = bytes(map(BYTE_OF.__getitem__, token))
        for token, i in self.merges.special.items():
            self.bytes_of[i] = token.encode()
        self._known = Kept(self._short)

    def forget(self) -> None:
        """Empty the memories, so that a worker that waits holds little."""
        self._known.forget()
        self.merges.forget()

    # --- encoding ---------------------------------------------------------------------

    def _short(self, piece: str) -> bytes:
        """Ids, as 32-bit numbers, of a pre-token whose end is at hand."""
        return array("i", self.merges.tokens(spelled(piece))).tobytes()

    def stream(self, text: str, start: int, end: int) -> Iterator[int]:
        """Ids of the pre-token at ``start`` to ``end``."""
        return self.merges.stream(_spelled(text, start, end))

    def _handed(self, text: str, spans: Iterable[tuple[int, int]]) -> Iterator[list[int]]:
        """Ids of the pre-tokens at the spans; those of a long one come in parts."""
        for start, end in spans:
            if end - start <= KEPT:
                yield _ids(self._known[text[start:end]])
                continue
            ids = self.stream(text, start, end)
            while part := list(islice(ids, PART)):
                yield part

    def chunks(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, span by span."""
        for i, segment in enumerate(self.merges.segments(text)):
            if i % 2:
                yield [self.merges.special[segment]]
                continue
            for start, end in blocks(segment):
                plain = not PLAIN.search(segment, start, end)
                if plain and end - start > 2 * BLOCK:
                    yield from self._handed(segment, (m.span() for m in PIECES.finditer(segment, start, end)))
                    continue
                if plain:
                    pieces = PIECES.findall(segment, start, end)
                else:
                    pieces = [unspelled(p) for p, _ in self.merges.library.pre_tokenizer.pre_tokenize_str(segment[start:end])]
                if not pieces:
                    continue
                if max(map(len, pieces)) <= KEPT:
                    yield _ids(b"".join(map(self._known.__getitem__, pieces)))
                else:
                    for piece in pieces:
                        yield from self._handed(piece, [(0, len(piece))])

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.chunks(text)))

    # --- decoding ---------------------------------------------------------------------

    def decode_stream(self, chunks: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of id chunks; at most three bytes of an unfinished character are held between chunks."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in chunks:
            yield machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))
        yield machine.decode(b"", True)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream([ids]))

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text."""
        n, of_ids, of_text, glue = 0, sha256(), sha256(), b""
        names = self._names

        def told() -> Iterator[list[int]]:
            nonlocal n, glue
            for ids in self.chunks(text):
                if ids:
                    n += len(ids)
                    of_ids.update(glue + ",".join(map(names.__getitem__, ids)).encode())
                    glue = b","
                yield ids

        for part in self.decode_stream(told()):
            of_text.update(part.encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()

    @property
    def _names(self) -> list[str]:
        if "_spelled_ids" not in self.__dict__:
            self._spelled_ids = [str(i) for i in range(len(self.bytes_of))]
        return self._spelled_ids


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids array<int>, n_tokens, and round_trip: whether the ids decode to the text.

    A narrow map; nothing is truncated or padded.
    """
    kept = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer_path)
        for batch in batches:
            for part in _small(batch):
                texts, rows, same = part.column(1).cast(pa.string()), [], []
                for i in range(part.num_rows):
                    text = texts[i].as_py() or ""
                    ids = machine.encode(text)
                    same.append(machine.decode(ids) == text)
                    rows.append(np.asarray(ids, np.int32))
                ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
                flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), pa.array(np.diff(ends), pa.int64()), pa.array(same, pa.bool_())],
                    names=[id_col, "ids", "n_tokens", "round_trip"],
                )
        machine.forget()
        idle()

    return kept.mapInArrow(run, f"`{id_col}` {_type(kept, id_col)}, ids array<int>, n_tokens bigint, round_trip boolean")


def bpe_decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the text of its ids (null ids: empty)."""
    kept = encoded.select(id_col, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer_path)
        for batch in batches:
            texts = [machine.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return kept.mapInArrow(run, f"`{id_col}` {_type(kept, id_col)}, text string")


def bpe_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 and decoded_sha256, from one encoding and decoding stream."""
    kept = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).cast(pa.string())
            rows = [machine.digests(texts[i].as_py() or "") for i in range(batch.num_rows)]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        machine.forget()
        idle()

    return kept.mapInArrow(run, f"`{id_col}` {_type(kept, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _small(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that the ids of few texts are held at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
