"""A byte-level BPE merge list: prefix dynamic program, sufficient lookahead, borders of pre-tokens.

Shared by the token counter (operator 5) and the encoder (operator 10). Tokens
are their ids here; a text is spelled in the printable alphabet of bytes.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
from tokenizers import Tokenizer

#: Entries of each of a cache's two generations, and of the memory of token pairs: what a worker holds is bounded.
CACHE, PAIRS = 1 << 17, 1 << 17
#: Characters up to which a piece's result is kept.
KEPT = 128
#: Characters of text that are split into pre-tokens at once.
BLOCK = 1 << 15


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


ALPHABET = byte_alphabet()
BYTE_OF = {c: b for b, c in enumerate(ALPHABET)}
_TABLE = {b: c for b, c in enumerate(ALPHABET)}


def spelled(text: str) -> str:
    """A text's UTF-8 bytes in the printable alphabet of the vocabulary."""
    if text.isascii() and text.isprintable():
        return text.replace(" ", ALPHABET[0x20])
    return text.encode("utf-8", "surrogateescape").decode("latin-1").translate(_TABLE)


def unspelled(piece: str) -> str:
    return bytes(map(BYTE_OF.__getitem__, piece)).decode("utf-8", "surrogateescape")


def _ranges(kind: str) -> str:
    """Regex ranges of the characters below U+0250 whose general category starts with ``kind``."""
    out, start = [], None
    for cp in range(0x251):
        if cp < 0x250 and unicodedata.category(chr(cp)).startswith(kind):
            start = cp if start is None else start
        elif start is not None:
            out.append(f"\\u{start:04x}-\\u{cp - 1:04x}")
            start = None
    return "".join(out)


#: Below U+0250, without control characters and odd blanks, Python's own classes and the library's agree.
PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u024f]")
LETTER, NUMBER = _ranges("L"), _ranges("N")
#: Places where a pre-token ends whatever stands around, as none holds both sides: a blank after another character,
#: an ASCII letter before a digit or mark, a digit before a letter or mark, an ideograph before its full stop or comma.
BORDER = re.compile(
    r"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z])(?=[\x21-\x40\x5b-\x60\x7b-\x7e])|(?<=[0-9])(?=[\x21-\x2f\x3a-\x7e])|(?<=[一-龥])(?=[、。，！？])"
)


def blocks(text: str, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """The text in spans of about ``size`` characters, cut at borders only."""
    start = 0
    while len(text) - start > size:
        found = BORDER.search(text, start + size)
        if not found:
            break
        yield start, found.start()
        start = found.start()
    yield start, len(text)


class Kept(dict):
    """Results by piece, in two generations: those not asked for during one are forgotten."""

    def __init__(self, work: Callable, limit: int = CACHE):
        self.work, self.limit, self.older = work, limit, {}

    def forget(self) -> None:
        self.older = {}
        self.clear()

    def __missing__(self, piece: str):
        found = self.older.get(piece)
        if found is None:
            found = self.work(piece)
        if len(piece) <= KEPT:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class MergeList:
    """Vocabulary and ranked merges of a tokenizer file, with the functions that follow from them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        # The library's normaliser and splitter, without its model.
        bare = {k: spec.get(k) for k in ("version", "normalizer", "pre_tokenizer")} | {"model": {"type": "BPE", "vocab": {}, "merges": []}}
        self.library = Tokenizer.from_str(json.dumps(bare))
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        bodies = {t: t.removesuffix(self.suffix) if self.suffix else t for t in self.vocab}
        self.max_len = max(map(len, bodies.values()))
        self.size = max(self.vocab.values()) + 1
        #: By token: rank at which it is made, -1 for single symbols, None if no merge makes it; and its two parts.
        self.made: list[int | None] = [None] * self.size
        self.halves: list[tuple[int, int] | None] = [None] * self.size
        for token, i in self.vocab.items():
            if len(bodies[token]) <= 1:
                self.made[i] = -1
        #: Rank of each pair, under left * size + right.
        self.rank: dict[int, int] = {}
        self._order: list[tuple[int, int]] = []
        for i, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, both = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.rank[a * self.size + b] = i
            self._order.append((a, b))
            if self.made[both] is None:
                self.made[both], self.halves[both] = i, (a, b)
        #: Automata that find, at each symbol, the tokens that end there, longest first: those within a word, those that close one.
        self.inner, self.closing = ahocorasick.Automaton(), ahocorasick.Automaton()
        self._strings: dict[int, str] = {}
        self.width = [0] * self.size
        for token, i in self.vocab.items():
            if self.made[i] is not None and bodies[token]:
                closes = bool(self.suffix) and token.endswith(self.suffix)
                (self.closing if closes else self.inner).add_word(bodies[token], (i, len(bodies[token])))
                self._strings[i] = bodies[token]
                self.width[i] = len(bodies[token])
        self.inner.make_automaton()
        if self.suffix:
            self.closing.make_automaton()
        self._pairs: dict[int, bool] = {}

    def forget(self) -> None:
        self._pairs.clear()

    def follows(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right``, side by side, as just these two tokens."""
        key = left * self.size + right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._stays(left, right)
        return known

    def _stays(self, left: int, right: int) -> bool:
        """Undo the merges inside the two tokens, latest rank first, looking only at
        the two parts that touch: if the touching parts have a merge that comes
        before the one just undone (at equal rank the left place comes first),
        that merge would have been made across the border.
        """
        rank, made, halves, size = self.rank, self.made, self.halves, self.size
        limit = 1 << 60
        while True:
            crossing = rank.get(left * size + right)
            if crossing is not None and crossing < limit:
                return False
            a, b = made[left], made[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, halves[left][1]
            else:
                limit, right = b + 1, halves[right][0]

    # --- prefix dynamic program --------------------------------------------------------

    def prefixes(self, word: str) -> tuple[list[int | None], list[int]]:
        """For every prefix of a piece (without word end): its last token and its exact token count.

        A prefix's encoding ends in exactly one token t, and what stands before t
        is the encoding of the prefix without t; so t is found by trying the
        tokens that end here against the last token before them.
        """
        last, width = self._program(word), self.width
        count = [0] * len(last)
        for end in range(1, len(last)):
            count[end] = count[end - width[last[end]]] + 1
        return last, count

    def _program(self, word: str) -> list[int | None]:
        """The last token of each prefix."""
        last: list[int | None] = [None] * (len(word) + 1)
        size, known = self.size, self._pairs.get
        for end, (token, width) in self.inner.iter(word):
            end += 1
            if last[end] is None:
                if end == width:
                    last[end] = token
                elif (before := last[end - width]) is not None:
                    fits = known(before * size + token)
                    if fits or (fits is None and self.follows(before, token)):
                        last[end] = token
        if last.count(None) > 1:
            raise ValueError(f"no token covers {word[: last.index(None, 1)]!r}")
        return last

    def tokens(self, word: str) -> list[int]:
        """Tokens of a piece that is known to its end: the way back from there."""
        last, width, at, out = self._program(word), self.width, len(word), []
        while at:
            token = last[at]
            out.append(token)
            at -= width[token]
        out.reverse()
        return out

    def closed(self, word: str) -> list[int]:
        """For every prefix of a piece: its exact token count as a whole piece, its last symbol carrying the word end."""
        last, count = self.prefixes(word)
        if not self.suffix:
            return count
        out = [0] * (len(word) + 1)
        for end, (token, width) in self.closing.iter(word):
            end += 1
            if not out[end]:
                start = end - width
                if not start or self.follows(last[start], token):
                    out[end] = count[start] + 1
        if 0 in out[1:]:
            raise ValueError(f"no token closes {word[: out.index(0, 1)]!r}")
        return out

    def stream(self, parts: Iterator[str]) -> Iterator[int]:
        """Tokens of a piece that comes in parts, each as soon as it is stable.

        Tokens that end the lookahead or more before the front are emitted and
        forgotten, so at most twice the lookahead and one part are held.
        """
        ahead, follows = self.lookahead, self.follows
        last: list[int | None] = [None]  # last[i]: the token that ends i symbols after the last one emitted
        base = fed = 0
        search = None
        for part in parts:
            fed += len(part)
            if search is None:
                search = self.inner.iter(part)
            else:
                search.set(part)
            for end, (token, width) in search:
                at = end + 1 - base
                start = at - width
                if at == len(last) and start >= 0 and (last[start] is None or follows(last[start], token)):
                    last.append(token)
            if base + len(last) - 1 != fed:
                raise ValueError("no token covers a symbol")
            if len(last) > 2 * ahead:
                ends = self._ends(last)
                done = max((e for e in ends if e < len(last) - ahead), default=0)
                yield from (last[e] for e in ends if e <= done)
                base, last = base + done, last[done:]
        yield from (last[e] for e in self._ends(last))

    def _ends(self, last: list[int | None]) -> list[int]:
        """Ends of the tokens on the way back from the front, in order."""
        at, ends = len(last) - 1, []
        while at > 0:
            ends.append(at)
            at -= self.width[last[at]]
        return ends[::-1]

    # --- sufficient lookahead ----------------------------------------------------------

    @property
    def lookahead(self) -> int:
        """Symbols to the right of a token's end after which no continuation changes the token.

        A merge r = (a, b) can be undone from the right only by an earlier-ranked
        merge (c, d) that takes a suffix c of b and joins it to d, the symbols
        right of b; that merge can in turn be undone by a still earlier one at
        d's end, and so on with falling ranks. reach(r), the symbols that such
        chains span, is therefore found in one pass by rank:
        reach(r) = max over suffixes c of b, over earlier merges (c, d), of len(d) + reach((c, d)).
        The last token at a boundary may still grow by itself: one longest token more.
        """
        return _lookahead(self)

    def segments(self, text: str) -> list[str]:
        """The text split at special strings; the odd entries are these strings."""
        return self.special_re.split(text) if self.special_re else [text]


@lru_cache(maxsize=8)
def _lookahead(merges: MergeList) -> int:
    best: dict[str, int] = {}
    strings, most = merges._strings, 0
    ends = {i for t, i in merges.vocab.items() if merges.suffix and t.endswith(merges.suffix)}
    for left, right in merges._order:  # in rank order
        a, b = strings[left], strings[right]
        # What closes a word is nobody's left part.
        reach = 0 if right in ends else max(best.get(b[i:], 0) for i in range(len(b)))
        best[a] = max(best.get(a, 0), len(b) + reach)
        most = max(most, reach)
    return most + merges.max_len


@lru_cache(maxsize=4)
def merge_list(path: str) -> MergeList:
    """One per path and process."""
    return MergeList(path)
