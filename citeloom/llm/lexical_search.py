"""Operator 12, ranked lexical search: dual-sorted wavelet trees and best-first search.

Each task cuts its documents into shards of bounded size. A shard's postings stand
term after term, highest impact first, and a wavelet tree over their document
numbers keeps that order in every node: the range of a term in a node starts with
its highest impact among the node's documents, so the sum of these over a query's
terms bounds every score below the node. The search opens nodes by bound, best
first, splits each term's range by rank, and reaches leaves, where the bound is the
score; a node that cannot reach a query's k-th score (or reaches it with larger ids
only) is never opened. All queries of a block go down together in numpy arrays.
The k-th scores carry over from one shard of a task to the next.

The documents are read twice for a block of queries, once for counts (documents,
words, documents of each term), once to index and search; texts are never
shuffled. What leaves a task is its best ``k`` rows of each query. Queries come in
blocks of BLOCK terms, of which there are as many as it takes, so a task holds one
block, whatever the number of queries. A term that nobody asks for gets no postings.
Defined results: null and empty texts have no terms and are never found; a query
without terms, or whose terms no document has, finds nothing; repeated rows, of
documents or queries, are rows of their own; equal scores go by ascending id, null
ids last; empty tables give an empty result. Ids of documents are integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import idle, running, save

#: Parameters of a score, in thousandths, hundredths and units.
LENGTH_SHARE, SATURATION, SCALE = 25, 12, 1_000_000_000
#: Postings of a shard (one longer document has more); terms of a block of queries; nodes that a query opens at once.
POSTINGS, BLOCK, OPEN = 1 << 19, 1 << 18, 64
#: Ranges of nodes not opened yet that are kept before closed ones are swept out.
POOL = 1 << 21
LAST = np.iinfo(np.int64).max
#: Everything but ASCII letters and digits, and bytes beyond ASCII, parts terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def norm(n: int, documents: int, words: int) -> int:
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // words


class Best:
    """The k best (score, id) of each query; ``least`` is the score to reach, ``until`` the id up to which an equal score still counts."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.zeros((queries, k), np.int64)
        self.ids = np.full((queries, k), -1, np.int64)
        self.nulls = np.zeros((queries, k), bool)

    @property
    def least(self) -> np.ndarray:
        return self.scores[:, -1]

    @property
    def until(self) -> np.ndarray:
        return self.ids[:, -1]

    def open(self, query: np.ndarray, bound: np.ndarray, lowest: np.ndarray) -> np.ndarray:
        """Which bounds may still change a query's result, ``lowest`` being the smallest id below."""
        least = self.least[query]
        return (bound > least) | ((bound == least) & (least > 0) & (lowest <= self.until[query]))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        met = np.unique(query)
        held = self.scores[met] > 0
        query = np.concatenate([query, np.repeat(met, held.sum(1))])
        score, ids, nulls = (np.concatenate([new, old[met][held]]) for new, old in ((score, self.scores), (ids, self.ids), (nulls, self.nulls)))
        order = np.lexsort((nulls, ids, -score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order, place = order[place < self.k], place[place < self.k]
        at = (query[order], place)
        self.scores[met], self.ids[met], self.nulls[met] = 0, -1, False
        self.scores[at], self.ids[at], self.nulls[at] = score[order], ids[order], nulls[order]


@dataclass(frozen=True)
class Queries:
    """A block of queries: terms and weights (times their repeats) of query i stand from starts[i] to starts[i + 1]."""

    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1


class Shard:
    """Postings of some documents as a dual-sorted wavelet tree, one array a level."""

    def __init__(self, terms: int, term: np.ndarray, document: np.ndarray, impact: np.ndarray, ids: np.ndarray, nulls: np.ndarray):
        """``document`` numbers rows of ``ids``, which ascend, null ones last; each (term, document) occurs once."""
        order = np.lexsort((document, -impact, term))
        self.ids, self.nulls, self.size = ids, nulls, len(order)
        self.depth = max(1, (len(ids) - 1).bit_length())
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=terms))])
        node, impact = document[order], impact[order]
        # Per level: how many of the postings before a place go left, where the right ones begin, impacts in the level's order.
        self.left = np.zeros((self.depth, self.size + 1), np.int32)
        self.right = np.zeros(self.depth, np.int64)
        self.impact = np.empty((self.depth + 1, self.size), np.int32)
        self.impact[0] = impact
        for level in range(self.depth):
            goes_left = (node >> (self.depth - 1 - level)) & 1 == 0
            np.cumsum(goes_left, out=self.left[level, 1:])
            self.right[level] = self.left[level, -1]
            stable = np.concatenate([np.flatnonzero(goes_left), np.flatnonzero(~goes_left)])
            node, impact = node[stable], impact[stable]
            self.impact[level + 1] = impact

    def impact_of(self, term: int, document: int) -> int:
        """The impact of one document for a term, 0 if it has it not: navigation by document, bit by bit."""
        low, high = int(self.starts[term]), int(self.starts[term + 1])
        for level in range(self.depth):
            a, b = int(self.left[level, low]), int(self.left[level, high])
            low, high = (low - a + int(self.right[level]), high - b + int(self.right[level])) if (document >> (self.depth - 1 - level)) & 1 else (a, b)
        return int(self.impact[self.depth, low]) if low < high else 0

    def search(self, queries: Queries, best: Best) -> int:
        """Takes what this shard has into ``best``; returns how many nodes were opened."""
        opened, rounds, width = 0, 0, OPEN
        low, high = self.starts[queries.terms], self.starts[queries.terms + 1]
        owner = np.repeat(np.arange(len(queries)), np.diff(queries.starts))
        some = low < high
        nodes = _Nodes(self)
        nodes.add(owner[some], np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64), np.arange(len(queries)), queries.weights[some], low[some], high[some], best)
        while nodes.take_open(best):
            chosen = nodes.first(width)
            opened += len(chosen)
            for child in nodes.split(chosen):
                nodes.add(*child, best)
            nodes.drop(chosen)
            rounds += 1
            width = OPEN if rounds <= self.depth else min(4096, 2 * width)
        return opened


class _Nodes:
    """Nodes not opened yet: query, level, prefix, bound, and their terms' ranges in a pool."""

    def __init__(self, shard: Shard):
        self.shard = shard
        self.query = self.level = self.prefix = self.bound = self.lowest = self.start = self.count = np.zeros(0, np.int64)
        self.weights = self.lows = self.highs = np.zeros(0, np.int64)

    _FIELDS = ("query", "level", "prefix", "bound", "lowest", "start", "count")

    def _keep(self, at: np.ndarray) -> None:
        for name in self._FIELDS:
            setattr(self, name, getattr(self, name)[at])

    def _entries(self, at: np.ndarray) -> np.ndarray:
        counts = self.count[at]
        return np.repeat(self.start[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())

    def take_open(self, best: Best) -> bool:
        """Leaves out nodes that cannot matter any more; sweeps the pool."""
        self._keep(np.flatnonzero(best.open(self.query, self.bound, self.lowest)))
        if len(self.lows) > POOL and 2 * int(self.count.sum()) < len(self.lows):
            at = self._entries(np.arange(len(self.query)))
            self.weights, self.lows, self.highs = self.weights[at], self.lows[at], self.highs[at]
            self.start = np.cumsum(self.count) - self.count
        return len(self.query) > 0

    def first(self, width: int) -> np.ndarray:
        """The ``width`` nodes of highest bound of each query."""
        order = np.lexsort((-self.bound, self.query))
        return order[np.arange(len(order)) - np.searchsorted(self.query[order], self.query[order]) < width]

    def drop(self, chosen: np.ndarray) -> None:
        stays = np.ones(len(self.query), bool)
        stays[chosen] = False
        self._keep(np.flatnonzero(stays))

    def split(self, chosen: np.ndarray) -> list[tuple]:
        """Both children of each chosen node, as arguments of ``add``."""
        shard, at = self.shard, self._entries(chosen)
        owner = np.repeat(np.arange(len(chosen)), self.count[chosen])
        level = self.level[chosen][owner]
        low, high = self.lows[at], self.highs[at]
        a, b, right = shard.left[level, low].astype(np.int64), shard.left[level, high].astype(np.int64), shard.right[level]
        query, below, prefix, weights = self.query[chosen], self.level[chosen] + 1, self.prefix[chosen] * 2, self.weights[at]
        out = []
        for side, low, high in ((0, a, b), (1, low - a + right, high - b + right)):
            some = low < high
            out.append((owner[some], below, prefix + side, query, weights[some], low[some], high[some]))
        return out

    def add(self, owner: np.ndarray, level: np.ndarray, prefix: np.ndarray, query: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray, best: Best) -> None:
        """New nodes: those of ``owner``, which ascends and indexes level, prefix and query, with their ranges. Leaves are results."""
        if not len(owner):
            return
        shard = self.shard
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        node = owner[first]
        bound = np.add.reduceat(weights * shard.impact[level[owner], low], first)
        level, prefix, query = level[node], prefix[node], query[node]
        lowest = shard.ids[np.minimum(prefix << (shard.depth - level), len(shard.ids) - 1)]
        opens = best.open(query, bound, lowest)
        leaf = opens & (level == shard.depth)
        if leaf.any():
            best.add(query[leaf], bound[leaf], shard.ids[prefix[leaf]], shard.nulls[prefix[leaf]])
        inner = opens & ~leaf
        count = np.diff(np.append(first, len(owner)))
        kept = np.repeat(inner, count)
        count = count[inner]
        new = (query[inner], level[inner], prefix[inner], bound[inner], lowest[inner], len(self.lows) + np.cumsum(count) - count, count)
        for name, values in zip(self._FIELDS, new, strict=True):
            setattr(self, name, np.concatenate([getattr(self, name), values]))
        self.weights, self.lows, self.highs = (np.concatenate([old, x[kept]]) for old, x in ((self.weights, weights), (self.lows, low), (self.highs, high)))


class Postings:
    """Documents on their way into a shard: postings of wanted terms."""

    def __init__(self, wanted: dict[bytes, int], documents: int, words: int):
        self.wanted, self.documents, self.words = wanted, documents, words
        self._reset()

    def _reset(self) -> None:
        self._terms, self._counts, self._sizes, self._norms, self._ids, self.size = [], [], [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        tokens = terms_of(text)
        found = Counter(map(self.wanted.get, tokens))
        found.pop(None, None)
        if found:
            self._terms.append(np.fromiter(found.keys(), np.int64, len(found)))
            self._counts.append(np.fromiter(found.values(), np.int64, len(found)))
            self._sizes.append(len(found))
            self._norms.append(norm(len(tokens), self.documents, self.words))
            self._ids.append(doc_id)
            self.size += len(found)

    def shard(self) -> Shard | None:
        """What was added, as a shard."""
        if not self._ids:
            return None
        nulls = np.array([i is None for i in self._ids])
        ids = np.array([LAST if i is None else i for i in self._ids], np.int64)
        order = np.lexsort((nulls, ids))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        counts, norms = np.concatenate(self._counts), np.repeat(np.array(self._norms, np.int64), self._sizes)
        impact = SCALE * counts // (1000 * counts + SATURATION * norms)
        made = Shard(len(self.wanted), np.concatenate(self._terms), np.repeat(number, self._sizes), impact, ids[order], nulls[order])
        self._reset()
        return made


def _statistics(texts: DataFrame, wanted: list[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with terms, all their words, and the documents of each wanted term: at most one row of each reaches the driver."""
    shared = texts.sparkSession.sparkContext.broadcast(frozenset(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, documents, words = Counter(), 0, 0
        for batch in batches:
            column = batch.column(1).cast(pa.binary())
            for i in range(batch.num_rows):
                tokens = terms_of(column[i].as_py())
                documents, words = documents + bool(tokens), words + len(tokens)
                met.update(shared.value.intersection(tokens))
        yield pa.RecordBatch.from_arrays([pa.array([None, *met], pa.binary()), pa.array([documents, *met.values()], pa.int64()), pa.array([words, *[0] * len(met)], pa.int64())], names=["term", "documents", "words"])
        idle()

    parts = texts.mapInArrow(run, "term binary, documents bigint, words bigint")
    rows = parts.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("words").alias("words")).collect()
    totals = next(((r.documents, r.words) for r in rows if r.term is None), (0, 0))
    return *totals, {bytes(r.term): r.documents for r in rows if r.term is not None}


def _found(texts: DataFrame, wanted: dict[bytes, int], block: Queries, numbers: np.ndarray, documents: int, words: int, k: int) -> DataFrame:
    """q, doc_id, score: each task's best of every query of a block."""
    shared = texts.sparkSession.sparkContext.broadcast((wanted, block, numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, block, numbers = shared.value
        best, postings = Best(len(block), k), Postings(wanted, documents, words)

        def search() -> None:
            if shard := postings.shard():
                shard.search(block, best)

        for batch in batches:
            ids, column = batch.column(0), batch.column(1).cast(pa.binary())
            for i in range(batch.num_rows):
                postings.add(ids[i].as_py(), column[i].as_py())
                if postings.size >= POSTINGS:
                    search()
        search()
        at = np.nonzero(best.scores > 0)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[at[0]]), pa.array(best.ids[at], mask=best.nulls[at]), pa.array(best.scores[at])], names=["q", "doc_id", "score"])
        idle()

    return texts.mapInArrow(run, "q bigint, doc_id bigint, score bigint")


def _asked(queries: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item, terms with repeats as (term, times), in blocks by running size."""
    kept = queries.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    item = kept.schema["item"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.binary())
            found = [Counter(terms_of(column[i].as_py())) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64())), pa.array([len(c) for c in found], pa.int64())],
                names=["item", "terms", "times", "size"],
            )

    made = kept.mapInArrow(run, f"item {item.simpleString()}, terms array<binary>, times array<bigint>, size bigint")
    return running(made.filter("size > 0"), [F.col("item"), F.xxhash64("terms", "times")], ["size"])


def lexical_search(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each query: item_id, rank, doc_id, score."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t")).filter("t IS NOT NULL")
    asked = save(_asked(queries, item_col, query_col).select(F.col("__place").alias("q"), "item", "terms", "times", F.floor(F.col("__before_size") / BLOCK).alias("block")), "lexical-queries")
    found = docs.sparkSession.createDataFrame([], "q bigint, doc_id bigint, score bigint")
    for block in range((asked.agg(F.max("block")).first()[0] or 0) + 1):
        rows = asked.filter(F.col("block") == block).select("q", "terms", "times").collect()  # BLOCK terms and one query more, at most
        wanted = {t: i for i, t in enumerate(dict.fromkeys(bytes(t) for r in rows for t in r.terms))}
        documents, words, df = _statistics(texts, list(wanted))
        if not rows or not df:
            continue
        weights = {t: weight(documents, n) for t, n in df.items()}
        starts = np.cumsum([0, *(len(r.terms) for r in rows)])
        told = Queries(starts, np.array([wanted[bytes(t)] for r in rows for t in r.terms]), np.array([weights.get(bytes(t), 0) * n for r in rows for t, n in zip(r.terms, r.times, strict=True)], np.int64))
        found = found.unionByName(_found(texts, wanted, told, np.array([r.q for r in rows], np.int64), documents, words, k))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("q", "item"), "q").select(F.col("item").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")


#: The query's result in SQL: every posting that a query meets, added up.
ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), docs AS (SELECT r, doc_id, w, len(w) AS n FROM words WHERE len(w) > 0
), totals AS (SELECT count(*) AS docs_n, sum(n)::BIGINT AS words_n FROM docs
), items AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark
), asked AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS term FROM items) GROUP BY ALL
), wanted AS (SELECT DISTINCT term FROM asked
), postings AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM docs) SEMI JOIN wanted USING (term) GROUP BY ALL
), weights AS (SELECT term, floor(1000 * ln((2 * docs_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY term, docs_n
), impacts AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs_n) // words_n)) AS i FROM postings, totals
), scores AS (SELECT q, item_id, r, doc_id, sum(times * w * i)::BIGINT AS score FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
