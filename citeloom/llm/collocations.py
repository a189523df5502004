"""Operator 11, phrase collocation mining: perfect-hash counting, level by level.

A phrase of n words can occur ``least`` times only if both phrases of n - 1 words
in it do (Apriori). Level n reads the documents once: mappers cut them into words,
drop every phrase one of whose parts is not in the level before's bit table, and
add equal ones up over some million words with numpy before anything is
shuffled. The bit table has a bound (BITS); a false bit lets a phrase through
and drops none, so results are exact however full it is.

Sums then meet in shards, by the hash of language and phrase, packed by flush and
shard: phrases in order of their first words, which compress to a few bytes each.
A shard adds up hash buckets first: a phrase whose bucket stays below ``least`` is no candidate. Over
the candidates it builds a minimal perfect hash, stores the phrase of each slot,
and counts its batches into numpy arrays by slot (a phrase that is not the one
stored at its slot is left out), which are summed as a tree. So a shard's table
is a hash, stored phrases and an array of counts. Cuts are read by slot: the parts
of each phrase go to the shards that hold them, in slices of bounded size with a
copy of the table each, so a word that begins a third of all phrases fills no task.

The number of shards follows the number of sums, so each task is bounded at
every size of input; a language that holds most rows is spread like any other.
Defined results: null text counts as empty; null language is ``und``; repeated
rows count again; null ids do not matter; an empty table gives an empty result.
Counts pass through 64-bit integers, products and sums through decimals of 38
digits. Only the text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.common import idle, join_groups, save
from citeloom.llm.perfect_hash import PerfectHash, mixed, mixed_one

LONGEST = 4
#: Words that a mapper numbers before it starts a new vocabulary.
VOCABULARY = 1_000_000
#: Words that a mapper adds up at once; bytes of a text that it cuts at once (up to the next end of a piece).
FLUSH, STRETCH = 2_000_000, 1 << 22
#: Sums of a shard, on average; rows of a batch that is counted into one array; parts that one copy of a shard's table answers.
SHARD_SUMS, BATCH, SLICE = 1 << 17, 1 << 15, 1 << 13
#: Bytes of text for each shard of single words, most of which are added up before.
SHARD_BYTES = 1 << 22
#: Bits of a level's table at most: 16 MB on the driver and in each worker.
BITS = 1 << 27
#: What ends a piece becomes a byte that no text has.
_END = 0xFF
_BYTES = bytes(_END if chr(b) in ".,;:!?\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_ROTATE = 21


@dataclass(frozen=True)
class Bits:
    """Which hashes may be those of frequent phrases; ``words`` has a power of two of bits."""

    words: np.ndarray

    def has(self, h: int) -> bool:
        """One hash, without numpy."""
        at = mixed_one(h) & (64 * len(self.words) - 1)
        return bool(int(self.words[at >> 6]) >> (at & 63) & 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = mixed(hashes, 0) & np.uint64(64 * len(self.words) - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x if not by else (x << np.uint64(by)) | (x >> np.uint64(64 - by))


class _Ids(dict):
    """Words of one language to numbers that no other language shares; -1 for those that cannot be frequent, and for the ends of pieces."""

    def __init__(self, lang: bytes, sums: Sums):
        super().__init__({bytes([_END]): -1})
        self._lang, self._sums = lang + b"\n", sums

    def __missing__(self, word: bytes) -> int:
        self[word] = number = self._sums.number(self._lang + word, word)
        return number


class Sums:
    """Phrases of n words, added up until they are handed on as (key, count); a key is the language, a line feed and the phrase.

    ``words`` and ``table`` are the bit tables of frequent words and of frequent phrases of n - 1 words.
    """

    def __init__(self, n: int, table: Bits | None = None, words: Bits | None = None):
        self.n, self.table, self.frequent = n, table, words
        self._ids, self.size = [], 0
        self._forget()

    def _forget(self) -> None:
        """Starts a new vocabulary."""
        self._words, self._keys, self._hashes, self._langs, self._met, self._counts = [], [], [], {}, 0, np.zeros(0, np.int64)

    def number(self, key: bytes, word: bytes) -> int:
        self._met += 1
        if self.frequent is not None:
            h = xxhash.xxh64_intdigest(key, 42)
            if not self.frequent.has(h):
                return -1
            self._hashes.append(h)
        self._words.append(word)
        self._keys.append(key)
        return len(self._words) - 1

    def add(self, lang: bytes, text: bytes) -> None:
        ids = self._langs.get(lang)
        if ids is None:
            ids = self._langs[lang] = _Ids(lang, self)
        end = bytes([_END])
        numbers = list(map(ids.__getitem__, text.translate(_BYTES).replace(end, b" " + end + b" ").split()))
        self._ids += np.array(numbers, np.int64), np.array([-1])
        self.size += len(numbers)

    def flush(self, last: bool = False) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """What was added since the last flush. Words are held back until the vocabulary is full, or to the end."""
        ids, self._ids, self.size = np.concatenate([*self._ids, np.zeros(0, np.int64)]), [], 0
        full = last or self._met > VOCABULARY
        if self.n == 1:
            counts = np.bincount(ids[ids >= 0], minlength=len(self._words))
            counts[: len(self._counts)] += self._counts
            self._counts = counts
            if full and self._words:
                yield from self._single(counts)
        elif len(ids):
            yield from self._several(ids)
        if full:
            self._forget()

    def _single(self, counts: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Words, and for each language the number of all its words, as the empty phrase."""
        yield pa.array(self._keys, pa.binary()), counts
        own = {lang: [n for n in ids.values() if n >= 0] for lang, ids in self._langs.items()}
        yield pa.array([lang + b"\n" for lang in own], pa.binary()), np.array([counts[n].sum() for n in own.values()], np.int64)

    def _several(self, ids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
        hashes = np.array([*self._hashes, 0], np.uint64)
        n, size = self.n, max(0, len(ids) - self.n + 1)
        window = lambda i, length=size: ids[i : i + length]
        # A part is frequent, or may be, where its n - 1 words stand in one piece and its bit is set.
        parts = np.ones(size + 1, bool)
        joined = np.zeros(size + 1, np.uint64)
        for i in range(n - 1):
            word = window(i, size + 1)
            parts &= word >= 0
            joined ^= _rotated(hashes[np.maximum(word, 0)], i * _ROTATE)
        parts &= self.table.holds(joined)
        at = np.flatnonzero(parts[:-1] & parts[1:])
        if not len(at):
            return
        # Phrases to dense numbers, a word at a time; ``first`` is a place of each.
        code, first = ids[at], None
        for i in range(1, n):
            pairs, first, code, counts = np.unique(code << 32 | ids[at + i], return_index=True, return_inverse=True, return_counts=True)
        words, keys, first = pa.array(self._words, pa.binary()), pa.array(self._keys, pa.binary()), at[first]
        yield pc.binary_join_element_wise(keys.take(ids[first]), *[words.take(ids[first + i]) for i in range(1, n)], pa.scalar(b" ", pa.binary())), counts


def stretches(text: bytes) -> Iterator[bytes]:
    """A text in stretches that end where a piece ends, so that no phrase is cut."""
    at = 0
    while len(text) - at > STRETCH:
        ends = [e for e in (text.find(mark, at + STRETCH) for mark in (b"\n", b".", b",")) if e >= 0]
        if not ends:
            break
        yield text[at : min(ends) + 1]
        at = min(ends) + 1
    yield text[at:]


_FACTOR = 0x9E6C63D0876A9A47


def hashes_of(keys: pa.Array) -> np.ndarray:
    """64-bit hashes of binary keys: polynomials over their bytes, mixed. Some thousand keys at a time, as a byte takes 24 on the way."""
    out = [np.zeros(0, np.uint64)]
    for i in range(0, len(keys), BATCH):
        part = keys[i : i + BATCH]
        offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        sizes, offsets = np.diff(offsets), offsets[:-1] - offsets[0]
        powers = np.cumprod(np.full(max(1, int(sizes.max())), _FACTOR, np.uint64))
        terms = (data.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(offsets, sizes)]
        some, sums = sizes > 0, np.zeros(len(part), np.uint64)
        sums[some] = np.add.reduceat(terms, offsets[some]) if some.any() else 0
        out.append(mixed(sums ^ sizes.astype(np.uint64), 0))
    return np.concatenate(out)


def packed(keys: pa.Array, counts: np.ndarray, n_shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, payload) of keys and counts, in the keys' order: number, counts, lengths, bytes."""
    shard = (hashes_of(keys) % np.uint64(n_shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys.take(pa.array(order)), counts[order].astype(np.int64)
    offsets = np.frombuffer(keys.buffers()[1], np.int32)[: len(keys) + 1]
    data, lengths = memoryview(keys.buffers()[2]), np.diff(offsets).astype(np.uint32)
    ends = np.flatnonzero(np.diff(shard, append=-1)) + 1
    press = zstandard.ZstdCompressor(level=3)
    for a, b in zip([0, *ends], ends):
        yield int(shard[a]), press.compress(b"".join((np.uint32(b - a).tobytes(), counts[a:b].tobytes(), lengths[a:b].tobytes(), data[offsets[a] : offsets[b]])))


def unpacked(payloads: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Keys and counts of a shard's payloads, one after the other."""
    counts, lengths, data = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], []
    for payload in payloads:
        raw = zstandard.ZstdDecompressor().decompress(payload)
        n = int(np.frombuffer(raw, np.uint32, 1)[0])
        counts.append(np.frombuffer(raw, np.int64, n, 4))
        lengths.append(np.frombuffer(raw, np.uint32, n, 4 + 8 * n))
        data.append(raw[4 + 12 * n :])
    sizes = np.concatenate(lengths)
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(data))]), np.concatenate(counts)


def _partial_sums(docs: DataFrame, n: int, tables: tuple[Bits | None, Bits | None], n_shards: int, text_col: str, lang_col: str) -> DataFrame:
    """shard, payload: phrases of n words and how often a stretch of the documents has them."""
    kept = docs.select(F.col(text_col).cast("string").alias("t"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("l")).filter("t IS NOT NULL")
    shared = kept.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(n, *shared.value)

        def handed(last: bool = False) -> Iterator[pa.RecordBatch]:
            for keys, counts in sums.flush(last):
                rows = packed(keys, counts, n_shards)
                while part := list(islice(rows, 256)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary())], names=["shard", "payload"])

        for batch in batches:
            texts, langs = batch.column(0).cast(pa.binary()), batch.column(1).cast(pa.binary())
            for i in range(batch.num_rows):
                lang = langs[i].as_py()
                for stretch in stretches(texts[i].as_py()):
                    sums.add(lang, stretch)
                    if sums.size >= FLUSH:
                        yield from handed()
        yield from handed(last=True)
        idle()

    return kept.mapInArrow(run, "shard int, payload binary")


def bincount(slots: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of 64-bit counts by slot: low and high parts apart, as numpy adds weights up in doubles."""
    low = np.bincount(slots, counts & ((1 << 26) - 1), size).astype(np.int64)
    return low + (np.bincount(slots, counts >> 26, size).astype(np.int64) << 26)


def tree_sum(arrays: list[np.ndarray]) -> np.ndarray:
    while len(arrays) > 1:
        arrays = [a + b for a, b in zip(arrays[::2], arrays[1::2])] + ([arrays[-1]] if len(arrays) % 2 else [])
    return arrays[0]


@dataclass
class Shard:
    """Phrases by slot: a perfect hash, the key stored at each slot, its count. Keys of an equal hash follow at the end."""

    table: PerfectHash
    keys: pa.Array
    counts: np.ndarray

    def slots(self, keys: pa.Array, hashes: np.ndarray | None = None) -> np.ndarray:
        """The slot at which each key is stored, -1 where it is not."""
        hashes = hashes_of(keys) if hashes is None else hashes
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        found = self.table.slots(hashes)
        same = pc.equal(self.keys.take(np.maximum(found, 0)), keys).to_numpy(zero_copy_only=False) & (found >= 0)
        found[~same] = -1
        rest = {key: self.table.size + i for i, key in enumerate(self.keys[self.table.size :].to_pylist())}
        if rest:
            open_ = np.flatnonzero(~same)
            found[open_] = [rest.get(k, -1) for k in keys.take(open_).to_pylist()]
        return found

    @classmethod
    def counted(cls, keys: pa.Array, sums: np.ndarray, least: int) -> Shard:
        """From partial sums: bucket filter, hash over what passes, arrays by slot, their tree sum."""
        hashes = hashes_of(keys)
        width = 1 << max(6, 2 * len(keys) - 1).bit_length()
        bucket = (mixed(hashes, LONGEST + 1) & np.uint64(width - 1)).astype(np.int64)
        passed = np.flatnonzero(bincount(bucket, sums, width)[bucket] >= least)
        unique = keys.take(passed).dictionary_encode()
        codes = unique.indices.to_numpy(zero_copy_only=False)
        first = np.full(len(unique.dictionary), -1, np.int64)
        first[codes[::-1]] = passed[::-1]
        distinct, at = np.unique(hashes[first], return_index=True)
        table = PerfectHash.build(distinct)
        others = np.setdiff1d(np.arange(len(first)), at)
        order = np.empty(len(first), np.int64)
        order[table.slots(distinct)] = at
        order[len(at) :] = others
        shard = cls(table, unique.dictionary.take(order), np.zeros(len(first), np.int64))
        arrays = [shard.counts]
        for i in range(0, len(keys), BATCH):
            slots = shard.slots(keys[i : i + BATCH], hashes[i : i + BATCH])
            arrays.append(bincount(slots[slots >= 0], sums[i : i + BATCH][slots >= 0], len(first)))
        shard.counts = tree_sum(arrays)
        return shard


#: A key's two parts; no phrase holds a line feed.
_PHRASE = "substring_index(key, '\n', -1)"
_LANG = f"substr(key, 1, length(key) - length({_PHRASE}) - 1)"
_SHARD = "level int, shard int, sums bigint, keys array<string>, counts array<bigint>, bits binary"


def _shards(partial: DataFrame, level: int, least: int) -> DataFrame:
    def run(group: tuple, rows: pa.Table) -> pa.Table:
        keys, sums = unpacked(rows["payload"].to_pylist())
        shard = Shard.counted(keys, sums, least)
        return pa.table(
            {
                "level": pa.array([level], pa.int32()), "shard": pa.array([group[0].as_py()], pa.int32()), "sums": pa.array([len(keys)], pa.int64()),
                "keys": pa.array([shard.keys.cast(pa.string()).to_pylist()], pa.list_(pa.string())), "counts": pa.array([shard.counts], pa.list_(pa.int64())), "bits": pa.array([shard.table.to_bytes()], pa.binary()),
            }
        )

    return partial.groupBy("shard").applyInArrow(run, _SHARD)


def _counted(shards: DataFrame, least: int) -> DataFrame:
    """level, key, phrase, lang, a of what the shards hold at least ``least`` times."""
    rows = shards.select("level", F.explode(F.arrays_zip("keys", "counts")).alias("x")).select("level", F.col("x.keys").alias("key"), F.col("x.counts").alias("a")).filter(F.col("a") >= least)
    return rows.withColumns({"phrase": F.expr(_PHRASE), "lang": F.expr(_LANG)})


def _bits(spark: SparkSession, counted: DataFrame, level: int) -> Bits:
    """The level's bit table, made on executors; BITS / 64 rows reach the driver at most."""
    phrases = counted.filter("phrase <> ''")
    size = min(BITS, 1 << max(10, (16 * phrases.count()).bit_length()))
    joined = F.lit(0).cast("bigint")
    for i in range(level):
        h = F.xxhash64(F.concat("lang", F.lit("\n"), F.element_at(F.split("phrase", " "), i + 1)))
        joined = joined.bitwiseXOR(h if not i else F.shiftleft(h, i * _ROTATE).bitwiseOR(F.shiftrightunsigned(h, 64 - i * _ROTATE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(mixed(batch.column(0).to_numpy().view(np.uint64), 0) & np.uint64(size - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(at & 63, pa.int32())], names=["word", "bit"])

    places = phrases.select(joined.alias("h")).mapInArrow(run, "word bigint, bit int")
    rows = places.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Bits(words)


def _part(first: bool, k: int) -> Column:
    words = F.split("phrase", " ")
    taken = F.slice(words, 1, k) if first else F.slice(words, F.lit(k + 1), F.size(words) - k)
    return F.concat("lang", F.lit("\n"), F.array_join(taken, " "))


def _with_cuts(kept: DataFrame, shards: DataFrame, n_shards: dict[int, int]) -> DataFrame:
    """key, a and, for each cut k, l<k> and r<k>, null where a phrase has no such cut."""
    parts = []
    for k in range(1, LONGEST):
        for side in (True, False):
            size = F.lit(k) if side else F.col("level") - k
            parts.append(F.when(F.col("level") > k, F.struct(F.lit(k).alias("k"), F.lit(side).alias("first"), size.cast("int").alias("size"), _part(side, k).alias("part"))))
    asked = kept.select("key", "a", F.explode(F.array_compact(F.array(*parts))).alias("p")).select("key", "a", "p.k", "p.first", F.col("p.size").alias("level"), "p.part")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths = np.array([1, *(n_shards[level] for level in sorted(n_shards))], np.uint64)
        for batch in batches:
            shard = hashes_of(batch.column("part").cast(pa.binary())) % widths[batch.column("level").to_numpy()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32))], names=[*batch.schema.names, "shard"])

    asked = save(asked.mapInArrow(placed, "key string, a bigint, k int, first boolean, level int, part string, shard int"), "phrase-parts")
    sizes = asked.groupBy("level", "shard").agg(F.count(F.lit(1)).alias("asked")).withColumn("slices", F.ceil(F.col("asked") / SLICE).cast("int"))
    sliced = join_groups(asked, sizes, ["level", "shard"], "asked", ["key", "k", "first"]).withColumn("slice", F.pmod(F.xxhash64("key", "k"), F.col("slices")).cast("int")).drop("asked", "slices")
    copies = shards.join(sizes, ["level", "shard"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("level", "shard", "slice", "keys", "counts", "bits")

    def read(requests: pa.Table, table: pa.Table) -> pa.Table:
        counts = np.zeros(0, np.int64)
        if requests.num_rows:
            shard = Shard(PerfectHash.from_bytes(table["bits"][0].as_py()), table["keys"].combine_chunks().flatten().cast(pa.binary()), table["counts"].combine_chunks().flatten().to_numpy())
            counts = shard.counts[shard.slots(requests["part"].combine_chunks().cast(pa.binary()))]
        return pa.table({"key": requests["key"], "a": requests["a"], "k": requests["k"], "first": requests["first"], "f": pa.array(counts, pa.int64())})

    place = ["level", "shard", "slice"]
    found = sliced.groupBy(*place).cogroup(copies.groupBy(*place)).applyInArrow(read, "key string, a bigint, k int, first boolean, f bigint")
    at = lambda k, first: F.max(F.when((F.col("k") == k) & (F.col("first") == first), F.col("f")))
    return found.groupBy("key", "a").agg(*[at(k, first).alias(f"{'l' if first else 'r'}{k}") for k in range(1, LONGEST) for first in (True, False)])


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, inside: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``least``: occurrences of a candidate; a candidate that lies within a longer
    one with ``inside`` percent of its occurrences or more is dropped.
    """
    if least < 1:
        raise ValueError("least must be 1 or more")
    spark, words, table, tables, n_shards = docs.sparkSession, None, None, [], {}
    # What tells the number of shards: bytes, then words, then the sums of the level before, which no later level exceeds.
    most = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    for level in range(1, LONGEST + 1):
        n_shards[level] = max(1, -(-most // (SHARD_BYTES if level == 1 else SHARD_SUMS)))
        tables.append(save(_shards(_partial_sums(docs, level, (table, words), n_shards[level], text_col, lang_col), level, least), f"phrase-shards-{level}"))
        if level < LONGEST:
            table = _bits(spark, _counted(tables[-1], least), level)
            words = words or table
            total = _counted(tables[-1], least).filter("phrase = ''").agg(F.sum("a"))
            most = (total if level == 1 else tables[-1].agg(F.sum("sums"))).first()[0] or 0
    shards = tables[0].unionByName(tables[1]).unionByName(tables[2]).unionByName(tables[3])
    counted = _counted(shards, least)
    candidates = counted.filter("level > 1")
    inner = F.explode(F.array(_part(True, F.col("level") - 1), F.concat("lang", F.lit("\n"), F.substring("phrase", F.instr("phrase", " ") + 1, F.length("phrase")))))
    longer = candidates.filter("level > 2").select(inner.alias("key"), F.lit(None).cast("bigint").alias("a"), F.col("a").alias("longer"))
    met = candidates.select("key", "a", F.lit(None).cast("bigint").alias("longer")).unionByName(longer).groupBy("key").agg(F.max("a").alias("a"), F.max("longer").alias("longer"))
    dropped = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * inside
    kept = met.filter(F.col("longer").isNull() | ~dropped).select("key", "a").withColumns({"phrase": F.expr(_PHRASE), "lang": F.expr(_LANG)})
    kept = kept.withColumn("level", F.size(F.split("phrase", " ")))
    cut = _with_cuts(kept, shards, n_shards)
    score = lambda k: F.expr(f"(cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))")
    cuts = [F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)]
    best = cut.select("key", "a", F.array_min(F.array_compact(F.array(*cuts))).alias("b")).withColumns({"phrase": F.expr(_PHRASE), "lang": F.expr(_LANG)})
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score").withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    totals = counted.filter("level = 1 AND phrase = ''").select("lang", F.col("a").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The query's result in SQL: every phrase spelled out and counted.
ORACLE = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda w: w <> '') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS p FROM documents)
), starts AS (SELECT lang, words, unnest(generate_series(1, len(words))) AS i FROM pieces
), phrases AS (
  SELECT lang, n, array_to_string(words[i : i + n - 1], ' ') AS phrase, count(*) AS a FROM starts, (VALUES (1), (2), (3), (4)) v(n) WHERE i + n - 1 <= len(words) GROUP BY ALL
), frequent AS (SELECT * FROM phrases WHERE a >= 30
), totals AS (SELECT lang, sum(a)::BIGINT AS n FROM phrases WHERE n = 1 GROUP BY lang
), longer AS (
  SELECT lang, array_to_string(w[1 + s : len(w) - 1 + s], ' ') AS phrase, max(a) AS a FROM (SELECT lang, a, string_split(phrase, ' ') AS w, unnest([0, 1]) AS s FROM frequent WHERE n > 2) GROUP BY ALL
), kept AS (SELECT c.* FROM frequent c LEFT JOIN longer USING (lang, phrase) WHERE c.n > 1 AND (longer.a IS NULL OR 100 * longer.a < 80 * c.a)
), cuts AS (
  SELECT *, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS rest FROM kept, (VALUES (1), (2), (3)) v(k) WHERE k < n
), scored AS (
  SELECT c.lang, c.phrase, c.a, f.a AS l, r.a AS r, 2000000 * c.a // (f.a + r.a) AS score, k FROM cuts c JOIN phrases f ON f.lang = c.lang AND f.phrase = c.first JOIN phrases r ON r.lang = c.lang AND r.phrase = c.rest
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
