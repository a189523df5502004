"""Operator 11 against brute force; the perfect hash and the bit table by themselves."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from citeloom.llm import collocations, queries
from citeloom.llm.perfect_hash import PerfectHash
from tests.llm.test_operators import made

SCHEMA = "doc_id bigint, text string, lang string, key string, a bigint, level string, shard string, k string, n string"


def with_lang(spark, rows):
    """rows: (lang, text); other columns have names that the operator uses itself."""
    return spark.createDataFrame([(i, t, lang, "x", 1, None, None, None, None) for i, (lang, t) in enumerate(rows)], SCHEMA)


def brute(rows, least, top=2000, inside=80):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    key = (lang, tuple(words[i : i + n]))
                    counts[key] = counts.get(key, 0) + 1
    out = []
    frequent = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    for (lang, p), a in frequent.items():
        longer = [b for (g, q), b in frequent.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= inside * a for b in longer):
            continue
        cuts = [(2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], totals[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return sorted(ranked)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(30)] + ["É", "é", "Der", "der", "漢字", "a-b", "x\x1cy"]
    out = []
    for i in range(250):
        marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", "! ", " ;: "]
        out.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), "".join(rng.choice(pool[: rng.choice([6, 37])]) + rng.choice(marks) for _ in range(rng.randrange(80)))))
    return out + [("en", None), ("en", ""), (None, None), ("fr", " .,;\n"), ("en", "of the of the of the " * 200), ("en", "one two three four " * 60), *[("de", "same row again and again")] * 40]


@pytest.mark.parametrize("least", [3, 30])
def test_collocations_equal_brute_force(spark, rows, least):
    assert result(collocations.collocations(with_lang(spark, rows), least=least)) == brute(rows, least)


def test_small_buffers_shards_and_bits_change_nothing(spark, rows, monkeypatch):
    """Flushes after some words, many shards, slices of a few parts, a bit table full of false bits."""
    for name, value in {"FLUSH": 50, "VOCABULARY": 40, "STRETCH": 64, "SHARD_SUMS": 200, "SHARD_BYTES": 500, "BATCH": 16, "SLICE": 8, "BITS": 64}.items():
        monkeypatch.setattr(collocations, name, value)
    monkeypatch.setattr("citeloom.llm.common.HOT", 16)
    assert result(collocations.collocations(with_lang(spark, rows).repartition(3), least=5, top=40)) == brute(rows, 5, 40)


def test_no_rows_and_nothing_frequent(spark):
    assert result(collocations.collocations(with_lang(spark, [("en", "a b"), (None, None)]).filter("false"))) == []
    assert result(collocations.collocations(with_lang(spark, [("en", "a b c"), (None, None)]))) == []
    with pytest.raises(ValueError, match="least"):
        collocations.collocations(made(spark, [(1, "a")]), least=0)


def test_one_phrase_holds_most_rows(spark):
    """A word pair that a third of all rows is made of, and a word that begins most phrases."""
    rows = [("en", "hot pair " * 30)] * 100 + [("en", f"the w{i % 40} x{i % 3}. ") for i in range(200)] * 2
    assert result(collocations.collocations(with_lang(spark, rows), least=5)) == brute(rows, 5)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({collocations.ORACLE})").fetchall()
    assert result(queries.queries()["op11_collocations"](spark, sf)) == sorted(want)


def test_counts_pass_64_bits_times_two_million(spark):
    """The score's products are exact where 64 bits and doubles are not."""
    a, lr = 4_000_000_000_000_007, 4_000_000_000_000_009
    slots = np.array([0, 1, 0])
    assert collocations.bincount(slots, np.array([a, lr, 1], np.int64), 2).tolist() == [a + 1, lr]
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(lr).alias("l1"), F.lit(lr + 5).alias("r1"))
    score = row.selectExpr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(l1 as decimal(20,0)) + cast(r1 as decimal(20,0)))").first()[0]
    assert score == 2_000_000 * a // (2 * lr + 5)


def test_perfect_hash_is_minimal_and_travels():
    rng = np.random.default_rng(1)
    for size in (0, 1, 2, 63, 5000, 100_000):
        keys = np.unique(rng.integers(0, 1 << 63, size, dtype=np.int64)).view(np.uint64)
        table = PerfectHash.build(keys)
        assert table.size == len(keys)
        assert sorted(table.slots(keys)) == list(range(len(keys)))
        again = PerfectHash.from_bytes(table.to_bytes())
        assert (again.slots(keys) == table.slots(keys)).all()
        others = again.slots(rng.integers(0, 1 << 63, 1000, dtype=np.int64).view(np.uint64))
        assert ((others >= -1) & (others < max(1, len(keys)))).all()
    with pytest.raises(ValueError, match="distinct"):
        PerfectHash.build(np.array([5, 5], np.uint64))


def test_a_shard_verifies_keys_and_keeps_equal_hashes_apart(monkeypatch):
    hashes = {b"en\na": 7, b"en\nb": 7, b"en\nc": 9, b"en\nrare": 11, b"en\nzzz": 9}  # a and b have one hash, and so have c and zzz
    monkeypatch.setattr(collocations, "hashes_of", lambda keys: np.array([hashes[k] for k in keys.to_pylist()], np.uint64))
    shard = collocations.Shard.counted(pa.array([b"en\na", b"en\nb", b"en\nc", b"en\na", b"en\nrare"]), np.array([3, 4, 9, 2, 1], np.int64), 4)
    counts = dict(zip(shard.keys.to_pylist(), shard.counts.tolist()))
    assert {k: v for k, v in counts.items() if v >= 4} == {b"en\na": 5, b"en\nb": 4, b"en\nc": 9}
    found = shard.slots(pa.array([b"en\nb", b"en\nzzz", b"en\nc"]))
    assert found[1] == -1 and [shard.counts[found[0]], shard.counts[found[2]]] == [4, 9]


def test_payloads_travel():
    rng = random.Random(2)
    keys = pa.array([bytes(rng.randrange(256) for _ in range(rng.randrange(12))) for _ in range(2000)] + [b""], pa.binary())
    counts = np.arange(2001, dtype=np.int64) << 20
    parts = list(collocations.packed(keys, counts, 7))
    back, sums = collocations.unpacked([p for _, p in parts])
    assert sorted(zip(back.to_pylist(), sums.tolist())) == sorted(zip(keys.to_pylist(), counts.tolist()))
    for shard, payload in parts:
        assert set(collocations.hashes_of(collocations.unpacked([payload])[0]) % np.uint64(7)) == {shard}
    assert (collocations.hashes_of(keys.slice(5, 10)) == collocations.hashes_of(keys)[5:15]).all()
    assert len(set(collocations.hashes_of(keys).tolist())) == len(set(keys.to_pylist()))


def test_bits_have_no_false_negatives(spark):
    words = [f"w{i}" for i in range(300)]
    counted = spark.createDataFrame([(f"en\n{a} {b}", f"{a} {b}", "en", 5) for a, b in zip(words, words[1:])] + [("en\n", "", "en", 9)], "key string, phrase string, lang string, a bigint")
    bits = collocations._bits(spark, counted, 2)
    h = np.array([xxhash.xxh64_intdigest(f"en\n{w}".encode(), 42) for w in words], np.uint64)
    pairs = h[:-1] ^ collocations._rotated(h[1:], 21)
    assert bits.holds(pairs).all() and all(bits.has(int(x)) for x in pairs)
    assert [bits.has(int(x)) for x in h] == bits.holds(h).tolist()
    assert bits.holds(np.random.default_rng(1).integers(0, 1 << 63, 10_000, dtype=np.int64).view(np.uint64)).mean() < 0.2
