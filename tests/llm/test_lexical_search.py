"""Operator 12 against brute force, its tree by itself, and odd input."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from citeloom.llm import lexical_search as ls
from citeloom.llm import queries
from tests.llm.test_operators import made

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k=20):
    """rows: (id, text); items: (id, text). Sorted (item, rank, id, score); ids of equal rows may repeat."""
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    total = sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in docs:
            m = 100 - 25 + (25 * n * len(docs)) // total
            score = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, 0, 0, "z") for i, t in items], "item_id bigint, text string, q bigint, rank bigint, block string")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    pool = [f"W{int(rng.paretovariate(0.6)) % 3000}" for _ in range(4000)] + ["é", "É", "x1", "漢"]
    rows = [(rng.randrange(10_000), rng.choice([" ", ". ", "-"]).join(rng.choices(pool, k=rng.randrange(1, 120)))) for _ in range(700)]
    rows += [(i, rows[0][1]) for i in range(20_000, 20_060)] + [(5, "w1 w1 w1"), (5, "w1 w1 w1"), (None, "w1 w2"), (None, rows[0][1]), (6, None), (7, ""), (8, " .,-_{}"), (9, "w1 " * 50_000)]
    items = [(i, " ".join(rng.choices(pool, k=rng.randrange(1, 40)))) for i in range(40)]
    return rows, items + [(100, rows[0][1]), (100, rows[0][1]), (None, "w1"), (101, ""), (102, None), (103, "nobody has this"), (104, "w1 w1 W1 w2")]


def test_search_equals_brute_force(spark, corpus):
    rows, items = corpus
    assert result(ls.lexical_search(made(spark, rows), benchmark(spark, items))) == brute(rows, items)


def test_small_shards_blocks_and_pools_change_nothing(spark, corpus, monkeypatch):
    rows, items = corpus
    for name, value in {"POSTINGS": 300, "BLOCK": 60, "OPEN": 2, "POOL": 16}.items():
        monkeypatch.setattr(ls, name, value)
    docs = made(spark, rows[:60] + rows[-70:]).repartition(3)
    assert result(ls.lexical_search(docs, benchmark(spark, items[:12] + items[-7:]), k=3)) == brute(rows[:60] + rows[-70:], items[:12] + items[-7:], 3)


def test_empty_tables(spark):
    docs, items = made(spark, [(1, "a b")]), benchmark(spark, [(1, "a")])
    assert result(ls.lexical_search(docs.filter("false"), items)) == []
    assert result(ls.lexical_search(docs, items.filter("false"))) == []
    assert result(ls.lexical_search(made(spark, [(1, None), (2, "")]), items)) == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({ls.ORACLE})").fetchall()
    assert result(queries.queries()["op12_lexical_search"](spark, sf)) == sorted(want, key=repr)


@pytest.mark.parametrize("size", [1, 2, 3, 64, 500])
def test_tree_is_sorted_by_impact_and_navigable_by_document(size):
    rng = np.random.default_rng(size)
    has = rng.random((5, size)) < 0.4
    term, document = np.nonzero(has)
    impact = rng.integers(1, 50, len(term))
    shard = ls.Shard(5, term, document, impact, np.arange(size) * 3, np.zeros(size, bool))
    told = {(t, d): i for t, d, i in zip(term, document, impact)}
    for t in range(5):
        assert [shard.impact_of(t, d) for d in range(size)] == [told.get((t, d), 0) for d in range(size)]
        own = shard.impact[0, shard.starts[t] : shard.starts[t + 1]]
        assert (np.diff(own.astype(int)) <= 0).all()


def test_bounds_leave_most_nodes_closed():
    """Impacts that differ let the search open a small part of the tree; results stay exact."""
    rng = np.random.default_rng(4)
    size, k = 20_000, 10
    term = np.repeat(np.arange(4), size)
    document = np.tile(np.arange(size), 4)
    impact = (rng.pareto(1.5, 4 * size) * 1000).astype(np.int64) + 1
    shard = ls.Shard(4, term, document, impact, np.arange(size), np.zeros(size, bool))
    block, best = ls.Queries(np.array([0, 2, 4]), np.array([0, 1, 2, 3]), np.array([3, 1, 2, 2])), ls.Best(2, k)
    opened = shard.search(block, best)
    scores = impact.reshape(4, size)
    for q, want in enumerate((3 * scores[0] + scores[1], 2 * scores[2] + 2 * scores[3])):
        order = np.lexsort((np.arange(size), -want))[:k]
        assert best.ids[q].tolist() == order.tolist() and best.scores[q].tolist() == want[order].tolist()
    assert opened < size / 5
