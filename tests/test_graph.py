"""Components, entities, reach, ranks, register and provisions against plain Python, with cycles, ties, nulls and empty tables."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from citeloom.operators import graph as G
from citeloom.operators import provisions as V
from citeloom.operators import register as N
from citeloom.storage import Kept


@pytest.fixture
def kept(spark):
    store = Kept(spark)
    yield store
    store.close()


# --- graph ---------------------------------------------------------------------------------


def test_components_of_chains_stars_and_loners(spark, kept):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 70)] + [(500, i) for i in range(501, 540)] + [(900, 901), (901, 900), (7000, 7000)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    nodes = sorted({n for p in pairs for n in p} | {9999})
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = G.components(spark.createDataFrame([(n,) for n in nodes], "node int"), spark.createDataFrame(pairs, "a int, b int"), kept)
    assert {r.node: r.component for r in got.collect()} == {n: root(n) for n in nodes}
    none = G.components(spark.createDataFrame([(3,)], "node int"), spark.createDataFrame([], "a int, b int"), kept)
    assert [tuple(r) for r in none.collect()] == [(3, 3)]


def test_entities(spark, kept):
    rows = [
        ("c1", "circular", None, "SEBI/HO/1", None, 2020), ("c2", "circular", None, "sebi-ho-1", "5 Mar 2020", 2020), ("c3", "circular", None, "SEBI/HO/11", None, 2020), ("c4", "circular", None, "SEBI/HO1", None, 2020),
        ("r1", "regulations", "SEBI (Mutual Funds) Regulations, 1996", None, None, 1996), ("r2", "regulations", "Securities and Exchange Board of India (Mutual Fund) Regulations, 1996", None, None, 1996),
        ("r3", "regulations", "SEBI (Mutual Funds) Regulations, 2026", None, None, 2026), ("r4", "regulations", "SEBI (Stock Brokers) Regulations, 1996", None, None, 1996), ("r5", "regulations", "SEBI (Stock Exchanges) Regulations, 1996", None, None, 1996),
        ("n1", "notification", "Notification", None, "March 5, 2020", 2020), ("n2", "notification", "Notification", None, "5 Mar 2020", 2020), ("n3", "notification", "Notification", None, "6 Mar 2020", 2020), ("x1", None, None, None, None, None),
        ("x2", "act", "", None, None, None), ("r1", "regulations", "SEBI (Mutual Funds) Regulations, 1996", None, None, 1996),
    ]
    docs = spark.createDataFrame(rows, "key string, document_type string, title string, identifier string, date string, year int")
    got = {r.key: r.entity for r in G.entities(docs, kept).collect()}
    assert got == {"c1": "c1", "c2": "c1", "c3": "c3", "c4": "c4", "r1": "r1", "r2": "r1", "r3": "r3", "r4": "r4", "r5": "r5", "n1": "n1", "n2": "n1", "n3": "n3", "x1": "x1", "x2": "x2"}
    assert G.entities(docs.filter("false"), kept).collect() == []


def brute_reach(pairs, roots):
    out = defaultdict(set)
    for a, b in pairs:
        if a is not None and b is not None:
            out[a].add(b)
    found = {}
    for root in roots:
        level = {b: (root, b) for b in out[root]}
        depth = 1
        while level:
            ahead = {}
            for node, path in level.items():
                found[root, node] = (depth, list(path))
            for node, path in level.items():
                for b in out[node]:
                    if (root, b) not in found and (b not in ahead or (*path, b) < ahead[b]):
                        ahead[b] = (*path, b)
            level, depth = ahead, depth + 1
    return found


def test_reach_equals_brute_force_with_cycles(spark, kept):
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(100, 100), (101, 102), (102, 103), (103, 101), (None, 5), (5, None), (101, 102)]
    links = spark.createDataFrame(pairs, "source int, target int")
    nodes = sorted({n for p in pairs for n in p if n is not None}) + [777]
    roots = spark.createDataFrame([(n,) for n in nodes] + [(None,), (100,)], "root int")
    want = brute_reach(pairs, nodes)
    got = {(r.root, r.reached): (r.depth, r.path) for r in G.reach(links, roots, kept).collect()}
    assert got == want and got[100, 100] == (1, [100, 100]) and got[101, 101] == (3, [101, 102, 103, 101])
    back = {(r.root, r.reached): r.depth for r in G.impact(links, roots, kept).collect()}
    assert back == {(b, a): d for (a, b), (d, _) in want.items()}
    two = {(r.root, r.reached) for r in G.reach(links, roots, kept, most=2).collect()}
    assert two == {k for k, (d, _) in want.items() if d <= 2}
    assert G.reach(links.filter("false"), roots, kept).collect() == []


def test_reach_doubles_its_depth_in_a_round(spark, kept, monkeypatch):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(20)] + [(20, 4), (2, 30), (30, 5), (3, 31), (31, 5)] + [(rng.randrange(40, 60), rng.randrange(40, 60)) for _ in range(40)]
    links = spark.createDataFrame(pairs, "source int, target int")
    nodes = sorted({n for p in pairs for n in p})
    roots = spark.createDataFrame([(n,) for n in nodes], "root int")
    want, rounds = brute_reach(pairs, nodes), []
    counted = lambda df: rounds.append(1) or kept(df)
    told = lambda found: {(r.root, r.reached): (r.depth, r.path) for r in found.collect()}
    assert max(depth for depth, _ in want.values()) > 16
    found = G.reach(links, roots, counted)
    assert told(found) == want and len(rounds) <= 9 and found.count() == len(want)  # the steps, the first pairs, and depths 2, 4, 8, 16, 32
    assert told(G.reach(links, roots, kept, most=7)) == {k: v for k, v in want.items() if v[0] <= 7}
    rounds.clear()
    some = {k: v for k, v in want.items() if k[0] in (19, 45)}
    assert told(G.reach(links, roots.filter("root IN (19, 45)"), counted)) == some and len(rounds) > 9  # the others' reach is not computed
    monkeypatch.setattr(G, "LEAPS", 0)
    assert told(G.reach(links, roots.filter("root >= 40"), kept, most=3)) == {k: v for k, v in want.items() if k[0] >= 40 and v[0] <= 3}
    assert told(G.reach(links, roots, kept, most=3)) == {k: v for k, v in want.items() if v[0] <= 3}


def test_ranks(spark, kept):
    links = spark.createDataFrame([(1, 2, 3), (1, 3, 1), (2, 3, 1), (3, 1, 1), (4, 3, 2), (4, 4, 1), (None, 1, 1)], "source int, target int, weight bigint")
    rank = {n: G.UNIT for n in (1, 2, 3, 4)}
    weights = {1: {2: 3, 3: 1}, 2: {3: 1}, 3: {1: 1}, 4: {3: 2, 4: 1}}
    for _ in range(4):
        got = {n: G.UNIT // 100 * 15 for n in rank}
        for a, out in weights.items():
            for b, w in out.items():
                got[b] += rank[a] * w * 85 // (100 * sum(out.values()))
        rank = got
    rows = {r.node: r for r in G.ranks(links, kept, rounds=4).collect()}
    assert {n: r["rank"] for n, r in rows.items()} == rank
    assert (rows[3].cites, rows[3].cited, rows[3].weight_in) == (1, 3, 4) and (rows[4].cites, rows[4].cited) == (2, 1)


def test_stable_ids(spark):
    row = spark.range(1).select(G.stable_id(F.lit("abc")).alias("i"), G.identifier_form(F.lit(" sebi/ho-1.x/")).alias("f")).first()
    import hashlib

    assert row.i == int(hashlib.md5(b"abc").hexdigest()[:15], 16) and row.f == "SEBI|HO|1|X"


# --- register ------------------------------------------------------------------------------


def test_register(spark):
    own = spark.createDataFrame([(1, "SEBI/HO/2020/1"), (2, "SEBI/HO/2020/2"), (3, "sebi-ho-2020-5"), (4, "SEBI/HO/2021/9"), (5, "SEBI/HO/2020/9"), (6, "no number"), (7, None), (8, "SEBI/HO/2020/5")], "doc_key int, identifier string")
    assert [tuple(r) for r in N.missing_ranges(own).orderBy("first").collect()] == [("SEBI/HO", 2020, 3, 4, 2), ("SEBI/HO", 2020, 6, 8, 3)]
    cited = spark.createDataFrame([(1, "SEBI/HO/2020/2"), (2, "SEBI/HO/2020/2"), (1, "SEBI/HO/2020/4"), (2, "SEBI-HO-2020-4"), (2, None), (4, "SEBI/HO/2021/9")], "doc_key int, identifier string")
    assert [tuple(r) for r in N.cited_but_missing(cited, own).collect()] == [("SEBI|HO|2020|4", 2)]
    assert {r.doc_key for r in N.orphans(cited, own.filter("identifier IS NOT NULL")).collect()} == {1, 3, 4, 5, 6, 8}
    assert N.missing_ranges(own.filter("false")).collect() == []


# --- provisions ----------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Regulation 13(2)(a)", [("regulation", "13/2/a/")]), ("Regulations 13 and 14(1)", [("regulation", "13/"), ("regulation", "14/1/")]), ("para 15.3", [("para", "15/3/")]),
        ("clause (b) of regulation 11(2)", [("regulation", "11/2/b/")]), ("clause (b) of the regulation 11", [("regulation", "11/b/")]), ("Section 11A, 12 (1) and 15", [("section", "11a/"), ("section", "12/1/"), ("section", "15/")]),
        ("section 5 of the Depositories Act, 1996 read with regulation 7", [("regulation", "7/")]), ("chapter IV and annexure-2", [("chapter", "iv/"), ("annexure", "2/")]), ("section 1, section 1", [("section", "1/")]), ("the rules", []), (None, []), ("", []),
    ],
)
def test_paths(spark, raw, want):
    row = spark.range(1).select(F.transform(V.paths(F.lit(raw).cast("string")), lambda p: F.struct(p["kind"].alias("kind"), V.path_key(p["path"]).alias("key"))).alias("p")).first()
    assert [tuple(p) for p in row.p] == want


def posting(spark, rows):
    made = spark.createDataFrame(rows, "entity string, entity_id bigint, kind string, path array<string>, doc_key int, mention_id string, relation_type string, issued string")
    return made.withColumn("issued", F.to_date("issued")).withColumn("path_key", V.path_key(F.col("path")))


def test_index_finds_by_prefix_and_reads_one_partition(spark, tmp_path, capsys):
    rng = random.Random(3)
    rows = [(f"e{i % 5}", i % 5, rng.choice(["regulation", "section"]), [str(rng.randrange(1, 20)), *rng.choice([[], ["2"], ["2", "a"]])], i, "m", "references", "2020-01-01") for i in range(400)]
    rows += [("e0", 0, "regulation", ["13", "2", "a"], 1000 + i, "m", "references", "2020-01-01") for i in range(900)]
    index = V.ProvisionIndex(spark, f"{tmp_path}/index").write(posting(spark, rows))
    for path in (["1"], ["13"], ["13", "2"], ["13", "2", "A"], ["99"]):
        want = sorted(r[4] for r in rows if r[1] == 0 and r[2] == "regulation" and r[3][: len(path)] == [p.lower() for p in path])
        assert sorted(r.doc_key for r in index.find(0, "Regulation", path).collect()) == want
    index.find(0, "regulation", ["13"]).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(bucket" in plan and "StringStartsWith(path_key,13/)" in plan
    with pytest.raises(ValueError, match="part"):
        index.find(0, "regulation", [])


def test_citations_count_parts_once_a_document(spark):
    rows = [("e", 1, "regulation", p, d, m, "references", None) for p, d, m in ((["13"], 1, "m1"), (["13", "2"], 1, "m1"), (["13", "2"], 2, "m1"), (["1"], 2, "m2"))]
    got = {r.provision: (r.citing_documents, r.mentions) for r in V.citations(posting(spark, rows)).collect()}
    assert got == {"13/": (2, 2), "13/2/": (2, 2), "1/": (1, 1)}


@pytest.mark.parametrize("period", ["month", "year"])
def test_states_equal_brute_force(spark, period):
    rng = random.Random(4)
    paths = [["13"], ["13", "2"], ["13", "2", "a"], ["13", "3"], ["14"], ["1"]]
    day = lambda: f"20{rng.randrange(10, 14)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"
    rows = [("e", 1, "regulation", rng.choice(paths), i, "m", rng.choice(["amends_or_modifies", "references"]), day() if i % 9 else None) for i in range(160)]
    rows += [("e", 1, "regulation", ["13"], 900 + i, "m", "amends_or_modifies", "2012-05-05") for i in range(3)]
    table = posting(spark, rows)
    asked = table.select("entity", "kind", "path", F.col("issued").alias("on"))
    got = {(r.provision, str(r.on)): (r.amended_by, r.since and str(r.since)) for r in V.states(asked, V.changes(table), period).collect()}
    amended = [(r[7], r[4], r[3]) for r in rows if r[6] == "amends_or_modifies" and r[7]]
    want = {}
    for r in rows:
        if r[7]:
            hits = [(d, doc) for d, doc, p in amended if d <= r[7] and (p[: len(r[3])] == r[3] or r[3][: len(p)] == p)]
            want["/".join(r[3]) + "/", r[7]] = max(hits)[::-1] if hits else (None, None)
    assert got == want
    intervals = V.validity(V.changes(table)).filter("provision = '13/'").orderBy("since").collect()
    assert all(a.until == b.since for a, b in zip(intervals, intervals[1:])) and intervals[-1].until is None
    assert next(i for i in intervals if str(i.since) == "2012-05-05").amended_by >= 902
    assert V.states(asked.filter("false"), V.changes(table)).collect() == [] and all(r.amended_by is None for r in V.states(asked, V.changes(table.filter("false"))).collect())


def test_citations_of_circulars_are_not_expanded(spark):
    from citeloom.operators import register as N

    own = spark.createDataFrame([(1, "A/1"), (2, "A/2"), (3, "A/3"), (4, "A/4")], "doc_key int, identifier string")
    cited = spark.createDataFrame([(1, "A/1"), (1, "A/1"), (2, "A-2"), (9, "A/2"), (1, "A/3"), (None, "A/4"), (4, None)], "doc_key int, identifier string")
    got = N.orphans(cited, own)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "A/1"), (4, "A/4")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "min(doc_key" in plan  # one row a code meets the bearers


def test_a_common_key_is_dealt_to_several_parts(spark, monkeypatch):
    monkeypatch.setattr(G, "HOT", 10)
    rows = spark.createDataFrame([(i, "act" if i % 2 else f"k{i}") for i in range(100)] + [(0, None)], "doc_key int, key string")
    hot = G.often(rows)
    assert [tuple(r) for r in hot.collect()] == [("act", 5)]
    table = spark.createDataFrame([("act", 1), ("k2", 2), ("k4", 3), ("unused", 4)], "key string, n int")
    got = G.met(rows, table, hot)
    assert got.columns == ["key", "doc_key", "n"]
    assert sorted(map(tuple, got.collect())) == sorted([("act", i, 1) for i in range(1, 100, 2)] + [("k2", 2, 2), ("k4", 4, 3)])


def test_circulars_are_dealt_out_before_their_texts_are_spelled(spark, tmp_path):
    from citeloom.plans import circulars as C

    spark.sql("SELECT id AS o_orderkey, TIMESTAMP '2020-01-02' AS o_orderdate FROM range(30)").write.parquet(f"{tmp_path}/orders.parquet")
    assert C.parts(spark, str(tmp_path)) == 4
    rows = C.paragraphs(spark, str(tmp_path), 4)
    plan = rows.groupBy("doc_key").agg(F.max("text"))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "(k#" in exchanges[0]
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, C.paragraphs(spark, str(tmp_path)).collect()))
