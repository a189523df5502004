"""Operator 3, MinHash near-dedup.

1. One pass over the texts: distinct word shingles, BANDS * ROWS universal hash
   minima, a key for each band, one byte of each minimum as a signature.
2. Texts with equal shingle sets become one node (their smallest id).
3. Nodes that share a band key are candidates. In each bucket one hub, the node
   whose buckets are fullest, is compared with the others: signatures first,
   then the full sets. Verified links and their components need no all-pairs.
4. What a hub cannot decide: bucket members of different components. Shingles
   that no other of these has cannot be shared, so a node whose other shingles
   are too few for the threshold drops out; the rest meet in a prefix join with
   position bounds, and are compared in full.
5. Components by alternating large-star and small-star.

Links are decided on full sets; candidates are missed only where all bands
differ, at the threshold (1 - 0.8**6)**40, about 5e-6 of pairs.

Defined results: null text counts as empty; a text without words has no
shingles, is linked with nothing and kept; with fewer words than a shingle has,
the whole sequence is its one shingle; rows that repeat share a component and
are all kept if one is; a null id is linked with nothing (component null, kept).
An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import BROADCAST_IDS, idle, join_groups, keep_rows, save, text_of
from citeloom.llm.components import components

#: Bands, minima in each, seed of the hash functions.
BANDS, ROWS, SEED = 40, 6, 3
#: Agreement of signatures below which a pair is not looked at: six standard deviations under 0.8.
AGREE = 0.64
#: Elements that one numpy step handles, and words that a worker's cache holds.
STEP, CACHE = 1 << 15, 1 << 17

#: Entries of one shingle that a task of the prefix join takes from one side.
SPLIT = 512

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``size`` words, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    width = min(size, len(h))
    out = np.full(n, np.uint64(width), np.uint64)
    for i in range(width):
        out = _mix(out * _MIX[0] + h[i : i + n])
    return np.unique(out)


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """Minimum of each universal hash a*x + b over each (non-empty) set: len(sets) x count."""
    a, b = _functions(count)
    out = np.empty((len(sets), count), np.uint64)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= STEP):
            total += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        for i in range(count):
            out[at:end, i] = np.minimum.reduceat(x * a[i] + b[i], starts)
        at = end
    return out


def _band_keys(m: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = m.reshape(len(m), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(m), bands)).copy()
    for r in range(rows):
        key = _mix(key * _MIX[0] + parts[:, :, r])
    return key.view(np.int64)


def _texts(column) -> list[str]:
    return [t or "" for t in column.cast(pa.string()).to_pylist()]


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: id, tx, n (shingles), digest (of the set), keys (one per band), sig. A narrow map."""
    kept = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("tx"), F.col(text_col).alias("text"))
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = [shingle_set(t, words) for t in _texts(batch.column(2))]
                full = [i for i, s in enumerate(sets) if len(s)]
                m = minima([sets[i] for i in full], bands * rows) if full else np.empty((0, bands * rows), np.uint64)
                keys, sig = _band_keys(m, bands, rows), (_mix(m) >> np.uint64(56)).astype(np.uint8)
                digest: list = [None] * len(sets)
                key_list: list = [None] * len(sets)
                sig_list: list = [None] * len(sets)
                for j, i in enumerate(full):
                    digest[i], key_list[i], sig_list[i] = xxhash.xxh128_digest(sets[i].tobytes()), keys[j], sig[j].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(key_list, pa.list_(pa.int64())), pa.array(sig_list, pa.binary())],
                    names=["id", "tx", "n", "digest", "keys", "sig"],
                )
        _words.clear()
        idle()

    return kept.mapInArrow(run, f"id {kind}, tx bigint, n bigint, digest binary, keys array<bigint>, sig binary")


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Full shingle sets (id, set) of the documents in ``ids``, which are broadcast only if they are few."""
    few = ids.count() <= BROADCAST_IDS
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids) if few else ids, "id", "left_semi")
    kind = wanted.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, words).view(np.int64) for t in _texts(batch.column(1))]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], names=["id", "set"])
        _words.clear()
        idle()

    return wanted.mapInArrow(run, f"id {kind}, `set` array<bigint>")


def _agreeing(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in a share of at least ``least``."""
    sig = nodes.select("id", "sig")
    both = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("s")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("t")), "b").select("a", "b", "s", "t")
    kind = both.schema["a"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s, t = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                batch = batch.filter(pa.array((s == t).mean(axis=1) >= least))
            yield batch.select(["a", "b"])

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _needed(n: Column, m: Column, percent: int) -> Column:
    """Shared shingles that sets of sizes n and m need: the least i with 100 i >= percent (n + m - i)."""
    return F.ceil((n + m) * percent / (100 + percent))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("s")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("t")), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("s", "t")).alias("i"), (F.size("s") + F.size("t")).alias("sum"))
    return shared.filter(F.col("i") * 100 >= (F.col("sum") - F.col("i")) * percent).select("a", "b").distinct()


def _prefix_pairs(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, from (id, comp, n): a prefix join with position bounds.

    Shingles of a set are ordered from the rarest among these documents. Two
    linked sets share a shingle among the first n - ceil(n * percent / 100) + 1
    of each, and the first that they share stands early enough in both for what
    follows to hold the overlap they need. Entries that cannot meet any partner
    that way leave before the join, as do shingles of one component, so a group
    of near copies meets in its few uncommon shingles only. What comes out is
    bounded by the pairs of different components that share so rare a shingle
    so early and are of like size; a shingle with many entries is dealt to a
    task for each SPLIT of them, each of which meets all of the other side.
    """
    tokens = docs.join(sets, "id").select("id", "comp", "n", F.explode("set").alias("t"))
    # A shingle that no other has needs no row here; a common one fills no task.
    counts = save(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shingles")
    place = F.row_number().over(Window.partitionBy("id", "n").orderBy("df", "t")) - 1
    entry = join_groups(tokens, counts, ["t"], "df", ["id"], "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("after", F.col("n") - place)
    entry = entry.filter((F.col("after") >= F.ceil(F.col("n") * percent / 100)) & (F.col("df") > 1)).select("t", "id", "comp", "n", "after")
    for last in (False, True):
        group = entry.groupBy("t").agg(F.min("n").alias("smallest"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).filter("lo < hi").select("t", "smallest", "c")
        group = save(group, "shingle-groups")
        enough = F.col("after") >= _needed(F.col("n"), F.greatest(F.col("smallest"), F.ceil(F.col("n") * percent / 100)), percent)
        met = join_groups(entry, group, ["t"], "c", ["id"])
        entry = save(met.filter(enough).select("t", "id", "comp", "n", "after", *["c"] * last), "prefix", instead_of=entry if last else counts)
    parts = F.ceil(F.col("c") / SPLIT)
    dealt = entry.withColumn("part", F.pmod(F.xxhash64("id"), parts))
    other = entry.select(F.col("t").alias("t2"), F.col("id").alias("b"), F.col("comp").alias("comp2"), F.col("n").alias("n2"), F.col("after").alias("after2"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part2"))
    meets = (F.col("t") == F.col("t2")) & (F.col("part") == F.col("part2")) & (F.col("id") < F.col("b")) & (F.col("comp") != F.col("comp2")) & (F.least("after", "after2") >= _needed(F.col("n"), F.col("n2"), percent))
    return dealt.join(other, meets).select(F.col("id").alias("a"), "b").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept, __tx."""
    signed = save(signatures(docs, id_col, text_col, words, bands, rows), "sign")
    least = min(AGREE, percent / 100 - 0.16)

    # Equal sets are one node.
    slim = signed.filter("id IS NOT NULL AND digest IS NOT NULL").select("id", "digest")
    same = slim.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("digest").alias("d"), "rep")
    known = signed.filter("id IS NOT NULL AND digest IS NOT NULL").join(same, F.col("digest") == F.col("d"), "left").select("id", "n", "keys", "sig", F.coalesce("rep", "id").alias("rep"))
    every = save(signed.select("id", "tx", "n"), "rows")
    known = save(known, "node", instead_of=signed)
    members = known.filter("id <> rep").select("id", "rep").distinct()
    nodes = known.filter("id = rep").select("id", "n", "keys", "sig")

    # Buckets of two nodes or more.
    keyed = nodes.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("key").alias("k"), "c")
    bucket = save(keyed.join(shared, F.col("key") == F.col("k")).select("key", "id", "c").distinct(), "bucket")

    # The hub of a bucket: the node that meets most others in all its buckets.
    crowd = bucket.groupBy("id").agg(F.sum("c").alias("crowd"))
    weighed = bucket.join(crowd, "id").select("key", "id", "c", (F.least(F.col("crowd"), F.lit(1 << 42)) * (1 << 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))).alias("w"))
    hub = weighed.groupBy("key").agg(F.max_by("id", "w").alias("hub"), F.max("c").alias("size"))
    pairs = join_groups(bucket.select("key", "id"), hub, ["key"], "size", ["id"]).filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    near = save(_agreeing(pairs, nodes, least), "near")
    sets = save(_sets(docs, bucket.select("id").distinct(), id_col, text_col, words), "sets")
    first = components(_linked(near, sets, percent))
    first = first.select(F.col("id").alias("f_id"), F.col("component").alias("f"))

    # Buckets that still hold several components.
    placed = bucket.join(first, F.col("id") == F.col("f_id"), "left").select("key", "id", F.coalesce("f", "id").alias("comp"))
    mixed = placed.groupBy("key").agg((F.min("comp") < F.max("comp")).alias("mixed"), F.count(F.lit(1)).alias("size"))
    open_ = save(join_groups(placed, mixed, ["key"], "size", ["id"]).filter("mixed").select("key", "id", "comp"), "open")
    sized = sets.join(open_.select("id").distinct(), "id", "left_semi").select("id", F.size("set").cast("bigint").alias("n"), "set")
    once = sized.select("id", F.explode("set").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).filter("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("u"))
    reach = sized.select("id", "n").join(once, "id", "left").select("id", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("can")).groupBy("id").agg(F.max("n").alias("n"), F.max("can").alias("can"))
    full = open_.join(reach, "id")
    smallest = full.groupBy(F.col("key").alias("k")).agg(F.min("n").alias("smallest"))
    alive = full.join(smallest, F.col("key") == F.col("k")).filter(F.col("can") >= _needed(F.col("n"), F.greatest(F.col("smallest"), F.ceil(F.col("n") * percent / 100)), percent)).select("key", "id", "comp", "n", "can")
    still = alive.groupBy(F.col("key").alias("k")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("k")
    alive = save(alive.join(still, F.col("key") == F.col("k"), "left_semi"), "alive")
    rest = save(_prefix_pairs(alive.select("id", "comp", "n").distinct(), sets, percent), "pairs")
    late = _linked(save(_agreeing(rest, nodes, least), "rest"), sets, percent)
    comps = alive.select("id", "comp").distinct()
    joined = late.join(comps.select(F.col("id").alias("a"), F.col("comp").alias("x")), "a").join(comps.select(F.col("id").alias("b"), F.col("comp").alias("y")), "b").select("x", "y")
    second = components(joined, "x", "y").select(F.col("id").alias("s_id"), F.col("component").alias("s"))

    # id -> node -> first component -> second component, for the ids that are not their own.
    moved = members.join(first, F.col("rep") == F.col("f_id"), "left").select("id", F.coalesce("f", "rep").alias("c"))
    moved = moved.unionByName(first.select(F.col("f_id").alias("id"), F.col("f").alias("c"))).unionByName(second.select(F.col("s_id").alias("id"), F.col("s").alias("c")))
    moved = moved.join(second, F.col("c") == F.col("s_id"), "left").select(F.col("id").alias("m_id"), F.coalesce("s", "c").alias("m")).groupBy("m_id").agg(F.min("m").alias("m"))
    out = every.join(moved, F.col("id") == F.col("m_id"), "left")
    component = F.coalesce(F.when(F.col("n") > 0, F.col("m")), F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"), F.col("tx").alias("__tx"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows that stay, one document of each group, columns as they were."""
    kept = near_groups(docs, id_col, text_col, words, percent).filter("kept").select(F.col(id_col).alias("__id"), "__tx")
    return keep_rows(docs, kept, id_col, text_col)


#: What op3 returns, by all pairs that share a shingle: for small tables.
ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g FROM t
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT a AS doc_id, b AS other FROM ways UNION SELECT r.doc_id, b FROM reach r JOIN ways ON a = other)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce(c, t.doc_id)) AS component_id, t.doc_id <= coalesce(c, t.doc_id) AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) USING (doc_id)
"""
