"""Operator 8, approximate nearest neighbours by shifted Hilbert curves.

1. Each curve projects the unit vectors onto a few random orthogonal directions,
   shifts the grid by a random part of a cell, and gives a Hilbert key. Keys are
   range-partitioned and sorted by Spark; every ``block``-th of a curve's order
   bounds a block, so no key or region can fill one (the key's low bits are a
   hash, which splits equal keys).
2. A vector goes to one block of each curve, as two bytes a component, packed
   with those of its batch that go there too. A query also goes to the blocks on either side that its window reaches. The window is
   SHARE of the counted points on either side, WINDOW at least: the share of a
   table that is searched does not shrink as it grows.
3. Neighbouring blocks' shortlists merge, over all curves, and the best are
   reranked by exact cosine of the original vectors, which only then move, those
   of queries and shortlisted candidates alone.

Vectors of one direction are one point of the curves, whatever their length. The
k + 1 smallest ids of each point are candidates, which loses nothing: among
equal scores the smaller ids win.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows with a null id, nor vectors whose length is
not the most common one (the smaller among equals); a query leaves out all rows
with its own id; an id with several vectors is one query and one candidate, at
its nearest; with fewer than k candidates all are returned; an empty table gives
an empty result. Only id and vector are read.

Measured recall stands in the README; projections and shifts are fixed by SEED.
Centre and scale of the projections come from at most SAMPLE vectors; bounds of
blocks, at most BOUNDS of them, are broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import BROADCAST_IDS, save
from citeloom.llm.hilbert import hilbert_keys

#: Curves, directions of a curve, bits of a direction, bits of the hash below a key.
CURVES, DIRECTIONS, BITS, TAIL = 12, 6, 6, 15
#: Least points on either side of a query, their share of all points, and blocks on either side that hold them.
WINDOW, SHARE, REACH = 1024, 0.03, 3
#: Most points of a block, most bounds of blocks.
LARGEST, BOUNDS = 131_072, 200_000
SEED, SAMPLE = 20, 4096
#: Queries of a block that are compared at once; candidates beyond k of one block's shortlist, and times k + 1 of a query's.
SLICE, SPARE, TIMES = 64, 5, 4


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part: columns id (bigint), v (array)."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").limit(1).collect()
    return rows.filter(F.size("v") == common[0].d) if common else rows


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _scaled(m: np.ndarray) -> np.ndarray:
    """Rows divided by powers of two, which changes no cosine, to components of 1 at most."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None])


def _unit(m: np.ndarray) -> np.ndarray:
    m = _scaled(m)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _curves(dimension: int, curves: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (curves x dimension x d), as long as they last from one random rotation after another, and shifts (curves x d)."""
    rng = np.random.default_rng(SEED)
    d = min(DIRECTIONS, dimension)
    each = dimension // d
    rotations = [np.linalg.qr(rng.standard_normal((dimension, dimension)))[0] for _ in range(-(-curves // each))]
    directions = np.stack([rotations[c // each][:, c % each * d : (c % each + 1) * d] for c in range(curves)])
    return directions, rng.random((curves, d)) - 0.5


def _coded(unit: np.ndarray) -> np.ndarray:
    """Unit vectors in two bytes a component, 32,767 for 1: cosines of these are out by less than 2e-5 times the root of the dimension."""
    return np.rint(unit * 32_767).astype(np.int16)


def _decoded(codes: bytes, dimension: int) -> np.ndarray:
    return np.frombuffer(codes, np.int16).reshape(-1, dimension).astype(np.float32) / np.float32(32_767)


def curve_keys(rows: DataFrame, sample: np.ndarray, curves: int = CURVES) -> DataFrame:
    """(id, asks, v) to (id, asks, h, code, keys): hash of the direction, its bytes, one key for each curve. A narrow map."""
    directions, shifts = _curves(sample.shape[1], curves)
    seen = np.einsum("nd,cdk->cnk", _unit(sample), directions)
    centre, spread = seen.mean(axis=1), seen.std(axis=1) + 1e-12

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column(2)))
            hashes = [xxhash.xxh128_digest(row.tobytes()) for row in np.rint(unit * (1 << 40)).astype(np.int64)]
            tail = np.array([int.from_bytes(h[:2], "big") for h in hashes], np.int64) >> (16 - TAIL)
            keys = np.empty((len(unit), curves), np.int64)
            for c in range(curves):
                cells = np.floor(((unit @ directions[c] - centre[c]) / (4 * spread[c]) + 0.5) * (1 << BITS) + shifts[c])
                keys[:, c] = (hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS).astype(np.int64) << TAIL) | tail
            codes = [row.tobytes() for row in _coded(unit)]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * curves), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.binary()), pa.array(codes, pa.binary()), listed], names=["id", "asks", "h", "code", "keys"])

    return rows.select("id", "asks", "v").mapInArrow(run, "id bigint, asks boolean, h binary, code binary, `keys` array<bigint>")


def block_bounds(keys: DataFrame, block: int) -> list[tuple[int, int]]:
    """Of (curve, key): each curve's every ``block``-th key, in order, from its first."""
    order = save(
        keys.repartitionByRange("curve", "key").sortWithinPartitions("curve", "key").select(
            "curve", "key", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")
        ),
        "ann-order",
    )
    # One row for each partition and curve in it: as many as partitions, and curves.
    runs = order.groupBy("curve", "pid").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("curve", "pid", (before - F.col("first")).alias("offset"))
    ranked = order.join(F.broadcast(runs), ["curve", "pid"]).filter(F.pmod(F.col("pos") + F.col("offset"), F.lit(block)) == 0)
    return sorted((r.curve, r.key) for r in ranked.select("curve", "key").collect())


def window_of(points: int) -> int:
    """Points on either side of a query in a table of so many."""
    return max(WINDOW, math.ceil(SHARE * points))


def _dealt(points: DataFrame, bounds: list[tuple[int, int]], curves: int, reach: int) -> DataFrame:
    """(p, asks, code, keys) to (cell, asks, ps, codes): each point to its block of each curve, queries also to those their window reaches.

    The points of a batch that go to one block travel as one row.
    """
    cuts = [np.array([k for c, k in bounds if c == i], np.int64) for i in range(curves)]
    shared = points.sparkSession.sparkContext.broadcast((cuts, np.cumsum([0, *map(len, cuts)])))

    def run(batches):
        cuts, first = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            p = np.asarray(batch.column(0), np.int64)
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            keys = np.asarray(batch.column(3).flatten(), np.int64).reshape(batch.num_rows, -1)
            asks = np.flatnonzero(np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool))
            for c in range(curves):
                home = np.maximum(np.searchsorted(cuts[c], keys[:, c], "right") - 1, 0)
                near = home[asks][:, None] + np.arange(-reach, reach + 1)[None, :]
                who, which = np.nonzero((near >= 0) & (near < len(cuts[c])))
                for row, cell, asking in ((np.arange(batch.num_rows), home, False), (asks[who], near[who, which], True)):
                    order = np.argsort(cell, kind="stable")
                    if not len(order):
                        continue
                    cells, starts = np.unique(cell[order], return_index=True)
                    parts = np.split(row[order], starts[1:])
                    columns = [pa.array(cells + first[c], pa.int64()), pa.array([asking] * len(cells)), pa.array([p[x].tobytes() for x in parts], pa.binary()), pa.array([code[x].tobytes() for x in parts], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["cell", "asks", "ps", "codes"])

    return points.select("p", "asks", "code", "keys").mapInArrow(run, "cell bigint, asks boolean, ps binary, codes binary")


def _search(most: int, dimension: int):
    """Within one block: a shortlist of its points for each query that comes to it, by cosine of the coded vectors."""

    def run(cell: pa.Table) -> pa.Table:
        asking = cell["asks"].to_pylist()
        ps, codes = cell["ps"].to_pylist(), cell["codes"].to_pylist()
        side = {}
        for flag in (False, True):
            mine = [i for i, x in enumerate(asking) if x == flag]
            side[flag] = np.frombuffer(b"".join(ps[i] for i in mine), np.int64), _decoded(b"".join(codes[i] for i in mine), dimension)
        (here, unit), (asker, wanted) = side[False], side[True]
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
        for at in range(0, len(asker) if len(here) else 0, SLICE):
            near = wanted[at : at + SLICE] @ unit.T
            best = np.argpartition(-near, most - 1, axis=1)[:, :most] if most < len(here) else np.broadcast_to(np.arange(len(here)), near.shape)
            out.append((np.repeat(asker[at : at + SLICE], best.shape[1]), here[best.ravel()], np.take_along_axis(near, best, axis=1).ravel()))
        who, found, score = (np.concatenate(x) for x in zip(*out))
        return pa.table({"asker": pa.array(who, pa.int64()), "near": pa.array(found, pa.int64()), "rough": pa.array(score, pa.float32())})

    return run


def _exact(pairs: DataFrame) -> DataFrame:
    """(query_id, vec_id, a, b) to (query_id, vec_id, score): the cosine in double precision."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = _scaled(_matrix(batch.column(2))), _scaled(_matrix(batch.column(3)))
                score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["query_id", "vec_id", "score"])

    return pairs.select("query_id", "vec_id", "a", "b").mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def nearest(
    vectors: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, window: int | None = None, block: int | None = None
) -> DataFrame:
    """Per query and rank from 1: query_id, rank, vec_id, score. ``queries`` is a Column over ``id``; ``window`` and ``block`` follow from the counted points if not given."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    if not some:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    keyed = save(curve_keys(rows.select("id", F.coalesce(queries, F.lit(False)).alias("asks"), "v"), np.array([r.v for r in some], np.float64), curves), "ann-keys")
    # One point for all vectors of a direction; sums are pre-aggregated, so a very common one moves as one row a task.
    points = keyed.groupBy("h").agg(F.max("asks").alias("asks"), F.min("code").alias("code"), F.min("keys").alias("keys"))
    points = save(points.withColumn("p", F.monotonically_increasing_id()), "ann-points")
    place = F.dense_rank().over(Window.partitionBy("h").orderBy("id"))
    # Spark limits each direction's ids before it shuffles them.
    members = keyed.select("h", "id").withColumn("place", place).filter(F.col("place") <= k + 1).select("h", "id").distinct().join(points.select("h", "p"), "h").select("p", "id")
    members = save(members, "ann-members")
    askers = save(keyed.filter("asks").select("h", F.col("id").alias("query_id")).distinct().join(points.select("h", "p"), "h").select("query_id", "p"), "ann-askers")

    count = points.count()
    window = window_of(count) if window is None else window
    block = min(max(1, math.ceil(window / REACH)), LARGEST) if block is None else block
    block = max(block, math.ceil(curves * count / BOUNDS))
    bounds = block_bounds(points.select(F.posexplode("keys").alias("curve", "key")), block)
    cells = _dealt(points, bounds, curves, math.ceil(window / block))
    found = cells.groupBy("cell").applyInArrow(_search(k + SPARE, len(some[0].v)), "asker bigint, near bigint, rough float")
    short = found.groupBy("asker", "near").agg(F.max("rough").alias("rough"))
    short = short.withColumn("n", F.row_number().over(Window.partitionBy("asker").orderBy(F.col("rough").desc(), "near"))).filter(F.col("n") <= TIMES * (k + 1)).select("asker", "near")
    named = short.join(members.select(F.col("p").alias("near"), F.col("id").alias("vec_id")), "near").join(askers.select(F.col("p").alias("asker"), "query_id"), "asker")
    pairs = save(named.filter("query_id <> vec_id").select("query_id", "vec_id").distinct(), "ann-pairs")

    wanted = pairs.select(F.col("query_id").alias("id")).unionByName(pairs.select(F.col("vec_id").alias("id"))).distinct()
    few = wanted.count() <= BROADCAST_IDS
    originals = save(rows.join(F.broadcast(wanted) if few else wanted, "id", "left_semi"), "ann-vectors")
    both = pairs.join(originals.select(F.col("id").alias("query_id"), F.col("v").alias("a")), "query_id").join(originals.select(F.col("id").alias("vec_id"), F.col("v").alias("b")), "vec_id")
    scored = _exact(both).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    final = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return final.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
