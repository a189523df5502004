"""Operator 4, quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled texts.
A text is cut into blocks of BLOCK bytes, a rest under a quarter of that joined to
the block before it, so every byte is read; each is compressed with either
dictionary, and the difference of the sizes over the block's length says which
dictionary knows it better. A text's two figures, the mean of these differences
and their minimum (the worst block), become a score by a logistic calibration.

Training is bounded by parameters: ``dictionary_rows`` labelled rows of each class
and ``calibration_rows`` others, chosen by hash of the id. Each class's dictionary
is built from about ``pieces`` pieces of PIECE characters, chosen by hash from all
pieces of the whole texts of its rows; the driver holds these and no more. The
calibration is fitted on the figures of whole texts, which executors compute, as
they do in scoring, which reads every whole text in one narrow map.

Defined results: null text counts as empty; an empty text has no blocks and
both figures 0; without labelled rows of both classes every score is 0.5.
Rows with a null label, or whose id is null, are never learned from; a null id
is not held out. Repeated rows are scored alike; an empty table gives an empty
result. Only id and text are read; labels, ids and other columns never enter a
score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import idle, save

#: Bytes of a block; characters of the pieces that dictionaries are trained on; bytes of a dictionary; compression level.
BLOCK, PIECE, DICTIONARY, LEVEL = 1000, 400, 112_640, 3
#: Bounds of training: labelled rows of each class for its dictionary, other labelled rows for calibration, pieces that a dictionary's whole texts hold together.
DICTIONARY_ROWS, CALIBRATION_ROWS, PIECES = 3000, 6000, 20_000
#: Score from which a text is predicted good.
GOOD_FROM = 0.7


def held_out(id_col: str) -> Column:
    """Rows whose crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the calibration; a few hundred kilobytes, sent to every task."""

    good: bytes
    bad: bytes
    trained: tuple[bool, bool]
    weights: tuple[float, float, float]

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return tuple(_compressor(data, full) for data, full in zip((self.good, self.bad), self.trained))

    def score(self, mean: float, least: float) -> float:
        a, b, c = self.weights
        z = max(-700.0, min(700.0, a + b * mean + c * least))
        return 1.0 / (1.0 + math.exp(-z))


def _compressor(data: bytes, full: bool) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT
    dictionary = zstandard.ZstdCompressionDict(data, dict_type=kind)
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)


def _dictionary(pieces: list[bytes]) -> tuple[bytes, bool]:
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes(), True
    except zstandard.ZstdError:  # too few pieces to train on: the texts themselves are the dictionary
        return b"".join(pieces)[-DICTIONARY:] or b"\n" * 8, False


def figures(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Mean and minimum over a text's blocks of (size with the bad - size with the good dictionary) / length."""
    found = []
    # A short rest says little by itself: it belongs to the block before it.
    starts = [i for i in range(0, len(text), BLOCK) if not i or len(text) - i >= BLOCK // 4]
    for i, end in zip(starts, [*starts[1:], len(text)]):
        block = text[i:end]
        found.append((len(bad.compress(block)) - len(good.compress(block))) / len(block))
    return (sum(found) / len(found), min(found)) if found else (0.0, 0.0)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Intercept and two weights by Newton's method with a small ridge, on standardised figures."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    design = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        gradient = design.T @ (y - p) - 1e-2 * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(3), gradient)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    b, c = w[1:] / scale
    return float(w[0] - b * mean[0] - c * mean[1]), float(b), float(c)


def _dictionary_pieces(rows: DataFrame, pieces: int) -> dict[str, list[bytes]]:
    """Of (role, __id, text) all pieces of whole texts: rows in order of a hash of their ids, as many as hold ``pieces`` pieces together.

    A text that alone holds more than a quarter of these is not chosen, so that it does not stand for its class.
    """
    sized = rows.select("role", "__id", F.xxhash64("text").alias("tx"), F.ceil(F.length("text") / PIECE).alias("n")).filter(F.col("n").between(1, max(1, pieces // 4)))
    order = Window.partitionBy("role").orderBy(F.xxhash64("__id", F.lit(9)), "__id", "tx")
    chosen = sized.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("upto") <= pieces).select("role", "__id", "tx")
    whole = rows.withColumn("tx", F.xxhash64("text")).join(F.broadcast(chosen.distinct()), ["role", "__id", "tx"]).dropDuplicates(["role", "__id", "tx"])
    cut = whole.select("role", "__id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("at", "piece"))
    found = sorted(cut.collect(), key=lambda r: (r["__id"], r["at"], r.piece))
    return {role: [r.piece.encode() for r in found if r.role == role] for role in ("good", "bad")}


def _figures_of(rows: DataFrame, model: Model) -> np.ndarray:
    """(label, mean, least) of each row's whole text; rows are (y, text) and bounded by the caller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors()
        for batch in batches:
            column = batch.column(1).cast(pa.string())
            found = [figures((column[i].as_py() or "").encode(), *pair) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.float64()), *(pa.array([f[k] for f in found], pa.float64()) for k in (0, 1))], names=["y", "mean", "least"])

    found = rows.select(F.col("y").cast("double").alias("y"), "text").mapInArrow(run, "y double, mean double, least double").collect()
    return np.array(sorted(tuple(r) for r in found)).reshape(-1, 3)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    dictionary_rows: int = DICTIONARY_ROWS, calibration_rows: int = CALIBRATION_ROWS, pieces: int = PIECES,
) -> Model | None:
    """Learn from labelled rows that are not held out; None without both classes.

    The ids are bounded by 2 * dictionary_rows + calibration_rows, so they are
    broadcast to find the texts. To the driver come the whole texts of as many
    rows as hold ``pieces`` pieces for each dictionary, and three numbers for each
    calibration row.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg((F.min(label_col) > 0).alias("y"))
    order = F.xxhash64("__id", F.lit(4))
    part = F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(2))
    good = known.filter((part == 0) & F.col("y")).orderBy(order, "__id").limit(dictionary_rows).withColumn("role", F.lit("good"))
    bad = known.filter((part == 0) & ~F.col("y")).orderBy(order, "__id").limit(dictionary_rows).withColumn("role", F.lit("bad"))
    rest = known.filter(part == 1).orderBy(order, "__id").limit(calibration_rows).withColumn("role", F.lit("rest"))
    chosen = save(good.unionByName(bad).unionByName(rest), "labels")
    texts = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("role", "__id", "y", "text")
    learned = _dictionary_pieces(rows.filter("role <> 'rest'"), pieces)
    if not learned["good"] or not learned["bad"]:
        return None
    (good_data, good_full), (bad_data, bad_full) = _dictionary(learned["good"]), _dictionary(learned["bad"])
    model = Model(good_data, bad_data, (good_full, bad_full), (0.0, 0.0, 0.0))
    seen = _figures_of(rows.filter("role = 'rest'"), model)
    if len(set(seen[:, 0])) < 2:  # too few labelled rows to set some apart
        seen = _figures_of(rows, model)
    return Model(good_data, bad_data, (good_full, bad_full), _logistic(seen[:, 1:], seen[:, 0]))


def quality_scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted (1 from GOOD_FROM), __tx. Without a model nothing speaks against a text: every score is GOOD_FROM."""
    kept = docs.select(F.col(id_col).alias("__id"), held_out(id_col).alias("held_out"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__tx"), F.col(text_col).alias("__text"))
    schema = f"__id {kept.schema['__id'].dataType.simpleString()}, held_out boolean, __tx bigint, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors() if model else None
        for batch in batches:
            scores = [GOOD_FROM] * batch.num_rows
            if pair:
                column = batch.column(3).cast(pa.string())
                scores = [model.score(*figures((column[i].as_py() or "").encode(), *pair)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.float64())], names=["__id", "held_out", "__tx", "score"])
        idle()

    scored = kept.mapInArrow(run, schema)
    return scored.select(F.col("__id").alias(id_col), "held_out", "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"), "__tx")


def quality_filter(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``quality_scores`` predicts good (all of them without a model), columns as they were; scored in place, so nothing is shuffled."""
    from pyspark.sql.types import StructType

    if model is None:
        return docs
    at = docs.columns.index(text_col)
    schema = StructType(docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors()
        for batch in batches:
            column = batch.column(at).cast(pa.string())
            stays = [model.score(*figures((column[i].as_py() or "").encode(), *pair)) >= GOOD_FROM for i in range(batch.num_rows)]
            yield batch.filter(pa.array(stays, pa.bool_()))
        idle()

    return docs.mapInArrow(run, schema)
