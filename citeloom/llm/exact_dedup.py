"""Operator 2, exact dedup by content-defined chunk recipes. DataFrame functions only.

1. Every normalised text is cut into chunks where its own characters say so.
2. Chunks get 64-bit identifiers, which are verified: the chunks themselves are
   grouped, so each distinct chunk moves once whatever the number of documents
   that hold it, and identifiers of two different chunks are found.
3. Documents are compared by their ordered identifier lists. A list entry whose
   identifier is not unique carries its chunk as well, so equal lists mean
   equal texts. Texts move no further than step 2.

Defined results: null text counts as empty; all empty texts form one group;
texts equal after each run of blanks becomes one space are one group (leading
and trailing blanks count as one space, not as none). The smallest id is kept,
in every row that has it; a null id is kept only in a group that has no other
ids (keep_id is null there). ``exact_dedup`` leaves one row of each group, of
rows with the same id the first by text hash and columns. An empty table gives an empty result. Only id and
text are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import BLANKS, join_groups, keep_rows, save, text_of

#: Characters of a chunk: fewer than SHORTEST only at a text's end, never more than LONGEST.
SHORTEST, LONGEST = 1024, 4096
#: Identifiers with several chunks that are listed in the plan; beyond it, lists carry all chunks.
MOST_CLASHES = 10_000


#: A chunk ends at the first sentence mark after SHORTEST characters, so where it ends is its content's choice,
#: and texts that differ at one place cut alike again after the next common mark; without marks it ends at LONGEST.
CHUNK = f"(?s).{{{SHORTEST}}}[^.!?;:。！？]{{0,{LONGEST - SHORTEST - 1}}}+.?|.{{1,{SHORTEST}}}"


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_of(text_col), BLANKS, " ")


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def clashing(docs: DataFrame, text_col: str, bits: int = 64) -> list[int] | None:
    """Identifiers that stand for several distinct chunks; None if there are more than MOST_CLASHES.

    At 64 bits a clash is expected once in some billion chunks, so what comes to
    the driver is bounded by MOST_CLASHES and in practice empty.
    """
    chunk = docs.select(F.explode(chunks_of(normalised(text_col))).alias("chunk"))
    distinct = chunk.groupBy(_hash(F.col("chunk"), bits).alias("h"), "chunk").agg(F.count(F.lit(1)).alias("n"))
    found = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("h").limit(MOST_CLASHES + 1).collect()
    return None if len(found) > MOST_CLASHES else sorted(r.h for r in found)


def _hash(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else h.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256 (and __tx, the raw text's hash, for filters)."""
    clashes = clashing(docs, text_col, bits)
    chunks = chunks_of(normalised(text_col))
    if clashes is None:
        recipe = chunks
    elif clashes:
        listed = F.array(*[F.lit(h).cast("bigint") for h in clashes])
        recipe = F.transform(chunks, lambda c: F.struct(_hash(c, bits).alias("h"), F.when(F.array_contains(listed, _hash(c, bits)), c).otherwise("").alias("c")))
    else:
        recipe = F.transform(chunks, lambda c: _hash(c, bits))
    listed_docs = docs.select(
        F.col(id_col).alias("__id"),
        F.xxhash64(text_of(text_col)).alias("__tx"),
        F.sha2(normalised(text_col).cast("binary"), 256).alias("text_sha256"),
        recipe.alias("__recipe"),
    )
    # Texts are read once for the lists, which are short; a hot group's rows fill no task of the join.
    listed_docs = save(listed_docs, "recipes")
    groups = listed_docs.groupBy("__recipe").agg(F.min("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return join_groups(listed_docs, groups, ["__recipe"], "group_size", ["__id", "__tx"]).select(
        F.col("__id").alias(id_col), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "__tx"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one of each group, all columns as they were."""
    kept = exact_groups(docs, id_col, text_col).filter("kept").groupBy(F.col(id_col).alias("__id"), "__tx").agg(F.count(F.lit(1)).alias("n"))
    kept = save(kept, "exact-kept")
    repeated = kept.groupBy(F.col("__id").alias("r_id")).agg(F.sum("n").alias("m")).filter("m > 1")
    if repeated.isEmpty():
        return keep_rows(docs, kept, id_col, text_col)
    same = F.col("__id").eqNullSafe(F.col("r_id"))
    rows = keep_rows(docs, kept.join(repeated, same, "left_anti"), id_col, text_col)
    # Kept ids with several rows: Spark limits each text to its first row before it shuffles.
    sortable = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    place = F.row_number().over(Window.partitionBy(id_col, F.sha2(normalised(text_col).cast("binary"), 256)).orderBy(F.xxhash64(text_of(text_col)), *[F.col(f"`{c}`") for c in sortable]))
    again = keep_rows(docs, kept.join(repeated, same, "left_semi"), id_col, text_col).withColumn("__place", place).filter("__place = 1").drop("__place")
    return rows.unionByName(again)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM t
"""
