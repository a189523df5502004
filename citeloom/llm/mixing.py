"""Operator 9, mixing sources to target weights by entropy balancing.

Each document gets the rate w that is closest in relative entropy to one copy
each, under one constraint per source, sum(w * size) = target, and the cap
w <= 3. The solution is w = min(3, exp(lambda * size / mean size of the source));
the lambdas solve the convex dual, whose Newton steps are computed over the
whole table as sums by source. Rates are then rounded into whole copies,
systematically along (size, hash), so that copies follow the rates at every
size; then a few copies of each source move by one, so that its words meet the
target as nearly as the sizes allow. No randomness: reruns agree.

A rate depends on source and size only, so sums and rounding work on the table
of distinct (source, size), which is smaller than the documents.

Defined results: null text has size 0 (rate 1, no words); a null source is a
source of its own, ordered last; documents that repeat are rounded each by
itself; null ids are allowed; an empty table gives an empty result. Only id,
source and text are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import WORDS, running, save, text_of

CAP = 3.0
#: Newton steps after which an unsettled source is an error, and the relative distance from the target at which they end.
STEPS, NEAR = 60, 1e-9
#: Rounds in which a source's words are brought nearer to its target, by one copy each.
MENDS = 4
#: Parts into which the documents of one (source, size) are dealt by hash for rounding.
PARTS = 4096


def sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__tx"), F.col(source_col).cast("string").alias("__source"), F.regexp_count(text, F.lit(WORDS)).cast("bigint").alias("__size"))


def source_targets(totals: DataFrame, weights: Sequence[int], cap: float = CAP) -> DataFrame:
    """Adds target to (source, total): shares of all words by weight, stopped at cap * total, the excess shared again.

    Filling in order of cap * total / weight, a source is stopped if what is left
    for it and all after it, by weight, would exceed its cap. However many
    sources there are, none of this takes place in one task.
    """
    named = running(totals.select("source", "total"), [F.col("source").asc_nulls_last()], [])
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("__place", F.lit(len(weights))) + 1).cast("int"))
    rows = named.select("source", "total", cycle.alias("w"), (F.col("total") * cap).alias("most"))
    rows = running(rows, [F.col("most") / F.col("w"), F.col("source").asc_nulls_last()], ["most", "w"])
    every = rows.agg(F.sum("total").alias("words"), F.sum("w").alias("w")).first()
    left = F.lit(every.words) - F.col("__before_most")
    share = left / (F.lit(every.w) - F.col("__before_w"))
    rows = rows.select("source", "total", "w", "most", (F.col("most") <= F.col("w") * share).alias("stopped"))
    free = rows.agg(F.sum(F.when(F.col("stopped"), F.col("most")).otherwise(0.0)).alias("most"), F.sum(F.when(~F.col("stopped"), F.col("w")).otherwise(0.0)).alias("w")).first()
    rest = (every.words - free.most) / free.w if free.w else 0.0
    return rows.select("source", "total", "most", F.when(F.col("stopped"), F.col("most")).otherwise(F.col("w") * rest).alias("target"))


def _rate(size: Column, mean: Column, lam: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(lam * size / mean, F.lit(700.0))))


def balance(hist: DataFrame, weights: Sequence[int], cap: float = CAP) -> DataFrame:
    """Lambda of each source from (source, size, n): columns source, total, target, mean, lam, full.

    ``full`` marks sources whose target is all that the cap allows. Newton steps
    that leave the bracket known so far are replaced by halving it. State is one
    row per source, written to shared storage between steps.
    """
    totals = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("total"), F.sum("n").cast("double").alias("docs"), F.max("size").cast("double").alias("longest"))
    aims = source_targets(totals, weights, cap)
    state = totals.join(aims.select(F.col("source").alias("s"), "target", "most"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    state = state.select(
        "source", "total", "target", F.greatest(F.col("total") / F.col("docs"), F.lit(1e-12)).alias("mean"), (F.col("target") >= F.col("most") * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("done"),
    )
    state = save(state, "mix-state")
    for _ in range(STEPS):
        now = hist.join(state.filter(~F.col("done")), hist["source"].eqNullSafe(state["source"])).select(state["source"], "size", "n", "total", "target", "mean", "full", "lam", "low", "high")
        rate = _rate(F.col("size"), F.col("mean"), F.col("lam"), cap)
        words = F.col("size") * F.col("n")
        sums = now.groupBy("source").agg(
            *[F.first(c).alias(c) for c in ("total", "target", "mean", "full", "lam", "low", "high")],
            F.sum(words * rate).alias("g"), F.sum(F.when(rate < cap, words * rate * F.col("size") / F.col("mean")).otherwise(0.0)).alias("h"),
        )
        off = F.col("g") - F.col("target")
        low, high = F.when(off < 0, F.col("lam")).otherwise(F.col("low")), F.when(off >= 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - F.try_divide(off, F.col("h"))
        newton = F.greatest(F.col("lam") - 50, F.least(F.col("lam") + 50, newton))
        middle = F.when(F.col("_low").isNotNull() & F.col("_high").isNotNull(), (F.col("_low") + F.col("_high")) / 2).when(F.col("_low").isNull(), 2 * F.col("_high") - 1).otherwise(2 * F.col("_low") + 1)
        inside = newton.isNotNull() & (F.col("_low").isNull() | (newton > F.col("_low"))) & (F.col("_high").isNull() | (newton < F.col("_high")))
        # Settled as well: no number is left between the bracket's ends.
        shut = F.coalesce((F.col("_low") + F.col("_high")) / 2 <= F.col("_low"), F.lit(False)) | F.coalesce((F.col("_low") + F.col("_high")) / 2 >= F.col("_high"), F.lit(False))
        done = F.col("full") | shut | (F.abs(off) <= NEAR * F.greatest(F.col("target"), F.lit(1.0)))
        step = sums.withColumns({"_low": low, "_high": high}).select(
            "source", "total", "target", "mean", "full", F.when(done, F.col("lam")).when(inside, newton).otherwise(middle).alias("lam"), F.col("_low").alias("low"), F.col("_high").alias("high"), done.alias("done")
        )
        state = save(state.filter("done").unionByName(step), "mix-state", instead_of=state)
        if state.filter(~F.col("done")).isEmpty():
            break
    else:
        raise RuntimeError(f"rates are not settled after {STEPS} steps")
    return state


def _mended(rated: DataFrame, cap: int) -> DataFrame:
    """Copies moved by one, here and there, until each source's words are as near its target as that brings them.

    Rounding along the sizes leaves up to a longest document. In each of MENDS
    rounds a source gains or loses one copy of the size that is nearest to what
    it lacks or has too much, if that brings it nearer; so it ends within half of
    a size that it can still move, or much closer where sizes lie densely.
    """
    for _ in range(MENDS):
        rated = save(rated, "mix-due")
        words = F.sum(F.col("size") * (F.col("whole") * F.col("n") + F.col("due")))
        off = rated.groupBy(F.col("source").alias("s")).agg((F.first("target") - words).alias("off")).filter(F.abs("off") > 0)
        met = rated.join(off, F.col("source").eqNullSafe(F.col("s"))).filter("size > 0")
        room = F.when(F.col("off") > 0, (F.col("due") < F.col("n")) & (F.col("whole") < cap)).otherwise(F.col("due") > 0)
        left = F.abs(F.abs("off") - F.col("size"))
        best = met.filter(room & (left < F.abs("off"))).groupBy("s").agg(F.min_by("size", F.struct(left.alias("l"), "size")).alias("z"), F.first(F.signum("off")).cast("bigint").alias("more"))
        if best.isEmpty():
            break
        one = F.coalesce(F.col("more"), F.lit(0).cast("bigint"))
        rated = rated.join(best, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left").withColumn("due", F.col("due") + one).drop("s", "z", "more")
    return rated


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = int(CAP), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per row: id, __tx, source, size, source_size, target, rate, copies, taken."""
    rows = save(sizes(docs, id_col, source_col, text_col), "mix-sizes")
    part = F.pmod(F.xxhash64("__id", "__tx"), F.lit(PARTS)).cast("int")
    hist = rows.groupBy(F.col("__source").alias("source"), F.col("__size").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    hist = save(hist, "mix-hist")
    state = balance(hist, weights, float(cap))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("full"), F.lit(float(cap))).otherwise(_rate(F.col("size"), F.col("mean"), F.col("lam"), float(cap)))
    rated = hist.join(state.select(F.col("source").alias("s"), "total", "target", "mean", "lam", "full"), F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "total", "target", rate.alias("rate"))
    # Fractions run up along the sizes of a source; each time the sum passes a half, one more copy is due at that size.
    along = Window.partitionBy("source").orderBy("size")
    rated = rated.withColumn("whole", F.floor("rate")).withColumn("upto", F.sum((F.col("rate") - F.col("whole")) * F.col("n")).over(along))
    due = F.floor(F.col("upto") + 0.5) - F.floor(F.coalesce(F.lag("upto").over(along), F.lit(0.0)) + 0.5)
    rated = _mended(rated.select("source", "size", "n", "total", "target", "rate", "whole", F.least(due, F.col("n")).alias("due")), cap)
    # Which documents of one (source, size) get the extra copy: those first by hash. Counts by part settle all parts but one.
    parts = rows.groupBy("__source", "__size", part.alias("__part")).agg(F.count(F.lit(1)).alias("m"))
    parts = parts.withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy("__source", "__size").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = parts.join(rated, F.col("__source").eqNullSafe(F.col("source")) & (F.col("__size") == F.col("size"))).select(
        F.col("__source").alias("c_source"), F.col("__size").alias("c_size"), F.col("__part").alias("c_part"), "total", "target", "rate", "whole",
        F.greatest(F.lit(0), F.least(F.col("m"), F.col("due") - F.col("before"))).alias("extra"), "m",
    )
    placed = rows.withColumn("__part", part).join(cut, F.col("__source").eqNullSafe(F.col("c_source")) & (F.col("__size") == F.col("c_size")) & (F.col("__part") == F.col("c_part")))
    split = (F.col("extra") > 0) & (F.col("extra") < F.col("m"))
    order = F.row_number().over(Window.partitionBy("c_source", "c_size", "c_part").orderBy(F.xxhash64("__id", "__tx", F.lit(1)), "__id", "__tx"))
    columns = ["__id", "__tx", "__source", "__size", "total", "target", "rate"]
    ranked = placed.filter(split).withColumn("place", order).select(*columns, (F.col("whole") + F.when(F.col("place") <= F.col("extra"), 1).otherwise(0)).alias("copies"))
    settled = placed.filter(~split).select(*columns, (F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)).alias("copies"))
    return settled.unionByName(ranked).select(
        F.col("__id").alias(id_col), "__tx", F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("total").cast("bigint").alias("source_size"), "target", "rate",
        F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("__size")).cast("bigint").alias("taken"),
    )


def mixed_rows(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = int(CAP), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its copies say, columns as they were.

    Rows of the same id and text share the sum of their copies: each takes the
    whole part of its share, and the first by source and columns one more.
    """
    counts = mix(docs, weights, cap, id_col, source_col, text_col)
    due = counts.groupBy(F.col(id_col).alias("__k_id"), F.col("__tx").alias("__k_tx")).agg(F.sum("copies").alias("__sum"), F.count(F.lit(1)).alias("__n"))
    due = save(due, "mix-due")
    same = F.col(id_col).eqNullSafe(F.col("__k_id")) & (F.xxhash64(text_of(text_col)) == F.col("__k_tx"))
    single = docs.join(due.filter("__n = 1 AND __sum > 0"), same).withColumn("__times", F.col("__sum"))
    repeated = due.filter("__n > 1 AND __sum > 0")
    if not repeated.isEmpty():
        sortable = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
        place = F.row_number().over(Window.partitionBy("__k_id", "__k_tx").orderBy(F.col(f"`{source_col}`"), *[F.col(f"`{c}`") for c in sortable]))
        shared = docs.join(repeated, same).withColumn("__place", place)
        times = F.floor(F.col("__sum") / F.col("__n")) + (F.col("__place") <= F.pmod("__sum", "__n")).cast("int")
        single = single.unionByName(shared.withColumn("__times", times).drop("__place"))
    return single.filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
