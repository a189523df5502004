"""Positioned lines to typed paragraphs.

lines: doc_key, page_number, page_width, page_height, text, x0, y0, x1, y1 (bottom-up points), fonts, sizes, size_mean and, where characters were seen, bold_ratio.
decorations: doc_key, page_number, x0, x1, y, width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import patterns as P

PAGE = ["doc_key", "page_number"]


def line_fonts(chars: DataFrame) -> DataFrame:
    """Font statistics of each line from its characters (doc_key, page_number, line_key, font, size): fonts, sizes, size_mean, bold_ratio, char_count."""
    size = F.bround("size", 2)
    return chars.groupBy(*PAGE, "line_key").agg(
        F.array_sort(F.collect_set("font")).alias("fonts"), F.array_sort(F.collect_set(size)).alias("sizes"), F.bround(F.avg(size), 2).alias("size_mean"),
        F.bround(F.avg(F.lower("font").contains("bold").cast("double")), 3).alias("bold_ratio"), F.count(F.lit(1)).cast("int").alias("char_count"),
    )


def is_bold(lines: DataFrame) -> Column:
    """Half of the characters or more, or any of the fonts."""
    any_font = F.exists("fonts", lambda f: F.lower(f).contains("bold"))
    return (F.coalesce(F.col("bold_ratio"), F.lit(0.0)) >= 0.5) | any_font if "bold_ratio" in lines.columns else any_font


def alignment() -> Column:
    off = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("page_width") / 2)
    return F.when(off <= 20, "center").when((F.col("x1") >= F.col("page_width") - 80) & (F.col("x0") > F.col("page_width") / 2), "right").otherwise("left")


def block_type() -> Column:
    """From alignment and is_bold: header and footer by place, then heading, list item, body."""
    text = F.btrim(F.regexp_replace("text", r"\s+", " "))
    low, any_letter = F.lower(text), text.rlike("[A-Za-z]")
    return (
        F.when(text == "", "empty").when(F.col("y0") < 45, "footer").when(F.col("y1") > F.col("page_height") - 45, "header").when(text.startswith("Page ") & text.contains(" of "), "header")
        .when((F.col("alignment") == "center") & (F.col("is_bold") | (any_letter & (F.upper(text) == text))), "heading")
        .when(low.startswith("sub:") | low.startswith("subject:"), "heading").when(text.rlike(P.LIST_PREFIX), "list_item").when(F.col("is_bold") & (F.length(text) <= 120), "heading").otherwise("body")
    )


def underlined(lines: DataFrame, decorations: DataFrame) -> DataFrame:
    """Lines (keyed by line_key) that a decoration underlines: a range semi-join within the page."""
    d = decorations.select(*[F.col(c).alias(f"d_{c}") for c in ("doc_key", "page_number", "x0", "x1", "y", "width")])
    near = (
        (F.col("doc_key") == F.col("d_doc_key")) & (F.col("page_number") == F.col("d_page_number")) & (F.col("d_width") >= F.least(F.lit(20.0), (F.col("x1") - F.col("x0")) * 0.4))
        & (F.least("x1", "d_x1") > F.greatest("x0", "d_x0")) & (F.col("d_y") - F.col("y0")).between(-3.0, 3.5)
    )
    return lines.join(d, near, "left_semi")


def typed_lines(lines: DataFrame, decorations: DataFrame) -> DataFrame:
    """Adds line_no, alignment, is_bold, is_underlined_guess, block_type, margin_left."""
    rows = lines.withColumn("line_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.col("y1").desc(), "x0", "text")))
    under = underlined(rows, decorations).select(*PAGE, "line_no").withColumn("is_underlined_guess", F.lit(True))
    rows = rows.join(under, [*PAGE, "line_no"], "left").withColumn("is_underlined_guess", F.coalesce("is_underlined_guess", F.lit(False)))
    rows = rows.withColumn("alignment", alignment()).withColumn("is_bold", is_bold(lines))
    rows = rows.withColumn("block_type", block_type())
    page = Window.partitionBy(*PAGE)
    body = (F.btrim("text") != "") & (F.col("alignment") != "center") & ~F.col("block_type").isin("header", "footer")
    return rows.withColumn("margin_left", F.coalesce(F.min(F.when(body, F.bround("x0", 1))).over(page), F.min("x0").over(page), F.lit(0.0)))


def indent_steps(typed: DataFrame, most: int = 12) -> DataFrame:
    """Distinct indents of a page, ascending, the first ``most``."""
    step = F.when(~F.col("block_type").isin("header", "footer"), F.bround(F.col("x0") - F.col("margin_left"), 1))
    return typed.groupBy(*PAGE).agg(F.slice(F.array_sort(F.collect_set(step)), 1, most).alias("indent_steps"))


def breaks(p: Column) -> Column:
    """Whether a new paragraph starts at this line; ``p`` is the line before (null on a page's first)."""
    kind, prev = F.col("block_type"), p["block_type"]
    gap, shift = p["y0"] - F.col("y1"), F.abs(p["x0"] - F.col("x0"))
    before, now = F.btrim(p["text"]), F.btrim(F.col("text"))
    tight, loose = F.greatest(F.lit(5.5), p["size_mean"] * 0.55), F.greatest(F.lit(7.5), p["size_mean"] * 0.9)
    edge, listed = ("header", "footer"), now.rlike(P.LIST_PREFIX)
    low_start = now.rlike(r"^\p{Ll}")
    goes_on = (prev == "heading") & (shift <= 6) & (gap <= F.greatest(F.lit(24.0), tight * 4)) & (
        low_start | F.lower(before).rlike("^(?:sub|subject):") | p["is_underlined_guess"] | F.col("is_underlined_guess")
    )
    after_item = ((F.col("x0") >= p["x0"] + 10) | (shift <= 6)) & ~listed
    return (
        F.when(p.isNull(), True).when(prev.isin(*edge) | kind.isin(*edge), True).when(kind == "heading", ~goes_on).when(prev == "heading", True).when(kind == "list_item", True)
        .when(gap > loose, True).when(prev == "list_item", ~after_item).when((shift >= 18) & (F.col("x0") <= p["x0"]), True).when(before.endswith(":") & listed, True).otherwise(False)
    )


def islands(typed: DataFrame) -> DataFrame:
    """Adds para_no: breaks counted up along the page; empty lines are left out."""
    page = Window.partitionBy(*PAGE).orderBy("line_no")
    prev = F.lag(F.struct("block_type", "x0", "y0", "y1", "text", "size_mean", "is_underlined_guess")).over(page)
    rows = typed.filter("block_type <> 'empty'").withColumn("__p", prev).withColumn("__b", breaks(F.col("__p")).cast("int"))
    return rows.withColumn("para_no", F.sum("__b").over(page.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__p", "__b")


def paragraphs(numbered: DataFrame) -> DataFrame:
    """One row per paragraph: type, text, box, indents, bold (all lines), underlined (any)."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "block_type", "text")))
    rows = numbered.groupBy(*PAGE, "para_no").agg(
        ordered.alias("l"), F.bround(F.min("x0"), 2).alias("left"), F.bround(F.min("y0"), 2).alias("bottom"), F.bround(F.max("x1"), 2).alias("right"), F.bround(F.max("y1"), 2).alias("top"),
        F.bround(F.min("x0") - F.min("margin_left"), 2).alias("indent_points"), F.every("is_bold").alias("is_bold"), F.some("is_underlined_guess").alias("is_underlined_guess"), F.count(F.lit(1)).alias("n_lines"),
    )
    first = F.get(F.col("l"), F.lit(0))["block_type"]
    # Most common type; among equals the one seen first.
    kinds = F.array_distinct(F.transform("l", lambda x: x["block_type"]))
    counted = F.transform(kinds, lambda k, i: F.struct((-F.size(F.filter("l", lambda x: x["block_type"] == k))).alias("n"), i.alias("i"), k.alias("k")))
    common = F.get(F.array_sort(counted), F.lit(0))["k"]
    texts = F.filter(F.transform("l", lambda x: F.btrim(x["text"])), lambda t: t != "")
    return rows.select(
        *PAGE, "para_no", F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit("."), F.col("para_no").cast("string")).alias("paragraph_id"),
        F.when(first.isin("heading", "list_item", "header", "footer"), first).otherwise(common).alias("block_type"), F.array_join(texts, " ").alias("text"), "left", "bottom", "right", "top",
        "indent_points", F.bround(F.greatest(F.lit(0.0), F.col("indent_points")) / 18, 0).cast("int").alias("indent_level"), "is_bold", "is_underlined_guess", "n_lines",
    )


def text_profile(page_texts: DataFrame) -> DataFrame:
    """Per document (doc_key, page_number, text): pages, pages with text, characters, whether it can be read, two samples of 400 characters.

    The two pages of each document that give samples are chosen by rank, which
    Spark limits before it shuffles, so no other text is gathered.
    """
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    rows = page_texts.select("doc_key", "page_number", body.alias("t"))
    place = F.row_number().over(Window.partitionBy("doc_key").orderBy("page_number"))
    firsts = rows.filter("t <> ''").select("doc_key", "page_number", F.substring("t", 1, 400).alias("t")).withColumn("n", place).filter("n <= 2")
    samples = firsts.groupBy("doc_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]).alias("samples"))
    out = rows.groupBy("doc_key").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("t") != "").alias("text_pages"), F.sum(F.length("t")).alias("total_chars"))
    out = out.join(samples, "doc_key", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
    return out.withColumn("extractable", (F.col("text_pages") > 0) & (F.col("total_chars") > 200))


def structured(numbered: DataFrame) -> DataFrame:
    """Pages with their paragraphs and lines nested, one row per document: doc_key, pages.

    ``numbered`` are lines with para_no (``islands``); a line's id is its place in its paragraph.
    """
    para_id = F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit("."), F.col("para_no").cast("string"))
    place = F.row_number().over(Window.partitionBy(*PAGE, "para_no").orderBy("line_no"))
    indent = F.bround(F.col("x0") - F.col("margin_left"), 2)
    rows = numbered.withColumn("paragraph_id", para_id).withColumn("line_id", F.concat(para_id, F.lit(".l"), place.cast("string")))
    some = [c for c in ("fonts", "sizes", "size_mean", "bold_ratio") if c in numbered.columns]
    line = F.struct(
        "line_no", "line_id", "paragraph_id", F.btrim("text").alias("text"), *[F.bround(a, 2).alias(b) for a, b in (("x0", "left"), ("x1", "right"), ("y1", "top"), ("y0", "bottom"))], *some, "is_bold", "is_underlined_guess",
        indent.alias("indent_points"), F.bround(F.greatest(F.lit(0.0), indent) / 18, 0).cast("int").alias("indent_level"), "alignment", "block_type",
    )
    lines = rows.groupBy(*PAGE).agg(
        F.bround(F.first("page_width"), 2).alias("width"), F.bround(F.first("page_height"), 2).alias("height"), F.bround(F.first("margin_left"), 2).alias("margin_left"), F.array_sort(F.collect_list(line)).alias("lines")
    )
    ids = rows.groupBy(*PAGE, "para_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line_id"))), lambda x: x["line_id"]).alias("line_ids"))
    paras = paragraphs(numbered).join(ids, [*PAGE, "para_no"])
    box = F.struct("left", "bottom", "right", "top").alias("bbox")
    nested = paras.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("para_no", "paragraph_id", "block_type", "text", box, "indent_points", "indent_level", "is_bold", "is_underlined_guess", "line_ids"))).alias("paragraphs"))
    page = lines.join(indent_steps(numbered), PAGE).join(nested, PAGE)
    return page.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("page_number", "width", "height", "margin_left", "indent_steps", "paragraphs", "lines"))).alias("pages"))
