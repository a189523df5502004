"""PDF files through a parser that the caller brings, as there is none in Spark.

A parser takes a file's bytes and returns (metadata, pages): a dict with any of
title, author, creator, producer, tagged, and a list of pages, dicts with width,
height, text, lines (dicts with text, x0, y0, x1, y1, chars: pairs of font and
size) and decorations (dicts with x0, x1, y0, y1).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import layout

Parser = Callable[[bytes], tuple[dict, list[dict]]]

_LINE = "struct<line_key:int,text:string,x0:double,y0:double,x1:double,y1:double,chars:array<struct<font:string,size:double>>>"
_DECORATION = "struct<x0:double,x1:double,y:double,width:double>"
_SCAN = (
    "doc_key string, file_name string, error string, metadata struct<title:string,author:string,creator:string,producer:string,tagged:boolean,page_count:int>, "
    f"pages array<struct<page_number:int,width:double,height:double,text:string,lines:array<{_LINE}>,decorations:array<{_DECORATION}>>>"
)
#: Points up to which a box counts as a rule.
THIN = 2.5


def list_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """The PDF files of a folder, or the one file: path, file_name, doc_key (the stem), bytes (length), content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("file_name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_key"), F.col("length").alias("bytes"), "content")


def scan(files: DataFrame, parser: Parser) -> DataFrame:
    """Parses each file by itself: doc_key, file_name, error (null where it went well), metadata, pages. A file that cannot be read fails no other."""

    def decoration(d: dict) -> dict | None:
        wide, high = abs(d["x1"] - d["x0"]), abs(d["y1"] - d["y0"])
        return {"x0": d["x0"], "x1": d["x1"], "y": (d["y0"] + d["y1"]) / 2, "width": wide} if min(wide, high) <= THIN else None

    def page(number: int, p: dict) -> dict:
        lines = [{**{k: ln[k] for k in ("x0", "y0", "x1", "y1")}, "text": " ".join(ln["text"].split()), "chars": [{"font": f, "size": s} for f, s in ln["chars"]]} for ln in p.get("lines", ())]
        lines = [{"line_key": i, **ln} for i, ln in enumerate(ln for ln in lines if ln["text"] and ln["chars"])]
        return {"page_number": number, "width": p["width"], "height": p["height"], "text": p.get("text"), "lines": lines, "decorations": [x for d in p.get("decorations", ()) if (x := decoration(d))]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                try:
                    known, pages = parser(bytes(row.content))
                    meta = {k: known.get(k) for k in ("title", "author", "creator", "producer")} | {"tagged": bool(known.get("tagged")), "page_count": len(pages)}
                    found = [row.doc_key, row.file_name, None, meta, [page(i, p) for i, p in enumerate(pages, 1)]]
                except Exception as error:  # noqa: BLE001 - whatever a parser raises is that file's result
                    found = [row.doc_key, row.file_name, f"{type(error).__name__}: {error}", None, []]
                yield pd.DataFrame([found], columns=["doc_key", "file_name", "error", "metadata", "pages"])

    return files.select("doc_key", "file_name", "content").mapInPandas(run, _SCAN)


def lines_of(scanned: DataFrame) -> DataFrame:
    """Lines as ``layout`` takes them, font statistics included."""
    pages = scanned.select("doc_key", F.explode("pages").alias("p"))
    rows = pages.select("doc_key", "p.page_number", F.col("p.width").alias("page_width"), F.col("p.height").alias("page_height"), F.explode("p.lines").alias("l"))
    rows = rows.select("doc_key", "page_number", "page_width", "page_height", "l.*")
    fonts = layout.line_fonts(rows.select("doc_key", "page_number", "line_key", F.inline("chars")))
    return rows.drop("chars").join(fonts, ["doc_key", "page_number", "line_key"])


def decorations_of(scanned: DataFrame) -> DataFrame:
    pages = scanned.select("doc_key", F.explode("pages").alias("p"))
    return pages.select("doc_key", "p.page_number", F.inline("p.decorations"))


def page_texts(scanned: DataFrame) -> DataFrame:
    """(doc_key, page_number, text) for ``layout.text_profile``."""
    return scanned.select("doc_key", F.inline("pages")).select("doc_key", "page_number", "text")


def structured(scanned: DataFrame) -> DataFrame:
    """The whole layout of each document: doc_key, file_name, metadata, pages."""
    typed = layout.islands(layout.typed_lines(lines_of(scanned), decorations_of(scanned)))
    return scanned.select("doc_key", "file_name", "metadata").join(layout.structured(typed), "doc_key", "left")
