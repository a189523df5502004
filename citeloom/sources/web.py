"""Pages and attachments over HTTP. Requests are made on executors, by a function that can be exchanged."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.storage import Kept

Get = Callable[[str, bytes | None], bytes]


def http(url: str, body: bytes | None = None, timeout: float = 60) -> bytes:
    """One request; a body makes it a POST."""
    request = urllib.request.Request(url, data=body, headers={"User-Agent": "Mozilla/5.0"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read()


def fetch(urls: DataFrame, url_col: str = "url", get: Get = http) -> DataFrame:
    """The rows with body (binary) and error: null body where the request failed, which fails no other row."""
    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    schema = StructType([*urls.schema.fields, StructField("body", BinaryType()), StructField("error", StringType())])

    def one(url: str | None) -> tuple[bytes | None, str | None]:
        try:
            return (get(url, None), None) if url else (None, "no url")
        except (OSError, ValueError) as error:
            return None, f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [one(u) for u in batch[url_col]]
            yield batch.assign(body=[b for b, _ in found], error=[e for _, e in found])

    return urls.mapInPandas(run, schema)


def attachments(pages: DataFrame, get: Get = http, strict: bool = False) -> DataFrame:
    """Of page urls (page_url) the PDF that each one is, or holds: page_url, pdf_url, pdf_name, bytes, content, error.

    ``strict`` takes only file= parameters that name a PDF on the issuer's host.
    Every url is asked once: what came is stored before it is read again.
    """
    kept = Kept(pages.sparkSession)
    is_pdf = F.lower(F.regexp_extract("page_url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)).endswith(".pdf")
    read = fetch(pages.filter(~is_pdf).select("page_url"), "page_url", get).withColumn("html", F.decode("body", "UTF-8"))
    link = T.strict_pdf_link(F.col("html")) if strict else T.absolute_url(F.col("page_url"), T.pdf_link(F.col("html")))
    linked = kept(read.select("page_url", link.alias("pdf_url"), F.col("error").alias("page_error")))
    direct = pages.filter(is_pdf).select("page_url", F.col("page_url").alias("pdf_url"), F.lit(None).cast("string").alias("page_error"))
    got = kept(fetch(direct.unionByName(linked), "pdf_url", get))
    name = T.safe_name(F.col("pdf_url")) if strict else T.pdf_name(F.col("pdf_url"))
    return got.select("page_url", "pdf_url", F.when(F.col("pdf_url").isNotNull(), name).alias("pdf_name"), F.octet_length("body").cast("bigint").alias("bytes"), F.col("body").alias("content"), F.coalesce("page_error", "error").alias("error"))


def manifest(downloads: DataFrame, folder: str = "pdfs") -> DataFrame:
    """What was stored: page_url, pdf_url, pdf_path, bytes."""
    return downloads.filter("content IS NOT NULL").select("page_url", "pdf_url", F.concat(F.lit(f"{folder}/"), "pdf_name").alias("pdf_path"), "bytes")
