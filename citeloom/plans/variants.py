"""A corpus of the rarer forms, one citing document for each order, in Spark and in SQL.

Bracketed and trailing master-circular titles, several locators of one document,
an alias inside another, citations of the document itself, and subjects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import extract as X
from citeloom.plans.catalog import query
from citeloom.plans.corpus import _spelled, _spelled_sql

#: {k} order key, {l} long date, {a} {b} {c} numbers of two digits that differ.
PARAGRAPHS = (
    "CIRCULAR SEBI/HO/{k} {l} Subject: Desk{k} Norms 1. General",
    'Master Circular for Brokers ("MCB") dated {l} and the like',
    "SEBI's Master Circular dated {l} for Custodians provides the form",
    "Master Circular dated {l}; section {a} and {b}(1) of the Depositories Act, 1996; section {c} of the Depositories Act, 1996 (\"Funds\") apply",
    'The SEBI (Mutual Funds) Regulations, 1996 ("MF Funds") stand amended',
    "MF Funds are read with Funds of any kind",
    'SEBI (Desk{k} Norms) Regulations, 1996 ("Annexure-A Norms") apply',
    "Annexure-A Norms of this circular and MF Funds apply",
    "Annexure-A Norms apply elsewhere",
)


def parts(spark: SparkSession, sf_dir: str) -> int:
    """How many parts the corpus is dealt into: Spark's own number, or more if a part would have more than PART_ROWS paragraphs."""
    paragraphs = spark.read.parquet(f"{sf_dir}/orders.parquet").count() * len(PARAGRAPHS)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-paragraphs // X.PART_ROWS))


def paragraphs(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """doc_key, page_number, para_no, paragraph_id, text; the first paragraph is page 1.

    With ``parts`` orders are dealt out before their paragraphs are spelled: keys and dates are shuffled, texts are not.
    """
    key = F.col("o_orderkey")
    number = lambda n: (key % 10 + n).cast("string")
    words = {"k": key.cast("string"), "l": F.date_format("o_orderdate", "MMMM d, yyyy"), "a": number(10), "b": number(30), "c": number(50)}
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key, "o_orderdate")
    orders = orders.repartition(parts, key) if parts else orders
    rows = orders.select(key.alias("doc_key"), F.posexplode(F.array(*[_spelled(t, words) for t in PARAGRAPHS])).alias("i", "text"))
    page, para = F.when(F.col("i") == 0, 1).otherwise(2), F.when(F.col("i") == 0, 1).otherwise(F.col("i"))
    return rows.select("doc_key", page.alias("page_number"), para.alias("para_no"), F.format_string("p%d.%d", page, para).alias("paragraph_id"), "text")


_PARTS = {"k": "o_orderkey::VARCHAR", "l": "strftime(o_orderdate, '%B %-d, %Y')", "a": "(o_orderkey % 10 + 10)::VARCHAR", "b": "(o_orderkey % 10 + 30)::VARCHAR", "c": "(o_orderkey % 10 + 50)::VARCHAR"}


def _sql(template: str | None) -> str:
    return "NULL" if template is None else _spelled_sql(template.replace("'", "''"), _PARTS)


#: What is cited: para_no, kind, title, matched texts, raw locators, sections, relation, whether by alias only. An alias is found where it is introduced, too. Citations of the document itself (by its subject's title, or as an annexure of "this circular") are not among them.
_FUNDS, _ACT, _DESK = "SEBI (Mutual Funds) Regulations, 1996", "Depositories Act, 1996", "SEBI (Desk{k} Norms) Regulations, 1996"
MENTIONS = (
    (1, "master_circular", "Master Circular for Brokers", ('Master Circular for Brokers ("MCB") dated {l} and the like',), (), (), "references", False),
    (2, "master_circular", "Master Circular for Custodians", ("SEBI's Master Circular dated {l} for Custodians",), (), (), "quotes_or_cites", False),
    (3, "master_circular", "Master Circular", ("Master Circular dated {l}",), (), (), "references", False),
    (3, "act", _ACT, (_ACT, "Funds"), ("section {a} and {b}(1)", "section {c}"), ("{a}", "{b}", "1", "{c}"), "references", False),
    (4, "regulations", _FUNDS, ("MF Funds", _FUNDS), (), (), "amends_or_modifies", False),
    (5, "regulations", _FUNDS, ("MF Funds",), (), (), "legal_basis", True),
    (5, "act", _ACT, ("Funds",), (), (), "legal_basis", True),
    (6, "regulations", _DESK, ("Annexure-A Norms",), (), (), "references", True),
    (7, "regulations", _FUNDS, ("MF Funds",), (), (), "references", True),
    (8, "regulations", _DESK, ("Annexure-A Norms",), (), (), "references", True),
)


def _list_sql(items: tuple[str, ...]) -> str:
    return "[" + ", ".join(_sql(i) for i in items) + "]::VARCHAR[]"


_MENTIONS_SQL = " UNION ALL ".join(
    f"SELECT o_orderkey AS doc_key, {para} AS para_no, '{kind}' AS document_type, {_sql(title)} AS title, {_list_sql(texts)} AS match_texts, {_list_sql(raw) if raw else 'NULL::VARCHAR[]'} AS raw, {_list_sql(sections)} AS sections, "
    f"'{relation}' AS relation_type, {0.74 if alias else 0.92 if kind == 'master_circular' else 0.93}::DOUBLE AS confidence FROM orders"
    for para, kind, title, texts, raw, sections, relation, alias in MENTIONS
)


@query(_MENTIONS_SQL)
def variant_mentions(spark, sf_dir):
    """Mentions of the rarer forms: titles in brackets and trailers, merged locators, the longer of two aliases, no citation of the document itself."""
    dealt = parts(spark, sf_dir)
    found = X.Extraction(paragraphs(spark, sf_dir, dealt), parts=dealt)
    at = F.col("target_locators")
    return found.named().select("doc_key", "para_no", "document_type", "title", "match_texts", at["raw"].alias("raw"), at["sections"].alias("sections"), "relation_type", "confidence")


@query(f"SELECT o_orderkey AS doc_key, 2 AS page_count, 'SEBI/HO/' || o_orderkey AS circular_number, {_PARTS['l']} AS issue_date, 'Desk' || o_orderkey || ' Norms' AS title FROM orders")
def variant_sources(spark, sf_dir):
    """Number, date and subject of each citing document."""
    return X.source_metadata(paragraphs(spark, sf_dir)).select("doc_key", "page_count", "circular_number", "issue_date", "title")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'relies_on' WHEN 1 THEN 'references' ELSE 'relies_on' END AS loose, CASE o_orderkey % 3 WHEN 2 THEN 'relies_on' ELSE 'references' END AS strict FROM orders")
def strict_relations(spark, sf_dir):
    """Relations by substrings and by whole words: "provide that" holds "vide ", "videotape" does not."""
    text = F.element_at(F.array(*[F.lit(t) for t in ("members provide that form", "a videotape of it", "vide letter of")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", T.relation_type(F.col("t")).alias("loose"), T.relation_type(F.col("t"), strict=True).alias("strict"))
