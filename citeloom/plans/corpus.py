"""A corpus of citation paragraphs made from orders and customers, in Spark and in SQL.

A customer is a citing document, its orders in key order are its paragraphs, four to a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ten paragraph texts; {k} order key, {s} segment, {n} customer name, {y} year, {l} long date, {d} short date, {m} month and day, {a} to {c} small numbers.
TEMPLATES = (
    "In terms of para {a} of Master Circular for {s} dated {l} the members shall report.",
    "SEBI Circular CIR/{s}/{b}/{y} dated {d} is relied upon; see annexure {c}.",
    'Regulation {a}(1) of the SEBI (Mutual Funds) Regulations, {y} ("MF Regulations") stand amended.',
    "As per section {a} of the Depositories Act, {y} read with notification dated {l}.",
    "Paras {a} of the Master Circular stand replaced.",
    "Vide Gazette notification dated {d}, entities shall comply.",
    "Refer to the Master Circular for {s} dated {m},",
    "{y} onwards, this circular provides the details.",
    "The MF Regulations and the SEBI (Mutual Funds) Regulation, {y} were issued.",
    "No citation here: order {k} of {n}.",
)


def _spelled(template: str, parts: dict[str, Column]) -> Column:
    """A template with its marks {x} replaced by columns."""
    pieces, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        pieces += [F.lit(head), parts[tail[0]]]
        rest = tail[2:]
    return F.concat(*pieces, F.lit(rest))


def _spelled_sql(template: str, parts: dict[str, str]) -> str:
    text = "'" + template + "'"
    for name, expression in parts.items():
        text = text.replace("{" + name + "}", f"' || {expression} || '")
    return text


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_key, seq, page_number, para_no, paragraph_id, text."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).withColumn("seq", seq)
    number = lambda n: (F.col("o_orderkey") % n + 1).cast("string")
    day = lambda form: F.date_format("o_orderdate", form)
    parts = {
        "k": F.col("o_orderkey").cast("string"), "s": F.col("c_mktsegment"), "n": F.col("c_name"), "y": day("yyyy"), "l": day("MMMM d, yyyy"), "d": day("d MMM yyyy"), "m": day("MMMM d"),
        "a": number(30), "b": number(50), "c": number(4),
    }

    text = F.lit(None).cast("string")
    for i, template in enumerate(TEMPLATES):
        text = F.when((F.col("o_custkey") + F.col("seq")) % 10 == i, _spelled(template, parts)).otherwise(text)
    page, para = F.ceil(F.col("seq") / 4).cast("int"), ((F.col("seq") - 1) % 4 + 1).cast("int")
    return rows.select(
        F.col("o_custkey").alias("doc_key"), F.col("seq").cast("int").alias("seq"), page.alias("page_number"), para.alias("para_no"),
        F.concat(F.lit("p"), page.cast("string"), F.lit("."), para.cast("string")).alias("paragraph_id"), text.alias("text"),
    )


def _sql_case() -> str:
    parts = {
        "k": "o_orderkey::VARCHAR", "s": "c_mktsegment", "n": "c_name", "y": "strftime(o_orderdate, '%Y')", "l": "strftime(o_orderdate, '%B %-d, %Y')", "d": "strftime(o_orderdate, '%-d %b %Y')",
        "m": "strftime(o_orderdate, '%B %-d')", "a": "(o_orderkey % 30 + 1)::VARCHAR", "b": "(o_orderkey % 50 + 1)::VARCHAR", "c": "(o_orderkey % 4 + 1)::VARCHAR",
    }
    out = ""
    for i, template in enumerate(TEMPLATES):
        out += f" WHEN {i} THEN {_spelled_sql(template, parts)}"
    return out


#: Common table expression ``corpus`` for DuckDB; queries continue after it with a comma or SELECT.
CORPUS_SQL = f"""
WITH o AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders JOIN customer ON o_custkey = c_custkey
), corpus AS (
  SELECT o_custkey AS doc_key, seq::INT AS seq, ceil(seq / 4.0)::INT AS page_number, ((seq - 1) % 4 + 1)::INT AS para_no,
         CASE (o_custkey + seq) % 10 {_sql_case()} END AS text
  FROM o
)
"""
