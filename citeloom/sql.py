"""The SQL surface: citation functions and tables by name, for queries that are written as text.

Functions are SQL functions whose bodies are the library's own Column
expressions, so Catalyst sees and compiles what the DataFrame API would give it;
no Python runs. ``citations(text)`` is a table function, to be joined laterally.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators.extract import Extraction, text_findings

#: Operators that Spark's rendering of a Column writes like functions; as names they need quotes.
_OPERATORS = re.compile(r"(?<![\w`])(and|or|not|in|rlike|like|<=>|<=|>=|==|=|!=|<|>|\+|-|\*|/|%|!)\(")
_STRINGS = re.compile(r"('(?:[^'\\]|\\.)*')")

#: Scalar functions: name, parameters, expression over columns of these names.
FUNCTIONS = {
    "compact_text": ("t STRING", lambda: T.compact("t")),
    "tidy_title": ("t STRING", lambda: T.tidy_title("t")),
    "clean_alias": ("t STRING", lambda: T.clean_alias("t")),
    "citation_year": ("t STRING", lambda: T.parse_year("t")),
    "citation_date": ("t STRING", lambda: T.listing_date(F.col("t"))),
    "document_kind": ("t STRING", lambda: T.document_type(F.col("t"))),
    "relation_kind": ("t STRING", lambda: T.relation_type(F.col("t"))),
    "citation_locators": ("t STRING", lambda: T.locators(F.col("t"))),
    "title_words": ("t STRING", lambda: T.title_tokens(F.col("t"))),
    "word_similarity": ("a ARRAY<STRING>, b ARRAY<STRING>", lambda: T.jaccard(F.col("a"), F.col("b"))),
}
#: Views of an extraction: name in SQL, table of the extraction.
VIEWS = {"paragraphs": "paragraphs", "citation_findings": "findings", "referenced_documents": "documents", "reference_mentions": "mentions", "run_summary": "summary", "source_documents": "sources"}


def sql_text(column: Column) -> str:
    """A Column as SQL that parses: Spark's rendering, with the names of operators in quotes."""
    parts = _STRINGS.split(column._jc.node().sql())
    return "".join(part if i % 2 else _OPERATORS.sub(r"`\1`(", part) for i, part in enumerate(parts))


def register_functions(spark: SparkSession) -> None:
    """Makes FUNCTIONS and the table function ``citations(t)`` known to the session: pattern, pos, start, end, the finding's fields, locators."""
    for name, (parameters, make) in FUNCTIONS.items():
        row = spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {p.split(' ', 1)[1]}) AS {p.split(' ', 1)[0]}" for p in parameters.split(", ")))
        kind = row.select(make().alias("x")).schema["x"].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {sql_text(make())}")
    found = text_findings(F.col("t"))
    schema = spark.range(1).select(F.lit("").alias("t")).select(found.alias("x")).schema["x"].dataType.elementType
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION citations(t STRING) RETURNS TABLE ({columns}) RETURN SELECT inline({sql_text(found)})")


def register_views(extraction: Extraction, prefix: str = "") -> None:
    """The extraction's tables as temporary views; each is computed when it is registered, if the extraction stores its tables."""
    for name, table in VIEWS.items():
        getattr(extraction, table).createOrReplaceTempView(prefix + name)
