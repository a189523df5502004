"""The SQL surface gives what the DataFrame API gives."""

from pyspark.sql import functions as F

from citeloom import sql as SQL
from citeloom.functions import text as T
from citeloom.operators.extract import Extraction

TEXTS = [
    "As per section 5 of the Depositories Act, 1996 and SEBI Circular SEBI/HO/1 dated 5 Mar 2020; it's \"x\".", "Regulation 3 of the SEBI (Mutual Funds) Regulation, 1996 (\"MF Regulations\") stand amended.", "", None,
    "In terms of para 2 of Master Circular for Brokers dated May 3, 2021 (the 'Master Circular') it provides", "Depositories Act, 1996 Depositories Act, 1996 \\ and Gazette notification dated 5 Mar 2020",
]


def test_functions_and_table_function(spark):
    SQL.register_functions(spark)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows.createOrReplaceTempView("sql_texts")
    for name, column in (("compact_text", T.compact("t")), ("document_kind", T.document_type(F.col("t"))), ("relation_kind", T.relation_type(F.col("t"))), ("citation_locators", T.locators(F.col("t"))), ("title_words", T.title_tokens(F.col("t")))):
        got = spark.sql(f"SELECT i, {name}(t) AS x FROM sql_texts").collect()
        assert sorted(got, key=lambda r: r.i) == sorted(rows.select("i", column.alias("x")).collect(), key=lambda r: r.i), name
    assert spark.sql("SELECT word_similarity(title_words('mutual funds'), title_words('the mutual trust')) AS s").first().s == 1 / 3
    found = spark.sql("SELECT t.i, c.* FROM sql_texts t, LATERAL citations(t.t) c")
    text = rows.filter("t IS NOT NULL").select(F.lit("d").alias("doc_key"), F.lit(1).alias("page_number"), (F.col("i") + 1).alias("para_no"), F.lit("p").alias("paragraph_id"), "t").withColumnRenamed("t", "text")
    from citeloom.operators.extract import explicit_findings

    same = explicit_findings(text.withColumn("para_seq", F.col("para_no")))
    columns = ["pattern", "pos", "start", "end", "document_type", "title", "identifier", "date", "year", "aliases", "key", "locators"]
    assert sorted(map(str, found.select((F.col("i") + 1).alias("para_seq"), *columns).collect())) == sorted(map(str, same.select("para_seq", *columns).collect()))
    assert found.count() == 7


def test_views(spark):
    text = spark.createDataFrame([("a", 1, 1, "p1", TEXTS[0]), ("a", 1, 2, "p2", TEXTS[1]), ("b", 1, 1, "p1", "none")], "doc_key string, page_number int, para_no int, paragraph_id string, text string")
    SQL.register_views(Extraction(text), "v_")
    got = spark.sql("SELECT m.doc_key, d.document_type, m.relation_type FROM v_reference_mentions m JOIN v_referenced_documents d USING (doc_key, document_id)").collect()
    assert sorted(tuple(r) for r in got) == [("a", "act", "references"), ("a", "circular", "references"), ("a", "regulations", "amends_or_modifies")]
    assert spark.sql("SELECT count(*) AS n FROM v_source_documents").first().n == 2 and spark.sql("SELECT * FROM v_run_summary").count() == 1
