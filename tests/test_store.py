"""Stored tables: a rerun replaces its own rows only, joins need no shuffle, files go through the store's own file system."""

import pytest
from pyspark.sql import functions as F

from citeloom.operators.extract import Extraction
from citeloom.sources import store as S
from citeloom.sources.tables import write_files

SCHEMA = "doc_key string, page_number int, para_no int, paragraph_id string, text string"


def paragraphs(spark, texts):
    return spark.createDataFrame([(d, 1, i + 1, f"p1.{i + 1}", t) for d, ts in texts.items() for i, t in enumerate(ts)], SCHEMA)


def files_of(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


@pytest.fixture
def tables(spark, tmp_path, request):
    yield tmp_path, f"t_{abs(hash(request.node.name)) % 10**9}"
    for row in spark.sql("SHOW TABLES").collect():
        if row.tableName.startswith("t_"):
            spark.sql(f"DROP TABLE {row.tableName}")


def test_a_rerun_of_one_document_replaces_only_its_rows(spark, tables):
    path, name = tables
    texts = {f"d{i}": [f"SEBI Circular SEBI/HO/{i} is cited.", f"See the Depositories Act, 19{60 + i}."] for i in range(12)}
    store = S.CitationStore(spark, f"file://{path}/k1", name, parts=4, buckets=2)
    store.replace(Extraction(paragraphs(spark, texts)))
    before, kept = files_of(path / "k1" / "mentions"), store["documents"].filter("doc_key <> 'd3'").orderBy("doc_key", "document_no").collect()
    assert store["mentions"].count() == 24 and store["sources"].count() == 12
    touched = store.replace(Extraction(paragraphs(spark, {"d3": ["SEBI Circular SEBI/HO/77 and SEBI Circular SEBI/HO/78.", "nothing here"]})))
    assert sorted(r.identifier for r in store["documents"].filter("doc_key = 'd3'").collect()) == ["SEBI/HO/77", "SEBI/HO/78"]
    assert store["documents"].filter("doc_key <> 'd3'").orderBy("doc_key", "document_no").collect() == kept
    after = files_of(path / "k1" / "mentions")
    assert len(touched["mentions"]) == 1 and {p for p in before if f"part={touched['mentions'][0]}/" not in str(p)} <= {p for p in after if after[p] == before.get(p)}
    store.replace(Extraction(paragraphs(spark, {"d3": ["SEBI Circular SEBI/HO/77 and SEBI Circular SEBI/HO/78.", "nothing here"]})))  # tried again
    assert store["documents"].count() == len(kept) + 2


def test_a_document_that_loses_all_its_rows_leaves_none(spark, tables):
    path, name = tables
    store = S.CitationStore(spark, f"file://{path}/k1", name, parts=8, buckets=1)
    store.replace(Extraction(paragraphs(spark, {"only": ["SEBI Circular SEBI/HO/1."]})))
    store.replace(Extraction(paragraphs(spark, {"only": ["no citation"]})))
    assert store["documents"].count() == 0 and store["mentions"].count() == 0 and store["sources"].count() == 1
    again = S.CitationStore(spark, f"file://{path}/k1", name + "_b", parts=8, buckets=1)  # another session's names for the same folders
    again.replace(Extraction(paragraphs(spark, {"new": ["SEBI Circular SEBI/HO/2."]})))
    assert again["sources"].count() == 2 and again["documents"].count() == 1


def test_joins_of_stored_tables_do_not_shuffle(spark, tables, capsys):
    path, name = tables
    store = S.CitationStore(spark, f"file://{path}/k1", name, parts=4, buckets=4)
    store.replace(Extraction(paragraphs(spark, {f"d{i}": ["SEBI Circular SEBI/HO/1.", "the Depositories Act, 1996"] for i in range(30)})))
    joined = store.cited()
    joined.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == 60 and joined.filter("identifier = 'SEBI/HO/1'").count() == 30
    counts = store["mentions"].groupBy("doc_key").agg(F.count(F.lit(1)).alias("n"))
    counts.explain()
    assert "Exchange" not in capsys.readouterr().out


def test_files_are_written_by_name_and_replaced(spark, tmp_path):
    rows = spark.createDataFrame([("a b=c.json", "one\ntwo é"), ("x%y.json", "3")], "name string, content string")
    assert write_files(rows, f"file://{tmp_path}/out") == 2
    assert (tmp_path / "out" / "a b=c.json").read_text() == "one\ntwo é\n" and (tmp_path / "out" / "x%y.json").read_text() == "3\n"
    assert write_files(rows.filter("content = '3'").withColumn("content", F.lit("4")), f"file://{tmp_path}/out") == 1
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["a b=c.json", "x%y.json"] and (tmp_path / "out" / "x%y.json").read_text() == "4\n"
    assert write_files(rows.filter("false"), f"file://{tmp_path}/out") == 0
