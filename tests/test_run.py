"""Whole runs: folders in, files and a report out."""

import json

import pytest

from citeloom import run
from citeloom.operators import evaluate
from citeloom.sources import tables
from citeloom.sources.store import CitationStore


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value), encoding="utf-8")


def pages(*texts):
    return {"pages": [{"page_number": i + 1, "paragraphs": [{"paragraph_id": f"p{i + 1}.1", "text": t}]} for i, t in enumerate(texts)]}


def test_pages_to_references_and_report(spark, tmp_path):
    write(tmp_path / "in" / "a.pages.json", pages("As per section 5 of the Depositories Act, 1996.", "SEBI Circular SEBI/HO/1 dated 5 Mar 2020 applies."))
    write(tmp_path / "in" / "b.pages.json", pages("Nothing."))
    write(tmp_path / "found" / "a.discovered.json", {"references": [{"exact_quote": "Companies Act", "evidence_text": "vide Companies Act", "document_type": "act", "title": "Companies Act", "identifier": None, "year_or_date": "2013", "source_page": 2}]})
    listing = spark.createDataFrame([("act", "Depositories Act, 1996", "https://x/legal/acts/d.html", "01-01-1996", 0), ("circular", "Circular on d", "https://x/legal/circulars/1.html", "05-03-2020", 1)], "kind string, title string, url string, listed_on string, pos int")
    store = CitationStore(spark, f"file://{tmp_path}/store", "t_run", parts=2, buckets=1)
    found = tables.read_discoveries(spark, f"{tmp_path}/found/*.json")
    assert run.extract_folder(spark, f"{tmp_path}/in/*.pages.json", f"file://{tmp_path}/out", found, listing, store, parser="toy") == 2
    got = json.loads((tmp_path / "out" / "a.references.json").read_text(encoding="utf-8"))
    assert [(d["title"], d["resolution_status"], d["resolved_url"]) for d in got["referenced_documents"]] == [
        ("Depositories Act, 1996", "resolved", "https://x/legal/acts/d.html"), (None, "resolved_approx", "https://x/legal/circulars/1.html"), ("Companies Act, 2013", "unresolved", None),
    ]
    assert got["summary"]["reference_mention_count"] == 3 and got["extraction_method"]["llm_used"] is True and got["url_resolution"] == {"resolved": 1, "resolved_approx": 1, "unresolved": 1}
    empty = json.loads((tmp_path / "out" / "b.references.json").read_text(encoding="utf-8"))
    assert empty["referenced_documents"] == [] and empty["summary"]["reference_mention_count"] == 0
    assert store["documents"].count() == 2

    assert run.predict_folder(spark, f"{tmp_path}/in/*.pages.json", f"file://{tmp_path}/predictions") >= 1
    refs = [
        {"canonical_key": "act", "document_type": "act", "canonical_title": "Depositories Act, 1996", "aliases": [], "official_identifier": None, "source_pages": [1], "resolved_url": None},
        {"canonical_key": "c", "document_type": "circular", "canonical_title": "X", "aliases": [], "official_identifier": "SEBI/HO/1", "source_pages": [2], "resolved_url": None},
        {"canonical_key": "m", "document_type": "act", "canonical_title": "Missing Act, 1999", "aliases": [], "official_identifier": None, "source_pages": [9], "resolved_url": None},
    ]
    write(tmp_path / "gold" / "a.json", {"fixture_id": "a", "source_pdf": "a.pdf", "scored_references": refs})
    scored = run.evaluate_folder(spark, f"{tmp_path}/predictions/*.json", f"{tmp_path}/gold/*.json")
    (row,) = scored.collect()
    assert (row.doc_metrics.tp, row.doc_metrics.pred_total, row.doc_metrics.gold_total) == (2, 2, 3) and row.missing_refs == ["m"] and row.title_exact_recall == pytest.approx(1 / 3)
    assert "| a | 80.0% |" in evaluate.report(scored)
