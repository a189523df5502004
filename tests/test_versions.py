"""Stateful ingestion: repeated files, corrections and late old files, in one batch and across batches."""

import json
import os

from citeloom.sources.store import CitationStore
from citeloom.streaming.versions import ingest


def deliver(folder, day, name, text, at):
    path = folder / day
    path.mkdir(parents=True, exist_ok=True)
    file = path / f"{name}.pages.json"
    file.write_text(json.dumps({"pages": [{"page_number": 1, "paragraphs": [{"paragraph_id": "p1.1", "text": text}]}]}))
    os.utime(file, (at, at))


def test_repeated_and_corrected_files(spark, tmp_path):
    folder, store = tmp_path / "in", CitationStore(spark, f"file://{tmp_path}/store", "t_versions", parts=2, buckets=1)

    def run():
        query = ingest(spark, f"{folder}/*", store, f"{tmp_path}/state")
        query.awaitTermination()
        return {(r.doc_key, r.identifier) for r in store["documents"].collect()}

    deliver(folder, "1", "a", "SEBI Circular SEBI/HO/1 applies.", 1_700_000_000)
    deliver(folder, "1", "b", "SEBI Circular SEBI/HO/2 applies.", 1_700_000_000)
    deliver(folder, "1b", "b", "SEBI Circular SEBI/HO/3 applies.", 1_700_000_100)  # corrected within the batch
    assert run() == {("a", "SEBI/HO/1"), ("b", "SEBI/HO/3")} and store["mentions"].count() == 2
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    deliver(folder, "2", "a", "SEBI Circular SEBI/HO/1 applies.", 1_700_000_200)  # again, unchanged
    assert run() == {("a", "SEBI/HO/1"), ("b", "SEBI/HO/3")} and store["mentions"].count() == 2
    assert files == {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}  # nothing was written
    deliver(folder, "3", "a", "SEBI Circular SEBI/HO/7 and SEBI Circular SEBI/HO/8 apply.", 1_700_000_300)  # corrected
    deliver(folder, "3", "c", "nothing", 1_700_000_300)
    assert run() == {("a", "SEBI/HO/7"), ("a", "SEBI/HO/8"), ("b", "SEBI/HO/3")}
    deliver(folder, "4", "a", "SEBI Circular SEBI/HO/99 applies.", 1_600_000_000)  # older than what is stored
    deliver(folder, "4", "b", "none left", 1_700_000_400)
    assert run() == {("a", "SEBI/HO/7"), ("a", "SEBI/HO/8")}
    assert sorted(r.doc_key for r in store["sources"].collect()) == ["a", "b", "c"]
