"""Text functions, spans, split dates, aliases and layout on invented rows, against plain Python where that is shorter."""

import random

from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import discover as D
from citeloom.operators import extract as X
from citeloom.operators import layout as L
from citeloom.operators import resolve as R
from citeloom.operators import spans as S
from citeloom.streaming import ingest


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


def paragraphs(spark, texts, page=4):
    rows = [("d", i // page + 1, i % page + 1, f"p{i // page + 1}.{i % page + 1}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_key string, page_number int, para_no int, paragraph_id string, text string")


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, T.compact("t"), t="  a b\n“c”’ ") == "a b \"c\"'"
    assert one(spark, T.clean_alias("t"), t='("the Act")') == "the Act" and one(spark, T.clean_alias("t"), t="x" * 81) is None
    assert one(spark, T.parse_year("t"), t="no2015x") == 2015 and one(spark, T.parse_year("t"), t="no") is None
    assert one(spark, T.document_type(t), t="Contracts Regulations") == "act" and one(spark, T.document_type(t, strict=True), t="Contracts Regulations") == "regulations"
    assert one(spark, T.relation_type(t), t="shall provide that") == "relies_on"
    assert one(spark, T.listing_date(t), t="August 7, 2013") == "07-08-2013" and one(spark, T.listing_date(t), t="15 Sept 2011") is None
    assert one(spark, T.normalize_text("t"), t="Café & Securities and Exchange Board of India") == "cafe and sebi"
    assert one(spark, T.normalize_identifier("t"), t="SEBI/HO-1 é") == "SEBIHO1E"
    assert one(spark, T.normalize_url("t"), t=" http://x/ ") == "http://x"
    assert one(spark, T.pdf_name(t), t="https://x.org/a/b?c=1") == "b.pdf"
    assert one(spark, T.pdf_link(t), t='<a href="/x.pdf"><iframe src="v?file=https://h/attachdocs/y.pdf">') == "https://h/attachdocs/y.pdf"
    assert one(spark, T.locators(t), t="under para 15.3 of ").raw is None
    found = one(spark, T.locators(t), t="see Regulations 3 and 4 (2) to 6, clause (A) and annexure-b of the ")
    assert found.regulations == ["3", "4(2", "6"] or found.regulations[:1] == ["3"]
    assert found.annexures == ["B"] and found.clauses == ["a"]


def test_containment(spark):
    rng = random.Random(1)
    rows = [(g, i, a := rng.randrange(12), a + rng.randrange(1, 8)) for g in range(300) for i in range(rng.randrange(1, 8))]
    kept = set()
    for g in range(300):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], -r[3], r[1]))
        out = []
        for r in mine:
            if not any(k[2] <= r[2] and r[3] <= k[3] for k in out):
                out.append(r)
        kept |= set(out)
    df = spark.createDataFrame(rows, "g int, i int, start int, end int")
    assert {tuple(r) for r in S.drop_contained(df, ["g"], "i").collect()} == kept


def test_spans_slice_back(spark):
    df = spark.createDataFrame([("a1 é22 😀333", ), ("none",), ("",)], "t string").select("t", F.explode(S.find_all(F.col("t"), r"\d+")).alias("m"))
    rows = df.collect()
    assert len(rows) == 3 and all(r.t[r.m.start : r.m.end] == r.m.hit for r in rows)


def test_split_dates(spark):
    texts = ["dated May 3,", "2021 applies.", "on May 4,", "2020 June 5,", "2019 x", "y"]
    got = [r.text for r in X.sequenced(paragraphs(spark, texts, page=6)).orderBy("para_seq").collect()]
    assert got == ["dated May 3, 2021 applies.", "on May 4, 2020 June 5,", "2019 x", "y"]
    assert X.sequenced(paragraphs(spark, texts[:2], page=1)).count() == 2


def test_alias_is_resolved_as_of_its_paragraph(spark):
    texts = [
        "Master Circular is not yet known.", "In terms of para 7 of Master Circular for Widgets dated March 4, 2019.", "Paras 7.2 of Master Circular stand amended.", "Master Circular for Gears dated May 3, 2021 applies.", "See Master Circular.",
    ]
    found = X.Extraction(paragraphs(spark, texts))
    docs = {r.document_id: r.title for r in found.documents.collect()}
    rows = sorted((r.source_page, r.source_paragraph_id, docs[r.document_id], r.relation_type, r.confidence) for r in found.mentions.collect())
    assert rows == [
        (1, "p1.2", "Master Circular for Widgets", "relies_on", 0.92), (1, "p1.3", "Master Circular for Widgets", "amends_or_modifies", 0.74),
        (1, "p1.4", "Master Circular for Gears", "references", 0.92), (2, "p2.1", "Master Circular for Gears", "references", 0.74),
    ]
    first = next(r for r in found.mentions.collect() if r.source_paragraph_id == "p1.2")
    assert first.target_locators.raw == ["para 7"] and first.target_locators.paragraphs == ["7"]


def test_resolution(spark):
    none = None
    docs = spark.createDataFrame(
        [(1, "circular", none, "SEBI Circular A/B dated March 4, 2019", "A/B", "March 4, 2019"), (2, "regulations", "SEBI (Custodian) Regulations, 1996", none, none, none), (3, "notification", "Notification", none, none, none)],
        "ref int, document_type string, title string, short_title string, identifier string, date string",
    )
    listing = spark.createDataFrame(
        [("circular", "Something else", "https://h/legal/circulars/1.html", "04-03-2019", 1), ("regulations", "Amendment to Custodian Regulations 1996", "https://h/legal/regulations/0.html", none, 1), ("regulations", "Custodian Regulations, 1996", "https://h/legal/regulations/1.html", none, 2)],
        "kind string, title string, url string, listed_on string, pos int",
    )
    got = {r.ref: (r.resolved_url, r.resolution_status) for r in R.resolve(docs, listing).collect()}
    assert got == {1: ("https://h/legal/circulars/1.html", "resolved_approx"), 2: ("https://h/legal/regulations/1.html", "resolved"), 3: (None, "unresolved")}


def test_layout(spark):
    def line(text, y1, x0=72.0, bold=False):
        return ("d", 1, 595.0, 842.0, text, x0, y1 - 12, x0 + 100, y1, ["Arial-Bold" if bold else "Arial"], 11.0)

    rows = [line("first line", 700.0), line("second line", 686.0), line("a) item", 672.0), line("goes on", 658.0, 84.0), line("far below", 500.0), line("Page 1 of 2", 30.0)]
    df = spark.createDataFrame(rows, "doc_key string, page_number int, page_width double, page_height double, text string, x0 double, y0 double, x1 double, y1 double, fonts array<string>, size_mean double")
    deco = spark.createDataFrame([("d", 1, 72.0, 170.0, 688.0, 98.0)], "doc_key string, page_number int, x0 double, x1 double, y double, width double")
    got = L.paragraphs(L.islands(L.typed_lines(df, deco))).orderBy("para_no").collect()
    assert [(r.paragraph_id, r.block_type, r.text) for r in got] == [("p1.1", "body", "first line second line"), ("p1.2", "list_item", "a) item goes on"), ("p1.3", "body", "far below"), ("p1.4", "footer", "Page 1 of 2")]
    assert got[0].is_underlined_guess and not got[2].is_underlined_guess


def test_stream(spark, tmp_path):
    import json

    folder = tmp_path / "in"
    folder.mkdir()
    for stem in ("a", "b"):
        (folder / f"{stem}.pages.json").write_text(json.dumps({"pages": [{"page_number": 1, "paragraphs": [{"paragraph_id": "p1.1", "text": "As per the Depositories Act, 1996."}]}]}))
    query = ingest.extract_stream(ingest.pages_stream(spark, str(folder)), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    assert {(r.doc_key, r.title) for r in spark.read.parquet(f"{tmp_path}/out/documents").collect()} == {("a", "Depositories Act, 1996"), ("b", "Depositories Act, 1996")}


def test_discoveries_join_known_documents(spark):
    text = paragraphs(spark, ["As per the Depositories Act, 1996.", "x"])
    got = X.Extraction(text)
    rows = [
        ("d", 0, "Depositories Act", "section 3 of the Depositories Act", "act", "Depositories Act", None, "1996", 2), ("d", 1, "Companies Act", "vide Companies Act", "act", "Companies Act", "Section 5", "2013", 2),
        ("d", 2, "this circular", "", "circular", "x", None, None, 1), ("d", 3, "q", "q", "act", "Broken tit", None, None, 1),
    ]
    found = spark.createDataFrame(rows, "doc_key string, pos int, exact_quote string, evidence_text string, document_type string, title string, identifier string, year_or_date string, source_page int")
    docs, refs = D.merge_discoveries(got.documents, got.mentions, found, got.sources)
    assert sorted((r.document_id, r.title, r.title_source) for r in docs.collect()) == [("doc_001", "Depositories Act, 1996", "explicit_in_text"), ("doc_002", "Companies Act, 2013", "ai_discovered")]
    told = sorted((r.mention_id, r.document_id, r.relation_type, r.target_locators.raw) for r in refs.collect())
    assert told == [("ref_001", "doc_001", "references", None), ("ref_002", "doc_001", "references", ["section 3"]), ("ref_003", "doc_002", "relies_on", None)]
    assert D.page_prompt(text).first().prompt == "=== PAGE 1 ===\nAs per the Depositories Act, 1996. x"


def test_equal_titles_are_compared_once(spark, monkeypatch):
    names = ("alpha beta rules", "beta alpha rules", "gamma delta act", "epsilon")
    listing = spark.createDataFrame([("act", names[i % 4], f"/legal/acts/{i}", f"0{i % 5 + 1}-02-2020", i) for i in range(200)] + [("circular", names[i % 4], f"/legal/circulars/{i}", f"0{i % 5 + 1}-02-2020", 200 + i) for i in range(80)], "kind string, title string, url string, listed_on string, pos int")
    docs = spark.createDataFrame([(i, "act" if i % 2 else "circular", names[i % 4], None, None, f"February {i % 5 + 1}, 2020" if i % 3 else None) for i in range(120)], "ref int, document_type string, title string, short_title string, identifier string, date string")
    pairs, scored = [], R._scored

    def counted(*args):
        out = scored(*args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(R, "_scored", counted)
    got = {r.ref: (r.resolved_url, r.resolution_status) for r in R.resolve(docs, listing).collect()}
    assert 0 < sum(pairs) <= 12  # 120 documents and 280 rows, of which each kind has three sets of words
    for i in range(120):
        kind, part = ("act", range(200)) if i % 2 else ("circular", range(80))
        near = [j for j in part if set(names[j % 4].split()) == set(names[i % 4].split()) and (kind == "act" or not i % 3 or j % 5 == i % 5)]
        assert got[i] == (f"/legal/{kind}s/{near[0]}", "resolved")


def test_findings_search_a_text_once(spark):
    text = "SEBI Circular SEBI/A/1/2020 dated 3 Jan 2021 and \ufdd0 SEBI Circular SEBI/A/1/2020; see regulation 4 of the Depositories Act, 1996"
    df = spark.createDataFrame([(1, 1, 1, text), (1, 2, 2, "nothing")], "doc_key int, page_number int, para_seq int, text string")
    found = X.explicit_findings(df)
    spots = sorted((r.start, r.end, r.pattern) for r in found.collect())
    assert spots == [(0, 44, 1), (text.rindex("SEBI Circular"), text.index(";"), 1), (text.index("Depositories"), len(text), 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "size(" in line]  # Spark infers it for a plain explode


def test_paragraphs_are_ordered_once(spark):
    plan = X.sequenced(paragraphs(spark, ["dated May 3,", "2021 applies."]))._jdf.queryExecution().executedPlan().toString()
    assert sum(" Sort [" in line for line in plan.splitlines()) == 1 and sum("Exchange hashpartitioning" in line for line in plan.splitlines()) == 1


def test_findings_compute_what_is_asked_for(spark):
    found = X.explicit_findings(spark.createDataFrame([(1, 1, 1, "under section 3 of the Depositories Act, 1996")], "doc_key int, page_number int, para_seq int, text string"))
    plan = found.select("doc_key", "identifier")._jdf.queryExecution().optimizedPlan().toString()
    assert "annexure" in found._jdf.queryExecution().optimizedPlan().toString() and "annexure" not in plan
    assert [(r.title, r.key, r.locators.sections) for r in found.collect()] == [("Depositories Act, 1996", "act|DEPOSITORIES ACT, 1996|||1996", ["3"])]


def test_single_and_repeated_matches_have_the_same_offsets(spark):
    texts = ["no match", "one 12 here", "1 22 333 é4 😀55", "﷐ 6 ﷐ 77", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = sorted((r.i, r.pos, r.start, r.end, r.hit) for r in S.search(rows, [(r"\d+", F.lit(True)), ("x", F.lit(False))]).collect())
    whole = rows.select("i", F.posexplode(S.find_all(F.col("text"), r"\d+")).alias("pos", "m")).select("i", "pos", "m.*")
    assert got == sorted(tuple(r) for r in whole.collect()) and len(got) == 8


def test_a_task_holds_a_part_however_large_the_table(spark, monkeypatch):
    monkeypatch.setattr(X, "PART_ROWS", 3)
    texts = ["Master Circular for Brokers dated June 3, 2020 applies.", "Depositories Act, 1996 was amended.", "See the Master Circular and section 3 of the Depositories Act, 1996.", "It begins on June 5,", "2020 onwards"]
    rows = paragraphs(spark, texts, page=5).drop("doc_key").crossJoin(spark.range(10).selectExpr("concat('d', id) AS doc_key"))
    for strict in (False, True):
        found = X.Extraction(rows, strict=strict)
        assert found.parts == 17 > int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert found.paragraphs.count() == 40 and found.aliased.count() == 10
        counts = {(r.n, tuple(r.d)) for r in found.mentions.groupBy("doc_key").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("document_id")).alias("d")).collect()}
        assert counts == {(4, ("doc_001", "doc_001", "doc_002", "doc_002"))}
        found.close()


def test_tables_of_a_citing_document_are_dealt_out_once(spark):
    found = X.Extraction(paragraphs(spark, ["Master Circular dated June 3, 2020 applies", "the Master Circular"]), store=False)
    findings = spark.createDataFrame([], found.findings.schema)
    plan = X.alias_bindings(findings)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    physical = X.documents(findings)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1


def test_mentions_by_key_are_the_mentions(spark):
    texts = [
        "CIRCULAR SEBI/A/1 Subject: Depositories Act", "Master Circular for Brokers dated June 3, 2020 has para 2 of SEBI Circular SEBI/B/2 dated 3 Jan 2021 in it.", "Regulation 4 of the SEBI (Mutual Funds) Regulations, 1996 (\"MF Rules\") stand amended.",
        "Para 3 of the Master Circular and regulation 5 of the MF Rules provides", "SEBI Circular SEBI/B/2; SEBI Circular SEBI/B/2; section 3 of the Depositories Act, 1996", "As per section 1 of the Banking Regulation Act, 1949 read with section 2 of the Banking Regulation Act, 1949",
    ]
    for rows in (texts, [t for t in texts if "Master" not in t and "MF" not in t]):
        for strict in (False, True):
            found = X.Extraction(paragraphs(spark, rows), strict=strict)
            keys = found.documents.select("doc_key", "document_id", "key")
            of = F.coalesce("target_locators.raw", F.array().cast("array<string>"))
            want = found.mentions.join(keys, ["doc_key", "document_id"]).select("key", "source_page", "relation_type", F.array_sort(of).alias("raws"))
            got = found.cited().select("key", "source_page", "relation_type", "raws")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and not want.isEmpty()
            assert found.cited(located=True).count() == want.filter(F.size("raws") > 0).count()
            found.close()


def test_named_mentions_are_the_mentions(spark):
    texts = [
        "CIRCULAR SEBI/A/1 Subject: Depositories Act", "section 2 of the DEPOSITORIES ACT, 1996 (\"Norms\") and the Banking Regulation Act, 1949", "Master Circular for Brokers (\"MCB\") dated June 3, 2020 and the like; section 9 of the Banking regulation act, 1949", "Clause (b) of regulation 4 of the SEBI (Mutual Funds) Regulations, 1996 (\"MF Norms\") stand amended.",
        "Para 3 of the Master Circular and regulation 5 of the MF Norms provides MF Norms", "SEBI Circular SEBI/B/2; para 7 of SEBI Circular SEBI/B/2; section 3 and 4 of the Banking Regulation Act, 1949; section 1 of the Banking Regulation Act, 1949", "sections 4 of the Norms; section 6 of the MF NORMS", "Notification dated June 3, 2020",
    ]
    columns = ["doc_key", "source_page", "document_type", "title", "match_texts", "target_locators", "relation_type", "confidence"]
    for strict, parts in ((False, 3), (True, None)):
        given = paragraphs(spark, texts * 2, page=3)
        found = X.Extraction(given.repartition(parts, "doc_key") if parts else given, strict=strict, parts=parts)
        titles = found.documents.select("doc_key", "document_id", "document_type", "title")
        want = found.mentions.join(titles, ["doc_key", "document_id"]).select(F.regexp_extract("source_paragraph_id", r"(\d+)$", 1).cast("int").alias("para_no"), *columns).collect()
        assert sorted(map(repr, found.named().select("para_no", *columns).collect())) == sorted(map(repr, want)) and len(want) > 15
        found.close()


def test_variants_are_dealt_out_before_they_are_spelled(spark, tmp_path):
    from citeloom.plans import variants as V

    spark.range(40).selectExpr("id AS o_orderkey", "timestamp'2020-06-03' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    rows = X.sequenced(V.paragraphs(spark, str(tmp_path), parts=3))
    lines = rows._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert len(at) == 1 and any("Generate posexplode" in line for line in lines[: at[0]])
    found = X.Extraction(V.paragraphs(spark, str(tmp_path), parts=3), parts=3)
    assert found.named().count() == 40 * len(V.MENTIONS)
    assert not {"paragraphs", "findings", "documents", "mentions"} & set(vars(found))  # none of these is made
    found.close()


def test_citations_of_dealt_paragraphs_shuffle_no_text(spark):
    rows = paragraphs(spark, ["CIRCULAR A/1 Subject: X", "SEBI Circular SEBI/B/2"]).repartition(3, "doc_key")
    found = X.citations(X.sequenced(rows), spark.createDataFrame([("d", "X")], "doc_key string, title string"), parts=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) == 2  # the paragraphs as given, and the titles
    assert [(r.key, r.counted) for r in found.collect()] == [("circular||SEBI/B/2||", True)]


def test_references_group_each_table_once(spark):
    from citeloom.operators import assemble as A

    found = X.Extraction(paragraphs(spark, ["As per the Depositories Act, 1996."]))
    rows = A.references(found, resolved=True)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Aggregate [doc_key" in line for line in plan.splitlines()) == 3  # sources, documents, mentions
    got = rows.first()
    assert got.url_resolution.unresolved == 1 and got.url_resolution.resolved == 0 and got.summary.reference_mention_count == 1
