"""The queries over the driver tables, one or more for each operator family, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom import sql as SQL
from citeloom.functions import patterns as P
from citeloom.functions import text as T
from citeloom.operators import assemble as A
from citeloom.operators import discover as D
from citeloom.operators import evaluate as E
from citeloom.operators import extract as X
from citeloom.operators import layout as L
from citeloom.operators import resolve as R
from citeloom.operators import spans as S
from citeloom.plans.corpus import CORPUS_SQL, paragraphs
from citeloom.sources.listing_index import ListingIndex
from citeloom.sources.tables import paragraphs_by_page
from citeloom.storage import Kept

FLAGSHIP = "cited_documents"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def keep(make):
        _QUERIES[make.__name__] = make
        if sql:
            _SQL[make.__name__] = sql
        return make

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- corpus and text functions -------------------------------------------------------------

_BLANK = r"[ \t\n\r\f\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(CORPUS_SQL + "SELECT doc_key, seq, page_number, para_no, text FROM corpus")
def templated_corpus(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_key", "seq", "page_number", "para_no", "text")


@query(rf'''SELECT doc_id, trim(regexp_replace(translate(text, '“”’‘', '""' || chr(39) || chr(39)), '{_BLANK}', ' ', 'g'), ' ') AS text FROM documents''')
def compact_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.compact("text").alias("text"))


_MERGED = """, flagged AS (
  SELECT *, lead(text) OVER w AS nxt,
         regexp_matches(text, '(?:January|February|March|April|May|June|July|August|September|October|November|December)\\s+\\d{1,2},$')
           AND coalesce(regexp_matches(lead(text) OVER w, '^\\d{4}\\b'), false) AS starts
  FROM corpus WINDOW w AS (PARTITION BY doc_key, page_number ORDER BY para_no)
), joined AS (
  SELECT doc_key, page_number, para_no, seq, CASE WHEN starts THEN text || ' ' || nxt ELSE text END AS text, coalesce(lag(starts) OVER (PARTITION BY doc_key, page_number ORDER BY para_no), false) AS gone FROM flagged
), merged AS (SELECT doc_key, page_number, para_no, text, row_number() OVER (PARTITION BY doc_key ORDER BY page_number, para_no)::INT AS para_seq FROM joined WHERE NOT gone)
"""


@query(CORPUS_SQL + _MERGED + "SELECT doc_key, page_number, para_no, para_seq, text FROM merged")
def merge_split_dates(spark, sf_dir):
    return X.sequenced(paragraphs(spark, sf_dir)).select("doc_key", "page_number", "para_no", "para_seq", "text")


@query(CORPUS_SQL + r"SELECT doc_key, seq, try_cast(nullif(regexp_extract(text, '(?:19|20)\d{2}'), '') AS INT) AS year FROM corpus")
def parse_year(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_key", "seq", T.parse_year("text").alias("year"))


_LOW = "lower(text)"
_TYPE_SQL = """CASE WHEN contains(lower(text), 'act') THEN 'act' WHEN contains(lower(text), 'master circular') THEN 'master_circular' WHEN contains(lower(text), 'circular') THEN 'circular'
  WHEN regexp_matches(lower(text), '\\bregulations?\\b') THEN 'regulations' WHEN contains(lower(text), 'notification') THEN 'notification' ELSE 'other' END"""


@query(CORPUS_SQL + f"SELECT doc_key, seq, {_TYPE_SQL} AS document_type FROM corpus")
def classify_document_type(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_key", "seq", T.document_type(F.col("text")).alias("document_type"))


_RELATION_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in P.RELATIONS) + " ELSE 'references' END"


@query(CORPUS_SQL + f"SELECT doc_key, seq, {_RELATION_SQL} AS relation_type FROM corpus")
def classify_relation(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_key", "seq", T.relation_type(F.col("text")).alias("relation_type"))


_CONFIDENCE_SQL = f"""CASE WHEN k.alias_only THEN 0.74 WHEN k.kind IN ('act', 'regulations') THEN 0.93 WHEN k.kind = 'master_circular' AND k.date <> '' THEN 0.92
  WHEN k.kind = 'circular' AND k.identifier <> '' THEN 0.91 WHEN k.kind = 'notification' AND k.date <> '' THEN 0.68 ELSE 0.61 END::DOUBLE"""


@query(f"""SELECT o_orderkey, {_CONFIDENCE_SQL} AS confidence, CASE WHEN {_CONFIDENCE_SQL} > 0.9 THEN 'high' ELSE 'medium' END AS confidence_label
FROM (SELECT o_orderkey, o_orderkey % 7 = 0 AS alias_only, ['act', 'regulations', 'master_circular', 'circular', 'notification', 'other'][o_orderkey % 6 + 1] AS kind,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'x' END AS identifier, CASE WHEN o_orderkey % 4 <> 0 THEN 'y' END AS date FROM orders) k""")
def confidence_case(spark, sf_dir):
    key = F.col("o_orderkey")
    kinds = F.array(*[F.lit(x) for x in ("act", "regulations", "master_circular", "circular", "notification", "other")])
    sure = T.confidence(key % 7 == 0, F.element_at(kinds, (key % 6 + 1).cast("int")), F.lit("t"), F.when(key % 5 != 0, "x"), F.when(key % 4 != 0, "y"))
    return read(spark, sf_dir, "orders").select("o_orderkey", sure.alias("s")).select("o_orderkey", "s.confidence", "s.confidence_label")


_DATES = r"(?:(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4}|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\s+\d{4})"


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y') AS long_form, strftime(o_orderdate, '%d-%m-%Y') AS short_form FROM orders""")
def date_normalize(spark, sf_dir):
    day = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", T.listing_date(F.date_format(day, "MMMM d, yyyy")).alias("long_form"), T.listing_date(F.date_format(day, "d MMM yyyy")).alias("short_form")
    )


@query("SELECT doc_id, no, CASE WHEN length(a) BETWEEN 1 AND 80 THEN a END AS alias FROM (SELECT doc_id, no, trim(trim(regexp_replace(translate(line, '“”’‘', '\"\"' || chr(39) || chr(39)), '" + _BLANK + "', ' ', 'g'), ' '), '()[]{}\"'' ') AS a FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS line, generate_subscripts(string_split(text, '. '), 1)::INT AS no FROM documents))")
def clean_alias(spark, sf_dir):
    """Every sentence of every document as an alias."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("n", "line"))
    return rows.select("doc_id", (F.col("n") + 1).alias("no"), T.clean_alias("line").alias("alias"))


# --- pattern extraction --------------------------------------------------------------------

_P1 = rf"(?i)((?:SEBI['’]s\s+)?)Master\s+Circular([^.;:\n]*?)\s+dated\s+({_DATES})([^.;:\n]*)"
_P2 = rf"(?i)SEBI\s+Circular(?:\s+no\.)?\s+([A-Z]+(?:/[A-Z0-9().-]+)+)(?:\s+dated\s+({_DATES}))?"
_P3 = rf"(?i)(?:{'|'.join(P.INSTRUMENTS)})\s*,?\s*((?:19|20)\d{{2}})"
_P4 = rf"(?i)(Gazette\s+notification|notification)\s+dated\s+({_DATES})"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_FINDINGS = f"""{_MERGED}, found AS (
  SELECT doc_key, page_number, para_no, para_seq, text, 0 AS pattern, regexp_extract(text, {_q(_P1)}, 0) AS hit FROM merged UNION ALL
  SELECT doc_key, page_number, para_no, para_seq, text, 1, regexp_extract(text, {_q(_P2)}, 0) FROM merged UNION ALL
  SELECT doc_key, page_number, para_no, para_seq, text, 2, regexp_extract(text, {_q(_P3)}, 0) FROM merged UNION ALL
  SELECT doc_key, page_number, para_no, para_seq, text, 3, regexp_extract(text, {_q(_P4)}, 0) FROM merged
), findings AS (
  SELECT doc_key, page_number, para_no, para_seq, text, pattern, (strpos(text, hit) - 1)::INT AS start, (strpos(text, hit) - 1 + length(hit))::INT AS "end", hit,
    CASE pattern WHEN 0 THEN 'master_circular' WHEN 1 THEN 'circular' WHEN 2 THEN CASE WHEN contains(lower(hit), 'act') THEN 'act' ELSE 'regulations' END ELSE 'notification' END AS document_type,
    CASE pattern WHEN 0 THEN trim('Master Circular ' || trim(regexp_extract(hit, {_q(_P1)}, 2))) WHEN 2 THEN regexp_replace(hit, 'Regulation,', 'Regulations,')
      WHEN 3 THEN CASE WHEN starts_with(lower(hit), 'gazette') THEN 'Gazette Notification' ELSE 'Notification' END END AS title,
    CASE pattern WHEN 1 THEN regexp_extract(hit, {_q(_P2)}, 1) END AS identifier,
    CASE pattern WHEN 0 THEN regexp_extract(hit, {_q(_P1)}, 3) WHEN 1 THEN nullif(regexp_extract(hit, {_q(_P2)}, 2), '') WHEN 3 THEN regexp_extract(hit, {_q(_P4)}, 2) END AS date
  FROM found WHERE hit <> ''
), keyed AS (
  SELECT *, try_cast(nullif(regexp_extract(coalesce(date, identifier, title), '(?:19|20)\\d{{2}}'), '') AS INT) AS year,
    concat_ws('|', document_type, upper(coalesce(title, '')), upper(coalesce(identifier, '')), upper(coalesce(date, '')),
      coalesce(try_cast(nullif(regexp_extract(coalesce(date, identifier, title), '(?:19|20)\\d{{2}}'), '') AS INT)::VARCHAR, '')) AS key
  FROM findings
)
"""


def _found(spark, sf_dir, rank: int) -> DataFrame:
    rows = X.explicit_findings(X.sequenced(paragraphs(spark, sf_dir))).filter(F.col("pattern") == rank)
    return rows.select("doc_key", "para_seq", "start", "end", "document_type", "title", "identifier", "date", "year")


def _found_sql(rank: int) -> str:
    return CORPUS_SQL + _FINDINGS + f'SELECT doc_key, para_seq, start, "end", document_type, title, identifier, date, year FROM keyed WHERE pattern = {rank}'


@query(_found_sql(0))
def extract_master_circulars(spark, sf_dir):
    return _found(spark, sf_dir, 0)


@query(_found_sql(1))
def extract_identified_circulars(spark, sf_dir):
    return _found(spark, sf_dir, 1)


@query(_found_sql(2))
def extract_instruments(spark, sf_dir):
    return _found(spark, sf_dir, 2)


@query(_found_sql(3))
def extract_notifications(spark, sf_dir):
    return _found(spark, sf_dir, 3)


_DOCUMENTS = f"""{_FINDINGS}, docs AS (
  SELECT doc_key, key, min(para_seq * 10 + pattern) AS seen, arg_min(document_type, para_seq * 10 + pattern) AS document_type, arg_min(title, para_seq * 10 + pattern) AS title,
         arg_min(identifier, para_seq * 10 + pattern) AS identifier, arg_min(date, para_seq * 10 + pattern) AS date, arg_min(year, para_seq * 10 + pattern) AS year
  FROM keyed GROUP BY doc_key, key
), numbered AS (SELECT *, 'doc_' || lpad(row_number() OVER (PARTITION BY doc_key ORDER BY seen)::VARCHAR, 3, '0') AS document_id FROM docs)
"""


@query(CORPUS_SQL + _DOCUMENTS + """SELECT n.doc_key, n.document_id, n.document_type, n.title, n.identifier, n.date, n.year, count(*) AS n_findings, list_sort(list_distinct(list(k.page_number))) AS pages
FROM numbered n JOIN keyed k USING (doc_key, key) GROUP BY ALL""")
def cited_documents(spark, sf_dir):
    """Which documents each customer's paragraphs cite, how often in full, and on which pages."""
    found = X.explicit_findings(X.sequenced(paragraphs(spark, sf_dir)))
    docs = X.documents(found, F.count(F.lit(1)).alias("n_findings"), F.array_sort(F.collect_set("page_number")).alias("pages"))
    return docs.select("doc_key", "document_id", "document_type", "title", "identifier", "date", "year", "n_findings", "pages")


_BOUND = f"""{_DOCUMENTS}, since AS (
  SELECT doc_key, key, CASE pattern WHEN 0 THEN 'master circular' ELSE 'mf regulations' END AS alias, min(para_seq * 10 + pattern) AS since FROM keyed
  WHERE pattern = 0 OR (pattern = 2 AND contains(text, '("MF Regulations")')) GROUP BY ALL
), bound AS (
  SELECT k.doc_key, alias, k.para_seq, arg_max(document_id, k.para_seq * 10 + pattern) AS document_id FROM keyed k JOIN since s ON k.doc_key = s.doc_key AND k.key = s.key AND k.para_seq * 10 + pattern >= since
  JOIN numbered n ON n.doc_key = k.doc_key AND n.key = k.key GROUP BY ALL
), bindings AS (SELECT doc_key, alias, document_id, para_seq AS from_seq, coalesce(lead(para_seq) OVER (PARTITION BY doc_key, alias ORDER BY para_seq), 2147483647)::INT AS to_seq FROM bound)
"""
#: No full citation of the corpus lies in another, and an alias stands at most once in a paragraph.
_ALIASED = f"""{_BOUND}, aliased AS (
  SELECT m.doc_key, m.para_seq, (strpos(lower(m.text), alias) - 1)::INT AS start, (strpos(lower(m.text), alias) - 1 + length(alias))::INT AS "end", document_id, substr(m.text, strpos(lower(m.text), alias), length(alias)) AS match_text
  FROM merged m JOIN bindings b ON m.doc_key = b.doc_key AND m.para_seq >= from_seq AND m.para_seq < to_seq AND contains(lower(m.text), alias)
  WHERE NOT EXISTS (SELECT 1 FROM keyed k WHERE k.doc_key = m.doc_key AND k.para_seq = m.para_seq AND strpos(lower(m.text), alias) - 1 < k."end" AND k.start < strpos(lower(m.text), alias) - 1 + length(alias))
)
"""
_LOCATOR_SQL = r"(?i)((?:para(?:s)?|regulation(?:s)?|section(?:s)?|chapter|clause(?:s)?|annexure)[^.;:\n]{0,140})\s+of(?:\s+the)?\s*$"
_SURE_SQL = f"""CASE WHEN alias_only THEN {{alias}} WHEN document_type IN ('act', 'regulations') THEN {{formal}} WHEN document_type = 'master_circular' AND title <> '' AND date <> '' THEN {{master_circular}}
  WHEN document_type = 'circular' AND identifier <> '' THEN {{circular}} WHEN document_type = 'notification' AND date <> '' THEN {{notification}} ELSE {{other}} END"""


def _sure_sql(part: int) -> str:
    quoted = {name: str(values[part]) if part == 0 else f"'{values[part]}'" for name, values in P.CONFIDENCE.items()}
    return _SURE_SQL.format(**quoted)


_MENTIONS = f"""{_ALIASED}, every AS (
  SELECT k.doc_key, k.para_seq, document_id, false AS alias_only, start, "end", CASE pattern WHEN 0 THEN regexp_replace(trim(hit), '(?i)\\s+(?:{'|'.join(P.VERBS)})\\b.*$', '') ELSE hit END AS match_text
  FROM keyed k JOIN numbered n ON n.doc_key = k.doc_key AND n.key = k.key UNION ALL SELECT doc_key, para_seq, document_id, true, start, "end", match_text FROM aliased
), used AS (
  SELECT e.*, m.page_number, m.para_no, m.text, nullif(regexp_extract(left(m.text, start), {_q(_LOCATOR_SQL)}, 1), '') AS raw FROM every e JOIN merged m USING (doc_key, para_seq) WHERE NOT contains(lower(match_text), 'this circular')
), grouped AS (
  SELECT doc_key, para_seq, page_number, para_no, text, document_id, bool_and(alias_only) AS alias_only, list_sort(list_distinct(list(match_text))) AS match_texts, max(raw) AS raw FROM used GROUP BY ALL
), mentioned AS (
  SELECT g.doc_key, 'ref_' || lpad(row_number() OVER (PARTITION BY g.doc_key ORDER BY para_seq, g.document_id)::VARCHAR, 3, '0') AS mention_id, g.document_id, page_number AS source_page, 'p' || page_number || '.' || para_no AS source_paragraph_id,
    match_texts, text AS evidence_text, {_RELATION_SQL} AS relation_type, raw,
    CASE WHEN starts_with(lower(raw), 'para') THEN [regexp_extract(raw, '[0-9]+')] ELSE [] END AS paragraphs, CASE WHEN starts_with(lower(raw), 'regulation') THEN [regexp_extract(raw, '[0-9]+')] || CASE WHEN regexp_extract(raw, '[0-9]+') <> '1' THEN ['1'] ELSE [] END ELSE [] END AS regulations,
    CASE WHEN starts_with(lower(raw), 'section') THEN [regexp_extract(raw, '[0-9]+')] ELSE [] END AS sections, ({_sure_sql(0)})::DOUBLE AS confidence, {_sure_sql(1)} AS confidence_label, {_sure_sql(2)} AS confidence_reason
  FROM grouped g JOIN numbered n ON n.doc_key = g.doc_key AND n.document_id = g.document_id
)
"""


@query(CORPUS_SQL + _BOUND + "SELECT * FROM bindings")
def alias_bindings(spark, sf_dir):
    """Which document an alias means, as of each paragraph."""
    return X.alias_bindings(X.explicit_findings(X.sequenced(paragraphs(spark, sf_dir))))


def _extracted(spark, sf_dir) -> X.Extraction:
    """Texts are searched once; what is found is stored until the driver ends."""
    return X.Extraction(paragraphs(spark, sf_dir))


@query(CORPUS_SQL + _ALIASED + "SELECT * FROM aliased")
def alias_mentions(spark, sf_dir):
    return _extracted(spark, sf_dir).aliased.select("doc_key", "para_seq", "start", "end", "document_id", "match_text")


def _flat(mentions: DataFrame) -> DataFrame:
    """Mentions with the locators that the corpus has as columns; there is one raw locator at most."""
    at = F.col("target_locators")
    return mentions.select(
        "doc_key", "mention_id", "document_id", "source_page", "source_paragraph_id", "match_texts", "evidence_text", "relation_type", at["raw"][0].alias("raw"), at["paragraphs"].alias("paragraphs"), at["regulations"].alias("regulations"),
        at["sections"].alias("sections"), "confidence", "confidence_label", "confidence_reason",
    )


@query(CORPUS_SQL + _MENTIONS + "SELECT * FROM mentioned")
def consolidated_mentions(spark, sf_dir):
    return _flat(_extracted(spark, sf_dir).mentions)


_SUMMARY = """, counted AS (
  SELECT d.doc_key, d.n AS referenced_document_count, coalesce(m.n, 0) AS reference_mention_count, coalesce(pages, []) AS pages_with_references FROM (SELECT doc_key, count(*) AS n FROM numbered GROUP BY doc_key) d
  LEFT JOIN (SELECT doc_key, count(*) AS n, list_sort(list_distinct(list(source_page))) AS pages FROM mentioned GROUP BY doc_key) m USING (doc_key))
"""


@query(CORPUS_SQL + _MENTIONS + _SUMMARY + "SELECT * FROM counted")
def mention_summary(spark, sf_dir):
    return _extracted(spark, sf_dir).summary


@query(CORPUS_SQL + _MENTIONS + _SUMMARY + """SELECT doc_key, schema_version, mode, s.referenced_document_count, s.reference_mention_count, s.pages_with_references, document_ids, mention_ids FROM (
  SELECT DISTINCT doc_key, '1.0.0' AS schema_version, 'deterministic' AS mode FROM corpus) LEFT JOIN (
  SELECT doc_key, list(document_id ORDER BY document_id) AS document_ids FROM numbered GROUP BY doc_key) USING (doc_key) LEFT JOIN (
  SELECT doc_key, list(mention_id || ' ' || document_id ORDER BY mention_id) AS mention_ids FROM mentioned GROUP BY doc_key) USING (doc_key) JOIN counted s USING (doc_key)""")
def assembled_references(spark, sf_dir):
    """The nested result of each citing document, with its lists reduced to ids."""
    rows = A.references(_extracted(spark, sf_dir)).filter("summary.referenced_document_count > 0")
    names = F.transform("reference_mentions", lambda m: F.concat_ws(" ", m["mention_id"], m["document_id"]))
    return rows.select("doc_key", "schema_version", "extraction_method.mode", "summary.*", F.transform("referenced_documents", lambda d: d["document_id"]).alias("document_ids"), F.when(F.size(names) > 0, names).alias("mention_ids"))


@query(CORPUS_SQL + _MENTIONS + "SELECT * FROM mentioned")
def assembled_mentions(spark, sf_dir):
    """Every mention inside the nested results, in all its fields."""
    rows = A.references(_extracted(spark, sf_dir)).select("doc_key", F.explode("reference_mentions").alias("m"))
    return _flat(rows.select("doc_key", "m.*"))


@query(CORPUS_SQL + _DOCUMENTS + """, named AS (
  SELECT doc_key, key, list_sort(list_distinct(flatten(list(CASE WHEN pattern = 0 THEN ['Master Circular'] WHEN contains(text, hit || ' ("MF Regulations")') THEN ['MF Regulations'] ELSE []::VARCHAR[] END)))) AS aliases FROM keyed GROUP BY ALL)
SELECT n.doc_key, document_id, document_type, title, CASE document_type WHEN 'master_circular' THEN 'Master Circular' WHEN 'circular' THEN 'SEBI Circular ' || identifier || coalesce(' dated ' || date, '') WHEN 'notification' THEN title END AS short_title,
  identifier, date, year, CASE WHEN document_type = 'act' THEN NULL ELSE 'SEBI' END AS issuing_body, aliases,
  CASE document_type WHEN 'circular' THEN 'not_present_in_text' WHEN 'notification' THEN 'generic_only' ELSE 'explicit_in_text' END AS title_source, 'unresolved' AS resolution_status FROM numbered n JOIN named USING (doc_key, key)""")
def assembled_documents(spark, sf_dir):
    """Every cited document inside the nested results, in all its fields."""
    rows = A.references(_extracted(spark, sf_dir)).select("doc_key", F.explode("referenced_documents").alias("d"))
    return rows.select("doc_key", "d.*").drop("resolved_url")


@query(CORPUS_SQL + f"""SELECT doc_key, max(page_number) AS page_count, nullif(regexp_extract(string_agg(text, ' ' ORDER BY para_no) FILTER (page_number = 1), '(?i){_DATES}'), '') AS issue_date
FROM corpus GROUP BY doc_key""")
def source_metadata(spark, sf_dir):
    return X.source_metadata(paragraphs(spark, sf_dir)).select("doc_key", "page_count", "issue_date")


@query(CORPUS_SQL + _FINDINGS + r"""SELECT doc_key, para_seq, pattern, nullif(raw, '') AS raw, list_filter([regexp_extract(raw, '(?i)\bsection(?:s)?\s+([0-9]+)', 1)], lambda x: x <> '') AS sections
FROM (SELECT *, regexp_extract(left(text, start), '(?i)((?:para(?:s)?|regulation(?:s)?|section(?:s)?|chapter|clause(?:s)?|annexure)[^.;:\n]{0,140})\s+of(?:\s+the)?\s*$', 1) AS raw FROM keyed)""")
def locator_tokens(spark, sf_dir):
    rows = X.explicit_findings(X.sequenced(paragraphs(spark, sf_dir)))
    return rows.select("doc_key", "para_seq", "pattern", "locators.raw", "locators.sections")


@query("""SELECT o_orderkey, 'chapter ' || k || ', annexure-' || chr((65 + n)::INT) || ' and clause (' || chr((97 + n)::INT) || ')' AS raw, [k] AS chapters, [chr((65 + n)::INT)] AS annexures, [chr((97 + n)::INT)] AS clauses
FROM (SELECT o_orderkey, (o_orderkey % 40 + 1)::VARCHAR AS k, o_orderkey % 26 AS n FROM orders)""")
def locators_by_kind(spark, sf_dir):
    """What stands before a citation, told apart by kind."""
    key, letter = F.col("o_orderkey"), lambda start: F.char((F.col("o_orderkey") % 26 + start).cast("int"))
    before = F.concat(F.lit("as under chapter "), (key % 40 + 1).cast("string"), F.lit(", annexure-"), letter(65), F.lit(" and clause ("), letter(97), F.lit(") of the "))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", T.locators(before).alias("l"))
    return rows.select("o_orderkey", "l.raw", "l.chapters", "l.annexures", "l.clauses")


@query(CORPUS_SQL + _FINDINGS + 'SELECT doc_key, para_seq, pattern, start, "end", document_type, title, identifier, date, year, key FROM keyed')
def sql_findings(spark, sf_dir):
    """Citations by SQL text: the table function joined to the paragraphs."""
    SQL.register_functions(spark)
    X.sequenced(paragraphs(spark, sf_dir)).createOrReplaceTempView("sql_findings_paragraphs")
    return spark.sql("SELECT p.doc_key, p.para_seq, c.pattern, c.start, c.`end`, c.document_type, c.title, c.identifier, c.date, c.year, c.key FROM sql_findings_paragraphs p, LATERAL citations(p.text) c")


@query(CORPUS_SQL + _MENTIONS + """SELECT n.document_type, m.relation_type, count(*) AS mentions, count(DISTINCT m.doc_key) AS documents, avg(year)::DOUBLE AS mean_year
FROM mentioned m JOIN numbered n ON n.doc_key = m.doc_key AND n.document_id = m.document_id GROUP BY ALL""")
def sql_mentions(spark, sf_dir):
    """Mentions by kind and relation, from the extraction's views."""
    SQL.register_views(_extracted(spark, sf_dir), "sql_")
    return spark.sql("""SELECT d.document_type, m.relation_type, count(*) AS mentions, count(DISTINCT m.doc_key) AS documents, avg(d.year) AS mean_year
      FROM sql_reference_mentions m JOIN sql_referenced_documents d USING (doc_key, document_id) GROUP BY ALL""")


# --- spans ---------------------------------------------------------------------------------

_SPANS_SQL = 'WITH s AS (SELECT DISTINCT l_orderkey AS g, (l_partkey % 50)::INT AS start, (l_partkey % 50 + l_quantity)::INT AS "end" FROM lineitem)'


def _spans(spark, sf_dir) -> DataFrame:
    start = (F.col("l_partkey") % 50).cast("int")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), start.alias("start"), (start + F.col("l_quantity")).cast("int").alias("end")).distinct()


@query(_SPANS_SQL + ' SELECT g, start, "end" FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.g = b.g AND b.start <= a.start AND b."end" >= a."end" AND (b.start < a.start OR b."end" > a."end"))')
def span_containment_dedupe(spark, sf_dir):
    return S.drop_contained(_spans(spark, sf_dir), ["g"])


@query(_SPANS_SQL + ' SELECT g, start, "end" FROM s a WHERE start % 2 = 1 AND NOT EXISTS (SELECT 1 FROM s b WHERE a.g = b.g AND b.start % 2 = 0 AND a.start < b."end" AND b.start < a."end")')
def span_overlap_antijoin(spark, sf_dir):
    rows = _spans(spark, sf_dir)
    taken = rows.filter("start % 2 = 0").groupBy("g").agg(F.collect_list(F.struct("start", "end")).alias("taken"))
    return rows.filter("start % 2 = 1").join(taken, "g", "left").filter(S.overlaps_none(F.col("start"), F.col("end"), F.col("taken"))).select("g", "start", "end")


# --- sources -------------------------------------------------------------------------------


@query("SELECT page_id, CASE WHEN ends_with(lower(n), '.pdf') THEN n ELSE n || '.pdf' END AS name FROM (SELECT page_id, string_split(rtrim(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/'), '/')[-1] AS n FROM pages)")
def url_filename(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.pdf_name(F.col("url")).alias("name"))


@query("SELECT page_id, string_split(rtrim(url, '/') || ' x+y', '/')[-1] || '.pdf' AS name FROM pages")
def decoded_filename(spark, sf_dir):
    """Names of attachments whose urls hold escapes."""
    rows = read(spark, sf_dir, "pages")
    return rows.select("page_id", T.safe_name(F.concat(F.rtrim("url", F.lit("/")), F.lit("%20x%2By/"))).alias("name"))


_HOLDING_SQL = """SELECT page_id, url, regexp_replace(html, 'href="(/[^"]*)"', 'href="\\1.pdf"', 'g') || CASE page_id % 3 WHEN 0 THEN '<iframe src="v?file=https://h.example/attachdocs/' || page_id || '.pdf">' WHEN 1 THEN '<a href="/AttachDocs/' || page_id || '.PDF">' ELSE '' END AS html FROM pages"""


def _holding(spark, sf_dir) -> DataFrame:
    """Pages whose links name PDF files: most a path of the site, some a preferred folder, some a viewer's parameter."""
    key = F.col("page_id").cast("string")
    more = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<iframe src="v?file=https://h.example/attachdocs/'), key, F.lit('.pdf">'))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('<a href="/AttachDocs/'), key, F.lit('.PDF">')))
    html = F.concat(F.regexp_replace("html", 'href="(/[^"]*)"', 'href="$1.pdf"'), F.coalesce(more, F.lit("")))
    return read(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))


@query(f"""SELECT page_id, CASE WHEN starts_with(l, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || l ELSE l END AS link FROM (
  SELECT page_id, url, coalesce(list_filter(c, lambda x: contains(lower(x), 'attachdocs'))[1], c[1]) AS l FROM (SELECT page_id, url, list_concat(regexp_extract_all(html, '(?i)[?&]file=([^"''&>\\s]+?\\.pdf)', 1),
  regexp_extract_all(html, '(?i)(?:href|src)=["'']([^"'']*?\\.pdf)["'']', 1)) AS c FROM ({_HOLDING_SQL})))""")
def html_link_candidates(spark, sf_dir):
    """The document that each page holds, as a url of its own."""
    return _holding(spark, sf_dir).select("page_id", T.absolute_url(F.col("url"), T.pdf_link(F.col("html"))).alias("link"))


@query(f"""SELECT page_id, nullif(regexp_extract(html, '(?i)file=(https://h[.]example/[^''"<>]+\\.pdf)', 1), '') AS link FROM ({_HOLDING_SQL})""")
def strict_html_link(spark, sf_dir):
    return _holding(spark, sf_dir).select("page_id", T.strict_pdf_link(F.col("html"), "h.example").alias("link"))


@query("SELECT kind, url, pos FROM (SELECT p_type AS kind, p_name AS url, p_partkey AS pos, row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def listing_dedupe(spark, sf_dir):
    return R.distinct_listing(read(spark, sf_dir, "part").select(F.col("p_type").alias("kind"), F.col("p_name").alias("url"), F.col("p_partkey").alias("pos")))


@query(f"""SELECT source AS doc_key, count(*) AS pages, count(*) FILTER (t <> '') AS text_pages, sum(length(t))::BIGINT AS total_chars,
  count(*) FILTER (t <> '') > 0 AND sum(length(t)) > 200 AS extractable, coalesce(list(left(t, 400) ORDER BY doc_id) FILTER (t <> ''), [])[1:2] AS samples FROM (SELECT doc_id, source, regexp_replace(text, '^{_BLANK}|{_BLANK}$', '', 'g') AS t FROM documents) GROUP BY source""")
def text_layer_profile(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_key"), F.col("doc_id").alias("page_number"), "text")
    return L.text_profile(rows)


# --- resolution ----------------------------------------------------------------------------

_KINDS = ("act", "regulations", "master_circular", "circular")


#: Kinds of cited documents: four that are looked for, one that is not.
_CITED_KINDS = (*_KINDS, "notification")


def _listing(spark, sf_dir) -> DataFrame:
    """Parts as a listing: kind, title, url, day, order. Up to three of a kind share a day; some are amendments, some stand in another section."""
    key = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (key % 4 + 1).cast("int"))
    section = F.element_at(F.array(*[F.lit(r[1]) for r in R.RULES]), (key % 4 + 1).cast("int"))
    elsewhere = (key % 252 >= 84) & (key % 84 % 3 == 0)
    day = F.concat_ws("-", F.lpad((key % 28 + 1).cast("string"), 2, "0"), F.lpad((key % 12 + 1).cast("string"), 2, "0"), (1980 + F.floor(key / 252) % 20).cast("string"))
    title = F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower(F.regexp_replace("p_brand", "#", " brand")))
    return read(spark, sf_dir, "part").select(
        kind.alias("kind"), F.when(key % 11 == 5, F.concat(F.lit("Amendment to "), title)).otherwise(title).alias("title"),
        F.concat(F.when(elsewhere, "/legal/other/").otherwise(section), key.cast("string"), F.lit(".html")).alias("url"), day.alias("listed_on"), key.alias("pos"),
    )


def _cited(spark, sf_dir) -> DataFrame:
    """Suppliers joined to part names as cited documents; half with the day of their part, an eighth with a day on which nothing is listed."""
    s, p = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "part")
    key = F.col("s_suppkey")
    rows = s.join(p, key == F.col("p_partkey"))
    kind = F.when(key % 9 == 0, "notification").otherwise(F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (key % 4 + 1).cast("int")))
    month = F.element_at(F.array(*[F.lit(m) for m in P.MONTHS]), (key % 12 + 1).cast("int"))
    date = F.concat(month, F.lit(" "), (key % 28 + 1).cast("string"), F.lit(", "), F.when(key % 16 >= 14, F.lit(1901)).otherwise(1980 + F.floor(key / 252) % 20).cast("string"))
    none = F.lit(None).cast("string")
    code = F.concat(F.lit("CIR/"), key.cast("string"))
    circular = F.col("document_type") == "circular"
    rows = rows.select(key.alias("ref"), kind.alias("document_type"), F.concat_ws(" ", "p_name", F.lit("the"), F.lower("p_type")).alias("name"), F.when(key % 8 >= 4, date).alias("date"), code.alias("code"))
    return rows.select("ref", "document_type", F.when(~circular | (F.col("ref") % 16 < 8), F.col("name")).alias("title"), F.when(circular, F.concat(F.lit("Circular "), "name")).alias("short_title"), F.when(circular, F.col("code")).otherwise(none).alias("identifier"), "date")


_KIND_SQL = "['act', 'regulations', 'master_circular', 'circular'][{0} % 4 + 1]"
_WORDS_SQL = "list_distinct(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), ' '), lambda x: length(x) > 1 AND x NOT IN (" + ", ".join(f"'{w}'" for w in P.STOP_WORDS) + ")))"
_TITLE_SQL = "p_name || ' ' || lower(p_type) || ' ' || lower(replace(p_brand, '#', ' brand'))"
_MONTHS_SQL = "[" + ", ".join(f"'{m}'" for m in P.MONTHS) + "]"
_TOP_SQL = f"""WITH listing AS (
  SELECT {_KIND_SQL.format('p_partkey')} AS kind, p_partkey AS pos, ['/legal/acts/', '/legal/regulations/', '/legal/master-circulars/', '/legal/circulars/'][p_partkey % 4 + 1] || p_partkey || '.html' AS url, p_partkey % 11 = 5 AS amends,
         printf('%02d-%02d-%d', p_partkey % 28 + 1, p_partkey % 12 + 1, 1980 + (p_partkey // 252) % 20) AS listed_on, {_WORDS_SQL.format(_TITLE_SQL)} AS w FROM part WHERE NOT (p_partkey % 252 >= 84 AND p_partkey % 84 % 3 = 0)
), refs AS (
  SELECT s_suppkey AS ref, CASE WHEN s_suppkey % 9 = 0 THEN 'notification' ELSE {_KIND_SQL.format('s_suppkey')} END AS kind, CASE WHEN s_suppkey % 9 <> 0 AND s_suppkey % 4 = 3 AND s_suppkey % 16 >= 8 THEN {_WORDS_SQL.format("'Circular ' || p_name || ' the ' || lower(p_type)")} ELSE {_WORDS_SQL.format("p_name || ' the ' || lower(p_type)")} END AS t,
    CASE WHEN s_suppkey % 8 >= 4 THEN printf('%02d-%02d-%d', s_suppkey % 28 + 1, s_suppkey % 12 + 1, CASE WHEN s_suppkey % 16 >= 14 THEN 1901 ELSE 1980 + (s_suppkey // 252) % 20 END) END AS day
  FROM supplier JOIN part ON s_suppkey = p_partkey
), scored AS (
  SELECT ref, kind, url, pos, day = listed_on AS same_day, len(list_intersect(w, t))::DOUBLE / (len(w) + len(t) - len(list_intersect(w, t))) AS score FROM refs JOIN listing USING (kind) WHERE NOT amends
), top AS (SELECT ref, url, score FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY score DESC, pos) AS n FROM scored WHERE score > 0) WHERE n = 1)
"""


@query(_TOP_SQL + "SELECT ref, url, score FROM top")
def title_jaccard_top1(spark, sf_dir):
    """The listed title nearest to each cited one, from the stored index of the listing."""
    kept = Kept(spark)
    index = ListingIndex(spark, f"{kept.path}/listing", f"listing_{uuid.uuid4().hex}", parts=2, buckets=4)
    index.refresh(_listing(spark, sf_dir))
    return index.nearest(_cited(spark, sf_dir), kept)


_RESOLVED_SQL = _TOP_SQL + """, today AS (SELECT ref, url, score FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY score DESC, pos) AS n FROM scored WHERE score > 0 AND same_day) WHERE n = 1
), days AS (SELECT kind, listed_on AS day, count(*) AS on_day, min(url) AS only_url FROM listing GROUP BY ALL
), picked AS (
  SELECT r.ref, r.kind, on_day, only_url, d.url AS day_url, d.score AS day_score, CASE WHEN r.kind IN ('act', 'regulations') THEN 0.35 ELSE 0.30 END AS least, CASE WHEN r.kind IN ('act', 'regulations') THEN 0.55 ELSE 0.50 END AS sure,
    CASE WHEN r.kind = 'notification' THEN NULL WHEN (r.kind = 'master_circular' AND on_day > 0) OR (r.kind = 'circular' AND r.day IS NOT NULL) THEN d.url ELSE a.url END AS url,
    CASE WHEN r.kind = 'notification' THEN NULL WHEN (r.kind = 'master_circular' AND on_day > 0) OR (r.kind = 'circular' AND r.day IS NOT NULL) THEN d.score ELSE a.score END AS score
  FROM refs r LEFT JOIN top a USING (ref) LEFT JOIN today d USING (ref) LEFT JOIN days ON days.kind = r.kind AND days.day = r.day
), resolved AS (
  SELECT ref, CASE WHEN kind = 'circular' AND on_day = 1 THEN only_url WHEN score >= least THEN url WHEN kind = 'circular' AND on_day > 1 AND day_score >= 0.20 THEN day_url END AS resolved_url,
    CASE WHEN kind = 'circular' AND on_day = 1 THEN 'resolved_approx' WHEN score >= sure THEN 'resolved' WHEN score >= least THEN 'resolved_approx' WHEN kind = 'circular' AND on_day > 1 AND day_score >= 0.20 THEN 'resolved_approx' ELSE 'unresolved' END AS resolution_status FROM picked)
"""


@query(_RESOLVED_SQL + "SELECT * FROM resolved")
def resolve_status(spark, sf_dir):
    return R.resolve(_cited(spark, sf_dir), _listing(spark, sf_dir)).select("ref", "resolved_url", "resolution_status")


_COUNTS_SQL = "count(*) FILTER (resolution_status = 'resolved') AS resolved, count(*) FILTER (resolution_status = 'resolved_approx') AS resolved_approx, count(*) FILTER (resolution_status = 'unresolved') AS unresolved"


@query(_RESOLVED_SQL + f"SELECT {_COUNTS_SQL} FROM resolved")
def resolution_counts(spark, sf_dir):
    return R.status_counts(R.resolve(_cited(spark, sf_dir), _listing(spark, sf_dir)))


def _half_resolved(spark, sf_dir) -> DataFrame:
    """Cited documents of which every fifth has its url from an earlier run."""
    known = F.col("ref") % 5 == 0
    return _cited(spark, sf_dir).withColumns({"resolved_url": F.when(known, "https://known"), "resolution_status": F.when(known, "resolved").otherwise("unresolved")})


@query(_RESOLVED_SQL + "SELECT ref, CASE WHEN ref % 5 = 0 THEN 'https://known' ELSE resolved_url END AS resolved_url, CASE WHEN ref % 5 = 0 THEN 'resolved' ELSE resolution_status END AS resolution_status FROM resolved")
def resolve_open(spark, sf_dir):
    return R.resolve_open(_half_resolved(spark, sf_dir), _listing(spark, sf_dir))[0].select("ref", "resolved_url", "resolution_status")


@query(_RESOLVED_SQL + f"SELECT {_COUNTS_SQL} FROM resolved WHERE ref % 5 <> 0")
def resolve_open_counts(spark, sf_dir):
    return R.resolve_open(_half_resolved(spark, sf_dir), _listing(spark, sf_dir))[1]


@query("SELECT p_partkey, trim(regexp_extract('SEBI (' || p_name || ') Regulations, 1996', '\\(([^)]+)\\)', 1)) AS regulations, trim(p_name || ' Act') AS act, array_to_string(list_filter(string_split(p_name || ' ' || p_type, ' '), lambda x: x <> '' AND lower(x) NOT IN (" + ", ".join(f"'{w}'" for w in P.STOP_WORDS) + "))[1:5], ' ') AS master_circular FROM part")
def search_keywords(spark, sf_dir):
    none = F.lit(None).cast("string")
    made = lambda kind, title: T.search_keywords(F.lit(kind), title, none, none)
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select(
        "p_partkey", made("regulations", F.concat(F.lit("SEBI ("), name, F.lit(") Regulations, 1996"))).alias("regulations"), made("act", F.concat(name, F.lit(" Act, 1992"))).alias("act"),
        made("master_circular", F.concat(F.lit("Master Circular for "), name, F.lit(" "), F.col("p_type"))).alias("master_circular"),
    )


_CLEANED_SQL = """WITH f AS (
  SELECT o_orderkey AS ref, ['as per this circular', 'the Act says', 'see there'][o_orderkey % 3 + 1] AS exact_quote, strftime(o_orderdate, '%Y') AS year_or_date, ['act', 'regulations'][o_orderkey % 2 + 1] AS document_type,
    ['Depositories Act', 'SEBI (Mutual Funds) Regulations', 'Companies Act, 2013', NULL, 'Broken tit'][o_orderkey % 5 + 1] AS t, ['Section 11', NULL, 'LAD/1', 'Regulation 5'][o_orderkey % 4 + 1] AS code FROM orders
), n AS (
  SELECT *, code IS NOT NULL AND regexp_matches(lower(code), '^(?:section|regulation|article|clause|para)\\b') AS locator, CASE WHEN t <> '' AND NOT contains(t, year_or_date) THEN t || ', ' || year_or_date ELSE t END AS title FROM f)
"""


@query(_CLEANED_SQL + """SELECT ref, exact_quote, year_or_date, document_type, title, CASE WHEN NOT coalesce(locator, false) THEN code END AS identifier, NULL::VARCHAR AS date, year_or_date::INT AS year, CASE WHEN starts_with(upper(title), 'SEBI') THEN 'SEBI' END AS issuing_body
FROM n WHERE NOT contains(exact_quote, 'this circular') AND NOT (locator AND title IS NULL) AND NOT coalesce(document_type = 'act' AND NOT regexp_matches(lower(title), '\\bact\\b'), false) AND NOT coalesce(document_type = 'regulations' AND NOT regexp_matches(lower(title), '\\bregulations?\\b'), false)""")
def discovery_cleanup(spark, sf_dir):
    """Orders as discovered references: some self-references, locators as identifiers, titles that lack their kind."""
    k = F.col("o_orderkey")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    found = read(spark, sf_dir, "orders").select(
        k.alias("ref"), pick(3, "as per this circular", "the Act says", "see there").alias("exact_quote"), pick(2, "act", "regulations").alias("document_type"),
        pick(5, "Depositories Act", "SEBI (Mutual Funds) Regulations", "Companies Act, 2013", None, "Broken tit").alias("title"), pick(4, "Section 11", None, "LAD/1", "Regulation 5").alias("identifier"), F.date_format("o_orderdate", "yyyy").alias("year_or_date"),
    )
    return R.clean_discoveries(found, F.lit(""))


# --- layout --------------------------------------------------------------------------------


def _lines(spark, sf_dir) -> DataFrame:
    """Orders as lines of text on pages of 12, one document for each customer."""
    k, n = F.col("o_orderkey"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = read(spark, sf_dir, "orders").withColumn("n", n).withColumn("k", k)
    words = F.array(*[F.lit(x) for x in ("the members shall report", "1. Scope of this paper", "Sub: Report on custody", "ANNEXURE", "page text goes on here:", "(a) first item", "Page 1 of 9", "continued text of a line")])
    line = F.col("n") % 12
    y1 = 780.0 - line * 60 + F.when(F.col("k") % 3 == 0, 46.0).otherwise(0.0)
    x0 = 72.0 + (F.col("k") % 4) * 18.0 + F.when(F.col("k") % 8 == 3, 160.0).otherwise(0.0)
    return rows.select(
        F.col("o_custkey").alias("doc_key"), (F.floor(F.col("n") / 12) + 1).cast("int").alias("page_number"), F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"), F.element_at(words, (F.col("k") % 8 + 1).cast("int")).alias("text"),
        x0.alias("x0"), (y1 - 12.0).alias("y0"), (x0 + 120.0).alias("x1"), y1.alias("y1"), F.array(F.when(F.col("k") % 5 == 0, "Arial-Bold").otherwise("Arial")).alias("fonts"), F.lit(11.0).alias("size_mean"), "k",
    )


def _decorations(spark, sf_dir) -> DataFrame:
    rows = _lines(spark, sf_dir).filter("k % 6 = 0")
    return rows.select("doc_key", "page_number", (F.col("x0") + 5).alias("x0"), (F.col("x0") + 65).alias("x1"), (F.col("y0") + F.col("k") % 7 - 3).cast("double").alias("y"), F.lit(60.0).alias("width"))


@query("""SELECT l_orderkey AS doc_key, (l_linenumber % 3)::INT AS line_key, list_sort(list_distinct(list(f))) AS fonts, list_sort(list_distinct(list(l_quantity::DOUBLE))) AS sizes, round_even(avg(l_quantity::DOUBLE), 2) AS size_mean,
  round_even(avg(contains(lower(f), 'bold')::INT), 3) AS bold_ratio, count(*)::INT AS char_count FROM (SELECT *, l_returnflag || l_linestatus || CASE WHEN l_partkey % 2 = 0 THEN '-Bold' ELSE '' END AS f FROM lineitem) GROUP BY ALL""")
def line_fonts(spark, sf_dir):
    """Order lines as characters: fonts, sizes and the bold share of each line."""
    font = F.concat("l_returnflag", "l_linestatus", F.when(F.col("l_partkey") % 2 == 0, "-Bold").otherwise(""))
    chars = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_key"), F.lit(1).alias("page_number"), (F.col("l_linenumber") % 3).cast("int").alias("line_key"), font.alias("font"), F.col("l_quantity").cast("double").alias("size"))
    return L.line_fonts(chars).drop("page_number")


_LINES_SQL = """WITH base AS (
  SELECT o_custkey AS doc_key, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders
), lines AS (
  SELECT doc_key, (n // 12 + 1)::INT AS page_number, k,
    ['the members shall report', '1. Scope of this paper', 'Sub: Report on custody', 'ANNEXURE', 'page text goes on here:', '(a) first item', 'Page 1 of 9', 'continued text of a line'][k % 8 + 1] AS text,
    72.0::DOUBLE + (k % 4) * 18 + CASE WHEN k % 8 = 3 THEN 160 ELSE 0 END AS x0, 780.0::DOUBLE - (n % 12) * 60 + CASE WHEN k % 3 = 0 THEN 46 ELSE 0 END AS y1, k % 5 = 0 AS is_bold
  FROM base
), decorations AS (SELECT doc_key, page_number, x0 + 5 AS dx0, x0 + 65 AS dx1, y1 - 12 + k % 7 - 3 AS y, 60.0 AS width FROM lines WHERE k % 6 = 0
), typed AS (
  SELECT l.*, y1 - 12 AS y0, x0 + 120 AS x1, abs((x0 + x0 + 120) / 2 - 297.5) <= 20 AS centred,
    EXISTS (SELECT 1 FROM decorations d WHERE d.doc_key = l.doc_key AND d.page_number = l.page_number AND width >= least(20, 120 * 0.4) AND least(x0 + 120, dx1) > greatest(x0, dx0) AND y - (y1 - 12) BETWEEN -3.0 AND 3.5) AS under
  FROM lines l
), kinds AS (
  SELECT *, CASE WHEN centred THEN 'center' WHEN x1 >= 515 AND x0 > 297.5 THEN 'right' ELSE 'left' END AS alignment,
    CASE WHEN y0 < 45 THEN 'footer' WHEN y1 > 797 THEN 'header' WHEN starts_with(text, 'Page ') AND contains(text, ' of ') THEN 'header' WHEN centred AND (is_bold OR upper(text) = text) THEN 'heading'
      WHEN starts_with(lower(text), 'sub:') THEN 'heading' WHEN regexp_matches(text, '^(\\(?[0-9]+(?:\\.[0-9]+)*[.)]?|[A-Za-z][.)]|[ivxlcdmIVXLCDM]+[.)])\\s+') THEN 'list_item' WHEN is_bold AND length(text) <= 120 THEN 'heading' ELSE 'body' END AS block_type
  FROM typed
), numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_key, page_number ORDER BY y1 DESC, x0, text) AS line_no FROM kinds)
"""


@query(_LINES_SQL + "SELECT doc_key, page_number, k, alignment, block_type, under AS is_underlined_guess FROM numbered")
def line_types(spark, sf_dir):
    """Alignment, block type and underline (a range semi-join) of each line."""
    return L.typed_lines(_lines(spark, sf_dir), _decorations(spark, sf_dir)).select("doc_key", "page_number", "k", "alignment", "block_type", "is_underlined_guess")


@query(_LINES_SQL + """, margins AS (SELECT doc_key, page_number, coalesce(min(round(x0, 1)) FILTER (alignment <> 'center' AND block_type NOT IN ('header', 'footer')), min(x0)) AS m FROM numbered GROUP BY ALL)
SELECT doc_key, page_number, coalesce(list_sort(list_distinct(list(round(x0 - m, 1)) FILTER (block_type NOT IN ('header', 'footer'))))[1:12], []) AS indent_steps FROM numbered JOIN margins USING (doc_key, page_number) GROUP BY ALL""")
def indent_steps(spark, sf_dir):
    return L.indent_steps(L.typed_lines(_lines(spark, sf_dir), _decorations(spark, sf_dir)))


_ISLANDS_SQL = _LINES_SQL + """, prev AS (
  SELECT *, lag(block_type) OVER w AS pb, lag(x0) OVER w AS px, lag(y0) OVER w AS py, lag(text) OVER w AS pt, lag(under) OVER w AS pu,
    regexp_matches(text, '^(\\(?[0-9]+(?:\\.[0-9]+)*[.)]?|[A-Za-z][.)]|[ivxlcdmIVXLCDM]+[.)])\\s+') AS listed FROM numbered WINDOW w AS (PARTITION BY doc_key, page_number ORDER BY line_no)
), broken AS (
  SELECT *, CASE WHEN pb IS NULL THEN 1 WHEN pb IN ('header', 'footer') OR block_type IN ('header', 'footer') THEN 1
    WHEN block_type = 'heading' THEN CASE WHEN pb = 'heading' AND abs(px - x0) <= 6 AND py - y1 <= greatest(24.0, 6.05 * 4) AND (regexp_matches(text, '^[a-z]') OR starts_with(lower(pt), 'sub:') OR pu OR under) THEN 0 ELSE 1 END
    WHEN pb = 'heading' THEN 1 WHEN block_type = 'list_item' THEN 1 WHEN py - y1 > 9.9 THEN 1
    WHEN pb = 'list_item' THEN CASE WHEN (x0 >= px + 10 OR abs(px - x0) <= 6) AND NOT listed THEN 0 ELSE 1 END
    WHEN abs(px - x0) >= 18 AND x0 <= px THEN 1 WHEN ends_with(pt, ':') AND listed THEN 1 ELSE 0 END AS b FROM prev
), island AS (SELECT *, sum(b) OVER (PARTITION BY doc_key, page_number ORDER BY line_no ROWS UNBOUNDED PRECEDING)::INT AS para_no FROM broken)
"""


@query(_ISLANDS_SQL + "SELECT doc_key, page_number, k, para_no FROM island")
def paragraph_islands(spark, sf_dir):
    return L.islands(L.typed_lines(_lines(spark, sf_dir), _decorations(spark, sf_dir))).select("doc_key", "page_number", "k", "para_no")


@query(_ISLANDS_SQL + """SELECT doc_key, page_number, para_no, string_agg(text, ' ' ORDER BY line_no) AS text, min(x0) AS "left", min(y0) AS bottom, max(x1) AS "right", max(y1) AS top, bool_and(is_bold) AS is_bold, bool_or(under) AS is_underlined_guess, count(*) AS n_lines,
  CASE WHEN arg_min(block_type, line_no) IN ('heading', 'list_item', 'header', 'footer') THEN arg_min(block_type, line_no) ELSE (list(block_type ORDER BY c DESC, first_no))[1] END AS block_type, greatest(0, round((min(x0) - min(m)) / 18))::INT AS indent_level
FROM (SELECT *, count(*) OVER (PARTITION BY doc_key, page_number, para_no, block_type) AS c, min(line_no) OVER (PARTITION BY doc_key, page_number, para_no, block_type) AS first_no FROM island
  JOIN (SELECT doc_key, page_number, coalesce(min(round(x0, 1)) FILTER (alignment <> 'center' AND block_type NOT IN ('header', 'footer')), min(x0)) AS m FROM numbered GROUP BY ALL) USING (doc_key, page_number)) GROUP BY ALL""")
def paragraph_aggregate(spark, sf_dir):
    rows = L.paragraphs(L.islands(L.typed_lines(_lines(spark, sf_dir), _decorations(spark, sf_dir))))
    return rows.select("doc_key", "page_number", "para_no", "text", "left", "bottom", "right", "top", "is_bold", "is_underlined_guess", "n_lines", "block_type", "indent_level")


@query(_ISLANDS_SQL + """SELECT doc_key, list(page ORDER BY page_number) AS pages FROM (SELECT doc_key, page_number, page_number || ': ' || count(DISTINCT para_no) || ' paragraphs, ' || count(*) || ' lines' AS page FROM island GROUP BY doc_key, page_number) GROUP BY doc_key""")
def structured_pages(spark, sf_dir):
    """The nested layout of each document, with its pages told by their counts."""
    rows = L.structured(L.islands(L.typed_lines(_lines(spark, sf_dir), _decorations(spark, sf_dir))))
    told = lambda p: F.format_string("%d: %d paragraphs, %d lines", p["page_number"], F.size(p["paragraphs"]), F.size(p["lines"]))
    return rows.select("doc_key", F.transform("pages", told).alias("pages"))


@query(CORPUS_SQL + "SELECT doc_key, list(page ORDER BY page_number) AS pages FROM (SELECT doc_key, page_number, page_number || ': ' || string_agg(text, '|' ORDER BY para_no) AS page FROM corpus GROUP BY doc_key, page_number) GROUP BY doc_key")
def slim_pages(spark, sf_dir):
    """Pages and paragraphs nested, as page files hold them."""
    told = lambda p: F.concat(p["page_number"].cast("string"), F.lit(": "), F.array_join(F.transform(p["paragraphs"], lambda q: q["text"]), "|"))
    return paragraphs_by_page(paragraphs(spark, sf_dir)).select("doc_key", F.transform("pages", told).alias("pages"))


# --- evaluation ----------------------------------------------------------------------------


def _gold(spark, sf_dir) -> DataFrame:
    """Customers as gold references of their nation's fixture, found on one page each."""
    none = F.lit(None).cast("string")
    rows = read(spark, sf_dir, "customer")
    return rows.select(
        F.col("c_nationkey").cast("string").alias("fixture_id"), F.col("c_name").alias("key"), F.lower("c_mktsegment").alias("document_type"), F.concat(F.lit("Title "), "c_name").alias("title"), F.array("c_name").alias("aliases"),
        F.concat(F.lit("CIR/"), F.col("c_custkey").cast("string")).alias("identifier"), F.array((F.col("c_custkey") % 5).cast("int")).alias("pages"), none.alias("url"),
    )


def _predicted(spark, sf_dir) -> DataFrame:
    """Orders as predictions about their customer: a third by identifier, a third by alias, a third by an unknown title."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("string").alias("fixture_id"), k.cast("int").alias("idx"), none.alias("key"), F.when(k % 3 == 1, F.upper("c_name")).when(k % 3 == 2, F.concat(F.lit("Other "), "c_name")).alias("title"),
        F.when(k % 3 == 0, F.concat(F.lit("cir "), F.col("c_custkey").cast("string"))).alias("identifier"), F.when(k % 2 == 0, F.lower("c_mktsegment")).alias("document_type"), F.array((k % 5).cast("int")).alias("pages"), none.alias("url"),
    )


_MATCH_SQL = """WITH p AS (
  SELECT c_nationkey::VARCHAR AS fixture_id, c_name, c_custkey, o_orderkey AS k, CASE WHEN o_orderkey % 3 < 2 THEN c_name END AS matched, (o_orderkey % 5)::INT AS page,
         CASE WHEN o_orderkey % 2 = 0 THEN lower(c_mktsegment) END AS kind FROM orders JOIN customer ON o_custkey = c_custkey
), a AS (SELECT *, CASE WHEN matched IS NOT NULL THEN 'gold:' || matched ELSE 'pred:' || 'other ' || lower(replace(c_name, '#', ' ')) END AS agg FROM p
), g AS (SELECT c_nationkey::VARCHAR AS fixture_id, c_name AS key, (c_custkey % 5)::INT AS page, lower(c_mktsegment) AS kind FROM customer
), d AS (SELECT g.fixture_id, count(*) AS gold_total, (SELECT count(DISTINCT matched) FROM a WHERE a.fixture_id = g.fixture_id) AS tp, (SELECT count(DISTINCT agg) FROM a WHERE a.fixture_id = g.fixture_id) AS pred_total,
  (SELECT count(*) FROM (SELECT DISTINCT agg, page FROM a WHERE a.fixture_id = g.fixture_id)) AS page_pred, count(*) FILTER (EXISTS (SELECT 1 FROM a WHERE a.matched = g.key AND a.page = g.page)) AS page_tp,
  count(*) FILTER (EXISTS (SELECT 1 FROM a WHERE a.matched = g.key AND a.kind = g.kind)) AS type_correct, list_sort(list(g.key) FILTER (NOT EXISTS (SELECT 1 FROM a WHERE a.matched = g.key))) AS missing FROM g GROUP BY g.fixture_id)
"""


@query(_MATCH_SQL + "SELECT fixture_id, k AS idx, matched, agg FROM a")
def gold_index_unique_match(spark, sf_dir):
    return E.match(_predicted(spark, sf_dir), _gold(spark, sf_dir)).select("fixture_id", F.col("idx").cast("bigint").alias("idx"), "matched", "agg")


def _evaluated(spark, sf_dir) -> DataFrame:
    return E.evaluate(_predicted(spark, sf_dir), _gold(spark, sf_dir))


_PRF_SQL = """SELECT fixture_id, {0} AS tp, {1} AS pred_total, gold_total, {0} / nullif({1}, 0) AS "precision", {0} / gold_total AS recall,
  CASE WHEN {1} > 0 THEN CASE WHEN {0} = 0 THEN 0.0 ELSE 2.0 * {0} / ({1} + gold_total) END END AS f1 FROM d"""


@query(_MATCH_SQL + _PRF_SQL.format("tp", "pred_total"))
def doc_prf(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("fixture_id", "doc_metrics.*")


@query(_MATCH_SQL + _PRF_SQL.format("page_tp", "page_pred"))
def page_prf(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("fixture_id", "page_metrics.*")


@query(_MATCH_SQL + """, t AS (
  SELECT g.fixture_id, g.key, bool_or(a.matched IS NOT NULL AND k % 3 = 1) AS told FROM g JOIN a ON a.matched = g.key GROUP BY ALL
) SELECT d.fixture_id, 0::DOUBLE AS title_exact_recall, (SELECT count(*) FROM t WHERE t.fixture_id = d.fixture_id AND told) / gold_total AS title_presence_recall FROM d""")
def title_metrics(spark, sf_dir):
    """Gold titles and predicted ones differ in form here ("Title Customer#1", "CUSTOMER#1"), so titles are there and never exact."""
    return _evaluated(spark, sf_dir).select("fixture_id", "title_exact_recall", "title_presence_recall")


@query(_MATCH_SQL + """SELECT d.fixture_id, (SELECT count(*) FROM customer c WHERE c_nationkey::VARCHAR = d.fixture_id AND c_custkey % 2 = 0 AND EXISTS (SELECT 1 FROM a WHERE a.matched = c.c_name AND k % 3 = 1)) / gold_total AS title_exact_recall FROM d""")
def exact_titles(spark, sf_dir):
    """Half of the gold titles are what some predictions say, but for their case."""
    gold = _gold(spark, sf_dir).withColumn("title", F.when(F.regexp_extract("identifier", r"(\d+)$", 1).cast("bigint") % 2 == 0, F.col("key")).otherwise(F.col("title")))
    return E.evaluate(_predicted(spark, sf_dir), gold).select("fixture_id", "title_exact_recall")


@query(_MATCH_SQL + """SELECT fixture_id, agg AS aggregate_key, 'Other ' || min(c_name) AS title, list_sort(list_distinct(list(page))) AS pages FROM a WHERE matched IS NULL GROUP BY ALL""")
def extra_references(spark, sf_dir):
    """Predicted documents that no gold reference stands for."""
    rows = _evaluated(spark, sf_dir).select("fixture_id", F.explode("extra_refs").alias("r"))
    return rows.select("fixture_id", "r.aggregate_key", "r.title", "r.pages")


@query(_MATCH_SQL + """, m AS (SELECT fixture_id, matched, list_sort(list_distinct(list(page))) AS pred_pages FROM a WHERE matched IS NOT NULL GROUP BY ALL)
SELECT g.fixture_id, key AS canonical_key, [page] AS gold_pages, pred_pages FROM g JOIN m ON m.matched = g.key WHERE pred_pages <> [page]""")
def page_mismatches(spark, sf_dir):
    rows = _evaluated(spark, sf_dir).select("fixture_id", F.explode("page_mismatches").alias("r"))
    return rows.select("fixture_id", "r.*")


def _linked(spark, sf_dir) -> DataFrame:
    """Gold references and predictions with urls, of which some agree."""
    link = lambda host, key: F.concat(F.lit(f"https://{host}/"), key.cast("string"))
    number = F.regexp_extract("identifier", r"(\d+)$", 1).cast("bigint")
    gold = _gold(spark, sf_dir).withColumn("url", F.when(number % 2 == 0, link("h", number)))
    found = _predicted(spark, sf_dir).withColumn("url", F.when(number % 3 == 0, F.concat(link("h", number), F.lit("/"))).when(number % 3 == 1, link("other", number)))
    return E.evaluate(found, gold)


@query(_MATCH_SQL + """, u AS (
  SELECT fixture_id, agg, min(c_custkey) AS c, bool_or(k % 3 = 0 AND c_custkey % 3 < 2 AND matched IS NOT NULL) AS linked, bool_or(k % 3 = 0 AND c_custkey % 6 = 0) AS right_ FROM a GROUP BY ALL
) SELECT d.fixture_id, (SELECT count(*) FILTER (linked) FROM u WHERE u.fixture_id = d.fixture_id) / nullif(pred_total, 0) AS url_resolution_rate,
  (SELECT count(*) FILTER (right_) / nullif(count(*) FILTER (linked), 0) FROM u WHERE u.fixture_id = d.fixture_id) AS resolution_precision,
  (SELECT count(*) FILTER (right_) FROM u WHERE u.fixture_id = d.fixture_id) / nullif((SELECT count(*) FROM customer WHERE c_nationkey::VARCHAR = d.fixture_id AND c_custkey % 2 = 0), 0) AS resolution_recall FROM d""")
def url_metrics(spark, sf_dir):
    return _linked(spark, sf_dir).select("fixture_id", "url_resolution_rate", "resolution_precision", "resolution_recall")


@query(_MATCH_SQL + "SELECT fixture_id, type_correct / nullif(tp, 0) AS type_accuracy FROM d")
def type_metrics(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("fixture_id", F.col("type_accuracy_on_matched_docs").alias("type_accuracy"))


@query(_MATCH_SQL + "SELECT fixture_id, coalesce(missing, []) AS missing_refs FROM d")
def missing_references(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("fixture_id", "missing_refs")


@query(_MATCH_SQL + """SELECT avg(tp / nullif(pred_total, 0)) AS doc_precision, avg(tp / gold_total) AS doc_recall, avg(CASE WHEN pred_total > 0 THEN 2.0 * tp / (pred_total + gold_total) END) AS doc_f1, avg(page_tp / nullif(page_pred, 0)) AS page_precision,
  avg(page_tp / gold_total) AS page_recall, avg(CASE WHEN page_pred > 0 THEN 2.0 * page_tp / (page_pred + gold_total) END) AS page_f1, avg(type_correct / nullif(tp, 0)) AS type_accuracy_on_matched_docs FROM d""")
def macro_average(spark, sf_dir):
    rows = E.macro_average(_evaluated(spark, sf_dir))
    return rows.select("doc_precision", "doc_recall", "doc_f1", "page_precision", "page_recall", "page_f1", "type_accuracy_on_matched_docs")


# --- discovery, listings, cross-document counts --------------------------------------------


@query(CORPUS_SQL + """, page AS (SELECT doc_key, page_number, '=== PAGE ' || page_number || ' ===' || chr(10) || string_agg(text, ' ' ORDER BY para_no) AS t FROM corpus GROUP BY doc_key, page_number)
SELECT doc_key, string_agg(t, chr(10) ORDER BY page_number) AS prompt FROM page GROUP BY doc_key""")
def page_prompt(spark, sf_dir):
    return D.page_prompt(paragraphs(spark, sf_dir))


@query("SELECT p_partkey, 'https://x/' || p_partkey || '.html' AS url, p_name AS title, 0 AS pos FROM part UNION ALL SELECT p_partkey, 'https://y/' || p_partkey || '.html', p_type, 1 FROM part")
def listing_rows(spark, sf_dir):
    link = lambda host, text: F.concat(F.lit(f"<li><a href='https://{host}/"), F.col("p_partkey").cast("string"), F.lit(".html'  class='p' title=\""), F.col(text), F.lit("\">x</a>"))
    html = F.concat(link("x", "p_name"), F.lit("<a href='http://z/a.html' title=\"no\">"), link("y", "p_type"))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.explode(D.listing_rows(html)).alias("r"))
    return rows.select("p_partkey", "r.url", "r.title", "r.pos")


@query(CORPUS_SQL + _FINDINGS + "SELECT key, count(DISTINCT doc_key) AS citing_documents, count(*) AS citations FROM keyed GROUP BY key")
def citation_counts(spark, sf_dir):
    """Which documents are cited by how many others, over the whole archive."""
    return D.citation_counts(X.explicit_findings(X.sequenced(paragraphs(spark, sf_dir))))


@query(CORPUS_SQL + _MENTIONS + """SELECT 'customer_' || n.doc_key AS fixture_id, (row_number() OVER (PARTITION BY n.doc_key ORDER BY seen) - 1)::INT AS idx,
  CASE WHEN document_type = 'circular' THEN 'SEBI Circular ' || identifier || coalesce(' dated ' || date, '') ELSE title END AS canonical_title, identifier AS official_identifier, document_type, coalesce(p.pages, []) AS source_pages
FROM numbered n LEFT JOIN (SELECT doc_key, document_id, list_sort(list_distinct(list(source_page))) AS pages FROM mentioned GROUP BY ALL) p USING (doc_key, document_id) WHERE document_type <> 'notification'""")
def predictions(spark, sf_dir):
    """Every customer's citations as predictions of a fixture of its own, in the nested form of prediction files, listed again."""
    text = paragraphs(spark, sf_dir)
    fixtures = text.select("doc_key", F.concat(F.lit("customer_"), F.col("doc_key").cast("string")).alias("fixture_id")).distinct()
    nested = D.predictions_by_fixture(E.as_predictions(X.Extraction(text), fixtures))
    rows = nested.select("fixture_id", F.posexplode("references").alias("idx", "r"))
    return rows.select("fixture_id", "idx", "r.canonical_title", "r.official_identifier", "r.document_type", "r.source_pages")


@query(CORPUS_SQL + _MENTIONS + f""", seconds AS (
  SELECT c.doc_key, 'ref_' || lpad((coalesce(m.n, 0) + 1)::VARCHAR, 3, '0') AS mention_id, 'doc_' || lpad((coalesce(d.n, 0) + 1)::VARCHAR, 3, '0') AS document_id, page_number AS source_page, NULL::VARCHAR AS source_paragraph_id, ['Companies Act, 2013'] AS match_texts,
    'section 5 of the Companies Act, 2013; ' || text AS evidence_text, {_RELATION_SQL} AS relation_type, 'section 5' AS raw, []::VARCHAR[] AS paragraphs, []::VARCHAR[] AS regulations, ['5'] AS sections,
    {P.DISCOVERED[0]}::DOUBLE AS confidence, '{P.DISCOVERED[1]}' AS confidence_label, '{P.DISCOVERED[2]}' AS confidence_reason
  FROM corpus c LEFT JOIN (SELECT doc_key, count(*) AS n FROM mentioned GROUP BY doc_key) m USING (doc_key) LEFT JOIN (SELECT doc_key, count(*) AS n FROM numbered GROUP BY doc_key) d USING (doc_key) WHERE seq = 1
) SELECT * FROM mentioned UNION ALL SELECT * FROM seconds""")
def discovered_mentions(spark, sf_dir):
    """The corpus's mentions with one discovered reference for each customer added."""
    text = paragraphs(spark, sf_dir)
    got = X.Extraction(text)
    first = text.filter("seq = 1")
    found = first.select(
        "doc_key", F.lit(0).alias("pos"), F.lit("Companies Act, 2013").alias("exact_quote"), F.concat(F.lit("section 5 of the Companies Act, 2013; "), "text").alias("evidence_text"), F.lit("act").alias("document_type"),
        F.lit("Companies Act").alias("title"), F.lit(None).cast("string").alias("identifier"), F.lit("2013").alias("year_or_date"), F.col("page_number").alias("source_page"),
    )
    return _flat(D.merge_discoveries(got.documents, got.mentions, found, got.sources)[1])
