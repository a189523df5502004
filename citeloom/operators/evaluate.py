"""Scoring of predicted references against gold labels.

gold: fixture_id, key, document_type, title, aliases, identifier, pages, url.
predictions: fixture_id, idx, key, title, identifier, document_type, pages, url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as T


def gold_rows(gold_files: DataFrame) -> DataFrame:
    rows = gold_files.select("fixture_id", F.explode("scored_references").alias("r"))
    return rows.select(
        "fixture_id", F.col("r.canonical_key").alias("key"), "r.document_type", F.col("r.canonical_title").alias("title"), F.col("r.aliases").alias("aliases"), F.col("r.official_identifier").alias("identifier"),
        F.col("r.source_pages").alias("pages"), F.col("r.resolved_url").alias("url"),
    )


_REFERENCE = (
    "canonical_key string, canonical_title string, title string, official_identifier string, identifier string, document_type string, type string, resolved_url string, url string"
)


def prediction_rows(files: DataFrame) -> DataFrame:
    """References of prediction files; of two spellings of a field the first that is there counts, even if it holds null.

    Pages that are not whole numbers, "3" among them, are left out.
    """
    rows = files.select("fixture_id", F.posexplode("references").alias("idx", "json"))
    rows = rows.select("fixture_id", "idx", "json", F.json_object_keys("json").alias("keys"), F.from_json("json", _REFERENCE).alias("r"))

    def pick(first: str, second: str) -> Column:
        return F.when(F.array_contains("keys", first), F.col(f"r.{first}")).otherwise(F.col(f"r.{second}"))

    pages = F.from_json(F.get_json_object("json", "$.source_pages"), "array<variant>")
    whole = F.transform(F.filter(pages, lambda p: F.schema_of_variant(p) == "BIGINT"), lambda p: F.variant_get(p, "$", "int"))
    return rows.select(
        "fixture_id", "idx", F.col("r.canonical_key").alias("key"), pick("canonical_title", "title").alias("title"), pick("official_identifier", "identifier").alias("identifier"),
        pick("document_type", "type").alias("document_type"), F.coalesce(whole, F.array().cast("array<int>")).alias("pages"), pick("resolved_url", "url").alias("url"),
    )


def as_predictions(extraction, fixtures: DataFrame) -> DataFrame:
    """An extraction's documents as predictions of the fixtures (doc_key, fixture_id) that they belong to.

    Dated notifications without a title of their own are left out, as are
    discovered notifications without any title.
    """
    vague = (F.col("document_type") == "notification") & ((F.col("title_source") == "generic_only") | ((F.col("title_source") == "ai_discovered") & F.coalesce(F.col("title") == "", F.lit(True))))
    pages = extraction.mentions.groupBy("doc_key", "document_id").agg(F.array_sort(F.collect_set("source_page")).alias("pages"))
    rows = extraction.documents.filter(~vague).join(pages, ["doc_key", "document_id"], "left").join(fixtures, "doc_key")
    return rows.select(
        "fixture_id", F.col("document_no").alias("idx"), F.lit(None).cast("string").alias("key"), F.coalesce(F.nullif("title", F.lit("")), "short_title").alias("title"), "identifier", "document_type",
        F.coalesce("pages", F.array().cast("array<int>")).alias("pages"), F.lit(None).cast("string").alias("url"),
    )


def _unique(rows: DataFrame, name: str) -> DataFrame:
    """Values that point to one gold reference only."""
    index = rows.filter(F.col(name) != "").groupBy("fixture_id", name).agg(F.min("key").alias("k"), F.max("key").alias("k2"))
    return index.filter("k = k2").select(F.col("fixture_id").alias(f"_f{name}"), F.col(name).alias(f"_{name}"), F.col("k").alias(f"by_{name}"))


def match(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions with matched (a gold key, or null), by key, else unique identifier, else unique title or alias; and agg, the document they stand for."""
    names = gold.select("fixture_id", "key", F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).select("fixture_id", "key", T.normalize_text("n").alias("t"))
    codes = gold.select("fixture_id", "key", T.normalize_identifier("identifier").alias("i"))
    keys = gold.select(F.col("fixture_id").alias("_f"), F.col("key").alias("by_key")).distinct()
    p = predictions.withColumns({"t": T.normalize_text("title"), "i": T.normalize_identifier("identifier"), "u": T.normalize_url("url")})
    p = p.join(keys, (F.col("fixture_id") == F.col("_f")) & (F.col("key") == F.col("by_key")), "left")
    for rows, name in ((codes, "i"), (names, "t")):
        p = p.join(_unique(rows, name), (F.col("fixture_id") == F.col(f"_f{name}")) & (F.col(name) == F.col(f"_{name}")), "left")
    matched = F.coalesce("by_key", "by_i", "by_t")
    unmatched = F.concat(F.lit("pred:"), F.coalesce(F.nullif("i", F.lit("")), F.nullif("t", F.lit("")), F.concat(F.lit("unmatched_"), F.col("idx").cast("string"))))
    return p.select("fixture_id", "idx", "title", "identifier", "document_type", "pages", "t", "i", "u", matched.alias("matched"), F.coalesce(F.concat(F.lit("gold:"), matched), unmatched).alias("agg"))


def buckets(matched: DataFrame) -> DataFrame:
    """One row per predicted document: sets of pages, titles, types, urls."""
    full = lambda c: F.collect_set(F.nullif(c, F.lit("")))
    pages = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("pages", F.array().cast("array<int>"))))))
    return matched.groupBy("fixture_id", "agg").agg(
        F.first("matched").alias("matched"), pages.alias("pages"), full("t").alias("titles"), full("document_type").alias("types"), full("u").alias("urls"),
        F.min_by(F.struct("title", "identifier"), "idx").alias("sample"),
    )


def _prf(tp: Column, predicted: Column, gold: Column) -> Column:
    precision, recall = T.ratio(tp, predicted), T.ratio(tp, gold)
    return F.struct(tp.alias("tp"), predicted.alias("pred_total"), gold.alias("gold_total"), precision.alias("precision"), recall.alias("recall"), T.f1(precision, recall).alias("f1"))


def evaluate(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """One row per gold fixture with all metrics; a fixture without predictions has none to be right about."""
    bucket = buckets(match(predictions, gold))
    fixtures = gold.select("fixture_id").distinct()
    g = gold.select("fixture_id", "key", "document_type", T.normalize_text("title").alias("t"), F.col("title").isNotNull().alias("titled"), F.array_sort(F.array_distinct("pages")).alias("gold_pages"), T.normalize_url("url").alias("u"))
    mine = bucket.filter("matched IS NOT NULL").select(F.col("fixture_id").alias("f"), F.col("matched").alias("k"), "pages", "titles", "types", "urls")
    both = g.join(mine, (F.col("fixture_id") == F.col("f")) & (F.col("key") == F.col("k")), "left")
    hit = F.col("k").isNotNull()
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    by_gold = both.groupBy("fixture_id").agg(
        F.count(F.lit(1)).alias("gold_docs"), count(hit).alias("docs"), F.sum(F.size("gold_pages")).alias("gold_pages_n"), F.sum(F.when(hit, F.size(F.array_intersect("gold_pages", "pages"))).otherwise(0)).alias("page_tp"),
        count(F.col("titled") & (F.length("t") >= 0)).alias("title_total"), count(hit & (F.col("t") != "") & (F.size("titles") > 0)).alias("title_present"), count(hit & (F.col("t") != "") & F.array_contains("titles", F.col("t"))).alias("title_exact"),
        count(hit & F.array_contains("types", F.col("document_type"))).alias("type_correct"), count(F.col("u") != "").alias("url_gold"), count(hit & (F.col("u") != "") & F.array_contains("urls", F.col("u"))).alias("url_correct"),
        F.array_sort(F.collect_list(F.when(~hit, F.col("key")))).alias("missing_refs"),
        F.array_sort(F.collect_list(F.when(hit & (F.col("gold_pages") != F.col("pages")), F.struct(F.col("key").alias("canonical_key"), "gold_pages", F.col("pages").alias("pred_pages"))))).alias("page_mismatches"),
    )
    by_pred = bucket.groupBy("fixture_id").agg(
        F.count(F.lit(1)).alias("pred_docs"), F.sum(F.size("pages")).alias("pred_pages_n"), count(F.size("urls") > 0).alias("with_url"),
        F.array_sort(F.collect_list(F.when(F.col("matched").isNull(), F.struct(F.col("agg").alias("aggregate_key"), F.col("sample.title").alias("title"), F.col("sample.identifier").alias("identifier"), "pages")))).alias("extra_refs"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = fixtures.join(by_gold, "fixture_id").join(by_pred, "fixture_id", "left")
    return rows.select(
        "fixture_id", _prf(F.col("docs"), zero("pred_docs"), F.col("gold_docs")).alias("doc_metrics"), _prf(F.col("page_tp"), zero("pred_pages_n"), F.col("gold_pages_n")).alias("page_metrics"),
        T.ratio(F.col("title_exact"), F.col("title_total")).alias("title_exact_recall"), T.ratio(F.col("title_present"), F.col("title_total")).alias("title_presence_recall"),
        T.ratio(F.col("type_correct"), F.col("docs")).alias("type_accuracy_on_matched_docs"), T.ratio(zero("with_url"), zero("pred_docs")).alias("url_resolution_rate"),
        T.ratio(F.col("url_correct"), zero("with_url")).alias("resolution_precision"), T.ratio(F.col("url_correct"), F.col("url_gold")).alias("resolution_recall"),
        "missing_refs", F.coalesce("extra_refs", F.array().cast("array<struct<aggregate_key:string,title:string,identifier:string,pages:array<int>>>")).alias("extra_refs"), "page_mismatches",
    )


def macro_average(evaluated: DataFrame) -> DataFrame:
    """Means over fixtures; null metrics are left out of a mean."""
    names = [f"{m}.{x}" for m in ("doc_metrics", "page_metrics") for x in ("precision", "recall", "f1")]
    plain = ["title_exact_recall", "title_presence_recall", "type_accuracy_on_matched_docs", "url_resolution_rate", "resolution_precision", "resolution_recall"]
    return evaluated.agg(*[F.avg(n).alias(n.replace("_metrics.", "_")) for n in names], *[F.avg(n).alias(n) for n in plain])


#: The report's headings.
_HEAD = ("Fixture", "Doc F1", "Page F1", "Title Exact Recall", "Type Acc", "URL Resolution Rate")
_MACRO = (
    ("Doc Precision", "doc_precision"), ("Doc Recall", "doc_recall"), ("Doc F1", "doc_f1"), ("Page Precision", "page_precision"), ("Page Recall", "page_recall"), ("Page F1", "page_f1"),
    ("Title Exact Recall", "title_exact_recall"), ("Title Presence Recall", "title_presence_recall"), ("Type Accuracy on Matched Docs", "type_accuracy_on_matched_docs"), ("URL Resolution Rate", "url_resolution_rate"),
)


def report(evaluated: DataFrame, form: str = "markdown") -> str:
    """The metrics as Markdown tables, by fixture and averaged, or as JSON; meant for the few rows of a gold set."""
    if form == "json":
        rows = evaluated.orderBy("fixture_id").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("j")).collect()
        return "[\n" + ",\n".join(r.j for r in rows) + "\n]"
    share = lambda v: "n/a" if v is None else f"{v * 100:.1f}%"
    row = lambda cells: "| " + " | ".join(cells) + " |"
    out = [row(_HEAD), "|---|" + "---:|" * (len(_HEAD) - 1)]
    for r in evaluated.orderBy("fixture_id").collect():
        out.append(row([r.fixture_id, *map(share, (r.doc_metrics.f1, r.page_metrics.f1, r.title_exact_recall, r.type_accuracy_on_matched_docs, r.url_resolution_rate))]))
    means = macro_average(evaluated).first()
    return "\n".join([*out, "", "## Macro Average", "", row(("Metric", "Value")), "|---|---:|", *[row((name, share(means[column]))) for name, column in _MACRO]])
