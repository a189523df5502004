"""Column functions over citation text; all stay inside the JVM, but for ``ascii_form``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from citeloom.functions import patterns as P
from citeloom.operators.spans import bound


def text(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def compact(value: str | Column) -> Column:
    """Straight quotes, runs of white space as one space, trimmed. Most texts are like that: one look tells."""
    straight = F.translate(text(value), "“”’‘", "\"\"''")
    return F.when(text(value).rlike(P.PLAIN), text(value)).otherwise(F.btrim(F.regexp_replace(straight, r"(?U)[\s\x1c-\x1f]+", " "), F.lit(" ")))


def strip(value: Column, marks: str) -> Column:
    return F.btrim(value, F.lit(marks))


def tidy_title(value: str | Column) -> Column:
    """Compact, without blanks and marks at the ends; null for null or empty input."""
    return F.when(text(value) != "", strip(compact(value), " .,:;"))


def clean_alias(value: str | Column) -> Column:
    """Without brackets and quotes at the ends; null if nothing or more than 80 characters are left."""
    bare = strip(compact(value), "()[]{}\"' ")
    return F.when((bare != "") & (F.length(bare) <= 80), bare)


def extract(value: Column, pattern: str, group: int = 0) -> Column:
    """First match's group; null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def parse_year(value: str | Column) -> Column:
    return extract(text(value), r"(?:19|20)\d{2}").try_cast("int")


def has(value: Column, words) -> Column:
    """Whether any of the words occurs, as a substring."""
    found = F.lit(False)
    for word in words:
        found = found | value.contains(word)
    return found


def document_type(name: Column, strict: bool = False) -> Column:
    """First kind whose word occurs in the name. As a substring "act" also hits Contracts; ``strict`` asks for the word."""
    low = F.lower(name)
    act = low.rlike(r"\bact\b") if strict else low.contains("act")
    return (
        F.when(act, "act").when(low.contains("master circular"), "master_circular").when(low.contains("circular"), "circular")
        .when(low.rlike(r"\bregulations?\b"), "regulations").when(low.contains("notification"), "notification").otherwise("other")
    )


def relation_type(paragraph: Column, strict: bool = False) -> Column:
    """First relation of whose words one occurs. As substrings they also hit other words ("vide " in "provide that"); ``strict`` asks for whole words."""
    low, out = F.lower(paragraph), F.lit("references")
    for name, words in reversed(P.RELATIONS):
        said = low.rlike(r"\b(?:" + "|".join(w.strip() for w in words) + r")\b") if strict else has(low, words)
        out = F.when(said, name).otherwise(out)
    return out


def confidence(alias_only: Column, kind: Column, title: Column, identifier: Column, date: Column) -> Column:
    """Struct (confidence, confidence_label, confidence_reason)."""

    def row(name: str) -> Column:
        value, label, reason = P.CONFIDENCE[name]
        return F.struct(F.lit(value).alias("confidence"), F.lit(label).alias("confidence_label"), F.lit(reason).alias("confidence_reason"))

    full = lambda c: F.coalesce(c != "", F.lit(False))
    return (
        F.when(alias_only, row("alias")).when(kind.isin("act", "regulations"), row("formal"))
        .when((kind == "master_circular") & full(title) & full(date), row("master_circular"))
        .when((kind == "circular") & full(identifier), row("circular"))
        .when((kind == "notification") & full(date), row("notification")).otherwise(row("other"))
    )


def document_key(kind: Column, title: Column, identifier: Column, date: Column, year: Column) -> Column:
    """The key of a cited document; its title is tidy."""
    part = lambda c: F.upper(F.coalesce(c, F.lit("")))
    return F.concat_ws("|", kind, part(title), part(identifier), part(date), F.coalesce(year.cast("string"), F.lit("")))


def master_circular_title(prefix: Column, body: Column, trailer: Column) -> Column:
    """A title from compact parts: what stands before and after "Master Circular", and its subject behind the date."""
    named = F.btrim(F.regexp_replace(body, r'\s*\("?[A-Za-z]{2,10}"?\)\s*$', ""), F.lit(" "))
    whole = F.when(body != "", F.btrim(F.concat(F.lit("Master Circular "), named), F.lit(" "))).when((prefix != "") & trailer.isNotNull(), F.concat(F.lit("Master Circular for "), trailer))
    return F.coalesce(whole, F.lit("Master Circular"))


def plural_regulations(name: Column) -> Column:
    return F.regexp_replace(name, r"\bRegulation\b(?=\s*,\s*(?:19|20)\d{2})", "Regulations")


# --- locators --------------------------------------------------------------------------


def _distinct(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda v: v != ""))


def locator_tokens(raw: Column) -> Column:
    """Numbers, dotted or bracketed, and Roman or letter items, in order, each once."""
    joined = F.regexp_replace(raw, r"(\d+)\s+\(([A-Za-z0-9]+)\)", "$1($2)")
    found = F.regexp_extract_all(F.replace(joined, F.lit(" to "), F.lit(" ")), F.lit(f"(?i){P.TOKEN}"), F.lit(0))
    return _distinct(F.transform(found, lambda t: strip(t, " ,.;:()")))


def locators(before: Column, strict: bool = False) -> Column:
    """What of the cited document is meant, from the text before the citation: struct of raw and six lists. ``strict`` takes dotted numbers as well."""
    return bound(locator_text(before, strict), lambda said: bound(F.coalesce(compact(said), F.lit("")), located))


def locator_text(before: Column, strict: bool = False) -> Column:
    """The words of a locator that a text ends with; null for none. Texts that do not end in "of" or "of the" are not searched."""
    return F.when(before.rlike(P.LOCATOR_END), extract(before, P.STRICT_LOCATOR if strict else P.LOCATOR, 1))


def located(raw: Column) -> Column:
    """The struct of ``locators`` for the compact words of a locator, empty for none."""
    lists = [F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(raw, F.lit(p), F.lit(1)), locator_tokens))).alias(name) for name, p in P.ITEMS.items()]
    annexures = F.transform(F.regexp_extract_all(raw, F.lit(P.ANNEXURE), F.lit(1)), F.upper)
    clause = F.regexp_extract(raw, P.CLAUSE, 1)
    clauses = _distinct(F.transform(F.regexp_extract_all(clause, F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda t: F.lower(F.trim(t))))
    none = F.array().cast("array<string>")
    nothing = F.struct(F.lit(None).cast("string").alias("raw"), *[none.alias(name) for name in (*P.ITEMS, "annexures", "clauses")])
    return F.when(raw == "", nothing).otherwise(F.struct(F.nullif(raw, F.lit("")).alias("raw"), *lists, annexures.alias("annexures"), clauses.alias("clauses")))


# --- titles, dates, urls ----------------------------------------------------------------


def title_tokens(title: Column) -> Column:
    """Distinct words of a title that carry meaning: no stop words, no single characters."""
    words = F.split(F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*P.STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def is_amendment(title: Column) -> Column:
    return F.lower(title).rlike("^(?:" + "|".join(P.AMENDMENTS) + ")")


def listing_date(value: Column) -> Column:
    """A citation's date as dd-MM-yyyy; null for layouts and months that the listing does not know."""
    long = F.regexp_extract(F.trim(value), r"^(\w+)\s+(\d{1,2}),\s*(\d{4})", 1), F.regexp_extract(F.trim(value), r"^(\w+)\s+(\d{1,2}),\s*(\d{4})", 2), F.regexp_extract(F.trim(value), r"^(\w+)\s+(\d{1,2}),\s*(\d{4})", 3)
    short = F.regexp_extract(F.trim(value), r"^(\d{1,2})\s+(\w+)\s+(\d{4})", 2), F.regexp_extract(F.trim(value), r"^(\d{1,2})\s+(\w+)\s+(\d{4})", 1), F.regexp_extract(F.trim(value), r"^(\d{1,2})\s+(\w+)\s+(\d{4})", 3)

    def told(month: Column, day: Column, year: Column) -> Column:
        number = F.lit(None).cast("string")
        for i, name in enumerate(P.MONTHS, 1):
            number = F.when(F.lower(month).isin(name.lower(), name[:3].lower()), f"{i:02d}").otherwise(number)
        return F.when(number.isNotNull(), F.concat_ws("-", F.lpad(day, 2, "0"), number, year))

    return F.coalesce(told(*long), told(*short))


def search_keywords(kind: Column, title: Column, short_title: Column, identifier: Column) -> Column:
    """What a listing is searched for, by kind of document."""
    name = F.coalesce(F.nullif(title, F.lit("")), short_title, F.lit(""))
    bracket = F.trim(extract(name, r"\(([^)]+)\)", 1))
    plain = F.trim(F.regexp_replace(name, r"(?i)\b(SEBI|regulations?|securities|exchange|board|india)\b", ""))
    core = F.coalesce(extract(name, r"(?i)^(?:SEBI'?s?\s+)?Master\s+Circular\s+(?:for\s+)?(.+)", 1), name)
    words = F.array_join(F.slice(F.filter(F.split(core, r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(*P.STOP_WORDS)), 1, 5), " ")
    return (
        F.when(kind == "regulations", F.coalesce(bracket, plain)).when(kind == "master_circular", words)
        .when(kind == "act", F.trim(F.regexp_replace(name, r",\s*(19|20)\d{2}.*", ""))).when(kind == "circular", F.coalesce(identifier, F.lit(""))).otherwise(name)
    )


def pdf_name(url: Column) -> Column:
    """Last part of the url's path, with .pdf at its end."""
    path = F.rtrim(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), F.lit("/"))
    return _with_pdf(F.element_at(F.split(path, "/"), -1))


def safe_name(url: Column) -> Column:
    """Last part of the whole url once its escapes are undone, with .pdf at its end; escapes that are not valid stay."""
    plain = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    return _with_pdf(F.element_at(F.split(F.rtrim(plain, F.lit("/")), "/"), -1))


def _with_pdf(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def pdf_link(html: Column, suffix: str = ".pdf", prefer: str = "attachdocs") -> Column:
    """The link to a page's document: file= parameters before href and src; a preferred folder before all."""
    end = suffix.replace(".", r"\.")
    first = F.regexp_extract_all(html, F.lit(P.FILE_LINK.replace("{end}", end)), F.lit(1))
    second = F.regexp_extract_all(html, F.lit(P.PLAIN_LINK.replace("{end}", end)), F.lit(1))
    every = F.concat(first, second)
    return F.coalesce(F.get(F.filter(every, lambda u: F.lower(u).contains(prefer)), F.lit(0)), F.get(every, F.lit(0)))


def strict_pdf_link(html: Column, host: str = P.HOST) -> Column:
    """The first file= parameter that names a PDF on the host; null where there is none."""
    return extract(html, P.STRICT_LINK.replace("{host}", host.replace(".", "[.]")), 1)


def _without_dots(path: Column, squeeze: bool) -> Column:
    """A path that starts with a slash, with its "." and ".." parts resolved and, if ``squeeze``, empty ones left out."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    inner = F.filter(inner, lambda s: s != "") if squeeze else inner
    every = F.concat(inner, F.array(last), F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    kept = F.aggregate(
        every, F.array().cast("array<string>"), lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s))
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def absolute_url(base: Column, link: Column) -> Column:
    """A page's link as a url of its own: relative to the page's folder, its host, its scheme, or as it is; null for no link."""
    part = lambda u, i: F.regexp_extract(u, r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$", i)
    site = F.concat(part(base, 1), F.lit(":"), part(base, 2))
    path, rest = part(link, 3), F.concat(part(link, 4), part(link, 5))
    folder = F.concat(F.regexp_extract(part(base, 3), r"^(.*/)?", 1), F.when(part(base, 3).contains("/"), "").otherwise("/"))
    return (
        F.when(link.isNull(), None).when(link == "", base).when(part(link, 1) != "", link).when(part(link, 2) != "", F.concat(part(base, 1), F.lit(":"), link))
        .when(path.startswith("/"), F.concat(site, _without_dots(path, False), rest)).when(path != "", F.concat(site, _without_dots(F.concat(folder, path), True), rest))
        .when(link.startswith("?"), F.concat(site, part(base, 3), rest)).otherwise(F.concat(site, part(base, 3), part(base, 4), rest))
    )


# --- scoring ---------------------------------------------------------------------------


@F.pandas_udf(StringType())
def _decomposed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode())


def ascii_form(value: str | Column) -> Column:
    """Compatibility decomposition, and of that what is ASCII. Spark has no function for it: values beyond ASCII, and no others, go through Arrow."""
    plain = text(value).rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, text(value)).otherwise(_decomposed(F.when(~plain, text(value))))


def normalize_text(value: str | Column) -> Column:
    low = F.replace(F.lower(ascii_form(F.coalesce(text(value), F.lit("")))), F.lit("&"), F.lit(" and "))
    named = F.replace(low, F.lit(P.ISSUER_LONG.lower()), F.lit(P.ISSUER.lower()))
    return F.trim(F.regexp_replace(named, r"[^a-z0-9]+", " "))


def normalize_identifier(value: str | Column) -> Column:
    return F.regexp_replace(F.upper(ascii_form(F.coalesce(text(value), F.lit("")))), r"[^A-Z0-9]+", "")


def normalize_url(value: str | Column) -> Column:
    return F.rtrim(F.trim(F.coalesce(text(value), F.lit(""))), F.lit("/"))


def ratio(part: Column, whole: Column) -> Column:
    """Null for an empty whole."""
    return F.when(whole != 0, part / whole)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))
