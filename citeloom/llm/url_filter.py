"""Operator 7, URL filter: explicit rules first, else an empirical-Bayes host reputation.

Labelled page outcomes are counted by host. Bad rates are shrunk through
beta-binomial priors down the name: the suffix towards all pages, the
registered domain towards its suffix, the host towards its domain. Prior
strengths come from the data, by the moments of the beta-binomial at each
level: where hosts differ no more than chance would have it, the prior is at its
strongest and no host stands out. A host is blocked where the lower bound of
its posterior bad rate exceeds ``lift`` times the rate of all pages (or lies
more than halfway from that rate to 1, whichever is less).

A suffix is a host's last label, or its last two where these are in
``suffixes``; a registered domain is one label more. An address is its own
domain, and all addresses share one suffix.

Defined results: a null url, or one without "://", has empty host and path,
which no rule fits and which share one reputation; hosts without outcomes get
their domain's, suffix's or the overall rate; without any outcomes nothing is
blocked by the method. Repeated rows are judged alike; null ids pass through;
an empty table gives an empty result. Only the id and url columns are read.
Outcomes meet in sums by host, pre-aggregated, and pages in a join with one row
for each host, so a hot host fills no task.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import save

URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Multiple of the overall bad rate above which a host is blocked, and the posterior standard deviations below the mean that the bound lies.
LIFT, SIDE = 2.0, 1.645
#: Common public suffixes of two labels.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "org.nz", "co.za", "co.in", "co.jp", "ne.jp", "or.jp", "co.kr", "co.il",
    "com.ar", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw",
)
_ADDRESS = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$"
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
#: Rules that one plan may hold as expressions.
MOST_RULES = 2000


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 2)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Columns (rule, action) of the longest rule that fits, null where none does.

    A rule "host/path" fits its host and all subdomains where the url's path
    starts with "/path". Among rules of one length the longer host wins, then
    block over allow.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} fit one plan")
    name = action = F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: (len(r[1]), len(r[1].split("/")[0]), r[0] == "block")):
        its_host, _, its_path = rule.partition("/")
        fits = ((host == its_host) | host.endswith("." + its_host)) & path.startswith("/" + its_path)
        name, action = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def _levels(host: Column, suffixes: Sequence[str]) -> tuple[Column, Column, Column]:
    """Host without user and port, its registered domain, its suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    double = two.isin(*suffixes) if suffixes else F.lit(False)
    domain = F.when(bare.rlike(_ADDRESS), bare).when(double, F.substring_index(bare, ".", -3)).otherwise(two)
    return bare, domain, F.when(bare.rlike(_ADDRESS), "[address]").when(double, two).otherwise(F.substring_index(bare, ".", -1))


def reputations(hosts: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Posterior bad rate of each host from (host, n labelled pages, bad ones): adds mean, lower bound and overall rate.

    One row per host in; the sums by domain and suffix are smaller still.
    """
    bare, domain, suffix = _levels(F.col("host"), suffixes)
    rows = hosts.select("host", F.col("n").cast("double").alias("n"), F.col("bad").cast("double").alias("b"), bare.alias("bare"), domain.alias("domain"), suffix.alias("suffix"))
    rows = save(rows, "url-hosts")
    by_bare = save(rows.groupBy("suffix", "domain", "bare").agg(F.sum("n").alias("n"), F.sum("b").alias("b")), "url-bare")
    by_domain = save(by_bare.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("b").alias("db")), "url-domains")
    by_suffix = save(by_domain.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb")), "url-suffixes")
    whole = by_suffix.agg(F.coalesce(F.sum("sb"), F.lit(0.0)).alias("tb"), F.coalesce(F.sum("sn"), F.lit(0.0)).alias("tn"))

    def strength(df: DataFrame, n: str, b: str, out: str) -> DataFrame:
        """Moments of n, b and b^2/n over the groups of a level give the prior's strength there (one row)."""
        seen = F.col(n) > 0
        m = df.agg(
            F.count(F.when(seen, 1)).cast("double").alias("m"), F.coalesce(F.sum(n), F.lit(0.0)).alias("N"), F.coalesce(F.sum(b), F.lit(0.0)).alias("B"),
            F.coalesce(F.sum(F.col(n) * F.col(n)), F.lit(0.0)).alias("N2"), F.coalesce(F.sum(F.when(seen, F.col(b) * F.col(b) / F.col(n))), F.lit(0.0)).alias("Q"),
        )
        p = F.try_divide(F.col("B"), F.col("N"))
        spread = p * (1 - p)
        above = F.col("Q") - F.col("N") * p * p - spread * (F.col("m") - 1)
        rho = F.try_divide(above, spread * (F.col("N") - F.try_divide(F.col("N2"), F.col("N")) - (F.col("m") - 1)))
        k = F.when(rho > 0, F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), 1 / rho - 1))).otherwise(F.lit(STRONGEST))
        return m.select(k.alias(out))

    # Rows of single numbers: their size does not depend on the input.
    one = F.broadcast(whole.crossJoin(strength(by_suffix, "sn", "sb", "k1")).crossJoin(strength(by_domain, "dn", "db", "k2")).crossJoin(strength(by_bare, "n", "b", "k3")))
    level = by_bare.join(by_domain, ["suffix", "domain"]).join(by_suffix, "suffix").join(one, F.lit(True), "inner")
    mean0 = (F.col("tb") + 1) / (F.col("tn") + 2)
    mean1 = (F.col("k1") * mean0 + F.col("sb")) / (F.col("k1") + F.col("sn"))
    mean2 = (F.col("k2") * mean1 + F.col("db")) / (F.col("k2") + F.col("dn"))
    total = F.col("k3") + F.col("n")
    mean = (F.col("k3") * mean2 + F.col("b")) / total
    lower = F.col("mean") - SIDE * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("total") + 1))
    scored = level.select("bare", mean.alias("mean"), total.alias("total"), mean0.alias("overall")).select("bare", "mean", lower.alias("lower"), "overall")
    return rows.select("host", "bare").join(scored, "bare").select("host", "mean", "lower", "overall")


def url_verdicts(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", lift: float = LIFT, suffixes: Sequence[str] = SUFFIXES
) -> DataFrame:
    """Per row: id, host, path, rule, verdict, and the method's bad_rate, bad_rate_lower and overall_rate.

    ``outcomes`` has columns url and bad (boolean, null: no outcome).
    """
    url = F.col(url_col).cast("string")
    parted = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    labelled = outcomes.filter(F.col("bad").isNotNull()).select(host_of(F.col("url")).alias("host"), F.col("bad").cast("int").alias("bad"))
    counted = labelled.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = parted.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).join(counted, "host", "full_outer")
    known = reputations(hosts.select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad")), suffixes)
    rule, action = best_rule(F.col("host"), F.col("path"), rules)
    most = F.least(lift * F.col("overall"), (1 + F.col("overall")) / 2)
    judged = F.coalesce(action, F.when(F.col("lower") > most, "block").otherwise("allow"))
    return parted.join(known, "host", "left").select(
        id_col, "host", "path", rule.alias("rule"), judged.alias("verdict"), F.col("mean").alias("bad_rate"), F.col("lower").alias("bad_rate_lower"), F.col("overall").alias("overall_rate")
    )
