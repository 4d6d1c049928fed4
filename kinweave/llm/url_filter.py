"""URL filters: rules of hosts and paths, and an empirical-Bayes reputation of hosts for all other urls.

Labelled page outcomes are counted by host. A host's rate of bad pages is shrunk towards that of its
registered domain, the domain's towards that of its suffix, the suffix's towards the overall rate, by
beta-binomial priors whose strength at each level is estimated from the spread of the rates there. A
url is blocked if the lower posterior bound of its host's rate is above the tolerated one. All is
DataFrame code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_words, materialise

#: Standard deviations below the posterior mean; rate of bad pages above which a host is blocked.
DEVIATIONS, TOLERATED = 1.645, 0.5
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0

#: Words that mark a host's pages as unwanted; labels that form a suffix with a country's.
LISTED = ("adult", "ads", "bets", "casino", "pills", "spam")
SECOND_LEVEL = ("ac", "co", "com", "ed", "edu", "go", "gob", "gouv", "gov", "gub", "gv", "ltd", "me", "mil", "muni", "ne", "net", "nhs", "nic", "nom", "or", "org", "plc", "police", "sch")


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host``, all its subdomains, and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in lower case; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_parts(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix): the suffix is the last label, or the last two where a country's has a second level.

    What stands before an @, a port, and dots at the end are left aside. A numeric address is its own domain, below the suffix ``ip``.
    """
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.*(:[0-9]*)?$", "")
    address = F.regexp_like(bare, F.lit(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^\["))
    labels = F.split(bare, r"\.")
    two = (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL) & (F.size(labels) > 2)
    n = F.when(two, 2).otherwise(1)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), k), ".")
    return F.when(address, bare).otherwise(last(n + 1)), F.when(address, "ip").otherwise(last(n))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def page_outcome(host: Column, html: Column) -> Column:
    """1 for a bad page: its host carries a listed word, or a tenth of its words are marked up as junk; 0 for another; null for an empty page."""
    junk = F.regexp_count(html, F.lit(r"\*\*\*|###|\$\$\$|%%%|!!"))
    listed = F.regexp_like(host, F.lit(rf"(^|[.-])({'|'.join(LISTED)})([.-]|$)"))
    words = count_words(F.coalesce(html, F.lit("")))
    return F.when(words > 0, (listed | (junk * 10 > words)).cast("int"))


def _strength(groups: DataFrame) -> tuple[float, float]:
    """Overall rate of bad pages and strength of the beta prior of groups (n, bad), by moments; three sums reach the driver."""
    n, bad, count = groups.agg(F.sum("n"), F.sum("bad"), F.count("*")).first()
    if not n:
        return 0.0, STRONGEST
    p = bad / n
    spread = groups.agg(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - p, 2))).first()[0] / n - p * (1 - p) * count / n
    return p, min(max(p * (1 - p) / spread - 1, WEAKEST), STRONGEST) if spread > 0 else STRONGEST


def host_reputation(pages: DataFrame) -> DataFrame:
    """(host, n, bad, a, b, bound): the posterior Beta(a, b) of each host's rate of bad pages and its lower bound.

    ``pages`` has host and outcome (1 bad, 0 good, null unlabelled); hosts without labelled pages get their parents' prior.
    """
    domain, suffix = domain_parts(F.col("host"))
    hosts = pages.groupBy("host").agg(F.count("outcome").alias("n"), F.sum(F.coalesce("outcome", F.lit(0))).alias("bad"))
    hosts = materialise(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall, by_suffix = _strength(suffixes.where("n > 0"))
    by_domain, by_host = (_strength(g.where("n > 0"))[1] for g in (domains, hosts))

    def rate(strength: float, prior: Column) -> Column:
        return (strength * prior + F.col("bad")) / (strength + F.col("n"))

    suffixes = suffixes.select("suffix", rate(by_suffix, F.lit(overall)).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", rate(by_domain, F.col("suffix_rate")).alias("domain_rate"))
    a = by_host * F.col("domain_rate") + F.col("bad")
    b = by_host * (1 - F.col("domain_rate")) + F.col("n") - F.col("bad")
    posterior = hosts.join(domains, "domain").select("host", "n", "bad", a.alias("a"), b.alias("b"))
    total = F.col("a") + F.col("b")
    return posterior.withColumn("bound", F.col("a") / total - DEVIATIONS * F.sqrt(F.greatest(F.col("a") * F.col("b"), F.lit(0.0)) / (total * total * (total + 1))))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, tolerated: float = TOLERATED) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound), one row for each row of ``pages`` (page_id, url, html).

    The longest fitting rule decides; else a url is blocked if the lower posterior bound of its
    host's rate of bad pages is above ``tolerated``. A null url, or one without ``://``, has an empty
    host and path; all such urls share one host. Null or empty html is an unlabelled page. A null
    page_id and repeated rows are judged like any others; an empty table gives an empty result.
    """
    host = host_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path_of(F.col("url")).alias("path"), page_outcome(host, F.col("html")).alias("outcome"))
    rows = materialise(rows, "pages")
    reputation = materialise(host_reputation(rows).select("host", "bound"), "reputation")  # a table: a host of many pages can be split in the join
    found = rows.join(reputation, "host").withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("bound") > tolerated, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "bound")
