"""URL filters: declared rules first, else the reputation of the host by empirical Bayes.

Labelled pages are outcomes of their hosts: bad or not. The share of bad pages of a host is shrunk through beta priors from
host to registered domain to suffix to all pages. At each level the prior of a group has its parent's posterior
mean, and one concentration that is fitted to all groups of the level by the moments of the beta-binomial
distribution: groups that differ no more than chance allows are shrunk strongly, others little. A host is blocked when the
lower bound of its posterior, `z` standard deviations below the mean, is above `limit`. A host without a labelled page
has the posterior of its domain, so evidence about the domain decides there, and so on up.

A rule fits its host and all subdomains of it where the path of the url starts with that of the rule; the longest rule wins, of
equally long ones that with the longer host, then the first given. Rules are configuration: they are literals of the plan.

Counts are summed by host before they are shuffled, hosts are joined as narrow written tables, so one host with a large share
of all pages is split like any hot key.

Defined cases: a null url and one without `://` have an empty host and path, fit no rule, and are pages of one host named ''; a port and
a user name belong to the host but not to the name its reputation goes by; a page is labelled by the label rows whose doc_id is its
page_id, bad if one of them says so, not labelled where quality and toxic are both null; pages that repeat an
id are pages each; pages with a null id are judged and not labelled; without any label nothing is blocked but by
rules; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.frames import join_checked
from pagesieve.llm.tables import cut

#: Endings of two labels below which domains are registered; all others have one label. A parameter of `judge`.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
#: A host is blocked if its share of bad pages is above LIMIT by Z standard deviations of the posterior.
LIMIT, Z = 0.3, 1.64
#: Bounds of the correlation of two pages of a group, which sets the concentration 1 / rho - 1.
LEAST_RHO, MOST_RHO = 0.001, 0.5


@dataclass(frozen=True)
class Rule:
    """`allow` or `block` for a host, its subdomains, and paths that start with `path`."""

    verdict: str
    host: str
    path: str = "/"

    @classmethod
    def of(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(verdict, host.lower(), slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits as struct of rule and verdict, or null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (-len(r.text), -len(r.host)))[::-1]:
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def ancestors(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column, Column]:
    """Name, registered domain and suffix of a host, without user name, port and final dot; addresses have no suffix."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    name = F.regexp_replace(name, "[.]$", "")
    two = F.substring_index(name, ".", -2)
    suffix = F.when(two.isin(list(suffixes)), two).otherwise(F.substring_index(name, ".", -1))
    labels = F.when(two.isin(list(suffixes)), F.substring_index(name, ".", -3)).otherwise(two)
    address = name.rlike("^[0-9.]+$") | F.startswith(name, F.lit("["))
    return name, F.when(address, name).otherwise(labels), F.when(address, F.lit("")).otherwise(suffix)


def outcomes(labels: DataFrame) -> DataFrame:
    """page_id and bad (0 or 1) of all labelled ids."""
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    known = labels.filter("doc_id is not null and (toxic is not null or quality is not null)")
    return known.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad.cast("int")).alias("bad"))


def _exact(term: Column) -> Column:
    """Decimal sums are the same in any order."""
    return F.sum(term.cast("decimal(38,12)")).cast("double")


def _shrunk(groups: DataFrame) -> DataFrame:
    """Rows with n, bad and m, the parent's mean: with rho, which all groups of the level share, mean and weight of the posterior."""
    expected = F.col("n") * F.col("m") * (1 - F.col("m"))
    off = F.col("bad") - F.col("n") * F.col("m")
    sums = groups.agg(_exact(off * off - expected).alias("over"), _exact(expected * (F.col("n") - 1)).alias("pairs"))
    rho = sums.select(F.try_divide("over", "pairs")).first()[0]
    s = 1 / min(max(rho or 0.0, LEAST_RHO), MOST_RHO) - 1
    return groups.withColumns({"mean": (s * F.col("m") + F.col("bad")) / (s + F.col("n")), "weight": s + F.col("n")})


def reputation(hosts: DataFrame, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """Rows of host, name, domain, suffix, n (labelled pages) and bad of them: with mean, bound and blocked."""
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    names = cut(hosts.groupBy("name", "domain", "suffix").agg(*sums))
    domains = cut(names.groupBy("domain", "suffix").agg(*sums))
    ends = cut(domains.groupBy("suffix").agg(*sums))
    total = ends.agg(*sums).first()
    base = (total["bad"] or 0) / max(total["n"] or 0, 1)
    parent = lambda df, key: cut(df.select(*key, F.col("mean").alias("m")))
    level = _shrunk(ends.withColumn("m", F.lit(float(base))))
    level = _shrunk(join_checked(domains, parent(level, ["suffix"]), ["suffix"]))
    level = _shrunk(join_checked(names, parent(level, ["domain", "suffix"]), ["domain", "suffix"]))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    judged = level.select("name", "domain", "suffix", "mean", (F.col("mean") - z * spread).alias("bound"))
    joined = join_checked(hosts, cut(judged), ["name", "domain", "suffix"])
    return joined.withColumn("blocked", F.col("bound") > limit)


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[Rule],
    limit: float = LIMIT,
    z: float = Z,
    suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """One row per row of `pages` (page_id, url): page_id, host, path, rule, verdict, and labelled, bad, mean and bound of the host."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    labelled = cut(rows.filter("page_id is not null").join(outcomes(labels), "page_id").select("host", "bad"))
    known = labelled.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    every = rows.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    counted = every.unionByName(known).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    name, domain, suffix = ancestors(F.col("host"), suffixes)
    hosts = cut(counted.withColumns({"name": name, "domain": domain, "suffix": suffix}))
    judged = reputation(hosts, limit, z).select(
        "host", F.col("n").alias("labelled"), "bad", "mean", "bound", "blocked"
    )
    found = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return join_checked(rows, cut(judged), "host").select(
        "page_id", "host", "path", found["rule"].alias("rule"), F.coalesce(found["verdict"], method).alias("verdict"),
        "labelled", "bad", "mean", "bound",
    )
