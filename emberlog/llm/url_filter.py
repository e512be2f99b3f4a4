"""URL filters: exact rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host, registered domain and suffix. A suffix is
shrunk towards all pages, a domain towards its suffix and a host towards its domain, each time through
a beta prior whose strength is estimated from how much the children of that level differ. A page is
blocked when the lower bound of its host's bad share lies above the limit, so a host needs enough bad
pages of its own, or a bad neighbourhood, before it is blocked.

Only DataFrame functions run here. Counting is a partial aggregation; the join back to the pages is
salted, so a host with a third of all pages is spread over many tasks.

Defined results: a null url, or one without ``://``, has an empty host and an empty path; such pages
form a host of their own like any other. Repeated rows get the same verdict and count as often as they
occur. Outcomes that are null are not counted. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = ("host", "domain", "suffix")


@dataclass(frozen=True)
class Rule:
    """``target`` is a host and a path, like ``example.net/en/``; verdict is allow or block."""

    verdict: str
    target: str

    def matches(self) -> Column:
        host, _, path = self.target.partition("/")
        fits = (F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))
        return fits & F.startswith(F.col("path"), F.lit(f"/{path}"))


@dataclass(frozen=True)
class Reputation:
    """Limit of the bad share, width of the bound in standard deviations, suffixes of several labels."""

    max_bad: float = 0.5
    z: float = 1.645
    copies: int = 16
    long_suffixes: tuple[str, ...] = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
    # Bounds of a prior's strength, in pages.
    weakest: float = 1.0
    strongest: float = 1_000.0


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    return pages.withColumns(
        {
            "host": F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER),
            "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
        }
    )


def with_levels(hosts: DataFrame, long_suffixes: tuple[str, ...]) -> DataFrame:
    """Adds ``suffix`` and ``domain`` (the suffix and one more label) to a table of hosts."""
    labels = F.split("host", "\\.")
    two = F.substring_index("host", ".", -2)
    long = two.isin(*long_suffixes) & (F.size(labels) > 2) if long_suffixes else F.lit(False)
    return hosts.withColumns(
        {
            "suffix": F.when(long, two).otherwise(F.substring_index("host", ".", -1)),
            "domain": F.when(long, F.substring_index("host", ".", -3)).otherwise(two),
        }
    )


def rule_columns(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(target, verdict) of the longest rule that fits; nulls without one."""
    target, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.target)):
        target = F.when(rule.matches(), F.lit(rule.target)).otherwise(target)
        verdict = F.when(rule.matches(), F.lit(rule.verdict)).otherwise(verdict)
    return target, verdict


def _strength(children: DataFrame, settings: Reputation) -> DataFrame:
    """One row, ``strength``: of the beta prior that children (n, bad, prior mean) share, by moments.

    With rates r = bad / n around their prior mean m, the squared distance of r exceeds m (1 - m) / n
    by m (1 - m) (n - 1) / n / (strength + 1) on average.
    """
    rate, mean = F.col("bad") / F.col("n"), F.col("mean")
    noise = mean * (1 - mean)
    seen = F.sum(F.pow(rate - mean, 2) * F.col("n") - noise)
    share = F.sum(noise * (F.col("n") - 1))
    spread = F.when((share > 0) & (seen > 0), seen / share)
    strength = F.when(spread.isNotNull(), 1 / spread - 1).otherwise(F.lit(settings.strongest))
    return children.where("n > 0").agg(
        F.greatest(F.lit(settings.weakest), F.least(F.lit(settings.strongest), strength)).alias("strength")
    )


def reputations(pages: DataFrame, settings: Reputation = Reputation()) -> DataFrame:
    """(host, n, bad, bad_mean, bad_low) from pages with ``host`` and ``bad`` (true, false or null)."""
    hosts = pages.groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad")
    )
    # One row per host, read at every level below.
    hosts = stage(with_levels(hosts, settings.long_suffixes), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # All pages, with one good and one bad page added; one row.
    total = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("mean"))

    def shrink(children: DataFrame) -> DataFrame:
        """Posterior of each child: a, b of its beta."""
        weighed = children.crossJoin(F.broadcast(_strength(children, settings)))
        return weighed.withColumn("a", F.col("mean") * F.col("strength") + F.col("bad")).withColumn(
            "b", (1 - F.col("mean")) * F.col("strength") + F.col("n") - F.col("bad")
        )

    def means(level: DataFrame, key: str) -> DataFrame:
        return level.select(F.col(key), (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))

    suffix = shrink(suffixes.crossJoin(F.broadcast(total)))
    domain = shrink(domains.join(means(suffix, "suffix"), "suffix"))
    host = shrink(hosts.join(means(domain, "domain"), "domain"))
    size = F.col("a") + F.col("b")
    mean = F.col("a") / size
    deviation = F.sqrt(mean * (1 - mean) / (size + 1))
    return host.select(
        "host",
        "n",
        "bad",
        mean.alias("bad_mean"),
        F.greatest(F.lit(0.0), mean - settings.z * deviation).alias("bad_low"),
    )


def judge(
    pages: DataFrame,
    rules: tuple[Rule, ...],
    settings: Reputation = Reputation(),
    url: str = "url",
    id_column: str = "page_id",
    bad: str = "bad",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_mean, bad_low); ``bad`` is a labelled outcome or null."""
    known = with_host(pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url"), F.col(bad).alias("bad")))
    known = known.drop("url")
    spread = reputations(known, settings).withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), F.lit(settings.copies - 1)))
    )
    salted = known.withColumn("_copy", F.pmod(F.xxhash64("page_id", "path"), F.lit(settings.copies)).cast("int"))
    rule, verdict = rule_columns(rules)
    method = F.when(F.col("bad_low") > settings.max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return salted.join(spread.drop("n", "bad"), ["host", "_copy"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "bad_mean", "bad_low"
    )
