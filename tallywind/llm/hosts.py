"""URL filters with empirical-Bayes host reputation.

Labelled pages of a host are binomial draws. Few labels say little, so a host's rate is shrunk towards that of its registered
domain, which is shrunk towards that of its suffix, which is shrunk towards the rate of all. How strongly is estimated from the
data at every level, by the moments of the beta-binomial distribution. A host is blocked if even the upper bound of its posterior
rate is low; explicit rules come first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywind.llm.tables import lower_ascii

#: Second-level names that count as part of the suffix below a two-letter top-level domain.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "net", "nom", "or", "org")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffix_labels(host: Column) -> tuple[Column, Column]:
    """The labels of a host without port and user, and how many of them make the suffix."""
    parts = F.split(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.")
    two = (F.size(parts) >= 3) & (F.length(F.element_at(parts, -1)) == 2) & F.get(parts, F.size(parts) - 2).isin(*SECOND_LEVEL)
    return parts, F.when(two, 2).otherwise(1)


def suffix(host: Column) -> Column:
    parts, n = _suffix_labels(host)
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), n), ".")


def registered_domain(host: Column) -> Column:
    parts, n = _suffix_labels(host)
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n), n + 1), ".")


def _strength(groups: DataFrame) -> Column:
    """As a scalar subquery: how many labels the prior of groups `n, k` is worth, between 1 and 1000.

    The groups' rates vary by chance and by their own differences; the share r of the latter, from the weighted sum of
    squares as in an analysis of variance, gives 1 / r - 1.
    """
    seen = groups.filter("n > 0")
    sums = seen.agg(
        F.sum("n").alias("all"), F.sum("k").alias("good"), F.count(F.lit(1)).alias("groups"),
        F.sum(F.expr("cast(n AS double) * n")).alias("n_n"), F.sum(F.expr("cast(k AS double) * k / n")).alias("k_k"),
    )
    rate = "(cast(good AS double) / all)"
    own = f"({rate} * (1 - {rate}))"
    squares = f"(k_k - all * {rate} * {rate})"
    share = f"(({squares} - (groups - 1) * {own}) / nullif({own} * (all - n_n / all - (groups - 1)), 0))"
    return sums.select(F.expr(f"coalesce(1 / greatest(0.000999000999000999, least(0.5, {share})) - 1, 1000)")).scalar()


def reputations(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """`host, domain, suffix, n_labels, n_good, mean, lower, upper` for each distinct host of `pages` (`page_id, host`).

    `outcomes` has `page_id, good` (0 or 1, null: unlabelled). Counts are summed per host before anything else is joined.
    """
    labels = outcomes.filter("good IS NOT NULL").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("k"))
    counted = pages.join(labels, "page_id").groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")).join(counted, "host", "left").select(
        "host", registered_domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"),
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"),
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    everything = suffixes.agg(F.expr("coalesce(sum(k) / nullif(sum(n), 0), 0.5)")).scalar()

    strength = _strength(suffixes)
    by_suffix = suffixes.select("suffix", ((strength * everything + F.col("k")) / (strength + F.col("n"))).alias("suffix_mean"))
    strength = _strength(domains)
    by_domain = domains.join(by_suffix, "suffix").select(
        "domain", "suffix", ((strength * F.col("suffix_mean") + F.col("k")) / (strength + F.col("n"))).alias("domain_mean")
    )
    strength = _strength(hosts)
    posterior = hosts.join(by_domain, ["domain", "suffix"]).select(
        "host", "domain", "suffix", F.col("n").alias("n_labels"), F.col("k").alias("n_good"),
        (strength * F.col("domain_mean") + F.col("k")).alias("a"),
        (strength * (1 - F.col("domain_mean")) + F.col("n") - F.col("k")).alias("b"),
    )
    mean, spread = "a / (a + b)", "sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))"
    return posterior.select(
        "host", "domain", "suffix", "n_labels", "n_good", F.expr(mean).alias("mean"),
        F.expr(f"greatest(0D, {mean} - {z}D * {spread})").alias("lower"), F.expr(f"least(1D, {mean} + {z}D * {spread})").alias("upper"),
    )


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Number of the longest rule that fits, null if none; of equally long ones the first. For short lists of rules."""
    ranked = sorted(range(len(rules)), key=lambda i: -len(rules[i].host + rules[i].path))
    found = None
    for i in ranked:
        fits = ((host == rules[i].host) | host.endswith("." + rules[i].host)) & path.startswith(rules[i].path)
        found = F.when(fits, i) if found is None else found.when(fits, i)
    return F.lit(None).cast("int") if found is None else found


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = (), least: float = 0.5, z: float = 1.645) -> DataFrame:
    """`page_id, host, path, rule, verdict, mean, upper` for every row of `pages`.

    A rule's verdict, else `block` where the posterior's upper bound is below `least`, else `allow`. A null url, or one
    without `://`, has an empty host, judged like others. Repeated rows and ids are judged alike; an empty table
    of outcomes leaves every rate at one half, which blocks nothing.
    """
    parsed = pages.select("page_id", url_host(pages["url"]).alias("host"), url_path(pages["url"]).alias("path"))
    known = reputations(parsed.select("page_id", "host"), outcomes.select("page_id", "good"), z).select("host", "mean", "upper")
    names = F.array(*[F.lit(r.host + r.path) for r in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array().cast("array<string>")
    ruled = parsed.withColumn("k", matching_rule(F.col("host"), F.col("path"), rules))
    return ruled.join(known, "host", "left").select(
        "page_id", "host", "path", F.get(names, F.col("k")).alias("rule"),
        F.coalesce(F.get(verdicts, F.col("k")), F.when(F.col("upper") < least, "block").otherwise("allow")).alias("verdict"),
        "mean", "upper",
    )
