"""URL rules, and host reputation by empirical Bayes where no rule fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlabel.session import settle

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty for NULL or without `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, NULL if none does. A rule fits its host and all
    subdomains if the path starts with its own. Longest is the host first, then the path."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def last_labels(host: Column, labels: int) -> Column:
    """The last `labels` labels of a host; a shorter host as it is."""
    return F.substring_index(host, ".", -labels)


def _weight(level: DataFrame) -> float:
    """Pseudo-pages of a beta prior, from how far the groups (n, k) of a level scatter about their expected rate `p`
    beyond binomial noise: E[(k - n p)^2] = n p (1 - p) (1 + (n - 1) rho), rho over all groups, weight 1 / rho - 1."""
    p, n, k = F.col("p"), F.col("n"), F.col("k")
    noise = n * p * (1 - p)
    over, scale = level.filter("n > 1").agg(F.sum(F.pow(k - n * p, 2) - noise), F.sum(noise * (n - 1))).first()
    rho = over / scale if scale else 0.0
    return min(1000.0, max(1.0, 1.0 / rho - 1.0)) if rho > 0 else 1000.0


def reputation(outcomes: DataFrame, host: str = "host", bad: str = "bad", z: float = 1.645, suffix_labels: int = 1) -> DataFrame:
    """(host, n, n_bad, mean, lower): how likely a page of each host is bad, shrunk through its domain and suffix.

    `outcomes` has one row per labelled page, `bad` is 0 or 1. A suffix is the last `suffix_labels` labels of a host, its
    registered domain has one more. On each level a beta prior is centred on the estimate one level up, made from the pages that
    are not of the group itself, so that no page speaks twice; its weight (1 to 1,000 pseudo-pages) comes from the scatter of the
    level's groups. `lower` is the posterior mean less z posterior deviations. Rows with a NULL host are left out; a NULL label
    is a page without one: it counts nowhere, but its host has a row, with the prior of its domain and suffix as its posterior.
    Groups are counted before any join, so a host with a third of all pages is one row; one number a level comes to the driver.
    """
    pages = outcomes.select(F.col(f"`{host}`").alias("host"), F.col(f"`{bad}`").cast("double").alias("bad"))
    counts = pages.filter("host is not null").groupBy("host").agg(
        F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("k")
    )
    domain, suffix = last_labels(F.col("host"), suffix_labels + 1), last_labels(F.col("host"), suffix_labels)
    hosts = settle(counts.withColumns({"domain": domain, "suffix": suffix}), "host-counts")
    total_n, total_k = hosts.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("k"), F.lit(0.0))).first()
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    table = settle(hosts.join(domains, ["domain", "suffix"]).join(suffixes, "suffix"), "host-levels")

    c = F.col
    top = (total_k - c("sk") + 0.5) / (total_n - c("sn") + 1)
    w_suffix = _weight(table.select("suffix", c("sn").alias("n"), c("sk").alias("k"), top.alias("p")).distinct())
    of_suffix = (c("sk") - c("dk") + w_suffix * top) / (c("sn") - c("dn") + w_suffix)
    w_domain = _weight(table.select("domain", "suffix", c("dn").alias("n"), c("dk").alias("k"), of_suffix.alias("p")).distinct())
    of_domain = (c("dk") - c("k") + w_domain * of_suffix) / (c("dn") - c("n") + w_domain)
    w_host = _weight(table.select("n", "k", of_domain.alias("p")))
    mean = (c("k") + w_host * of_domain) / (c("n") + w_host)
    out = table.select("host", c("n").cast("long").alias("n"), c("k").cast("long").alias("n_bad"), mean.alias("mean"))
    spread = F.sqrt(c("mean") * (1 - c("mean")) / (c("n") + w_host + 1))
    return out.withColumn("lower", c("mean") - F.lit(z) * spread)


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    block_above: float = 0.5,
    z: float = 1.645,
    suffix_labels: int = 1,
) -> DataFrame:
    """(id_col, host, path, rule, verdict, reputation): one row per page row.

    `outcomes` (id_col, bad) labels pages by id. The longest fitting rule decides. Else a host is blocked if its
    posterior lower bound is above `block_above`: at worst a page of it is more likely bad than not. A host
    without labelled pages is judged by what its domain and suffix say of it. Empty hosts are allowed, with a NULL reputation. A NULL url has empty host and path;
    repeated rows are judged each by itself; an empty table gives no rows, and without labels all are allowed.
    Only the id and url columns are read.
    """
    url = F.col(f"`{url_col}`").cast("string")
    parts = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    parts = settle(parts.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)), "url-parts")
    known = outcomes.select(F.col(f"`{id_col}`").alias("_id"), F.col("bad"))
    labelled = parts.filter("host <> ''").join(known, F.col("id") == F.col("_id")).select("host", "bad")
    every = parts.filter("host <> ''").select("host").distinct().withColumn("bad", F.lit(None).cast(labelled.schema["bad"].dataType))
    labelled = labelled.unionByName(every)
    rated = reputation(labelled, z=z, suffix_labels=suffix_labels).select(F.col("host").alias("_host"), "lower", "mean")
    blocked = F.when(F.col("lower") > block_above, "block").otherwise("allow")
    out = parts.join(rated, F.col("host") == F.col("_host"), "left")
    return out.select(
        F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), blocked).alias("verdict"), F.col("mean").alias("reputation"),
    )
