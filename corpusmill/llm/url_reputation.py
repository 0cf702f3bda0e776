"""URL filter: rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted by host. The share of bad pages of a suffix is shrunk to the share of all, that of a
registered domain to its suffix, that of a host to its domain, each through a beta-binomial prior whose strength is
estimated from how the children of one parent differ. A host is blocked if the lower bound of its posterior share of bad
pages reaches a multiple of the share over all pages.

Defined results: a null url, or one without "://", has empty host and path, fits no rule and is judged like any other
host; an unlabelled host takes its domain's share; labels that repeat a page count as they stand; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import LOWER, UPPER, attach, scratch

#: Second labels that country domains register names under; such a suffix has two labels, any other is the last label. Fixed values.
SECOND_LABELS = ("ac", "co", "com", "edu", "gen", "go", "gob", "gov", "gouv", "govt", "gv", "id", "info", "me", "mil", "ne", "net", "nom", "or", "org", "school", "sch", "web")
#: Rules that are broadcast at most.
MAX_BROADCAST_RULES = 100_000


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def host_name(host: Column) -> Column:
    """The host without user, password, port and a final dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(?::[0-9]*)?$", "")


def _address(name: Column) -> Column:
    return name.rlike(r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*\])$")


def _two_labels(name: Column) -> Column:
    return name.rlike(r"(?:^|\.)(?:" + "|".join(SECOND_LABELS) + r")\.[a-z]{2}$")


def url_suffix(name: Column) -> Column:
    """The public suffix of a host name; an IP address is its own."""
    return F.when(_address(name), name).when(_two_labels(name), F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))


def registered_domain(name: Column) -> Column:
    return F.when(_address(name), name).when(_two_labels(name), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, fitting): the rules (verdict, rule) of a host or a parent of it, longest first, as an array of (path, rule, verdict). Hosts without any are left out.

    rules are like `example.com/en/`: a name and the start of a path. Each host meets them by its names, its own and its parents'.
    """
    parts = F.split("rule", "/", 2)
    known = rules.select(parts[0].alias("name"), F.concat(F.lit("/"), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("path"), "rule", "verdict")
    known = F.broadcast(known) if rules.count() <= MAX_BROADCAST_RULES else known
    labels = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = hosts.select("host", F.explode(names).alias("name")).join(known, "name")
    fitting = F.array_sort(F.collect_list(F.struct((-F.length("rule")).alias("order"), "rule", "path", "verdict")))
    return met.groupBy("host").agg(fitting.alias("fitting"))


def _shrink(children: DataFrame, parent: str, default_strength: float) -> DataFrame:
    """One row for each parent: strength of the prior for its children, by the method of moments."""
    t = children.groupBy(parent).agg(F.count_if(F.col("n") > 0).alias("k"), F.sum("n").alias("sn"), F.sum(F.col("n") * F.col("n")).alias("sn2"), F.sum("bad").alias("sb"), F.sum(F.when(F.col("n") > 0, F.col("bad") * F.col("bad") / F.col("n")).otherwise(0.0)).alias("sb2"))
    p = F.col("sb") / F.col("sn")
    spread = F.col("sb2") - 2 * p * F.col("sb") + p * p * F.col("sn")
    by_chance = F.col("k") - 1
    rho = (spread / (p * (1 - p)) - by_chance) / (F.col("sn") - F.col("sn2") / F.col("sn") - by_chance)
    usable = (F.col("k") > 1) & (F.col("sb") > 0) & (F.col("sb") < F.col("sn")) & (F.col("sn") - F.col("sn2") / F.col("sn") > by_chance)
    rho = F.when(usable, F.least(F.greatest(rho, F.lit(0.001)), F.lit(0.99)))
    return t.select(parent, F.coalesce(1 / rho - 1, F.lit(default_strength)).alias("strength"))


def host_reputation(hosts: DataFrame, z: float = 1.645, default_strength: float = 10.0) -> DataFrame:
    """hosts (a scratch table: host, n labelled pages, bad ones) to (host, share, bound, overall): the posterior share of bad pages, its lower bound, and the share over all hosts.

    Suffixes with many domains and domains with many hosts meet them by broadcast (attach).
    """
    name = host_name(F.col("host"))
    hosts = hosts.withColumn("domain", registered_domain(name)).withColumn("suffix", url_suffix(name))
    domains = scratch(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("hosts")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("domains"))
    total = domains.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("*").alias("domains"), F.coalesce(F.sum("hosts"), F.lit(0)).alias("hosts")).first()
    overall = F.lit((total.bad + 1) / (total.n + 2))
    mean = (default_strength * overall + F.col("bad")) / (default_strength + F.col("n"))
    prior = scratch(suffixes.select("suffix", "domains", mean.alias("prior")).join(_shrink(domains, "suffix", default_strength), "suffix"), "suffixes")
    domains = attach(domains, prior, "suffix", "domains", total.domains).withColumn("mean", (F.col("strength") * F.col("prior") + F.col("bad")) / (F.col("strength") + F.col("n")))
    prior = scratch(domains.select("domain", "hosts", F.col("mean").alias("prior")).join(_shrink(hosts, "domain", default_strength), "domain"), "priors")
    a, b = F.col("strength") * F.col("prior") + F.col("bad"), F.col("strength") * (1 - F.col("prior")) + F.col("n") - F.col("bad")
    scored = attach(hosts, prior, "domain", "hosts", total.hosts).select("host", "pages", "n", "bad", overall.alias("overall"), (a / (a + b)).alias("share"), (a + b).alias("weight"))
    return scored.withColumn("bound", F.col("share") - z * F.sqrt(F.col("share") * (1 - F.col("share")) / (F.col("weight") + 1)))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, lift: float = 1.25, z: float = 1.645) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, bound. outcomes: page_id, bad (0 or 1).

    rules: (verdict, rule), a list or a table of any size. The verdict of the longest that fits holds, of equally long ones the first; elsewhere a host
    whose bound reaches `lift` times the share of all pages is blocked.
    """
    url = F.col("url")
    parsed = scratch(pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path")), "urls")
    n_rows = parsed.count()
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    counted = parsed.select("page_id", "host").join(known, "page_id", "left")
    hosts = scratch(counted.groupBy("host").agg(F.count("*").alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "hosts")
    table = rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(list(rules), "verdict string, rule string")
    reputation = host_reputation(hosts, z).select("host", "pages", "share", "bound", "overall").join(rules_of_hosts(hosts, table), "host", "left")
    judged = attach(parsed, scratch(reputation, "reputation"), "host", "pages", n_rows)
    first = F.get(F.filter("fitting", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    verdict = F.coalesce(first["verdict"], F.when(F.col("bound") >= lift * F.col("overall"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", first["rule"].alias("rule"), verdict.alias("verdict"), "share", "bound")
