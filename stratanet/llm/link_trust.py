"""URL filters: rules by host and path, and trust and distrust carried along the links between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratanet.llm.common import let, small, stored

#: Fixed value of the contract: what is left of a url is its host, then its path.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The target of a link in a page.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]+)"""
ELSEWHERE = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
NO_PAGE = r"^(?:#|[A-Za-z][A-Za-z0-9+.-]*:)"
#: Trust and distrust that all seeds give out together; whole units, so that sums don't depend on their order.
MASS = 1 << 40
#: Part of a host's mass that follows its links, and how often it does.
DAMPING, ROUNDS = 0.85, 20
#: Rounds between two tables on shared storage.
STORED_EACH = 5
#: Bytes of a host's row, about.
HOST_BYTES = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: str) -> Column:
    """What follows the first ``://`` up to a slash, question mark or hash; empty without one."""
    return lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), URL, 1))


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), URL, 2)


def linked_host(link: Column, own: Column) -> Column:
    """The host a link leads to: its own for a relative one, null for mail, scripts and places in the page."""
    there = lower(F.regexp_extract(link, ELSEWHERE, 1))
    return F.when(link.rlike(ELSEWHERE), F.nullif(there, F.lit(""))).when(~link.rlike(NO_PAGE), own)


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, n): links of all pages between hosts, those within a host too."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))
    found = pages.select(host_of("url").alias("source"), links.alias("links")).where("source != ''")
    targets = F.transform("links", lambda x: linked_host(x, F.col("source")))
    found = found.select("source", F.explode(targets).alias("target")).where("target is not null")
    return found.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def parsed_rules(rules: DataFrame) -> DataFrame:
    """(rule, verdict, rule_host, rule_path), each once; rules without a slash fit any path."""
    at = F.instr("rule", "/")
    host = F.when(at > 0, F.expr("substring(rule, 1, instr(rule, '/') - 1)")).otherwise(F.col("rule"))
    path = F.when(at > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit(""))
    return rules.where("rule is not null").select("rule", "verdict", lower(host).alias("rule_host"), path.alias("rule_path")).distinct()


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules of each distinct host and of the domains above it, as far as it has any."""
    parts = F.split("host", r"\.")
    above = let(parts, lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.array_join(F.slice(p, k, F.size(p)), ".")))
    known = small(parsed_rules(rules), HOST_BYTES)
    fits = hosts.where("host != ''").select("host", F.explode(above).alias("rule_host")).join(known, "rule_host")
    rule = F.struct(F.length("rule").alias("length"), "verdict", "rule", "rule_path")
    return fits.groupBy("host").agg(F.collect_list(rule).alias("rules"))


def with_rules(pages: DataFrame, hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """The pages (host, path and more) with the longest rule that fits; of equal ones a block, then the later text."""
    of_host = rules_of_hosts(hosts, rules)
    joined = pages.join(small(stored(of_host, "trust-rules"), HOST_BYTES), "host", "left")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"]))
    best = F.array_max(fits)
    return joined.withColumn("best", best).select(
        *pages.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict")
    )


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(kind, host, mass): personalised PageRank of each kind of seeds.

    ``links`` (kind, source, target, n) and ``seeds`` (kind, host, mass). In
    each round a host keeps 1 - damping of its seed and gets what the hosts
    that link to it pass on, by their numbers of links. What a host without
    links would pass on is lost. Masses are whole numbers, so that a rerun on
    other partitions gives the same. Tables are written every few rounds.
    """
    out = stored(links.groupBy("kind", "source").agg(F.sum("n").alias("all")), "trust-sources")
    share = F.col("n").cast("double") / F.col("all").cast("double")
    shares = links.join(small(out, HOST_BYTES), ["kind", "source"])
    shares = stored(shares.select("kind", "source", "target", share.alias("share")), "trust-links")
    seeds = stored(seeds, "trust-seeds")
    base = seeds.select("kind", "host", F.floor(F.lit(1 - damping) * F.col("mass").cast("double")).cast("long").alias("mass"))
    ranks = seeds
    for k in range(rounds):
        moved = ranks.withColumnRenamed("host", "source").join(shares, ["kind", "source"]).select(
            "kind", F.col("target").alias("host"), F.floor(F.lit(damping) * F.col("mass").cast("double") * F.col("share")).cast("long").alias("mass")
        )
        ranks = base.unionByName(moved).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if k % STORED_EACH == STORED_EACH - 1 or k == rounds - 1:
            ranks = stored(ranks, "trust-ranks")
    return ranks


def host_trust(ruled: DataFrame, links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust): what the pages under an allow rule and under a block rule spread.

    Trust follows the links from trusted pages' hosts; distrust goes against
    them, from blocked pages' hosts to those that link there. A page gives the
    same mass in both.
    """
    kind = F.when(F.col("rule_verdict") == "allow", "trust").when(F.col("rule_verdict") == "block", "distrust")
    seeds = ruled.select(kind.alias("kind"), "host").where("kind is not null and host != ''")
    seeds = stored(seeds.groupBy("kind", "host").agg(F.count(F.lit(1)).alias("n")), "trust-pages")
    total = seeds.agg(F.sum("n")).first()[0] or 1
    mass = F.floor(F.lit(float(MASS)) * F.col("n").cast("double") / F.lit(float(total))).cast("long")
    links = stored(links, "trust-edges")
    back = links.select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "n")
    both = links.select(F.lit("trust").alias("kind"), "source", "target", "n").unionByName(back)
    ranks = propagate(both, seeds.select("kind", "host", mass.alias("mass")), rounds)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0)).alias(kind)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: DataFrame, percent: int = 50, rounds: int = ROUNDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of pages (page_id, url, html).

    The longest rule that fits a page decides. Else its host is blocked if
    distrust is more than ``percent`` of all mass the host has, and allowed if
    not, as when no mass reaches it. ``rules`` has (rule, verdict), the rule as
    host and path, the verdict allow or block.

    A null url or one without ``://`` has an empty host and path, no rule, and
    is allowed. A null html has no links. Rows that share an id are judged one
    by one, and each counts as a seed. Empty tables give no rows, or pages
    without rules. Long pages are searched as a whole. Other columns are not
    read, and may have any name.
    """
    split = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    hosts = stored(split.select("host").distinct(), "trust-hosts")
    ruled = with_rules(split, hosts, rules)
    trust = host_trust(ruled, host_links(pages), rounds)
    mass = stored(hosts.join(trust, "host"), "trust-masses")
    found = ruled.join(small(mass, HOST_BYTES), "host", "left")
    trust, distrust = (F.coalesce(c, F.lit(0).cast("long")) for c in ("trust", "distrust"))
    bad = 100 * distrust > percent * (trust + distrust)
    verdict = F.coalesce("rule_verdict", F.when(bad, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
