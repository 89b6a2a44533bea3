"""Verdicts on page addresses: written rules first, then trust that spreads over links between hosts.

Hosts with pages that a rule allows are trusted seeds, hosts with blocked pages are distrusted seeds, each weighed by
its number of such pages. Trust is personalised PageRank along the links, distrust the same against them. A host is
blocked if its distrust exceeds ``ratio`` times its trust. Everything is DataFrame code; a round moves one row per host
and the summed messages.

Defined cases: a null address, or one without ``://``, has an empty host and path, fits no rule and is allowed; null
html has no links; links to the page's own host are left out and repeated links count as often as they stand; hosts
without links either way keep their seeds' weight; a table without pages gives no rows. Only page_id, url and html are
read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.llm.storage import stored
from hostweave.operators.scale import Wires, cut_and_see, hot_keys, skew_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""
# PageRank's share that follows links, and the part of each rank that may still change when rounds stop.
DAMPING, TOLERANCE = 0.85, 1e-6
# Rounds of the SQL that the tests compare with, which has no way to stop by itself.
ROUNDS = 100
# Trust and distrust that differ by less than this part of them are equal, so that neither the order of sums nor the
# last rounds decide.
SAME = 1e-5


@dataclass(frozen=True)
class Rule:
    """Verdict for a host with its subdomains, and addresses whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``, else empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def addresses(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(page_id, host, path, rule, ruled): the longest fitting rule and its verdict, or nulls."""
    parts = pages.select("page_id", after_scheme(F.coalesce("url", F.lit(""))).alias("rest")).select(
        "page_id", host_of(F.col("rest")).alias("host"), path_of(F.col("rest")).alias("path")
    )
    rule = ruled = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        when = fits(r, F.col("host"), F.col("path"))
        rule = rule.when(when, r.text) if rule is not None else F.when(when, r.text)
        ruled = ruled.when(when, r.verdict) if ruled is not None else F.when(when, r.verdict)
    none = F.lit(None).cast("string")
    return parts.withColumns({"rule": none if rule is None else rule, "ruled": none if ruled is None else ruled})


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    host = host_of(after_scheme(F.coalesce("url", F.lit(""))))
    links = F.regexp_extract_all("html", F.lit(LINK), F.lit(1))
    found = pages.select(host.alias("src"), F.explode(links).alias("link"))
    dst = host_of(F.regexp_replace("link", r"^(?:[A-Za-z]+:)?//", ""))
    return (
        found.select("src", dst.alias("dst"))
        .where("src <> '' AND dst <> '' AND src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


def spread(links: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING, hot_rows: int | None = None) -> DataFrame:
    """(host, seed, rank): personalised PageRank of all hosts in ``seeds``, which has each host once with its seed.

    Ranks add up to 1; what hosts without links hold goes back to the seeds. All zero if no host is a seed. Rounds go on
    until no host's rank changes by more than ``TOLERANCE`` of it, so every host that links lead to has been reached; a
    chain of hosts takes as many rounds as it is long. With ``rounds`` it is a RuntimeError if those do not suffice.
    Links stay where they are, those of a hub dealt out; a round moves one row per host and the added-up shares.
    """
    total = seeds.agg(F.sum("seed")).first()[0] or 0.0
    if not total:
        return seeds.withColumn("rank", F.lit(0.0))
    out = links.groupBy("src").agg(F.sum("n").alias("out"), F.count("*").alias("n_links"))
    counts = stored(out.withColumnRenamed("src", "nbr"), "out")
    hot = hot_keys(counts, ["nbr"], "n_links", hot_rows)
    shares = skew_join(links.select(F.col("src").alias("nbr"), F.col("dst").alias("id"), "n"), counts.select("nbr", "out"), ["nbr"], hot, ["id"])
    shares = stored(shares.select("nbr", "id", (F.col("n") / F.col("out")).alias("share")), "shares")
    # what goes back to the seeds only scales all ranks, so it is left out of the rounds and made up for at the end
    start = (F.col("seed") / total).alias("start")
    state = stored(seeds.select(F.col("host").alias("id"), "seed", start, start.alias("rank")), "ranks")
    with Wires(shares, hot_rows, counts.select("nbr", F.col("n_links").alias("n"))) as wires:
        done = 0
        while True:
            sent = wires.carry(state.where("rank > 0"), "rank", of_link=["share"]).groupBy("id").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
            new = F.col("start") + damping * F.coalesce("got", F.lit(0.0))
            step = F.when(new > 0, F.abs(new - F.col("rank")) / new)
            moved = state.join(sent, "id", "left").select("id", "seed", "start", new.alias("rank"), step.alias("step"))
            moved, seen = cut_and_see(moved, step=F.max("step"), rank=F.sum("rank"))
            state, done = moved.drop("step"), done + 1
            if seen["step"] < TOLERANCE:
                break
            if done == rounds:
                raise RuntimeError(f"ranks still change by {seen['step']} of them after {rounds} rounds")
    return state.select(F.col("id").alias("host"), "seed", (F.col("rank") / seen["rank"]).alias("rank"))


def host_verdicts(pages: DataFrame, judged: DataFrame, ratio: float = 1.0) -> DataFrame:
    """(host, trust, distrust, verdict) of every host that has a page or a link."""
    links = stored(host_links(pages), "links")
    own = (
        judged.where("host <> ''")
        .groupBy("host")
        .agg(F.count_if(F.col("ruled") == "allow").cast("double").alias("good"), F.count_if(F.col("ruled") == "block").cast("double").alias("bad"))
    )
    ends = links.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    hosts = stored(
        ends.join(own, "host", "full").select("host", F.coalesce("good", F.lit(0.0)).alias("good"), F.coalesce("bad", F.lit(0.0)).alias("bad")), "hosts"
    )
    trust = spread(links, hosts.select("host", F.col("good").alias("seed")))
    reversed_links = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = spread(reversed_links, hosts.select("host", F.col("bad").alias("seed")))
    # relative to the two values, which shrink as the number of hosts grows
    more = F.col("distrust") > ratio * F.col("trust") * (1 + SAME)
    return (
        trust.select("host", F.col("rank").alias("trust"))
        .join(distrust.select("host", F.col("rank").alias("distrust")), "host")
        .withColumn("verdict", F.when(more, "block").otherwise("allow"))
    )


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, ratio: float = 1.0) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages."""
    judged = addresses(pages, rules)
    verdicts = stored(host_verdicts(pages, judged, ratio).select("host", F.col("verdict").alias("spread")), "verdicts")
    return judged.join(verdicts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict")
    )
