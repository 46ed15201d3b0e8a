"""URL rules and host trust from the link graph, native expressions only.

A rule fits its host and all subdomains if the path starts with the rule's path; the longest rule
wins. Where no rule fits, the host decides. Hosts with more than half of their pages allowed by rules
are trusted seeds, hosts with more than half blocked are blocked seeds. Trust flows by personalised
PageRank from the trusted seeds along links between hosts, distrust from the blocked seeds against
the links, and a host with more distrust than trust is blocked.

Masses are integers (a share is rounded down), so results do not depend on the order of sums. Steps go on until the mass
that still moves is a 10^9th of what the seeds had, or nothing moves: links of any distance count up to there (a chain of hosts
is followed for 128 links). At a tie of trust and distrust a host is allowed.

Defined results for odd input: a NULL url, or one without ``://``, has an empty host and path, and
no rule fits it. NULL html has no links. Repeated rows come back as often as they occur; a link
counts once per pair of hosts. A host without links, and the empty host, get neither mass and are
allowed. Columns beyond the named ones are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.llm.common import broadcast_if_small, lower_ascii, stored

#: mass given to all seeds of one kind together; a host cannot gather more than UNIT / 0.15, which fits a long
UNIT = 10 ** 18
#: percent of a host's mass that follows its links
FOLLOW_PERCENT = 85
#: moving mass of both kinds together at which the flow has ended
REST = UNIT // 10 ** 9
#: steps after which the masses so far are summed into one table
FOLD = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return lower_ascii(raw), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or NULL; ``rules`` are (verdict, host, path)."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in longest]
    return reduce(lambda rest, x: F.when(x[0], F.struct(F.lit(x[1][1] + x[1][2]).alias("rule"), F.lit(x[1][0]).alias("verdict")))
                  .otherwise(rest), reversed(list(zip(fits, longest, strict=True))), F.lit(None).cast("struct<rule:string,verdict:string>"))


def host_links(pages: DataFrame, host: str, html: str) -> DataFrame:
    """Distinct links between different hosts (src, dst), from absolute href targets."""
    targets = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"), F.lit(1))
    found = pages.select(F.col(host).alias("src"), F.explode(F.array_distinct(targets)).alias("to"))
    absolute = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    return found.select("src", host_and_path(absolute)[0].alias("dst")).filter("dst <> src AND dst <> '' AND src <> ''").distinct()


def spread(links: DataFrame, seeds: DataFrame, follow: int = FOLLOW_PERCENT, rest: int = REST) -> DataFrame:
    """(host, trust, distrust) from ``seeds`` (host, kind) when at most ``rest`` still moves; kind is trust or distrust.

    Both kinds travel in one table: trust along links, distrust against them. Each step joins the
    hosts that hold mass with their edges and sums by target; partial sums are made first. A step leaves 85 % of the
    mass at most, so there are 132 steps at most.
    """
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    degrees = edges.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("degree"))
    edges = stored(edges.join(degrees, ["kind", "src"]), "edges")
    share = seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("n_seeds"))    # two rows
    total = now = stored(seeds.join(F.broadcast(share), "kind").select("kind", "host", F.expr(f"{UNIT} div n_seeds").alias("mass")), "seeds")
    moving = lambda df: df.agg(F.coalesce(F.sum(F.col("mass").cast("decimal(38,0)")), F.lit(0))).first()[0]
    step = 0
    while moving(now) > rest:
        sent = F.expr(f"(mass div 100 * {follow} + mass % 100 * {follow} div 100) div degree")
        moved = now.join(edges, (now.kind == edges.kind) & (now.host == edges.src)).select(edges.kind, F.col("dst").alias("host"), sent.alias("mass"))
        now = stored(moved.groupBy("kind", "host").agg(F.sum("mass").alias("mass")).filter("mass > 0"), "step")
        total, step = total.unionByName(now), step + 1
        if step % FOLD == 0:
            total = stored(total.groupBy("kind", "host").agg(F.sum("mass").alias("mass")), "so-far")
    by_kind = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0)).alias(k)
    return total.groupBy("host").agg(by_kind("trust"), by_kind("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the host's trust and distrust."""
    host, path = host_and_path(F.col(f"`{url}`"))
    base = pages.select(F.col(f"`{id_col}`").alias("k"), host.alias("host"), path.alias("path"), F.col(f"`{html}`").alias("html"))
    links = stored(host_links(base, "host", "html"), "links")
    fit = F.col("fit")
    ruled = stored(base.drop("html").withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)).select(
        "k", "host", "path", fit["rule"].alias("rule"), fit["verdict"].alias("ruled")), "ruled")
    share = lambda v: 2 * F.count(F.when(F.col("ruled") == v, 1)) > F.count(F.lit(1))
    seeds = ruled.groupBy("host").agg(F.when(share("allow"), "trust").when(share("block"), "distrust").alias("kind")).filter("kind IS NOT NULL")
    mass = broadcast_if_small(stored(spread(links, stored(seeds, "seed_hosts")), "mass"))
    out = ruled.join(mass, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    return out.select(F.col("k").alias(id_col), "host", "path", "rule",
                      F.coalesce("ruled", F.when(distrust > trust, "block").otherwise("allow")).alias("verdict"),
                      trust.alias("trust"), distrust.alias("distrust"))
