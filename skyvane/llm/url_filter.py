"""Verdicts on urls: written rules first, then trust and distrust spread over host links.

Trust is a personalised PageRank: it starts at hosts with pages that a rule allows and follows
links. Distrust starts at hosts with pages that a rule blocks and follows links backwards: a host
is distrusted as far as the hosts that it links to are. It is weighted by the own links of the host
that takes it on, so it does not shrink with the number of hosts that link to a blocked one. A
host is judged by its distrust compared with its trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyvane.llm.storage import stored

# Action, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
FOLLOW = 0.85
# Each round lets through a share FOLLOW of what the one before moved, so about 180 rounds settle
# a thousand million hosts.
ROUNDS = 500
SETTLED = 1e-4
# Distrust, which is 1 for a host whose every page is blocked, that blocks a host which is not
# trusted more.
DISTRUST = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without one or without ``://``."""
    there = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.expr("substring(url, locate('://', url) + 3)")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return (
        F.when(there, F.translate(host, _UPPER, _LOWER)).otherwise(""),
        F.when(there, path).otherwise(""),
    )


def verdicts(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    follow: float = FOLLOW,
    rounds: int = ROUNDS,
    distrust: float = DISTRUST,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` per row of
    ``pages(page_id, url, html)``.

    A rule fits its host and the hosts below it where the path starts with the rule's path; the
    longest fitting rule decides. Without one the host is blocked if its distrust is at least
    ``distrust`` and more than its trust, else allowed. A row without a url has an empty host,
    which has no links, and is allowed. Repeated rows count as so many pages and each get a row;
    other columns are ignored. Raises RuntimeError if trust and distrust do not settle within
    ``rounds``.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), _links())
    judged = stored(_with_rule(parts, rules), "urls")
    seeds = judged.groupBy("host").agg(
        F.avg(F.coalesce((F.col("action") == "allow").cast("double"), F.lit(0.0))).alias("allowed"),
        F.avg(F.coalesce((F.col("action") == "block").cast("double"), F.lit(0.0))).alias("blocked"),
    )
    # A host may hold most pages; a written table beside them lets its join be split.
    hosts = stored(spread(stored(seeds, "seeds"), _edges(judged), follow, rounds), "hosts")
    blocked = (F.col("distrust") >= distrust) & (F.col("distrust") > F.col("trust"))
    own = F.coalesce("action", F.when(blocked, "block").otherwise("allow"))
    return (
        judged.drop("links")
        .join(hosts, "host", "left")
        .select("page_id", "host", "path", "rule", own.alias("verdict"), "trust", "distrust")
    )


def _links() -> Column:
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))
    return F.array_distinct(
        F.transform(found, lambda host: F.translate(host, _UPPER, _LOWER))
    ).alias("links")


def _with_rule(parts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add ``action`` and ``rule``: the rules of the host and of those above it are looked up in
    each row, the longest first."""
    tops = dict.fromkeys(top for _, top, _ in rules)
    rule_type = "array<struct<n:int,rule:string,action:string,start:string>>"
    entries = [
        item
        for top in tops
        for item in (
            F.lit(top),
            F.array(
                *(
                    F.struct(
                        F.lit(len(top + start)).alias("n"),
                        F.lit(top + start).alias("rule"),
                        F.lit(action).alias("action"),
                        F.lit(start).alias("start"),
                    )
                    for action, own, start in rules
                    if own == top
                )
            ),
        )
    ]
    table = F.create_map(*entries) if rules else F.lit(None).cast(f"map<string,{rule_type}>")
    labels = F.split("host", r"\.", -1)
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."),
    )
    known = F.transform(
        above, lambda top: F.coalesce(F.try_element_at(table, top), F.array().cast(rule_type))
    )
    fitting = F.filter(
        F.flatten(known), lambda rule: F.startswith(F.col("path"), rule["start"])
    )
    return parts.withColumn("first", F.array_max(fitting)).select(
        "page_id", "host", "path", "links", "first.rule", "first.action"
    )


def _edges(judged: DataFrame) -> DataFrame:
    return (
        judged.select("host", F.explode("links").alias("to"))
        .where("host != '' AND host != to")
        .distinct()
    )


def spread(seeds: DataFrame, edges: DataFrame, follow: float, rounds: int) -> DataFrame:
    """``host, trust, distrust`` from ``seeds(host, allowed, blocked)`` and ``edges(host, to)``.

    Trust is shared among the hosts linked to. Distrust is a host's blocked share, and for pages
    without a rule ``follow`` times the mean distrust of the hosts that it links to. Values are
    scaled so that a host without links keeps its seed. Ends when no value moves by more than
    ``SETTLED``; raises RuntimeError if it does not within ``rounds``. Every host of ``seeds``
    gets a row. Counts and ranks are written before they are joined, so that a host with very
    many links can be split.
    """
    edges = stored(edges, "edges")
    counts = stored(edges.groupBy("host").agg(F.count("*").alias("n_links")), "link-counts")
    open_share = seeds.select("host", (1 - F.col("allowed") - F.col("blocked")).alias("open"))
    counted = edges.join(counts, "host").join(open_share, "host")
    kinds = F.array(
        F.struct(
            F.lit("trust").alias("kind"),
            F.col("host").alias("giver"),
            F.col("to").alias("taker"),
            (1 / F.col("n_links")).alias("share"),
        ),
        F.struct(
            F.lit("distrust").alias("kind"),
            F.col("to").alias("giver"),
            F.col("host").alias("taker"),
            (F.col("open") / F.col("n_links")).alias("share"),
        ),
    )
    weighted = stored(counted.select(F.inline(kinds)), "links")
    start = seeds.select(
        F.col("host").alias("taker"),
        F.inline(
            F.array(
                F.struct(F.lit("trust").alias("kind"), F.col("allowed").alias("seed")),
                F.struct(F.lit("distrust").alias("kind"), F.col("blocked").alias("seed")),
            )
        ),
    )
    start = stored(start.where("seed > 0"), "starts")
    ranks = start.withColumnRenamed("seed", "rank")
    for _ in range(rounds):
        given = (
            ranks.withColumnRenamed("taker", "giver")
            .join(weighted, ["kind", "giver"])
            .groupBy("kind", "taker")
            .agg((F.sum(F.col("rank") * F.col("share")) * follow).alias("got"))
        )
        # Seeds are given in units of 1 - follow, so a host on its own keeps its seed.
        new = start.join(given, ["kind", "taker"], "full").select(
            "kind",
            "taker",
            (F.coalesce("seed", F.lit(0.0)) + F.coalesce("got", F.lit(0.0))).alias("rank"),
        )
        new = stored(new, "ranks")
        moved = (
            new.join(ranks.withColumnRenamed("rank", "old"), ["kind", "taker"], "full")
            .agg(F.max(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))))
            .first()[0]
        )
        ranks = new
        if moved is None or moved <= SETTLED:
            break
    else:
        raise RuntimeError(f"trust and distrust did not settle in {rounds} rounds")

    def of(kind: str) -> DataFrame:
        return ranks.where(F.col("kind") == kind).select(
            F.col("taker").alias("host"), F.col("rank").alias(kind)
        )

    return (
        seeds.select("host")
        .join(of("trust"), "host", "left")
        .join(of("distrust"), "host", "left")
        .na.fill(0.0, ["trust", "distrust"])
    )
