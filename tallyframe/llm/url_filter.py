"""URL filters: rules first, and for what no rule fits, trust and distrust propagated over links between hosts.

Hosts with pages that a rule allows are trusted, those with pages that a rule blocks are distrusted, each as often as it
has such pages. Trust flows along links (a personalised PageRank from the trusted hosts), distrust against them, from a
blocked host to those that link to it (the same on the reversed graph). A host is linked to its parent domain as well,
both ways, as the one can speak for the other. A host whose distrust is at least a given part of both is blocked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage

DAMPING = 0.7
TOLERANCE = 1e-3
BLOCK_FROM = 0.75

LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    text: str  # host, then the beginning of a path

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://` or url."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """pages with host, path, rule and ruled: the longest rule that fits and its verdict, null where none does."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path))
        rule, ruled = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(ruled)
    return pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumns({"rule": rule, "ruled": ruled})


# Names below which others register their own: in a country's domain the usual second names. No list of all is known here.
SHARED = r"^(?:ac|co|com|edu|gob|gov|ltd|mil|net|nom|or|org|plc|sch)\.[a-z]{2}$"
ADDRESS = r"^(?:[0-9.]*|\[.*|.*:.*:.*)$"


def parents_of(host: Column) -> Column:
    """The host and the domains above it, nearest first: without user and port; an address has none above it, and no name
    of one label or that is `SHARED` is one."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    labels = F.split(bare, "[.]")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i + 1, 1_000_000), "."))
    domains = F.filter(above, lambda h: h.contains(".") & ~h.rlike(SHARED) & ~h.startswith("."))
    chain = F.when(bare.rlike(ADDRESS), F.array(bare)).otherwise(F.concat(F.array(bare), domains))
    return F.filter(F.array_distinct(F.concat(F.array(host), chain)), lambda h: h != "")


def host_links(pages: DataFrame) -> DataFrame:
    """a, b, n: links between different hosts in the html of `pages` (host, html), and between hosts and the domains above them."""
    linked = pages.select(F.col("host").alias("a"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("b")).select("a", ascii_lower(F.col("b")).alias("b"))
    out = linked.filter("a != b and a != '' and b != ''").groupBy("a", "b").agg(F.count("*").alias("n"))
    out = stage(out, "links")
    hosts = pages.select("host").distinct().unionByName(out.select(F.col("b").alias("host"))).distinct()
    chains = hosts.select(parents_of(F.col("host")).alias("h")).filter("size(h) > 1")
    parents = chains.select(F.explode(F.arrays_zip(F.slice("h", 1, F.size("h") - 1).alias("a"), F.slice("h", 2, F.size("h")).alias("b"))).alias("x")).select("x.a", "x.b").filter("a is not null and b is not null").distinct()
    both = parents.unionByName(parents.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("n", F.lit(1).cast("long"))
    return out.unionByName(both).groupBy("a", "b").agg(F.sum("n").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust and distrust from seeds (host, trust, distrust) over links (a, b, n).

    Every step is written to the shared folder; steps end when no host gains more than `tolerance` of its own trust or of
    its own distrust. A first score is all of it, so every host that a seed reaches has one, whatever the other hosts have.
    Once that holds it holds in all later steps, as a host passes on what arrives as it passed on all that it has.
    """
    onward = links.groupBy("a").agg(F.sum("n").alias("all")).join(links, "a").select(F.col("a").alias("host"), F.col("b").alias("to"), (F.col("n") / F.col("all")).alias("forward"), F.lit(0.0).alias("backward"))
    back = links.groupBy("b").agg(F.sum("n").alias("all")).join(links, "b").select(F.col("b").alias("host"), F.col("a").alias("to"), F.lit(0.0).alias("forward"), (F.col("n") / F.col("all")).alias("backward"))
    steps = stage(onward.unionByName(back).groupBy("host", "to").agg(F.sum("forward").alias("forward"), F.sum("backward").alias("backward")), "steps")
    # What is new in a step moves on in the next; the scores are the sum of all that arrived.
    scores = moving = stage(seeds.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust")), "scores")
    while True:
        arrived = moving.join(steps, "host").groupBy("to").agg(F.sum(damping * F.col("trust") * F.col("forward")).alias("trust"), F.sum(damping * F.col("distrust") * F.col("backward")).alias("distrust"))
        moving = stage(arrived.select(F.col("to").alias("host"), "trust", "distrust").filter("trust > 0 or distrust > 0"), "moving")
        old = scores.select("host", "trust", "distrust", F.lit(0.0).alias("t"), F.lit(0.0).alias("d"))
        both = old.unionByName(moving.select("host", "trust", "distrust", F.col("trust").alias("t"), F.col("distrust").alias("d")))
        state = stage(both.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("trust", "distrust", "t", "d")]), "scores")
        scores = state.select("host", "trust", "distrust")
        if state.filter((F.col("t") > tolerance * F.col("trust")) | (F.col("d") > tolerance * F.col("distrust"))).isEmpty():
            return scores


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, block_from: float = BLOCK_FROM) -> DataFrame:
    """Per row of `pages` (page_id, url, html): page_id, host, path, rule, verdict, and trust and distrust of its host.

    A host that nothing is known of, such as the empty host of null urls and urls without `://`, is allowed.
    """
    ruled = judged(pages.select("page_id", "url", "html"), rules)
    links = stage(host_links(ruled.select("host", "html")), "host-links")
    pages_ = ruled.select("page_id", "host", "path", "rule", "ruled")
    seeds = pages_.filter("ruled is not null and host != ''").groupBy("host").agg(F.count(F.when(F.col("ruled") == "allow", 1)).cast("double").alias("trust"), F.count(F.when(F.col("ruled") == "block", 1)).cast("double").alias("distrust"))
    scores = stage(propagate(seeds, links), "scores")
    blocked = (F.col("distrust") > 0) & (F.col("distrust") >= block_from * (F.col("trust") + F.col("distrust")))
    method = F.when(blocked, "block").otherwise("allow")
    return pages_.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")
