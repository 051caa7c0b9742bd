"""Operator 2: URL filter by rules and by trust and distrust over the host graph.

Rules decide the urls they fit, the longest first. The rest follow their host: personalised PageRank
spreads trust from hosts with allowed pages along links, and distrust from hosts with blocked pages against
links (who links to bad hosts is suspect). Edges are absolute links between hosts, counted per page, and a
two-way tie between a host and its parent domain. A host is blocked if its distrust exceeds ``ratio``
times its trust.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed;
hosts that no seed reaches are allowed; null html has no links; repeated rows count as pages each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialise

#: Fixed values: (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/"'?#\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in rules]
    order = sorted(range(len(rules)), key=lambda k: -len(rules[k][1] + rules[k][2]))
    rule = F.coalesce(*[F.when(fits[k], F.lit(rules[k][1] + rules[k][2])) for k in order])
    verdict = F.coalesce(*[F.when(fits[k], F.lit(rules[k][0])) for k in order])
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, weight)`` from ``pages(host, html)``."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)))
    links = pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst")).filter("src <> dst AND src <> '' AND dst <> ''")
    links = links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hosts = pages.select("host").distinct().unionByName(links.select(F.col("dst").alias("host"))).distinct()
    labels = F.split("host", r"\.")
    # a.b.c.d has the parents b.c.d and c.d: each is tied to the next
    chain = F.transform(F.sequence(F.lit(0), F.size(labels) - 2), lambda k: F.array_join(F.slice(labels, k + 1, F.size(labels)), "."))
    named = hosts.select(F.explode(F.when(F.size(labels) >= 2, chain)).alias("host")).distinct()
    up = named.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]*\.(.+)$", 1).alias("dst")).filter("instr(dst, '.') > 0")
    ties = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    return links.unionByName(ties).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 12, cut_every: int = 3) -> DataFrame:
    """``(kind, host, score)``: PageRank personalised to ``seeds(kind, host, score)``.

    ``edges(kind, src, dst, share)`` hold both directions, so trust and distrust move in one join. What a host without
    outgoing edges would pass on is lost.
    """
    rank = seeds
    for k in range(rounds):
        moved = rank.join(edges.withColumnRenamed("src", "host"), ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share") * damping).alias("score"))
        fresh = seeds.withColumn("score", F.col("score") * (1 - damping))
        rank = moved.unionByName(fresh).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % cut_every == cut_every - 1 or k == rounds - 1:
            rank = materialise(rank)
    return rank


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple = RULES, ratio: float = 1.0, damping: float = 0.85, rounds: int = 12) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` of every row."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).alias("html"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": ruled})
    edges = materialise(host_edges(rows))
    both = edges.select(F.lit("allow").alias("kind"), "src", "dst", "weight").unionByName(edges.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("all"))
    shares = materialise(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("all")).alias("share")))
    seeds = rows.filter("ruled IS NOT NULL AND host <> ''").groupBy(F.col("ruled").alias("kind"), "host").agg(F.count(F.lit(1)).cast("double").alias("score"))
    total = seeds.groupBy("kind").agg(F.sum("score").alias("all"))
    seeds = materialise(seeds.join(total, "kind").select("kind", "host", (F.col("score") / F.col("all")).alias("score")))
    rank = propagate(shares, seeds, damping, rounds)
    scores = rank.groupBy(F.col("host").alias("__host")).agg(*[F.round(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)), 12).alias(n) for k, n in (("allow", "trust"), ("block", "distrust"))])
    judged = rows.drop("html").join(scores, rows["host"] == scores["__host"], "left").drop("__host")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    verdict = F.coalesce("ruled", F.when(distrust > trust * ratio, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))

