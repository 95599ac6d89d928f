"""URL rules, and host verdicts by propagation over the link graph (operator 6). DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, release, settle, settled

#: Verdict and rule; a rule is a host, which stands for its subdomains too, and the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Part of a host's score that its links pass on, and the mass still on its way, as a part of the host's score, that ends the rounds.
DAMPING, CHANGE = 0.85, 1e-6
#: A host is blocked if its distrust is this part of its trust and distrust together, or more.
BLOCK_SHARE = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)


def ruled(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Adds host, path, rule and the rule's verdict (null where none fits) for a `url`; the longest rule wins."""
    host, path = host_and_path(F.col("url"))
    rows = pages.withColumns({"host": host, "path": path})
    which = verdict = None
    for kind, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)
        which = F.when(fits, rule) if which is None else which.when(fits, rule)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return rows.withColumns({"rule": which if rules else none, "by_rule": verdict if rules else none})


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, summed before any shuffle; relative links stay on their host."""
    src, _ = host_and_path(F.col("url"))
    out = pages.select(src.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), F.col("to"))).otherwise(F.col("to"))
    return out.select("src", host_and_path(to)[0].alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def scores(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, change: float = CHANGE) -> DataFrame:
    """(host, trust, distrust) for edges (src, dst, n) and seeds (host, trust, distrust: weights).

    Trust is the personalised PageRank from trusted seeds along the links; distrust that from blocked seeds against
    them, since who links to a blocked host shares the blame. Both run in one table. Mass of hosts without links to
    follow ends there. A round passes on what arrived in the round before and adds it to the scores; it is only passed on
    by hosts where it is more than `change` of their score, so rounds end when no host is reached for the first time and
    no score moves by more: whatever the number of hosts and the length of paths. Every round is checkpointed.
    """
    total = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    kinds = F.array(F.struct(F.lit("t").alias("kind"), F.col("trust").alias("w")), F.struct(F.lit("d").alias("kind"), F.col("distrust").alias("w")))
    start = seeds.select("host", F.inline(kinds)).where("w > 0")
    whole = F.when(F.col("kind") == "t", F.lit(float(total["t"] or 1))).otherwise(F.lit(float(total["d"] or 1)))
    start = settle(start.select("kind", "host", ((1 - damping) * F.col("w") / whole).alias("score")))
    edges = settle(edges)
    ahead = edges.select(F.lit("t").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
    back = edges.select(F.lit("d").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    steps = ahead.unionByName(back)
    sums = settle(steps.groupBy("kind", "host").agg(F.sum("n").alias("all")))
    steps = settle(steps.join(sums, ["kind", "host"]).select("kind", "host", "to", (damping * F.col("n") / F.col("all")).alias("share")))
    # score: all that has arrived at a host; fresh: the part of it that it has not passed on yet.
    now, left = start.withColumn("fresh", F.col("score")), not steps.isEmpty()
    while left:
        goes = F.col("fresh") > change * F.col("score")
        moved = now.where(goes).join(steps, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("fresh") * F.col("share")).alias("score"))
        stays = now.select("kind", "host", "score", F.when(goes, 0.0).otherwise(F.col("fresh")).alias("fresh"))
        both = moved.select("kind", "host", "score", F.col("score").alias("fresh")).unionByName(stays)
        now, n = settled(both.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("fresh").alias("fresh")))
        left = not now.where(F.col("fresh") > change * F.col("score")).isEmpty()
        release(seeds.sparkSession)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0))
    return now.groupBy("host").agg(of("t").alias("trust"), of("d").alias("distrust"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, block_share: float = BLOCK_SHARE) -> DataFrame:
    """Per row of `pages` (page_id, url, html): page_id, host, path, rule, verdict, trust and distrust of its host.

    Where a rule fits, its verdict holds. Other pages get their host's: seeds are hosts by the number of their pages
    that rules allow or block, and a host whose distrust is at least `block_share` of both scores is blocked. Hosts that no
    score reaches, empty hosts (null urls, or none) and all hosts without seeds are allowed. A null html has no links; one
    of any length is searched whole. Repeated rows each count and are each judged; other columns are not looked at. An
    empty table gives no rows.
    """
    pages = pages.select("page_id", "url", "html")
    rows = settle(ruled(pages.select("page_id", "url"), rules).drop("url"))
    seeds = rows.where("by_rule IS NOT NULL AND host <> ''").groupBy("host").agg(
        F.count_if(F.col("by_rule") == "allow").alias("trust"), F.count_if(F.col("by_rule") == "block").alias("distrust")
    )
    hosts = settle(scores(links(pages), settle(seeds)))
    both = F.col("trust") + F.col("distrust")
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= block_share * both)
    return rows.join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir, "pages")).drop("trust", "distrust")
