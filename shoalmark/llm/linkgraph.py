"""Host verdicts from a link graph (operator 7), in DataFrame functions only.

Hosts link to hosts: by the absolute links in the pages, and a host to its parent domain and back, as
sites of one owner do. Trust is a personalised PageRank that restarts at hosts which an allow rule fits;
distrust runs on the reversed links and restarts at hosts which a block rule fits. A page with a rule
gets the rule's verdict; any other gets its host's: block, if the host's distrust is at least ``ratio``
times its trust and above zero, else allow.

All steps are joins and sums with map-side combine on hosts, so a host with a third of all pages is one
row after the first sum. Links of one page to one host count once for each occurrence.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and is allowed;
repeated pages are judged each; null html has no links; an empty table gives no rows; ties between rules
cannot occur, as the longest path wins and hosts differ in length or name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, lower_ascii, table

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING, STEPS, RATIO = 0.85, 12, 1.0


def split_url(pages: DataFrame) -> DataFrame:
    """Adds host and path; a clashing column is replaced."""
    df = pages.withColumn("u", F.coalesce("url", F.lit("")))
    after = F.expr("case when locate('://', u) > 0 then substring(u, locate('://', u) + 3) else '' end")
    df = df.withColumn("u", after)
    df = df.withColumn("host", lower_ascii(F.regexp_extract("u", r"^[^/?#]*", 0)))
    # the path is what follows the host up to a query or fragment
    return df.withColumn("path", F.regexp_extract("u", r"(?s)^[^/?#]*([^?#]*)", 1)).drop("u")


def fits(host: Column, rule_host: str) -> Column:
    return (host == rule_host) | host.endswith("." + rule_host)


def with_rule(df: DataFrame) -> DataFrame:
    """Adds rule (`host/path`, null if none fits) and said (its verdict)."""
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    hit = [(fits(F.col("host"), h) & F.col("path").startswith(p), h + p, v) for v, h, p in order]
    chain = lambda k: reduce(lambda acc, x: acc.when(x[0], x[k]), hit[1:], F.when(hit[0][0], hit[0][k]))
    return df.withColumn("rule", chain(1)).withColumn("said", chain(2))


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    found = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)(?:href|src)\s*=\s*[\"']?[a-z][a-z0-9+.-]*://([^/?#\"'\s<>]+)"), 1)).alias("to"))
    found = found.select(F.col("host").alias("src"), lower_ascii(F.col("to")).alias("dst"))
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = pages.select("host").distinct().select(F.explode(above).alias("host")).distinct()  # and all their parents
    parent = F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1)
    up = hosts.select(F.col("host").alias("src"), parent.alias("dst")).where("dst <> ''")
    tree = up.union(up.select("dst", "src"))
    ok = (F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")
    counted = found.where(ok).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.union(tree.where(ok).distinct().withColumn("n", F.lit(1).cast("long")))
    return counted.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def rank(edges: DataFrame, seeds: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """(host, score) of a random walk along src -> dst that restarts at the (host, weight) seeds."""
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    flow = keep(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")), "flow")
    total = seeds.agg(F.sum("weight").alias("t"))
    start = keep(seeds.crossJoin(F.broadcast(total)).select("host", (F.col("weight") / F.col("t")).alias("score")), "seeds")
    score = start
    for i in range(steps):
        moved = flow.join(score, flow.src == score.host).groupBy(F.col("dst").alias("host")).agg(
            F.sum(F.col("share") * F.col("score") * damping).alias("score")
        )
        score = moved.union(start.select("host", F.col("score") * (1 - damping))).groupBy("host").agg(F.sum("score").alias("score"))
        if i % 4 == 3 or i == steps - 1:
            score = keep(score, "rank")
    return score


def judge(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """The rows of ``pages`` (page_id, url, html) with host, path, rule, verdict and the host's two scores."""
    url = with_rule(split_url(pages))
    edges = keep(links(url), "links")
    seeds = keep(url.where("said is not null").groupBy("host", "said").agg(F.count(F.lit(1)).cast("double").alias("weight")), "said")
    trust = rank(edges, seeds.where("said = 'allow'").select("host", "weight"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = rank(back, seeds.where("said = 'block'").select("host", "weight"))
    host = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
    out = url.select("page_id", "host", "path", "rule", "said").join(host, "host", "left")
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    own = F.when((d > 0) & (d >= ratio * t), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), t.alias("trust"), d.alias("distrust"))


def op7_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
