"""From rule outputs to one candidate row per (user, item): normalise, trim, pivot, cap."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rules import top
from .store import hold

#: Rows of rule outputs that one task pivots.
ROWS = 500_000


def union(outputs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, outputs)


def normal_scores(out: DataFrame) -> DataFrame:
    """Each rule's scores as normal quantiles of their mid-rank in the rule (clipped at 5.2)."""

    @F.pandas_udf("double")
    def inverse(p: pd.Series) -> pd.Series:
        f = NormalDist().inv_cdf
        return p.map(lambda x: f(min(max(x, 1e-7), 1 - 1e-7)))

    # scores are dealt by range and summed within a range and over the ranges before it: a rule may have as many as rows
    per = out.groupBy("method", "score").agg(F.count(F.lit(1)).alias("m"))
    parts = int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = hold(per.repartitionByRange(parts, "method", "score").withColumn("part", F.spark_partition_id()), "scores")
    sums = per.groupBy("method", "part").agg(F.sum("m").alias("own"))
    rule = Window.partitionBy("method")
    sums = sums.select("method", "part", F.coalesce(F.sum("own").over(rule.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("own").over(rule).alias("total"))
    w = Window.partitionBy("method", "part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("below", F.coalesce(F.sum("m").over(w), F.lit(0))).join(F.broadcast(sums), ["method", "part"])  # ranges and rules
    below, total = F.col("before") + F.col("below"), F.col("total")
    mid = per.withColumn("q", (below + (F.col("m") - 1) / 2) / F.greatest(total - 1, F.lit(1)))
    mid = mid.withColumn("z", inverse("q")).select("method", "score", "z")
    return out.join(mid, ["method", "score"]).select("uidx", "iidx", "method", F.col("z").alias("score"))


def trim(out: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Per rule: if its positive rate is under ``least``, keep its ranks up to the last at which the running rate is above.

    Ranks are average ranks of the score per user. Only users with labels count then; a rule that never reaches the
    rate goes, and one that just reaches it keeps the ranks up to there.
    """
    lab = labels.select("uidx", "iidx").distinct().withColumn("label", F.lit(1))
    known = labels.select("uidx").distinct()
    df = out.join(known, "uidx", "left_semi").join(lab, ["uidx", "iidx"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    w = Window.partitionBy("uidx", "method").orderBy(F.desc("score"))
    ties = F.count(F.lit(1)).over(Window.partitionBy("uidx", "method", "score"))
    df = df.withColumn("rank", F.ceil(F.rank().over(w) + (ties - 1) / 2))
    by = df.groupBy("method", "rank").agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("method").orderBy("rank")
    by = by.withColumn("rate", F.sum("hits").over(run) / F.sum("n").over(run))
    above, at = (F.max(F.when(c, F.col("rank"))) for c in (F.col("rate") > least, F.col("rate") == least))
    limit = by.groupBy("method").agg(F.coalesce(above, at).alias("limit"), (F.sum("hits") / F.sum("n")).alias("all"))
    good = limit.where(F.col("all") >= least).select("method")
    cut = limit.where((F.col("all") < least) & F.col("limit").isNotNull())
    kept = df.join(F.broadcast(cut), "method").where(F.col("rank") <= F.col("limit")).select("uidx", "iidx", "method", "score")
    return out.join(F.broadcast(good), "method", "left_semi").select("uidx", "iidx", "method", "score").unionByName(kept)


def pivot(out: DataFrame, methods: list[str]) -> DataFrame:
    """One column per rule of a fixed list; null where the rule did not give the pair.

    Rows are dealt by user, into parts of a bounded number: what follows goes by user too.
    """
    return out.groupBy("uidx", "iidx").pivot("method", methods).agg(F.sum("score"))


def collect(outputs: list[DataFrame], methods: list[str], labels: DataFrame | None = None, gone: DataFrame | None = None, least: float | None = None, norm: bool = False) -> DataFrame:
    """Scores are normalised over all that a rule gives; only then out-of-stock items go."""
    out = hold(union(outputs), "outputs")
    parts = max(int(out.sparkSession.conf.get("spark.sql.shuffle.partitions")), out.count() // ROWS)
    if norm:
        out = hold(normal_scores(out), "normal") if labels is not None and least else normal_scores(out)
    if gone is not None:
        out = out.join(gone.select("iidx"), "iidx", "left_anti")
    if labels is not None and least:
        out = trim(out, labels, least)
    return pivot(out.repartition(parts, "uidx"), methods)


def cap(cand: DataFrame, methods: list[str], n: int = 200) -> DataFrame:
    """Min-max scale each rule's column, sum what is there, keep each user's n best; adds score and rank."""
    ends = cand.agg(*(f(m).alias(f"{a}_{m}") for m in methods for a, f in (("lo", F.min), ("hi", F.max))))
    df = cand.crossJoin(F.broadcast(ends))
    one = [F.coalesce((F.col(m) - F.col(f"lo_{m}")) / F.when(F.col(f"hi_{m}") > F.col(f"lo_{m}"), F.col(f"hi_{m}") - F.col(f"lo_{m}")).otherwise(1.0), F.lit(0.0)) for m in methods]
    df = df.withColumn("score", F.round(reduce(lambda a, b: a + b, one), 9)).drop(*(f"{a}_{m}" for m in methods for a in ("lo", "hi")))
    w = Window.partitionBy("uidx").orderBy(F.desc("score"), "iidx")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def fuse(lists: DataFrame, top_k: int) -> DataFrame:
    """(uidx, iidx, score, rank) of ranked lists (uidx, list_no, weight, iidx, pos): sum of weight / (pos + 1), pos from 0."""
    s = lists.groupBy("uidx", "iidx").agg(F.sum(F.col("weight") / (F.col("pos") + 1)).alias("score"), F.min(F.struct("list_no", "pos")).alias("first"))
    s = s.withColumn("score", F.round("score", 9))
    w = Window.partitionBy("uidx").orderBy(F.desc("score"), "first", "iidx")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).drop("first")


def best_first(cand: DataFrame, n: int) -> DataFrame:
    """The n items of highest probability per user, each once."""
    one = cand.groupBy("uidx", "iidx").agg(F.max("prob").alias("prob"))
    return top(one, n, ["uidx"], F.desc("prob"), F.col("iidx"))
