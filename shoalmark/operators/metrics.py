"""Offline metrics of ranked lists, splits of an interaction log, business figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int, case: str = "case") -> DataFrame:
    """case, recall, precision, ap, ndcg at k of (case, pos from 1, item) against (case, item)."""
    rel = relevant.select(case, "item").distinct()
    n = rel.groupBy(case).agg(F.count(F.lit(1)).alias("n"))
    r = ranked.where(F.col("pos") <= k).join(rel.withColumn("hit", F.lit(1)), [case, "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    run = F.sum("hit").over(Window.partitionBy(case).orderBy("pos"))
    r = r.withColumn("gain", F.when(F.col("hit") == 1, run / F.col("pos")).otherwise(0.0))
    a = r.groupBy(case).agg(
        F.count_distinct(F.when(F.col("hit") == 1, F.col("item"))).alias("hits"), F.sum("gain").alias("gain"),
        F.sum(F.col("hit") / F.log2(F.col("pos") + 1)).alias("dcg"),
    )
    best = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    z = lambda c: F.coalesce(c, F.lit(0))
    return n.join(a, case, "left").select(
        case, (z("hits") / F.col("n")).alias("recall"), (z("hits") / F.lit(float(k))).alias("precision"),
        (z("gain") / F.least("n", F.lit(k))).alias("ap"), (z("dcg") / best).alias("ndcg"),
    )


def shelf_metrics(ranked: DataFrame, products: DataFrame, inventory: DataFrame, case: str = "case") -> DataFrame:
    """case, in_stock_rate and category_diversity over the rows returned; no stock row counts as 0."""
    r = ranked.join(products.select(F.col("product_id").alias("item"), "category"), "item", "left")
    r = r.join(inventory.select(F.col("product_id").alias("item"), "stock"), "item", "left")
    return r.groupBy(case).agg(
        F.avg((F.coalesce("stock", F.lit(0)) > 0).cast("double")).alias("in_stock_rate"), F.count_distinct("category").alias("category_diversity")
    )


def citation_coverage(evidence: str = "evidence") -> Column:
    return F.avg((F.size(evidence) > 0).cast("double"))


def last_purchase(events: DataFrame, user: str, ts: str, *tie: str) -> DataFrame:
    """Rows with ``holdout``: each user's last purchase is held out; rows without a time never are."""
    w = Window.partitionBy(user).orderBy(F.desc_nulls_last(ts), *(F.desc(t) for t in tie))
    return events.withColumn("holdout", (F.row_number().over(w) == 1) & F.col(ts).isNotNull())


def user_scan(tx: DataFrame) -> DataFrame:
    """uidx, purchases, dates, last date and rows on it."""
    last = F.max("day").over(Window.partitionBy("uidx"))
    t = tx.select("uidx", "day", last.alias("last"))
    return t.groupBy("uidx").agg(
        F.count(F.lit(1)).alias("purchases"), F.count_distinct("day").alias("n_dates"), F.max("last").alias("last_day"), F.count(F.when(F.col("day") == F.col("last"), 1)).alias("last_rows")
    )


def quotas(sizes: DataFrame, n: int) -> DataFrame:
    """(cell, size) to (cell, quota): largest remainders; cells of quota 0 go. One row per cell."""
    total = sizes.agg(F.sum("size").alias("total"))
    s = sizes.crossJoin(F.broadcast(total)).withColumn("share", F.col("size") * n / F.col("total"))
    s = s.withColumn("base", F.floor("share")).withColumn("frac", F.round(F.col("share") - F.col("base"), 9))
    left = F.lit(n) - F.sum("base").over(Window.partitionBy())
    r = F.row_number().over(Window.orderBy(F.desc("frac"), "cell"))
    s = s.withColumn("quota", F.col("base") + F.when(r <= left, 1).otherwise(0))
    return s.where("quota > 0").select("cell", "quota")


def cohort(scan: DataFrame, strata: DataFrame, n: int) -> DataFrame:
    """uidx, cell: the most active users of each stratum up to its quota."""
    df = scan.join(strata, "uidx", "left").withColumn("cell", F.coalesce("cell", F.lit("(nan)")))
    q = quotas(df.groupBy("cell").agg(F.count(F.lit(1)).alias("size")), n)
    w = Window.partitionBy("cell").orderBy(F.desc("n_dates"), F.desc("purchases"), "uidx")
    return df.join(F.broadcast(q), "cell").withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("quota")).select("uidx", "cell")


def pick_of_last_day(tx: DataFrame, pick: Column) -> DataFrame:
    """uidx, iidx, day: of the rows on a user's last day the one at index ``pick`` mod their number."""
    w = Window.partitionBy("uidx").orderBy(F.desc("day"), "iidx", "okey", "line")
    last = F.max("day").over(Window.partitionBy("uidx"))
    t = tx.withColumn("last", last).where("day = last")
    t = t.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("uidx")))
    return t.where(F.col("i") == F.pmod(pick, F.col("n"))).select("uidx", "iidx", "day")


def business_summary(recs: DataFrame) -> DataFrame:
    return recs.agg(
        F.count(F.lit(1)).alias("n_recommendations"), F.coalesce(F.avg((F.col("stock") > 0).cast("double")), F.lit(0.0)).alias("in_stock_rate"),
        F.coalesce(F.avg("margin"), F.lit(0.0)).alias("avg_margin"), F.coalesce(F.avg("return_rate"), F.lit(0.0)).alias("avg_return_rate"),
        F.count_distinct("category").alias("category_diversity"),
    )


def business_notes(summary: DataFrame) -> DataFrame:
    """A verdict per figure: good or risk."""
    v = lambda c: F.when(c, "good").otherwise("risk")
    return summary.select(
        v(F.col("in_stock_rate") >= 0.8).alias("availability"), v(F.col("avg_margin") >= 0.40).alias("margin"),
        v(F.col("avg_return_rate") <= 0.10).alias("return_risk"), v(F.col("category_diversity") >= 3).alias("diversity"),
    )
