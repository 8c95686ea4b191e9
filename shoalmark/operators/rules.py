"""Candidate rules over a purchase log (uidx, iidx, day): each gives (uidx, iidx, method, score).

Orderings end in an id, so results do not depend on partitioning. Row-numbered top-n windows are cut early
by the planner's group limit; group and global lists are joined to users, and only lists of at most n rows
are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .topn import nearest as nearest

# The decay curve a / sqrt(gap) + b * exp(-c * gap) - d, and the least kept value.
DECAY_A, DECAY_B, DECAY_C, DECAY_D, DECAY_LEAST = 2.5e4, 1.5e5, 0.2, 1e3, 150
COLUMNS = ["uidx", "iidx", "method", "score"]


def named(df: DataFrame, method: str, score: Column) -> DataFrame:
    return df.select("uidx", "iidx", F.lit(method).alias("method"), score.cast("double").alias("score"))


def top(df: DataFrame, n: int | None, keys: list[str], *order: Column) -> DataFrame:
    if n is None:
        return df
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def last_day(tx: DataFrame) -> DataFrame:
    return tx.agg(F.max("day").alias("last"))


def with_last(tx: DataFrame) -> DataFrame:
    """Adds the last day of the log, a one-row side."""
    return tx.crossJoin(F.broadcast(last_day(tx)))


def trailing(tx: DataFrame, days: int) -> DataFrame:
    return with_last(tx).where(F.col("day") >= F.col("last") - (days - 1)).drop("last")


def before(tx: DataFrame, day: int) -> DataFrame:
    return tx.where(F.col("day") < day)


def order_history(tx: DataFrame, days: int, n: int | None = None, name: str = "1") -> DataFrame:
    own = F.max("day").over(Window.partitionBy("uidx"))
    df = tx.select("uidx", "iidx", (own - F.col("day")).alias("diff")).where(F.col("diff") < days)
    df = df.groupBy("uidx", "iidx").agg(F.min("diff").alias("diff"))
    return named(top(df, n, ["uidx"], F.col("diff"), F.col("iidx")), f"OrderHistory_{name}", -F.col("diff"))


def decay_values(tx: DataFrame, days: int) -> DataFrame:
    """uidx, iidx, value of each purchase: decayed and times sales now by sales in its own period."""
    df = with_last(tx.select("uidx", "iidx", "day"))
    age = F.col("last") - F.col("day")
    df = df.select("uidx", "iidx", F.greatest(age, F.lit(1)).alias("gap"), F.floor(age / days).alias("period"))
    sales = df.groupBy("period", "iidx").agg(F.count(F.lit(1)).alias("own"))
    now = sales.where("period = 0").select("iidx", F.col("own").alias("now"))
    curve = DECAY_A / F.sqrt("gap") + DECAY_B * F.exp(-DECAY_C * F.col("gap")) - DECAY_D
    df = df.join(sales, ["period", "iidx"]).join(now, "iidx", "left")
    value = F.greatest(curve, F.lit(0.0)) * (F.coalesce("now", F.lit(0)) / F.col("own"))
    return df.select("uidx", "iidx", value.alias("value"))


def order_history_decay(tx: DataFrame, days: int, n: int | None = None, name: str = "1") -> DataFrame:
    df = decay_values(tx, days).groupBy("uidx", "iidx").agg(F.sum("value").alias("value")).where(F.col("value") > DECAY_LEAST)
    return named(top(df, n, ["uidx"], F.desc("value"), F.col("iidx")), f"OrderHistoryDecay_{name}", F.col("value"))


def item_pair(base: DataFrame, name: str = "1") -> DataFrame:
    """Each base item's most frequent partner among the base rule's own output."""
    src = base.select("uidx", "iidx").distinct()
    pairs = src.join(src.withColumnRenamed("iidx", "pair"), "uidx").where("iidx <> pair")
    pairs = pairs.groupBy("iidx", "pair").agg(F.count(F.lit(1)).alias("count"))
    best = top(pairs, 1, ["iidx"], F.desc("count"), F.col("pair"))
    got = top(src.join(best, "iidx"), 1, ["uidx", "pair"], F.col("iidx")).drop("iidx").withColumnRenamed("pair", "iidx")
    return named(got, f"ItemPairRetrieve_{name}", F.col("count"))


def item_cf_sim(hist: DataFrame, top_k: int = 10, group: str | None = None, least: int = 5) -> DataFrame:
    """(group, iidx, related, weight): sequence co-occurrence, order and distance weighted.

    Positions are numbered per user by (day, iidx); pairs come from an equi-join on the user. A user's
    pairs grow with the square of the history, so feed it a bounded window of days.
    """
    keys = [group] if group else []
    w = Window.partitionBy("uidx").orderBy("day", "iidx", *(c for c in ("okey", "line") if c in hist.columns))
    seq = hist.withColumn("pos", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("uidx")))
    a = seq.select("uidx", *keys, "iidx", "pos", "n").where("pos < n - 1")
    b = seq.select("uidx", F.col("iidx").alias("related"), F.col("pos").alias("at"))
    side = F.when(F.col("at") > F.col("pos"), 1.0).otherwise(0.9)
    weight = side * F.pow(F.lit(0.7), F.abs(F.col("at") - F.col("pos")) - 1) / F.ln(1 + F.col("n"))
    sim = a.join(b, "uidx").where("pos <> at").groupBy(*keys, "iidx", "related").agg(F.sum(weight).alias("weight"))
    many = F.count(F.lit(1)).over(Window.partitionBy(*keys, "iidx"))
    sim = sim.withColumn("k", many).where(F.col("k") >= least).drop("k")
    return top(sim, top_k, [*keys, "iidx"], F.desc(F.round("weight", 9)), F.col("related"))


def item_cf_predict(sim: DataFrame, target: DataFrame, name: str = "1", group: str | None = None) -> DataFrame:
    keys = [group] if group else []
    t = target.select("uidx", *keys, "iidx").distinct()
    got = t.join(sim, [*keys, "iidx"]).select("uidx", F.col("related").alias("iidx"), "weight")
    return named(got, f"{'UG' if group else ''}ItemCF_{name}", F.col("weight"))


def to_users(lists: DataFrame, users: DataFrame, key: str | None, n: int, method: str, score: Column) -> DataFrame:
    """Attach lists of a group, or one global list, to users; a global list has at most n rows."""
    got = users.join(lists, key) if key else users.crossJoin(F.broadcast(lists.limit(n)))
    return named(got, method, score)


def time_history(win: DataFrame, users: DataFrame, n: int = 50, name: str = "1") -> DataFrame:
    cnt = win.select("uidx", "iidx").distinct().groupBy("iidx").agg(F.count(F.lit(1)).alias("count"))
    cnt = cnt.orderBy(F.desc("count"), "iidx").limit(n)
    return to_users(cnt, users.select("uidx"), None, n, f"TimeHistory_{name}", F.col("count"))


def time_history_decay(tx: DataFrame, users: DataFrame, days: int = 7, n: int = 50, name: str = "1") -> DataFrame:
    cnt = decay_values(tx, days).groupBy("iidx").agg(F.sum("value").alias("value"))
    cnt = cnt.orderBy(F.desc(F.round("value", 6)), "iidx").limit(n)
    return to_users(cnt, users.select("uidx"), None, n, f"TimeHistoryDecay_{name}", F.col("value"))


def window_counts(tx: DataFrame, days: int, keys: list[str]) -> DataFrame:
    """keys, recent, previous: sales in the last ``days`` and the ``days`` before, in one pass."""
    gap = F.col("last") - F.col("day")
    recent, prev = F.count(F.when(gap <= days - 1, 1)), F.count(F.when(gap > days - 1, 1))
    return with_last(tx).where(gap <= 2 * days - 1).groupBy(*keys).agg(recent.alias("recent"), prev.alias("previous"))


def sale_trend(tx: DataFrame, users: DataFrame, days: int = 7, n: int = 50, t: float = 0.8, name: str = "1") -> DataFrame:
    log = window_counts(tx, days, ["iidx"]).where("previous > 0")
    log = log.withColumn("trend", (F.col("recent") - F.col("previous")) / F.col("previous")).where(F.col("trend") > t)
    log = log.orderBy(F.desc("recent"), F.desc("trend"), "iidx").limit(n)
    return to_users(log, users.select("uidx"), None, n, f"SaleTrend_{name}", F.col("trend"))


def in_group(log: DataFrame, users: DataFrame, group: str) -> DataFrame:
    """The log with its buyers' group; a buyer without one is in group 0."""
    zero = F.lit(0).cast(users.schema[group].dataType)
    return log.join(users, "uidx", "left").withColumn(group, F.coalesce(group, zero))


def ug_time_history(win: DataFrame, users: DataFrame, group: str, n: int = 50, scale: bool = False, name: str = "1") -> DataFrame:
    own = users.select("uidx", group)
    cnt = in_group(win.select("uidx", "iidx").distinct(), own, group).groupBy(group, "iidx").agg(F.count(F.lit(1)).alias("count"))
    cnt = top(cnt, n, [group], F.desc("count"), F.col("iidx"))
    score = F.col("count").cast("double")
    if scale:
        cnt = cnt.crossJoin(F.broadcast(cnt.agg(F.max("count").alias("most"))))
        score = F.col("count") / F.col("most")
    return to_users(cnt, own, group, n, f"UGTimeHistory_{name}", score)


def ug_sale_trend(tx: DataFrame, users: DataFrame, group: str, days: int = 7, n: int = 50, t: float = 0.8, name: str = "1") -> DataFrame:
    own = users.select("uidx", group)
    log = window_counts(in_group(tx, own, group), days, [group, "iidx"]).where("previous > 0")
    log = log.withColumn("trend", (F.col("recent") - F.col("previous")) / (F.col("previous") + 1)).where(F.col("trend") > t)
    log = top(log, n, [group], F.desc("recent"), F.desc("trend"), F.col("iidx"))
    return to_users(log, own, group, n, f"UGSaleTrend_{name}", F.col("trend"))


def out_of_stock(tx: DataFrame, days: int = 30) -> DataFrame:
    """iidx whose sales fell by over 80 % or to nothing."""
    c = window_counts(tx, days, ["iidx"]).where("previous > 0")
    return c.where(((F.col("recent") - F.col("previous")) / F.col("previous") < -0.8) | (F.col("recent") == 0))


def recent_pool(tx: DataFrame, days: int = 5, size: int | None = 1000) -> DataFrame:
    """The ``size`` most sold items of the last ``days``, or all that were sold then."""
    pool = with_last(tx).where(F.col("day") > F.col("last") - days).groupBy("iidx").agg(F.count(F.lit(1)).alias("count"))
    return pool if size is None else pool.orderBy(F.desc("count"), "iidx").limit(size)


def triple_tables(tx: DataFrame, items: DataFrame, k: int = 200, days: int | None = 28) -> DataFrame:
    """(cat_code, style_code, occ_code, iidx, pop, pos): the k most sold items of each triple."""
    sold = (trailing(tx, days) if days else tx).groupBy("iidx").agg(F.count(F.lit(1)).alias("pop"))
    t = ["cat_code", "style_code", "occ_code"]
    a = items.select("iidx", *t).join(sold, "iidx", "left").withColumn("pop", F.coalesce("pop", F.lit(0)))
    w = Window.partitionBy(*t).orderBy(F.desc("pop"), "iidx")
    return a.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def same_triple(items: DataFrame, shares: int = 16) -> DataFrame:
    """(a, b): all pairs of items of one triple, in ``shares`` parts of each triple.

    The pairs are the square of a triple, the items few bytes: no plan by bytes would share them out.
    """
    k = ["cat_code", "style_code", "occ_code", "share"]
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = items.select(F.col("iidx").alias("a"), *k[:3], F.pmod(F.xxhash64("iidx"), F.lit(shares)).alias("share"))
    b = items.select(F.col("iidx").alias("b"), *k[:3], F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    b = b.withColumn("share", F.col("share").cast("long"))
    return a.repartition(parts, *k).join(b.repartition(parts, *k).hint("merge"), k).select("a", "b")


def query_match(triples: DataFrame, table: DataFrame, name: str) -> DataFrame:
    got = triples.join(table, ["cat_code", "style_code", "occ_code"])
    return named(got, f"QueryMatch_{name}", F.lit(1.0) / F.col("pos"))


def neighbours(pairs: DataFrame, target: DataFrame, name: str = "1") -> DataFrame:
    """Embedding neighbours (iidx, related, weight) of each target item."""
    t = target.select("uidx", "iidx").distinct()
    got = t.join(pairs, "iidx").select("uidx", F.col("related").alias("iidx"), "weight")
    return named(got, f"W2V_{name}", F.col("weight"))
