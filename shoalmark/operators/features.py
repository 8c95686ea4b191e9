"""Point-in-time features: everything is computed from rows strictly before ``day``.

Four wide tables (item, family, user, pair) and a category table, each by conditional aggregation in one
pass over the log; candidates then take four or five joins, whatever the number of features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from .store import hold

EPS = 1e-6
WEEKS = (1, 2, 3, 4)


def cut(tx: DataFrame, day: int) -> DataFrame:
    return tx.where(F.col("day") < day)


def within(day: int, lo: int, hi: int = 0) -> Column:
    """day - lo <= row's day < day - hi"""
    return (F.col("day") >= day - lo) & (F.col("day") < day - hi)


def unit_table(tx: DataFrame, day: int, key: str, p: str) -> DataFrame:
    """Sales windows, ranks, shares, buyers, trend, repurchase, age, popularity of items (p=i) or families (p=p)."""
    names = {f"{p}_{w}w_sale": within(day, 7 * w) for w in WEEKS}
    names |= {f"lw_{p}_sale": within(day, 14, 7), f"{p}_ly_sale": within(day, 372, 358), f"{p}_full_sale": F.lit(True)}
    # first by unit and buyer, where distinct buyers are rows; dealt by unit, so both steps read the same narrow rows
    parts = int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a part by bytes would hold millions of groups
    per = cut(tx, day).select(key, "uidx", "day").repartition(parts, key).groupBy(key, "uidx").agg(
        *(F.count(F.when(c, 1)).alias(k) for k, c in names.items()), F.sum(1 / (day - F.col("day"))).alias("pop"), F.min("day").alias("first"), F.sum("day").alias("days")
    )
    full = F.sum(f"{p}_full_sale")
    t = per.groupBy(key).agg(
        *(F.sum(k).alias(k) for k in names),
        F.count(F.when(F.col(f"{p}_1w_sale") > 0, F.col("uidx"))).alias(f"{p}_sale_uni"), F.count(F.when(F.col(f"lw_{p}_sale") > 0, F.col("uidx"))).alias(f"lw_{p}_sale_uni"),
        F.sum("pop").alias(f"{p}_pop"), F.greatest(F.lit(day) - F.min("first"), F.lit(1)).alias(f"{p}_age"), (F.lit(day) - F.sum("days") / full).alias(f"{p}_time_mean"),
        (F.count(F.when(F.col(f"{p}_full_sale") > 1, 1)) / (F.count(F.lit(1)) + EPS)).alias(f"{p}_repurchase_ratio"),
    )
    t = hold(t, "units")  # one row a unit, read once more for the ranks
    # ranks and totals over the counts of each value: a small table, so no global window over units
    sales = F.explode(F.array(*(F.struct(F.lit(w).alias("w"), F.col(f"{p}_{w}w_sale").alias("c")) for w in WEEKS)))
    by = hold(t.select(sales.alias("x")).select("x.*").where("c > 0").groupBy("w", "c").agg(F.count(F.lit(1)).alias("m")), "counts")
    of = lambda w, c: F.coalesce(F.sum(F.when(F.col("w") == w, c)), F.lit(0))
    totals = by.agg(*(F.greatest(of(w, F.col("c") * F.col("m")).cast("double"), F.lit(EPS)).alias(f"t{w}") for w in WEEKS), *(of(w, F.col("m")).alias(f"n{w}") for w in WEEKS))
    t = t.crossJoin(F.broadcast(totals))
    above = F.sum("m").over(Window.partitionBy("w").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1))
    ranks = by.select("w", "c", (F.coalesce(above, F.lit(0)) + (F.col("m") + 1) / 2).alias("r"))
    for w in WEEKS:
        c = f"{p}_{w}w_sale"
        t = t.withColumn(f"{c}_norm", F.col(c) / F.col(f"t{w}"))
        one = ranks.where(F.col("w") == w).select(F.col("c").alias(c), F.col("r").alias(f"{c}_rank"))
        t = t.join(F.broadcast(one), c, "left").withColumn(f"{c}_rank", F.coalesce(f"{c}_rank", F.col(f"n{w}") + 1.0))
    cur, last = F.col(f"{p}_1w_sale"), F.col(f"lw_{p}_sale")
    daily = F.col(f"{p}_full_sale") / F.col(f"{p}_age")
    return t.withColumns({
        f"{p}_uni_ratio": X.ratio(cur, F.col(f"{p}_sale_uni")),
        f"lw_{p}_uni_ratio": X.ratio(last, F.col(f"lw_{p}_sale_uni")),
        f"{p}_sale_trend": (cur - last) / (last + EPS),
        f"{p}_daily_sale": daily,
        f"{p}_w_full_sale_ratio": X.ratio(cur, F.col(f"{p}_full_sale")),
        f"{p}_2w_full_sale_ratio": X.ratio(F.col(f"{p}_2w_sale"), F.col(f"{p}_full_sale")),
        f"{p}_week_above_daily_sale": cur / 7 - daily,
        f"{p}_2w_week_above_daily_sale": F.col(f"{p}_2w_sale") / 14 - daily,
    }).drop(*(f"t{w}" for w in WEEKS), *(f"n{w}" for w in WEEKS))


def item_extras(tx: DataFrame, day: int) -> DataFrame:
    """iidx, item_price (last seen), item_channel (mode, smallest on ties)."""
    c = cut(tx, day)
    price = c.where("price is not null").groupBy("iidx").agg(F.max_by("price", F.struct("day", "okey", "line")).alias("item_price"))
    mode = c.groupBy("iidx", "channel").agg(F.count(F.lit(1)).alias("k"))
    mode = mode.groupBy("iidx").agg(F.max_by("channel", F.struct("k", -F.col("channel"))).alias("item_channel"))
    return mode.join(price, "iidx", "left")


def user_table(tx: DataFrame, day: int) -> DataFrame:
    u = cut(tx, day).groupBy("uidx").agg(
        (day - F.max("day")).alias("customer_id_last_time"), (day - F.min("day")).alias("customer_id_first_time"),
        (day - F.avg("day")).alias("customer_id_time_mean"), F.avg("price").alias("user_mean_price"),
    )
    return u.withColumn("customer_id_gap", F.col("customer_id_first_time") - F.col("customer_id_last_time"))


def category_table(tx: DataFrame, items: DataFrame, day: int) -> DataFrame:
    c = cut(tx, day).join(items.select("iidx", "cat_code"), "iidx").groupBy("cat_code").agg(
        F.count(F.when(within(day, 7), 1)).alias("cat_sale"), F.count(F.when(within(day, 14, 7), 1)).alias("lw_cat_sale")
    )
    return c.withColumn("cat_sale_trend", (F.col("cat_sale") - F.col("lw_cat_sale")) / (F.col("lw_cat_sale") + EPS))


def pair_table(tx: DataFrame, day: int) -> DataFrame:
    return cut(tx, day).groupBy("uidx", "iidx").agg(F.count(F.lit(1)).alias("ui_sale"))


def affinity(tx: DataFrame, items: DataFrame, day: int, key: str, name: str) -> DataFrame:
    """Decayed purchases of a user in a category or family."""
    t = cut(tx, day).join(items.select("iidx", key), "iidx")
    return t.groupBy("uidx", key).agg(F.sum(1 / (day - F.col("day"))).alias(name))


def buyer_profile(tx: DataFrame, users: DataFrame, day: int) -> DataFrame:
    """Mean and spread of the age codes of an item's buyers, and their mean purchase ability."""
    t = cut(tx, day).join(users.select("uidx", "age_code", "purchase_ability"), "uidx")
    return t.groupBy("iidx").agg(
        F.avg("age_code").alias("i_buyer_age_mean"), F.coalesce(F.stddev_samp("age_code"), F.lit(0.0)).alias("i_buyer_age_std"), F.avg("purchase_ability").alias("i_buyer_pa_mean")
    )


def purchase_ability(tx: DataFrame) -> DataFrame:
    """uidx, quintile of the mean price by first rank. The rank is global: one row per user is sorted."""
    m = tx.groupBy("uidx").agg(F.avg("price").alias("m"))
    n = m.agg(F.count(F.lit(1)).alias("n"))
    r = m.withColumn("r", F.row_number().over(Window.orderBy(F.round("m", 6), "uidx"))).crossJoin(F.broadcast(n))
    return r.select("uidx", X.quantile_bin(F.col("r"), F.col("n"), 5).alias("purchase_ability"))


def budget_tier(tx: DataFrame) -> DataFrame:
    m = tx.groupBy("uidx").agg(F.median("price").alias("m"))
    n = m.agg(F.count(F.lit(1)).alias("n"))
    r = m.withColumn("r", F.row_number().over(Window.orderBy(F.round("m", 6), "uidx"))).crossJoin(F.broadcast(n))
    name = F.element_at(F.array(*map(F.lit, ("low", "mid", "high"))), X.quantile_bin(F.col("r"), F.col("n"), 3) + 1)
    return r.select("uidx", name.alias("budget_tier"))


def join_features(cand: DataFrame, tx: DataFrame, items: DataFrame, day: int) -> DataFrame:
    """All feature columns of (uidx, iidx) candidates; what a unit lacks is 0, a missing rank is last."""
    tx, items = hold(cut(tx, day), "log"), hold(items, "items")  # ten tables read them
    a = items.select("iidx", "fidx", "cat_code", "style_code", "occ_code", "color_code", F.col("price").alias("list_price"))
    fam = tx.join(items.select("iidx", "fidx"), "iidx")
    df = cand.join(a, "iidx", "left")
    df = df.join(unit_table(tx, day, "iidx", "i"), "iidx", "left").join(unit_table(fam, day, "fidx", "p"), "fidx", "left")
    df = df.join(item_extras(tx, day), "iidx", "left").join(user_table(tx, day), "uidx", "left")
    df = df.join(F.broadcast(category_table(tx, items, day)), "cat_code", "left").join(pair_table(tx, day), ["uidx", "iidx"], "left")
    df = df.join(affinity(tx, items, day, "cat_code", "u_cat_affinity"), ["uidx", "cat_code"], "left")
    df = df.join(affinity(tx, items, day, "fidx", "u_fam_affinity"), ["uidx", "fidx"], "left")
    df = df.withColumn("item_price", F.coalesce("item_price", "list_price", F.lit(0.0))).drop("list_price")
    df = df.fillna(0)
    for k in ("", "lw_"):
        i, p = ("i_1w_sale", "p_1w_sale") if not k else ("lw_i_sale", "lw_p_sale")
        df = df.withColumn(f"{k}i_sale_ratio", X.ratio(F.col(i), F.col(p))).withColumn(f"{k}i_sale_uni_ratio", X.ratio(F.col(f"{k}i_sale_uni"), F.col(f"{k}p_sale_uni")))
    return df.withColumns({
        "i_daily_sale_ratio": X.ratio(F.col("i_daily_sale"), F.col("p_daily_sale")),
        "price_ratio": X.ratio(F.col("item_price"), F.col("user_mean_price")),
        "ui_sale_ratio": X.ratio(F.col("ui_sale"), F.col("i_full_sale")),
        "i_ly_ratio": X.ratio(F.col("i_ly_sale"), F.col("i_2w_sale")),
    })


def query_agreement(cand: DataFrame, query: DataFrame, items: DataFrame) -> DataFrame:
    """Flags and their sum: does the candidate's code equal the query's? An unknown item never agrees."""
    q = query.select("uidx", *(F.col(c).alias(f"q_{c}") for c in ("cat_code", "style_code", "occ_code")))
    df = cand.join(items.select("iidx", "cat_code", "style_code", "occ_code"), "iidx", "left").join(q, "uidx")
    eq = {f"q_{n}_eq": F.coalesce((F.col(c) == F.col(f"q_{c}")).cast("int"), F.lit(0)) for n, c in (("cat", "cat_code"), ("style", "style_code"), ("occ", "occ_code"))}
    df = df.select("uidx", "iidx", *(v.alias(k) for k, v in eq.items()))
    return df.withColumn("q_match", F.col("q_cat_eq") + F.col("q_style_eq") + F.col("q_occ_eq"))
