"""The three candidate strategies: which rules run, over which windows, and how their outputs are collected.

Each takes the purchase log before the round's day, the round's target users with their groups and, in training
rounds, the round's labels (uidx, iidx), by which rules of too low a positive rate are trimmed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import collect as C
from . import rules as R
from .store import hold

# The rule outputs of each strategy, the least positive rate of the small one, kept ranks of the large one.
SMALL = ["OrderHistory_1", "OrderHistory_2", "OrderHistoryDecay_1", "OrderHistoryDecay_2", *(f"ItemPairRetrieve_{k}" for k in range(1, 5)), "UGTimeHistory_1", "UGTimeHistory_2", "UGSaleTrend_1", "TimeHistory_1", "TimeHistory_2", "TimeHistoryDecay_1", "TimeHistoryDecay_2", "SaleTrend_1"]
LARGE = ["ALS_1", "BPR_1", "UGTimeHistory_1", "UGTimeHistory_2", "UGTimeHistory_3", "OrderHistory_3", "OrderHistoryDecay_3", "TimeHistory_3", "ItemCF_1", "ItemCF_2", "ItemCF_3", "W2V_1", "ProNE_1", *(f"UGItemCF_{k}" for k in range(1, 7))]
QUERY = ["QueryMatch_recent", "QueryMatch_alltime"]
LEAST, CAP, KEPT = 0.006, 200, 50


def users_frame(targets: DataFrame, attributes: DataFrame, groups: list[str]) -> DataFrame:
    """The target users with their groups; a user without attributes is in group 0."""
    df = targets.select("uidx").distinct().join(attributes.select("uidx", *groups), "uidx", "left")
    return df.withColumns({g: F.coalesce(g, F.lit(0).cast(attributes.schema[g].dataType)) for g in groups})


def small(tx: DataFrame, users: DataFrame, labels: DataFrame | None, age: str = "age_band_code", least: float = LEAST) -> DataFrame:
    """Histories, pairs, group and global lists; scores as normal quantiles, rules trimmed, out-of-stock items gone."""
    tx, users = hold(tx, "log"), hold(users, "users")
    own = hold(tx.join(users.select("uidx"), "uidx", "left_semi"), "own")
    week, three = R.trailing(tx, 7), R.trailing(tx, 3)
    base = [R.order_history(own, 3, name="1"), R.order_history(own, 7, name="2"), R.order_history_decay(own, 3, 50, "1"), R.order_history_decay(own, 7, 50, "2")]
    base = [hold(b, "base") for b in base]
    outputs = [
        *base,
        *(R.item_pair(b, str(k + 1)) for k, b in enumerate(base)),
        R.ug_time_history(week, users, age, 50, name="1"),
        R.ug_time_history(three, users, age, 50, name="2"),
        R.ug_sale_trend(tx, users, age, 7, 50, name="1"),
        R.time_history(week, users, 50, "1"),
        R.time_history(three, users, 50, "2"),
        R.time_history_decay(tx, users, 3, 50, "1"),
        R.time_history_decay(tx, users, 7, 50, "2"),
        R.sale_trend(tx, users, 7, 50, name="1"),
    ]
    return C.collect(outputs, SMALL, labels, R.out_of_stock(tx), least, norm=True)


def large(tx: DataFrame, users: DataFrame, attributes: DataFrame, extra: list[DataFrame] = (), age: str = "age_band_code", power: str = "purchase_ability", gender: str = "user_gender", cap: int = CAP) -> DataFrame:
    """Group and global lists, histories and item filtering, raw scores, at most ``cap`` items a user with score and rank.

    ``extra`` has the outputs of trained models: ALS_1, BPR_1, W2V_1 and ProNE_1 where there are any.
    """
    tx, users = hold(tx, "log"), hold(users, "users")
    own = tx.join(users.select("uidx"), "uidx", "left_semi")
    week = R.trailing(tx, 7)
    target = hold(own.crossJoin(F.broadcast(R.last_day(tx))).where("day >= last - 13").drop("last"), "target")
    outputs = [
        *extra,
        *(R.ug_time_history(week, users, g, cap, True, str(k + 1)) for k, g in enumerate((age, power, gender))),
        R.order_history(own, 35, cap, "3"),
        R.order_history_decay(own, 7, cap, "3"),
        R.time_history(week, users, cap, "3"),
    ]
    for k, days in enumerate((80, 60, 14)):
        outputs.append(R.item_cf_predict(R.item_cf_sim(R.trailing(tx, days)), target, str(k + 1)))
    for j, group in enumerate((age, power)):
        inside = lambda log: R.in_group(log, attributes.select("uidx", group), group)  # noqa: B023, E731
        for k, days in enumerate((80, 60, 14)):
            sim = R.item_cf_sim(inside(R.trailing(tx, days)), group=group)
            outputs.append(R.item_cf_predict(sim, inside(target), str(3 * j + k + 1), group))
    return C.cap(hold(C.collect(outputs, LARGE), "pivoted"), LARGE, cap)


def query(tx: DataFrame, items: DataFrame, labels: DataFrame, k: int = 200) -> DataFrame:
    """The most sold items of the triple that the user asks for: that of the first label, one query a user and round."""
    t = ["cat_code", "style_code", "occ_code"]
    tx, items = hold(tx.select("iidx", "day"), "log"), hold(items.select("iidx", *t), "items")
    asked = R.top(labels.join(items.select("iidx", *t), "iidx"), 1, ["uidx"], F.col("iidx")).select("uidx", *t)
    outputs = [R.query_match(asked, R.triple_tables(tx, items, k, 28), "recent"), R.query_match(asked, R.triple_tables(tx, items, k, None), "alltime")]
    return C.collect(outputs, QUERY)


def rounds(tx: DataFrame, last: int, n: int) -> list[tuple[int, DataFrame, DataFrame]]:
    """(day, log before it, labels of the day) of the n rounds that end with ``last``: round 0 validates, later ones train."""
    return [(last - k, R.before(tx, last - k), tx.where(F.col("day") == last - k).select("uidx", "iidx").distinct()) for k in range(n)]
