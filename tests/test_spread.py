"""Steps whose work or memory must be shared out, however few bytes or keys there are."""

from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from shoalmark.operators import collect as C
from shoalmark.operators import features as T
from shoalmark.operators import rules as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_one_triple_are_shared_out(spark):
    items = spark.createDataFrame([(k, 1, 2, 3 if k < 290 else 4) for k in range(300)], "iidx long, cat_code int, style_code int, occ_code int")
    got = R.same_triple(items)
    own = got.groupBy(F.spark_partition_id()).count().collect()
    assert got.distinct().count() == got.count() == 290 * 290 + 10 * 10
    assert len(own) >= 4 and max(r["count"] for r in own) < 0.6 * 290 * 290
    assert "Broadcast" not in plan(got)


def test_unit_rows_are_not_expanded(spark):
    """Distinct buyers are counted as rows of (unit, buyer); the log is not copied for each distinct count."""
    rows = [(u, i, d) for u in range(6) for i in range(9) for d in (90, 92, 97, 99) if (u * i + d) % 3]
    tx = spark.createDataFrame(rows, "uidx long, iidx long, day int")
    seen = []
    hold = T.hold
    T.hold = lambda df, name: seen.append(plan(df)) or hold(df, name)
    try:
        got = {r.iidx: r for r in T.unit_table(tx, 100, "iidx", "i").collect()}
    finally:
        T.hold = hold
    assert seen and not any("Expand" in p for p in seen)
    for i in range(9):
        own = [(u, d) for u, x, d in rows if x == i]
        if own:
            week, last = {u for u, d in own if d >= 93}, {u for u, d in own if d < 93}
            again = [u for u, _ in own]
            users = set(again)
            assert (got[i].i_sale_uni, got[i].lw_i_sale_uni, got[i].i_full_sale, got[i].i_age) == (len(week), len(last), len(own), 100 - min(d for _, d in own))
            assert got[i].i_repurchase_ratio == pytest.approx(sum(again.count(u) > 1 for u in users) / (len(users) + 1e-6))
            assert got[i].i_time_mean == pytest.approx(100 - sum(d for _, d in own) / len(own))


def test_normal_scores_are_summed_by_ranges(spark):
    """A rule with as many scores as rows is not sorted in one task."""
    rows = [(k, k % 7, m, float((k * 37) % n)) for m, n in (("A", 1009), ("B", 5)) for k in range(1000)]
    out = spark.createDataFrame(rows, "uidx long, iidx long, method string, score double")
    df = C.normal_scores(out)
    assert "windowspecdefinition(method#" in plan(df) and ", part#" in plan(df)
    got = {(r.method, r.uidx): r.score for r in df.collect()}
    for m in "AB":
        own = sorted(s for _, _, x, s in rows if x == m)
        for u, _, x, s in rows:
            if x == m:
                q = (own.index(s) + (own.count(s) - 1) / 2) / (len(own) - 1)
                assert got[m, u] == pytest.approx(NormalDist().inv_cdf(min(max(q, 1e-7), 1 - 1e-7)), abs=1e-9)


def test_pivots_have_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(C, "ROWS", 20)
    out = spark.range(1000).select((F.col("id") % 100).alias("uidx"), F.col("id").alias("iidx"), F.lit("A").alias("method"), F.lit(1.0).alias("score"))
    got = C.collect([out], ["A"])
    assert got.count() == 1000 and got.groupBy(F.spark_partition_id()).count().count() > 20
