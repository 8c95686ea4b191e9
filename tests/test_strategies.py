"""Trim against a plain rank loop, groups of unknown buyers, strategies and the evaluation loop on small tables."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shoalmark.operators import collect as C
from shoalmark.operators import evaluate as E
from shoalmark.operators import rules as R
from shoalmark.operators import strategies as G


def plain_trim(rows, labels, least):
    """The rule's rows that stay, by lowering the rank from the worst one."""
    known = {u for u, _ in labels}
    mine = [r for r in rows if r[0] in known]
    hit = lambda r: r[:2] in labels
    rate = sum(map(hit, mine)) / len(mine) if mine else 0.0
    if rate >= least:
        return rows
    scores = defaultdict(list)
    for u, _, s in mine:
        scores[u].append(s)
    rank = lambda r: sum(x > r[2] for x in scores[r[0]]) + (scores[r[0]].count(r[2]) + 1) / 2
    best, at = rate, max(map(rank, mine), default=0)
    for k in range(int(at), 0, -1):
        part = [r for r in mine if rank(r) <= k]
        got = sum(map(hit, part)) / len(part) if part else 0.0
        if got > best:
            best, at = got, k
        if got > least:
            break
    return [] if best < least else [r for r in mine if rank(r) <= at]


def test_trim_is_the_rank_loop(spark):
    rng = random.Random(2)
    rows, labels = [], {(u, rng.randrange(12)) for u in range(8) for _ in range(2)}
    for m in "abcdef":
        for u in range(12):
            rows += [(u, i, m, float(rng.randrange(4 if m < "d" else 9) + 20 * (m in "bd" and (u, i) in labels))) for i in rng.sample(range(12), 9)]
    out = spark.createDataFrame(rows, "uidx long, iidx long, method string, score double")
    lab = spark.createDataFrame(sorted(labels), "uidx long, iidx long")
    for least in (0.01, 0.16, 0.3, 0.5, 0.9):
        got = sorted(map(tuple, C.trim(out, lab, least).collect()))
        want = sorted((u, i, m, s) for m in "abcdef" for u, i, s in plain_trim([(u, i, s) for u, i, x, s in rows if x == m], labels, least))
        assert got == want, least


def test_scores_are_normal_before_items_go(spark):
    rows = [(1, k, "A", float(k)) for k in range(5)]
    out = spark.createDataFrame(rows, "uidx long, iidx long, method string, score double")
    gone = spark.createDataFrame([(0,), (1,)], "iidx long")
    got = {r.iidx: r.A for r in C.collect([out], ["A"], gone=gone, norm=True).collect()}
    assert set(got) == {2, 3, 4} and abs(got[2]) < 1e-9 and got[3] == pytest.approx(0.6745, abs=1e-3)


def test_unknown_buyers_are_in_group_0(spark):
    log = spark.createDataFrame([(1, 7), (9, 7), (9, 8)], "uidx long, iidx long")
    users = spark.createDataFrame([(1, 0), (2, 1)], "uidx long, g int")
    got = {(r.uidx, r.iidx): r.score for r in R.ug_time_history(log, users, "g").collect()}
    assert got == {(1, 7): 2.0, (1, 8): 1.0}
    frame = G.users_frame(spark.createDataFrame([(1,), (5,)], "uidx long"), users.withColumn("g", F.lit(3)), ["g"])
    assert {(r.uidx, r.g) for r in frame.collect()} == {(1, 3), (5, 0)}


def test_rounds(spark):
    tx = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 2, 12)], "uidx long, iidx long, day int")
    got = G.rounds(tx, 12, 2)
    assert [(d, b.count(), [tuple(r) for r in lab.collect()]) for d, b, lab in got] == [(12, 2, [(2, 2)]), (11, 1, [(1, 2)])]


class Fixed:
    def __init__(self, got):
        self.got = got

    def recommend_dataframe(self, query, user_id, top_k):
        assert query == "casual shirt for beach" and user_id == "u1" and top_k == 2
        return self.got


def test_evaluation_loop(spark):
    products = spark.createDataFrame([("p1", "shirt", "casual", "beach"), ("p2", "bag", "boho", "work")], "product_id string, category string, style_tags string, occasion_tags string")
    cases = spark.createDataFrame([("u1", "p1"), ("u2", "unknown")], "user_id string, product_id string")
    stock = spark.createDataFrame([("p1", 0), ("p2", 3)], "product_id string, stock int")
    for got in (["p2", "p1", "p3"], {"recommendations": [{"product_id": "p2"}, {"product_id": "p1"}]}):
        r = E.evaluate(E.plugged(Fixed(got)), cases, products, stock, 2).first()
        assert (r.cases, r.recall_at_k, r.precision_at_k, r.map_at_k, r.inventory_hit_rate, r.category_diversity) == (1, 1.0, 0.5, 0.5, 0.5, 2.0)
    none = E.evaluate(E.plugged(Fixed([])), cases.where("false"), products, stock, 2).first()
    assert none.cases == 0 and all(none[c] == 0.0 for c in E.COLUMNS)
    with pytest.raises(ValueError):
        E.sample(cases, 0)
    with pytest.raises(TypeError):
        E.plugged(object())
