"""Learned models answer for every user and item, not for a subset of ids."""

import numpy as np

from shoalmark import catalogue
from shoalmark.operators import models as Mo
from shoalmark.operators import rules as R
from shoalmark.sources import adapters as A

SF = "/root/testdata/sf0.001"


def ids(df, c):
    return {r[0] for r in df.select(c).distinct().collect()}


def test_neighbours_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.integers(-2, 3, 4).astype(float).tolist()) for k in range(150)]
    got = {}
    for r in Mo.item_neighbours(spark.createDataFrame(rows, "iidx long, v array<double>"), 7, block=32).collect():
        got.setdefault(r.iidx, []).append((r.weight, r.related))
    x = np.array([v for _, v in rows])
    n = np.sqrt((x * x).sum(1))
    x = np.where(n[:, None] > 0, x / np.where(n > 0, n, 1)[:, None], 0)
    s = np.round(x @ x.T, 6)
    for k in range(150):
        want = sorted(((s[k, j] + 0.0, j) for j in range(150) if j != k), key=lambda t: (-t[0], t[1]))[:7]
        assert sorted(got[k], key=lambda t: (-t[0], t[1])) == want
    assert Mo.item_neighbours(spark.createDataFrame(rows[:1], "iidx long, v array<double>")).count() == 0


def test_all_items_have_neighbours(spark):
    t = A.tx(spark, SF)
    for name, items in (("word2vec_neighbours", ids(t, "iidx")), ("svd_embedding_similarity", ids(R.trailing(t, 365), "iidx"))):
        got = catalogue.queries()[name](spark, SF)
        assert ids(got, "iidx") == items and len(ids(got, "related")) > len(items) / 2


def test_all_users_have_candidates(spark):
    t = A.tx(spark, SF)
    pool = ids(R.recent_pool(t, 60), "iidx")
    assert len(pool) > 100
    for name, users in (("als_topn", ids(t, "uidx")), ("bpr_topn", ids(R.trailing(t, 365), "uidx"))):
        got = catalogue.queries()[name](spark, SF)
        assert ids(got, "uidx") == users and ids(got, "iidx") <= pool
