"""Nearest neighbours by vantage-point trees per shard (operator 4).

Largest inner product becomes nearest Euclidean point: every vector x gets one more component
sqrt(M^2 - |x|^2), M the largest norm, and every query a 0, so that distances order the vectors as inner
products do. Vectors are dealt to shards by a hash of vec_id, so copies and hot labels spread evenly; each
shard builds its own tree: a node's vantage point splits its rows at the median distance, and either side
keeps the interval of its distances. A side is skipped for a query when its distance to the interval,
times ``factor``, is at least the k-th best distance so far: factor 1 is exact, larger ones prune more and
lose recall. All queries of a block walk the tree together, nearest leaf first.

Queries are dealt in blocks of at most ``block`` to every shard (a stated query set against all rows), and
only each shard's k best per query leave it.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; a
vector meets only vectors of its own dimension; ties go to the smaller vec_id (rows that repeat a vec_id
are rows of their own, but a query leaves out all rows of its own id); fewer candidates than k give fewer
rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

LEAF, SHARD, BLOCK, FACTOR, K = 256, 32_768, 16_384, 1.0, 20


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component on, so equal vectors get equal scores."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


class VpTree:
    """Nodes in preorder; a leaf is a run of rows in ``order``."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 11):
        self.x, self.leaf, self.rng = x, leaf, np.random.default_rng(seed)
        self.order = np.arange(len(x))
        self.root = self._build(0, len(x))
        del self.rng

    def _build(self, lo: int, hi: int):
        if hi - lo <= self.leaf:
            return lo, hi
        rows = self.order[lo:hi]
        p = self.x[self.rng.choice(rows)]
        d = np.sqrt(((self.x[rows] - p) ** 2).sum(1))
        mid = (hi - lo) // 2
        by = np.argpartition(d, mid)
        self.order[lo:hi], d = rows[by], d[by]
        near, far = (d[:mid].min(), d[:mid].max()), (d[mid:].min(), d[mid:].max())
        return p, near, far, self._build(lo, lo + mid), self._build(lo + mid, hi)

    def search(self, q: np.ndarray, k: int, visit, bound: np.ndarray, factor: float) -> None:
        """Calls ``visit(queries, rows)`` for the leaves that can matter; it lowers ``bound`` in place."""
        slack = 1e-9

        def walk(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if len(node) == 2:
                visit(who, self.order[node[0] : node[1]])
                return
            p, near, far, left, right = node
            d = np.sqrt(((q[who] - p) ** 2).sum(1))
            gap = [np.maximum(0, np.maximum(lo - d, d - hi)) for lo, hi in (near, far)]
            first = gap[0] <= gap[1]
            for side, child in ((0, left), (1, right)):
                walk(child, who[(first if side == 0 else ~first) & (gap[side] * factor <= bound[who] + slack)])
            for side, child in ((0, left), (1, right)):
                walk(child, who[(~first if side == 0 else first) & (gap[side] * factor <= bound[who] + slack)])

        walk(self.root, np.arange(len(q)))


def search_shard(ids: np.ndarray, x: np.ndarray, qid: np.ndarray, q: np.ndarray, top: float, k: int, factor: float):
    """The k best (query row, vec_id, score) of one shard for each query."""
    wide = np.concatenate([x, np.sqrt(np.maximum(0, top * top - (x * x).sum(1)))[:, None]], 1)
    qn = np.sqrt((q * q).sum(1))
    unit = q * (top / qn)[:, None]  # the order of the products does not change with a query's length
    qw = np.concatenate([unit, np.zeros((len(q), 1))], 1)
    tree = VpTree(wide)
    best_s = np.full((len(q), k), -np.inf)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max)
    bound = np.full(len(q), np.inf)
    eps = 1e-9 * top * top

    def visit(who: np.ndarray, rows: np.ndarray) -> None:
        for s in range(0, len(who), 2048):
            w = who[s : s + 2048]
            rough = unit[w] @ x[rows].T
            floor = best_s[w, -1] * (top / qn[w]) - eps  # anything below is out, whatever the rounding
            a, b = np.nonzero((rough >= floor[:, None]) & (ids[rows][None, :] != qid[w][:, None]))
            if not len(a):
                continue
            # at most k by rough order and those as near as the k-th, then exact scores
            if len(a) > 4 * k * len(w):
                kth = np.partition(np.where(ids[rows][None, :] != qid[w][:, None], rough, -np.inf), -min(k, len(rows)), 1)
                ok = rough[a, b] >= kth[a, -min(k, len(rows))] - eps
                a, b = a[ok], b[ok]
            exact = dots(q[w[a]], x[rows[b]])
            who_ = np.concatenate([a, np.repeat(np.arange(len(w)), k)])
            sc = np.concatenate([exact, best_s[w].ravel()])
            vi = np.concatenate([ids[rows[b]], best_i[w].ravel()])
            o = np.lexsort((vi, -sc, who_))
            who_, sc, vi = who_[o], sc[o], vi[o]
            begin = np.searchsorted(who_, np.arange(len(w)))
            take = begin[:, None] + np.arange(k)
            best_s[w], best_i[w] = sc[take], vi[take]
            full = np.isfinite(best_s[w, -1])
            prod = best_s[w, -1] * (top / qn[w])
            bound[w] = np.where(full, np.sqrt(np.maximum(0, 2 * top * top - 2 * prod)), np.inf)

    tree.search(qw, k, visit, bound, factor)
    r, c = np.nonzero(np.isfinite(best_s))
    return r, best_i[r, c], best_s[r, c]


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, shard: int = SHARD, block: int = BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest; both sides have vec_id and embedding."""

    def sound(df: DataFrame) -> DataFrame:
        e = F.col("embedding")
        fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        ok = e.isNotNull() & fine & F.exists(e, lambda v: v != 0) & F.col("vec_id").isNotNull()
        one = df.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("e")).where(ok)
        return one.withColumn("dim", F.size("e"))

    x, q = sound(vectors), sound(queries)
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, v: s + v * v))
    n, top, nq = *x.agg(F.count(F.lit(1)), F.max(norm)).first(), q.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-nq // block))
    top = float(top or 1.0) * (1 + 1e-12)
    spread = lambda seed, m: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    key = ["dim", "shard", "block"]
    x = x.withColumn("shard", spread(1, shards)).withColumn("block", every(blocks))
    q = q.withColumn("block", spread(2, blocks)).withColumn("shard", every(shards))

    def run(_, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        qid = asked["vec_id"].to_numpy()
        got = search_shard(
            rows["vec_id"].to_numpy(), np.stack(rows["e"].to_numpy()), qid, np.stack(asked["e"].to_numpy()), top, k, factor
        )
        return pd.DataFrame({"query_id": qid[got[0]], "vec_id": got[1], "score": got[2]})

    found = x.groupBy(*key).cogroup(q.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(e, e.where("vec_id % 20 = 0"))


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (
  select q.vec_id as query_id, c.vec_id,
         list_reduce(list_transform(range(1, len(c.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e))
select query_id, rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p) where rank <= 20
"""
