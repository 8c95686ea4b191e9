"""Offline evaluation of an assistant: requests from held-out purchases, ranked answers, mean metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as M

#: The columns of a result, all 0 where there is no case.
COLUMNS = ["recall_at_k", "precision_at_k", "map_at_k", "ndcg_at_k", "inventory_hit_rate", "category_diversity"]


def sample(cases: DataFrame, n: int | None, seed: int = 42) -> DataFrame:
    """At most n cases, drawn by a hash; all of them for None."""
    if n is None:
        return cases
    if n <= 0:
        raise ValueError("sample_users must be a positive integer")
    return cases.orderBy(F.xxhash64(F.lit(seed), "user_id", "product_id"), "user_id", "product_id").limit(n)


def requests(cases: DataFrame, products: DataFrame) -> DataFrame:
    """(case, user_id, product_id, query): a request in words from the held-out product; unknown products are left out."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    p = products.groupBy("product_id").agg(*(F.first(c).alias(c) for c in ("style_tags", "category", "occasion_tags")))
    q = cases.join(p, "product_id")
    query = F.concat(text("style_tags"), F.lit(" "), text("category"), F.lit(" for "), text("occasion_tags"))
    return q.select(F.xxhash64("user_id", "product_id").alias("case"), "user_id", "product_id", query.alias("query"))


def evaluate(
    answer: Callable[[DataFrame, int], DataFrame], cases: DataFrame, products: DataFrame, inventory: DataFrame | None,
    top_k: int = 5, sample_users: int | None = 100, seed: int = 42,
) -> DataFrame:
    """One row of COLUMNS and ``cases``. ``answer`` gives (case, pos from 1, item) for a table of requests and top_k."""
    asked = requests(sample(cases, sample_users, seed), products)
    got = answer(asked.select("case", "user_id", "query"), top_k).where(F.col("pos") <= top_k)
    m = M.ranking_metrics(got, asked.select("case", F.col("product_id").alias("item")), top_k)
    stock = products.select("product_id", F.lit(1).alias("stock")) if inventory is None else inventory
    m = m.join(M.shelf_metrics(got, products, stock), "case", "left")
    names = dict(zip(COLUMNS, ["recall", "precision", "ap", "ndcg", "in_stock_rate", "category_diversity"]))
    means = [F.coalesce(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), F.lit(0.0)).alias(n) for n, c in names.items()]
    return m.agg(F.count(F.lit(1)).alias("cases"), *means)


def plugged(assistant: object) -> Callable[[DataFrame, int], DataFrame]:
    """An ``answer`` from an object with recommend_dataframe(query, user_id, top_k), asked case by case.

    Such an object answers one request at a time in the driver, so it is for the sampled cases only. It may return
    a table with product_id, a dict with recommendations, or ids.
    """
    ask = getattr(assistant, "recommend_dataframe", None)
    if not callable(ask):
        raise TypeError(f"{type(assistant).__name__} has no recommend_dataframe(query, user_id, top_k)")

    def ids(got) -> list[str]:
        if hasattr(got, "toPandas"):
            got = got.toPandas()
        if hasattr(got, "columns"):
            return [str(x) for x in got["product_id"].tolist()]
        return [str(r["product_id"]) for r in got.get("recommendations", [])] if isinstance(got, dict) else [str(x) for x in got]

    def answer(asked: DataFrame, top_k: int) -> DataFrame:
        rows = []
        for r in asked.toLocalIterator():
            got = ids(ask(query=r["query"], user_id=str(r["user_id"]), top_k=top_k))[:top_k]
            rows += [(r["case"], k + 1, x) for k, x in enumerate(got)]
        return asked.sparkSession.createDataFrame(rows, "case long, pos int, item string")

    return answer
