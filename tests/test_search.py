"""Retrieval against all pairs of requests and products; sizes that must not grow with the catalogue."""

import math
import random
import re
from collections import Counter

from shoalmark.operators import assistant as B

COLUMNS = "product_id long, name string, category string, color string, style_tags string, occasion_tags string, description string, price double"
WORDS = [f"w{k:02d}" for k in range(40)]


def table(spark, n=300, prices=None):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(WORDS, k=4)), None, "", None, None, rng.choice(WORDS), prices(rng) if prices else float(rng.randrange(5, 60))) for k in range(n)]
    return rows, spark.createDataFrame(rows, COLUMNS)


REQUESTS = [(1, "w01 w02 w03", None), (2, "w04 w05", 9.0), (3, "nothing known", 20.0), (4, "w06", 1.0), (5, "w07 w08 w08", 30.0), (6, "", None)]


def plain(rows, top_k):
    grams = lambda s: (lambda w: Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))([x for x in re.findall(r"\w\w+", s.lower()) if x not in B.STOP])
    tf = {r[0]: grams(" ".join(x or "" for x in r[1:7])) for r in rows}
    df = Counter(t for c in tf.values() for t in c)
    total = sum(tf.values(), Counter())
    known = sorted(total, key=lambda t: (-total[t], t))[:5000]
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in known}
    unit = lambda c: (lambda w: {t: x / math.sqrt(sum(y * y for y in w.values())) for t, x in w.items()})({t: k * idf[t] for t, k in c.items() if t in idf})
    docs = {k: unit(c) for k, c in tf.items()}
    out = set()
    for q, text, budget in REQUESTS:
        qw = unit(grams(text))
        ok = [r for r in rows if budget is None or (r[7] is not None and r[7] <= 1.25 * budget)] or rows
        score = {r[0]: round(sum(w * docs[r[0]].get(t, 0) for t, w in qw.items()), 9) for r in ok}
        by = sorted(ok, key=lambda r: (-score[r[0]], -math.inf if r[7] is None else r[7], r[0]))
        out |= {(q, r[0], k + 1, round(score[r[0]], 6)) for k, r in enumerate(by[:top_k])}
    return out


def asked(spark):
    return spark.createDataFrame(REQUESTS, "query_id int, retrieval_text string, budget double")


def test_search_is_all_pairs(spark):
    for prices in (None, lambda rng: rng.choice([None, 3.0, 11.0, 11.0, 40.0]), lambda rng: 50.0):
        rows, p = table(spark, prices=prices)
        for top_k in (3, 30, 400):
            got = {(r.query_id, r.product_id, r.rank, round(r.retrieval_score, 6)) for r in B.search(asked(spark), p, top_k).collect()}
            assert got == plain(rows, top_k), top_k


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_requests_are_not_paired_with_the_catalogue(spark):
    """Windows by request see lists, cut where they are made, and joins by request do not deal the catalogue to few tasks."""
    _, p = table(spark)
    text = plan(B.search(asked(spark), p))
    assert "WindowGroupLimit" in text and "Cartesian" not in text
    assert "LeftOuter" not in text
    soft = plan(B.soft_budget(asked(spark).select("query_id", "budget"), p.select("product_id", "price")))
    assert "Window" not in soft and "hashpartitioning(query_id" not in soft


def test_catalogue_is_not_broadcast(spark):
    from shoalmark.plans import assistant as P
    from shoalmark.sources import adapters as A

    sf = "/root/testdata/sf0.001"
    a = B.Assistant(A.products(spark, sf), A.events(spark, sf), A.inventory(spark, sf), A.reviews(spark, sf))
    text = plan(a.recommend_batch(P.requests(spark), 3))
    cut = [m.end() for m in re.finditer("BroadcastExchange", text)]
    assert cut and not any("p_name" in text[k : k + 200] or "p_size" in text[k : k + 200] for k in cut)
