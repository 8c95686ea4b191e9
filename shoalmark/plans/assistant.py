"""Request-side queries: intent, retrieval, profile, scores, reranking, explanation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import assistant as B
from ..operators import metrics as M
from ..operators import rules as R
from ..sources import adapters as A
from .registry import query

#: (query_id, user_id, query)
REQUESTS = [
    (1, 1, "I need a relaxed light outfit for a beach weekend under 90 dollars"),
    (2, 2, "面试穿的黑色正式外套，预算不超过 150"),
    (3, 3, "almond brass part for the office below $1200.50"),
    (4, 4, "cheap blue shirt"),
    (5, 5, "something nice"),
    (6, 6, "formal blazer $950 or less"),
    (7, 7, "small widget and gear, 1000 usd"),
    (8, 8, "affordable STEEL frost antique for travel and the gym"),
    (9, 9, "a stop at the standard update"),
    (10, 10, "运动鞋 300以内"),
]


def values() -> str:
    return "req as (select * from (values " + ", ".join(f"({a}, {b}, '{c}')" for a, b, c in REQUESTS) + ") as t(query_id, user_id, query))"


def requests(s):
    return s.createDataFrame(REQUESTS, "query_id int, user_id int, query string")


def terms_sql(vocabulary: dict) -> str:
    one = lambda name, vs: f"case when {' or '.join(f'contains(lower(query), {chr(39)}{v}{chr(39)})' for v in vs)} then '{name}' end"
    return "concat_ws(',', " + ", ".join(one(k, v) for k, v in vocabulary.items()) + ")"


BUDGET = """coalesce(nullif(regexp_extract(query, '(under|below|less than|<=|预算不超过|低于|小于)[\\s　]*\\$?[\\s　]*(\\d+(\\.\\d+)?)', 2, 'i'), '')::double,
 nullif(regexp_extract(query, '\\$[\\s　]*(\\d+(\\.\\d+)?)[\\s　]*(or less|max|以内)', 1, 'i'), '')::double, nullif(regexp_extract(query, '(\\d+(\\.\\d+)?)[\\s　]*(dollars|usd|以内|以下)', 1, 'i'), '')::double,
 case when contains(lower(query), 'cheap') or contains(lower(query), 'affordable') then 60.0::double end)"""
PARSED = f"""pq as (select *, {terms_sql(B.OCCASIONS)} as occ, {terms_sql(B.STYLES)} as sty, {terms_sql(B.COLORS)} as col, {terms_sql(B.CATEGORIES)} as cat, {BUDGET} as budget from req),
 rq as (select *, trim(regexp_replace(concat_ws(' ', query, replace(concat_ws(' ', nullif(occ, ''), nullif(sty, ''), nullif(col, ''), nullif(cat, '')), ',', ' '), 'budget under ' || regexp_replace(budget::varchar, '\\.0$', '')), ' +', ' ', 'g')) as retrieval_text from pq)"""


@query("intent_parse_terms", "", f"with {values()}, {PARSED} select query_id, occ as occasion, sty as style, col as color, cat as category, (occ = '' and sty = '' and cat = '') as unclear, retrieval_text from rq")
def intent_terms(s, d):
    p = B.parse(requests(s))
    return p.select("query_id", *(F.array_join(c, ",").alias(c) for c in ("occasion", "style", "color", "category")), "unclear", "retrieval_text")


@query("intent_budget", "", f"with {values()}, {PARSED} select query_id, budget from rq")
def intent_budget(s, d):
    return B.parse(requests(s)).select("query_id", "budget")


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in B.STOP) + ")"
GRAMS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
WORDS = f"list_filter(regexp_extract_all(lower({{c}}), '[0-9_\\p{{{{L}}}}\\p{{{{M}}}}]{{{{2,}}}}'), lambda x: x not in {STOP_SQL})"
SEARCH = f"""{values()}, {PARSED}, dt as (select product_id, {WORDS.format(c="concat_ws(' ', name, category, color, style_tags, occasion_tags, description)").replace('{{', '{').replace('}}', '}')} as w from products),
 tf as (select product_id, term, count(*) as tf from (select product_id, unnest({GRAMS}) as term from dt) group by 1, 2),
 st as (select term, sum(tf) as total, count(*) as df from tf group by 1 order by 2 desc, 1 limit 5000), idf as (select term, ln((1 + (select count(*) from products)) / (1 + df)::double) + 1 as idf from st),
 dw as (select product_id, term, tf * idf as w from tf join idf using (term)), dn as (select product_id, sqrt(sum(w * w)) as n from dw group by 1),
 qt as (select query_id, {WORDS.format(c="retrieval_text").replace('{{', '{').replace('}}', '}')} as w from rq), qf as (select query_id, term, count(*) as tf from (select query_id, unnest({GRAMS}) as term from qt) group by 1, 2),
 qw as (select query_id, term, tf * idf as w from qf join idf using (term)), qn as (select query_id, sqrt(sum(w * w)) as n from qw group by 1),
 sc as (select query_id, product_id, sum(qw.w / qn.n * dw.w / dn.n) as s from qw join qn using (query_id) join dw using (term) join dn using (product_id) group by 1, 2),
 al as (select query_id, product_id, price, budget, round(coalesce(s, 0), 9) as retrieval_score from rq cross join products left join sc using (query_id, product_id)),
 ok as (select *, (budget is null or price <= 1.25 * budget) as pass, max((budget is null or price <= 1.25 * budget)::int) over (partition by query_id) as anyp from al),
 rk as (select query_id, product_id, price, retrieval_score, row_number() over (partition by query_id order by retrieval_score desc, price, product_id) as rank from ok where pass or anyp = 0),
 cand as (select * from rk where rank <= 30)"""


@query("tfidf_search", "products", f"with {SEARCH} select query_id, product_id, round(price, 6) as price, round(retrieval_score, 6) + 0.0 as retrieval_score, rank::int as rank from cand")
def tfidf_search(s, d):
    got = B.search(B.parse(requests(s)), A.products(s, d))
    return got.select("query_id", "product_id", F.round("price", 6).alias("price"), X.r6(F.col("retrieval_score")).alias("retrieval_score"), "rank")


@query("soft_budget_filter", "products", f"with {values()}, {PARSED}, c as (select query_id, product_id, price, budget, (budget is null or price <= 1.25 * budget) as ok from rq cross join products), a as (select *, max(ok::int) over (partition by query_id) as anyp from c) select query_id, product_id from a where ok or anyp = 0")
def soft_budget(s, d):
    p = A.products(s, d)
    return B.soft_budget(B.parse(requests(s)).select("query_id", "budget"), p.select("product_id", "price")).select("query_id", "product_id")


PROFILE = """h as (select user_id, event_weight * exp(-coalesce(date_sub('day', ts, max(ts) over (partition by user_id)), 0) / 60.0::double) as w, product_id from ev),
 j as (select h.user_id, w, category, color, style_tags from h join products using (product_id)),
 k as (select user_id, w, 'category' as kind, category as key from j union all select user_id, w, 'color', color from j union all select user_id, w, 'style', unnest(list_distinct(list_filter(list_transform(string_split(style_tags, ','), lambda x: lower(trim(x))), lambda x: x <> ''))) from j),
 g as (select user_id, kind, key, sum(w) as v from k group by all), prof as (select user_id, kind, key, v / case when sum(abs(v)) over (partition by user_id, kind) = 0 then 1 else sum(abs(v)) over (partition by user_id, kind) end as value from g)"""


@query("user_affinity_l1", "products ev", f"with {PROFILE} select user_id, kind, key, round(value, 6) + 0.0 as value from prof")
def affinity(s, d):
    p = B.profile(A.events(s, d), A.products(s, d))
    return p.select("user_id", "kind", "key", X.r6(F.col("value")).alias("value"))


def cands(s, d):
    req = B.parse(requests(s))
    return req, B.search(req, A.products(s, d))


PREF = f"""{SEARCH}, {PROFILE}, cu as (select c.*, r.user_id, r.budget, concat_ws(',', nullif(occ, ''), nullif(sty, ''), nullif(col, ''), nullif(cat, '')) as wanted from cand c join rq r using (query_id)),
 pf as (select cu.query_id, cu.product_id, least(greatest(0.40 * coalesce(a.value, 0) + 0.20 * coalesce(b.value, 0) + 0.25 * coalesce((select sum(value) from prof where prof.user_id = cu.user_id and kind = 'style' and (key = lower(p.brand) or key = lower(split_part(p.style_tags, ',', 2)))), 0), 0.0::double), 1.0::double) as preference_score
   from cu join products p using (product_id) left join prof a on a.user_id = cu.user_id and a.kind = 'category' and a.key = p.category left join prof b on b.user_id = cu.user_id and b.kind = 'color' and b.key = p.color)"""


@query("preference_score", "products ev", f"with {PREF} select query_id, product_id, round(preference_score, 6) + 0.0 as preference_score from pf")
def preference(s, d):
    req, c = cands(s, d)
    c = c.join(req.select("query_id", "user_id"), "query_id")
    p = A.products(s, d)
    return B.preference(c, p, B.profile(A.events(s, d), p)).select("query_id", "product_id", X.r6(F.col("preference_score")).alias("preference_score"))


RERANK = f"""{PREF}, x as (select cu.query_id, cu.product_id, cu.price, retrieval_score, budget, wanted, preference_score, coalesce(stock, 0) as stock, coalesce(return_rate, 0.10) as return_rate, margin as m0,
   lower(concat_ws(' ', name, category, color, style_tags, occasion_tags, description)) as row_text, lower(style_tags || ',' || occasion_tags || ',' || category || ',' || color) as tags from cu join pf using (query_id, product_id) join products p using (product_id) left join inventory i using (product_id)),
 x2 as (select *, coalesce(m0, median(m0) over (partition by query_id), 0.30) as margin from x),
 x3 as (select *, case when wanted = '' then 0.0::double else len(list_filter(string_split(wanted, ','), lambda t: contains(row_text, t) or list_contains(string_split(tags, ','), t))) / len(string_split(wanted, ','))::double end as intent_match_score,
   case when budget is null or price <= budget then 1.0::double else greatest(0.0::double, 1 - 2 * (price - budget) / greatest(budget, 1)) end as price_score, (stock > 0)::int::double as inventory_score,
   case when abs(max(margin) over q - min(margin) over q) <= 1e-9 * max(abs(margin)) over q then 1.0::double else (margin - min(margin) over q) / (max(margin) over q - min(margin) over q) end as margin_score from x2 window q as (partition by query_id)),
 x4 as (select *, round(retrieval_score * 0.45::double + intent_match_score * 0.15::double + preference_score * 0.15::double + price_score * 0.10::double + inventory_score * 0.08::double + margin_score * 0.04::double + (1 - return_rate) * 0.03::double - case when stock <= 0 then 0.35::double else 0 end, 9) as score from x3),
 fin as (select *, row_number() over (partition by query_id order by score desc, (stock > 0) desc, retrieval_score desc, price, product_id)::int as rank from x4)"""


def reranked(s, d):
    req, c = cands(s, d)
    p = A.products(s, d)
    return B.rerank(c, p, A.inventory(s, d), req, B.profile(A.events(s, d), p))


@query("intent_match_score", "products ev inventory", f"with {RERANK} select query_id, product_id, round(intent_match_score, 6) + 0.0 as intent_match_score from fin")
def intent_match(s, d):
    return reranked(s, d).select("query_id", "product_id", X.r6(F.col("intent_match_score")).alias("intent_match_score"))


@query("price_score", "products ev inventory", f"with {RERANK} select query_id, product_id, round(price_score, 6) + 0.0 as price_score, round(margin_score, 6) + 0.0 as margin_score from fin")
def price(s, d):
    return reranked(s, d).select("query_id", "product_id", X.r6(F.col("price_score")).alias("price_score"), X.r6(F.col("margin_score")).alias("margin_score"))


@query("rerank_weighted", "products ev inventory", f"with {RERANK} select query_id, product_id, rank, round(score, 6) + 0.0 as score from fin")
def rerank(s, d):
    return reranked(s, d).select("query_id", "product_id", "rank", X.r6(F.col("score")).alias("score"))


@query("final_rank_4key", "products ev inventory", f"with {RERANK} select query_id, product_id, rank, stock from fin where rank <= 5")
def final_rank(s, d):
    return reranked(s, d).where("rank <= 5").select("query_id", "product_id", "rank", "stock")


@query("penalty_update", "inventory", "select product_id, round(margin - case when stock <= 10 then 0.35::double else 0 end, 6) + 0.0 as score from inventory")
def penalty(s, d):
    return A.inventory(s, d).select("product_id", X.r6(F.col("margin") - F.when(F.col("stock") <= 10, 0.35).otherwise(0.0)).alias("score"))


@query("business_summary", "products ev inventory", f"with {RERANK} select count(*) as n_recommendations, round(avg((stock > 0)::int::double), 6) + 0.0 as in_stock_rate, round(avg(margin), 6) + 0.0 as avg_margin, round(avg(return_rate), 6) + 0.0 as avg_return_rate, count(distinct category) as category_diversity from fin join products using (product_id) where rank <= 5")
def business(s, d):
    r = reranked(s, d).where("rank <= 5")
    m = M.business_summary(r)
    return m.select("n_recommendations", *(X.r6(F.col(c)).alias(c) for c in ("in_stock_rate", "avg_margin", "avg_return_rate")), "category_diversity")


@query("business_notes", "inventory products", "with s as (select avg((stock > 0)::int::double) as a, avg(margin) as m, avg(return_rate) as r, count(distinct category) as c from inventory join products using (product_id)) select case when a >= 0.8 then 'good' else 'risk' end as availability, case when m >= 0.40 then 'good' else 'risk' end as margin, case when r <= 0.10 then 'good' else 'risk' end as return_risk, case when c >= 3 then 'good' else 'risk' end as diversity from s")
def notes(s, d):
    return M.business_notes(M.business_summary(A.inventory(s, d).join(A.products(s, d).select("product_id", "category"), "product_id")))


@query("vocab_longest_match", "products", f"with {values()}, v as (select value, (dense_rank() over (order by value) - 1)::int as code from (select distinct lower(color) as value from products union select distinct lower(split_part(style_tags, ',', 2)) from products) where value <> ''), h as (select query_id, code, row_number() over (partition by query_id order by length(value) desc, code) as n from req join v on contains(lower(query), value)) select query_id, coalesce(code, -1)::int as code from req left join (select * from h where n = 1) using (query_id)")
def vocab(s, d):
    p = A.products(s, d)
    v = p.select(F.lower("color").alias("value")).union(p.select(F.lower(F.get(F.split("style_tags", ","), F.lit(1))))).distinct().where("value <> ''")
    v = v.withColumn("code", F.dense_rank().over(R.Window.orderBy("value")) - 1)
    return B.longest_match(requests(s), v)


@query("review_summary", "reviews", """with b as (select product_id, count(*) as n, round_even(avg(rating), 1) as avg_rating from reviews group by 1), f as (select product_id, fit_feedback, count(*) as k from reviews group by 1, 2),
 g as (select product_id, string_agg(fit_feedback || ':' || printf('%.2f', round(k / t::double, 2)), ',' order by k desc, fit_feedback) as fits from (select *, sum(k) over (partition by product_id) as t from f) group by 1),
 q as (select product_id, string_agg(review_id::varchar, ',' order by n) as best from (select *, row_number() over (partition by product_id order by rating desc, review_id) as n from reviews) where n <= 2 group by 1)
 select product_id, n, round(avg_rating, 1) as avg_rating, fits, best from b join g using (product_id) join q using (product_id)""")
def review_summary(s, d):
    r = B.review_summary(A.reviews(s, d))
    return r.select("product_id", "n", F.round("avg_rating", 1).alias("avg_rating"), "fits", F.array_join(F.transform("samples", lambda x: x["review_id"].cast("string")), ",").alias("best"))


@query("fit_distribution", "reviews", "select product_id, fit_feedback, count(*) as k, round(count(*) / sum(count(*)) over (partition by product_id)::double, 6) as share from reviews group by 1, 2")
def fit_distribution(s, d):
    g = A.reviews(s, d).groupBy("product_id", "fit_feedback").agg(F.count(F.lit(1)).alias("k"))
    return g.withColumn("share", F.round(F.col("k") / F.sum("k").over(R.Window.partitionBy("product_id")), 6))


@query("explain_recommendations", "products ev inventory reviews", f"""with {RERANK}, rv as (select product_id, count(*) as n from reviews group by 1)
 select query_id, rank, product_id, (1 + (preference_score > 0.05)::int + 1 + (return_rate <= 0.08)::int + 1)::int as n_why, (6 + 1 + case when n > 0 then 2 + least(n, 2) else 0 end)::int as n_evidence from fin left join rv using (product_id) where rank <= 3""")
def explained(s, d):
    got = B.explain(reranked(s, d).where("rank <= 3"), A.products(s, d), B.review_summary(A.reviews(s, d)))
    return got.select("query_id", "rank", "product_id", F.size("why").alias("n_why"), F.size("evidence").alias("n_evidence"))


@query("respond_nested")
def respond(s, d):
    a = B.Assistant(A.products(s, d), A.events(s, d), A.inventory(s, d), A.reviews(s, d))
    return B.respond(a.recommend_batch(requests(s), 3), 3)


@query("citation_coverage")
def coverage(s, d):
    a = B.Assistant(A.products(s, d), A.events(s, d), A.inventory(s, d), A.reviews(s, d))
    return a.recommend_batch(requests(s), 3).groupBy("query_id").agg(M.citation_coverage().alias("coverage"))
