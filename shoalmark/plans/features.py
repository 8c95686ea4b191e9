"""Feature-store queries, point in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import features as T
from ..operators import rules as R
from ..sources import adapters as A
from .registry import query

#: 2001-06-01, two months before the log ends.
DAY = 11474


def rounded(df, keys, cols):
    return df.select(*keys, *(X.r6(F.col(c)).alias(c) for c in cols))


def unit_sql(key: str, p: str) -> str:
    w = lambda lo, hi=0: f"day >= {DAY} - {lo} and day < {DAY} - {hi}"
    sales = ", ".join(f"count(*) filter ({w(7 * k)}) as w{k}" for k in T.WEEKS)
    ranks = ", ".join(f"case when w{k} > 0 then rank() over (order by w{k} desc) + (count(*) over (partition by w{k}) - 1) / 2.0::double else (select count(*) from a where w{k} > 0) + 1.0::double end as r{k}" for k in T.WEEKS)
    cols = [f"w{k} as {p}_{k}w_sale" for k in T.WEEKS] + [f"r{k} as {p}_{k}w_sale_rank" for k in T.WEEKS]
    cols += [f"w{k} / greatest((select sum(w{k}) from a)::double, 1e-6) as {p}_{k}w_sale_norm" for k in T.WEEKS]
    cols += [f"lw as lw_{p}_sale", f"u as {p}_sale_uni", f"lu as lw_{p}_sale_uni", f"ly as {p}_ly_sale", f"n as {p}_full_sale", f"pop as {p}_pop", f"age as {p}_age", f"tm as {p}_time_mean"]
    cols += [f"rep as {p}_repurchase_ratio", f"w1 / (u + 1e-6) as {p}_uni_ratio", f"lw / (lu + 1e-6) as lw_{p}_uni_ratio", f"(w1 - lw) / (lw + 1e-6) as {p}_sale_trend", f"n / age::double as {p}_daily_sale"]
    cols += [f"w1 / (n + 1e-6) as {p}_w_full_sale_ratio", f"w2 / (n + 1e-6) as {p}_2w_full_sale_ratio", f"w1 / 7.0::double - n / age::double as {p}_week_above_daily_sale", f"w2 / 14.0::double - n / age::double as {p}_2w_week_above_daily_sale"]
    out = ", ".join(f"round(({c.rsplit(' as ', 1)[0]})::double, 6) + 0.0 as {c.rsplit(' as ', 1)[1]}" for c in cols)
    return f"""with t as (select * from tx join (select iidx, fidx from items) using (iidx) where day < {DAY}),
 a as (select {key}, {sales}, count(*) filter ({w(14, 7)}) as lw, count(distinct uidx) filter ({w(7)}) as u, count(distinct uidx) filter ({w(14, 7)}) as lu, count(*) filter ({w(372, 358)}) as ly,
   count(*) as n, sum(1.0::double / ({DAY} - day)) as pop, greatest({DAY} - min(day), 1) as age, {DAY} - avg(day) as tm from t group by 1),
 p as (select {key}, count(*) filter (k > 1) / (count(*) + 1e-6) as rep from (select {key}, uidx, count(*) as k from t group by 1, 2) group by 1),
 r as (select *, {ranks} from a join p using ({key})) select {key}, {out} from r"""


def unit_cols(p: str) -> list[str]:
    c = [f"{p}_{k}w_sale{x}" for k in T.WEEKS for x in ("", "_rank", "_norm")]
    c += [f"lw_{p}_sale", f"{p}_sale_uni", f"lw_{p}_sale_uni", f"{p}_ly_sale", f"{p}_full_sale", f"{p}_pop", f"{p}_age", f"{p}_time_mean", f"{p}_repurchase_ratio", f"{p}_uni_ratio", f"lw_{p}_uni_ratio"]
    return c + [f"{p}_sale_trend", f"{p}_daily_sale", f"{p}_w_full_sale_ratio", f"{p}_2w_full_sale_ratio", f"{p}_week_above_daily_sale", f"{p}_2w_week_above_daily_sale"]


@query("feat_item_windows", "tx items", unit_sql("iidx", "i"))
def item_windows(s, d):
    return rounded(T.unit_table(A.tx(s, d), DAY, "iidx", "i"), ["iidx"], unit_cols("i"))


@query("feat_family_windows", "tx items", unit_sql("fidx", "p"))
def family_windows(s, d):
    t = A.tx(s, d).join(A.items(s, d).select("iidx", "fidx"), "iidx")
    return rounded(T.unit_table(t, DAY, "fidx", "p"), ["fidx"], unit_cols("p"))


@query("feat_category", "tx items", f"""with c as (select cat_code, count(*) filter (day >= {DAY} - 7) as cat_sale, count(*) filter (day >= {DAY} - 14 and day < {DAY} - 7) as lw_cat_sale from tx join items using (iidx) where day < {DAY} group by 1)
 select cat_code, cat_sale, lw_cat_sale, round((cat_sale - lw_cat_sale) / (lw_cat_sale + 1e-6), 6) + 0.0 as cat_sale_trend from c""")
def category(s, d):
    return T.category_table(A.tx(s, d), A.items(s, d), DAY).withColumn("cat_sale_trend", X.r6(F.col("cat_sale_trend")))


@query("feat_user_time", "tx", f"""select uidx, ({DAY} - max(day))::int as customer_id_last_time, ({DAY} - min(day))::int as customer_id_first_time, round({DAY} - avg(day), 6) + 0.0 as customer_id_time_mean,
 (max(day) - min(day))::int as customer_id_gap, round(avg(price), 6) + 0.0 as user_mean_price from tx where day < {DAY} group by 1""")
def user_time(s, d):
    u = T.user_table(A.tx(s, d), DAY)
    return u.select("uidx", "customer_id_last_time", "customer_id_first_time", X.r6(F.col("customer_id_time_mean")).alias("customer_id_time_mean"), "customer_id_gap", X.r6(F.col("user_mean_price")).alias("user_mean_price"))


@query("feat_pair", "tx", f"select uidx, iidx, count(*) as ui_sale from tx where day < {DAY} group by 1, 2")
def pair(s, d):
    return T.pair_table(A.tx(s, d), DAY)


USERS = """au as (select uidx, (dense_rank() over (order by age_band) - 1)::int as age_code from users), pm as (select uidx, avg(price) as m from tx group by 1),
 pa as (select uidx, greatest(ceil(5 * (r - 1) / greatest(n - 1, 1)::double) - 1, 0)::int as purchase_ability from (select uidx, row_number() over (order by round(m, 6), uidx) as r, count(*) over () as n from pm))"""


def coded_users(s, d):
    u = A.users(s, d)
    dim = u.select("age_band").distinct().withColumn("age_code", F.dense_rank().over(R.Window.orderBy("age_band")) - 1)
    return u.join(F.broadcast(dim), "age_band").join(T.purchase_ability(A.tx(s, d)), "uidx")


@query("quintile_purchase_ability", "tx users", "with " + USERS + " select uidx, purchase_ability from pa")
def quintile(s, d):
    return T.purchase_ability(A.tx(s, d))


@query("tercile_budget_tier", "tx", """with m as (select uidx, median(price) as m from tx group by 1), r as (select uidx, row_number() over (order by round(m, 6), uidx) as r, count(*) over () as n from m)
 select uidx, case least(3 * (r - 1) // greatest(n - 1, 1), 2) when 0 then 'low' when 1 then 'mid' else 'high' end as budget_tier from r""")
def tercile(s, d):
    return T.budget_tier(A.tx(s, d))


BUYERS = f"""with {USERS}, t as (select * from tx join au using (uidx) join pa using (uidx) where day < {DAY})
 select iidx, round(avg(age_code), 6) + 0.0 as i_buyer_age_mean, round(coalesce(stddev_samp(age_code), 0), 6) + 0.0 as i_buyer_age_std, round(avg(purchase_ability), 6) + 0.0 as i_buyer_pa_mean from t group by 1"""


@query("feat_buyer_profile", "tx users", BUYERS)
def buyer_profile(s, d):
    return rounded(T.buyer_profile(A.tx(s, d), coded_users(s, d), DAY), ["iidx"], ["i_buyer_age_mean", "i_buyer_age_std", "i_buyer_pa_mean"])


@query("feat_last_year", "tx items", f"select fidx, iidx, count(*) filter (day >= {DAY} - 372 and day < {DAY} - 358) as ly, round(count(*) filter (day >= {DAY} - 372 and day < {DAY} - 358) / (count(*) filter (day >= {DAY} - 14) + 1e-6), 6) + 0.0 as ly_ratio from tx join items using (iidx) where day < {DAY} group by 1, 2")
def last_year(s, d):
    t = T.unit_table(A.tx(s, d), DAY, "iidx", "i").join(A.items(s, d).select("iidx", "fidx"), "iidx")
    return t.select("fidx", "iidx", F.col("i_ly_sale").alias("ly"), X.r6(X.ratio(F.col("i_ly_sale"), F.col("i_2w_sale"))).alias("ly_ratio"))


@query("feat_affinity", "tx items", f"""select uidx, 'cat' as kind, cat_code::bigint as code, round(sum(1.0::double / ({DAY} - day)), 6) + 0.0 as value from tx join items using (iidx) where day < {DAY} group by all
 union all select uidx, 'fam' as kind, fidx::bigint as code, round(sum(1.0::double / ({DAY} - day)), 6) + 0.0 as value from tx join items using (iidx) where day < {DAY} group by all""")
def affinity(s, d):
    t, i = A.tx(s, d), A.items(s, d)
    one = lambda k, name: T.affinity(t, i, DAY, k, "value").select("uidx", F.lit(name).alias("kind"), F.col(k).cast("long").alias("code"), X.r6(F.col("value")).alias("value"))
    return one("cat_code", "cat").unionByName(one("fidx", "fam"))


CANDS = "cand as (select uidx, iidx from (select *, max(day) over (partition by uidx) as m from tx where day < {d}) where m - day < 35 group by 1, 2)"


def candidates(s, d):
    return R.order_history(R.before(A.tx(s, d), DAY), 35).select("uidx", "iidx")


@query("feat_query_agreement", "tx items", "with " + CANDS.format(d=DAY) + """, q as (select uidx, cat_code, style_code, occ_code from (select uidx, min(iidx) as iidx from cand group by 1) join items using (iidx))
 select c.uidx, c.iidx, (i.cat_code = q.cat_code)::int as q_cat_eq, (i.style_code = q.style_code)::int as q_style_eq, (i.occ_code = q.occ_code)::int as q_occ_eq,
 (i.cat_code = q.cat_code)::int + (i.style_code = q.style_code)::int + (i.occ_code = q.occ_code)::int as q_match from cand c join items i using (iidx) join q using (uidx)""")
def query_agreement(s, d):
    c = candidates(s, d)
    q = c.groupBy("uidx").agg(F.min("iidx").alias("iidx")).join(A.items(s, d), "iidx")
    return T.query_agreement(c, q, A.items(s, d))


@query("feat_joined", "tx items", "with " + CANDS.format(d=DAY) + f""", t as (select * from tx where day < {DAY}), i as (select iidx, count(*) as full_, count(*) filter (day >= {DAY} - 7) as w1, arg_max(price, struct_pack(day, okey, line)) as item_price from t group by 1),
 f as (select fidx, count(*) filter (day >= {DAY} - 7) as w1 from t join items using (iidx) group by 1), u as (select uidx, avg(price) as p from t group by 1), ui as (select uidx, iidx, count(*) as n from t group by 1, 2),
 fa as (select uidx, fidx, sum(1.0::double / ({DAY} - day)) as v from t join items using (iidx) group by 1, 2)
 select c.uidx, c.iidx, items.fidx, round(i.w1 / (f.w1 + 1e-6), 6) + 0.0 as i_sale_ratio, round(i.item_price / (u.p + 1e-6), 6) + 0.0 as price_ratio, round(ui.n / (i.full_ + 1e-6), 6) + 0.0 as ui_sale_ratio, round(fa.v, 6) + 0.0 as u_fam_affinity
 from cand c join items using (iidx) join i using (iidx) join f on f.fidx = items.fidx join u on u.uidx = c.uidx join ui on ui.uidx = c.uidx and ui.iidx = c.iidx join fa on fa.uidx = c.uidx and fa.fidx = items.fidx""")
def joined(s, d):
    df = T.join_features(candidates(s, d), A.tx(s, d), A.items(s, d), DAY)
    return rounded(df, ["uidx", "iidx", "fidx"], ["i_sale_ratio", "price_ratio", "ui_sale_ratio", "u_fam_affinity"])
