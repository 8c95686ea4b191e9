"""Rule queries over the purchase log, with parameters that give rows on the small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import rules as R
from ..sources import adapters as A
from .registry import query

POP = 100


def out(df):
    return df.select("uidx", "iidx", "method", X.r6(F.col("score")).alias("score"))


def sel(method: str, score: str) -> str:
    return f"select uidx, iidx, '{method}' as method, round(({score})::double, 6) + 0.0 as score"


OH = "oh as (select uidx, iidx, min(m - day) as diff from (select *, max(day) over (partition by uidx) as m from tx) where m - day < {d} group by 1, 2)"
DECAY = """a as (select uidx, iidx, greatest(last - day, 1) as gap, (last - day) // {d} as period from tx, lastday),
 s as (select period, iidx, count(*) as own from a group by 1, 2),
 v as (select a.uidx, a.iidx, greatest(2.5e4 / sqrt(gap) + 1.5e5 * exp(-0.2 * gap) - 1e3, 0) * coalesce(n.own, 0) / s.own as value
   from a join s using (period, iidx) left join (select iidx, own from s where period = 0) n on n.iidx = a.iidx)"""
COUNTS = """c as (select {k} iidx, count(*) filter (last - day <= {d} - 1) as recent, count(*) filter (last - day > {d} - 1) as previous
  from tx {j} cross join lastday where last - day <= 2 * {d} - 1 group by {k} iidx)"""


@query("rule_order_history", "tx", "with " + OH.format(d=35) + " , r as (select *, row_number() over (partition by uidx order by diff, iidx) as n from oh) " + sel("OrderHistory_1", "-diff") + " from r where n <= 12")
def order_history(s, d):
    return out(R.order_history(A.tx(s, d), 35, 12))


@query("rule_order_history_decay", "tx lastday", "with " + DECAY.format(d=7) + ", g as (select uidx, iidx, sum(value) as value from v group by 1, 2) " + sel("OrderHistoryDecay_1", "value") + " from g where value > 150")
def order_history_decay(s, d):
    return out(R.order_history_decay(A.tx(s, d), 7))


@query("rule_item_pair", "tx", "with " + OH.format(d=35) + """, p as (select x.iidx, y.iidx as pair, count(*) as k from oh x join oh y using (uidx) where x.iidx <> y.iidx group by 1, 2),
 b as (select * from (select *, row_number() over (partition by iidx order by k desc, pair) as n from p) where n = 1),
 u as (select *, row_number() over (partition by uidx, pair order by i) as m from (select oh.uidx, b.pair, b.k, oh.iidx as i from oh join b using (iidx)))
 select uidx, pair as iidx, 'ItemPairRetrieve_1' as method, k::double as score from u where m = 1""")
def item_pair(s, d):
    return out(R.item_pair(R.order_history(A.tx(s, d), 35)))


CF = """seq as (select uidx, {g} iidx, row_number() over (partition by uidx order by day, iidx, okey, line) - 1 as pos, count(*) over (partition by uidx) as n from tx {j} cross join lastday where day >= last - 79),
 sim as (select {g1} a.iidx, b.iidx as related, sum(case when b.pos > a.pos then 1.0 else 0.9 end::double * pow(0.7::double, abs(b.pos - a.pos) - 1) / ln(1 + a.n)) as weight
   from seq a join seq b on a.uidx = b.uidx and a.pos <> b.pos and a.pos < a.n - 1 group by all),
 best as (select *, row_number() over (partition by {g} iidx order by round(weight, 9) desc, related) as r from (select *, count(*) over (partition by {g} iidx) as k from sim) where k >= {k}),
 t as (select distinct uidx, {g} iidx from seq)
 select t.uidx, best.related as iidx, '{m}' as method, round(weight, 6) + 0.0 as score from t join best using ({g} iidx) where r <= 10"""


@query("rule_item_cf", "tx lastday", "with " + CF.format(g="", g1="", j="", k=5, m="ItemCF_1"))
def item_cf(s, d):
    win = R.trailing(A.tx(s, d), 80)
    return out(R.item_cf_predict(R.item_cf_sim(win, 10), win))


@query("rule_ug_item_cf", "tx lastday users", "with " + CF.format(g="age_band,", g1="a.age_band,", j="join users using (uidx)", k=5, m="UGItemCF_1"))
def ug_item_cf(s, d):
    win = R.trailing(A.tx(s, d), 80).join(A.users(s, d).select("uidx", "age_band"), "uidx")
    return out(R.item_cf_predict(R.item_cf_sim(win, 10, "age_band"), win, group="age_band"))


@query("rule_time_history", "tx lastday users", "with c as (select iidx, count(distinct uidx) as k from tx, lastday where day >= last - 59 group by 1), t as (select * from c order by k desc, iidx limit 50) " + sel("TimeHistory_1", "k") + " from users cross join t")
def time_history(s, d):
    return out(R.time_history(R.trailing(A.tx(s, d), 60), A.users(s, d), 50))


@query("rule_time_history_decay", "tx lastday users", "with " + DECAY.format(d=7) + ", g as (select iidx, sum(value) as value from v group by 1), t as (select * from g order by round(value, 6) desc, iidx limit 50) " + sel("TimeHistoryDecay_1", "value") + " from users cross join t")
def time_history_decay(s, d):
    return out(R.time_history_decay(A.tx(s, d), A.users(s, d)))


@query("rule_sale_trend", "tx lastday users", "with " + COUNTS.format(k="", j="", d=180) + ", t as (select *, (recent - previous) / previous::double as trend from c where previous > 0), b as (select * from t where trend > 0.8 order by recent desc, trend desc, iidx limit 50) " + sel("SaleTrend_1", "trend") + " from users cross join b")
def sale_trend(s, d):
    return out(R.sale_trend(A.tx(s, d), A.users(s, d), 180))


@query("rule_ug_time_history", "tx lastday users", """with c as (select age_band, iidx, count(distinct uidx) as k from tx join users using (uidx) cross join lastday where day >= last - 59 group by 1, 2),
 t as (select * from (select *, row_number() over (partition by age_band order by k desc, iidx) as n from c) where n <= 50), m as (select max(k) as most from t) """ + sel("UGTimeHistory_1", "k / most::double") + " from users join t using (age_band) cross join m")
def ug_time_history(s, d):
    return out(R.ug_time_history(R.trailing(A.tx(s, d), 60), A.users(s, d), "age_band", 50, True))


@query("rule_ug_sale_trend", "tx lastday users", "with " + COUNTS.format(k="age_band,", j="join users using (uidx)", d=180) + """, t as (select *, (recent - previous) / (previous + 1)::double as trend from c where previous > 0),
 b as (select * from (select *, row_number() over (partition by age_band order by recent desc, trend desc, iidx) as n from t where trend > 0.4) where n <= 50) """ + sel("UGSaleTrend_1", "trend") + " from users join b using (age_band)")
def ug_sale_trend(s, d):
    return out(R.ug_sale_trend(A.tx(s, d), A.users(s, d), "age_band", 180, 50, 0.4))


@query("rule_out_of_stock", "tx lastday", "with " + COUNTS.format(k="", j="", d=30) + " select iidx, recent, previous from c where previous > 0 and ((recent - previous) / previous::double < -0.8 or recent = 0)")
def out_of_stock(s, d):
    return R.out_of_stock(A.tx(s, d))


@query("rule_recent_pool", "tx lastday", "select iidx, count(*) as count from tx, lastday where day > last - 5 group by 1 order by 2 desc, 1 limit 1000")
def recent_pool(s, d):
    return R.recent_pool(A.tx(s, d))


TRIPLES = """p as (select iidx, count(*) as pop from tx cross join lastday where {w} group by 1),
 t as (select *, row_number() over (partition by cat_code, style_code, occ_code order by pop desc, iidx) as pos from (select iidx, cat_code, style_code, occ_code, coalesce(pop, 0) as pop from items left join p using (iidx))),
 q as (select uidx, cat_code, style_code, occ_code from (select uidx, iidx, row_number() over (partition by uidx order by day desc, iidx, okey, line) as n from tx) join items using (iidx) where n = 1)"""


def triples_of_users(s, d):
    return R.top(A.tx(s, d), 1, ["uidx"], F.desc("day"), F.col("iidx"), F.col("okey"), F.col("line")).select("uidx", "iidx").join(A.items(s, d), "iidx").select("uidx", "cat_code", "style_code", "occ_code")


@query("rule_query_match", "tx lastday items", "with " + TRIPLES.format(w="day >= last - 27") + " select uidx, iidx, 'QueryMatch_recent' as method, round(1.0::double / pos, 6) + 0.0 as score from q join t using (cat_code, style_code, occ_code) where pos <= 200")
def query_match(s, d):
    return out(R.query_match(triples_of_users(s, d), R.triple_tables(A.tx(s, d), A.items(s, d)), "recent"))


@query("topk_per_triple", "tx lastday items", "with " + TRIPLES.format(w="true") + " select cat_code, style_code, occ_code, iidx, pop, pos::int as pos from t where pos <= 5")
def topk_per_triple(s, d):
    return R.triple_tables(A.tx(s, d), A.items(s, d), 5, None).select("cat_code", "style_code", "occ_code", "iidx", "pop", "pos")


def vectors(s, d):
    return A.raw(s, d, "embeddings").select(F.col("vec_id").alias("iidx"), F.col("embedding").alias("v"))


DOT = "list_reduce(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::double * {b}[i]::double), lambda x, y: x + y)"


@query("rule_w2v_i2i", "tx", """with e as (select vec_id as iidx, embedding as v from embeddings), s as (select a.iidx, b.iidx as related, round(""" + DOT.format(a="a.v", b="b.v") + """, 6) as weight from e a join e b on a.iidx <> b.iidx),
 n as (select *, row_number() over (partition by iidx order by weight desc, related) as r from s), t as (select distinct uidx, iidx from tx)
 select uidx, related as iidx, 'W2V_1' as method, weight + 0.0 as score from t join n using (iidx) where r <= 10""")
def w2v_i2i(s, d):
    e = vectors(s, d)
    target = A.tx(s, d)
    pairs = R.nearest(e.select("iidx", F.col("v").alias("a")), e.select(F.col("iidx").alias("related"), F.col("v").alias("b")), 10, "iidx", "related", skip_self=True)
    return out(R.neighbours(pairs, target))


@query("rule_prone_u2i", "", """with e as (select vec_id as iidx, label, embedding as v from embeddings), p as (select iidx, v from e),
 s as (select e.iidx as uidx, p.iidx, round(""" + DOT.format(a="e.v", b="p.v") + """, 6) as weight from e cross join p)
 select uidx, iidx, 'ProNE_1' as method, weight + 0.0 as score from (select *, row_number() over (partition by uidx order by weight desc, iidx) as r from s) where r <= 20""")
def prone_u2i(s, d):
    e = vectors(s, d)
    got = R.nearest(e.select(F.col("iidx").alias("uidx"), F.col("v").alias("a")), e.select("iidx", F.col("v").alias("b")), 20, "uidx", "iidx")
    return out(R.named(got, "ProNE_1", F.col("weight")))


@query("embedding_dot_topn", "", """with u as (select label, i as dim, avg(v::double) as x from (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings) group by 1, 2),
 s as (select u.label, e.vec_id, round(sum(u.x * e.embedding[u.dim]::double), 6) + 0.0 as score from u join embeddings e on true group by 1, 2)
 select label, vec_id, score, r as rank from (select *, row_number() over (partition by label order by score desc, vec_id)::int as r from s) where r <= 10""")
def embedding_dot_topn(s, d):
    e = A.raw(s, d, "embeddings")
    m = e.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    m = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda t: t["x"]).alias("b"))
    got = e.select("vec_id", F.col("embedding").alias("a")).crossJoin(F.broadcast(m)).select("label", "vec_id", (F.round(X.dot(F.col("a"), F.col("b")), 6) + 0.0).alias("score"))
    w = R.Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(w)).where("rank <= 10")
