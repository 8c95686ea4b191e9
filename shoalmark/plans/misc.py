"""Projections, filters, joins, aggregations, windows, metrics, splits and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..operators import collect as C
from ..operators import evaluate as E
from ..operators import metrics as M
from ..operators import rules as R
from ..sources import adapters as A
from ..sources import loaders as L
from .registry import query

W = Window.partitionBy


@query("scan_required_columns", "", "select p_partkey, p_name, p_type from part")
def scan_required(s, d):
    return L.check_columns(A.raw(s, d, "part"), ["p_partkey", "p_name", "p_type"], "part").select("p_partkey", "p_name", "p_type")


@query("coerce_defaults", "", "select event_id, coalesce(try_cast(case when event_id % 7 = 0 then 'bad' else value::varchar end as double), 0.0::double) as value from events")
def coerce_defaults(s, d):
    e = A.raw(s, d, "events")
    raw = F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.col("value").cast("string"))
    return e.select("event_id", F.coalesce(raw.try_cast("double"), F.lit(0.0)).alias("value"))


@query("event_weight_map", "ev", "select event_id, event_weight from ev")
def event_weight(s, d):
    return A.events(s, d).select("event_id", "event_weight")


@query("real_ids", "", "select p_partkey, case when p_partkey % 3 = 0 then 'x' || p_partkey else lpad(p_partkey::varchar, greatest(length(p_partkey::varchar), 10)::int, '0') end as id from part")
def real_ids(s, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string"))
    return A.raw(s, d, "part").select("p_partkey", X.padded_id(raw).alias("id"))


@query("product_text", "products", "select product_id, concat_ws(' ', name, coalesce(case when size > 25 then category end, ''), color, description) as text from products")
def product_text(s, d):
    p = A.products(s, d)
    return p.select("product_id", X.searchable(F.col("name"), F.when(F.col("size") > 25, F.col("category")), F.col("color"), F.col("description")).alias("text"))


@query("tag_split_explode", "products", "select distinct product_id, lower(trim(t)) as tag from (select product_id, unnest(string_split(replace(style_tags || ' ; ' || occasion_tags, ';', ','), ',')) as t from products) where trim(t) <> ''")
def tag_split(s, d):
    p = A.products(s, d)
    return p.select("product_id", F.explode(X.tags(F.concat_ws(" ; ", "style_tags", "occasion_tags"))).alias("tag"))


@query("first_present", "", "select c_custkey, coalesce(nullif(case when c_custkey % 2 = 0 then '' else c_name end, ''), nullif(c_mktsegment, ''), 'unknown') as v from customer")
def first_present(s, d):
    c = A.raw(s, d, "customer")
    return c.select("c_custkey", X.first_present(F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name")), F.col("c_mktsegment"), default="unknown").alias("v"))


@query("ordered_distinct_join", "products", "select product_id, case when color = split_part(name, ' ', 2) then color || ',' || category else color || ',' || split_part(name, ' ', 2) || ',' || category end as v from products")
def ordered_distinct(s, d):
    return A.products(s, d).select("product_id", X.distinct_join(F.col("color"), F.get(F.split("name", " "), F.lit(1)), F.col("color"), F.lit(""), F.col("category")).alias("v"))


@query("age_band_bins", "", """select c_custkey, case when a is null or a <= 0 or a > 120 then 'nan' when a <= 17 then '0-17' when a <= 24 then '18-24' when a <= 34 then '25-34' when a <= 44 then '35-44' when a <= 54 then '45-54' when a <= 64 then '55-64' else '65+' end as band
 from (select c_custkey, case when c_custkey % 11 = 0 then null else c_custkey % 130 - 3 end as a from customer)""")
def age_bands(s, d):
    age = F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey") % 130 - 3)
    return A.raw(s, d, "customer").select("c_custkey", X.age_band(age).alias("band"))


STATUS = ["Returned", " cancelled ", "Processing", "Shipped"]


@query("status_to_event", "", "select o_orderkey, case o_orderkey % 4 when 0 then 'return' when 1 then 'cancel' when 2 then 'cart' else 'purchase' end as event_type from orders")
def status_event(s, d):
    st = F.element_at(F.array(*map(F.lit, STATUS)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return A.raw(s, d, "orders").select("o_orderkey", X.status_event(st).alias("event_type"))


@query("family_code", "", "select p_partkey, left(lpad(p_partkey::varchar, 10, '0'), 7) as family from part")
def family_code(s, d):
    pid = X.padded_id(F.col("p_partkey").cast("string"))
    return A.raw(s, d, "part").select("p_partkey", pid.alias("id")).select("p_partkey", F.expr("substring(id, 1, greatest(length(id) - 3, 0))").alias("family"))


@query("gender_season_flags", "", """select p_partkey, case when p_partkey % 5 in (1, 3) or cat in ('Dress', 'Beanie') then 2 when p_partkey % 5 = 0 then 1 else 0 end as gender, case when cat in ('Beanie', 'Boots') then 2 when cat in ('Dress', 'Sandals') then 1 else 0 end as season
 from (select p_partkey, case p_partkey % 6 when 0 then 'Dress' when 1 then 'Beanie' when 2 then 'Boots' when 3 then 'Sandals' when 4 then 'Tie' end as cat from part)""")
def gender_season(s, d):
    cats = F.get(F.array(*map(F.lit, ("Dress", "Beanie", "Boots", "Sandals", "Tie"))), (F.col("p_partkey") % 6).cast("int"))
    style = F.get(F.array(*map(F.lit, ("MENSWEAR basics", "Ladieswear", "Kids", "all LADIESWEAR"))), (F.col("p_partkey") % 5).cast("int"))
    p = A.raw(s, d, "part").select("p_partkey", cats.alias("c"), F.coalesce(style, F.lit("")).alias("t"))
    return p.select("p_partkey", X.gender_code(F.col("c"), F.col("t")).alias("gender"), X.season_code(F.col("c")).alias("season"))


@query("dense_codes", "items", "select iidx, fidx, cat_code, style_code, occ_code, color_code from items")
def dense_codes(s, d):
    return A.items(s, d).drop("price")


@query("json_props_extract", "", "select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def json_props(s, d):
    return A.raw(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("margin_clip", "", "select p_partkey, round(least(greatest((p_retailprice - p_size * 40) / case when p_retailprice > 0 then p_retailprice else 1 end, 0), 1), 6) + 0.0 as margin from part")
def margin_clip(s, d):
    m = (F.col("p_retailprice") - F.col("p_size") * 40) / F.when(F.col("p_retailprice") > 0, F.col("p_retailprice")).otherwise(1.0)
    return A.raw(s, d, "part").select("p_partkey", X.r6(F.least(F.greatest(m, F.lit(0.0)), F.lit(1.0))).alias("margin"))


@query("point_in_time_cut", "tx", "select iidx, count(*) as n, min(day) as first_day from tx where day < 11000 group by 1")
def point_in_time(s, d):
    return R.before(A.tx(s, d), 11000).groupBy("iidx").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"))


@query("trailing_windows", "tx lastday", "select count(*) filter (day >= last - 2) as d3, count(*) filter (day >= last - 6) as d7, count(*) filter (day >= last - 13) as d14, count(*) filter (day >= last - 59) as d60, count(*) filter (day >= last - 79) as d80 from tx, lastday")
def trailing(s, d):
    t = R.with_last(A.tx(s, d))
    return t.agg(*(F.count(F.when(F.col("day") >= F.col("last") - (n - 1), 1)).alias(f"d{n}") for n in (3, 7, 14, 60, 80)))


@query("top_active_users", "tx", "with a as (select uidx, count(*) as k from tx group by 1 order by 2 desc, 1 limit 50) select uidx, iidx, day from tx where uidx in (select uidx from a)")
def top_active(s, d):
    t = A.tx(s, d)
    a = t.groupBy("uidx").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "uidx").limit(50)
    return t.join(F.broadcast(a), "uidx", "left_semi").select("uidx", "iidx", "day")


@query("score_threshold", "tx", "select uidx, iidx, count(*) as k from tx group by 1, 2 having count(*) > 1")
def threshold(s, d):
    return A.tx(s, d).groupBy("uidx", "iidx").agg(F.count(F.lit(1)).alias("k")).where("k > 1")


@query("oos_anti_join", "inventory", "select p_partkey from part where p_partkey not in (select product_id from inventory where stock <= 10)")
def anti(s, d):
    gone = A.inventory(s, d).where("stock <= 10").select(F.col("product_id").alias("p_partkey"))
    return A.raw(s, d, "part").select("p_partkey").join(gone, "p_partkey", "left_anti")


@query("cohort_semi_join", "", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
def semi(s, d):
    rich = A.raw(s, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return A.raw(s, d, "customer").select("c_custkey").join(rich, "c_custkey", "left_semi")


@query("history_left_products", "ev products", "select event_id, user_id, category from ev left join products using (product_id)")
def history_left(s, d):
    return A.events(s, d).join(A.products(s, d).select("product_id", "category"), "product_id", "left").select("event_id", "user_id", "category")


@query("inventory_fill_defaults", "products inventory", "with i as (select * from inventory where product_id % 3 <> 0), j as (select product_id, category, stock, margin, return_rate from products left join i using (product_id)) select product_id, coalesce(stock, 0) as stock, round(coalesce(margin, median(margin) over (partition by category), 0.30), 6) + 0.0 as margin, round(coalesce(return_rate, 0.10), 6) + 0.0 as return_rate from j")
def fill_defaults(s, d):
    i = A.inventory(s, d).where("product_id % 3 <> 0")
    j = A.products(s, d).select("product_id", "category").join(i, "product_id", "left")
    return j.select("product_id", F.coalesce("stock", F.lit(0)).alias("stock"), X.r6(F.coalesce("margin", F.median("margin").over(W("category")), F.lit(0.30))).alias("margin"), X.r6(F.coalesce("return_rate", F.lit(0.10))).alias("return_rate"))


@query("self_pair_theta", "tx lastday", "with t as (select distinct uidx, iidx from tx, lastday where day >= last - 79) select a.iidx, b.iidx as pair, count(*) as k from t a join t b on a.uidx = b.uidx and a.iidx <> b.iidx group by 1, 2")
def self_pair(s, d):
    t = R.trailing(A.tx(s, d), 80).select("uidx", "iidx").distinct()
    return t.join(t.withColumnRenamed("iidx", "pair"), "uidx").where("iidx <> pair").groupBy("iidx", "pair").agg(F.count(F.lit(1)).alias("k"))


@query("group_broadcast_join", "users", "with g as (select age_band, min(uidx) as leader, count(*) as size from users group by 1) select uidx, leader, size from users join g using (age_band)")
def group_join(s, d):
    u = A.users(s, d)
    g = u.groupBy("age_band").agg(F.min("uidx").alias("leader"), F.count(F.lit(1)).alias("size"))
    return u.join(F.broadcast(g), "age_band").select("uidx", "leader", "size")


@query("global_cross_join", "tx users", "with t as (select iidx, count(*) as k from tx group by 1 order by 2 desc, 1 limit 5) select uidx, iidx, k from users cross join t")
def cross(s, d):
    t = A.tx(s, d).groupBy("iidx").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "iidx").limit(5)
    return A.users(s, d).select("uidx").crossJoin(F.broadcast(t))


@query("full_outer_trend_counts", "tx lastday", "with a as (select iidx, count(*) as recent from tx, lastday where day >= last - 29 group by 1), b as (select iidx, count(*) as previous from tx, lastday where day < last - 29 and day >= last - 59 group by 1) select iidx, coalesce(recent, 0) as recent, coalesce(previous, 0) as previous from a full outer join b using (iidx)")
def outer(s, d):
    return R.window_counts(A.tx(s, d), 30, ["iidx"])


LABELS = "lab as (select distinct uidx, iidx from tx, lastday where day > last - 30)"
HIST = "hist as (select uidx, iidx, min(m - day) as diff from (select tx.*, max(day) over (partition by uidx) as m from tx, lastday where day <= last - 30) where m - day < 365 group by 1, 2)"


def past(s, d):
    return R.with_last(A.tx(s, d)).where(F.col("day") <= F.col("last") - 30).drop("last")


def future(s, d):
    return R.trailing(A.tx(s, d), 30).select("uidx", "iidx").distinct()


@query("label_left_join", "tx lastday", f"with {LABELS}, {HIST} select h.uidx, h.iidx, (l.uidx is not null)::int as label from hist h left join lab l using (uidx, iidx)")
def label_join(s, d):
    c = R.order_history(past(s, d), 365).select("uidx", "iidx")
    return c.join(future(s, d).withColumn("label", F.lit(1)), ["uidx", "iidx"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


@query("triple_match_join", "items", "select q.iidx as a, i.iidx as b from items q join items i using (cat_code, style_code, occ_code)")
def triple(s, d):
    return R.same_triple(A.items(s, d))


@query("median_price", "tx", "select iidx, round(median(price) + 1e-7, 3) as price from tx group by 1")
def median(s, d):
    return A.tx(s, d).groupBy("iidx").agg(F.round(F.median("price") + 1e-7, 3).alias("price"))


@query("canonical_min_id", "products", "select product_id, min(product_id) over (partition by name, category, brand) as canonical from products")
def canonical(s, d):
    return A.products(s, d).select("product_id", F.min("product_id").over(W("name", "category", "brand")).alias("canonical"))


@query("preferred_style_top3_agg", "tx products", "with c as (select uidx, brand, count(*) as k from tx join products on iidx = product_id group by 1, 2), r as (select *, row_number() over (partition by uidx order by k desc, brand) as n from c) select uidx, string_agg(brand, ', ' order by n) as preferred_style from r where n <= 3 group by 1")
def preferred(s, d):
    p = A.products(s, d).select(F.col("product_id").alias("iidx"), "brand")
    c = A.tx(s, d).join(p, "iidx").groupBy("uidx", "brand").agg(F.count(F.lit(1)).alias("k"))
    r = c.withColumn("n", F.row_number().over(W("uidx").orderBy(F.desc("k"), "brand"))).where("n <= 3")
    return r.groupBy("uidx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "brand"))), lambda x: x["brand"]), ", ").alias("preferred_style"))


@query("return_rate_mean", "inventory", "select product_id, round(return_rate, 6) + 0.0 as return_rate from inventory")
def return_rate(s, d):
    return A.inventory(s, d).select("product_id", X.r6(F.col("return_rate")).alias("return_rate"))


@query("repurchase_ratio", "tx", "select iidx, round(count(*) filter (k > 1) / (count(*) + 1e-6), 6) + 0.0 as ratio from (select iidx, uidx, count(*) as k from tx group by 1, 2) group by 1")
def repurchase(s, d):
    per = A.tx(s, d).groupBy("iidx", "uidx").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("iidx").agg(X.r6(F.count(F.when(F.col("k") > 1, 1)) / (F.count(F.lit(1)) + 1e-6)).alias("ratio"))


@query("decayed_popularity", "tx lastday", "select iidx, round(sum(1.0::double / (last + 1 - day)), 6) + 0.0 as pop from tx, lastday group by 1")
def decayed(s, d):
    return R.with_last(A.tx(s, d)).groupBy("iidx").agg(X.r6(F.sum(1 / (F.col("last") + 1 - F.col("day")))).alias("pop"))


@query("mode_channel", "tx", "with c as (select iidx, channel, count(*) as k from tx group by 1, 2) select iidx, channel from (select *, row_number() over (partition by iidx order by k desc, channel) as n from c) where n = 1")
def mode(s, d):
    c = A.tx(s, d).groupBy("iidx", "channel").agg(F.count(F.lit(1)).alias("k"))
    return c.groupBy("iidx").agg(F.max_by("channel", F.struct("k", -F.col("channel"))).alias("channel"))


@query("buyer_age_std", "tx users", "with u as (select uidx, dense_rank() over (order by age_band) - 1 as c from users) select iidx, round(coalesce(stddev_samp(c), 0), 6) + 0.0 as sd from tx join u using (uidx) group by 1")
def age_std(s, d):
    u = A.users(s, d)
    dim = u.select("age_band").distinct().withColumn("c", F.dense_rank().over(Window.orderBy("age_band")) - 1)
    return A.tx(s, d).join(u.join(F.broadcast(dim), "age_band").select("uidx", "c"), "uidx").groupBy("iidx").agg(X.r6(F.coalesce(F.stddev_samp("c"), F.lit(0.0))).alias("sd"))


METHODS = ["OrderHistory_1", "OrderHistoryDecay_1"]


def outputs(s, d):
    t = A.tx(s, d)
    return [R.order_history(t, 35), R.order_history_decay(t, 7)]


BOTH = """a as (select uidx, iidx, min(m - day) as diff from (select *, max(day) over (partition by uidx) as m from tx) where m - day < 35 group by 1, 2),
 g0 as (select uidx, iidx, greatest(last - day, 1) as gap, (last - day) // 7 as period from tx, lastday), s0 as (select period, iidx, count(*) as own from g0 group by 1, 2),
 b as (select g0.uidx, g0.iidx, sum(greatest(2.5e4 / sqrt(gap) + 1.5e5 * exp(-0.2 * gap) - 1e3, 0) * coalesce(n.own, 0) / s0.own) as v from g0 join s0 using (period, iidx) left join (select iidx, own from s0 where period = 0) n on n.iidx = g0.iidx group by 1, 2 having v > 150),
 pv as (select uidx, iidx, -a.diff::double as x, b.v as y from a full outer join b using (uidx, iidx))"""


@query("pivot_rule_scores", "tx lastday", f"with {BOTH} select uidx, iidx, round(x, 6) + 0.0 as OrderHistory_1, round(y, 6) + 0.0 as OrderHistoryDecay_1 from pv")
def pivot(s, d):
    p = C.collect(outputs(s, d), METHODS)
    return p.select("uidx", "iidx", *(X.r6(F.col(m)).alias(m) for m in METHODS))


@query("minmax_cap_rank", "tx lastday", f"with {BOTH}, e as (select min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy from pv), z as (select uidx, iidx, round(coalesce((x - lx) / case when hx > lx then hx - lx else 1 end, 0) + coalesce((y - ly) / case when hy > ly then hy - ly else 1 end, 0), 9) as score from pv, e), r as (select *, row_number() over (partition by uidx order by score desc, iidx)::int as rank from z) select uidx, iidx, round(score, 6) + 0.0 as score, rank from r where rank <= 10")
def capped(s, d):
    c = C.cap(C.collect(outputs(s, d), METHODS), METHODS, 10)
    return c.select("uidx", "iidx", X.r6(F.col("score")).alias("score"), "rank")


@query("last_purchase_holdout", "ev", "select event_id, coalesce(row_number() over (partition by user_id order by ts desc nulls last, event_id desc) = 1 and ts is not null, false) as holdout from ev where event_type = 'purchase'")
def holdout(s, d):
    e = A.events(s, d).where(F.lower("event_type") == "purchase")
    return M.last_purchase(e, "user_id", "ts", "event_id").select("event_id", "holdout")


@query("user_scan_stats", "tx", "with t as (select *, max(day) over (partition by uidx) as last_day from tx) select uidx, count(*) as purchases, count(distinct day) as n_dates, max(last_day) as last_day, count(*) filter (day = last_day) as last_rows from t group by 1")
def scan_stats(s, d):
    return M.user_scan(A.tx(s, d))


QUOTA = "z as (select age_band as cell, count(*) as size from users group by 1), sh as (select cell, size * 101 / (sum(size) over ())::double as share from z), q as (select cell, floor(share)::bigint + (row_number() over (order by round(share - floor(share), 9) desc, cell) <= 101 - sum(floor(share)) over ())::int as quota from sh)"


@query("quota_largest_remainder", "users", f"with {QUOTA} select cell, quota from q where quota > 0")
def quota(s, d):
    z = A.users(s, d).groupBy(F.col("age_band").alias("cell")).agg(F.count(F.lit(1)).alias("size"))
    return M.quotas(z, 101).select("cell", F.col("quota").cast("long").alias("quota"))


@query("cohort_select", "tx users", f"with {QUOTA}, u as (select uidx, count(*) as p, count(distinct day) as n from tx group by 1), r as (select uidx, age_band as cell, row_number() over (partition by age_band order by n desc, p desc, uidx) as k from u join users using (uidx)) select uidx, cell from r join q using (cell) where k <= quota")
def cohort(s, d):
    u = A.users(s, d)
    z = u.groupBy(F.col("age_band").alias("cell")).agg(F.count(F.lit(1)).alias("size"))
    df = M.user_scan(A.tx(s, d)).join(u.select("uidx", F.col("age_band").alias("cell")), "uidx")
    w = W("cell").orderBy(F.desc("n_dates"), F.desc("purchases"), "uidx")
    return df.join(F.broadcast(M.quotas(z, 101)), "cell").withColumn("r", F.row_number().over(w)).where("r <= quota").select("uidx", "cell")


@query("modulo_holdout_pick", "tx", "with t as (select *, max(day) over (partition by uidx) as last from tx), r as (select *, row_number() over (partition by uidx order by day desc, iidx, okey, line) - 1 as i, count(*) over (partition by uidx) as n from t where day = last) select uidx, iidx, day from r where i = uidx % n")
def modulo_pick(s, d):
    return M.pick_of_last_day(A.tx(s, d), F.col("uidx"))


@query("crc32_holdout_pick")
def crc_pick(s, d):
    return M.pick_of_last_day(A.tx(s, d), F.crc32(F.col("uidx").cast("string").cast("binary")))


@query("topn_per_user", "tx", "select uidx, iidx, r as rank from (select uidx, iidx, row_number() over (partition by uidx order by day desc, iidx, okey, line)::int as r from tx) where r <= 3")
def topn(s, d):
    w = W("uidx").orderBy(F.desc("day"), "iidx", "okey", "line")
    return A.tx(s, d).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("uidx", "iidx", "rank")


@query("average_rank", "tx", "with c as (select iidx, count(*) as k from tx group by 1) select iidx, rank() over (order by k desc) + (count(*) over (partition by k) - 1) / 2.0::double as r from c")
def avg_rank(s, d):
    c = A.tx(s, d).groupBy("iidx").agg(F.count(F.lit(1)).alias("k"))
    return c.select("iidx", X.average_rank(Window.orderBy(F.desc("k")), W("k")).alias("r"))


@query("window_max_transform", "tx", "select uidx, iidx, day, max(day) over (partition by uidx) - day as age from tx")
def win_max(s, d):
    return A.tx(s, d).select("uidx", "iidx", "day", (F.max("day").over(W("uidx")) - F.col("day")).alias("age"))


SPLIT = """t as (select uidx, iidx, day, max(day) over (partition by uidx) as last from tx), tr as (select * from t where day < last), rel as (select distinct uidx, iidx from t where day = last),
 oh as (select uidx, iidx, min(m - day) as diff from (select *, max(day) over (partition by uidx) as m from tr) where m - day < 35 group by 1, 2), l1 as (select uidx, iidx, 1 as list_no, row_number() over (partition by uidx order by diff, iidx) - 1 as pos from oh),
 pc as (select iidx, count(distinct uidx) as k from tr where day >= (select max(day) from tr) - 59 group by 1 order by 2 desc, 1 limit 20), pp as (select iidx, row_number() over (order by k desc, iidx) - 1 as pos from pc),
 ls as (select * from l1 union all select u.uidx, iidx, 2, pos from (select distinct uidx from rel) u cross join pp), f as (select uidx, iidx, round(sum(1.0::double / (pos + 1)), 9) as score, min(list_no * 100000 + pos) as first from ls group by 1, 2),
 rk as (select uidx, iidx, score, row_number() over (partition by uidx order by score desc, first, iidx)::int as rank from f), r5 as (select * from rk where rank <= 5)"""


def split(s, d):
    t = A.tx(s, d).withColumn("last", F.max("day").over(W("uidx")))
    return t.where("day < last").drop("last"), t.where("day = last").select("uidx", "iidx").distinct()


def fused(s, d, k=5):
    train, rel = split(s, d)
    own = R.order_history(train, 35)
    one = own.select("uidx", "iidx", F.lit(1).alias("list_no"), (F.row_number().over(W("uidx").orderBy(F.desc("score"), "iidx")) - 1).alias("pos"))
    users = rel.select("uidx").distinct()
    pop = R.trailing(train, 60).select("uidx", "iidx").distinct().groupBy("iidx").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "iidx").limit(20)
    pop = pop.select("iidx", (F.row_number().over(Window.orderBy(F.desc("k"), "iidx")) - 1).alias("pos"))
    two = users.crossJoin(F.broadcast(pop)).select("uidx", "iidx", F.lit(2).alias("list_no"), "pos")
    return C.fuse(one.unionByName(two).withColumn("weight", F.lit(1.0)), k), rel


@query("rank_fusion", "tx", f"with {SPLIT} select uidx, iidx, round(score, 6) + 0.0 as score, rank from r5")
def rank_fusion(s, d):
    return fused(s, d)[0].select("uidx", "iidx", X.r6(F.col("score")).alias("score"), "rank")


METRIC = SPLIT + """, n as (select uidx, count(*) as n from rel group by 1), hit as (select r5.*, (rel.iidx is not null)::int as hit from r5 left join rel using (uidx, iidx)), hs as (select *, sum(hit) over (partition by uidx order by rank) as run from hit),
 mt as (select uidx, sum(hit) as hits, sum(hit * run / rank::double) as gain, sum(hit / log2(rank + 1)) as dcg from hs group by 1),
 al as (select uidx, coalesce(hits, 0) / n::double as recall, coalesce(hits, 0) / 5.0::double as precision, coalesce(gain, 0) / least(n, 5)::double as ap, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1.0::double / log2(i + 1))) as ndcg from n left join mt using (uidx))"""


def measured(s, d):
    ranked, rel = fused(s, d)
    r = ranked.select(F.col("uidx").alias("case"), F.col("rank").alias("pos"), F.col("iidx").alias("item"))
    return M.ranking_metrics(r, rel.select(F.col("uidx").alias("case"), F.col("iidx").alias("item")), 5)


def metric_query(name: str, column: str):
    @query(name, "tx", f"with {METRIC} select uidx, round({column}, 6) + 0.0 as {column} from al")
    def run(s, d):
        return measured(s, d).select(F.col("case").alias("uidx"), X.r6(F.col(column)).alias(column))


for _name, _column in (("metric_recall", "recall"), ("metric_precision", "precision"), ("metric_map", "ap"), ("metric_ndcg", "ndcg")):
    metric_query(_name, _column)


@query("metric_stock_diversity", "tx products inventory", f"with {SPLIT} select uidx, round(avg((coalesce(stock, 0) > 10)::int::double), 6) + 0.0 as in_stock_rate, count(distinct category) as category_diversity from r5 left join products p on p.product_id = iidx left join inventory i on i.product_id = iidx group by 1")
def shelf(s, d):
    ranked, _ = fused(s, d)
    r = ranked.select(F.col("uidx").alias("case"), F.col("iidx").alias("item"))
    inv = A.inventory(s, d).withColumn("stock", F.greatest(F.col("stock") - 10, F.lit(0)))
    m = M.shelf_metrics(r, A.products(s, d), inv)
    return m.select(F.col("case").alias("uidx"), X.r6(F.col("in_stock_rate")).alias("in_stock_rate"), "category_diversity")


EVALUATED = """ev2 as (select *, row_number() over (partition by uidx order by day desc, okey desc, line desc, iidx desc) as n from tx), tr as (select * from ev2 where n > 1), cs as (select uidx, iidx from ev2 where n = 1),
 pc as (select iidx, row_number() over (order by count(*) desc, iidx) as pos from tr group by 1), p5 as (select pc.*, category, stock from pc left join products p on p.product_id = iidx left join inventory i on i.product_id = iidx where pos <= 5),
 sh as (select avg((coalesce(stock, 0) > 0)::int::double) as s, count(distinct category)::double as c from p5), m as (select cs.uidx, p5.pos from cs left join p5 using (iidx))"""


@query("evaluation_loop", "tx products inventory", f"with {EVALUATED} select count(*) as cases, round(avg((pos is not null)::int::double), 6) + 0.0 as recall_at_k, round(avg((pos is not null)::int / 5.0::double), 6) + 0.0 as precision_at_k, round(avg(coalesce(1.0::double / pos, 0)), 6) + 0.0 as map_at_k, round(avg(coalesce(1.0::double / log2(pos + 1), 0)), 6) + 0.0 as ndcg_at_k, round(any_value(s), 6) + 0.0 as inventory_hit_rate, round(any_value(c), 6) + 0.0 as category_diversity from m cross join sh")
def evaluation_loop(s, d):
    """The most sold items as an assistant that answers all the same, over every user's last purchase."""
    t = M.last_purchase(A.tx(s, d), "uidx", "day", "okey", "line", "iidx")
    best = t.where("not holdout").groupBy("iidx").agg(F.count(F.lit(1)).alias("k"))
    cases = t.where("holdout").select(F.col("uidx").alias("user_id"), F.col("iidx").alias("product_id"))

    def answer(asked, k):
        top = best.orderBy(F.desc("k"), "iidx").limit(k)
        top = top.select(F.col("iidx").alias("item"), F.row_number().over(Window.orderBy(F.desc("k"), "iidx")).alias("pos"))
        return asked.select("case").crossJoin(F.broadcast(top)).select("case", "pos", "item")

    got = E.evaluate(answer, cases, A.products(s, d), A.inventory(s, d), 5, None)
    return got.select("cases", *(X.r6(F.col(c)).alias(c) for c in E.COLUMNS))


@query("flagship_recall_at_5", "tx", f"with {METRIC} select count(*) as cases, round(avg(recall), 6) + 0.0 as recall_at_5, round(avg(precision), 6) + 0.0 as precision_at_5, round(avg(ap), 6) + 0.0 as map_at_5, round(avg(ndcg), 6) + 0.0 as ndcg_at_5 from al")
def flagship(s, d):
    m = measured(s, d)
    return m.agg(F.count(F.lit(1)).alias("cases"), *(X.r6(F.avg(c)).alias(f"{n}_at_5") for c, n in (("recall", "recall"), ("precision", "precision"), ("ap", "map"), ("ndcg", "ndcg"))))
