"""The retail tables as views over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X


def raw(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tx(spark: SparkSession, d: str) -> DataFrame:
    """Purchase log: uidx, iidx, day, price, channel, and (okey, line) to break ties."""
    li = raw(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_linestatus")
    o = raw(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("uidx"),
        F.col("l_partkey").alias("iidx"),
        F.unix_date(F.to_date("o_orderdate")).alias("day"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("channel"),
        F.col("l_orderkey").alias("okey"),
        F.col("l_linenumber").alias("line"),
    )


def products(spark: SparkSession, d: str) -> DataFrame:
    p = raw(spark, d, "part")
    words = F.split("p_name", " ")
    size = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "medium").otherwise("large")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.get(words, F.lit(0)).alias("color"),
        F.concat(F.col("p_brand"), F.lit(","), F.coalesce(F.get(words, F.lit(1)), F.lit(""))).alias("style_tags"),
        size.alias("occasion_tags"),
        F.col("p_retailprice").alias("price"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("description"),
        F.col("p_brand").alias("brand"),
        F.col("p_size").alias("size"),
    )


def items(spark: SparkSession, d: str) -> DataFrame:
    """Dense codes of each product, in sorted order of the lower-cased value."""
    p = products(spark, d)
    out = p.select(F.col("product_id").alias("iidx"), F.expr("product_id div 10").alias("fidx"), "price", *(F.lower(c).alias(c) for c in ("category", "brand", "occasion_tags", "color")))
    for c, code in (("category", "cat_code"), ("brand", "style_code"), ("occasion_tags", "occ_code"), ("color", "color_code")):
        dim = out.select(c).distinct().withColumn(code, F.dense_rank().over(Window.orderBy(c)) - 1)
        out = out.join(F.broadcast(dim) if c != "brand" else dim, c)
    return out.select("iidx", "fidx", "cat_code", "style_code", "occ_code", "color_code", "price")


def users(spark: SparkSession, d: str) -> DataFrame:
    c = raw(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("uidx"), F.col("c_mktsegment").alias("age_band"), F.col("c_nationkey").alias("nation"))


def inventory(spark: SparkSession, d: str) -> DataFrame:
    li = raw(spark, d, "lineitem").select("l_partkey", "l_linestatus", "l_returnflag")
    agg = li.groupBy("l_partkey").agg(
        F.count(F.when(F.col("l_linestatus") == "O", 1)).alias("stock"),
        F.avg((F.col("l_returnflag") == "R").cast("double")).alias("return_rate"),
    )
    p = raw(spark, d, "part").select("p_partkey", "p_size").hint("merge")  # its file is small, its rows are many
    return p.join(agg, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("p_partkey").alias("product_id"), "stock", (F.lit(0.25) + F.lit(0.006) * F.col("p_size")).alias("margin"), "return_rate"
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    e = raw(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", "ts", F.get_json_object("props", "$.k").cast("long").alias("product_id"), X.event_weight(F.col("event_type")).alias("event_weight"))


def reviews(spark: SparkSession, d: str) -> DataFrame:
    lab, doc = raw(spark, d, "labels"), raw(spark, d, "documents").select("doc_id", "text")
    return lab.join(doc, "doc_id").select(
        F.col("doc_id").alias("review_id"),
        (F.col("doc_id") % 200).alias("product_id"),
        (1 + 4 * F.col("quality")).cast("double").alias("rating"),
        F.when(F.col("toxic") == 1, "small").otherwise("fit").alias("fit_feedback"),
        F.col("text").alias("review_text"),
    )


#: The same views for the SQL oracle.
SQL = {
    "tx": """tx as (select o_custkey as uidx, l_partkey as iidx, (o_orderdate::date - date '1970-01-01')::int as day, l_extendedprice / l_quantity as price,
      case when l_linestatus = 'O' then 1 else 2 end as channel, l_orderkey as okey, l_linenumber as line from lineitem join orders on l_orderkey = o_orderkey)""",
    "products": """products as (select p_partkey as product_id, p_name as name, p_type as category, split_part(p_name, ' ', 1) as color,
      p_brand || ',' || split_part(p_name, ' ', 2) as style_tags, case when p_size <= 10 then 'small' when p_size <= 30 then 'medium' else 'large' end as occasion_tags,
      p_retailprice as price, p_name || ' ' || p_type || ' ' || p_brand as description, p_brand as brand, p_size as size from part)""",
    "items": """items as (select product_id as iidx, product_id // 10 as fidx, (dense_rank() over (order by lower(category)) - 1)::int as cat_code,
      (dense_rank() over (order by lower(brand)) - 1)::int as style_code, (dense_rank() over (order by lower(occasion_tags)) - 1)::int as occ_code,
      (dense_rank() over (order by lower(color)) - 1)::int as color_code, price from products)""",
    "users": "users as (select c_custkey as uidx, c_mktsegment as age_band, c_nationkey as nation from customer)",
    "inventory": """inventory as (select p_partkey as product_id, count(*) filter (l_linestatus = 'O') as stock, 0.25::double + 0.006::double * p_size as margin,
      avg((l_returnflag = 'R')::int::double) as return_rate from part join lineitem on p_partkey = l_partkey group by p_partkey, p_size)""",
    "ev": """ev as (select event_id, user_id, event_type, ts, json_extract_string(props, '$.k')::bigint as product_id,
      case event_type when 'view' then 0.2 when 'cart' then 0.6 when 'favorite' then 0.8 when 'purchase' then 1.0 when 'return' then -1.0 else 0.1 end::double as event_weight from events)""",
    "reviews": """reviews as (select doc_id as review_id, doc_id % 200 as product_id, (1 + 4 * quality)::double as rating, case when toxic = 1 then 'small' else 'fit' end as fit_feedback,
      text as review_text from labels join documents using (doc_id))""",
    "lastday": "lastday as (select max(day) as last from tx)",
}
