"""Raw dataset layouts to the six retail tables; one function per layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from .loaders import REQUIRED, read_csv, read_json, read_json_map, read_jsonl, read_lookup, require_files


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in REQUIRED[name]))


def fill(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {n: tables[n] if n in tables else empty(spark, n) for n in REQUIRED}


def plain_stock(products: DataFrame) -> DataFrame:
    return products.select("product_id", F.lit(1).alias("stock"), F.lit(0.35).alias("margin"), F.lit(0.10).alias("return_rate"))


def drawn_stock(products: DataFrame, seed: int = 42) -> DataFrame:
    """Stock figures drawn by a hash of the id, the same in every run."""
    u = lambda k: F.pmod(F.xxhash64("product_id", F.lit(seed + k)), F.lit(10_000)) / 10_000.0
    return products.select("product_id", F.floor(u(0) * 50).cast("int").alias("stock"), (0.2 + 0.4 * u(1)).alias("margin"), (0.02 + 0.2 * u(2)).alias("return_rate"))


def text(c: str):
    return F.coalesce(F.col(c), F.lit(""))


def fashion_retailer(spark: SparkSession, folder: str, sample_users: int | None = None) -> dict[str, DataFrame]:
    """articles, customers, transactions_train: canonical articles, relative prices times 1000, user tiers."""
    require_files(spark, folder, ["articles.csv", "customers.csv", "transactions_train.csv"])
    a = read_csv(spark, f"{folder}/articles.csv", ["article_id", "prod_name"])
    p = a.select(
        F.col("article_id").alias("product_id"), F.col("prod_name").alias("name"), F.col("product_type_name").alias("category"),
        F.coalesce(F.nullif(F.trim(F.concat_ws(" ", F.nullif(F.col("perceived_colour_value_name"), F.lit("")), F.nullif(F.col("colour_group_name"), F.lit("")))), F.lit("")), F.lit("unknown")).alias("color"),
        F.col("index_group_name").alias("style_tags"), F.col("garment_group_name").alias("occasion_tags"), F.lit("").alias("season"),
        F.when(F.lower(text("graphical_appearance_name")).isin("", "unknown"), text("detail_desc")).otherwise(F.concat(text("detail_desc"), F.lit(" Pattern: "), F.col("graphical_appearance_name"), F.lit("."))).alias("description"),
    )
    same = [F.coalesce(c, F.lit("")) for c in ("name", "category", "color", "style_tags", "occasion_tags", "description")]
    canon = p.select("product_id", F.min("product_id").over(Window.partitionBy(*same)).alias("canonical"))
    t = read_csv(spark, f"{folder}/transactions_train.csv", ["customer_id", "article_id", "t_dat"])
    t = t.select(F.col("customer_id").alias("user_id"), F.col("article_id").alias("product_id"), F.lit("purchase").alias("event_type"), F.try_to_timestamp("t_dat").alias("event_timestamp"), F.lit(1.0).alias("event_weight"), F.col("price").try_cast("double").alias("price"), F.col("sales_channel_id").try_cast("tinyint").alias("sales_channel_id"))
    if sample_users:
        active = t.groupBy("user_id").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "user_id").limit(sample_users)
        t = t.join(active, "user_id", "left_semi")
    t = t.join(canon, "product_id", "left").withColumn("product_id", F.coalesce("canonical", "product_id")).drop("canonical")
    p = p.join(canon.where("product_id = canonical").select("product_id"), "product_id", "left_semi")
    price = t.groupBy("product_id").agg(F.median("price").alias("m"))
    mid = price.agg(F.median("m").alias("mid"))
    p = p.join(price, "product_id", "left").crossJoin(F.broadcast(mid)).withColumn("price", F.round(F.coalesce("m", "mid", F.lit(0.0)) * 1000, 2)).drop("m", "mid")
    liked = t.join(p.select("product_id", "style_tags"), "product_id").where(F.trim(text("style_tags")) != "").groupBy("user_id", "style_tags").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("user_id").orderBy(F.desc("k"), "style_tags")
    liked = liked.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "style_tags"))), lambda x: x["style_tags"]), ", ").alias("preferred_style"))
    spend = t.groupBy("user_id").agg(F.median("price").alias("m"))
    n = spend.agg(F.count(F.lit(1)).alias("n"))
    tier = spend.withColumn("r", F.row_number().over(Window.orderBy("m", "user_id"))).crossJoin(F.broadcast(n))
    tier = tier.select("user_id", F.element_at(F.array(*map(F.lit, ("low", "mid", "high"))), X.quantile_bin(F.col("r"), F.col("n"), 3) + 1).alias("budget_tier"))
    c = read_csv(spark, f"{folder}/customers.csv", ["customer_id", "age"]).select(F.col("customer_id").alias("user_id"), X.age_band(F.col("age").try_cast("double")).alias("age_band"))
    u = c.join(t.select("user_id").distinct(), "user_id", "left_semi").join(liked, "user_id", "left").join(tier, "user_id", "left").withColumn("budget_tier", F.coalesce("budget_tier", F.lit("unknown")))
    return fill(spark, {"products": p, "interactions": t, "users": u, "inventory": drawn_stock(p)})


def web_shop(spark: SparkSession, folder: str, sample_users: int | None = None) -> dict[str, DataFrame]:
    """products, order_items, users, inventory_items: events by order status, margins and return rates by item."""
    require_files(spark, folder, ["products.csv", "order_items.csv", "users.csv", "inventory_items.csv"])
    r = read_csv(spark, f"{folder}/products.csv", ["id", "name"])
    retail, cost = F.col("retail_price").try_cast("double"), F.col("cost").try_cast("double")
    p = r.select(F.col("id").alias("product_id"), "name", "category", F.lit("unknown").alias("color"), X.distinct_join(F.col("department"), F.col("category"), F.col("brand")).alias("style_tags"), F.col("department").alias("occasion_tags"), F.lit("").alias("season"), F.coalesce(retail, F.lit(0.0)).alias("price"), F.concat_ws(" ", "brand", "name", "category", "department").alias("description"), "brand")
    o = read_csv(spark, f"{folder}/order_items.csv", ["user_id", "product_id", "status"])
    if sample_users:
        active = o.groupBy("user_id").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "user_id").limit(sample_users)
        o = o.join(active, "user_id", "left_semi")
    kind = X.status_event(F.col("status"))
    weight = F.when(kind == "cancel", X.STATUS_WEIGHTS["cancel"]).otherwise(X.event_weight(kind))
    t = o.select("user_id", "product_id", kind.alias("event_type"), F.try_to_timestamp("created_at").alias("event_timestamp"), weight.alias("event_weight"))
    u = read_csv(spark, f"{folder}/users.csv", ["id", "age"])
    u = u.select(F.col("id").alias("user_id"), X.age_band(F.col("age").try_cast("double")).alias("age_band"), "gender", "city", "state", "country").join(t.select("user_id").distinct(), "user_id", "left_semi")
    inv = read_csv(spark, f"{folder}/inventory_items.csv", ["product_id", "sold_at"]).where(F.col("sold_at").isNull()).groupBy("product_id").agg(F.count(F.lit(1)).cast("int").alias("stock"))
    back = t.groupBy("product_id").agg(F.avg((F.col("event_type") == "return").cast("double")).alias("return_rate"))
    margin = F.least(F.greatest((retail - cost) / F.when(retail > 0, retail).otherwise(1.0), F.lit(0.0)), F.lit(1.0))
    s = r.select(F.col("id").alias("product_id"), F.coalesce(margin, F.lit(0.0)).alias("margin")).join(inv, "product_id", "left").join(back, "product_id", "left")
    s = s.select("product_id", F.coalesce("stock", F.lit(0)).alias("stock"), "margin", F.coalesce("return_rate", F.lit(0.0)).alias("return_rate"))
    return fill(spark, {"products": p, "interactions": t, "users": u, "inventory": s})


def review_dump(spark: SparkSession, reviews: str, meta: str, limit: int | None = None) -> dict[str, DataFrame]:
    """Two JSON-lines files, items and reviews: the review is also an event of weight rating / 5."""
    m = read_jsonl(spark, meta, "parent_asin string, asin string, title string, main_category string, categories array<string>, description array<string>, price string, store string, images array<struct<large string, thumb string>>", limit)
    pid = F.coalesce(F.nullif(F.col("parent_asin"), F.lit("")), F.col("asin"))
    first = F.get("images", F.lit(0))
    p = m.select(
        pid.alias("product_id"), F.col("title").alias("name"), F.coalesce(F.try_element_at("categories", F.lit(-1)), F.nullif(F.col("main_category"), F.lit("")), F.lit("unknown")).alias("category"), F.lit("unknown").alias("color"),
        F.coalesce(F.array_join("categories", ","), F.lit("")).alias("style_tags"), F.lit("").alias("occasion_tags"), F.lit("").alias("season"), F.coalesce(F.col("price").try_cast("double"), F.lit(0.0)).alias("price"),
        F.coalesce(F.array_join(F.filter(F.transform("description", lambda x: F.trim(x)), lambda x: x != ""), " "), F.lit("")).alias("description"), F.col("store").alias("brand"), F.coalesce(F.nullif(first["large"], F.lit("")), first["thumb"], F.lit("")).alias("image_url"),
    ).dropDuplicates(["product_id"])
    r = read_jsonl(spark, reviews, "user_id string, parent_asin string, asin string, rating double, title string, text string, timestamp long", limit)
    r = r.withColumn("product_id", F.coalesce(F.nullif(F.col("parent_asin"), F.lit("")), F.col("asin")))
    t = r.select("user_id", "product_id", F.lit("review").alias("event_type"), F.timestamp_millis("timestamp").alias("event_timestamp"), (F.coalesce("rating", F.lit(0.0)) / 5).alias("event_weight"))
    w = Window.orderBy("user_id", "product_id", "timestamp", "text")
    v = r.select((F.row_number().over(w) - 1).cast("string").alias("review_id"), "product_id", "rating", F.lit("").alias("fit_feedback"), F.col("text").alias("review_text"))
    u = r.select("user_id").distinct()
    return fill(spark, {"products": p, "interactions": t, "reviews": v, "users": u, "inventory": plain_stock(p)})


def image_styles(spark: SparkSession, folder: str, limit: int | None = None) -> dict[str, DataFrame]:
    """styles.csv with malformed rows skipped; an image is named where its file lies in images/."""
    r = read_csv(spark, f"{folder}/styles.csv", ["id"], limit, drop_malformed=True)
    c = lambda n: F.col(n) if n in r.columns else F.lit(None).cast("string")
    p = r.select(
        F.col("id").alias("product_id"), X.first_present(c("productDisplayName"), c("articleType"), default="unknown").alias("name"), X.first_present(c("articleType"), c("subCategory"), c("masterCategory"), default="unknown").alias("category"),
        X.first_present(c("baseColour"), default="unknown").alias("color"), X.distinct_join(c("usage"), c("gender"), c("masterCategory")).alias("style_tags"), X.distinct_join(c("usage")).alias("occasion_tags"), F.coalesce(c("season"), F.lit("")).alias("season"), F.lit(0.0).alias("price"),
        F.concat_ws(" ", c("productDisplayName"), c("gender"), c("baseColour"), c("articleType"), c("usage")).alias("description"),
    )
    from .loaders import exists

    if exists(spark, f"{folder}/images"):
        files = spark.read.format("binaryFile").load(f"{folder}/images").select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("product_id"), F.col("path").alias("image_url"))
        p = p.join(files, "product_id", "left").withColumn("image_url", F.coalesce("image_url", F.lit("")))
    return fill(spark, {"products": p, "inventory": plain_stock(p)})


def outfit_sets(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """item_metadata.json (an object by id), categories.csv, and outfits as JSON."""
    m = read_json_map(spark, f"{folder}/item_metadata.json", "title:string, url_name:string, category_id:string, semantic_category:string, description:string", "product_id")
    cats = read_lookup(spark, f"{folder}/categories.csv", ["category_id", "fine", "coarse"])
    m = m.join(F.broadcast(cats), "category_id", "left")
    p = m.select("product_id", X.first_present(F.col("title"), F.col("url_name"), default="unknown").alias("name"), X.first_present(F.col("semantic_category"), F.col("fine"), F.col("coarse"), default="unknown").alias("category"), F.lit("unknown").alias("color"), text("fine").alias("style_tags"), F.lit("").alias("occasion_tags"), F.lit("").alias("season"), F.lit(0.0).alias("price"), text("description").alias("description"))
    o = read_json(spark, f"{folder}/outfits.json", "set_id string, items array<struct<item_id string, index int>>")
    o = o.select(F.col("set_id").alias("outfit_id"), F.array_join("items.item_id", "|").alias("product_ids"), F.lit("").alias("occasion_tags"), F.lit("").alias("description"), F.lit(1.0).alias("compatibility_score"))
    return fill(spark, {"products": p, "outfits": o, "inventory": plain_stock(p)})


def fit_reviews(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A JSON array or lines of fit feedback."""
    r = read_json(spark, path, "item_id string, product_id string, user_id string, rating string, fit string, review_text string")
    w = Window.orderBy("user_id", "item_id", "product_id", "review_text")
    v = r.select((F.row_number().over(w) - 1).cast("string").alias("review_id"), F.coalesce("item_id", "product_id").alias("product_id"), F.col("rating").try_cast("double").alias("rating"), text("fit").alias("fit_feedback"), text("review_text").alias("review_text"))
    return fill(spark, {"reviews": v})
