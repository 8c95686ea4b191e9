import json

import pytest
from pyspark.sql import functions as F

from shoalmark.operators import assistant as B
from shoalmark.operators import metrics as M
from shoalmark.sources import loaders as L
from shoalmark.sources import normalise as N
from shoalmark.sources import sinks as K


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_csv_checks(spark, tmp_path):
    p = write(tmp_path / "a.csv", "id,x\n001,2\n")
    assert L.read_csv(spark, p, ["id"]).first().id == "001"
    with pytest.raises(ValueError):
        L.read_csv(spark, p, ["y"])
    assert L.read_optional_csv(spark, str(tmp_path / "none.csv"), ["a", "b"]).columns == ["a", "b"]


def test_json_shapes(spark, tmp_path):
    lines = write(tmp_path / "l.json", '{"a": 1}\n\n{"a": 2}\n')
    array = write(tmp_path / "a.json", '[{"a": 1}, {"a": 2}]')
    for p in (lines, array):
        assert sorted(r.a for r in L.read_json(spark, p, "a int").collect()) == [1, 2]
    assert L.read_jsonl(spark, lines, "a int", 2).count() == 1
    m = write(tmp_path / "m.json", '{"k1": {"a": "x"}, "k2": {"a": "y"}}')
    assert {r.id: r.a for r in L.read_json_map(spark, m, "a:string").collect()} == {"k1": "x", "k2": "y"}


def test_config():
    c = L.load_config("default_top_k: 7\nranking:\n  margin_weight: 0.5\n  return_risk_weight: 0.2\nevaluation:\n  sample_users: null\n")
    assert (c.default_top_k, c.ranking.margin_weight, c.ranking.return_weight, c.sample_users) == (7, 0.5, 0.2, None)
    assert L.load_factory("json:dumps")([1]) == "[1]"


def test_catalog(spark, tmp_path):
    write(tmp_path / "products.csv", "product_id,name,category,color,style_tags,occasion_tags,season,price,description\np1,a,b,c,d,e,f,bad,g\n")
    write(tmp_path / "interactions.csv", "user_id,product_id,event_type,event_timestamp\nu1,p1,view,2024-01-01\nu1,p1,other,nonsense\n")
    t = L.load_catalog(spark, str(tmp_path))
    assert t["products"].first().price == 0.0 and t["outfits"].count() == 0
    assert sorted((r.event_weight, r.event_timestamp is None) for r in t["interactions"].collect()) == [(0.1, True), (0.2, False)]


def test_leaderboard(tmp_path):
    p = str(tmp_path / "board.json")
    K.append_entry(p, {"name": "a", "dataset": "d", "recall_at_k": 0.1})
    rows = K.append_entry(p, {"name": "<b>", "dataset": "d", "recall_at_k": 0.2})
    assert [r["name"] for r in K.ordered(rows)] == ["<b>", "a"] and "&lt;b&gt;" in K.leaderboard_html(rows)
    with pytest.raises(ValueError):
        K.append_entry(p, {"name": "c", "dataset": "other"})
    assert json.load(open(K.write_report(str(tmp_path), {"name": "My Run"})))["name"] == "My Run"


def test_intent_goldens(spark):
    q = [(1, 1, "I need a relaxed light outfit for a beach weekend under 90 dollars"), (2, 2, "面试穿的黑色正式外套，预算不超过 150"), (3, 3, None)]
    a, b, c = B.parse(spark.createDataFrame(q, "query_id int, user_id int, query string")).orderBy("query_id").collect()
    assert (a.occasion, a.style, a.color, a.category, a.budget, a.unclear) == (["beach", "weekend"], ["casual"], [], [], 90.0, False)
    assert a.retrieval_text == a.query + " beach weekend casual budget under 90"
    assert (b.occasion, b.color, b.style, b.category, b.budget) == (["interview"], ["black"], ["formal"], ["jacket"], 150.0)
    assert c.unclear and c.budget is None


def test_metric_goldens(spark):
    ranked = spark.createDataFrame([(1, k + 1, x) for k, x in enumerate("abcd")], "case int, pos int, item string")
    rel = spark.createDataFrame([(1, "b"), (1, "d")], "case int, item string")
    two, four = (M.ranking_metrics(ranked, rel, k).first() for k in (2, 4))
    assert two.recall == 0.5 and four.ap == 0.5 and abs(four.ndcg - 0.650921) < 1e-6


def test_web_shop(spark, tmp_path):
    write(tmp_path / "products.csv", "id,name,category,department,brand,retail_price,cost\n1,Tee,Tops,Men,Acme,10,4\n2,Hat,Caps,Women,Acme,0,1\n")
    write(tmp_path / "order_items.csv", "user_id,product_id,status,created_at\n7,1,Returned,2024-01-01\n7,1,Shipped,2024-01-02\n")
    write(tmp_path / "users.csv", "id,age,gender,city,state,country\n7,30,F,x,y,z\n8,40,M,x,y,z\n")
    write(tmp_path / "inventory_items.csv", "product_id,sold_at\n1,\n1,2024-01-01\n")
    t = N.web_shop(spark, str(tmp_path))
    inv = {r.product_id: r for r in t["inventory"].collect()}
    assert (inv["1"].stock, inv["1"].margin, inv["1"].return_rate) == (1, 0.6, 0.5) and inv["2"].margin == 0.0
    assert [r.age_band for r in t["users"].collect()] == ["25-34"]
    assert {r.event_type for r in t["interactions"].collect()} == {"return", "purchase"}


def test_retailer(spark, tmp_path):
    cols = "article_id,prod_name,product_type_name,perceived_colour_value_name,colour_group_name,index_group_name,garment_group_name,graphical_appearance_name,detail_desc"
    write(tmp_path / "articles.csv", f"{cols}\n001,Tee,Top,Dark,Blue,Menswear,Jersey,Solid,Nice.\n002,Tee,Top,Dark,Blue,Menswear,Jersey,Solid,Nice.\n")
    write(tmp_path / "customers.csv", "customer_id,age\nu1,20\n")
    write(tmp_path / "transactions_train.csv", "t_dat,customer_id,article_id,price,sales_channel_id\n2020-01-01,u1,002,0.05,1\n")
    t = N.fashion_retailer(spark, str(tmp_path))
    p = t["products"].collect()
    assert [(r.product_id, r.color, r.price, r.description) for r in p] == [("001", "Dark Blue", 50.0, "Nice. Pattern: Solid.")]
    assert t["interactions"].first().product_id == "001" and t["users"].first().budget_tier == "low"


def test_other_layouts(spark, tmp_path):
    meta = write(tmp_path / "meta.jsonl", '{"parent_asin": "A", "title": "T", "main_category": "M", "categories": [], "description": [" x ", ""], "price": "3.5", "images": [{"thumb": "t"}]}\n')
    rev = write(tmp_path / "rev.jsonl", '{"user_id": "u", "asin": "A", "rating": 4, "text": "good", "timestamp": 0}\n')
    t = N.review_dump(spark, rev, meta)
    p = t["products"].first()
    assert (p.category, p.description, p.image_url, p.price) == ("M", "x", "t", 3.5) and t["interactions"].first().event_weight == 0.8
    write(tmp_path / "img/styles.csv", "id,gender,masterCategory,articleType,baseColour,season,usage,productDisplayName\n1,Men,Apparel,Shirt,,Fall,Casual,Big Shirt\n")
    assert N.image_styles(spark, str(tmp_path / "img"))["products"].first().color == "unknown"
    write(tmp_path / "out/item_metadata.json", '{"9": {"title": "", "url_name": "hat", "category_id": "3"}}')
    write(tmp_path / "out/categories.csv", "3,fedora,hats\n")
    write(tmp_path / "out/outfits.json", '[{"set_id": "s", "items": [{"item_id": "9", "index": 1}, {"item_id": "8", "index": 2}]}]')
    o = N.outfit_sets(spark, str(tmp_path / "out"))
    assert o["products"].first().category == "fedora" and o["outfits"].first().product_ids == "9|8"
    fit = write(tmp_path / "fit.json", '{"item_id": "1", "rating": "5", "fit": "fit", "review_text": "ok"}\n')
    assert N.fit_reviews(spark, fit)["reviews"].first().rating == 5.0


def test_store_and_split(spark, tmp_path):
    c = spark.createDataFrame([(u, i) for u in range(20) for i in range(3)], "uidx long, iidx long")
    K.write_store(c, str(tmp_path / "store"), 4)
    assert L.point_lookup(spark, str(tmp_path / "store"), 7, 4).count() == 3
    none = L.point_lookup(spark, str(tmp_path / "store"), 99, 4)
    assert L.with_fallback(none, c, 99, 2).count() == 2
    counts = K.split_tables(c.withColumn("holdout", F.col("iidx") == 0), str(tmp_path / "split"))
    assert counts == {"train": 40, "test": 20}
