"""Reading the retail tables and raw dumps. Ids are strings; schemas are explicit, never inferred for ids."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X

# Required columns of each table.
REQUIRED = {
    "products": ["product_id", "name", "category", "color", "style_tags", "occasion_tags", "season", "price", "description"],
    "interactions": ["user_id", "product_id", "event_type", "event_timestamp"],
    "reviews": ["review_id", "product_id", "rating", "fit_feedback", "review_text"],
    "inventory": ["product_id", "stock", "margin", "return_rate"],
    "users": ["user_id"],
    "outfits": ["outfit_id", "product_ids", "occasion_tags", "description", "compatibility_score"],
}


def check_columns(df: DataFrame, required: list[str], name: str = "table") -> DataFrame:
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{name} lacks the columns {', '.join(missing)}")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require_files(spark: SparkSession, folder: str, names: list[str]) -> None:
    if gone := [n for n in names if not exists(spark, f"{folder}/{n}")]:
        raise FileNotFoundError(f"{folder} lacks {', '.join(gone)}")


def read_csv(spark: SparkSession, path: str, required: list[str] = (), limit: int | None = None, drop_malformed: bool = False) -> DataFrame:
    """A CSV with a header, every column a string."""
    mode = "DROPMALFORMED" if drop_malformed else "PERMISSIVE"
    df = spark.read.csv(path, header=True, inferSchema=False, mode=mode, multiLine=True, escape='"')
    df = check_columns(df, list(required), path)
    return df.limit(limit) if limit else df


def read_optional_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in required]))
    return read_csv(spark, path, required)


def read_lookup(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A headerless CSV."""
    return spark.read.csv(path, header=False, schema=", ".join(f"{c} string" for c in columns))


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """One JSON object a line; blank lines count towards the limit and are skipped."""
    lines = spark.read.text(path)
    lines = (lines.limit(limit) if limit else lines).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or one object a line, by the first character that is no space."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    many = bool(head) and head[0][0].lstrip().startswith("[")
    return spark.read.json(path, schema=schema, multiLine=many)


def read_json_map(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """One JSON object whose members are the rows."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string, struct<{schema}>>")).alias(key, "x")).select(key, "x.*")


def load_catalog(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The six tables, typed: bad prices and stock figures 0, bad times null, weights from types if absent."""
    num = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    out = {t: read_csv(spark, f"{folder}/{t}.csv", REQUIRED[t]) for t in ("products", "interactions")}
    out |= {t: read_optional_csv(spark, f"{folder}/{t}.csv", REQUIRED[t]) for t in ("reviews", "inventory", "users", "outfits")}
    out["products"] = out["products"].withColumn("price", num("price"))
    ev = out["interactions"].withColumn("event_timestamp", F.try_to_timestamp("event_timestamp"))
    weight = F.col("event_weight").try_cast("double") if "event_weight" in ev.columns else X.event_weight(F.col("event_type"))
    out["interactions"] = ev.withColumn("event_weight", weight)
    out["inventory"] = out["inventory"].withColumns({c: num(c) for c in ("stock", "margin", "return_rate")})
    return out


@dataclass(frozen=True)
class Ranking:
    retrieval_weight: float = 0.45
    intent_match_weight: float = 0.15
    preference_weight: float = 0.15
    price_weight: float = 0.10
    inventory_weight: float = 0.08
    margin_weight: float = 0.04
    return_weight: float = 0.03
    out_of_stock_penalty: float = 0.35


@dataclass(frozen=True)
class Config:
    data_dir: str = "data"
    default_top_k: int = 5
    candidate_k: int = 30
    max_features: int = 5000
    sample_users: int | None = None
    sample_seed: int = 42
    ranking: Ranking = field(default_factory=Ranking)


def load_config(text: str) -> Config:
    """From JSON, or the two-level subset of YAML (key: value, one indent)."""
    try:
        raw = json.loads(text)
    except ValueError:
        raw, own = {}, None
        for line in text.splitlines():
            body = line.split("#")[0].rstrip()
            if not body:
                continue
            k, _, v = body.strip().partition(":")
            v = v.strip()
            if not v and body[0] != " ":
                own = raw.setdefault(k, {})
                continue
            value = {"null": None, "": None, "true": True, "false": False}.get(v, v)
            if isinstance(value, str):
                for cast in (int, float):
                    try:
                        value = cast(v)
                        break
                    except ValueError:
                        pass
            (own if body[0] == " " and own is not None else raw)[k] = value
    flat = {k: v for k, v in raw.items() if not isinstance(v, dict)}
    flat |= {k: v for part in ("retrieval", "evaluation") for k, v in raw.get(part, {}).items()}
    r = dict(raw.get("ranking", {}))
    if "return_risk_weight" in r:  # the older name
        r.setdefault("return_weight", r.pop("return_risk_weight"))
    known = lambda cls, d: {f.name: d[f.name] for f in fields(cls) if f.name in d and f.name != "ranking"}
    return replace(Config(**known(Config, flat)), ranking=Ranking(**known(Ranking, r)))


def load_factory(spec: str) -> Callable:
    """``module:factory``, a callable without arguments."""
    module, _, name = spec.partition(":")
    if not name:
        raise ValueError("a factory is named as module:factory")
    return getattr(importlib.import_module(module), name)


def point_lookup(spark: SparkSession, store: str, uidx: int, buckets: int = 64) -> DataFrame:
    """A user's candidates from a store written by ``sinks.write_store``: one partition, one row-group range."""
    return spark.read.parquet(store).where((F.col("bucket") == uidx % buckets) & (F.col("uidx") == uidx))


def with_fallback(found: DataFrame, candidates: DataFrame, uidx: int, n: int = 500) -> DataFrame:
    """For an unknown user the n items that are candidates most often."""
    pop = candidates.groupBy("iidx").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "iidx").limit(n)
    pop = pop.select(F.lit(uidx).cast("long").alias("uidx"), "iidx")
    none = found.limit(1).agg((F.count(F.lit(1)) == 0).alias("none"))
    return found.select("uidx", "iidx").unionByName(pop.crossJoin(F.broadcast(none)).where("none").drop("none"))
