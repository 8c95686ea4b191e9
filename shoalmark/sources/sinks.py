"""Writing tables, candidate stores, reports and the leaderboard."""

from __future__ import annotations

import html
import json
import os
import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "csv") -> None:
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        w.csv(f"{folder}/{name}", header=True) if kind == "csv" else w.parquet(f"{folder}/{name}.parquet")


def write_round(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").partitionBy("strategy", "day").parquet(folder)


def write_store(df: DataFrame, folder: str, buckets: int = 64) -> None:
    """Partitioned by user bucket and sorted by user, so a lookup prunes files and row groups."""
    b = df.withColumn("bucket", F.pmod("uidx", F.lit(buckets)))
    b.repartition(buckets, "bucket").sortWithinPartitions("bucket", "uidx").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def split_tables(events: DataFrame, folder: str) -> dict[str, int]:
    """Writes train and test of rows with ``holdout`` and checks the counts of what was written."""
    spark, want = events.sparkSession, {}
    for name, cond in (("train", ~F.col("holdout")), ("test", F.col("holdout"))):
        part = events.where(cond).drop("holdout")
        want[name] = part.count()
        part.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        if spark.read.parquet(f"{folder}/{name}.parquet").count() != want[name]:
            raise OSError(f"{name} was not written whole")
    return want


def write_atomic(path: str, text: str) -> None:
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w") as f:
        f.write(text)
    os.replace(tmp, path)


def append_entry(path: str, entry: dict) -> list[dict]:
    """Append a run to a leaderboard file; runs on another dataset are refused."""
    rows = json.load(open(path)) if os.path.exists(path) else []
    if rows and rows[0].get("dataset") != entry.get("dataset"):
        raise ValueError("the leaderboard holds runs on another dataset")
    rows.append({"id": max((r["id"] for r in rows), default=0) + 1} | entry)
    write_atomic(path, json.dumps(rows, indent=2))
    return rows


def ordered(rows: list[dict]) -> list[dict]:
    return sorted(rows, key=lambda r: (-r.get("recall_at_k", 0.0), r["id"]))


def leaderboard_text(rows: list[dict]) -> str:
    return "\n".join(f"{k}. {r.get('name', '')} {r.get('version', '')}  recall {r.get('recall_at_k', 0.0):.4f}" for k, r in enumerate(ordered(rows), 1))


def leaderboard_html(rows: list[dict]) -> str:
    cols = ["id", "name", "version", "recall_at_k", "precision_at_k", "map_at_k", "ndcg_at_k"]
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else html.escape(str(v))
    body = "".join(f"<tr>{''.join(f'<td>{show(r.get(c, ""))}</td>' for c in cols)}</tr>" for r in ordered(rows))
    return f"<table><tr>{''.join(f'<th>{c}</th>' for c in cols)}</tr>{body}</table>"


def write_report(folder: str, summary: dict) -> str:
    slug = re.sub(r"[^a-z0-9]+", "-", str(summary.get("name", "run")).lower()).strip("-") or "run"
    path = os.path.join(folder, f"{slug}.json")
    write_atomic(path, json.dumps(summary, indent=2))
    return path


def manifest(scan: DataFrame, counts: dict[str, int]) -> dict:
    r = scan.agg(F.count(F.lit(1)).alias("users"), F.min("n_dates").alias("min_dates"), F.median("n_dates").alias("median_dates"), F.max("n_dates").alias("max_dates")).first()
    return r.asDict() | counts


def markdown(rows: list[dict], query: str) -> str:
    """A response as text: heading, one section per recommendation with reasons and evidence."""
    out = [f"# {query}", ""]
    for r in rows:
        out += [f"## {r['rank']}. {r['product_id']} ({r['score']:.4f})", *(f"- {w}" for w in r["why"]), *(f"  - [{e['source']}:{e['source_id']}] {e['field']}: {e['value']}" for e in r["evidence"]), ""]
    return "\n".join(out)
