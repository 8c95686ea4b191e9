"""What the corpus operators share: scratch tables, column hygiene, connected components.

Intermediate tables are written as Parquet under ``spark.checkpoint.dir`` (the folder that driver
and executors share), so that a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings while a table is written: shuffle files go as soon as the query has ended; batches for Python are small.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def scratch_root(spark: SparkSession) -> str:
    """The scratch folder that driver and executors share.

    A session that names none gets a folder of its own only in local mode, where one process is driver and
    executor; anywhere else that is an error, as executors could not read each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_shoalmark_scratch", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark._shoalmark_scratch = tempfile.mkdtemp(prefix="shoalmark-")
    return f"{root.rstrip('/')}/shoalmark"


def keep(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to scratch and read it back: cuts lineage, survives executor loss.

    Shuffle files of the plan behind it go with the write, so no later step may lean on them. The table
    itself stays until ``drop`` or, for the last ones that a result is read from, the end of the session.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    was = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._shoalmark_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that ``keep`` has written and nothing reads any more."""
    for df in tables:
        path = getattr(df, "_shoalmark_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column (in any case) has it."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) links as (node, root), root = smallest node of its component.

    Alternates the large-star and small-star steps of map-reduce union-find: each round is two
    aggregations with map-side combine and two equi-joins whose skew AQE can split, and the number of
    rounds grows with log^2 of the longest chain. Nodes without a link are not returned. Null ends and
    self links are ignored. Only the last round's table stays in scratch.
    """
    e = (
        edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        .where("a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))
        .distinct()
    )
    e = keep(e, "cc0")
    for i in range(rounds + 1):
        # done when every link leads to a root: no node has two links, and none that has one is led to
        ends = e.select("v", F.lit(1).alias("up"), F.lit(0).alias("root")).union(e.select("m", F.lit(0), F.lit(1)))
        ends = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        if ends.where("up > 1 or (up = 1 and root = 1)").isEmpty():
            break
        if i == rounds:
            raise RuntimeError("the components did not settle")
        both = e.union(e.select("m", "v"))  # (node, neighbour)
        low = both.groupBy("v").agg(F.min("m").alias("low")).select("v", F.least("v", "low").alias("low"))
        large = both.where("m > v").join(low, "v").select(F.col("m").alias("v"), F.col("low").alias("m"))
        large = large.where("v <> m")  # repeated links do no harm until the end of the round
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v").select(F.col("m").alias("v"), F.col("low").alias("m")).where("v <> m")
        was, e = e, keep(small.union(low.select("v", F.col("low").alias("m"))).distinct(), f"cc{i + 1}")
        drop(was)
    roots = e.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct()
    out = e.select(F.col("v").alias("node"), F.col("m").alias("root")).union(roots)
    out._shoalmark_path = e._shoalmark_path
    return out
