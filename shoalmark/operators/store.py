"""Tables of a round that several steps read: written once, so that their plans are not repeated."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def hold(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the session's shared folder (else its warehouse) and read it back; a lost executor costs a re-read."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/rounds/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes what ``hold`` wrote, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(d)
        path.getFileSystem(conf).delete(path, True)
