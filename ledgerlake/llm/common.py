"""What the operators share: reading tables, and tables written in the folder that all executors see."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..sources.storage import shared_dir

#: White space as the operators understand it: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The pattern of one word, for Java's and RE2's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: What an application has written in the shared folder and not removed.
_made: dict[str, set[str]] = {}


def shared_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def written(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """df as a table in the shared folder, read back: its lineage is cut there, and a lost executor costs nothing."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, tag)
    out = df.write.option("compression", "zstd")
    out.partitionBy(*partition_by).parquet(path) if partition_by else out.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def _removed(spark: SparkSession, paths) -> None:
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for p in list(paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        _made.get(spark.sparkContext.applicationId, set()).discard(p)


def dropped(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for t in tables:
        _removed(t.sparkSession, [t._written_at])


def clear(spark: SparkSession) -> None:
    """Remove everything that the operators have written in this application. Their results are read from it, so they must have been read or written elsewhere."""
    _removed(spark, _made.get(spark.sparkContext.applicationId, ()))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished phases. What Python held is known to be free to the JVM only after a
    first collection there."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fresh(df: DataFrame, stem: str = "_") -> str:
    """A prefix that no column of df begins with."""
    while any(c.lower().startswith(stem) for c in df.columns):
        stem += "_"
    return stem


def input_bytes(df: DataFrame) -> int:
    """Size of df as Catalyst estimates it from the files, for choosing a number of partitions."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """df.mapInArrow, with this package sent to the executors' Python once in each application."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)
