"""Shared working folder: materialised intermediates that survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Where each stored result lies, and its table name if it is bucketed.
STORED: WeakKeyDictionary[DataFrame, tuple[str, str | None]] = WeakKeyDictionary()
#: All of these that are not deleted yet.
LIVE: dict[str, str | None] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only where driver and executors are one process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tabulon-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write a result to the shared folder and read it back: cuts lineage, recoverable from any executor."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tabulon/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    STORED[out], LIVE[path] = (path, None), None
    return out


def discard(*stored: DataFrame) -> None:
    """Delete stored results that no later plan reads: whatever was made from them must itself be stored.

    The shuffle files of finished plans go as well, as soon as the driver has
    collected its garbage.
    """
    if stored:
        delete(stored[0].sparkSession, [STORED.pop(df)[0] for df in stored])


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        if ident := LIVE.pop(path):
            spark.sql(f"DROP TABLE IF EXISTS {ident}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    collect_garbage(spark)


def settled(df: DataFrame, earlier: set[str], name: str) -> DataFrame:
    """Store a result and delete whatever was stored since ``earlier`` (the keys of ``LIVE`` then) to make it."""
    out = materialise(df, name)
    delete(df.sparkSession, [p for p in LIVE if p not in earlier and p != STORED[out][0]])
    return out


def collect_garbage(spark: SparkSession) -> None:
    """Free what finished plans hold: plans and broadcasts in the driver, shuffle files on executors."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucketed(df: DataFrame, key: str, name: str = "store") -> DataFrame:
    """Like materialise, but hash-bucketed by ``key``: later joins on it move only the other side."""
    spark = df.sparkSession
    ident = f"tabulon_{name}_{uuid.uuid4().hex}"
    path = f"{work_dir(spark)}/tabulon/{ident}"
    n = n_parts(spark)
    (
        df.write.format("parquet")
        .option("path", path)
        .option("compression", "zstd")
        .bucketBy(n, key)
        .saveAsTable(ident)
    )
    out = spark.table(ident)
    STORED[out], LIVE[path] = (path, ident), ident
    return out
