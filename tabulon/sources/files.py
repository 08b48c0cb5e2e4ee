"""Parquet, CSV and JDBC. Parquet keeps roles in the columns' metadata."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..model import SPARK_TYPES, Dataset, Structure, wrap


def read_parquet(spark: SparkSession, path: str, ids=None, **roles) -> Dataset:
    return wrap(spark.read.parquet(path), ids, **roles)


def write_parquet(ds: Dataset, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    ds.stamped().write.mode(mode).partitionBy(*partition_by).parquet(path)


def schema_of(structure: Structure) -> T.StructType:
    """The Spark schema of a structure; readers can use it without inference."""
    return T.StructType([T.StructField(c.name, T._parse_datatype_string(SPARK_TYPES[c.type]), c.nullable) for c in structure])


def read_csv(spark: SparkSession, path: str, structure: Structure | None = None, sep: str = ";", **options) -> Dataset:
    """With a structure typed columns, matched by header name; without one all strings."""
    reader = spark.read.options(header=True, sep=sep, **options)
    if structure is None:
        return wrap(reader.csv(path))
    head = reader.csv(path).columns
    known = [n for n in head if n in structure]
    raw = spark.read.options(header=True, sep=sep, **options).schema(T.StructType([T.StructField(n, schema_of(structure)[n].dataType if n in structure else T.StringType()) for n in head])).csv(path)
    return Dataset(raw.select(*known), Structure([structure[n] for n in known]))


def write_csv(ds: Dataset, path: str, sep: str = ";", mode: str = "errorifexists") -> None:
    ds.df.write.mode(mode).options(header=True, sep=sep).csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, ids=None, **options) -> Dataset:
    """All components are measures unless told; pass partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    return wrap(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), ids)
