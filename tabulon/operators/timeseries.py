"""Time operators on datasets with one identifier of a time type."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import InvalidArgument
from ..functions.temporal import LENGTHS, add_duration, duration, indicator, shift_column, start_of
from ..functions.scalar import apply, constant
from ..model import NUMERIC, PERIOD, STRING, Component, Dataset, Scalar, Structure, col
from .aggregate import time_component


def running(ds: Dataset, pos=None):
    time = time_component(ds, pos)
    others = [n for n in ds.ids if n != time]
    return W.partitionBy(*[col(n) for n in others]).orderBy(col(time))


def measures_by(ds: Dataset, make) -> Dataset:
    columns = [make(col(c.name)).alias(c.name) if c.name in ds.measures and c.type in NUMERIC else col(c.name) for c in ds.structure]
    return Dataset(ds.df.select(*columns), ds.structure)


def flow_to_stock(ds: Dataset, pos=None) -> Dataset:
    w = running(ds, pos).rowsBetween(W.unboundedPreceding, W.currentRow)
    return measures_by(ds, lambda x: F.sum(x).over(w))


def stock_to_flow(ds: Dataset, pos=None) -> Dataset:
    w = running(ds, pos)
    return measures_by(ds, lambda x: x - F.coalesce(F.lag(x).over(w), F.lit(0)))


def frequency(ds: Dataset, time: str):
    """The letter of each row's spacing: of a period its length, of a date one day."""
    return indicator(col(time)) if ds.structure[time].type == PERIOD else F.lit("D")


def timeshift(ds: Dataset, n: int, pos=None) -> Dataset:
    """Periods move by n of their lengths; dates by n times the usual step of the series."""
    time = time_component(ds, pos)
    kind = ds.structure[time].type
    if kind == PERIOD:
        moved = shift_column(Scalar(col(time), kind), F.lit(n))
        df = ds.df
    else:
        others = [x for x in ds.ids if x != time]
        whole = W.partitionBy(*[col(x) for x in others])
        w = whole.orderBy(col(time))
        step = F.datediff(F.lead(col(time)).over(w), col(time))
        df = ds.df.withColumn("__step", step).withColumn("__least", F.min("__step").over(whole))
        least = F.col("__least")
        months = F.when(least >= 365, 12).when(least >= 181, 6).when(least >= 90, 3).when(least >= 28, 1).otherwise(0)
        days = F.when(least >= 28, 0).when(least == 7, 7).otherwise(1)
        moved = add_duration(col(time), duration(months * n, days * n))
    return Dataset(df.select(*[moved.alias(time) if c.name == time else col(c.name) for c in ds.structure]), ds.structure)


def fill_time_series(ds: Dataset, mode: str | None = None, pos=None) -> Dataset:
    """Missing days or periods get rows with null measures, between the first and last of the group (``single``) or of all data."""
    time = time_component(ds, pos)
    kind = ds.structure[time].type
    others = [x for x in ds.ids if x != time]
    x = start_of(Scalar(col(time), kind))
    letter = frequency(ds, time)
    rows = ds.df.withColumns({"__at": x, "__f": F.coalesce(letter, F.lit("D"))})
    keys = [*[col(n) for n in others], F.col("__f")]
    bounds = rows.groupBy(*keys).agg(F.min("__at").alias("__a"), F.max("__at").alias("__b"))
    if mode != "single":
        whole = rows.groupBy("__f").agg(F.min("__at").alias("__a"), F.max("__at").alias("__b"))
        bounds = bounds.drop("__a", "__b").join(whole, "__f")
    grid = None
    for f, (months, days) in LENGTHS.items():
        step = F.make_interval(months=F.lit(months), days=F.lit(days))
        part = bounds.filter(F.col("__f") == f).select(*[col(n) for n in others], "__f", F.explode(F.sequence("__a", "__b", step)).alias("__at"))
        grid = part if grid is None else grid.unionByName(part)
    full = grid.join(rows, [*others, "__f", "__at"], "left")
    if kind == PERIOD:
        months = F.when(F.col("__f") == "A", 12).when(F.col("__f") == "S", 6).when(F.col("__f") == "Q", 3).when(F.col("__f") == "M", 1).otherwise(0)
        days = F.when(F.col("__f") == "W", 7).when(F.col("__f") == "D", 1).otherwise(0)
        at = F.struct(F.col("__at").alias("start"), add_duration(F.col("__at"), duration(months, days)).alias("end"))
    else:
        at = F.col("__at")
    return Dataset(full.select(*[at.alias(time) if c.name == time else col(c.name) for c in ds.structure]), ds.structure)


def time_agg(ds: Dataset, letter: str, pos=None) -> Dataset:
    """The time identifier widened to periods of the given length."""
    if letter not in LENGTHS:
        raise InvalidArgument(f"unknown period {letter}", pos)
    time = time_component(ds, pos)
    value = apply("time_agg scalar", [constant(letter), Scalar(col(time), ds.structure[time].type)], pos)
    df = ds.df.select(*[value.column.alias(time) if c.name == time else col(c.name) for c in ds.structure])
    return Dataset(df, Structure([Component(c.name, value.type, c.role) if c.name == time else c for c in ds.structure]))


def period_indicator(ds: Dataset, pos=None) -> Dataset:
    time = time_component(ds, pos)
    if ds.structure[time].type != PERIOD:
        raise InvalidArgument("period_indicator needs a time period", pos)
    df = ds.df.select(*[col(n) for n in ds.ids], indicator(col(time)).alias("duration_var"))
    return Dataset(df, Structure([*(ds.structure[n] for n in ds.ids), Component("duration_var", STRING)]))


