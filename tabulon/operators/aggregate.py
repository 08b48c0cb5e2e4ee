"""Aggregation, as a clause and on whole datasets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FunctionNotFound, InvalidArgument, UndefinedVariable
from ..functions.scalar import SHOWN
from ..functions.temporal import LENGTHS, floor_to, start_of
from ..model import DATE, IDENTIFIER, INTEGER, MEASURE, NULL, NUMBER, NUMERIC, PERIOD, Component, Dataset, Scalar, Structure, col

SPREAD = {"stddev_pop": F.stddev_pop, "stddev_samp": F.stddev_samp, "var_pop": F.var_pop, "var_samp": F.var_samp}
NAMES = {"sum", "avg", "count", "min", "max", "median", *SPREAD}


#: At this accuracy the sketch keeps every value of a group of up to two thousand million.
EXACT = (1 << 31) - 1


def median(x: Column, discrete: bool = False) -> Column:
    """Interpolated, or the lower of the two middle values."""
    return F.percentile_approx(x, 0.5, EXACT) if discrete else F.percentile(x.cast("double"), 0.5)


def aggregate(name: str, x: Scalar | None, pos=None, discrete: bool = False) -> Scalar:
    """One aggregate of a column; ``count`` counts rows whatever its operand. Nulls are skipped."""
    if name == "count":
        return Scalar(F.count(F.lit(1)), INTEGER)
    if x is None:
        raise InvalidArgument(f"{name} needs an operand", pos)
    if name in ("min", "max"):
        return Scalar((F.min if name == "min" else F.max)(x.column), x.type)
    if x.type not in (*NUMERIC, NULL):
        raise FunctionNotFound(f"{name}({SHOWN.get(x.type, x.type)})", pos)
    if name == "sum":
        return Scalar(F.sum(x.column), x.type)
    if name == "avg":
        return Scalar(F.avg(x.column), NUMBER)
    if name == "median":
        return Scalar(median(x.column, discrete).cast("double"), NUMBER)
    return Scalar(SPREAD[name](x.column.cast("double")), NUMBER)


def time_component(ds: Dataset, pos=None) -> str:
    found = [n for n in ds.ids if ds.structure[n].type in (DATE, PERIOD)]
    if len(found) != 1:
        raise InvalidArgument("the dataset needs exactly one identifier of a time type", pos)
    return found[0]


def grouped(ds: Dataset, grouping, key: Callable[[object], Scalar], pos=None) -> tuple[Dataset, list[str]]:
    """The dataset with computed keys added, and the names to group by."""
    if grouping is None:
        return ds, []
    if grouping.kind == "all":
        value = key(grouping.key)
        others = [c for c in ds.structure if c.name != "time"]
        df = ds.df.select(*[col(c.name) for c in others], value.column.alias("time"))
        return Dataset(df, Structure([*others, Component("time", value.type, IDENTIFIER)])), ["time"]
    for n in grouping.names:
        if n not in ds.structure:
            raise UndefinedVariable(n, pos)
    names = list(grouping.names) if grouping.kind == "by" else [n for n in ds.ids if n not in grouping.names]
    if grouping.period:
        if grouping.period not in LENGTHS:
            raise InvalidArgument(f"unknown period {grouping.period}", pos)
        time = time_component(ds, pos)
        x = Scalar(col(time), ds.structure[time].type)
        df = ds.df.withColumn(time, floor_to(start_of(x), grouping.period))
        ds = Dataset(df, Structure([Component(c.name, DATE, c.role) if c.name == time else c for c in ds.structure]))
        names = [*names, *([time] if time not in names else [])]
    return ds, names


def run(ds: Dataset, names: list[str], items: list[tuple[str | None, str, Scalar]], having: Scalar | None, pos=None) -> Dataset:
    """Group and aggregate; the condition is aggregated as well, filtered on and left out."""
    columns = [v.column.alias(n) for _, n, v in items]
    if having is not None:
        columns.append(having.column.alias("__having"))
    df = ds.df.groupBy(*[col(n) for n in names]).agg(*columns)
    if having is not None:
        df = df.filter("__having")
    keys = [Component(n, ds.structure[n].type, IDENTIFIER, domain=ds.structure[n].domain) for n in names]
    made = [Component(n, v.type, role or MEASURE) for role, n, v in items]
    return Dataset(df.select(*[col(c.name) for c in [*keys, *made]]), Structure([*keys, *made]))


def over_dataset(name: str, ds: Dataset, names: list[str], having: Scalar | None, pos=None, discrete: bool = False) -> Dataset:
    """The aggregate of every measure (numeric ones, unless min or max)."""
    if name == "count":
        return run(ds, names, [(None, "int_var", aggregate("count", None))], having, pos)
    fits = [m for m in ds.measures if name in ("min", "max") or ds.structure[m].type in NUMERIC]
    return run(ds, names, [(None, m, aggregate(name, Scalar(col(m), ds.structure[m].type), pos, discrete)) for m in fits], having, pos)
