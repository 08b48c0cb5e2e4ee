"""Analytic (window) functions, as expressions and on whole datasets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from ..errors import FunctionNotFound, InvalidArgument, UndefinedVariable
from ..functions.scalar import SHOWN, quotient
from ..model import INTEGER, NULL, NUMBER, NUMERIC, Component, Dataset, Scalar, Structure, col
from .aggregate import SPREAD, median

NAMES = {"sum", "avg", "count", "min", "max", "median", *SPREAD, "first_value", "last_value", "lag", "lead", "ratio_to_report", "rank"}


def spec(window, structure: Structure, pos=None) -> WindowSpec:
    """Given parts only: no partition is one window, no frame with an order is RANGE up to the current row."""
    for n in [*window.partition, *(n for n, _ in window.order)]:
        if n not in structure:
            raise UndefinedVariable(n, pos)
    w = W.partitionBy(*[col(n) for n in window.partition])
    if window.order:
        w = w.orderBy(*[col(n).asc() if up else col(n).desc() for n, up in window.order])
    if window.frame:
        kind, low, high = window.frame
        if kind == "range" and (len(window.order) != 1 or structure[window.order[0][0]].type not in NUMERIC):
            raise InvalidArgument("a range frame needs one numeric order component", pos)
        edge = {"-": W.unboundedPreceding, "+": W.unboundedFollowing}
        low, high = edge.get(low, low), edge.get(high, high)
        if low > high:
            raise InvalidArgument("the frame ends before it begins", pos)
        w = w.rowsBetween(low, high) if kind == "rows" else w.rangeBetween(low, high)
    return w


def analytic(name: str, args: list[Scalar], window, structure: Structure, pos=None, discrete: bool = False) -> Scalar:
    w = spec(window, structure, pos)
    if name == "rank":
        if not window.order:
            raise InvalidArgument("rank needs an order", pos)
        return Scalar(F.rank().over(w).cast("bigint"), INTEGER)
    if not args:
        raise InvalidArgument(f"{name} needs an operand", pos)
    x = args[0]
    if name in ("first_value", "last_value"):
        return Scalar((F.first if name == "first_value" else F.last)(x.column).over(w), x.type)
    if name in ("lag", "lead"):
        offset = int(args[1].literal) if len(args) > 1 else 1
        default = args[2].literal if len(args) > 2 else None
        return Scalar((F.lag if name == "lag" else F.lead)(x.column, offset, default).over(w), x.type)
    if name == "count":
        return Scalar(F.count(x.column).over(w), INTEGER)
    if name in ("min", "max"):
        return Scalar((F.min if name == "min" else F.max)(x.column).over(w), x.type)
    if x.type not in (*NUMERIC, NULL):
        raise FunctionNotFound(f"{name}({SHOWN.get(x.type, x.type)})", pos)
    if name == "ratio_to_report":
        return Scalar(quotient(x.column.cast("double"), F.sum(x.column.cast("double")).over(w)), NUMBER)
    if name == "sum":
        return Scalar(F.sum(x.column).over(w), x.type)
    if name == "avg":
        return Scalar(F.avg(x.column).over(w), NUMBER)
    if name == "median":
        return Scalar(median(x.column, discrete).over(w).cast("double"), NUMBER)
    return Scalar(SPREAD[name](x.column.cast("double")).over(w), NUMBER)


def over_dataset(name: str, ds: Dataset, args: list[Scalar], window, pos=None, discrete: bool = False) -> Dataset:
    """Every measure in one projection over one window."""
    if name == "rank":
        value = analytic(name, [], window, ds.structure, pos)
        made = [("rank", value)]
    else:
        made = [(m, analytic(name, [Scalar(col(m), ds.structure[m].type), *args], window, ds.structure, pos, discrete)) for m in ds.measures]
    df = ds.df.select(*[col(n) for n in ds.ids], *[v.column.alias(m) for m, v in made])
    return Dataset(df, Structure([*(ds.structure[n] for n in ds.ids), *(Component(m, v.type) for m, v in made)]))


