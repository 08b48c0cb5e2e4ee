"""Set operators, by identifiers, and exists_in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..model import BOOLEAN, Component, Dataset, Structure, col


def check(datasets: list[Dataset], pos) -> None:
    if any(not d.structure.same_as(datasets[0].structure) for d in datasets[1:]):
        raise InvalidArgument("datasets must have the same structure", pos)


def union(datasets: list[Dataset], pos=None) -> Dataset:
    """All rows; of those with equal identifiers the leftmost dataset's stays. One aggregation, combined map-side."""
    check(datasets, pos)
    first = datasets[0]
    names = [c.name for c in first.structure]
    if not first.ids:
        out = first.df
        for d in datasets[1:]:
            out = out.unionByName(d.df)
        return Dataset(out.distinct(), first.structure)
    rest = [n for n in names if n not in first.ids]
    out = None
    for i, d in enumerate(datasets):
        part = d.df.select(*[col(n) for n in first.ids], F.lit(i).alias("__nth"), F.struct(*[col(n) for n in rest]).alias("__rest") if rest else F.lit(0).alias("__rest"))
        out = part if out is None else out.union(part)
    best = out.groupBy(*[col(n) for n in first.ids]).agg(F.min_by("__rest", "__nth").alias("__rest"))
    df = best.select(*[col(n) if n in first.ids else F.col("__rest")[n].alias(n) for n in names])
    return Dataset(df, first.structure)


def pick(a: Dataset, b: Dataset, how: str):
    return a.df.join(b.df.select(*[col(n) for n in a.ids]), a.ids, how).select(*[col(c.name) for c in a.structure])


def intersect(datasets: list[Dataset], pos=None) -> Dataset:
    check(datasets, pos)
    out = datasets[0]
    for d in datasets[1:]:
        out = Dataset(pick(out, d, "left_semi"), out.structure)
    return out


def setdiff(a: Dataset, b: Dataset, pos=None) -> Dataset:
    check([a, b], pos)
    return Dataset(pick(a, b, "left_anti"), a.structure)


def symdiff(a: Dataset, b: Dataset, pos=None) -> Dataset:
    check([a, b], pos)
    return Dataset(pick(a, b, "left_anti").unionByName(pick(b, a, "left_anti")), a.structure)


def exists_in(a: Dataset, b: Dataset, retain: str = "all", pos=None) -> Dataset:
    """Whether the identifiers of a row occur in another dataset."""
    keys = [n for n in a.ids if n in b.ids]
    if not keys:
        raise InvalidArgument("exists_in needs common identifiers", pos)
    structure = Structure([*(a.structure[n] for n in a.ids), Component("bool_var", BOOLEAN)])
    ids = a.df.select(*[col(n) for n in a.ids])
    if retain in ("true", "false"):
        found = ids.join(b.df.select(*[col(n) for n in keys]), keys, "left_semi" if retain == "true" else "left_anti")
        return Dataset(found.select(*[col(n) for n in a.ids], F.lit(retain == "true").alias("bool_var")), structure)
    marks = b.df.select(*[col(n) for n in keys]).distinct().withColumn("__in", F.lit(True))
    return Dataset(ids.join(marks, keys, "left").select(*[col(n) for n in a.ids], F.coalesce("__in", F.lit(False)).alias("bool_var")), structure)
