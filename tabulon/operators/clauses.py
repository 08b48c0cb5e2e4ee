"""Clauses on one dataset: filter, calc, keep, drop, rename, sub, pivot, unpivot."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import AlreadyDefined, InvalidArgument, InvalidType, UndefinedVariable
from ..functions.scalar import SHOWN
from ..model import BOOLEAN, IDENTIFIER, MEASURE, NULL, SPARK_TYPES, STRING, Component, Dataset, Scalar, Structure, col


def filter_rows(ds: Dataset, condition: Scalar, pos=None) -> Dataset:
    """Rows where the condition is true; null drops them."""
    if condition.type not in (BOOLEAN, NULL):
        raise InvalidType(SHOWN[condition.type], "Boolean", pos)
    return Dataset(ds.df.filter(condition.as_type(BOOLEAN)), ds.structure)


def calc(ds: Dataset, items: list[tuple[str | None, str, Scalar]], pos=None) -> Dataset:
    """New or replaced components, all computed from the input."""
    made: dict[str, tuple[Component, Scalar]] = {}
    for role, name, value in items:
        if name in ds.structure and ds.structure[name].role == IDENTIFIER:
            raise InvalidArgument(f"identifier {name} cannot be overwritten", pos)
        if name in made:
            raise InvalidArgument(f"{name} is computed twice", pos)
        old = ds.structure[name].role if name in ds.structure else MEASURE
        kind = STRING if value.type == NULL else value.type
        made[name] = Component(name, kind, role or old), Scalar(value.as_type(kind), kind)
    components = [made[c.name][0] if c.name in made else c for c in ds.structure] + [c for n, (c, _) in made.items() if n not in ds.structure]
    columns = [made[c.name][1].column.alias(c.name) if c.name in made else col(c.name) for c in components]
    return Dataset(ds.df.select(*columns), Structure(components))


def listed(ds: Dataset, names: tuple[str, ...], pos) -> list[str]:
    for n in names:
        if n not in ds.structure:
            raise UndefinedVariable(n, pos)
        if ds.structure[n].role == IDENTIFIER:
            raise InvalidArgument("identifiers cannot be kept or dropped explicitly", pos)
    return list(names)


def keep(ds: Dataset, names: tuple[str, ...], pos=None) -> Dataset:
    wanted = set(listed(ds, names, pos))
    return ds.select([c.name for c in ds.structure if c.role == IDENTIFIER or c.name in wanted])


def drop(ds: Dataset, names: tuple[str, ...], pos=None) -> Dataset:
    gone = set(listed(ds, names, pos))
    return ds.select([c.name for c in ds.structure if c.name not in gone])


def rename(ds: Dataset, pairs: tuple[tuple[str, str], ...], pos=None) -> Dataset:
    """All at once, so names may be swapped."""
    old, new = [a for a, _ in pairs], [b for _, b in pairs]
    for names in (old, new):
        if len(set(names)) < len(names):
            raise InvalidArgument("duplicate column in rename clause", pos)
    for a in old:
        if a not in ds.structure:
            raise UndefinedVariable(a, pos)
    rest = {c.name for c in ds.structure} - set(old)
    for b in new:
        if b in rest:
            raise AlreadyDefined(f"'{b}', is already defined in '{', '.join(ds.structure.components)}'", pos)
    to = dict(pairs)
    components = [Component(to.get(c.name, c.name), c.type, c.role, c.nullable, c.domain) for c in ds.structure]
    return Dataset(ds.df.select(*[col(c.name).alias(to.get(c.name, c.name)) for c in ds.structure]), Structure(components))


def subspace(ds: Dataset, pairs: list[tuple[str, Scalar]], pos=None) -> Dataset:
    """Rows with the given identifier values, without those identifiers."""
    condition = F.lit(True)
    for name, value in pairs:
        if name not in ds.structure:
            raise UndefinedVariable(name, pos)
        if ds.structure[name].role != IDENTIFIER:
            raise InvalidArgument(f"{name} is not an identifier", pos)
        condition = condition & (col(name) == value.column)
    gone = {n for n, _ in pairs}
    return Dataset(ds.df.filter(condition), ds.structure).select([c.name for c in ds.structure if c.name not in gone])


def pivot(ds: Dataset, identifier: str, measure: str, values: tuple = (), pos=None) -> Dataset:
    """A column for each value of an identifier; other measures and attributes go.

    Without ``values`` Spark looks them up first, which costs a job.
    """
    for n, role in ((identifier, IDENTIFIER), (measure, MEASURE)):
        if n not in ds.structure:
            raise UndefinedVariable(n, pos)
        if ds.structure[n].role != role:
            raise InvalidArgument(f"{n} is not of role {role.lower()}", pos)
    others = [n for n in ds.ids if n != identifier]
    kind = ds.structure[measure].type
    twice = F.raise_error(F.concat(F.lit(f"pivot: more than one data point for a value of {identifier}: "), col(identifier).cast("string")))
    cell = F.when(F.count(F.lit(1)) > 1, twice.cast(SPARK_TYPES[kind])).otherwise(F.first(col(measure))).alias(measure)
    cells = ds.df.groupBy(*[col(n) for n in others], col(identifier)).agg(cell)
    spread = cells.groupBy(*[col(n) for n in others]).pivot(identifier, list(values) or None).agg(F.first(col(measure)))
    fresh = [n for n in spread.columns if n not in others]
    df = spread.select(*[col(n) for n in others], *[col(n).cast(SPARK_TYPES[kind]).alias(n) for n in fresh])
    return Dataset(df, Structure([ds.structure[n] for n in others] + [Component(n, kind) for n in fresh]))


def unpivot(ds: Dataset, identifier: str, measure: str, pos=None) -> Dataset:
    """A row for each non-null measure, its name in a new identifier."""
    kinds = {ds.structure[m].type for m in ds.measures}
    if len(kinds) != 1:
        raise InvalidArgument("unpivot needs measures of one type", pos)
    if identifier in ds.ids:
        raise AlreadyDefined(f"'{identifier}', is already defined", pos)
    pairs = F.array(*[F.struct(F.lit(m).alias("k"), col(m).alias("v")) for m in ds.measures])
    long = ds.df.select(*[col(n) for n in ds.ids], F.explode(pairs).alias("kv")).filter("kv.v is not null")
    df = long.select(*[col(n) for n in ds.ids], F.col("kv.k").alias(identifier), F.col("kv.v").alias(measure))
    return Dataset(df, Structure([*(ds.structure[n] for n in ds.ids), Component(identifier, STRING, IDENTIFIER), Component(measure, kinds.pop())]))


def membership(ds: Dataset, name: str, pos=None) -> Dataset:
    """Identifiers and one component; an identifier or attribute becomes a measure of its own."""
    if name not in ds.structure:
        raise UndefinedVariable(name, pos)
    c = ds.structure[name]
    if c.role == IDENTIFIER:
        shown = {"string": "string_var", "integer": "int_var", "number": "num_var", "boolean": "bool_var", "date": "date_var"}.get(c.type, f"{c.type}_var")
        df = ds.df.select(*[col(n) for n in ds.ids], col(name).alias(shown))
        return Dataset(df, Structure([*(ds.structure[n] for n in ds.ids), Component(shown, c.type)]))
    out = ds.select([*ds.ids, name])
    return Dataset(out.df, Structure([*(ds.structure[n] for n in ds.ids), Component(name, c.type, MEASURE, domain=c.domain)]))
