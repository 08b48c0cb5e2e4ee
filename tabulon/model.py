"""Datasets: a DataFrame with a structure of identifiers, measures and attributes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidArgument, UndefinedVariable

IDENTIFIER, MEASURE, ATTRIBUTE, VIRAL = "IDENTIFIER", "MEASURE", "ATTRIBUTE", "VIRALATTRIBUTE"
ROLES = (IDENTIFIER, MEASURE, ATTRIBUTE, VIRAL)

INTEGER, NUMBER, STRING, BOOLEAN, DATE, DURATION, PERIOD, NULL = "integer", "number", "string", "boolean", "date", "duration", "time_period", "null"
NUMERIC = (INTEGER, NUMBER)

DURATION_SPARK = "struct<months:int,days:int,micros:bigint>"
PERIOD_SPARK = "struct<start:timestamp_ntz,end:timestamp_ntz>"
SPARK_TYPES = {INTEGER: "bigint", NUMBER: "double", STRING: "string", BOOLEAN: "boolean", DATE: "timestamp_ntz", DURATION: DURATION_SPARK, PERIOD: PERIOD_SPARK, NULL: "string"}


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def vtl_type(kind: T.DataType) -> str | None:
    """The script type of a Spark type, None for nested types that no component may have."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return NUMBER
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return STRING
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    if isinstance(kind, T.StructType):
        return {("months", "days", "micros"): DURATION, ("start", "end"): PERIOD}.get(tuple(kind.names))
    if isinstance(kind, T.NullType):
        return STRING
    return None


@dataclass(frozen=True)
class Component:
    name: str
    type: str
    role: str = MEASURE
    nullable: bool = True
    domain: str | None = None


class Structure:
    """Ordered components; names are unique and case-sensitive."""

    def __init__(self, components):
        self.components: dict[str, Component] = {}
        for c in components:
            if c.name in self.components:
                raise InvalidArgument(f"duplicate component {c.name}")
            self.components[c.name] = replace(c, nullable=False) if c.role == IDENTIFIER else c

    def __iter__(self):
        return iter(self.components.values())

    def __contains__(self, name: str) -> bool:
        return name in self.components

    def __getitem__(self, name: str) -> Component:
        if name not in self.components:
            raise UndefinedVariable(name)
        return self.components[name]

    def __len__(self) -> int:
        return len(self.components)

    def names(self, *roles: str) -> list[str]:
        return [c.name for c in self if not roles or c.role in roles]

    @property
    def ids(self) -> list[str]:
        return self.names(IDENTIFIER)

    @property
    def measures(self) -> list[str]:
        return self.names(MEASURE)

    def same_as(self, other: Structure) -> bool:
        key = lambda s: {(c.name, c.type, c.role) for c in s}
        return key(self) == key(other)

    def __eq__(self, other):
        return isinstance(other, Structure) and self.same_as(other)

    def __repr__(self) -> str:
        return f"Structure({', '.join(f'{c.name}:{c.type}:{c.role}' for c in self)})"


@dataclass
class Dataset:
    """A lazy result: rows and what its columns mean."""

    df: DataFrame
    structure: Structure
    persistent: bool = False

    @property
    def ids(self) -> list[str]:
        return self.structure.ids

    @property
    def measures(self) -> list[str]:
        return self.structure.measures

    def select(self, names: list[str]) -> Dataset:
        return Dataset(self.df.select(*[col(n) for n in names]), Structure([self.structure[n] for n in names]))

    def stamped(self) -> DataFrame:
        """The rows with role, type and domain in the columns' metadata, as sources read them."""
        return self.df.select(
            *[col(c.name).alias(c.name, metadata={"vtlRole": c.role, "vtlType": c.type, **({"vtlValuedomain": c.domain} if c.domain else {})}) for c in self.structure]
        )

    def show(self, n: int = 20) -> None:
        self.df.show(n)


@dataclass
class Scalar:
    """A typed expression: a constant at script level, a column expression inside a dataset."""

    column: Column
    type: str
    literal: object = None

    def as_type(self, kind: str) -> Column:
        return self.column.cast(SPARK_TYPES[kind]) if self.type != kind else self.column


def wrap(df: DataFrame, ids=None, attributes=None, roles=None, domains=None) -> Dataset:
    """A DataFrame as a dataset. Roles: given, else from metadata, else measure; nested columns are dropped."""
    roles, domains = dict(roles or {}), dict(domains or {})
    for names, role in ((ids, IDENTIFIER), (attributes, ATTRIBUTE)):
        for n in names or []:
            if n not in df.columns:
                raise UndefinedVariable(n)
            roles[n] = role
    lowered: dict[str, str] = {}
    parts, components = [], []
    for f in df.schema.fields:
        kind = vtl_type(f.dataType)
        if kind is None:
            continue
        if lowered.setdefault(f.name.lower(), f.name) != f.name:
            raise InvalidArgument(f"columns {lowered[f.name.lower()]} and {f.name} differ by case only")
        role = roles.get(f.name) or f.metadata.get("vtlRole") or MEASURE
        domain = domains.get(f.name) or f.metadata.get("vtlValuedomain")
        components.append(Component(f.name, kind, role, domain=domain))
        wanted = SPARK_TYPES[kind]
        parts.append(col(f.name) if f.dataType.simpleString() == wanted else col(f.name).cast(wanted).alias(f.name))
    return Dataset(df.select(*parts), Structure(components))
