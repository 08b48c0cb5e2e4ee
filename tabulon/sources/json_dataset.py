"""JSON datasets: an object with a structure and data points, in either order; and JSON bindings."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import SparkSession

from ..errors import InvalidArgument
from ..model import ATTRIBUTE, DATE, IDENTIFIER, MEASURE, ROLES, VIRAL, Component, Dataset, Structure
from .files import schema_of

#: Type names in files.
TYPES = {"STRING": "string", "INTEGER": "integer", "NUMBER": "number", "BOOLEAN": "boolean", "DATE": "date", "FLOAT": "number"}
ROLE_NAMES = {"IDENTIFIER": IDENTIFIER, "MEASURE": MEASURE, "ATTRIBUTE": ATTRIBUTE, "VIRALATTRIBUTE": VIRAL}


def structure_from(items: list[dict]) -> Structure:
    out = []
    for c in items:
        kind = TYPES.get(str(c["type"]).upper())
        role = ROLE_NAMES.get(str(c.get("role", MEASURE)).upper())
        if kind is None or role not in ROLES:
            raise InvalidArgument(f"component {c.get('name')} has an unknown type or role")
        out.append(Component(c["name"], kind, role, c.get("nullable", True)))
    return Structure(out)


def value_from(value, kind: str):
    if value is None:
        return None
    if kind == DATE:
        at = dt.datetime.fromisoformat(str(value))
        return at.astimezone(dt.timezone.utc).replace(tzinfo=None) if at.tzinfo else at
    return {"integer": int, "number": float, "string": str, "boolean": bool}[kind](value)


def dataset_from(spark: SparkSession, content: dict) -> Dataset:
    structure = structure_from(content.get("structure") or content.get("dataStructure") or [])
    points = content.get("data", content.get("dataPoints")) or []
    names = [c.name for c in structure]
    rows = [[p.get(n) for n in names] if isinstance(p, dict) else list(p) for p in points]
    typed = [tuple(value_from(v, structure[n].type) for n, v in zip(names, r, strict=True)) for r in rows]
    return Dataset(spark.createDataFrame(typed, schema_of(structure)), structure)


def read_json(spark: SparkSession, text: str) -> Dataset:
    return dataset_from(spark, json.loads(text))


def read_bindings(spark: SparkSession, text: str) -> dict[str, object]:
    """Name to Dataset or plain value."""
    return {k: dataset_from(spark, v) if isinstance(v, dict) else v for k, v in json.loads(text).items()}


def write_json(ds: Dataset, most: int = 1_000_000) -> str:
    """The whole dataset as one JSON text. It passes through the driver, so more than ``most`` data points are an error."""
    plain = lambda v: v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v
    structure = [{"name": c.name, "type": c.type.upper(), "role": c.role} for c in ds.structure]
    names = [c.name for c in ds.structure]
    rows = ds.df.select(*[f"`{n}`" for n in names]).limit(most + 1).collect()
    if len(rows) > most:
        raise InvalidArgument(f"the dataset has more than {most} data points; write it as Parquet or CSV")
    return json.dumps({"structure": structure, "data": [[plain(r[n]) for n in names] for r in rows]})
