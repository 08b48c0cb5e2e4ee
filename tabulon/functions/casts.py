"""cast(x, type, mask): conversions that fail loudly on data that does not fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..model import BOOLEAN, DATE, DURATION, INTEGER, NULL, NUMBER, PERIOD, SPARK_TYPES, STRING, Scalar
from .temporal import add_duration, duration_of, instant_of


def failing(x: Column, kind: str) -> Column:
    return F.raise_error(F.concat(F.lit('Failed to cast string "'), x, F.lit(f'" to {kind}'))).cast(SPARK_TYPES[kind])


def java_mask(mask: str) -> str:
    return mask.replace("YYYY", "yyyy").replace("DD", "dd")


def cast(x: Scalar, kind: str, mask: str | None, pos=None) -> Scalar:
    kind = {"time": PERIOD}.get(kind, kind)
    if kind not in SPARK_TYPES or kind == NULL:
        raise InvalidArgument(f"cast to {kind} is not supported", pos)
    if x.type == NULL:
        return Scalar(F.lit(None).cast(SPARK_TYPES[kind]), kind)
    if x.type == kind:
        return x
    v = x.column
    out = None
    if x.type == STRING:
        if kind in (INTEGER, NUMBER):
            value = v.try_cast(SPARK_TYPES[kind]) if kind == NUMBER else F.when(F.rlike(v, F.lit(r"^\s*[-+]?\d+\s*$")), v.try_cast("bigint"))
            out = F.when(v.isNull(), F.lit(None).cast(SPARK_TYPES[kind])).when(value.isNull(), failing(v, kind)).otherwise(value)
        elif kind == BOOLEAN:
            out = F.lower(v) == "true"
        elif kind == DATE:
            out = F.lit(None).cast("timestamp_ntz") if mask is None else F.to_timestamp_ntz(v, F.lit(java_mask(mask)))
        elif kind == DURATION:
            out = duration_of(v)
        elif kind == PERIOD:
            left, right = F.split_part(v, F.lit("/"), F.lit(1)), F.split_part(v, F.lit("/"), F.lit(2))
            start = F.when(left.startswith("P"), add_duration(instant_of(right), duration_of(left), -1)).otherwise(instant_of(left))
            end = F.when(right.startswith("P"), add_duration(instant_of(left), duration_of(right), 1)).otherwise(instant_of(right))
            out = F.when(v.isNotNull(), F.struct(start.alias("start"), end.alias("end")))
    elif x.type == INTEGER:
        out = {STRING: v.cast("string"), NUMBER: v.cast("double"), BOOLEAN: v != 0}.get(kind)
    elif x.type == NUMBER:
        if kind == INTEGER:
            out = F.when(v % 1 != 0, F.raise_error(F.concat(v.cast("string"), F.lit(" can not be casted into integer"))).cast("bigint")).otherwise(v.cast("bigint"))
        else:
            out = {STRING: v.cast("string"), BOOLEAN: v != 0}.get(kind)
    elif x.type == BOOLEAN:
        out = {STRING: v.cast("string"), INTEGER: v.cast("bigint"), NUMBER: v.cast("double")}.get(kind)
    elif x.type == DATE and kind == STRING:
        if mask is None:
            raise InvalidArgument("cast date to string requires a mask", pos)
        out = F.date_format(v, java_mask(mask))
    if out is None:
        raise InvalidArgument(f"cast {x.type} to {kind} is not supported", pos)
    return Scalar(out, kind)


