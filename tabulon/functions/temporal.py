"""Dates, durations and periods.

A date is a timestamp without zone, in UTC.  A duration keeps calendar months,
days and microseconds apart; a period is a start and an end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..model import DATE, DURATION, INTEGER, PERIOD, STRING, Scalar
from .scalar import function

#: Period lengths: letter to months and days.
LENGTHS = {"A": (12, 0), "S": (6, 0), "Q": (3, 0), "M": (1, 0), "W": (0, 7), "D": (0, 1)}
UNITS = {"A": "year", "Q": "quarter", "M": "month", "W": "week", "D": "day"}
ISO = r"^(-?)P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d+))?S)?)?$"


def instant_of(text: Column) -> Column:
    """An ISO instant; a zone suffix is resolved to UTC."""
    zoned = F.rlike(text, F.lit(r"(?:[zZ]|[+-]\d\d:?\d\d)$")) & F.contains(text, F.lit("T"))
    return F.when(zoned, F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.to_timestamp(text).cast("timestamp_ntz"))).otherwise(F.to_timestamp_ntz(text))


def duration_of(text: Column) -> Column:
    def part(i: int) -> Column:
        return F.coalesce(F.when(F.regexp_extract(text, ISO, i) != "", F.regexp_extract(text, ISO, i)).cast("bigint"), F.lit(0).cast("bigint"))

    sign = F.when(F.regexp_extract(text, ISO, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    seconds = part(6) * 3600 + part(7) * 60 + part(8)
    fraction = F.rpad(F.substring(F.regexp_extract(text, ISO, 9), 1, 6), 6, "0").try_cast("bigint")
    return F.when(
        F.rlike(text, F.lit(ISO)),
        F.struct(
            (sign * (part(2) * 12 + part(3))).cast("int").alias("months"), (sign * (part(4) * 7 + part(5))).cast("int").alias("days"),
            (sign * (seconds * 1_000_000 + F.coalesce(fraction, F.lit(0)))).cast("bigint").alias("micros"),
        ),
    )


def add_duration(at: Column, d: Column, sign: int = 1) -> Column:
    seconds = (d["micros"] * sign / 1_000_000).cast("decimal(18,6)")
    return (at + F.make_interval(months=d["months"] * sign, days=d["days"] * sign, secs=seconds)).cast("timestamp_ntz")


def micros_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b)


def duration(months: Column | int = 0, days: Column | int = 0, micros: Column | int = 0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(months).cast("int").alias("months"), lit(days).cast("int").alias("days"), lit(micros).cast("bigint").alias("micros"))


def temporal_binary(op: str, a: Scalar, b: Scalar) -> Scalar | None:
    """date ± duration, date - date, duration × integer; None if the types are others."""
    key = (a.type, op, b.type)
    if key in ((DATE, "+", DURATION), (DURATION, "+", DATE)):
        at, d = (a, b) if a.type == DATE else (b, a)
        return Scalar(add_duration(at.column, d.column), DATE)
    if key == (DATE, "-", DURATION):
        return Scalar(add_duration(a.column, b.column, -1), DATE)
    if key == (DATE, "-", DATE):
        gone = micros_between(b.column, a.column)
        day = 86_400_000_000
        return Scalar(F.when(gone.isNotNull(), duration(0, (gone / day).cast("bigint"), gone % day)), DURATION)
    if key in ((DURATION, "*", INTEGER), (INTEGER, "*", DURATION)):
        d, n = (a, b) if a.type == DURATION else (b, a)
        return Scalar(F.when(d.column.isNotNull() & n.column.isNotNull(), duration(d.column["months"] * n.column, d.column["days"] * n.column, d.column["micros"] * n.column)), DURATION)
    if a.type == b.type == DURATION and op in "+-":
        s = 1 if op == "+" else -1
        x, y = a.column, b.column
        return Scalar(F.when(x.isNotNull() & y.isNotNull(), duration(x["months"] + y["months"] * s, x["days"] + y["days"] * s, x["micros"] + y["micros"] * s)), DURATION)
    if a.type == PERIOD and b.type == DURATION and op in "+-":
        s = 1 if op == "+" else -1
        return Scalar(F.when(a.column.isNotNull(), F.struct(add_duration(a.column["start"], b.column, s).alias("start"), add_duration(a.column["end"], b.column, s).alias("end"))), PERIOD)
    return None


def period_months(p: Column) -> Column:
    """Whole months from start to end."""
    return F.floor(F.months_between(p["end"], p["start"], False)).cast("int")


def indicator(p: Column) -> Column:
    """The letter of the period whose length this is."""
    out = None
    for letter, (months, days) in LENGTHS.items():
        same = add_duration(p["start"], duration(months, days)) == p["end"]
        out = F.when(same, letter) if out is None else out.when(same, letter)
    return out


def shift_period(p: Column, n: Column) -> Column:
    """Move a period by n times its own length, in calendar months where it spans whole months."""
    months = period_months(p)
    whole = add_duration(p["start"], duration(months)) == p["end"]
    by_month = lambda at: add_duration(at, duration(months * n))
    by_time = lambda at: add_duration(at, duration(0, 0, micros_between(p["start"], p["end"]) * n))
    return F.when(
        p.isNotNull(),
        F.struct(*[F.when(whole & (months > 0), by_month(p[x])).otherwise(by_time(p[x])).alias(x) for x in ("start", "end")]),
    )


def shift_column(x: Scalar, n: Column, unit: str | None = None) -> Column:
    """A date moves by n units (days if not told), a period by its length."""
    if x.type == PERIOD:
        return shift_period(x.column, n)
    if x.type == DATE:
        months, days = LENGTHS[unit or "D"]
        return add_duration(x.column, duration(F.lit(months) * n, F.lit(days) * n))
    raise InvalidArgument("timeshift needs a date or a time period")


def start_of(x: Scalar) -> Column:
    return x.column["start"] if x.type == PERIOD else x.column


def floor_to(at: Column, letter: str) -> Column:
    """The start of the period of this length that holds a date."""
    if letter == "S":
        half = F.make_timestamp_ntz(F.year(at), F.when(F.month(at) > 6, 7).otherwise(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        return F.when(at.isNotNull(), half)
    return F.date_trunc(UNITS[letter], at).cast("timestamp_ntz")


TEMPORAL = (DATE, PERIOD)


@function("timeshift", (PERIOD, DATE), (INTEGER,))
def timeshift(x, n):
    return Scalar(shift_column(x, n.column), x.type)


@function("truncate_time", TEMPORAL, (STRING,), (STRING,), required=2)
def truncate_time(x, unit, zone=None):
    def cut(at: Column) -> Column:
        local = F.from_utc_timestamp(at, zone.column).cast("timestamp_ntz") if zone else at
        floor = F.call_function("date_trunc", unit.column, local).cast("timestamp_ntz")
        return F.to_utc_timestamp(floor, zone.column).cast("timestamp_ntz") if zone else floor

    if x.type == DATE:
        return Scalar(cut(x.column), DATE)
    start = cut(x.column["start"])
    letter = F.upper(F.substring(unit.column, 1, 1))
    step = F.when(letter == "Y", 12).when(F.lower(unit.column) == "month", 1).otherwise(0)
    end = F.when(step > 0, add_duration(start, duration(step))).otherwise(add_duration(start, duration(0, F.when(F.lower(unit.column) == "day", 1).otherwise(0), F.when(letter == "H", 3_600_000_000).when(F.lower(unit.column) == "minute", 60_000_000).when(letter == "S", 1_000_000).otherwise(0))))
    return Scalar(F.when(x.column.isNotNull(), F.struct(start.alias("start"), end.alias("end"))), PERIOD)


@function("at_zone", (DATE,), (STRING,))
def at_zone(x, zone):
    """The wall-clock time in a zone; an unknown zone fails."""
    return Scalar(F.from_utc_timestamp(x.column, zone.column).cast("timestamp_ntz"), DATE)


function("period_indicator", (PERIOD,))(lambda x: Scalar(indicator(x.column), STRING))


@function("datediff", TEMPORAL, TEMPORAL)
def datediff(a, b):
    return Scalar(F.abs(F.datediff(start_of(a), start_of(b))).cast("bigint"), INTEGER)


@function("dateadd", TEMPORAL, (INTEGER,), (STRING,))
def dateadd(x, n, unit):
    letter, at = unit.column, start_of(x)
    months = F.when(letter == "A", 12).when(letter == "S", 6).when(letter == "Q", 3).when(letter == "M", 1).otherwise(0)
    days = F.when(letter == "W", 7).when(letter == "D", 1).otherwise(0)
    return Scalar(add_duration(at, duration(months * n.column, days * n.column)), DATE)


for _name, _part in (("getyear", F.year), ("year", F.year), ("getmonth", F.month), ("month", F.month), ("dayofmonth", F.dayofmonth), ("dayofyear", F.dayofyear)):
    function(_name, TEMPORAL)(lambda x, part=_part: Scalar(part(start_of(x)).cast("bigint"), INTEGER))


def iso_days(x: Column, big: int, letters: str) -> Column:
    return F.when(x.isNotNull(), F.concat(F.lit("P"), F.floor(x / big).cast("string"), F.lit(letters[0]), (x % big).cast("string"), F.lit(letters[1])))


function("daytoyear", (INTEGER,))(lambda x: Scalar(iso_days(x.column, 365, "YD"), STRING))
function("daytomonth", (INTEGER,))(lambda x: Scalar(iso_days(x.column, 30, "MD"), STRING))


def to_days(x: Scalar, per_year: int, per_month: int) -> Scalar:
    d = duration_of(x.column) if x.type == STRING else x.column
    return Scalar((F.floor(d["months"] / 12) * per_year + (d["months"] % 12) * per_month + d["days"]).cast("bigint"), INTEGER)


function("yeartoday", (STRING, DURATION))(lambda x: to_days(x, 365, 30))
function("monthtoday", (STRING, DURATION))(lambda x: to_days(x, 360, 30))


@function("time_agg scalar", (STRING,), TEMPORAL)
def time_agg(letter, x):
    """A date to the first day of its period of the given length, a period to that whole period."""
    unit = letter.literal
    if unit not in LENGTHS:
        raise InvalidArgument(f"unknown period {unit}")
    start = floor_to(start_of(x), unit)
    if x.type == DATE:
        return Scalar(start, DATE)
    months, days = LENGTHS[unit]
    return Scalar(F.when(x.column.isNotNull(), F.struct(start.alias("start"), add_duration(start, duration(months, days)).alias("end"))), PERIOD)


