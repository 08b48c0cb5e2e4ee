"""Scalar operators and functions: typed arguments to a typed column, all inside Catalyst.

Any null argument gives null unless a function says otherwise.  Guards keep the
script semantics under ANSI mode: they sit in the same expression as the value,
so no reordering can separate them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConflictingTypes, FunctionNotFound
from ..model import BOOLEAN, DATE, DURATION, INTEGER, NULL, NUMBER, NUMERIC, PERIOD, SPARK_TYPES, STRING, Scalar

#: Type names in messages.
SHOWN = {INTEGER: "Long", NUMBER: "Double", STRING: "String", BOOLEAN: "Boolean", DATE: "Instant", DURATION: "PeriodDuration", PERIOD: "Interval", NULL: "Object"}
#: Digits that a column may give to round and trunc.
DIGITS = range(-15, 16)

REGISTRY: dict[str, tuple[tuple[tuple[str, ...], ...], int, Callable[..., Scalar]]] = {}


def function(name: str, *accepted: tuple[str, ...], required: int | None = None):
    """Register a builder: accepted types by argument; arguments after ``required`` may be missing (None)."""

    def keep(build):
        REGISTRY[name] = (accepted, len(accepted) if required is None else required, build)
        return build

    return keep


def signature(name: str, args: list[Scalar]) -> str:
    return f"{name}({', '.join(SHOWN.get(a.type, a.type) for a in args if a is not None)})"


def apply(name: str, args: list[Scalar | None], pos=None) -> Scalar:
    """Call a registered function; arguments may be missing at the end or omitted (None)."""
    accepted, required, build = REGISTRY[name]
    given = [a for a in args]
    if len(given) > len(accepted) or len(given) < required:
        raise FunctionNotFound(signature(name, given), pos)
    for i, a in enumerate(given):
        if a is not None and a.type != NULL and accepted[i] and a.type not in accepted[i]:
            raise FunctionNotFound(signature(name, given), pos)
    given += [None] * (len(accepted) - len(given))
    typed = [a if a is None or a.type != NULL or not accepted[i] else Scalar(a.column.cast(SPARK_TYPES[accepted[i][0]]), accepted[i][0]) for i, a in enumerate(given)]
    return build(*typed)


def null(kind: str) -> Column:
    return F.lit(None).cast(SPARK_TYPES[kind])


def constant(value, kind: str | None = None) -> Scalar:
    """A Python value as a typed constant."""
    import datetime as dt

    if kind is None:
        kind = NULL if value is None else BOOLEAN if isinstance(value, bool) else INTEGER if isinstance(value, int) else NUMBER if isinstance(value, float) else STRING if isinstance(value, str) else DATE
    if kind == DATE and isinstance(value, dt.datetime) and value.tzinfo:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(value, (dt.datetime, dt.date)):
        return Scalar(F.lit(value.isoformat()).cast("timestamp_ntz"), DATE, value)
    return Scalar(F.lit(value).cast(SPARK_TYPES[kind]), kind, value)


def dbl(x: Scalar) -> Column:
    return x.column.cast("double")


def wider(a: Scalar, b: Scalar) -> str:
    return INTEGER if a.type == b.type == INTEGER else NUMBER


# ---- arithmetic

def plus(a: Scalar, b: Scalar) -> Scalar:
    return Scalar(a.column + b.column, wider(a, b))


def minus(a: Scalar, b: Scalar) -> Scalar:
    return Scalar(a.column - b.column, wider(a, b))


def times(a: Scalar, b: Scalar) -> Scalar:
    return Scalar(a.column * b.column, wider(a, b))


def quotient(a: Column, b: Column) -> Column:
    """IEEE division: a zero divisor gives an infinity or NaN."""
    at_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def divide(a: Scalar, b: Scalar) -> Scalar:
    return Scalar(quotient(dbl(a), dbl(b)), NUMBER)


for _op, _build in (("+", plus), ("-", minus), ("*", times), ("/", divide)):
    function(_op, NUMERIC, NUMERIC)(_build)


@function("unary +", NUMERIC)
def positive(a):
    return a


@function("unary -", NUMERIC)
def negative(a):
    return Scalar(-a.column, a.type)


@function("||", (STRING,), (STRING,))
def concat(a, b):
    return Scalar(F.concat(a.column, b.column), STRING)


# ---- numbers

function("ceil", NUMERIC)(lambda x: Scalar(F.ceil(x.column).cast("bigint"), INTEGER))
function("floor", NUMERIC)(lambda x: Scalar(F.floor(x.column).cast("bigint"), INTEGER))
function("abs", NUMERIC)(lambda x: Scalar(F.abs(dbl(x)), NUMBER))
function("exp", NUMERIC)(lambda x: Scalar(F.exp(dbl(x)), NUMBER))
function("power", NUMERIC, NUMERIC)(lambda a, b: Scalar(F.pow(dbl(a), dbl(b)), NUMBER))


@function("ln", NUMERIC)
def ln(x):
    v = dbl(x)
    return Scalar(F.when(v == 0, F.lit(float("-inf"))).when(v < 0, F.lit(float("nan"))).otherwise(F.ln(v)), NUMBER)


@function("sqrt", NUMERIC)
def sqrt(x):
    v = dbl(x)
    return Scalar(F.when(v < 0, F.raise_error(F.lit("Sqrt operand has to be 0 or positive")).cast("double")).otherwise(F.sqrt(v)), NUMBER)


@function("log", NUMERIC, NUMERIC)
def log(x, base):
    v, b = dbl(x), dbl(base)
    return Scalar(
        F.when(v.isNull() | b.isNull(), null(NUMBER))
        .when(v <= 0, F.raise_error(F.lit("Log operand has to be positive")).cast("double"))
        .when(b < 1, F.raise_error(F.lit("Log base has to be greater or equal than 1")).cast("double"))
        .otherwise(quotient(F.ln(v), F.ln(b))),
        NUMBER,
    )


@function("mod", NUMERIC, NUMERIC)
def mod(a, b):
    x, y = dbl(a), dbl(b)
    return Scalar(F.when(y == 0, x).otherwise(F.try_mod(x, y) * F.when(y < 0, F.lit(-1.0)).otherwise(F.lit(1.0))), NUMBER)


def steps(x: Column, digits: Column, half: float) -> Column:
    """x in whole multiples of 10 ** -digits, towards zero after ``half`` a step is added."""
    size = F.pow(F.lit(10.0), -digits)
    return F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * F.floor(F.abs(x) / size + half).cast("double") * size


def by_digits(x: Column, digits: Scalar | None, make: Callable[[Column, int], Column], half: float) -> Column:
    """make(x, digits); digits from a column choose among the usual literals, beyond which doubles have no digits or only whole steps."""
    if digits is None:
        return make(x, 0)
    if digits.literal is not None:
        return make(x, int(digits.literal))
    out = F.when(digits.column.isNull(), make(x, 0))
    for n in DIGITS:
        out = out.when(digits.column == n, make(x, n))
    return out.when(digits.column > max(DIGITS), x).otherwise(steps(x, digits.column, half))


@function("round", NUMERIC, (INTEGER,), required=1)
def round_half_up(x, digits=None):
    return Scalar(by_digits(dbl(x), digits, lambda v, n: F.round(v, n), 0.5), NUMBER)


@function("trunc", NUMERIC, (INTEGER,), required=1)
def truncate(x, digits=None):
    def cut(v: Column, n: int) -> Column:
        # from 2**53 on doubles are whole
        exact = F.when(F.abs(v) < float(1 << 53), F.abs(v)).cast("decimal(38,15)")
        whole = F.abs(v) if n >= 0 else steps(F.abs(v), F.lit(n), 0.0)
        return F.when(v < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * F.coalesce(F.floor(exact, F.lit(n)).cast("double"), whole)

    return Scalar(by_digits(dbl(x), digits, cut, 0.0), NUMBER)


@function("random", (INTEGER,), (INTEGER,))
def random(seed, draws):
    """The n-th double of the 48-bit linear congruential generator, in halves of 24 bits to stay exact."""
    half, low_m, high_m = 1 << 24, 0xE66D | (0xEC << 16), 0x5DEECE66D >> 24
    scrambled = F.pmod(seed.column, F.lit(1 << 48)).bitwiseXOR(F.lit(0x5DEECE66D).cast("bigint"))

    def step(s: Column) -> Column:
        high, low = F.floor(s / half).cast("bigint"), s % half
        carried = F.pmod(high * low_m + low * high_m, F.lit(half).cast("bigint"))
        return F.pmod(carried * half + low * low_m + 11, F.lit(1 << 48).cast("bigint"))

    before = F.aggregate(F.sequence(F.lit(1).cast("bigint"), draws.column * 2 - 1), scrambled.cast("bigint"), lambda s, _: step(s))
    first, second = before, step(before)
    value = (F.shiftright(first, 22) * F.lit(1 << 27) + F.shiftright(second, 21)).cast("double") / float(1 << 53)
    return Scalar(F.when(draws.column >= 1, value), NUMBER)


# ---- strings

BLANK = r"[\x00-\x20]"
function("trim", (STRING,))(lambda x: Scalar(F.regexp_replace(x.column, rf"^{BLANK}+|{BLANK}+$", ""), STRING))
function("ltrim", (STRING,))(lambda x: Scalar(F.regexp_replace(x.column, r"^\s+", ""), STRING))
function("rtrim", (STRING,))(lambda x: Scalar(F.regexp_replace(x.column, r"\s+$", ""), STRING))
function("upper", (STRING,))(lambda x: Scalar(F.upper(x.column), STRING))
function("lower", (STRING,))(lambda x: Scalar(F.lower(x.column), STRING))
function("length", (STRING,))(lambda x: Scalar(F.length(x.column).cast("bigint"), INTEGER))
function("levenshtein", (STRING,), (STRING,))(lambda a, b: Scalar(F.levenshtein(a.column, b.column).cast("bigint"), INTEGER))


@function("substr", (STRING,), (INTEGER,), (INTEGER,), required=1)
def substr(x, start=None, length=None):
    first = F.greatest(F.coalesce(start.column, F.lit(1)), F.lit(1)).cast("int") if start else F.lit(1)
    size = F.coalesce(length.column, F.length(x.column)).cast("int") if length else F.length(x.column)
    return Scalar(F.substring(x.column, first, size), STRING)


@function("replace", (STRING,), (STRING,), (STRING,), required=2)
def replace(x, pattern, by=None):
    return Scalar(F.regexp_replace(x.column, pattern.column, F.coalesce(by.column, F.lit("")) if by else F.lit("")), STRING)


@function("instr", (STRING,), (STRING,), (INTEGER,), (INTEGER,), required=2)
def instr(x, pattern, start=None, occurrence=None):
    cut = F.coalesce(start.column, F.lit(0)).cast("int") if start else F.lit(0)
    nth = F.coalesce(occurrence.column, F.lit(1)).cast("int") if occurrence else F.lit(1)
    rest = F.substring(x.column, cut + 1, F.length(x.column))
    found = F.aggregate(
        F.sequence(F.lit(1), nth), F.lit(0),
        lambda at, _: F.when(at < 0, at).otherwise(F.when(F.call_function("locate", pattern.column, rest, at + 1) == 0, F.lit(-1)).otherwise(F.call_function("locate", pattern.column, rest, at + 1))),
    )
    return Scalar(F.when(x.column.isNull() | pattern.column.isNull(), null(INTEGER)).otherwise(F.greatest(found, F.lit(0)).cast("bigint")), INTEGER)


# ---- comparison and logic

def common(types: list[str], pos=None) -> str:
    """The type that values of these types share; numbers widen, null fits all."""
    known = list(dict.fromkeys(t for t in types if t != NULL))
    if not known:
        return NULL
    if len(known) == 1:
        return known[0]
    if set(known) <= set(NUMERIC):
        return NUMBER
    raise ConflictingTypes([SHOWN[t] for t in types if t != NULL], pos)


COMPARE = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def compare(op: str, a: Scalar, b: Scalar, pos=None) -> Scalar:
    kind = common([a.type, b.type], pos)
    if NULL in (a.type, b.type):
        return Scalar(null(BOOLEAN), BOOLEAN)
    return Scalar(COMPARE[op](a.as_type(kind), b.as_type(kind)), BOOLEAN)


def within(x: Scalar, items: list[Scalar], negate: bool, pos=None) -> Scalar:
    kind = common([x.type, *(i.type for i in items)], pos)
    found = x.as_type(kind).isin(*[i.as_type(kind) for i in items]) if kind != NULL else null(BOOLEAN)
    return Scalar(~found if negate else found, BOOLEAN)


@function("between", (), (), ())
def between(x, low, high):
    kind = common([x.type, low.type, high.type])
    return Scalar(null(BOOLEAN) if kind == NULL else x.as_type(kind).between(low.as_type(kind), high.as_type(kind)), BOOLEAN)


@function("match_characters", (STRING,), (STRING,))
def match_characters(x, pattern):
    return Scalar(F.rlike(x.column, F.concat(F.lit(r"\A(?:"), pattern.column, F.lit(r")\z"))), BOOLEAN)


function("isnull", ())(lambda x: Scalar(x.column.isNull(), BOOLEAN))
function("and", (BOOLEAN,), (BOOLEAN,))(lambda a, b: Scalar(a.column & b.column, BOOLEAN))
function("or", (BOOLEAN,), (BOOLEAN,))(lambda a, b: Scalar(a.column | b.column, BOOLEAN))
function("xor", (BOOLEAN,), (BOOLEAN,))(lambda a, b: Scalar(a.column != b.column, BOOLEAN))
function("not", (BOOLEAN,))(lambda a: Scalar(~a.column, BOOLEAN))


@function("nvl", (), ())
def nvl(x, default):
    kind = common([x.type, default.type])
    return Scalar(F.coalesce(x.as_type(kind), default.as_type(kind)), kind)


def choose(condition: Scalar, then: Scalar, otherwise: Scalar, pos=None) -> Scalar:
    """A null condition gives null."""
    if condition.type not in (BOOLEAN, NULL):
        raise FunctionNotFound(signature("if", [condition, then, otherwise]), pos)
    kind = common([then.type, otherwise.type], pos)
    test = condition.as_type(BOOLEAN)
    return Scalar(F.when(test.isNull(), null(kind)).when(test, then.as_type(kind)).otherwise(otherwise.as_type(kind)), kind)


def case(branches: list[tuple[Scalar, Scalar]], otherwise: Scalar, pos=None) -> Scalar:
    """A null condition counts as false."""
    kind = common([*(v.type for _, v in branches), otherwise.type], pos)
    first, *rest = [(c.as_type(BOOLEAN), v.as_type(kind)) for c, v in branches]
    chain = reduce(lambda acc, cv: acc.when(*cv), rest, F.when(*first))
    return Scalar(chain.otherwise(otherwise.as_type(kind)), kind)
