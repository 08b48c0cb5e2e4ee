import math

import pytest

from tabulon.errors import ConflictingTypes, FunctionNotFound, InvalidArgument, NotImplementedFunction, UndefinedVariable
from tabulon.session import Session

VALUES = [
    ("1 + 2", 3), ("7 / 2", 3.5), ("1 / 0", math.inf), ("-1 / 0", -math.inf), ("2 * 1.5", 3.0), ("-(3)", -3),
    ("ceil(3.2)", 4), ("floor(-3.2)", -4), ("abs(-2)", 2.0), ("exp(0)", 1.0), ("ln(1)", 0.0), ("ln(0)", -math.inf),
    ("sqrt(16)", 4.0), ("round(2.5)", 3.0), ("round(1234.567, -2)", 1200.0), ("round(-1.005, 2)", -1.01), ("trunc(-1.29, 1)", -1.2), ("trunc(12.999)", 12.0),
    ("mod(5, 2)", 1.0), ("mod(5, -2)", -1.0), ("mod(9, 0)", 9.0), ("power(2, 10)", 1024.0), ("log(8, 2)", 3.0),
    ('"a" || "b"', "ab"), ('trim("  a ")', "a"), ('ltrim(" a ")', "a "), ('rtrim(" a ")', " a"), ('upper("aé")', "AÉ"), ('length("abc")', 3),
    ('substr("hello", 2, 3)', "ell"), ('substr("hello")', "hello"), ('substr("hello", _, 2)', "he"), ('substr("hello", 0, 2)', "he"), ('substr("hello", 9)', ""), ('substr("hello", 3, 99)', "llo"),
    ('replace("Hello world", "[el]+", "-")', "H-o wor-d"), ('replace("abc", "b")', "ac"),
    ('instr("abcabc", "bc")', 2), ('instr("abcabc", "bc", 0, 2)', 5), ('instr("abcabc", "bc", 2)', 3), ('instr("abc", "z")', 0), ('instr("aaa", "aa", 0, 2)', 2),
    ('levenshtein("kitten", "sitting")', 3),
    ("1 = 1.0", True), ("1 < 2 and 2 <> 3", True), ("true xor false", True), ("not true", False), ("3 in {1, 2, 3}", True), ('"a" not_in {"a"}', False), ("between(2, 1, 3)", True),
    ('match_characters("abc", "ab")', False), ('match_characters("abc", "a.c")', True), ("isnull(null)", True),
    ("if 1 > 2 then 3 else 4", 4), ("nvl(null, 5)", 5), ("case when false then 1 when true then 2 else 3", 2),
    ('cast("12", integer)', 12), ('cast("1.5", number)', 1.5), ('cast("TRUE", boolean)', True), ("cast(0, boolean)", False), ("cast(2.0, integer)", 2), ("cast(true, string)", "true"),
    ('cast(cast("31/12/2021", date, "DD/MM/YYYY"), string, "YYYY-MM")', "2021-12"),
    ('getyear(cast("2020-02-29", date, "YYYY-MM-DD") + cast("P1Y", duration))', 2021),
    ('dayofyear(cast("2020-03-01", date, "YYYY-MM-DD"))', 61), ('period_indicator(cast("2020-01-01/P1M", time_period))', "M"),
    ('getmonth(timeshift(cast("2020-01-01/2020-04-01", time_period), 2))', 7), ('daytoyear(400)', "P1Y35D"), ('monthtoday("P2M3D")', 63),
]


@pytest.fixture(scope="module")
def results(spark):
    session = Session(spark)
    script = "".join(f"v{i} := {text};" for i, (text, _) in enumerate(VALUES))
    out = session.run(script)
    row = spark.range(1).select(*[out[f"v{i}"].column.alias(f"v{i}") for i in range(len(VALUES))]).first()
    return row.asDict()


@pytest.mark.parametrize("i", range(len(VALUES)), ids=[t for t, _ in VALUES])
def test_value(results, i):
    want, got = VALUES[i][1], results[f"v{i}"]
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


NULLS = ["null + 1", "1 / null", "round(null, 1)", 'substr(null, 1, 2)', 'null || "a"', "null and true", "null = 1", "null in {1}", "if null then 1 else 2", "ln(null)", "mod(null, 2)", "not null", "cast(null, integer)", "ln(-1) * null"]


def test_nulls(spark):
    out = Session(spark).run("".join(f"n{i} := {t};" for i, t in enumerate(NULLS)))
    row = spark.range(1).select(*[v.column.alias(k) for k, v in out.items()]).first()
    assert all(x is None for x in row), row


def test_three_valued_logic(spark):
    s = Session(spark)
    out = s.run("a := null and false; b := null or true; c := null or false;")
    assert s.value(out["a"]) is False and s.value(out["b"]) is True and s.value(out["c"]) is None


def test_random_is_the_48_bit_generator(spark):
    s = Session(spark)
    assert s.value(s.run("r := random(111, 1);")["r"]) == pytest.approx(0.7213825824542086)
    state, draws = (42 ^ 0x5DEECE66D) & ((1 << 48) - 1), []
    for _ in range(3):
        bits = []
        for n in (26, 27):
            state = (state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
            bits.append(state >> (48 - n))
        draws.append(((bits[0] << 27) + bits[1]) / (1 << 53))
    assert s.value(s.run("q := random(42, 3);")["q"]) == draws[2]


@pytest.mark.parametrize(
    "text, error, message",
    [
        ('ceil("a")', FunctionNotFound, r"function 'ceil\(String\)' not found"), ('1 = "a"', ConflictingTypes, r"conflicting types: \[Long, String\]"),
        ('if true then 1 else "a"', ConflictingTypes, "conflicting"), ("nothing(1)", NotImplementedFunction, "the function nothing is not yet implemented"),
        ("missing + 1", UndefinedVariable, "undefined variable missing"), ('{1, "a"}', ConflictingTypes, "conflicting"), ("sqrt()", FunctionNotFound, "not found"),
        ("cast(true, date)", InvalidArgument, "not supported"),
    ],
)
def test_static_errors(spark, text, error, message):
    with pytest.raises(error, match=message) as e:
        Session(spark).run(f"x := {text};")
    assert e.value.pos is not None


@pytest.mark.parametrize("text, message", [("sqrt(-1)", "Sqrt operand"), ("log(0, 2)", "Log operand"), ('cast("x", integer)', "Failed to cast"), ("cast(1.1, integer)", "can not be casted into integer")])
def test_data_errors(spark, text, message):
    s = Session(spark)
    out = s.run(f"x := {text};")["x"]
    with pytest.raises(Exception, match=message):
        s.value(type(out)(out.column, out.type))
