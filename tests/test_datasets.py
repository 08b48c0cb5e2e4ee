import datetime as dt

import pytest

from tabulon.errors import AlreadyDefined, InvalidArgument, InvalidType, UndefinedVariable, VtlError
from tabulon.model import ATTRIBUTE, IDENTIFIER, MEASURE, Dataset
from tabulon.session import Session


@pytest.fixture
def s(spark):
    session = Session(spark)
    session.bind("ds", spark.createDataFrame([("a", 1, 10.0, "x"), ("b", 2, None, "y"), ("c", None, 30.0, "x")], "id string, n bigint, v double, t string"), ids=["id"])
    session.bind("other", spark.createDataFrame([("a", 5, 1.0), ("b", 6, 2.0), ("z", 7, 3.0)], "id string, n bigint, v double"), ids=["id"])
    return session


def rows(ds: Dataset, *names):
    return sorted((tuple(r) for r in ds.df.select(*(names or ds.df.columns)).collect()), key=str)


def run(s, text, *names):
    return rows(s.run(f"res := {text};")["res"], *names)


def test_filter_drops_null(s):
    assert run(s, "ds[filter n > 1]", "id") == [("b",)]


def test_calc_sees_input(s):
    assert run(s, "ds[calc n := n + 1, m := n]", "id", "n", "m") == [("a", 2, 1), ("b", 3, 2), ("c", None, None)]


def test_calc_identifier_rejected(s):
    with pytest.raises(InvalidArgument):
        s.run('r := ds[calc id := "q"];')


def test_roles(s):
    out = s.run("r := ds[calc attribute a := n, identifier k := t];")["r"].structure
    assert out["a"].role == ATTRIBUTE and out["k"].role == IDENTIFIER and out["n"].role == MEASURE


def test_keep_drop_errors(s):
    with pytest.raises(InvalidArgument):
        s.run("r := ds[keep id];")
    with pytest.raises(UndefinedVariable):
        s.run("r := ds[drop nope];")


def test_rename(s):
    out = s.run("r := ds[rename n to v, v to n];")["r"]
    assert rows(out, "id", "n")[0] == ("a", 10.0) and out.structure["v"].type == "integer"
    with pytest.raises(AlreadyDefined):
        s.run("q := ds[rename n to t];")


def test_lift_two(s):
    assert run(s, "ds[keep n, v] + other", "id", "n", "v") == [("a", 6, 11.0), ("b", 8, None)]


def test_lift_needs_same_names(s):
    with pytest.raises(InvalidArgument):
        s.run("r := ds#n + other#v;")


def test_lift_same_rows_needs_no_join(s):
    plan = s.run("r := ds[keep n, v] * 2 + 1;")["r"].df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    x = s.run("y := ds#n; z := y + y;")["z"].df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in x


def test_lift_one_join_for_all_measures(s):
    plan = s.run("r := ds[keep n, v] + other;")["r"].df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_bool_var(s):
    assert s.run("r := ds#n > 1;")["r"].measures == ["bool_var"]


def test_joins(s):
    assert run(s, "inner_join(ds[keep t] as a, other as b)", "id", "t", "n") == [("a", "x", 5), ("b", "y", 6)]
    s.reset()
    assert run(s, "full_join(ds[keep t] as a, other as b)", "id", "t") == [("a", "x"), ("b", "y"), ("c", "x"), ("z", None)]
    s.reset()
    assert run(s, "inner_join(ds as a, other as b)", "id", "n") == [("a", 5), ("b", 6)]  # the last alias wins
    s.reset()
    assert run(s, "inner_join(ds as a, other as b calc k := a#n * 10 + b#n keep k)", "id", "k") == [("a", 15), ("b", 26)]
    s.reset()
    assert run(s, "left_join(ds as a, other as b keep a#n, b#v)", "id", "n", "v") == [("a", 1, 1.0), ("b", 2, 2.0), ("c", None, None)]
    with pytest.raises(InvalidArgument):
        s.run("q := inner_join(ds, other);")
    with pytest.raises(InvalidArgument):
        s.run("q := inner_join(ds[keep n], other as b);")


def test_sets(s, spark):
    a = spark.createDataFrame([(1, "l"), (2, "l")], "k bigint, w string")
    b = spark.createDataFrame([("r", 2), ("r", 3)], "w string, k bigint")
    s.bind("a", a, ids=["k"]), s.bind("b", b, ids=["k"])
    assert run(s, "union(a, b)", "k", "w") == [(1, "l"), (2, "l"), (3, "r")]
    s.reset()
    assert run(s, "union(b, a)", "k", "w") == [(1, "l"), (2, "r"), (3, "r")]
    out = s.run("i := intersect(a, b); d := setdiff(a, b); y := symdiff(a, b); u := union(a, a);")
    assert rows(out["i"], "k") == [(2,)] and rows(out["d"], "k") == [(1,)] and rows(out["y"], "k") == [(1,), (3,)] and rows(out["u"], "k") == [(1,), (2,)]
    with pytest.raises(InvalidArgument):
        s.run("bad := union(a, ds);")


def test_aggregates(s):
    out = s.run("g := ds[aggr c := count(), s := sum(n), m := median(v) group by t having count() > 1]; w := sum(ds[keep n]); e := ds[aggr c := count() group except id];")
    assert rows(out["g"], "t", "c", "s", "m") == [("x", 2, 1, 20.0)]
    assert rows(out["w"], "n") == [(3,)] and rows(out["e"], "c") == [(3,)]


def test_analytic_role_and_frame(s):
    out = s.run("r := ds[calc identifier k := rank(over (order by id)), p := lag(n, 1 over (order by id)), l := lead(n, 1, 0 over (order by id))];")["r"]
    assert out.structure["k"].role == IDENTIFIER
    assert rows(out, "id", "k", "p", "l") == [("a", 1, None, 2), ("b", 2, 1, None), ("c", 3, 2, 0)]
    with pytest.raises(VtlError):
        s.run("q := ds[calc x := sum(n over (order by t range between 1 preceding and current data point))];")


def test_pivot_unpivot(s):
    out = s.run("p := ds[calc identifier k := t][keep v][pivot k, v]; q := ds[keep v][calc w := v][unpivot what, amount];")
    assert rows(out["p"], "id", "x", "y") == [("a", 10.0, None), ("b", None, None), ("c", 30.0, None)]
    assert rows(out["q"], "id", "what", "amount") == [("a", "v", 10.0), ("a", "w", 10.0), ("c", "v", 30.0), ("c", "w", 30.0)]


def test_persistent(s):
    assert s.run("k <- ds[keep n];")["k"].persistent
    with pytest.raises(InvalidType, match="expected Dataset"):
        s.run("j <- 1;")


def test_check_datapoint_nulls_and_one_scan(s):
    rules = "define datapoint ruleset r (variable n, v as w) is a: when n > 1 then w > 5 errorcode \"E\"; b: w > 20 errorlevel 3 end datapoint ruleset;"
    out = s.run(rules + "all_rows := check_datapoint(ds, r all); bad := check_datapoint(ds, r);")
    assert rows(out["all_rows"], "id", "ruleid", "bool_var") == [("a", "a", True), ("a", "b", False), ("b", "a", True), ("b", "b", None), ("c", "a", True), ("c", "b", True)]
    assert rows(out["bad"], "id", "ruleid", "errorlevel") == [("a", "b", 3)]
    assert "bool_var" not in out["bad"].structure
    with pytest.raises(InvalidArgument, match="not contained"):
        s.run("define datapoint ruleset z (variable nope) is nope > 1 end datapoint ruleset; y := check_datapoint(ds, z);")


def test_hierarchy_subtracts(spark):
    s = Session(spark)
    s.bind("h", spark.createDataFrame([(1, "A", 5), (1, "B", 9), (1, "C", 4), (2, "A", 1), (2, "B", 9)], "g int, code string, v bigint"), ids=["g", "code"])
    rules = "define hierarchical ruleset r (variable rule code) is A = B - C errorcode \"x\" end hierarchical ruleset;"
    out = s.run(rules + "c := check_hierarchy(h, r rule code partial_zero all_measures); t := hierarchy(h, r rule code partial_zero);")
    assert rows(out["c"], "g", "bool_var", "imbalance", "errorcode") == [(1, True, 0, None), (2, False, -8, "x")]
    assert rows(out["t"], "g", "code", "v") == [(1, "A", 5), (2, "A", 9)]


def test_hierarchy_conditions_hold_for_their_rule_alone(spark):
    s = Session(spark)
    data = [(1990, "T", 9), (1990, "A", 5), (1990, "B", 1), (1990, "C", 7), (1990, "D", 2), (2010, "T", 9), (2010, "A", 5), (2010, "B", 4), (2010, "C", 8), (2010, "D", 2)]
    s.bind("h", spark.createDataFrame(data, "year int, code string, v bigint"), ids=["year", "code"])
    head = "define hierarchical ruleset {} (variable condition year as y rule code) is "
    rules = head.format("r") + "when y > 2000 then T = A + B; C = A + D end hierarchical ruleset;"
    rules += head.format("x") + "when y > 2000 then E = A + B; when y <= 2000 then E = A - B; F = E + D end hierarchical ruleset;"
    rules += head.format("q") + "when y > 2000 then G = A + B; H = G + A; when y > 3000 then C = A end hierarchical ruleset;"
    out = s.run(rules + "c := check_hierarchy(h, r rule code non_null all_measures); z := check_hierarchy(h, r rule code always_zero all_measures); t := hierarchy(h, r rule code non_null); e := hierarchy(h, x rule code non_null); p := check_hierarchy(h, q rule code dataset_priority all_measures);")
    checked = [(1990, "C", True, 0), (2010, "C", False, 1), (2010, "T", True, 0)]
    assert rows(out["c"], "year", "code", "bool_var", "imbalance") == rows(out["z"], "year", "code", "bool_var", "imbalance") == checked
    assert rows(out["t"], "year", "code", "v") == [(1990, "C", 7), (2010, "C", 7), (2010, "T", 9)]
    assert rows(out["e"], "year", "code", "v") == [(1990, "E", 4), (1990, "F", 6), (2010, "E", 9), (2010, "F", 11)]
    assert rows(out["p"], "year", "code", "v", "bool_var") == [(2010, "G", 9, True), (2010, "H", 14, True)]


def test_time_series(spark):
    s = Session(spark)
    days = [(dt.datetime(2020, 1, d), float(d)) for d in (1, 2, 4)]
    s.bind("d", spark.createDataFrame(days, "day timestamp_ntz, v double"), ids=["day"])
    out = s.run("st := flow_to_stock(d); fl := stock_to_flow(st); f := fill_time_series(d, single); m := time_agg(\"M\", _, d); sh := timeshift(d, 1);")
    assert [r[1] for r in rows(out["st"])] == [1.0, 3.0, 7.0]
    assert rows(out["fl"]) == rows(s.inputs["d"])
    assert [r[1] for r in rows(out["f"])] == [1.0, 2.0, None, 4.0]
    assert {r[0] for r in rows(out["m"])} == {dt.datetime(2020, 1, 1)}
    assert rows(out["sh"])[0][0] == dt.datetime(2020, 1, 2)


def test_statement_order_does_not_matter(s):
    import itertools

    lines = ["x := ds[keep n];", "y := x + 1;", "z := y[filter n > 2];"]
    seen = []
    for p in itertools.permutations(lines):
        s.reset()
        seen.append(rows(s.run("".join(p))["z"]))
    assert all(x == seen[0] for x in seen)


def test_registered(s):
    s.register("twice", lambda x: x * 2, ["number"], "number")
    s.register_dataset_fn("size", lambda ds: ds.df.count())
    out = s.run("a := twice(ds#v); b := size(ds); c := twice(4);")
    assert rows(out["a"], "v") == [(20.0,), (60.0,), (None,)] and s.value(out["b"]) == 3 and s.value(out["c"]) == 8.0


def test_operator_definition(s):
    out = s.run("define operator f(d dataset, k number default 2) returns dataset is d * k end operator; a := f(ds#n); b := f(ds#n, 10);")
    assert rows(out["b"], "n") == [(10,), (20,), (None,)]
    with pytest.raises(InvalidType):
        s.run("c := f(1);")


def test_empty_dataset(spark):
    s = Session(spark)
    s.bind("e", spark.createDataFrame([], "id string, n bigint"), ids=["id"])
    out = s.run("a := e + e; b := e[aggr c := count() group by id]; c := union(e, e); d := check(e > 1);")
    assert all(rows(v) == [] for v in out.values())


def test_joins_without_using_need_one_set_of_identifiers(spark):
    s = Session(spark)
    s.bind("a", spark.createDataFrame([(1, 1, 2.0)], "i long, j long, x double"), ids=["i", "j"])
    s.bind("b", spark.createDataFrame([(1, 5, 3.0), (1, 6, 4.0)], "i long, k long, y double"), ids=["i", "k"])
    for kind in ("inner_join", "left_join", "full_join"):
        with pytest.raises(InvalidArgument, match="common identifiers"):
            s.run(f"{kind[0]} := {kind}(a, b);")


def test_pivot_raises_on_two_values_for_a_cell(spark):
    s = Session(spark)
    s.bind("a", spark.createDataFrame([(1, "x", 2.0), (1, "x", 3.0), (2, "y", 4.0)], "i long, k string, v double"), ids=["i", "k"])
    with pytest.raises(Exception, match="more than one data point"):
        s.run("p := a[pivot k, v];")["p"].df.collect()


def test_numbers_and_patterns_at_their_edges(spark):
    s = Session(spark)
    rows = [(1, 1e25, "abc\n", -20), (2, -123.456, "abc", -2), (3, 5.55e20, "ABC", -20), (4, float("nan"), None, 400)]
    s.bind("a", spark.createDataFrame(rows, "i long, x double, t string, n long"), ids=["i"])
    got = {r.i: r for r in s.run('r := a[calc u := trunc(x), w := trunc(x, n), o := round(x, n), m := match_characters(t, "abc")];')["r"].df.collect()}
    assert [got[i].u for i in (1, 2, 3)] == [1e25, -123.0, 5.55e20] and got[4].u != got[4].u
    assert (got[1].m, got[2].m, got[3].m, got[4].m) == (False, True, False, None)
    assert (got[2].w, got[2].o) == (-100.0, -100.0) and got[3].w == pytest.approx(5e20) and got[3].o == pytest.approx(6e20)


def test_discrete_median_is_an_element(spark):
    s = Session(spark, median="discrete")
    s.bind("a", spark.createDataFrame([(i, float(v)) for i, v in enumerate((10, 20, 25, 30))], "i long, x double"), ids=["i"])
    assert s.run("m := a[aggr m := median(x)];")["m"].df.first().m == 20.0
