import itertools

import pytest

from tabulon.errors import CycleError, MultipleAssignment, VtlSyntaxError
from tabulon.plans import nodes as N
from tabulon.plans.order import check_single_assignment, in_order
from tabulon.plans.parser import parse


def expr(text):
    return parse(f"x := {text};")[0].expr


def test_precedence():
    e = expr("a + b * c > 1 and not d or e")
    assert e.op == "or" and e.left.op == "and" and e.left.left.op == ">" and e.left.left.left.right.op == "*"


def test_minus_without_blank():
    e = expr("5-2")
    assert e.op == "-" and e.right.value == 2


def test_comments_and_quotes():
    s = parse("/* c */ 'my set' := a.b + 1; // end")
    assert s[0].name == "my set" and s[0].expr.left.name == "a.b"


@pytest.mark.parametrize("bad", ["a := ;", "a := (1 + ;", "a = 1;", "a := b[filter x", "a := 1 b := 2;", "a := §;"])
def test_rejects(bad):
    with pytest.raises(VtlSyntaxError):
        parse(bad)


def test_positions():
    with pytest.raises(VtlSyntaxError) as e:
        parse("a := 1;\nb := );")
    assert e.value.pos == (1, 5)


def test_window_bounds():
    w = expr("sum(m over (partition by a order by b desc data points between 2 preceding and unbounded following))").options["over"]
    assert w == N.Window(("a",), (("b", False),), ("rows", -2, "+"))


def test_order_of_all_permutations():
    lines = ["a := b + 1;", "b := c + 1;", "c := d;", "e := a + c;"]
    for p in itertools.permutations(lines):
        names = [s.name for s in in_order(parse(" ".join(p)))]
        assert names.index("c") < names.index("b") < names.index("a") < names.index("e")


def test_cycle():
    with pytest.raises(CycleError, match="assignment creates a cycle"):
        in_order(parse("a := b; b := c; c := a;"))


def test_component_names_make_no_cycle():
    names = [s.name for s in in_order(parse("a := ds[calc b := c + 1]; c := a[filter c > 1];"))]
    assert names == ["a", "c"]


def test_single_assignment():
    with pytest.raises(MultipleAssignment, match="has already been assigned"):
        check_single_assignment(parse("a := 1; a := 2;"), set())
    with pytest.raises(MultipleAssignment, match="part of the bindings"):
        check_single_assignment(parse("a := 1;"), {"a"})
