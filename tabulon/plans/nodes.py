"""Syntax tree of scripts."""

from __future__ import annotations

from dataclasses import dataclass, field

Pos = tuple[int, int]


@dataclass(frozen=True)
class Node:
    pos: Pos


@dataclass(frozen=True)
class Constant(Node):
    value: object
    type: str


@dataclass(frozen=True)
class Variable(Node):
    name: str


@dataclass(frozen=True)
class Omitted(Node):
    """The placeholder of an optional argument."""


@dataclass(frozen=True)
class Unary(Node):
    op: str
    operand: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class SetOf(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Membership(Node):
    operand: Node
    component: str


@dataclass(frozen=True)
class If(Node):
    condition: Node
    then: Node
    otherwise: Node


@dataclass(frozen=True)
class Case(Node):
    branches: tuple[tuple[Node, Node], ...]
    otherwise: Node


@dataclass(frozen=True)
class Cast(Node):
    operand: Node
    type: str
    mask: str | None


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    options: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Grouping:
    kind: str  # by, except, all
    names: tuple[str, ...] = ()
    key: Node | None = None
    period: str | None = None


@dataclass(frozen=True)
class Window:
    partition: tuple[str, ...]
    order: tuple[tuple[str, bool], ...]  # name, ascending
    frame: tuple | None  # (rows or range, low, high); a bound is None or an offset


@dataclass(frozen=True)
class Clause(Node):
    operand: Node
    kind: str
    body: object


@dataclass(frozen=True)
class CalcItem:
    role: str | None
    name: str
    expr: Node


@dataclass(frozen=True)
class Aggregation:
    items: tuple[CalcItem, ...]
    grouping: Grouping | None
    having: Node | None


@dataclass(frozen=True)
class Join(Node):
    kind: str
    operands: tuple[tuple[Node, str | None], ...]
    using: tuple[str, ...]
    body: tuple[tuple[str, object], ...]


@dataclass(frozen=True)
class Rule:
    name: str | None
    condition: Node | None
    body: Node
    code: object
    level: object


@dataclass(frozen=True)
class CodeRule:
    """left (compared with) signed right items."""

    name: str | None
    condition: Node | None
    left: str
    op: str
    items: tuple[tuple[int, str], ...]
    code: object
    level: object


@dataclass(frozen=True)
class DatapointRuleset(Node):
    name: str
    domain: bool  # signature by value domain
    signature: tuple[tuple[str, str], ...]  # variable or domain, alias
    rules: tuple[Rule, ...]


@dataclass(frozen=True)
class HierarchicalRuleset(Node):
    name: str
    domain: bool
    conditions: tuple[tuple[str, str], ...]
    component: str
    rules: tuple[CodeRule, ...]


@dataclass(frozen=True)
class Operator(Node):
    name: str
    parameters: tuple[tuple[str, str | None, Node | None], ...]
    returns: str | None
    body: Node


@dataclass(frozen=True)
class Assign(Node):
    name: str
    expr: Node
    persistent: bool


Statement = Assign | DatapointRuleset | HierarchicalRuleset | Operator
