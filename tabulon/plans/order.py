"""Statement order: single assignment, dependencies, cycles."""

from __future__ import annotations

from dataclasses import fields, is_dataclass

from ..errors import CycleError, MultipleAssignment, ScriptErrors, VtlError
from . import nodes as N


def reads(node: object) -> tuple[set[str], set[str]]:
    """(names read from the session, names that may be components or session names)."""
    firm: set[str] = set()
    loose: set[str] = set()

    def walk(x: object, inside: bool) -> None:
        if isinstance(x, N.Variable):
            (loose if inside else firm).add(x.name)
        elif isinstance(x, N.Call):
            (loose if inside else firm).add(x.name)
        if isinstance(x, N.Clause):
            walk(x.operand, inside)
            walk(x.body, True)
        elif isinstance(x, N.Join):
            for operand, _ in x.operands:
                walk(operand, inside)
            walk([b for _, b in x.body], True)
        elif isinstance(x, (N.DatapointRuleset, N.HierarchicalRuleset)):
            walk([f for r in x.rules for f in (r.condition, getattr(r, "body", None))], True)
        elif is_dataclass(x) and not isinstance(x, type):
            for f in fields(x):
                walk(getattr(x, f.name), inside)
        elif isinstance(x, (tuple, list)):
            for y in x:
                walk(y, inside)
        elif isinstance(x, dict):
            for y in x.values():
                walk(y, inside)

    walk(node, False)
    return firm, loose - firm


def check_single_assignment(statements: list[N.Statement], bound: set[str]) -> None:
    errors: list[VtlError] = []
    seen: set[str] = set()
    for s in statements:
        if s.name in bound:
            errors.append(MultipleAssignment(f"Dataset {s.name} is part of the bindings and therefore cannot be assigned", s.pos))
        elif s.name in seen:
            errors.append(MultipleAssignment(f"Dataset {s.name} has already been assigned", s.pos))
        seen.add(s.name)
    if errors:
        raise errors[0] if len(errors) == 1 else ScriptErrors(errors)


def in_order(statements: list[N.Statement]) -> list[N.Statement]:
    """Statements so that each comes after those it reads; otherwise as written."""
    made = {s.name: s for s in statements}
    firm, loose = {}, {}
    for s in statements:
        a, b = reads(s)
        own = {s.name} if not isinstance(s, N.Assign) else set()
        firm[s.name] = sorted(n for n in a - own if n in made)
        loose[s.name] = sorted(n for n in b - own - {s.name} if n in made)
    out: list[N.Statement] = []
    state: dict[str, int] = {}
    errors: list[VtlError] = []

    def needs(name: str, seen: set[str]) -> set[str]:
        """Names that a statement reads for certain, directly or not."""
        for n in firm[name]:
            if n not in seen:
                seen.add(n)
                needs(n, seen)
        return seen

    def visit(name: str, path: list[str]) -> None:
        if state.get(name) == 2:
            return
        if state.get(name) == 1:
            ring = [*path[path.index(name) :], name]
            errors.append(CycleError(f"assignment creates a cycle: [{' <- '.join(ring)}]", made[name].pos))
            return
        state[name] = 1
        for n in firm[name]:
            visit(n, [*path, name])
        for n in loose[name]:  # a component of that name is likelier than a cycle
            if state.get(n) != 1 and name not in needs(n, set()):
                visit(n, [*path, name])
        state[name] = 2
        out.append(made[name])

    for s in statements:
        visit(s.name, [])
    if errors:
        raise errors[0] if len(errors) == 1 else ScriptErrors(errors)
    return out


def fan_out(statements: list[N.Statement]) -> dict[str, int]:
    """How many statements read each assigned name."""
    count = {s.name: 0 for s in statements}
    for s in statements:
        for n in reads(s)[0]:
            if n in count and n != s.name:
                count[n] += 1
    return count
