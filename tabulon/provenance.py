"""Provenance of a script: its steps, the datasets and variables they read and make, as a graph and as Turtle or JSON-LD."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from .model import Dataset
from .plans import nodes as N
from .plans import order

# Fixed vocabulary addresses.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "prov": "http://www.w3.org/ns/prov#",
    "sdth": "http://rdf-vocabulary.ddialliance.org/sdth#",
}


@dataclass
class Step:
    name: str
    index: int
    source: str
    reads: list[str]
    makes: str
    variables_read: list[str] = field(default_factory=list)
    variables_made: list[str] = field(default_factory=list)


@dataclass
class Program:
    name: str
    source: str
    steps: list[Step]
    datasets: dict[str, list[str]]

    def graph(self) -> list[tuple[str, str]]:
        """(read, made) pairs of datasets."""
        return [(r, s.makes) for s in self.steps for r in s.reads]

    def variable_graph(self) -> list[tuple[str, str]]:
        """(dataset#variable read, dataset#variable made) pairs."""
        return [(v, f"{s.makes}#{m}") for s in self.steps for v in s.variables_read for m in s.variables_made]

    def triples(self) -> list[tuple[str, str, str]]:
        quoted = lambda x: json.dumps(x, ensure_ascii=False)
        program = f"<urn:program:{self.name}>"
        out = [(program, "rdf:type", "sdth:Program"), (program, "rdfs:label", quoted(self.name)), (program, "sdth:hasSourceCode", quoted(self.source))]
        for name, variables in self.datasets.items():
            frame = f"<urn:dataset:{name}>"
            out += [(frame, "rdf:type", "sdth:DataframeInstance"), (frame, "rdfs:label", quoted(name))]
            for v in variables:
                inside = f"<urn:variable:{name}/{v}>"
                out += [(inside, "rdf:type", "sdth:VariableInstance"), (inside, "rdfs:label", quoted(v)), (frame, "sdth:hasVariableInstance", inside)]
        for s in self.steps:
            step = f"<urn:step:{self.name}/{s.index}>"
            out += [(program, "sdth:hasProgramStep", step), (step, "rdf:type", "sdth:ProgramStep"), (step, "rdfs:label", quoted(f"Create {s.makes}")), (step, "sdth:hasSourceCode", quoted(s.source))]
            out += [(step, "sdth:consumesDataframe", f"<urn:dataset:{r}>") for r in s.reads]
            out.append((step, "sdth:producesDataframe", f"<urn:dataset:{s.makes}>"))
            out += [(f"<urn:dataset:{s.makes}>", "prov:wasDerivedFrom", f"<urn:dataset:{r}>") for r in s.reads]
            out += [(step, "sdth:usesVariable", f"<urn:variable:{v.replace('#', '/')}>") for v in s.variables_read]
            out += [(step, "sdth:assignsVariable", f"<urn:variable:{s.makes}/{v}>") for v in s.variables_made]
        return out

    def turtle(self) -> str:
        head = "".join(f"@prefix {k}: <{v}> .\n" for k, v in PREFIXES.items())
        return head + "".join(f"{a} {b} {c} .\n" for a, b, c in self.triples())

    def json_ld(self) -> str:
        nodes: dict[str, dict] = {}
        for a, b, c in self.triples():
            node = nodes.setdefault(a, {"@id": a.strip("<>")})
            if b == "rdf:type":
                node["@type"] = c
            else:
                node.setdefault(b, []).append({"@id": c.strip("<>")} if c.startswith("<") else json.loads(c))
        return json.dumps({"@context": PREFIXES, "@graph": list(nodes.values())}, indent=1, ensure_ascii=False)


def assigned(expr: N.Node) -> list[str]:
    """Components that an expression computes by name."""
    if isinstance(expr, N.Clause):
        inner = assigned(expr.operand)
        items = expr.body if expr.kind == "calc" else expr.body.items if expr.kind == "aggr" else ()
        return [*inner, *(i.name for i in items)]
    if isinstance(expr, N.Join):
        return [i.name for kind, body in expr.body if kind in ("calc", "aggr") for i in (body if kind == "calc" else body.items)]
    return []


def trace(name: str, script: str, session=None) -> Program:
    """The program of a script; with a session also the variables of its datasets."""
    statements = session.statements(script) if session else order.in_order(order_input(script))
    results = {}
    if session:
        probe = type(session)(session.spark, session.median)
        probe.__dict__.update({k: (dict(v) if isinstance(v, dict) else v) for k, v in session.__dict__.items()})
        probe.outputs = {}
        results = {**probe.inputs, **probe.run(script)}
    lines = script.split("\n")
    starts = sorted(s.pos for s in statements)
    made = {s.name for s in statements if isinstance(s, N.Assign)}
    known = made | (set(session.inputs) if session else set())
    variables = {k: list(v.structure.components) for k, v in results.items() if isinstance(v, Dataset)}
    steps, datasets = [], {}
    for i, s in enumerate(s for s in statements if isinstance(s, N.Assign)):
        firm, loose = order.reads(s.expr)
        read = sorted(n for n in firm if n in known)
        end = next((p for p in starts if p > s.pos), (len(lines), 0))
        used = [f"{r}#{v}" for r in read for v in sorted(loose) if v in variables.get(r, ())]
        steps.append(Step(s.name, i + 1, text_between(lines, s.pos, end), read, s.name, used, [v for v in assigned(s.expr)] or [v for v in variables.get(s.name, []) if not read]))
        for n in [*read, s.name]:
            datasets[n] = variables.get(n, [])
    return Program(name, script, steps, datasets)


def order_input(script: str):
    from .plans.parser import parse

    return parse(script)


def text_between(lines: list[str], a: tuple[int, int], b: tuple[int, int]) -> str:
    part = lines[a[0] : b[0] + 1]
    if b[0] < len(lines):
        part[-1] = part[-1][: b[1]]
    part[0] = part[0][a[1] :]
    return "\n".join(part).strip()
