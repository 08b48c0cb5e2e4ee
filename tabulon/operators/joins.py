"""inner, left, full and cross joins of datasets, folded from the left."""

from __future__ import annotations

from ..errors import InvalidArgument
from ..model import IDENTIFIER, Component, Dataset, Structure, col

HOW = {"inner_join": "inner", "left_join": "left", "full_join": "outer"}


def keys_of(kind: str, operands: list[tuple[str, Dataset, bool]], using: tuple[str, ...], pos) -> list[str]:
    if using:
        if kind in ("full_join", "cross_join"):
            raise InvalidArgument(f"{kind} takes no using", pos)
        for k in using:
            for alias, ds, _ in operands:
                if k not in ds.structure:
                    raise InvalidArgument(f"using component {k} has to be present in all datasets", pos)
                if ds.structure[k].role != IDENTIFIER:
                    raise InvalidArgument(f"using component {k} has to be an identifier", pos)
        return list(using)
    shared = operands[0][1].ids
    if not shared or any(set(ds.ids) != set(shared) for _, ds, _ in operands):
        raise InvalidArgument("datasets must have common identifiers", pos)
    return list(shared)


def join(kind: str, operands: list[tuple[str, Dataset, bool]], using: tuple[str, ...] = (), pos=None) -> Dataset:
    """operands: (alias, dataset, alias given). Components that several operands share are named ``alias#name``."""
    aliases = [a for a, _, _ in operands]
    if len(set(aliases)) < len(aliases):
        raise InvalidArgument("join operands need distinct aliases", pos)
    keys = [] if kind == "cross_join" else keys_of(kind, operands, using, pos)
    count: dict[str, int] = {}
    for _, ds, _ in operands:
        for c in ds.structure:
            if c.name not in keys:
                count[c.name] = count.get(c.name, 0) + 1
    shared = {n for n, k in count.items() if k > 1}
    if shared and not all(given for _, ds, given in operands if any(c.name in shared for c in ds.structure)):
        raise InvalidArgument("not aliased datasets must not have common components", pos)
    out, components = None, []
    for alias, ds, _ in operands:
        to = {c.name: f"{alias}#{c.name}" if c.name in shared else c.name for c in ds.structure}
        part = ds.df.select(*[col(c.name).alias(to[c.name]) for c in ds.structure])
        components += [Component(to[c.name], c.type, c.role, c.nullable, c.domain) for c in ds.structure if c.name not in keys or not any(x.name == c.name for x in components)]
        if out is None:
            out = part
        elif kind == "cross_join":
            out = out.crossJoin(part)
        else:
            out = out.join(part, keys, HOW[kind])
    ordered = [c for c in components if c.name in keys] + [c for c in components if c.name not in keys]
    return Dataset(out.select(*[col(c.name) for c in ordered]), Structure(ordered))


def settle(ds: Dataset) -> Dataset:
    """After the body: ``alias#name`` becomes ``name``; the last alias wins."""
    last: dict[str, Component] = {}
    for c in ds.structure:
        base = c.name.rpartition("#")[2]
        if "#" not in c.name or base not in last or "#" in last[base].name:
            last[base] = c
    for c in ds.structure:
        if "#" not in c.name:
            last[c.name] = c
    kept = [(b, c) for b, c in last.items()]
    return Dataset(ds.df.select(*[col(c.name).alias(b) for b, c in kept]), Structure([Component(b, c.type, c.role, c.nullable, c.domain) for b, c in kept]))
