"""Scalar operations on whole datasets: one join of the operands, one projection of all measures."""

from __future__ import annotations

from collections.abc import Callable

from ..errors import InvalidArgument
from ..model import BOOLEAN, MEASURE, NULL, STRING, Component, Dataset, Scalar, Structure, col


def joined(datasets: list[Dataset], pos=None) -> tuple:
    """(rows, ids, prefix of each dataset's measures): inner join on shared identifiers.

    Operands over the same rows need no join.
    """
    lead = max(datasets, key=lambda d: len(d.ids))
    if all(d.df is datasets[0].df for d in datasets):
        return datasets[0].df, lead, [lambda m: m] * len(datasets)
    renamers = [lambda m, i=i: f"__{i}__{m}" for i in range(len(datasets))]
    parts = [d.df.select(*[col(n) for n in d.ids], *[col(m).alias(r(m)) for m in d.measures]) for d, r in zip(datasets, renamers, strict=True)]
    order = sorted(range(len(datasets)), key=lambda i: -len(datasets[i].ids))
    out, have = parts[order[0]], set(datasets[order[0]].ids)
    for i in order[1:]:
        keys = [n for n in datasets[i].ids if n in have]
        if not keys or len(keys) < len(datasets[i].ids):
            raise InvalidArgument("operands of a dataset operation need identifiers of one in the other", pos)
        out = out.join(parts[i], keys, "inner")
    return out, lead, renamers


def lift(operands: list[Dataset | Scalar], build: Callable[[list[Scalar]], Scalar], pos=None, free: tuple[int, ...] = ()) -> Dataset:
    """Apply a scalar operation to every measure.

    Datasets of several measures must agree in names; a single measure is used
    with each of them.  Two single measures need one name unless the operand's
    place is in ``free`` (conditions).  A single boolean result is named
    ``bool_var``.
    """
    places = [i for i, x in enumerate(operands) if isinstance(x, Dataset)]
    datasets = [operands[i] for i in places]
    for d in datasets:
        if not d.measures:
            raise InvalidArgument("a dataset operand has no measure", pos)
    strict = [d for i, d in zip(places, datasets, strict=True) if i not in free] or datasets
    several = [d for d in strict if len(d.measures) > 1]
    if several:
        names = several[0].measures
        if any(set(d.measures) != set(names) for d in several):
            raise InvalidArgument("operand measures must have the same names", pos)
    else:
        names = strict[0].measures
        if any(d.measures != names for d in strict):
            raise InvalidArgument("operand measures must have the same name", pos)
    df, lead, renamers = joined(datasets, pos)
    results = []
    for m in names:
        args: list[Scalar] = list(operands)
        for i, d, r in zip(places, datasets, renamers, strict=True):
            own = m if m in d.structure and d.structure[m].role == MEASURE else d.measures[0]
            args[i] = Scalar(col(r(own)), d.structure[own].type)
        value = build(args)
        results.append((m, value if value.type != NULL else Scalar(value.as_type(STRING), STRING)))
    if len(results) == 1 and results[0][1].type == BOOLEAN:
        results = [("bool_var", results[0][1])]
    structure = Structure([lead.structure[n] for n in lead.ids] + [Component(m, v.type) for m, v in results])
    return Dataset(df.select(*[col(n) for n in lead.ids], *[v.column.alias(m) for m, v in results]), structure)
