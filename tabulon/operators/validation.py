"""check, check_datapoint, check_hierarchy and hierarchy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..model import BOOLEAN, IDENTIFIER, INTEGER, MEASURE, NUMBER, NUMERIC, STRING, SPARK_TYPES, Component, Dataset, Scalar, Structure, col

MODES = {"non_null", "non_zero", "partial_null", "partial_zero", "always_null", "always_zero"}


def constant_type(values: list[object], default: str, what: str, pos) -> str:
    """The one type of the given error codes or levels."""
    kinds = {STRING if isinstance(v, str) else NUMBER if isinstance(v, float) else INTEGER for v in values if v is not None}
    if len(kinds) > 1:
        raise InvalidArgument(f"{what} of rules must have one type", pos)
    return kinds.pop() if kinds else default


def typed(value: object, kind: str) -> Column:
    return F.lit(value).cast(SPARK_TYPES[kind])


def check(ds: Dataset, code: object, level: object, imbalance: Dataset | None, output: str | None, pos=None) -> Dataset:
    """Error fields where a boolean measure is false; ``invalid`` keeps those rows only."""
    if len(ds.measures) != 1 or ds.structure[ds.measures[0]].type != BOOLEAN:
        raise InvalidArgument("Check operand dataset measure has to be boolean", pos)
    ok = ds.measures[0]
    df = ds.df.select(*[col(n) for n in ds.ids], col(ok).alias("bool_var"))
    kind = NUMBER
    if imbalance is not None:
        if len(imbalance.measures) != 1 or imbalance.structure[imbalance.measures[0]].type not in NUMERIC:
            raise InvalidArgument("Check imbalance dataset measure has to be numeric", pos)
        kind = imbalance.structure[imbalance.measures[0]].type
        keys = [n for n in ds.ids if n in imbalance.ids]
        df = df.join(imbalance.df.select(*[col(n) for n in keys], col(imbalance.measures[0]).alias("imbalance")), keys, "left")
    else:
        df = df.withColumn("imbalance", F.lit(None).cast("double"))
    code_type, level_type = constant_type([code], STRING, "error codes", pos), constant_type([level], INTEGER, "error levels", pos)
    wrong = ~col("bool_var")
    fields = [F.when(wrong, typed(code, code_type)).alias("errorcode"), F.when(wrong, typed(level, level_type)).alias("errorlevel")]
    components = [*(ds.structure[n] for n in ds.ids), Component("bool_var", BOOLEAN), Component("imbalance", kind), Component("errorcode", code_type), Component("errorlevel", level_type)]
    out = Dataset(df.select(*[col(n) for n in ds.ids], col("bool_var"), col("imbalance"), *fields), Structure(components))
    if output == "invalid":
        out = Dataset(out.df.filter(~col("bool_var")), out.structure).select([c.name for c in components if c.name != "bool_var"])
    return out


def labels(ruleset) -> list[str]:
    return [r.name or f"{ruleset.name}_{i + 1}" for i, r in enumerate(ruleset.rules)]


def check_datapoint(ds: Dataset, ruleset, evaluate, components: tuple[str, ...] = (), output: str | None = None, pos=None) -> Dataset:
    """A row for each row and rule, by exploding the rules' results: one scan whatever their number.

    ``evaluate(expression, names)`` gives a rule's expression over the dataset, names standing for aliases.
    """
    names: dict[str, str] = {}
    for i, (variable, alias) in enumerate(ruleset.signature):
        if ruleset.domain:
            found = [components[i]] if i < len(components) else [c.name for c in ds.structure if c.domain == variable]
            if not found:
                raise InvalidArgument(f"Valuedomain {variable} not used in {', '.join(ds.structure.components)} components", pos)
            target = found[0]
        else:
            target = components[i] if i < len(components) else variable
            if target not in ds.structure:
                raise InvalidArgument(f"Variable {variable} not contained in {', '.join(ds.structure.components)}", pos)
        if alias != target and alias in ds.structure:
            raise InvalidArgument(f"Alias {alias} from {ruleset.name} ruleset already defined in {', '.join(ds.structure.components)}", pos)
        names[alias] = target
    code_type = constant_type([r.code for r in ruleset.rules], STRING, "error codes", pos)
    level_type = constant_type([r.level for r in ruleset.rules], INTEGER, "error levels", pos)
    results = []
    for label, rule in zip(labels(ruleset), ruleset.rules, strict=True):
        then = evaluate(rule.body, names).as_type(BOOLEAN)
        if rule.condition is None:
            when, held = F.lit(True), then
        else:
            when = evaluate(rule.condition, names).as_type(BOOLEAN)
            held = F.when(when.isNull(), then).when(then.isNull(), when).otherwise(~when | then)
        failed = F.coalesce(when & ~then, F.lit(False))
        results.append(
            F.struct(F.lit(label).alias("ruleid"), held.alias("bool_var"), F.when(failed, typed(rule.code, code_type)).alias("errorcode"), F.when(failed, typed(rule.level, level_type)).alias("errorlevel"))
        )
    rest = [c for c in ds.structure if c.role != IDENTIFIER]
    df = ds.df.select(*[col(c.name) for c in ds.structure], F.explode(F.array(*results)).alias("__rule"))
    df = df.select(*[col(n) for n in ds.ids], F.col("__rule.ruleid"), *[col(c.name) for c in rest], F.col("__rule.bool_var"), F.col("__rule.errorcode"), F.col("__rule.errorlevel"))
    structure = Structure([*(ds.structure[n] for n in ds.ids), Component("ruleid", STRING, IDENTIFIER), *rest, Component("bool_var", BOOLEAN), Component("errorcode", code_type), Component("errorlevel", level_type)])
    out = Dataset(df, structure)
    if output in (None, "invalid"):
        out = Dataset(out.df.filter(~col("bool_var")), structure).select([c.name for c in structure if c.name != "bool_var"])
    return out


class Items:
    """Code items spread to columns: per group whether each is present, and its value."""

    def __init__(self, ds: Dataset, component: str, rules: list, conditions: list[Column | None], pos=None):
        if component not in ds.ids:
            raise InvalidArgument(f"{component} is not an identifier of the dataset", pos)
        if len(ds.measures) != 1 or ds.structure[ds.measures[0]].type not in NUMERIC:
            raise InvalidArgument(f"Dataset {', '.join(ds.structure.components)} is not monomeasure", pos)
        self.others = [n for n in ds.ids if n != component]
        self.measure, self.type = ds.measures[0], ds.structure[ds.measures[0]].type
        codes = dict.fromkeys(c for r in rules for c in involved(r))
        self.when = {id(r): i for i, (r, x) in enumerate(zip(rules, conditions, strict=True)) if x is not None}
        # an item of a conditional rule has columns of its own, next to those that all rows of the item fill
        wanted = [(c, None) for c in codes] + [(c, self.when[id(r)]) for r in rules if id(r) in self.when for c in involved(r)]
        self.place = {w: i for i, w in enumerate(dict.fromkeys(wanted))}
        rows = ds.df.filter(col(component).cast("string").isin(list(codes)))
        rows = rows.withColumns({f"__w{i}": F.coalesce(conditions[i], F.lit(False)) for i in self.when.values()}) if self.when else rows
        parts = [F.bool_or(F.col(f"__w{i}")).alias(f"__h{i}") for i in self.when.values()]
        for (c, i), n in self.place.items():
            own = col(component).cast("string") == F.lit(c)
            own = own if i is None else own & F.col(f"__w{i}")
            parts += [F.coalesce(F.bool_or(own), F.lit(False)).alias(f"__p{n}"), F.max(F.when(own, col(self.measure))).alias(f"__v{n}")]
        self.df = rows.groupBy(*[col(n) for n in self.others]).agg(*parts)

    def present(self, code: str, rule=None) -> Column:
        return F.col(f"__p{self.place[code, self.when.get(id(rule))]}")

    def value(self, code: str, rule=None) -> Column:
        return F.col(f"__v{self.place[code, self.when.get(id(rule))]}")

    def holds(self, rule) -> Column:
        """Whether some row of the group fulfils the rule's condition; only there the rule is evaluated."""
        return F.col(f"__h{self.when[id(rule)]}") if id(rule) in self.when else F.lit(True)


def involved(rule) -> list[str]:
    return list(dict.fromkeys([rule.left, *(c for _, c in rule.items)]))


def emitted(mode: str, items: list[tuple[Column, Column]]) -> Column:
    """Whether a rule is evaluated in a group, by the presence and values of its items."""
    every = lambda parts: reduce(lambda a, b: a & b, parts)
    some = lambda parts: reduce(lambda a, b: a | b, parts)
    if mode == "non_null":
        return every([p & v.isNotNull() for p, v in items])
    if mode == "non_zero":
        return some([p & (v.isNull() | (v != 0)) for p, v in items])
    if mode.startswith("partial"):
        return some([p & v.isNotNull() for p, v in items])
    return F.lit(True)


def filled(mode: str, present: Column, value: Column) -> Column:
    """A missing item counts as 0 in the zero modes; a present null stays null."""
    return F.when(present, value).otherwise(F.lit(0)) if mode in ("non_zero", "partial_zero", "always_zero") else value


def total(mode: str, parts: list[tuple[int, Column, Column]]) -> Column:
    signed = [filled(mode, p, v) * F.lit(s) for s, p, v in parts]
    return reduce(lambda a, b: a + b, signed)


COMPARE = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def check_hierarchy(ds: Dataset, ruleset, component: str, mode: str | None, output: str | None, pos=None, conditions: list[Column | None] | None = None, computed: bool = False) -> Dataset:
    """Each rule in each group of the other identifiers: one aggregation, then the rules exploded.

    A rule's condition holds for that rule alone.  With ``computed``, items that
    equality rules compute stand in for those that the dataset lacks.
    """
    mode = mode or "non_null"
    conditions = conditions or [None] * len(ruleset.rules)
    items = Items(ds, component, ruleset.rules, conditions, pos)
    code_type = constant_type([r.code for r in ruleset.rules], STRING, "error codes", pos)
    level_type = constant_type([r.level for r in ruleset.rules], INTEGER, "error levels", pos)
    kind = SPARK_TYPES[items.type]
    df, made = rolled(items, ruleset.rules, mode, "own")[:2] if computed else (items.df, {})
    results = []
    for label, rule in zip(labels(ruleset), ruleset.rules, strict=True):
        have = {c: (items.present(c, rule), items.value(c, rule)) for c in involved(rule)}
        for c in have.keys() & made.keys():
            # a row of the dataset comes before a computed item, even where it fails the condition
            own, use = have[c], made[c][0] & ~items.present(c)
            have[c] = (own[0] | use, F.when(use, made[c][1].cast(kind)).otherwise(own[1]))
        left = filled(mode, *have[rule.left])
        right = total(mode, [(s, *have[c]) for s, c in rule.items])
        held = COMPARE[rule.op](left, right)
        results.append(
            F.struct(
                (items.holds(rule) & emitted(mode, list(have.values()))).alias("emit"), F.lit(rule.left).alias("code"), F.lit(label).alias("ruleid"), left.cast(kind).alias("value"), held.alias("bool_var"), (left - right).cast(kind).alias("imbalance"),
                F.when(~held, typed(rule.code, code_type)).alias("errorcode"), F.when(~held, typed(rule.level, level_type)).alias("errorlevel"),
            )
        )
    df = df.select(*[col(n) for n in items.others], F.explode(F.array(*results)).alias("__rule")).filter("__rule.emit")
    shown = {"ruleid": "ruleid", component: "code", items.measure: "value", "bool_var": "bool_var", "imbalance": "imbalance", "errorcode": "errorcode", "errorlevel": "errorlevel"}
    made = [
        ds.structure[component], Component("ruleid", STRING, IDENTIFIER), Component(items.measure, items.type, MEASURE),
        Component("bool_var", BOOLEAN), Component("imbalance", items.type), Component("errorcode", code_type), Component("errorlevel", level_type),
    ]
    structure = Structure([*(ds.structure[n] for n in items.others), *made])
    code_kind = SPARK_TYPES[ds.structure[component].type]
    df = df.select(*[col(n) for n in items.others], *[(F.col(f"__rule.{shown[c.name]}").cast(code_kind) if c.name == component else F.col(f"__rule.{shown[c.name]}")).alias(c.name) for c in made])
    out = Dataset(df, structure)
    if output in (None, "invalid"):
        return Dataset(df.filter(~col("bool_var")), structure).select([c.name for c in structure if c.name != "bool_var"])
    if output == "all":
        return out.select([c.name for c in structure if c.name != items.measure])
    return out


def in_dependency_order(rules: list) -> list:
    """Rules so that a computed item comes before those that add it up; rules of one item keep their order."""
    made = {}
    for r in rules:
        made.setdefault(r.left, []).append(r)
    out, state = [], {}

    def visit(left: str) -> None:
        if state.get(left) == 2:
            return
        if state.get(left) == 1:
            raise InvalidArgument(f"hierarchical rules depend on each other at {left}")
        state[left] = 1
        for r in made[left]:
            for _, c in r.items:
                if c in made:
                    visit(c)
        state[left] = 2
        out.extend(made[left])

    for r in rules:
        visit(r.left)
    return out


def rolled(items: Items, rules: list, mode: str, source: str) -> tuple[DataFrame, dict[str, tuple[Column, Column]], list[Column]]:
    """The groups with all computed items: (computed, value) of each, and rows to explode.  Of several rules for an item, the first that is evaluated in a group makes it."""
    df, made, results = items.df, {}, []
    for i, rule in enumerate(in_dependency_order([r for r in rules if r.op == "="])):
        parts = []
        for s, c in rule.items:
            present, value = items.present(c, rule), items.value(c, rule)
            if c in made and source != "dataset":
                done, got = made[c]
                # a computed item comes first, unless it is null (rule_priority) or the dataset has its own (own)
                use = done & ~items.present(c) if source == "own" else done if source == "rule" else done & got.isNotNull()
                present, value = done | present, F.when(use, got).otherwise(value)
            parts.append((s, present, value))
        first = ~made[rule.left][0] if rule.left in made else F.lit(True)
        emit = items.holds(rule) & first & emitted(mode, [(p, v) for _, p, v in parts])
        df = df.withColumns({f"__e{i}": emit, f"__c{i}": F.when(emit, total(mode, parts))})
        done, got = F.col(f"__e{i}"), F.col(f"__c{i}")
        results.append(F.struct(done.alias("emit"), F.lit(rule.left).alias("code"), got.cast(SPARK_TYPES[items.type]).alias("value")))
        if rule.left in made:
            done, got = done | made[rule.left][0], F.when(done, got).otherwise(made[rule.left][1])
        made[rule.left] = (done, got)
    return df, made, results


def hierarchy(ds: Dataset, ruleset, component: str, mode: str | None, source: str | None, output: str | None, pos=None, conditions: list[Column | None] | None = None) -> Dataset:
    """Computed items of the equality rules; ``all`` puts them over the dataset's own rows."""
    mode, source = mode or "non_null", source or "rule"
    conditions = conditions or [None] * len(ruleset.rules)
    pairs = [(r, x) for r, x in zip(ruleset.rules, conditions, strict=True) if r.op == "="]
    rules = [r for r, _ in pairs]
    items = Items(ds, component, rules, [x for _, x in pairs], pos)
    df, _, results = rolled(items, rules, mode, source)
    df = df.select(*[col(n) for n in items.others], F.explode(F.array(*results)).alias("__rule")).filter("__rule.emit")
    structure = Structure([*(ds.structure[n] for n in ds.ids), ds.structure[items.measure]])
    code_kind = SPARK_TYPES[ds.structure[component].type]
    df = df.select(*[F.col("__rule.code").cast(code_kind).alias(component) if n == component else col(n) for n in ds.ids], F.col("__rule.value").alias(items.measure))
    computed = Dataset(df, structure)
    if output == "all":
        from .sets import union

        return union([computed, ds.select([*ds.ids, items.measure])], pos)
    return computed
