"""Syntax trees to datasets and typed columns. Structures are known at once; rows stay lazy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import InvalidArgument, InvalidType, NotImplementedFunction, UndefinedVariable, VtlError
from ..functions import casts, scalar, temporal
from ..functions.scalar import SHOWN, constant
from ..model import BOOLEAN, DATE, Dataset, Scalar, col
from ..operators import aggregate, analytic, clauses, joins, sets, timeseries, validation
from ..operators.lifting import lift
from . import nodes as N

SET_OPERATORS = {"union", "intersect", "setdiff", "symdiff"}
TIME_OPERATORS = {"flow_to_stock": timeseries.flow_to_stock, "stock_to_flow": timeseries.stock_to_flow}


class Scope:
    """What names mean inside a clause: components, and the names that stand for them."""

    def __init__(self, ds: Dataset, names: dict[str, str] | None = None, aggregating: bool = False, owners: dict[str, Dataset] | None = None):
        self.ds, self.names, self.aggregating, self.owners = ds, names or {}, aggregating, owners or {}

    def get(self, name: str) -> Scalar | None:
        name = self.names.get(name, name)
        if name in self.ds.structure:
            return Scalar(col(name), self.ds.structure[name].type)
        return None


class Evaluator:
    def __init__(self, session, bound: dict[str, object]):
        self.session, self.bound = session, bound

    # ---- dispatch

    def eval(self, node: N.Node, scope: Scope | None = None):
        try:
            return getattr(self, "_" + type(node).__name__.lower())(node, scope)
        except VtlError as e:
            e.pos = e.pos or node.pos
            raise

    def dataset(self, node: N.Node, scope: Scope | None = None) -> Dataset:
        value = self.eval(node, scope)
        if not isinstance(value, Dataset):
            raise InvalidType(SHOWN.get(getattr(value, "type", ""), type(value).__name__), "Dataset", node.pos)
        return value

    def scalar(self, node: N.Node, scope: Scope | None = None) -> Scalar:
        value = self.eval(node, scope)
        if not isinstance(value, Scalar):
            raise InvalidType("Dataset", "Scalar", node.pos)
        return value

    def lifted(self, operands: list, build, pos, free: tuple[int, ...] = ()):
        if any(isinstance(x, Dataset) for x in operands):
            return lift(operands, build, pos, free)
        return build(operands)

    # ---- leaves

    def _constant(self, node: N.Constant, scope):
        return constant(node.value, node.type)

    def _variable(self, node: N.Variable, scope: Scope | None):
        if scope:
            found = scope.get(node.name)
            if found is not None:
                return found
        if node.name in self.bound:
            value = self.bound[node.name]
            if scope and isinstance(value, Dataset) and not scope.owners:
                raise UndefinedVariable(node.name, node.pos)
            return value
        raise UndefinedVariable(node.name, node.pos)

    def _omitted(self, node, scope):
        return None

    def _setof(self, node: N.SetOf, scope) -> list[Scalar]:
        items = [self.scalar(x, scope) for x in node.items]
        scalar.common([i.type for i in items], node.pos)
        return items

    # ---- expressions

    def _unary(self, node: N.Unary, scope):
        name = node.op if node.op == "not" else f"unary {node.op}"
        return self.lifted([self.eval(node.operand, scope)], lambda a: scalar.apply(name, a, node.pos), node.pos)

    def _binary(self, node: N.Binary, scope):
        left = self.eval(node.left, scope)
        if node.op in ("in", "not_in"):
            items = self._domain(node.right.name, node.pos) if isinstance(node.right, N.Variable) else self._setof(node.right, scope)
            return self.lifted([left], lambda a: scalar.within(a[0], items, node.op == "not_in", node.pos), node.pos)
        right = self.eval(node.right, scope)
        for x in (left, right):
            if not isinstance(x, (Dataset, Scalar)):
                raise InvalidArgument(f"operand of {node.op} has no value", node.pos)

        def build(args: list[Scalar]) -> Scalar:
            if node.op in scalar.COMPARE:
                return scalar.compare(node.op, *args, pos=node.pos)
            return temporal.temporal_binary(node.op, *args) or scalar.apply(node.op, args, node.pos)

        return self.lifted([left, right], build, node.pos)

    def _domain(self, name: str, pos) -> list[Scalar]:
        if name not in self.session.domains:
            raise UndefinedVariable(name, pos)
        return [constant(v) for v in self.session.domains[name]]

    def _if(self, node: N.If, scope):
        parts = [self.eval(x, scope) for x in (node.condition, node.then, node.otherwise)]
        return self.lifted(parts, lambda a: scalar.choose(*a, pos=node.pos), node.pos, free=(0,))

    def _case(self, node: N.Case, scope):
        flat = [self.eval(x, scope) for b in node.branches for x in b] + [self.eval(node.otherwise, scope)]
        n = len(node.branches)
        return self.lifted(flat, lambda a: scalar.case([(a[2 * i], a[2 * i + 1]) for i in range(n)], a[-1], node.pos), node.pos, free=tuple(range(0, 2 * n, 2)))

    def _cast(self, node: N.Cast, scope):
        return self.lifted([self.eval(node.operand, scope)], lambda a: casts.cast(a[0], node.type, node.mask, node.pos), node.pos)

    def _membership(self, node: N.Membership, scope: Scope | None):
        if scope and isinstance(node.operand, N.Variable):
            whole = scope.get(f"{node.operand.name}#{node.component}")
            if whole is not None:
                return whole
            owner = scope.owners.get(node.operand.name)
            if owner is not None and node.component in owner.structure:
                found = scope.get(node.component)
                if found is not None:
                    return found
            if scope.owners or node.operand.name not in self.bound:
                raise UndefinedVariable(f"{node.operand.name}#{node.component}", node.pos)
        return clauses.membership(self.dataset(node.operand, scope), node.component, node.pos)

    # ---- clauses

    def _clause(self, node: N.Clause, scope):
        return self.clause(self.dataset(node.operand, scope), node.kind, node.body, node.pos)

    def clause(self, ds: Dataset, kind: str, body, pos, owners: dict[str, Dataset] | None = None) -> Dataset:
        inside = Scope(ds, owners=owners)
        if owners:
            body = self.resolved(ds, kind, body)
        if kind == "filter":
            return clauses.filter_rows(ds, self.scalar(body, inside), pos)
        if kind == "calc":
            return clauses.calc(ds, [(i.role, i.name, self.scalar(i.expr, inside)) for i in body], pos)
        if kind in ("keep", "drop"):
            return (clauses.keep if kind == "keep" else clauses.drop)(ds, body, pos)
        if kind == "rename":
            return clauses.rename(ds, body, pos)
        if kind == "sub":
            return clauses.subspace(ds, [(n, self.scalar(x, None)) for n, x in body], pos)
        if kind == "unpivot":
            return clauses.unpivot(ds, body[0], body[1], pos)
        if kind in ("pivot", "customPivot"):
            return clauses.pivot(ds, *body, pos)
        if kind == "aggr":
            return self.aggr(ds, body, pos, owners)
        if kind == "apply":
            if not owners:
                raise InvalidArgument("apply is a clause of joins", pos)
            return Evaluator(self.session, {**self.bound, **owners}).dataset(body)
        raise NotImplementedFunction(kind, pos)

    @staticmethod
    def resolved(ds: Dataset, kind: str, body):
        """In a join body ``alias#name`` may stand for a component that is not shared."""
        def one(n: str) -> str:
            return n if n in ds.structure or "#" not in n else n.rpartition("#")[2]

        if kind in ("keep", "drop"):
            return tuple(one(n) for n in body)
        if kind == "rename":
            return tuple((one(a), b) for a, b in body)
        return body

    def aggr(self, ds: Dataset, body: N.Aggregation, pos, owners=None) -> Dataset:
        ds, names = aggregate.grouped(ds, body.grouping, lambda k: self.scalar(self.time_key(k), Scope(ds)), pos)
        inside = Scope(ds, aggregating=True, owners=owners)
        items = [(i.role, i.name, self.scalar(i.expr, inside)) for i in body.items]
        having = self.scalar(body.having, inside) if body.having is not None else None
        return aggregate.run(ds, names, items, having, pos)

    @staticmethod
    def time_key(key: N.Node) -> N.Node:
        if isinstance(key, N.Call) and key.name == "time_agg":
            return N.Call(key.pos, "time_agg scalar", tuple(a for a in key.args if not isinstance(a, N.Omitted)))
        return key

    def _join(self, node: N.Join, scope):
        operands = []
        for x, alias in node.operands:
            if alias is None and not isinstance(x, N.Variable):
                raise InvalidArgument("cannot use expressions without alias in join clause", x.pos)
            operands.append((alias or x.name, self.dataset(x), alias is not None))
        out = joins.join(node.kind, operands, node.using, node.pos)
        owners = {alias: ds for alias, ds, _ in operands}
        for kind, body in node.body:
            out = self.clause(out, kind, body, node.pos, owners)
        return out if node.kind == "cross_join" and not node.body else joins.settle(out)

    # ---- calls

    def _call(self, node: N.Call, scope: Scope | None):
        name, opts = node.name, node.options
        discrete = self.session.median == "discrete"
        if name in self.bound and isinstance(self.bound[name], N.Operator):
            return self.operator(self.bound[name], node, scope)
        if "over" in opts:
            if name not in analytic.NAMES:
                raise NotImplementedFunction(name, node.pos)
            args = [self.eval(a, scope) for a in node.args]
            if args and isinstance(args[0], Dataset):
                return analytic.over_dataset(name, args[0], args[1:], opts["over"], node.pos, discrete)
            if scope is None:
                raise InvalidArgument(f"{name} over a window needs a dataset", node.pos)
            return analytic.analytic(name, args, opts["over"], scope.ds.structure, node.pos, discrete)
        if scope and scope.aggregating and name in aggregate.NAMES:
            inner = Scope(scope.ds, scope.names, owners=scope.owners)
            operand = self.scalar(node.args[0], inner) if node.args else None
            return aggregate.aggregate(name, operand, node.pos, discrete)
        if name in aggregate.NAMES and scope is None:
            ds = self.dataset(node.args[0])
            ds, names = aggregate.grouped(ds, opts.get("grouping"), lambda k: self.scalar(self.time_key(k), Scope(ds)), node.pos)
            having = self.scalar(opts["having"], Scope(ds, aggregating=True)) if "having" in opts else None
            return aggregate.over_dataset(name, ds, names, having, node.pos, discrete)
        special = getattr(self, "_do_" + name, None)
        if special:
            return special(node, scope)
        if name in SET_OPERATORS:
            return self.set_operator(name, [self.dataset(a) for a in node.args], node.pos)
        if name in TIME_OPERATORS:
            return TIME_OPERATORS[name](self.dataset(node.args[0]), node.pos)
        if name in self.session.dataset_functions:
            args = [self.eval(a, scope) for a in node.args]
            return self.session.call_dataset_function(name, args, node.pos)
        args = [self.eval(a, scope) for a in node.args]
        while args and args[-1] is None:
            args.pop()
        if name in self.session.functions:
            return self.lifted(args, lambda a: self.session.call_function(name, a, node.pos), node.pos)
        if name not in scalar.REGISTRY:
            raise NotImplementedFunction(name, node.pos)
        places = [i for i, a in enumerate(args) if a is not None]

        def build(given: list[Scalar]) -> Scalar:
            full: list[Scalar | None] = [None] * len(args)
            for i, a in zip(places, given, strict=True):
                full[i] = a
            return scalar.apply(name, full, node.pos)

        return self.lifted([args[i] for i in places], build, node.pos)

    def operator(self, definition: N.Operator, node: N.Call, scope):
        names = {}
        if len(node.args) > len(definition.parameters):
            raise InvalidArgument(f"{definition.name} takes {len(definition.parameters)} arguments", node.pos)
        for i, (name, kind, default) in enumerate(definition.parameters):
            given = node.args[i] if i < len(node.args) else None
            value = self.eval(given, scope) if given is not None else None
            if value is None:
                if default is None:
                    raise InvalidArgument(f"{definition.name} needs {name}", node.pos)
                value = self.eval(default)
            if kind == "dataset" and not isinstance(value, Dataset) or kind in SHOWN and (not isinstance(value, (Dataset, Scalar)) or isinstance(value, Scalar) and value.type not in (kind, "null") and {kind, value.type} != {"integer", "number"}):
                raise InvalidType(SHOWN.get(getattr(value, "type", ""), "Dataset"), SHOWN.get(kind, "Dataset"), node.pos)
            names[name] = value
        rest = {k: v for k, v in self.bound.items() if k != definition.name}
        return Evaluator(self.session, {**rest, **names}).eval(definition.body)

    @staticmethod
    def set_operator(name: str, datasets: list[Dataset], pos) -> Dataset:
        if name in ("union", "intersect"):
            return getattr(sets, name)(datasets, pos)
        if len(datasets) != 2:
            raise InvalidArgument(f"{name} takes two datasets", pos)
        return getattr(sets, name)(*datasets, pos)

    def literal(self, node: N.Node):
        value = self.scalar(node)
        if value.literal is None:
            raise InvalidArgument("a constant is needed here", node.pos)
        return value.literal

    def _do_exists_in(self, node: N.Call, scope):
        retain = "all"
        rest = list(node.args[2:])
        if rest and isinstance(rest[0], N.Constant):
            retain = "true" if rest[0].value is True else "false" if rest[0].value is False else str(rest[0].value)
        return sets.exists_in(self.dataset(node.args[0]), self.dataset(node.args[1]), node.options.get("output", retain), node.pos)

    def _do_current_date(self, node, scope):
        return Scalar(F.lit(self.session.now.isoformat()).cast("timestamp_ntz"), DATE, self.session.now)

    def _do_timeshift(self, node: N.Call, scope):
        first = self.eval(node.args[0], scope)
        if isinstance(first, Dataset):
            return timeseries.timeshift(first, int(self.literal(node.args[1])), node.pos)
        return scalar.apply("timeshift", [first, self.scalar(node.args[1], scope)], node.pos)

    def _do_fill_time_series(self, node: N.Call, scope):
        return timeseries.fill_time_series(self.dataset(node.args[0]), node.options.get("output"), node.pos)

    def _do_period_indicator(self, node: N.Call, scope):
        first = self.eval(node.args[0], scope)
        return timeseries.period_indicator(first, node.pos) if isinstance(first, Dataset) else scalar.apply("period_indicator", [first], node.pos)

    def _do_time_agg(self, node: N.Call, scope):
        args = [self.eval(a, scope) for a in node.args]
        rest = [a for a in args[1:] if a is not None and not (isinstance(a, Scalar) and isinstance(a.literal, str))]
        if rest and isinstance(rest[0], Dataset):
            return timeseries.time_agg(rest[0], args[0].literal, node.pos)
        return scalar.apply("time_agg scalar", [args[0], *rest], node.pos)

    def _do_check(self, node: N.Call, scope):
        o = node.options
        imbalance = self.dataset(o["imbalance"]) if "imbalance" in o else None
        return validation.check(self.dataset(node.args[0]), o.get("code"), o.get("level"), imbalance, o.get("output"), node.pos)

    def ruleset(self, node: N.Node, kind):
        if not isinstance(node, N.Variable) or node.name not in self.bound:
            raise UndefinedVariable(getattr(node, "name", "ruleset"), node.pos)
        value = self.bound[node.name]
        if not isinstance(value, kind):
            raise InvalidType(type(value).__name__, kind.__name__, node.pos)
        return value

    def _do_check_datapoint(self, node: N.Call, scope):
        ds, rules = self.dataset(node.args[0]), self.ruleset(node.args[1], N.DatapointRuleset)
        evaluate = lambda x, names: self.scalar(x, Scope(ds, names))
        return validation.check_datapoint(ds, rules, evaluate, node.options.get("components", ()), node.options.get("output"), node.pos)

    def hierarchical(self, node: N.Call) -> tuple[Dataset, N.HierarchicalRuleset, str, list]:
        """The dataset, the ruleset, the code component and each rule's condition over the dataset's rows."""
        ds, rules = self.dataset(node.args[0]), self.ruleset(node.args[1], N.HierarchicalRuleset)
        component = node.options.get("rule") or rules.component
        names = dict((alias, name) for (name, alias) in rules.conditions)
        conditions = [None if r.condition is None else self.scalar(r.condition, Scope(ds, names)).as_type(BOOLEAN) for r in rules.rules]
        return ds, rules, component, conditions

    def _do_check_hierarchy(self, node: N.Call, scope):
        ds, rules, component, conditions = self.hierarchical(node)
        o = node.options
        return validation.check_hierarchy(ds, rules, component, o.get("mode"), o.get("output"), node.pos, conditions, o.get("input") == "dataset_priority")

    def _do_hierarchy(self, node: N.Call, scope):
        ds, rules, component, conditions = self.hierarchical(node)
        o = node.options
        return validation.hierarchy(ds, rules, component, o.get("mode"), o.get("input"), o.get("output"), node.pos, conditions)

    def _do_eval(self, node: N.Call, scope):
        inner = node.args[0]
        if not isinstance(inner, N.Call) or inner.name not in self.session.routines:
            raise NotImplementedFunction("eval", node.pos)
        value = self.session.routines[inner.name](*[self.eval(a, scope) for a in inner.args])
        return value if isinstance(value, (Dataset, Scalar)) else self.session.as_dataset(value)


