"""Sessions: bind inputs, run scripts, read results."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from .errors import FunctionNotFound, InvalidArgument, InvalidType
from .functions.scalar import constant, signature
from .model import NULL, SPARK_TYPES, Dataset, Scalar, wrap
from .plans import nodes as N
from .plans import order
from .plans.evaluate import Evaluator
from .plans.parser import parse


class Session:
    """A namespace of inputs and outputs over a SparkSession.

    ``median="discrete"`` gives the lower median instead of the interpolated one.
    """

    def __init__(self, spark: SparkSession, median: str = "exact"):
        self.spark, self.median = spark, median
        self.inputs: dict[str, object] = {}
        self.outputs: dict[str, object] = {}
        self.functions: dict[str, tuple[Callable, tuple[str, ...], str]] = {}
        self.dataset_functions: dict[str, Callable] = {}
        self.routines: dict[str, Callable] = {}
        self.domains: dict[str, list] = {}
        self.now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)

    # ---- inputs

    def bind(self, name: str, df: DataFrame | Dataset, ids=None, attributes=None, roles=None, value_domains=None) -> Dataset:
        ds = df if isinstance(df, Dataset) else wrap(df, ids, attributes, roles, value_domains)
        self.inputs[name] = ds
        return ds

    def bind_scalar(self, name: str, value, kind: str | None = None) -> Scalar:
        self.inputs[name] = constant(value, kind)
        return self.inputs[name]

    def value_domain(self, name: str, values: list) -> None:
        """A code list for ``in``."""
        self.domains[name] = list(values)

    def register(self, name: str, fn: Callable, args: list[str], returns: str) -> None:
        """A scalar function. ``fn`` builds a Column from Columns, or is a pandas UDF."""
        self.functions[name] = (fn, tuple(args), returns)

    def register_dataset_fn(self, name: str, fn: Callable) -> None:
        """A function of whole datasets; it gets Datasets and Python values and gives a Dataset, DataFrame or value."""
        self.dataset_functions[name] = fn

    def register_routine(self, name: str, fn: Callable) -> None:
        """An external routine for ``eval``."""
        self.routines[name] = fn

    def use(self, provider: dict[str, tuple]) -> None:
        """Register many scalar functions: name to (fn, args, returns)."""
        for name, spec in provider.items():
            self.register(name, *spec)

    # ---- calls from scripts

    def as_dataset(self, value):
        if isinstance(value, DataFrame):
            return wrap(value)
        return value if isinstance(value, (Dataset, Scalar)) else constant(value)

    def call_function(self, name: str, args: list[Scalar], pos) -> Scalar:
        fn, kinds, returns = self.functions[name]
        fits = len(args) == len(kinds) and all(a.type in (k, NULL) or (a.type, k) == ("integer", "number") for a, k in zip(args, kinds, strict=True))
        if not fits:
            raise FunctionNotFound(signature(name, args), pos)
        out: Column = fn(*[a.as_type(k) for a, k in zip(args, kinds, strict=True)])
        return Scalar(out.cast(SPARK_TYPES[returns]), returns)

    def call_dataset_function(self, name: str, args: list, pos):
        given = [a.literal if isinstance(a, Scalar) else a for a in args]
        return self.as_dataset(self.dataset_functions[name](*given))

    # ---- scripts

    def statements(self, script: str, reorder: bool = True) -> list[N.Statement]:
        found = parse(script)
        order.check_single_assignment(found, set(self.inputs) | set(self.outputs))
        return order.in_order(found) if reorder else found

    def run(self, script: str, reorder: bool = True, persist: bool = False) -> dict[str, object]:
        """Evaluate a script; returns its outputs. With ``persist``, results that two statements read are cached."""
        statements = self.statements(script, reorder)
        readers = order.fan_out(statements) if persist else {}
        bound = {**self.inputs, **self.outputs}
        made: dict[str, object] = {}
        for s in statements:
            if not isinstance(s, N.Assign):
                value: object = s
            else:
                value = Evaluator(self, bound).eval(s.expr)
                if s.persistent:
                    if not isinstance(value, Dataset):
                        raise InvalidType(value.type if isinstance(value, Scalar) else type(value).__name__, "Dataset", s.pos)
                    value = Dataset(value.df, value.structure, True)
                if value is None:
                    raise InvalidArgument(f"{s.name} has no value", s.pos)
                if readers.get(s.name, 0) > 1 and isinstance(value, Dataset):
                    value = Dataset(value.df.persist(), value.structure, value.persistent)
            bound[s.name] = value
            made[s.name] = value
        self.outputs.update(made)
        return made

    def value(self, result: Scalar):
        """The Python value of a scalar result."""
        if result.literal is not None:
            return result.literal
        return self.spark.range(1).select(result.column.alias("x")).first()["x"]

    def reset(self) -> None:
        """Forget outputs, so that a script can run again."""
        self.outputs.clear()

    def explain(self, script: str) -> str:
        """Statements in order of evaluation, with the physical plan of every dataset."""
        trial = Session(self.spark, self.median)
        trial.__dict__.update({k: (dict(v) if isinstance(v, dict) else v) for k, v in self.__dict__.items()})
        trial.outputs = {}
        parts = []
        for name, value in trial.run(script).items():
            if isinstance(value, Dataset):
                plan = value.df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
                parts.append(f"== {name}: {value.structure}\n{plan}")
            else:
                parts.append(f"== {name}: {type(value).__name__}")
        return "\n".join(parts)

    def provenance(self, script: str, name: str = "program"):
        from .provenance import trace

        return trace(name, script, self)


