"""Operator registry, signatures as blueprints, and plans as graphs of operators."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Operator:
    name: str
    run: Callable
    inputs: tuple[str, ...]


REGISTRY: dict[str, Operator] = {}


def register(f: Callable, name: str | None = None) -> Callable:
    """Register a function; parameters annotated DataFrame are its inputs."""
    inputs = tuple(p for p, x in inspect.signature(f).parameters.items() if str(x.annotation) in ("DataFrame", "<class 'pyspark.sql.dataframe.DataFrame'>"))
    REGISTRY[name or f"{f.__module__.rsplit('.', 1)[-1]}.{f.__name__}"] = Operator(name or f.__name__, f, inputs)
    return f


def load() -> dict[str, Operator]:
    """Register every public function of the operator modules that takes and gives tables."""
    from weftline.operators import aggregate, connect, convert, documents, filters, graph, hosts, order, page_sections, prompts, providers, records, segment, special, vectors, versioned

    for m in (aggregate, connect, convert, documents, filters, graph, hosts, order, page_sections, prompts, providers, records, segment, special, vectors, versioned):
        for n, f in vars(m).items():
            if inspect.isfunction(f) and f.__module__ == m.__name__ and not n.startswith("_"):
                register(f)
    return REGISTRY


def blueprint(op: Operator) -> dict[str, object]:
    """Required and optional parameters, inputs and result, by reflection."""
    sig = inspect.signature(op.run)
    rest = [p for p in sig.parameters.values() if p.name not in op.inputs]
    return {
        "inputs": list(op.inputs),
        "required": {p.name: str(p.annotation) for p in rest if p.default is p.empty},
        "optional": {p.name: {"type": str(p.annotation), "default": p.default} for p in rest if p.default is not p.empty},
        "output": str(sig.return_annotation),
        "multiple": "dict" in str(sig.return_annotation) or "Iterator" in str(sig.return_annotation),
        "doc": inspect.getdoc(op.run) or "",
    }


@dataclass
class Step:
    operator: str
    parameters: dict = field(default_factory=dict)
    inputs: dict[str, str] = field(default_factory=dict)


@dataclass
class Plan:
    """Steps by name. Inputs name tables or other steps; ``outputs`` are the steps whose tables come back."""

    steps: dict[str, Step]
    outputs: list[str]

    @staticmethod
    def of(spec: dict) -> Plan:
        return Plan({n: Step(s["operator"], s.get("parameters", {}), s.get("inputs", {})) for n, s in spec["steps"].items()}, list(spec["outputs"]))

    def order(self) -> list[str]:
        done: list[str] = []
        trail: list[str] = []

        def visit(n: str) -> None:
            if n in trail:
                raise ValueError(f"the plan has a cycle through {n}")
            if n in self.steps and n not in done:
                trail.append(n)
                for i in self.steps[n].inputs.values():
                    visit(i)
                trail.pop()
                done.append(n)

        for n in self.steps:
            visit(n)
        return done

    def compile(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """One lazy graph; nothing runs until an output is used."""
        made = dict(tables)
        for n in self.order():
            s = self.steps[n]
            op = REGISTRY[s.operator]
            if missing := [i for i in op.inputs if i not in s.inputs and inspect.signature(op.run).parameters[i].default is inspect.Parameter.empty]:
                raise ValueError(f"step {n} lacks the inputs {missing}")
            made[n] = op.run(**{i: made[t] for i, t in s.inputs.items()}, **s.parameters)
        return {n: made[n] for n in self.outputs}


def fan_out(df: DataFrame, key: str, items: str, name: str) -> DataFrame:
    """Open a scope: a row per item, with the key and the item's place."""
    return df.select("*", F.posexplode(items).alias("scope_pos", name)).drop(items)


def fan_in(df: DataFrame, key: str, item: str, name: str) -> DataFrame:
    """Close it: the items of a key as a list, in their places."""
    rows = F.array_sort(F.collect_list(F.struct("scope_pos", item)))
    return df.groupBy(key).agg(F.transform(rows, lambda r: r[item]).alias(name))


class Conversions:
    """Type conversions closed under composition; each path is composed from its own steps."""

    def __init__(self) -> None:
        self.direct: dict[tuple[str, str], Callable] = {}

    def add(self, source: str, target: str, f: Callable) -> None:
        self.direct[source, target] = f

    def path(self, source: str, target: str) -> list[Callable]:
        trails, seen = [(source, [])], {source}
        while trails:
            at, steps = trails.pop(0)
            if at == target:
                return steps
            for (a, b), f in self.direct.items():
                if a == at and b not in seen:
                    seen.add(b)
                    trails.append((b, [*steps, f]))
        raise KeyError(f"{source} does not convert to {target}")

    def convert(self, value: object, source: str, target: str) -> object:
        for f in self.path(source, target):
            value = f(value)
        return value
