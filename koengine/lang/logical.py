"""The logical plan: a short pipeline of operators that the builder turns into one DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Union

Literal = Union[None, bool, int, float, str]


@dataclass(frozen=True)
class Compare:
    prop: str
    op: str  # == != > < >= <=
    value: Literal


@dataclass(frozen=True)
class Both:
    left: "Predicate"
    right: "Predicate"


@dataclass(frozen=True)
class Either:
    left: "Predicate"
    right: "Predicate"


Predicate = Union[Compare, Both, Either]


@dataclass(frozen=True)
class Scan:
    type_name: str


@dataclass(frozen=True)
class Filter:
    predicate: Predicate


@dataclass(frozen=True)
class VectorSearch:
    vector: tuple[float, ...] | None
    text: str | None = None
    model: str | None = None
    k: int = 10


@dataclass(frozen=True)
class TextSearch:
    text: str
    k: int = 10
    scoring: str = "jaccard"  # or bm25


@dataclass(frozen=True)
class Fuse:
    how: str = "rrf"  # rrf, weighted, vector_only, text_only
    k0: int = 60
    rank_base: int = 1
    weight_vector: float = 0.5
    weight_text: float = 0.5


@dataclass(frozen=True)
class Traverse:
    rel_type: str | None
    depth: int = 1
    direction: str = "out"
    seeds: tuple[str, ...] = ()


@dataclass(frozen=True)
class Project:
    fields: tuple[str, ...]  # empty: all


@dataclass(frozen=True)
class Plan:
    operators: tuple[Any, ...]
    explain: bool = False
    limit: int | None = None


@dataclass(frozen=True)
class Write:
    """CREATE, UPDATE or DELETE."""

    action: str
    type_name: str
    values: dict[str, Literal] = field(default_factory=dict)
    predicate: Predicate | None = None


def check(plan: Plan) -> Plan:
    """The plan, if its shape is one that can be built."""
    from koengine.lang.diagnostics import InvalidPlan

    ops = plan.operators
    if not ops:
        raise InvalidPlan("the plan is empty")
    if not isinstance(ops[0], (Scan, Traverse)):
        raise InvalidPlan("a plan begins with a scan or a traversal from seeds")
    if isinstance(ops[0], Traverse) and not ops[0].seeds:
        raise InvalidPlan("a traversal without a scan needs seeds")
    if sum(isinstance(o, Scan) for o in ops) > 1:
        raise InvalidPlan("one scan only")
    for i, o in enumerate(ops):
        if isinstance(o, Fuse) and not any(isinstance(p, (VectorSearch, TextSearch)) for p in ops[:i]):
            raise InvalidPlan("fusion needs a search before it")
        if isinstance(o, (VectorSearch, TextSearch)) and o.k < 1:
            raise InvalidPlan("k is at least 1")
        if isinstance(o, Traverse) and o.depth < 1:
            raise InvalidPlan("depth is at least 1")
    return plan
