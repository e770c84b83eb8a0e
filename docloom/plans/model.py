"""The query description: what a caller asks for, before any DataFrame exists."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

EQ, NE, LT, LE, GT, GE = "==", "!=", "<", "<=", ">", ">="
IN, NOT_IN, CONTAINS, CONTAINS_ANY = "in", "not-in", "array-contains", "array-contains-any"
HAS_ANCESTOR = "has-ancestor"
IS_NULL, IS_NOT_NULL, IS_NAN, IS_NOT_NAN = "is-null", "is-not-null", "is-nan", "is-not-nan"
INEQUALITIES = frozenset((LT, LE, GT, GE, NE, NOT_IN))
NAME = "__name__"
KEY = "__key__"
DOCUMENT, ENTITY = "document", "entity"


@dataclass(frozen=True)
class Where:
    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


def all_of(*parts) -> And:
    return And(tuple(parts))


def any_of(*parts) -> Or:
    return Or(tuple(parts))


@dataclass(frozen=True)
class Order:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class Cursor:
    """Values for a leading part of the order; ``before``: the position just before them, else just behind."""

    values: tuple
    before: bool


@dataclass(frozen=True)
class Selector:
    collection: str = ""
    descendants: bool = False


@dataclass(frozen=True)
class Nearest:
    field: str
    query: tuple[float, ...]
    measure: str  # euclidean, cosine or dot
    limit: int
    result_field: str | None = None
    threshold: float | None = None


@dataclass(frozen=True)
class Query:
    selectors: tuple[Selector, ...] = ()
    parent: str = ""
    where: Any = None
    order: tuple[Order, ...] = ()
    start: Cursor | None = None
    end: Cursor | None = None
    limit: int | None = None
    offset: int = 0
    select: tuple[str, ...] | None = None
    distinct_on: tuple[str, ...] = ()
    nearest: Nearest | None = None
    flavour: str = DOCUMENT
    read_time: Any = None


@dataclass(frozen=True)
class Count:
    alias: str | None = None
    up_to: int | None = None


@dataclass(frozen=True)
class Sum:
    field: str
    alias: str | None = None


@dataclass(frozen=True)
class Avg:
    field: str
    alias: str | None = None


@dataclass
class Plan:
    """An analysed query: the effective order, and fields that must exist."""

    query: Query
    order: list[Order] = field(default_factory=list)
    required: list[str] = field(default_factory=list)
