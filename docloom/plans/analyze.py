"""Rules applied to a query before a DataFrame is built: order, existence, validation."""

from __future__ import annotations

from ..errors import InvalidArgument
from .model import ENTITY, HAS_ANCESTOR, INEQUALITIES, KEY, NAME, And, Avg, Or, Order, Plan, Query, Sum, Where


def leaves(where) -> list[Where]:
    if where is None:
        return []
    return [where] if isinstance(where, Where) else [x for p in where.parts for x in leaves(p)]


def name_of(q: Query) -> str:
    return KEY if q.flavour == ENTITY else NAME


def effective_order(q: Query) -> list[Order]:
    """Explicit keys; then fields under inequalities by name, in the direction of the last explicit key; then the name."""
    order, own = list(q.order), name_of(q)
    have = {o.field for o in order}
    if own in have or q.nearest:
        return order
    down = order[-1].descending if order else False
    if q.flavour != ENTITY:
        extra = sorted({w.field for w in leaves(q.where) if w.op in INEQUALITIES and w.field not in have and w.field != own})
        order += [Order(f, down) for f in extra]
    return [*order, Order(own, down)]


def analyze(q: Query) -> Plan:
    own = name_of(q)
    for w in leaves(q.where):
        if w.op in ("in", "not-in", "array-contains-any") and not isinstance(w.value, (list, tuple)):
            raise InvalidArgument(f"{w.op} needs a list")
        if w.op == HAS_ANCESTOR and (q.flavour != ENTITY or w.field != own):
            raise InvalidArgument("has-ancestor is for the key of entities")
    if isinstance(q.where, (And, Or)) and not q.where.parts:
        raise InvalidArgument("an empty composite filter")
    for c in (q.start, q.end):
        if c is not None and len(c.values) > len(effective_order(q)):
            raise InvalidArgument("a cursor has more values than the order has keys")
    if q.offset < 0:
        raise InvalidArgument("a negative offset")
    return Plan(q, effective_order(q), [o.field for o in q.order if o.field != own])


def required_for(aggregations) -> list[str]:
    """Fields of sums and averages must exist for a document to count in any aggregate of the request."""
    out = []
    for a in aggregations:
        if isinstance(a, (Sum, Avg)):
            if a.field in (KEY, NAME):
                raise InvalidArgument("no sum or average over keys")
            if a.field not in out:
                out.append(a.field)
    return out
