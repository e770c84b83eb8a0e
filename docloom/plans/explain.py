"""Explain: the index a query would use, Spark's plan, and figures of a run."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .analyze import analyze, leaves, required_for
from .model import HAS_ANCESTOR, KEY, NAME, Query


def summary(q: Query, aggregations=None) -> dict:
    """Index descriptor from the effective order, without reading anything.

    The index of an aggregation also holds the fields of its sums and averages.
    """
    plan = analyze(q)
    scope = "Collection group" if any(s.descendants for s in q.selectors) else "Collection"
    order = [(o.field, "DESC" if o.descending else "ASC") for o in plan.order]
    extra = [f for f in required_for(aggregations or []) if f not in {n for n, _ in order}]
    order = [*order[:-1], *((f, "ASC") for f in extra), *order[-1:]]
    ancestor = bool(q.parent) or any(w.op == HAS_ANCESTOR for w in leaves(q.where))
    return {"query_scope": scope, "properties": "(" + ", ".join(f"{f} {d}" for f, d in order) + ")", "includes_ancestors": ancestor, "name_field": KEY if q.flavour == "entity" else NAME}


def physical(df: DataFrame) -> str:
    """Spark's formatted plan."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def _observed(db, q: Query) -> tuple:
    """The database with a count on each scan of the query."""
    counts, tables = [], {}
    wanted = {id(c) for s in q.selectors for c in db.tables_of(s)}
    for name, held in db.tables.items():
        tables[name] = []
        for c in held:
            if id(c) in wanted:
                counts.append(Observation())
                c = replace(c, df=c.df.observe(counts[-1], F.count(F.lit(1)).alias("n")))
            tables[name].append(c)
    return replace(db, tables=tables), counts


def analyze_run(db, q: Query, aggregations=None) -> dict:
    """Run a query or an aggregation once: rows returned, read operations (at least one), seconds, and the rows that its scans gave."""
    watched, counts = _observed(db, q)
    began = time.monotonic()
    if aggregations is None:
        # Under a count a sort without a limit is left out, which would read the scan twice.
        n = watched.query(q).agg(F.count(F.lit(1))).first()[0]
    else:
        n = len(watched.aggregate(q, aggregations).collect())
    scanned = sum(o.get["n"] for o in counts)
    reads = n if aggregations is None else -(-scanned // 1000)
    return {"results": n, "read_operations": max(1, reads), "seconds": time.monotonic() - began, "documents_scanned": scanned, **summary(q, aggregations)}
