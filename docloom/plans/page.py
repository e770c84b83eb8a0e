"""Pages of a query: cursor tokens, skipped results, and whether more follow."""

from __future__ import annotations

import base64
import datetime as dt
import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..errors import InvalidArgument
from ..sources.database import PATH
from .analyze import analyze
from .build import build
from .model import KEY, NAME, Cursor, Query

MORE, DONE = "MORE_RESULTS_AFTER_LIMIT", "NO_MORE_RESULTS"


@dataclass
class Page:
    """``rows`` in order, how many an offset skipped, whether more follow, and the token behind the last row (None without rows)."""

    rows: DataFrame
    skipped_results: int
    more_results: str
    end_cursor: str | None


def _plain(v):
    if isinstance(v, (dt.datetime, dt.date)):
        return {"t": v.isoformat()}
    return {"b": bytes(v).hex()} if isinstance(v, (bytes, bytearray)) else {"v": v}


def _value(x: dict):
    if "t" in x:
        return dt.datetime.fromisoformat(x["t"])
    return bytes.fromhex(x["b"]) if "b" in x else x["v"]


def encode_cursor(path: str, order: list[tuple[str, object]]) -> str:
    """A token from a row: its path, and the values of the order's fields (n: null)."""
    sorts = [{"c": f, "n": v is None, **_plain(v)} for f, v in order]
    return base64.urlsafe_b64encode(json.dumps({"p": path, "s": sorts}, separators=(",", ":")).encode()).decode()


def decode_cursor(token: str) -> Cursor:
    """The position just behind the row of a token."""
    try:
        held = json.loads(base64.urlsafe_b64decode(token.encode()))
        return Cursor((*(None if x["n"] else _value(x) for x in held["s"]), held["p"]), False)
    except (ValueError, KeyError, TypeError) as e:
        raise InvalidArgument("this is no cursor token") from e


def page(db, q: Query, token: str | None = None) -> Page:
    """One page of a query of one collection with stored fields in its order; a token of the page before takes its offset away."""
    if token is not None:
        q = replace(q, start=decode_cursor(token), offset=0)
    fields = [o.field for o in analyze(q).order if o.field not in (NAME, KEY)]
    rows = build(db, q)
    ordered = rows.select(PATH, *(f"`{f}`" for f in fields))
    held = ordered.tail(1)  # in the order of the query
    n = rows.count() if q.limit else None
    skipped = min(q.offset, build(db, replace(q, offset=0, limit=None)).count()) if q.offset else 0
    more = MORE if q.limit and n == q.limit else DONE
    return Page(rows, skipped, more, encode_cursor(held[0][PATH], [(f, held[0][f]) for f in fields]) if held else None)


def partitions(db, q: Query, most: int = 0) -> DataFrame:
    """Split points of a query: none, so that one request reads all of it; Spark splits the scan itself."""
    if most < 0:
        raise InvalidArgument("a negative number of partitions")
    analyze(q)
    return db.spark.createDataFrame([], "cursor string")
