"""Field paths, resource names and document paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument

_PLAIN = re.compile(r"[A-Za-z_][A-Za-z_0-9]*\Z")
_RESOURCE = re.compile(r"projects/([^/]+)/databases/([^/]+)/documents(?:/(.*))?\Z")
RESERVED = re.compile(r"__.*__\Z")
VIRTUAL = re.compile(r"__id(-?\d+)__\Z")


def parse_field_path(path: str) -> list[str]:
    """Segments of a dotted path; a segment in backticks may hold any character, with backslash escapes."""
    out, at, n = [], 0, len(path)
    while at < n:
        if path[at] == "`":
            part, at = [], at + 1
            while at < n and path[at] != "`":
                if path[at] == "\\" and at + 1 < n:
                    at += 1
                part.append(path[at])
                at += 1
            if at == n:
                raise InvalidArgument(f"unclosed backtick in field path {path!r}")
            out.append("".join(part))
            at += 1
            if at < n and path[at] != ".":
                raise InvalidArgument(f"text behind a quoted segment in field path {path!r}")
        else:
            end = path.find(".", at)
            end = n if end < 0 else end
            out.append(path[at:end])
            at = end
        if at < n:
            at += 1
            if at == n:
                raise InvalidArgument(f"field path {path!r} ends with a dot")
    if not out or any(not s for s in out):
        raise InvalidArgument(f"empty segment in field path {path!r}")
    return out


def format_field_path(segments: list[str]) -> str:
    quote = lambda s: s if _PLAIN.match(s) else "`" + s.replace("\\", "\\\\").replace("`", "\\`") + "`"
    return ".".join(map(quote, segments))


def parse_resource(name: str) -> tuple[str, str, str]:
    """(project, database, document path) of a full resource name."""
    m = _RESOURCE.match(name)
    if not m:
        raise InvalidArgument(f"{name!r} is no resource name")
    return m[1], m[2], m[3] or ""


def resource_name(project: str, database: str, path: Column | str) -> Column:
    p = F.lit(path) if isinstance(path, str) else path
    return F.concat(F.lit(f"projects/{project}/databases/{database}/documents/"), p)


def check_id(document_id: str) -> str:
    """Reserved ids are refused, numeric ids in disguise are not."""
    if not document_id or "/" in document_id:
        raise InvalidArgument(f"{document_id!r} is no document id")
    if RESERVED.match(document_id) and not VIRTUAL.match(document_id):
        raise InvalidArgument(f"{document_id!r} is a reserved id")
    return document_id


def refused_id(document_id: Column) -> Column:
    """``check_id`` over a column: whether an id would be refused."""
    reserved = document_id.rlike("^__.*__$") & ~document_id.rlike(r"^__id-?\d+__$")
    return document_id.isNull() | (document_id == "") | document_id.contains("/") | reserved


def document_id(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """Path of the parent document, '' at the top."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), "/")


def under(path: Column, ancestor: str, itself: bool = False) -> Column:
    """Paths below an ancestor document ('' for all), by prefix and not by pattern."""
    if not ancestor:
        return F.lit(True)
    below = path.startswith(ancestor + "/")
    return below | (path == ancestor) if itself else below


def path_key(path: Column) -> Column:
    """Sort key of a path: segment by segment, numeric ids (__id7__) first and by number, only at document positions."""

    def one(s: Column, i: Column) -> Column:
        number = F.when(s.startswith("__id"), F.regexp_extract(s, r"^__id(-?[0-9]+)__$", 1).try_cast("long"))
        numeric = (i % 2 == 1) & number.isNotNull()
        return F.struct(
            F.when(numeric, 0).otherwise(1).alias("kind"), F.when(numeric, number).otherwise(F.lit(0)).cast("long").alias("number"), F.when(numeric, F.lit("")).otherwise(s).alias("text")
        )

    return F.transform(F.split(path, "/"), one)
