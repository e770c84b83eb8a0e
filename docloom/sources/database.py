"""Collections over DataFrames: how a table becomes documents with paths."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument, NotFound
from ..functions import paths as P
from ..plans.model import Query, Selector

PATH = "__path__"


@dataclass
class Collection:
    """A table of documents: ``__path__`` and either typed columns (null: missing) or a map column ``fields`` of values.

    ``nulls``: typed columns whose null is an explicit null instead.
    ``unindexed``: properties that never match a filter.
    ``parts``: (collection id, column or literal id) from the top down to the
    document itself, so that lookups by path and by ancestor become filters on
    stored columns, which the scan can push down.
    """

    name: str
    df: DataFrame
    nulls: frozenset[str] = frozenset()
    unindexed: frozenset[str] = frozenset()
    virtual_ids: bool = False
    key: str | None = None
    prefix: str | None = None
    parts: tuple[tuple[str, Column | str], ...] | None = None

    @property
    def path(self) -> Column:
        return F.col(PATH)

    @property
    def dynamic(self) -> bool:
        return "fields" in self.df.columns and isinstance(self.df.schema["fields"].dataType, T.MapType)

    def typed(self, field_path: str) -> tuple[Column, T.DataType]:
        """A typed field by its path; a path through something that is no map is missing."""
        kind: T.DataType = self.df.schema
        col: Column | None = None
        for s in P.parse_field_path(field_path):
            if not isinstance(kind, T.StructType) or s not in kind.fieldNames():
                return F.lit(None).cast("string"), T.StringType()
            col = F.col(f"`{s}`") if col is None else col.getField(s)
            kind = kind[s].dataType
        return col, kind

    def value(self, field_path: str) -> Column:
        return F.col("fields")[".".join(P.parse_field_path(field_path))]

    def _is(self, part: Column | str, wanted: str) -> Column:
        """Whether a part of the path has this id."""
        if isinstance(part, str):
            return F.lit(part == wanted)
        kind = self.df.select(part).schema[0].dataType
        if isinstance(kind, T.IntegralType):
            number = int(wanted) if wanted.lstrip("-").isdigit() else None
            return part == F.lit(number).cast(kind) if number is not None and str(number) == wanted else F.lit(False)
        return part == F.lit(wanted) if isinstance(kind, T.StringType) else part.cast("string") == F.lit(wanted)

    def under(self, ancestor: str, itself: bool = False) -> Column:
        """The documents below an ancestor, by their columns where these are known."""
        if self.parts is None or not ancestor:
            return P.under(self.path, ancestor, itself)
        segments = ancestor.split("/")
        depth = len(segments) // 2
        if len(segments) % 2 or depth > len(self.parts) or (depth == len(self.parts) and not itself):
            return F.lit(False)
        if any(c != part[0] for c, part in zip(segments[::2], self.parts, strict=False)):
            return F.lit(False)
        return reduce(lambda a, b: a & b, (self._is(part[1], i) for i, part in zip(segments[1::2], self.parts, strict=False)))

    def parts_match(self, path: str) -> bool:
        """Whether a path can be one of this table's."""
        segments = path.split("/")
        return len(segments) == 2 * len(self.parts) and all(c == part[0] for c, part in zip(segments[::2], self.parts, strict=True))

    def by_ids(self, paths: list[str]) -> Column:
        """The documents of these paths, by their columns where these are known."""
        if self.parts is None:
            return self.path.isin(paths) if paths else F.lit(False)
        depth, last = 2 * len(self.parts), self.parts[-1][1]
        fit = [p for p in paths if p.count("/") + 1 == depth]
        if self.prefix is not None and isinstance(last, Column):  # one parent: a list of keys
            kind = self.df.select(last).schema[0].dataType
            ids = [p.rpartition("/")[2] for p in fit if p.rpartition("/")[0] == self.prefix]
            if isinstance(kind, T.IntegralType):
                keys = [int(i) for i in ids if i.lstrip("-").isdigit() and str(int(i)) == i]
            else:
                keys = ids
            return (last if isinstance(kind, (T.IntegralType, T.StringType)) else last.cast("string")).isin(keys) if keys else F.lit(False)
        return reduce(lambda a, b: a | b, (self.under(p, itself=True) for p in fit)) if fit else F.lit(False)


@dataclass
class Database:
    """Collections by id; several tables may hold the same collection id at different parents."""

    spark: SparkSession
    project: str = "p"
    name: str = "(default)"
    namespace: str = ""
    tables: dict[str, list[Collection]] = field(default_factory=dict)

    def register(self, collection: str, df: DataFrame, *, key: str | None = None, parent: Column | str | tuple = "", path: Column | None = None, **kw) -> Collection:
        """Add a table; the path is ``parent/collection/key`` unless given.

        ``parent``: a path, a Column of paths, or pairs of (collection id, column)
        from the top down, through which ancestors can be pushed to the scan.
        """
        if path is None:
            if key is None:
                raise InvalidArgument("a collection needs a key column or a path")
            if isinstance(parent, Column):
                path = F.concat(parent, F.lit(f"/{collection}/"), F.col(key).cast("string"))
            else:
                if isinstance(parent, str):
                    kw.setdefault("prefix", f"{parent}/{collection}" if parent else collection)
                    segments = parent.split("/") if parent else []
                    parts = list(zip(segments[::2], segments[1::2], strict=True))
                else:
                    parts = [(c, F.col(f"`{name}`")) for c, name in parent]
                parts.append((collection, F.col(f"`{key}`")))
                kw.setdefault("parts", tuple(parts))
                each = [x for c, i in parts for x in (F.lit(f"/{c}/"), F.lit(i) if isinstance(i, str) else i.cast("string"))]
                path = F.substring(F.concat(*each), 2, 1 << 30)
        held = Collection(collection, df.withColumn(PATH, path), key=key, **kw)
        self.tables.setdefault(collection, []).append(held)
        return held

    def tables_of(self, s: Selector) -> list[Collection]:
        if not s.collection:
            if not s.descendants:
                raise InvalidArgument("a kindless query needs all descendants")
            return [c for many in self.tables.values() for c in many]
        return self.tables.get(s.collection, [])

    def scans(self, s: Selector, parent: str = "") -> list[Collection]:
        """The tables that a selector reads, with the scan predicates applied."""
        out = []
        for c in self.tables_of(s):
            df = c.df
            if s.descendants:
                df = df.where(c.under(parent)) if parent else df
            elif c.prefix is not None:
                want = f"{parent}/{c.name}" if parent else c.name
                df = df if c.prefix == want else df.where(F.lit(False))
            elif c.parts is not None:
                depth = parent.count("/") // 2 + 1 if parent else 0
                df = df.where(c.under(parent) if depth == len(c.parts) - 1 else F.lit(False))
            else:
                df = df.where(P.parent_path(c.path) == parent)
            out.append(replace(c, df=df))
        return out

    def kindless(self, parent: str = "") -> DataFrame:
        """Every document below ``parent``: path and collection."""
        frames = [c.df.select(PATH, F.lit(c.name).alias("collection")) for c in self.scans(Selector("", True), parent)]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def get(self, path: str, mask: list[str] | None = None) -> DataFrame:
        """One document as a DataFrame of one row or none."""
        collection = path.split("/")[-2]
        for c in self.tables.get(collection, []):
            hit = c.df.where(c.by_ids([path]) & (c.path == path))
            if c.parts is not None and not c.parts_match(path):
                continue
            return hit.select(PATH, *(f"`{m}`" for m in mask)) if mask else hit
        raise NotFound(path)

    def query(self, q: Query) -> DataFrame:
        from ..plans.build import build

        return build(self, q)

    def aggregate(self, q: Query, aggregations) -> DataFrame:
        from ..operators.aggregate import aggregate

        return aggregate(self, q, aggregations)
