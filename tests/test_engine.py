"""Literal fixtures: filters over missing, null and NaN, order, cursors, aggregates, writes, time travel and watch."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from docloom import catalogue
from docloom.errors import Aborted, FailedPrecondition, InvalidArgument, NotFound
from docloom.functions import paths as P
from docloom.functions import values as V
from docloom.operators import changes, lookup, mutate, transforms
from docloom.operators.numbering import numbered
from docloom.plans import explain
from docloom.plans import page as pages
from docloom.plans.model import CONTAINS, CONTAINS_ANY, DOCUMENT, ENTITY, EQ, GE, GT, IN, IS_NAN, IS_NOT_NAN, IS_NOT_NULL, IS_NULL, LT, NAME, NE, NOT_IN, Avg, Count, Cursor, Nearest, Order, Query, Selector, Sum, Where, all_of, any_of
from docloom.sources import indexes, wire
from docloom.sources.changelog import ChangeLog
from docloom.sources.database import PATH, Database
from docloom.sources.shared import shared_dir
from docloom.streaming import watch

W = (Selector("w"),)
NAN = float("nan")


def dyn(spark, **docs):
    """A dynamic collection ``w`` from documents given as dicts."""
    out = None
    for name, fields in docs.items():
        one = spark.range(1).select(F.lit("w/" + name).alias("p"), V.fields(**fields).alias("fields"))
        out = one if out is None else out.unionByName(one)
    db = Database(spark)
    db.register("w", out, path=F.col("p"), prefix="w")
    return db


def ids(db, where=None, **kw):
    return [r[PATH].removeprefix("w/") for r in db.query(Query(W, where=where, **kw)).collect()]


def test_filters_on_types(spark):
    db = dyn(
        spark, a={"count": 1, "tags": ["go", "sql"], "loc": V.Geo(37.7, -122.4), "m": {"x": 1, "y": 2}, "r": V.Ref("t/1"), "b": b"\x01"},
        b={"count": 5, "tags": ["python", "sql"], "loc": V.Geo(40.7, -74.0), "m": {"x": 3, "y": 4}, "r": V.Ref("t/2"), "b": b"\x02"},
        c={"count": 10.5, "tags": [], "x": None, "score": NAN}, d={"count": "ten", "x": 7, "tags": None},
    )
    assert sorted(ids(db, Where("count", GT, 3))) == ["b", "c"]
    assert ids(db, all_of(Where("count", GE, 5), Where("count", LT, 10))) == ["b"]
    assert sorted(ids(db, Where("count", EQ, 5.0))) == ["b"]
    assert sorted(ids(db, Where("count", NE, 1))) == ["b", "c", "d"]
    assert sorted(ids(db, Where("count", IN, [1, "ten"]))) == ["a", "d"]
    assert sorted(ids(db, Where("count", NOT_IN, [1, "ten"]))) == ["b", "c"]
    assert ids(db, Where("count", NOT_IN, [1, None])) == []
    assert ids(db, Where("count", IN, [])) == []
    assert sorted(ids(db, Where("tags", CONTAINS, "sql"))) == ["a", "b"]
    assert sorted(ids(db, Where("tags", CONTAINS_ANY, ["go", "python"]))) == ["a", "b"]
    assert ids(db, Where("tags", EQ, ["go", "sql"])) == ["a"]
    assert ids(db, Where("tags", EQ, "sql")) == []
    assert sorted(ids(db, Where("tags", EQ, "sql"), flavour=ENTITY)) == ["a", "b"]
    assert ids(db, Where("x", IS_NULL)) == ["c"]
    assert ids(db, Where("x", IS_NOT_NULL)) == ["d"]
    assert sorted(ids(db, Where("tags", IS_NOT_NULL))) == ["a", "b", "c"]
    assert ids(db, Where("score", IS_NAN)) == ["c"]
    assert ids(db, Where("score", GT, 0)) == []
    assert sorted(ids(db, Where("count", IS_NOT_NAN))) == ["a", "b", "c", "d"]
    assert ids(db, Where("loc", EQ, V.Geo(37.7, -122.4))) == ["a"]
    assert ids(db, Where("m", EQ, {"y": 4, "x": 3})) == ["b"]
    assert ids(db, Where("m.x", EQ, 1)) == ["a"]
    assert ids(db, Where("r", EQ, V.Ref("t/2"))) == ["b"]
    assert ids(db, Where("b", GT, b"\x01")) == ["b"]
    assert sorted(ids(db, any_of(Where("count", EQ, 1), Where("score", IS_NAN)))) == ["a", "c"]
    assert sorted(ids(db, Where("x", NE, 7), flavour=ENTITY)) == ["a", "b", "c"]


def test_cross_type_order_and_cursors(spark):
    docs = {"null": None, "flag": True, "nan": NAN, "neg": float("-inf"), "zero": 0, "time": dt.datetime(2024, 1, 1), "text": "a", "blob": b"a", "ref": V.Ref("a/b"), "geo": V.Geo(1, 2), "arr": [1], "vec": V.Vector((1.0,)), "map": {"k": 1}}
    db = dyn(spark, **{k: {"v": x} for k, x in docs.items()}, other={"w": 1})
    assert ids(db, order=(Order("v"),)) == list(docs)
    assert ids(db, order=(Order("v", True),)) == list(docs)[::-1]
    assert ids(db, order=(Order("v"),), start=Cursor((0,), True), limit=2) == ["zero", "time"]
    assert ids(db, order=(Order("v"),), start=Cursor((0,), False), end=Cursor(("a",), False)) == ["time", "text"]
    assert ids(db, order=(Order("v"),), limit=3, offset=3) == ["neg", "zero", "time"]
    assert ids(db, limit=0, flavour=ENTITY) == []


def test_aggregates(spark):
    db = dyn(spark, a={"v": 10, "r": "us"}, b={"v": 0.5, "r": "us"}, c={"v": 5, "r": "eu"}, d={"r": "eu"}, e={"v": "no", "r": "x"})
    got = db.aggregate(Query(W), [Count("n"), Sum("v", "s"), Avg("v", "a")]).first()
    assert (got.n, got.s, got.s_int, round(got.a, 6)) == (4, 15.5, None, 5.166667)
    got = db.aggregate(Query(W, where=Where("r", EQ, "eu")), [Sum("v", "s"), Count()]).first()
    assert (got.s_int, got.property_2) == (5, 1)
    got = db.aggregate(Query(W, where=Where("r", EQ, "none")), [Sum("v", "s"), Avg("v", "a")]).first()
    assert (got.s_int, got.a) == (0, None)
    assert db.aggregate(Query(W), [Count("n", 3)]).first().n == 3
    with pytest.raises(InvalidArgument):
        db.aggregate(Query(W), [Sum("__key__", "s")])


def test_paths_and_wire(spark):
    assert P.parse_field_path("a.`b.c`.d") == ["a", "b.c", "d"]
    assert P.parse_field_path("`x\\`y`") == ["x`y"] and P.format_field_path(["x`y", "z"]) == "`x\\`y`.z"
    for bad in ("", "a..b", "`a", "a."):
        with pytest.raises(InvalidArgument):
            P.parse_field_path(bad)
    assert P.parse_resource("projects/p/databases/d/documents/a/b") == ("p", "d", "a/b")
    with pytest.raises(InvalidArgument):
        P.check_id("__x__")
    assert P.check_id("__id7__") == "__id7__"
    text = '{"name":"projects/p/databases/d/documents/w/a","fields":{"n":{"integerValue":"5"},"l":{"arrayValue":{"values":[{"stringValue":"x"},{"integerValue":"2"}]}},"m":{"mapValue":{"fields":{"k":{"booleanValue":true}}}},"z":{"nullValue":null}}}'
    db = Database(spark)
    c = db.register("w", wire.decode(spark.createDataFrame([(text,)], "json string")), path=F.regexp_extract("name", "documents/(.*)$", 1), prefix="w")
    assert ids(db, Where("l", CONTAINS, 2)) == ["a"] and ids(db, Where("m", EQ, {"k": True})) == ["a"] and ids(db, Where("n", EQ, 5)) == ["a"]
    assert indexes.field_index(c.df).count() == 5
    assert indexes.parse_index_config("indexes:\n- kind: K\n  properties:\n  - name: a\n  - name: b\n    direction: desc\n")[0]["properties"] == [("a", "asc"), ("b", "desc")]


def test_nearest(spark):
    db = dyn(spark, a={"v": V.Vector((1.0, 0.0))}, b={"v": V.Vector((0.0, 1.0))}, c={"v": V.Vector((3.0, 0.0, 1.0))}, z={"v": V.Vector((0.0, 0.0))})
    near = lambda m, **k: [(r[PATH], round(r.d, 6)) for r in db.query(Query(W, nearest=Nearest("v", (1.0, 0.0), m, 2, "d", **k))).collect()]
    assert near("euclidean") == [("w/a", 0.0), ("w/z", 1.0)]
    assert near("cosine") == [("w/a", 0.0), ("w/b", 1.0)]
    assert near("dot") == [("w/a", 1.0), ("w/b", 0.0)]
    assert near("euclidean", threshold=0.5) == [("w/a", 0.0)]


def test_transforms_and_writes(spark):
    r = spark.range(1).select(
        transforms.increment(F.lit(1.5), 2).alias("i"), transforms.maximum(F.lit(10), 5).alias("x"), transforms.minimum(F.lit(10), 3).alias("n"),
        transforms.append_missing(F.array(F.lit("a"), F.lit("b")), ["b", "c", "c"]).alias("p"), transforms.remove_all(F.array(F.lit("a"), F.lit("b"), F.lit("a")), ["a"]).alias("q"),
    ).first()
    assert (r.i, r.x, r.n, r.p, r.q) == (3.5, 10, 3, ["a", "b", "c", "c"], ["b"])
    live = spark.createDataFrame([("w/a", 1, 1), ("w/b", 2, 3)], "path string, v int, version long")
    writes = spark.createDataFrame([("w/a", "upsert", 9), ("w/c", "insert", 7), ("w/b", "delete", None)], "path string, op string, v int")
    got = {r.path: (r.v, r.version) for r in mutate.post_image(live, writes, ["v"]).collect()}
    assert got == {"w/a": (9, 2), "w/c": (7, 1)}
    tx = mutate.Transactions()
    one, two = tx.begin(), tx.begin()
    tx.read(one, live)
    assert tx.commit(one, live, writes).count() == 3
    tx.read(two, live)
    with pytest.raises(Aborted):
        tx.commit(two, mutate.post_image(live, writes, ["v"]), writes)
    with pytest.raises(NotFound):
        tx.rollback(two)
    three = tx.begin(read_only=True)
    with pytest.raises(FailedPrecondition):
        tx.commit(three, live, writes)
    with pytest.raises(Aborted):
        mutate.atomic(live, writes.withColumn("op", F.lit("insert")))


def test_lookup_and_listing(spark):
    docs = spark.createDataFrame([("w/a", 1), ("w/b", 2)], f"{PATH} string, v int")
    request = lookup.keys_frame(spark, ["w/b", "w/x", "w/b"])
    assert [(r[PATH], r.found) for r in lookup.batch_get(docs, request).orderBy("place").collect()] == [("w/b", True), ("w/x", False)]
    below = spark.createDataFrame([("w/a/n/1",), ("w/ghost/n/1",)], f"{PATH} string")
    assert {(r[PATH], r.missing) for r in lookup.with_missing(docs, below, "", "w").collect()} == {("w/a", False), ("w/b", False), ("w/ghost", True)}
    assert [r.collection for r in lookup.collection_ids(below.unionByName(docs.select(PATH)), "").collect()] == ["w"]


@pytest.fixture
def log(spark):
    rows = [(1, "w/a", 1, False, 1), (2, "w/b", 2, False, 5), (3, "w/a", 3, False, 9), (4, "w/b", 4, True, None), (5, "w/c", 5, False, 7), (6, "w/a", 6, False, 0)]
    return spark.createDataFrame(rows, "seq long, path string, change_time long, deleted boolean, v int")


def test_time_travel(log):
    assert {(r.path, r.v) for r in changes.as_of(log, 3).collect()} == {("w/a", 9), ("w/b", 5)}
    assert {r.path for r in changes.live(log).collect()} == {"w/a", "w/c"}
    assert [(r.path, r.seq) for r in changes.since_seq(log, 2).collect()] == [("w/a", 6), ("w/b", 4), ("w/c", 5)]
    assert changes.current_seq(log).first().seq == 6
    got = {(r.path, r.change) for r in changes.diff(log, F.col("v") >= 5, 3, 6).collect()}
    assert got == {("w/a", "REMOVE"), ("w/b", "DELETE"), ("w/c", "CHANGE")}


def test_watch_stream_equals_batch(spark, log, tmp_path):
    matches = {"big": F.col("v") >= 5, "any": F.lit(True)}
    want = {tuple(r) for r in watch.events_batch(log, matches).collect()}
    for i in range(1, 7):
        log.where(F.col("seq") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = watch.watch(stream, matches).writeStream.format("memory").queryName("events_seen").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("select * from events_seen").collect()}
    assert got == want and ("big", "w/b", 4, "DELETE") in got


def test_change_log_commits(spark, log, tmp_path):
    cl = ChangeLog(spark, "file://" + str(tmp_path / "cl"))
    assert cl.commit(log.where("seq <= 3")) == 0 and cl.commit(log.where("seq > 3")) == 1
    log.write.parquet(cl.staging())  # a commit that was never published
    assert cl.read().count() == 6 and cl.read(upto=0).count() == 3


def test_explain(spark):
    db = dyn(spark, a={"v": 1}, b={"v": 2})
    q = Query(W, where=Where("v", GT, 1), order=(Order("v", True),))
    assert explain.summary(q)["properties"] == "(v DESC, __name__ DESC)"
    assert explain.analyze_run(db, q)["results"] == 1
    assert "Physical Plan" in explain.physical(db.query(q))


def test_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2.5d as v", "cast(id as string) as s").write.parquet(str(tmp_path / "t"))
    db = Database(spark)
    db.register("t", spark.read.parquet(str(tmp_path / "t")), key="id")
    plan = explain.physical(db.query(Query((Selector("t"),), where=all_of(Where("v", GT, 10.0), Where("s", EQ, "7")), order=(Order("v"),), limit=5, select=("v",))))
    assert "TakeOrderedAndProject" in plan and "EqualTo(s, 7)" in plan.replace("EqualTo(s,7)", "EqualTo(s, 7)") and "GreaterThan(v,10.0)" in plan


def test_virtual_ids(spark):
    df = spark.createDataFrame([("w/b",), ("w/__id10__",), ("w/__id9__",), ("w/__idx__",)], "p string")
    db = Database(spark)
    db.register("w", df, path=F.col("p"), prefix="w", virtual_ids=True)
    assert ids(db, order=(Order(NAME),), flavour=DOCUMENT) == ["__id9__", "__id10__", "__idx__", "b"]


SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@tables
@pytest.mark.parametrize(
    "name, pushed",
    [("filter_key_in", "In(o_orderkey,[5,77,999999999])"), ("kind_ancestor", "EqualTo(o_custkey,42)"), ("scan_collection_group", "EqualTo(n_regionkey,1)"), ("scan_child_collection", "EqualTo(o_custkey,7)"), ("point_get", "EqualTo(o_orderkey,7)"), ("ds_key_eq", "EqualTo(o_orderkey,7)")],
)
def test_paths_reach_the_scan(spark, name, pushed):
    plan = explain.physical(catalogue.QUERIES[name](spark, SF)).replace(" ", "")
    assert pushed in plan


def test_paths_of_parts(spark):
    db = Database(spark)
    df = spark.createDataFrame([("x", 7, 1), ("y", 7, 2), ("x", 8, 3)], "a string, b long, v int")
    c = db.register("n", df, key="b", parent=(("m", "a"),))
    got = lambda w, **k: sorted(r[PATH] for r in db.query(Query((Selector("n", True),), where=w, **k)).collect())
    assert got(None) == ["m/x/n/7", "m/x/n/8", "m/y/n/7"] and got(None, parent="m/x") == ["m/x/n/7", "m/x/n/8"] and got(None, parent="q/x") == []
    assert got(Where(NAME, IN, ["m/x/n/7", "m/x/n/07", "m/x/n/z", "m/x", "m/y/n/7/q/1"])) == ["m/x/n/7"]
    assert got(Where("__key__", "has-ancestor", "m/y/n/7"), flavour=ENTITY) == ["m/y/n/7"] and got(Where("__key__", "has-ancestor", "m/y/n/7/o/1"), flavour=ENTITY) == []
    assert [r[PATH] for r in db.query(Query((Selector("n"),), parent="m/y")).collect()] == ["m/y/n/7"] and db.query(Query((Selector("n"),))).count() == 0
    assert db.get("m/x/n/8").first().v == 3 and c.by_ids([]) is not None
    with pytest.raises(NotFound):
        db.get("q/x/n/8")


def test_sums_beyond_64_bits_are_doubles(spark):
    db = Database(spark)
    db.register("w", spark.createDataFrame([(1, 1 << 62, 5), (2, 1 << 62, 6), (3, None, 7)], "k long, big long, small int"), key="k")
    got = db.aggregate(Query(W), [Sum("big", "s")])
    assert got.dtypes == [("s", "double")] and got.first().s == float(1 << 63)
    got = db.aggregate(Query(W, where=Where("k", EQ, 1)), [Sum("big", "s"), Sum("small", "t"), Count("n")])
    assert got.dtypes == [("s", "bigint"), ("t", "bigint"), ("n", "bigint")] and tuple(got.first()) == (1 << 62, 5, 1)
    assert db.aggregate(Query(W, where=Where("k", EQ, 9)), [Sum("big", "s")]).first().s == 0


def test_transforms_of_missing_and_other_values(spark):
    df = spark.createDataFrame([(None, ["a"]), (["a", "b"], ["b", "c", "c"])], "c array<string>, more array<string>")
    assert [r[0] for r in df.select(transforms.append_missing(F.col("c"), F.col("more"))).collect()] == [["a"], ["a", "b", "c", "c"]]
    values = [7, 7.5, "text", None, True, [1, 2, 1], NAN, (1 << 63) - 1]
    one = spark.range(1).select(*[V.literal(v).alias(f"v{i}") for i, v in enumerate(values)])
    shown = lambda v: F.struct(v["int"].alias("i"), v["key"]["num"].alias("d"), v["key"]["real"].alias("r"))
    up = one.select(*[shown(transforms.increment_value(F.col(c), 3)).alias(c) for c in one.columns]).first()
    assert [(x.i, x.d) for x in up[:6]] == [(10, 10.0), (None, 10.5), (3, 3.0), (3, 3.0), (3, 3.0), (3, 3.0)] and up[6].r == 0 and up[7].i is None and up[7].d == float(1 << 63)
    assert one.select(shown(transforms.increment_value(F.col("v0"), 0.5)).alias("x")).first().x.d == 7.5
    low = one.select(*[shown(transforms.minimum_value(F.col(c), 7)).alias(c) for c in one.columns[:3]]).first()
    assert [(x.i, x.d) for x in low] == [(7, 7.0), (7, 7.0), (0, 0.0)]
    texts = lambda v: F.transform(v["key"]["items"], lambda x: x["exact"])
    both = one.select(texts(transforms.append_missing_value(F.col("v5"), [2, 3, 3])).alias("a"), texts(transforms.append_missing_value(F.col("v2"), [1])).alias("b"), texts(transforms.remove_all_value(F.col("v5"), [1])).alias("c"), transforms.remove_all_value(F.col("v2"), [1])["key"]["text"].alias("d")).first()
    assert (both.a, both.b, both.c, both.d) == ([1, 2, 1, 3, 3], [1], [2], "text")


def test_pages_and_tokens(spark):
    db = Database(spark)
    db.register("w", spark.createDataFrame([(i, None if i % 3 == 0 else dt.datetime(2024, 1, 1 + i), bytes([i])) for i in range(9)], "k long, t timestamp, b binary"), key="k")
    q, seen, token = Query(W, order=(Order("t"), Order("b", True)), limit=4, offset=1, flavour=ENTITY), [], None
    for _ in range(4):
        p = pages.page(db, q, token)
        seen.append(([r.k for r in p.rows.collect()], p.skipped_results, p.more_results))
        token = p.end_cursor
        if token is None:
            break
    assert [s[0] for s in seen] == [[2, 4, 5, 7], [8], []] or [k for s in seen for k in s[0]][-1] == 8
    assert seen[0][1] == 1 and seen[1][1] == 0 and seen[0][2] == pages.MORE and seen[-1][2] == pages.DONE
    assert pages.decode_cursor(pages.encode_cursor("w/1", [("a", None), ("b", b"x"), ("c", dt.datetime(2024, 1, 1))])).values == (None, b"x", dt.datetime(2024, 1, 1), "w/1")
    with pytest.raises(InvalidArgument):
        pages.decode_cursor("bm90IGpzb24=")


def test_explain_of_aggregations_and_ancestors(spark):
    db = dyn(spark, a={"v": 1}, b={"v": 2}, c={"x": 2})
    got = explain.analyze_run(db, Query(W, where=Where("v", GT, 0)), [Count("n"), Sum("v", "s")])
    assert got["results"] == 1 and got["documents_scanned"] == 3 and got["properties"] == "(v ASC, __name__ ASC)"
    q = Query((Selector("w", True),), where=Where("__key__", "has-ancestor", "w/a"), flavour=ENTITY)
    assert explain.summary(q) == {"query_scope": "Collection group", "properties": "(__key__ ASC)", "includes_ancestors": True, "name_field": "__key__"}
    assert explain.analyze_run(db, Query(W, order=(Order("v"),)))["documents_scanned"] == 3


def test_resumed_watch_knows_what_was_sent(spark, log, tmp_path):
    matches = {"big": F.col("v") >= 5}
    sent = watch.sent_paths(log, matches, 3)
    assert {tuple(r) for r in sent.collect()} == {("big", "w/a"), ("big", "w/b")}
    log.where("seq > 3").coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = watch.watch(stream, matches, sent).writeStream.format("memory").queryName("resumed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.path, r.seq, r.change) for r in spark.sql("select * from resumed").collect()} == {("w/b", 4, "DELETE"), ("w/c", 5, "CHANGE"), ("w/a", 6, "REMOVE")}
    token = watch.token(3, "s")
    got = [(r.place, r.path, r.change) for r in watch.opened(log, F.col("v") >= 5, "big", 6, "s", resume_token=token, once=True).orderBy("place", "path").collect()]
    assert got == [(0, None, "ADD"), (1, "w/a", "REMOVE"), (1, "w/b", "DELETE"), (1, "w/c", "CHANGE"), (2, None, "CURRENT"), (3, None, "NO_CHANGE"), (4, None, "REMOVE_TARGET")]
    other = watch.opened(log, F.col("v") >= 5, "big", 6, "t", resume_token=token)
    assert [(r.path, r.change) for r in other.where("place = 1").collect()] == [("w/c", "CHANGE")]
    assert watch.read_token(other.where("place = 3").first().token) == (6, "t")
    with pytest.raises(InvalidArgument):
        watch.read_token("x")


def test_vectors_and_deep_values_on_the_wire(spark):
    text = '{"name":"projects/p/databases/d/documents/w/a","fields":{"v":{"mapValue":{"fields":{"__type__":{"stringValue":"__vector__"},"value":{"arrayValue":{"values":[{"doubleValue":1.5},{"integerValue":"2"}]}}}}},"deep":{"arrayValue":{"values":[{"arrayValue":{"values":[{"integerValue":"1"}]}}]}},"none":{"arrayValue":{}},"big":{"integerValue":"9007199254740993"}}}'
    docs = wire.decode(spark.createDataFrame([(text,)], "json string"), keep=("json",))
    db = Database(spark)
    db.register("w", docs, path=F.regexp_extract("name", "documents/(.*)$", 1), prefix="w")
    assert ids(db, Where("v", EQ, V.Vector((1.5, 2.0)))) == ["a"] and ids(db, Where("deep", EQ, [[1]])) == ["a"] and ids(db, Where("none", EQ, [])) == ["a"]
    assert ids(db, Where("big", EQ, 9007199254740993)) == ["a"] and ids(db, Where("big", EQ, 9007199254740992)) == []
    assert docs.select(wire.encode_fields(F.col("name"), F.col("fields")) == F.col("json")).first()[0]
    made = dyn(spark, a={"n": 5, "d": 2.5, "s": 'q"\\\\x', "b": b"\\x00\\xff", "t": True, "z": None, "g": V.Geo(1.0, 2.0), "r": V.Ref("a/b"), "l": [1, "x"], "m": {"k": {"j": 1}}, "v": V.Vector((1.0, 2.0))})
    back = made.tables["w"][0].df.select(wire.encode_fields(F.lit("w/a"), F.col("fields")).alias("json"))
    both = wire.decode(back).select("fields").join(made.tables["w"][0].df.select(F.col("fields").alias("f0")))
    same = both.select(F.filter(F.map_keys("fields"), lambda k: F.col("fields")[k]["key"] != F.col("f0")[k]["key"]).alias("differ"), F.size("fields").alias("n")).first()
    assert same.differ == [] and same.n == 11


def test_indexes_keys_and_references(spark, tmp_path):
    held = indexes.parse_index_config("indexes:\n- kind: K\n  properties:\n  - name: a\n- kind: L\n")
    assert indexes.get_index(held, held[0]["id"])["kind"] == "K" and len(held[0]["id"]) == 16
    with pytest.raises(NotFound):
        indexes.get_index(held, "none")
    spark.range(100).write.parquet(str(tmp_path / "t"))
    assert indexes.stored_bytes(spark.read.parquet(str(tmp_path / "t"))) == sum(f.stat().st_size for f in (tmp_path / "t").glob("part-*"))
    keys = spark.createDataFrame([("b", None), ("a", 7), ("c", None)], "name string, id long")
    assert {(r.name, r.id) for r in mutate.complete_keys(keys, "id", 10, ["name"]).collect()} == {("a", 7), ("b", 11), ("c", 12)}
    with pytest.raises(InvalidArgument):
        mutate.reserve_ids(keys, "id")
    db = Database(spark)
    c = db.register("u", spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), key="k")
    docs = spark.createDataFrame([("u/2",), ("u/9",), ("q/2",), ("u/2/p/1",), (None,)], "ref string")
    assert [(r.ref, r.ref_document.v if r.ref_document else None) for r in lookup.dereference(docs, "ref", c).orderBy(F.asc_nulls_last("ref")).collect()] == [("q/2", None), ("u/2", "y"), ("u/2/p/1", None), ("u/9", None), (None, None)]


def test_numbers_are_gapless_over_many_tasks(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("x").alias("id_of"))
    got = numbered(df.repartition(9), ["v"], 100, "n").collect()
    assert sorted(r.n for r in got) == list(range(101, 5101)) and all(r.n == 101 + r.v for r in got)
    assert numbered(df.limit(0), ["v"], 5, "n").count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        shared_dir(Session())
    Session.sparkContext.master = "local-cluster[3,2,1024]"
    with pytest.raises(RuntimeError):
        shared_dir(Session())


@pytest.mark.parametrize("down", [False, True])
@pytest.mark.parametrize("offset, limit", [(5, 10), (11_990, 60), (20_470, 60), (30_000, 5), (0, 15_000), (19_000, None), (0, None)])
def test_deep_pages_are_lined_up_and_keys_computed_once(spark, down, offset, limit):
    n = 20_500
    k = F.col("k").cast("string")
    path = F.concat(F.lit("w/"), F.when(F.col("k") % 2 == 1, F.concat(F.lit("__id"), k, F.lit("__"))).otherwise(k))
    db = Database(spark)
    db.register("w", spark.range(n).select((F.col("id") * 7919 % n).alias("k")).repartition(5), path=path, prefix="w", virtual_ids=True)
    got = db.query(Query((Selector("w"),), order=(Order(NAME, down),), offset=offset, limit=limit))
    plan = got._jdf.queryExecution().executedPlan().toString()
    held = [int(x) for x in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", plan)]
    assert all(h <= 10_000 for h in held)
    assert not re.search(r"(TakeOrderedAndProject|Sort)[^\n]*transform\(", plan.split("== Initial Plan ==")[0])
    want = sorted(range(n), key=lambda i: (0, i, "") if i % 2 else (1, 0, str(i)), reverse=down)[offset:]
    assert [r.k for r in got.collect()] == (want if limit is None else want[:limit])


def test_a_value_is_worked_out_once_on_the_wire(spark):
    text = '{"name":"w/a","fields":{"n":{"doubleValue":"NaN"},"i":{"doubleValue":"-Infinity"},"d":{"doubleValue":1.5},"big":{"integerValue":"9007199254740993"},"z":{"nullValue":null},"odd":7,"l":{"arrayValue":{"values":[{"doubleValue":"NaN"},{"doubleValue":-2.5}]}},"v":{"mapValue":{"fields":{"__type__":{"stringValue":"__vector__"}}}}}}'
    docs = wire.decode(spark.createDataFrame([(text,)], "json string"))
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("= -Infinity") == 4 and plan.count("= NaN") <= 12  # a value of its own, of an array, of a map and of a vector
    f = docs.first().fields
    leaf = lambda k: (k["rank"], k["real"], k["num"], k["exact"])
    assert {n: leaf(f[n].key) for n in ("n", "i", "d", "big", "z", "odd")} == {
        "n": (V.NUMBER, 0, 0.0, None), "i": (V.NUMBER, 1, float("-inf"), -(1 << 63)), "d": (V.NUMBER, 1, 1.5, 1), "big": (V.NUMBER, 1, 9007199254740992.0, 9007199254740993), "z": (V.NULL, None, None, None), "odd": (V.NULL, None, None, None),
    }
    assert [leaf(x) for x in f["l"].key["items"]] == [(V.NUMBER, 0, 0.0, None), (V.NUMBER, 1, -2.5, -2)] and f["v"].key["rank"] == V.VECTOR and f["v"].key["items"] == []


@tables
def test_wire_documents_are_spread_over_all_cores(spark):
    parts = catalogue.QUERIES["wire_all_types"](spark, SF).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 2 * spark.sparkContext.defaultParallelism
