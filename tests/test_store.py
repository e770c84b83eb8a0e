"""A writable collection end to end: commits, conflicts, time travel, batch writes, a stream of writes and of events."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from docloom.errors import Aborted, AlreadyExists, Conflict, FailedPrecondition, InvalidArgument, NotFound
from docloom.plans.model import GT, Avg, Count, Order, Query, Selector, Where
from docloom.sources.store import Store
from docloom.streaming.watch import Heartbeat

W = (Selector("w"),)


def test_store(spark, tmp_path):
    s = Store(spark, "file://" + str(tmp_path / "s"), "w", "v int, tag string")
    assert s.current_seq() == 0 and s.live().count() == 0
    early, late = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc)
    s.commit(s.writes([("insert", "w/a", {"v": 1, "tag": "x"}), ("upsert", "w/b", {"v": 5})]), time=early)
    with pytest.raises(AlreadyExists):
        s.create("w/a", {"v": 2})
    with pytest.raises(NotFound):
        s.commit(s.writes([("update", "w/none", {"v": 2}), ("upsert", "w/c", {"v": 2})]))
    with pytest.raises(Conflict):
        s.commit(s.writes([("upsert", "w/a", {"v": 2})], base_version=7))
    with pytest.raises(FailedPrecondition):
        s.commit(s.writes([("upsert", "w/new", {"v": 2})], exists=True))
    with pytest.raises(InvalidArgument):
        s.writes([("upsert", "w/__bad__", {})])
    assert s.current_seq() == 2
    s.commit(s.writes([("update", "w/a", {"v": 9})]), time=late, mask=["v"])
    a = s.get("w/a")
    assert (a.v, a.tag, a.version) == (9, "x", 2) and a.create_time < a.change_time
    assert {r.path: r.v for r in s.as_of(dt.datetime(2024, 1, 1, 12)).collect()} == {"w/a": 1, "w/b": 5}
    s.delete("w/b")
    with pytest.raises(NotFound):
        s.get("w/b")
    s.create("w/b", {"v": 7})
    assert [r.path for r in s.query(Query(W, where=Where("v", GT, 6), order=(Order("v"),))).collect()] == ["w/b", "w/a"]
    assert tuple(s.aggregate(Query(W), [Count("n"), Avg("v", "a")]).first()) == (2, 8.0)
    got = {(r.path, r.status) for r in s.batch_write(s.writes([("insert", "w/a", {}), ("upsert", "w/z", {"v": 0})])).collect()}
    assert got == {("w/a", "ALREADY_EXISTS"), ("w/z", "OK")}
    assert {(r.path, r.change) for r in s.diff(F.col("v") > 3, 2).collect()} == {("w/a", "CHANGE"), ("w/b", "CHANGE")}
    one, two = s.transactions.begin(), s.transactions.begin()
    for t in (one, two):
        s.transactions.read(t, s.live().where("path = 'w/z'"))
    s.commit(s.writes([("upsert", "w/z", {"v": 1})]), transaction=one)
    with pytest.raises(Aborted):
        s.commit(s.writes([("upsert", "w/z", {"v": 2})]), transaction=two)
    assert s.get("w/z").v == 1 and s.list(2).count() == 2 and s.batch_get(["w/a", "w/q"]).where("found").count() == 1
    s.snapshot()
    before = s.live().orderBy("path").collect()
    s.upsert("w/z", {"v": 3})
    assert s.get("w/z").v == 3 and s.live().where("path <> 'w/z'").count() == len(before) - 1 and s.changes().count() == s.current_seq()


def test_read_only_transactions_cannot_write(spark, tmp_path):
    s = Store(spark, "file://" + str(tmp_path / "s"), "w", "v int")
    t = s.transactions.begin(read_only=True)
    with pytest.raises(FailedPrecondition):
        s.commit(s.writes([("insert", "w/a", {"v": 1})]), transaction=t)
    with pytest.raises(NotFound):
        s.transactions.rollback(t)
    assert s.current_seq() == 0 and not s.log.commits()
    u = s.transactions.begin(read_only=True)
    s.end(u)
    with pytest.raises(NotFound):
        s.end(u)


def test_writes_to_one_path_go_in_order(spark, tmp_path):
    s = Store(spark, "file://" + str(tmp_path / "s"), "w", "v int, tag string")
    with pytest.raises(AlreadyExists):
        s.commit(s.writes([("insert", "w/a", {"v": 1}), ("insert", "w/a", {"v": 2})]))
    assert s.current_seq() == 0
    s.commit(s.writes([("insert", "w/a", {"v": 1}), ("upsert", "w/b", {"v": 5}), ("update", "w/a", {"v": 2}), ("delete", "w/a", {}), ("insert", "w/a", {"v": 3})]))
    assert [(r.seq, r.path, r.version, r.deleted, r.v) for r in s.changes().orderBy("seq").collect()] == [(1, "w/a", 1, False, 1), (2, "w/b", 1, False, 5), (3, "w/a", 2, False, 2), (4, "w/a", 3, True, None), (5, "w/a", 4, False, 3)]
    times = [r.change_time for r in s.changes().orderBy("seq").collect()]
    assert all(b - a >= dt.timedelta(milliseconds=1) for a, b in zip(times, times[1:], strict=False))
    got = s.batch_write(s.writes([("insert", "w/a", {}), ("delete", "w/a", {}), ("insert", "w/a", {"v": 7}), ("update", "w/x", {})])).orderBy("place").collect()
    assert [r.status for r in got] == ["ALREADY_EXISTS", "OK", "OK", "NOT_FOUND"] and [r.version for r in got] == [None, 5, 6, None]
    assert got[1].update_time > times[-1] and s.get("w/a").v == 7


def test_masks_transforms_and_update_times(spark, tmp_path):
    s = Store(spark, "file://" + str(tmp_path / "s"), "w", "n long, d double, at timestamp, tags array<string>, m struct<x: int, y: struct<z: string, k: long>>")
    s.create("w/a", {"n": 5, "d": 1.5, "tags": ["a", "b", "a"], "m": (1, ("q", 4))})
    mask = s.writes([("update", "w/a", {"n": 1, "m": (9, ("new", None))})], masks=[["m.y.z", "m.y.k", "d"]])
    s.commit(mask)
    a = s.get("w/a")
    assert (a.n, a.d, tuple(a.m.y), a.m.x, a.tags) == (5, None, ("new", None), 1, ["a", "b", "a"])
    first = a.change_time.replace(tzinfo=dt.timezone.utc)
    with pytest.raises(FailedPrecondition):
        s.commit(s.writes([("upsert", "w/a", {"n": 1})], update_time=first - dt.timedelta(milliseconds=1)))
    with pytest.raises(FailedPrecondition):
        s.commit(s.writes([("upsert", "w/none", {"n": 1})], update_time=first))
    wanted = [("n", "increment", 3), ("d", "increment", 2), ("d", "maximum", 7.5), ("n", "minimum", 100), ("tags", "append_missing_elements", ["b", "c", "c"]), ("at", "request_time", None), ("m.y.k", "increment", 4)]
    when = dt.datetime(2030, 5, 6, tzinfo=dt.timezone.utc)
    done = s.commit(s.writes([("upsert", "w/a", {})], masks=[[]], transforms=[wanted], update_time=first), time=when).writes.first()
    a = s.get("w/a")
    assert (a.n, a.d, a.tags, a.m.y.k, a.m.y.z) == (8, 7.5, ["a", "b", "a", "c", "c"], 4, "new") and a.at.replace(tzinfo=dt.timezone.utc) == when
    assert done.results[:2] == ["8", "7.5"] and done.results[4] == '["a","b","a","c","c"]' and done.results[6] == "4" and done.version == 3
    two = s.writes([("upsert", "w/a", {}), ("upsert", "w/new", {"n": 1})], masks=[[], None], transforms=[[("tags", "remove_all_from_array", ["a"])], [("n", "increment", 2), ("tags", "append_missing_elements", ["x", "x"])]])
    s.commit(two)
    assert s.get("w/a").tags == ["b", "c", "c"] and (s.get("w/new").n, s.get("w/new").tags) == (3, ["x", "x"])
    with pytest.raises(InvalidArgument):
        s.writes([("upsert", "w/a", {})], transforms=[[("n", "double", 2)]])


def test_overtaken_writers_are_aborted(spark, tmp_path):
    root = "file://" + str(tmp_path / "s")
    one, two = Store(spark, root, "w", "v int"), Store(spark, root, "w", "v int")
    one.create("w/a", {"v": 1})
    number = one.log.next_number()
    read = two._append

    def slow(*args, **kw):
        one.upsert("w/a", {"v": 2})  # the other publishes while this one has judged its writes
        return read(*args, **kw)

    two._append = slow
    with pytest.raises(Aborted):
        two.upsert("w/a", {"v": 3})
    assert one.get("w/a").v == 2 and one.current_seq() == 2 and one.log.next_number() == number + 1
    one.log._lock(2)  # a writer that holds the number
    with pytest.raises(Aborted):
        one.upsert("w/a", {"v": 4})
    assert one.current_seq() == 2


def test_streams(spark, tmp_path):
    s = Store(spark, "file://" + str(tmp_path / "s"), "w", "v int")
    spark.createDataFrame([("upsert", "w/a", 1), ("upsert", "w/b", 9)], "op string, path string, v int").write.parquet(str(tmp_path / "in"))
    beat = Heartbeat()
    spark.streams.addListener(beat.listener)
    q = spark.readStream.schema("op string, path string, v int").parquet(str(tmp_path / "in")).writeStream.foreachBatch(s.sink).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert s.live().count() == 2
    s.changes().withColumn("path", F.lit("w/lost")).write.parquet(s.log.staging())  # a writer that never published
    e = s.watch({"big": F.col("v") > 3}).writeStream.format("memory").queryName("store_events").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    e.awaitTermination(120)
    spark.streams.removeListener(beat.listener)
    assert [(r.path, r.change) for r in spark.sql("select * from store_events").collect()] == [("w/b", "CHANGE")]


def test_replayed_batches_are_left_out(spark, tmp_path):
    s = Store(spark, "file://" + str(tmp_path / "s"), "w", "v int")
    one = spark.createDataFrame([("upsert", "w/a", 1)], "op string, path string, v int")
    s.sink(one, 0)
    s.sink(one, 1)
    s.upsert("w/b", {"v": 1})
    s.sink(one, 1)
    s.sink(one, 0, stream="other")
    assert s.get("w/a").version == 3 and s.log.last_batch("sink") == 1 and s.log.last_batch("none") is None
    w = s.write_stream()
    first = w.token
    assert w.write(first, None) == (first, None)
    second, done = w.write(first, s.writes([("insert", "w/c", {"v": 2})]))
    assert second != first and done.writes.first().status == "OK" and s.get("w/c").v == 2
    with pytest.raises(InvalidArgument):
        w.write(first, None)


def test_heartbeats_and_runtime(spark, tmp_path):
    from docloom.sources import oplog
    from docloom.streaming import watch

    q = watch.heartbeats(spark, ["a", "b"], 1).writeStream.format("memory").queryName("beats").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(60):
            q.processAllAvailable()
            if spark.sql("select * from beats").count() >= 4:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    got = spark.sql("select target, change from beats").distinct().collect()
    assert {tuple(r) for r in got} == {("a", "NO_CHANGE"), ("b", "NO_CHANGE")}
    now = oplog.runtime(spark)
    assert now["executors"] >= 1 and now["parallelism"] >= 1 and now["uptime_ms"] > 0
