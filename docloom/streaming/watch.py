"""Watching a query: what enters, changes, leaves or is deleted, as a stream.

State is one row for each (target, path): whether the document was sent, and
the last sequence number, which drops what arrives out of order.  ``opened`` is
what a target gets first, ``watch`` what follows; a target is removed by leaving
it out of the next ``watch``, or at once by ``once``.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import InvalidArgument

OUT = "target string, path string, seq long, change string"
STATE = "sent boolean, seq long"


#: Markers of a target beside the changes of its documents.
ADD, CURRENT, NO_CHANGE, REMOVE_TARGET = "ADD", "CURRENT", "NO_CHANGE", "REMOVE_TARGET"


def targets(changes: DataFrame, matches: dict[str, Column]) -> DataFrame:
    """One row for each change and target: the predicate of each target as a column of its own, exploded."""
    each = F.array(*[F.struct(F.lit(t).alias("target"), F.coalesce(m, F.lit(False)).alias("hit")) for t, m in matches.items()])
    return changes.select("path", "seq", "deleted", F.explode(each).alias("t")).select("t.target", "path", "seq", "deleted", F.col("t.hit").alias("hit"))


def step(sent: bool, hit: bool, deleted: bool) -> tuple[str | None, bool]:
    """The event of one change, and whether the document counts as sent behind it."""
    if hit and not deleted:
        return "CHANGE", True
    if sent:
        return ("DELETE" if deleted else "REMOVE"), False
    return None, False


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    target, path = key
    rows = pd.concat(list(frames)).sort_values("seq")  # one document's changes within a micro-batch
    sent, last = state.get if state.exists else (bool(rows["was_sent"].iloc[0]), -1)
    out = []
    for r in rows.itertuples():
        if r.seq <= last:
            continue
        last = int(r.seq)
        kind, sent = step(sent, bool(r.hit), bool(r.deleted))
        if kind:
            out.append((target, path, last, kind))
    state.update((sent, last))
    yield pd.DataFrame(out, columns=["target", "path", "seq", "change"])


def watch(changes: DataFrame, matches: dict[str, Column], sent: DataFrame | None = None) -> DataFrame:
    """Events of a stream of changes (path, seq, deleted and columns) for one or more targets.

    ``sent``: (target, path) of documents that a resumed target was sent before
    (``sent_paths``): what a document counts as until its first change here.
    """
    each = targets(changes, matches)
    if sent is None:
        each = each.withColumn("was_sent", F.lit(False))
    else:
        each = each.join(sent.select("target", "path", F.lit(True).alias("was_sent")), ["target", "path"], "left").withColumn("was_sent", F.coalesce("was_sent", F.lit(False)))
    return each.groupBy("target", "path").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def events_batch(changes: DataFrame, matches: dict[str, Column]) -> DataFrame:
    """The same events over a finite log, by a window: the state before a change is the match of the change before."""
    from pyspark.sql import Window as W

    t = targets(changes, matches).withColumn("now", F.col("hit") & ~F.col("deleted"))
    before = F.coalesce(F.lag("now").over(W.partitionBy("target", "path").orderBy("seq")), F.lit(False))
    kind = F.when(F.col("now"), "CHANGE").when(before & F.col("deleted"), "DELETE").when(before, "REMOVE")
    return t.withColumn("change", kind).where("change is not null").select("target", "path", "seq", "change")


def snapshot(live: DataFrame, matches: Column, target: str, seq: int) -> DataFrame:
    """What a new target gets first: its present documents, to be followed by changes behind ``seq``."""
    return live.where(matches).select(F.lit(target).alias("target"), "path", F.lit(seq).alias("seq"), F.lit("CHANGE").alias("change"))


def token(seq: int, stream_id: str) -> str:
    """A resume token: the position, and the stream that it is a position of."""
    return base64.urlsafe_b64encode(json.dumps({"seq": seq, "stream": stream_id}).encode()).decode()


def read_token(text: str) -> tuple[int, str]:
    try:
        held = json.loads(base64.urlsafe_b64decode(text.encode()))
        return int(held["seq"]), str(held["stream"])
    except (ValueError, KeyError, TypeError) as e:
        raise InvalidArgument("this is no resume token") from e


def opened(log: DataFrame, matches: Column, target: str, seq: int, stream_id: str, *, resume_token: str | None = None, read_time=None, once: bool = False) -> DataFrame:
    """All that a target gets when it is added at position ``seq`` of a log: place, target, path, change, token.

    ADD; its documents (all of them, or for a token of this stream or a read
    time what has changed since: changed, left or deleted ones); CURRENT; and
    NO_CHANGE with the token to resume from, which closes the snapshot.  A token
    of another stream gives all documents again.  ``once``: the target is
    removed behind its snapshot.
    """
    from ..operators import changes

    since = None
    if resume_token is not None:
        position, of = read_token(resume_token)
        since = position if of == stream_id else None
    upto = log.where(F.col("seq") <= seq)
    if since is not None:
        docs = changes.diff(upto, matches, since, seq).select("path", "change")
    elif read_time is not None:
        docs = changes.diff_time(upto, matches, read_time).select("path", "change")
    else:
        docs = changes.live(upto).where(F.coalesce(matches, F.lit(False))).select("path", F.lit("CHANGE").alias("change"))
    spark, at = log.sparkSession, token(seq, stream_id)
    marks = [(0, target, None, ADD, None), (2, target, None, CURRENT, at), (3, target, None, NO_CHANGE, at)] + [(4, target, None, REMOVE_TARGET, None)] * once
    marked = spark.createDataFrame(marks, "place int, target string, path string, change string, token string")
    return marked.unionByName(docs.select(F.lit(1).alias("place"), F.lit(target).alias("target"), "path", "change", F.lit(None).cast("string").alias("token")))


def sent_paths(log: DataFrame, matches: dict[str, Column], seq: int) -> DataFrame:
    """(target, path) of the documents that each target had been sent at a position: those that matched."""
    from ..operators import changes

    return targets(changes.live(log.where(F.col("seq") <= seq)), matches).where("hit and not deleted").select("target", "path")


def documents_target(paths: list[str]) -> Column:
    """A target of named documents."""
    return F.col("path").isin(paths)


def resume(log: DataFrame, *, seq: int | None = None, time=None) -> DataFrame:
    """The changes behind a resume token (a sequence number) or a read time."""
    return log.where(F.col("seq") > seq) if seq is not None else log.where(F.col("change_time") > F.lit(time))


def heartbeats(spark, targets_of: list[str], seconds: int = 5) -> DataFrame:
    """A stream of NO_CHANGE markers, one for each target every so many seconds, to be sent beside its events."""
    beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load().where(F.col("value") % seconds == 0)
    return beat.select(F.explode(F.array(*[F.lit(t) for t in targets_of])).alias("target"), F.lit(None).cast("string").alias("path"), F.col("timestamp").alias("read_time"), F.lit(NO_CHANGE).alias("change"))


class Heartbeat:
    """Counts progress and idle reports of streaming queries (attach with ``spark.streams.addListener(Heartbeat().listener)``)."""

    def __init__(self):
        from pyspark.sql.streaming import StreamingQueryListener

        beat = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                beat.started += 1

            def onQueryProgress(self, event):
                beat.progress += 1

            def onQueryIdle(self, event):
                beat.idle += 1

            def onQueryTerminated(self, event):
                beat.ended += 1

        self.started = self.progress = self.idle = self.ended = 0
        self.listener = Listener()
