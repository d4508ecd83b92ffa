"""Streams: rebuild on change, the feedback fold, and conversation turns."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from notegraph.functions.text import round4
from notegraph.operators import feedback
from notegraph.settings import DEFAULT, Settings
from notegraph.shipping import ship
from notegraph.sources.readers import FEEDBACK, event_time, list_notes, listing_diff

LEAST_QUERY, LEAST_ANSWER = 3, 20


def injections(turns: DataFrame) -> DataFrame:
    """turns(session, turn, role, text): one row a session and turn, of real messages long enough.

    On a stream with a watermark column ``ts`` repeats are dropped within the watermark.
    """
    real = turns.where((F.length("text") >= LEAST_QUERY) & (F.col("role") != "system"))
    if turns.isStreaming:
        return real.dropDuplicatesWithinWatermark(["session", "turn"])
    return real.withColumn("_r", F.row_number().over(Window.partitionBy("session", "turn").orderBy("text"))).where("_r = 1").drop("_r")


def feedback_source(spark: SparkSession, folder: str, days: int = 30) -> DataFrame:
    """A stream of feedback records from JSON lines; late ones are those older than ``days`` days."""
    raw = spark.readStream.schema(FEEDBACK).option("mode", "DROPMALFORMED").json(folder)
    return raw.withColumn("ts", event_time(F.coalesce("timestamp", "ts"))).drop("timestamp").where("ts is not null").withWatermark("ts", f"{days} days")


def feedback_days(records: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """A stream of feedback (``feedback_source``) by day and edge: day, src, dst, consumed, ignored, delta.

    A day's row is given once, when the watermark has passed its end; its state goes then. A
    record of a closed day, later than the source's bound, is dropped and counted in the query's progress (``late_rows``).
    """
    rows = feedback.edge_rows(records)
    used = F.col("event") != "ignored"
    by_day = rows.groupBy(F.window("ts", "1 day").alias("day"), "src", "dst").agg(
        F.count_if(used).alias("consumed"), F.count_if(~used).alias("ignored"), round4(F.sum(feedback.amount_of(F.col("event"), s))).alias("delta")
    )
    return by_day.select(F.to_date("day.start").alias("day"), "src", "dst", "consumed", "ignored", "delta")


def start_feedback_days(records: DataFrame, out: str, checkpoint: str, s: Settings = DEFAULT):
    """Starts a query that appends closed days to the Parquet folder ``out``."""
    return feedback_days(records, s).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def late_rows(query) -> int:
    """Rows that a query's state has dropped as too late, over all its progress."""
    return sum(x.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for x in json.loads(p.json if hasattr(p, "json") else json.dumps(p))["stateOperators"])


class Snapshots:
    """Versions of a table as folders, with a one-row pointer; readers see whole versions only.

    The pointer also keeps what the writer says of the version (``note``).
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _said(self) -> dict:
        path, fs = self._pointer()
        return json.loads(self.spark.read.text(f"{self.root}/CURRENT").first()[0]) if fs.exists(path) else {}

    def read(self) -> DataFrame | None:
        version = self.current()
        return None if version is None else self.spark.read.parquet(f"{self.root}/{version}")

    def current(self) -> str | None:
        return self._said().get("version")

    def note(self) -> dict:
        return self._said().get("note", {})

    def write(self, table: DataFrame, version: str | None = None, note: dict | None = None) -> str:
        """Writes a version, then moves the pointer; writing the current version again does nothing."""
        version = version or uuid.uuid4().hex
        if self.current() == version:
            return version
        table.write.mode("overwrite").parquet(f"{self.root}/{version}")
        # Written beside and renamed over, so that readers find the old pointer or the new one.
        path, fs = self._pointer()
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsparkSession.sessionState().newHadoopConf()
        part = hadoop.Path(f"{self.root}/.{uuid.uuid4().hex}.tmp")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps({"version": version, "note": note or {}}).encode()))
        out.close()
        over = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(path.toUri(), conf).rename(part, fs.makeQualified(path), over)
        return version


def fold_feedback(records: DataFrame, store: Snapshots, checkpoint: str, s: Settings = DEFAULT):
    """Starts a query that folds every batch of records into the next snapshot of the weights, once.

    Snapshots are named by the query's id, which its checkpoint keeps, and the batch, so that a replayed batch
    is known. A query with another checkpoint that takes the store over reads the log from its
    beginning: it leaves out records no later than the last that was folded before.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        owner = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        version, before, said = f"{owner}-{epoch:09d}", store.read(), store.note()
        if store.current() == version:
            return
        floor = said.get("floor") if said.get("owner") == owner else said.get("until")
        fresh = batch if floor is None else batch.where(F.unix_micros("ts") > floor)
        last = fresh.agg(F.max(F.unix_micros("ts"))).first()[0]
        until = max((x for x in (last, said.get("until")) if x is not None), default=None)
        delta = feedback.deltas(feedback.edge_events(fresh), s)
        empty = spark.createDataFrame([], "src string, dst string, type string, weight double, use_count int, last_updated double, last_touch double")
        store.write(feedback.apply_deltas(before if before is not None else empty, delta, s).drop("change"), version, {"owner": owner, "floor": floor, "until": until})

    return records.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(spark: SparkSession, root: str, store: Snapshots, rebuild: Callable[[DataFrame], None]) -> dict[str, int]:
    """One look at a folder: on any difference from the last listing, rebuild(changes), then keep the listing."""
    now = list_notes(spark, root)
    old = store.read()
    changes = listing_diff(old if old is not None else now.limit(0), now).cache()
    counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    if counts:
        rebuild(changes)
        store.write(now)
    changes.unpersist()
    return counts


class TurnEnd(StatefulProcessor):
    """Joins a turn's assistant texts and says whether to ingest them and what they cite.

    Rows of a session: role (user, assistant, end), text, titles (retrieved, on user rows).
    State is the open turn: texts since it began, null before the first, and the titles shown to it. With ``idle`` seconds and rows
    that have an event time ts, a session without rows for so long by the watermark is abandoned: its open turn goes.
    Rows are plain rows: a session has few a batch, so that frames would cost more than what they hold.
    """

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "text string, titles array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        held = self.open.get()
        before = (held[0], list(held[1])) if held is not None else (None, [])
        text, titles = before
        said = sorted(rows, key=lambda r: (r.seq is None, r.seq))  # a session's rows of one batch
        for r in said:
            if r.role == "user":
                text, titles = None, list(r.titles) if r.titles is not None else []
            elif r.role == "assistant":
                if r.text is not None:
                    text = r.text if text is None else f"{text}\n{r.text}"
            else:
                whole = text or ""
                yield Row(session=key[0], text=whole, ingest=len(whole) >= LEAST_ANSWER, cited=[t for t in titles if t and t in whole])
                text, titles = None, []
        left = text is not None or bool(titles)
        if left and (held is None or (text, titles) != before):
            self.open.update((text, titles))
        elif not left and held is not None:
            self.open.clear()
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if left:
                self.handle.registerTimer(max(r.at_ms for r in said) + self.idle * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.open.clear()
        yield from ()

    def close(self) -> None:
        pass


def _turn_ends(messages: DataFrame) -> DataFrame:
    order = Window.partitionBy("session").orderBy("seq")
    # A turn begins with a user's message and after an end.
    opens = F.when((F.col("role") == "user") | (F.lag("role").over(order) == "end"), 1).otherwise(0)
    turns = messages.withColumn("_opens", opens).withColumn("_turn", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("seq", "text"))))
    one = turns.groupBy("session", "_turn").agg(
        F.array_join(F.transform(said, lambda x: x["text"]), "\n").alias("text"), F.bool_or(F.col("role") == "end").alias("ended"),
        F.coalesce(F.first(F.when(F.col("role") == "user", F.col("titles")), True), F.array().cast("array<string>")).alias("titles"),
    )
    cited = F.filter("titles", lambda t: (t != "") & F.contains(F.col("text"), t))
    return one.where("ended").select("session", "text", (F.length("text") >= LEAST_ANSWER).alias("ingest"), cited.alias("cited"))


_ENDS = "session string, text string, ingest boolean, cited array<string>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def turn_ends(messages: DataFrame, idle: int | None = None) -> DataFrame:
    """messages(session, seq, role, text, titles) to session, text, ingest, cited, a row for every end of a turn.

    On a stream the open turn is state, and rows of a session must not come in a batch before one with
    rows of lower seq; ``idle`` seconds, on a stream with a watermark on ts, close abandoned sessions. A table is cut
    into turns by a window.
    """
    if not messages.isStreaming:
        return _turn_ends(messages)
    ship(messages.sparkSession)
    timed = messages if idle is None else messages.withColumn("at_ms", F.unix_millis("ts"))
    keyed = timed.withColumn("session", F.col("session").cast("string")).groupBy("session")
    return keyed.transformWithState(TurnEnd(idle), outputStructType=_ENDS, outputMode="Append", timeMode="None" if idle is None else "EventTime")


@contextmanager
def keyed_state(spark: SparkSession):
    """Within, queries start with the state store that keyed state needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def start_turn_ends(messages: DataFrame, out: str, checkpoint: str, idle: int | None = None):
    """Starts a query that appends the ends of turns to the Parquet folder ``out``."""
    with keyed_state(messages.sparkSession):
        return turn_ends(messages, idle).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
