"""Structured Streaming jobs: incremental ingest and index, session tails, running counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues
from pyspark.sql.types import StructType

from ..functions import text as tx
from ..operators import history, telemetry
from ..operators.stored_index import StoredIndex
from ..sources import files


CORPUS = "doc_name string, ext string, chunk_index long, chunk_text string"
SEEN = "doc_name string, ext string, hash string"
POSTINGS = "term string, id string, tf long, dl long"
TERMS = "term string, df long"
STATS = "n_docs long, n_tokens long"
#: A job's shuffles leave the disk when it ends; what is dealt by name meets tables bucketed by name where it lies.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


def ingest(docs: DataFrame, seen: DataFrame, corpus: DataFrame, splitter) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, seen, changed): documents(doc_name, ext, text) that changed replace their chunks; a document without chunks is remembered too."""
    changed = files.changed_documents(files.one_each(docs.withColumn("hash", F.md5("text"))), seen)
    cut = splitter(changed).select("doc_name", "ext", "chunk_index", "chunk_text")
    names = changed.select("doc_name", "ext")
    kept = corpus.join(names, ["doc_name", "ext"], "left_anti").select("doc_name", "ext", "chunk_index", "chunk_text").unionByName(cut)
    known = seen.join(names, ["doc_name", "ext"], "left_anti").select("doc_name", "ext", "hash").unionByName(changed.select("doc_name", "ext", "hash"))
    return kept, known, changed


class Versions(StoredIndex):
    """Corpus, remembered hashes and text index of a job as segments under one log, so that a batch changes all or none.

    A batch is known by its checkpoint and number, and is not applied twice; whatever checkpoint it comes from, its
    segments come after all that are named. One job at a time may write.
    """

    MORE = {"chunks": (CORPUS, "doc_name"), "seen": (SEEN, "doc_name")}

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, **options) -> None:
        """buckets: by default as many as Spark has shuffle partitions, as a task holds and sorts a bucket; a stored index keeps its own."""
        super().__init__(spark, path, "string", buckets=buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), more=self.MORE, **options)

    def live_seen(self) -> DataFrame:
        """doc_name, ext, hash, seq: the last hash of each document and its segment."""
        return self.table("seen").groupBy("doc_name", "ext").agg(F.max_by("hash", "seq").alias("hash"), F.max("seq").alias("seq"))

    def live(self, name: str) -> DataFrame:
        if name == "seen":
            return self.live_seen().drop("seq")
        if name == "chunks":
            return self.table("chunks").join(self.live_seen().drop("hash"), ["doc_name", "ext", "seq"]).drop("seq")
        return super().live(name)

    def read(self, name: str, schema: str) -> DataFrame:
        """The live rows of corpus, seen, postings, terms or stats."""
        columns = StructType.fromDDL(schema).names
        if not self.lines:
            return self.spark.createDataFrame([], schema)
        return (self.index().stats if name == "stats" else self.live("chunks" if name == "corpus" else name)).select(*columns)

    def replace(self, docs: DataFrame, splitter, job: str = "", batch: int = 0, parse: Callable[[DataFrame], DataFrame] | None = None) -> bool:
        """Documents(doc_name, ext, text) that changed replace what is there, corpus and index in one segment; whether any did.

        A document is known by the hash of its text as it came; parse, if any, cleans it before it is cut. One without
        chunks is remembered too; of several rows of one document that with the smallest hash counts. Only hashes are read of what is stored,
        and the postings of segments that hold a changed document.

        Nothing is cached, as texts and chunks would lie on disk once more. Hashes alone are compared first; texts are then dealt once, into the buckets
        in which their chunks are written; the index is made from these chunks where they lie.
        """
        hashed = docs.withColumn("hash", F.md5("text"))
        changed = lambda rows: files.changed_documents(files.one_each(rows), self.live_seen())
        seq = self.begin()
        self.write("seen", changed(hashed.select("doc_name", "ext", "hash")), seq)
        if not self.table("seen", [seq]).limit(1).count():
            return False
        rows = changed(hashed.repartition(self.buckets, "doc_name"))
        self.write("chunks", splitter(parse(rows) if parse else rows), seq, dealt=True)
        key = F.concat_ws("", "doc_name", "ext").alias("id")
        texts = self.table("chunks", [seq]).groupBy("doc_name", "ext").agg(joined_chunks().alias("text"))
        self.add(texts.select(key, "text"), self.table("seen", [seq]).select(key), job, batch, seq)
        return True


def ingest_stream(stream: DataFrame, path: str, checkpoint: str, splitter, parse: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Streaming ingest of documents into corpus, seen and text index under path: each batch writes a segment of the documents that changed. Runs what is there and ends."""

    def batch(docs: DataFrame, n: int) -> None:
        for name, value in LEAN.items():  # in the stream's own session
            docs.sparkSession.conf.set(name, value)
        store = Versions(docs.sparkSession, path)
        if not store.applied(checkpoint, n):
            store.replace(docs, splitter, checkpoint, n, parse)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def joined_chunks():
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda x: x.chunk_text), "\n")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE = "created_at long, id long, role string, content string"
_FIELDS = ("created_at", "id", "role", "content")


class SessionTail(StatefulProcessor):
    """State of one session: its last n messages as a list, and the timer that ends an idle session."""

    def __init__(self, n: int, idle_ms: int | None) -> None:
        self.n, self.idle = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getListState("tail", MESSAGE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        order = lambda m: (m[0], m[1], m[2] or "", m[3] or "")
        last, latest = list(self.tail.get()), 0
        for pdf in rows:  # as many pieces as Spark likes; only n messages stay of each
            last = sorted(set(map(tuple, last)) | set(zip(*(pdf[f].tolist() for f in _FIELDS), strict=True)), key=order)[-self.n :]
            if self.idle is not None:
                latest = max(latest, int(pdf["at"].max().timestamp() * 1000))
        self.tail.put(last)
        if self.idle is not None:
            timers = list(self.handle.listTimers())
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max([*timers, latest + self.idle]))
        yield pd.DataFrame([(key[0], i + 1, *m, False) for i, m in enumerate(last)], columns=["session_id", "pos", *_FIELDS, "expired"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = list(self.tail.get())
        self.tail.clear()
        yield pd.DataFrame([(key[0], i + 1, *m, True) for i, m in enumerate(last)], columns=["session_id", "pos", *_FIELDS, "expired"])

    def close(self) -> None:
        pass


def session_tails(stream: DataFrame, n: int = 10, idle_ms: int | None = None, late: str = "1 hour") -> DataFrame:
    """The last n messages of each session so far, by (created_at, id), from stream(id, session_id, role, content, created_at long): session_id, pos, the message, expired.

    Update mode: each batch gives the whole tail of the sessions it touches. State lives in RocksDB, n messages a session. A late
    message never pushes out a newer one; a message sent twice counts once; a null time or id counts as 0.
    With idle_ms the stream has a timestamp `at`, too: once the watermark, `late` behind the latest message of all, is so far beyond a
    session's last message, the session gives its tail once more, marked expired, and leaves the state; it starts anew if it goes
    on. Messages behind the watermark are left out then, as their session may be gone.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = f"session_id {dict(stream.dtypes)['session_id']}, pos long, {MESSAGE}, expired boolean"
    stream = stream.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("created_at", "id")})
    rows = stream.select("session_id", *_FIELDS) if idle_ms is None else stream.filter("at is not null").select("session_id", *_FIELDS, "at").withWatermark("at", late)
    return rows.groupBy("session_id").transformWithStateInPandas(SessionTail(n, idle_ms), schema, "update", "None" if idle_ms is None else "EventTime")


def tail_sessions(stream: DataFrame, n: int = 10) -> DataFrame:
    """session_tails of sessions that never end."""
    return session_tails(stream, n).drop("expired")


TOTALS = "since timestamp, n long, total double, prompt_tokens long, completion_tokens long, cost double"
_NUMBERS = ("latency", "prompt_tokens", "completion_tokens", "cost")


class Counters(StatefulProcessor):
    """State of one kind: sums of what came after its last reset."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", TOTALS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.sums.get() if self.sums.exists() else (None, 0, 0.0, 0, 0, 0.0)
        since, sums, parts = held[0], np.array(held[1:], object), []
        reset = None if since is None else pd.Timestamp(since)
        for pdf in rows:
            again = pdf.loc[pdf["reset"], "ts"].max()
            if pd.notna(again) and (reset is None or again > reset):
                reset, sums = again, np.array((0, 0.0, 0, 0, 0.0), object)
            parts.append(pdf.loc[~pdf["reset"], ["ts", *_NUMBERS]])
        for p in parts:  # numbers of one batch of one kind
            own = p if reset is None else p[p["ts"] > reset]
            sums = sums + np.array((len(own), float(own["latency"].sum()), int(own["prompt_tokens"].sum()), int(own["completion_tokens"].sum()), float(own["cost"].sum())), object)
        n, total, prompt, completion, cost = sums
        self.sums.update((None if reset is None else reset.to_pydatetime(), int(n), float(total), int(prompt), int(completion), float(cost)))
        yield pd.DataFrame({"kind": [key[0]], "since": [reset], "n": [n], "total": [total], "prompt_tokens": [prompt], "completion_tokens": [completion], "cost": [cost]}).astype({"since": "datetime64[ns]", "n": "int64", "total": "float64", "prompt_tokens": "int64", "completion_tokens": "int64", "cost": "float64"})

    def close(self) -> None:
        pass


def usage_counters(stream: DataFrame, prices: DataFrame) -> DataFrame:
    """Running calls, latency, tokens and cost by kind of stream(kind, ts, latency, model, prompt_tokens, completion_tokens, reset): kind, since, n, total, prompt_tokens, completion_tokens, cost.

    Prices(model, p_in, p_out) are a static table joined to the stream; unknown models have the price of 'default'. A row with reset
    sets its kind to zero: rows of that kind up to its time no longer count, also where they come later. A reset that comes after
    rows with a later time takes these with it, as a counter keeps sums only. Null numbers count as 0.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    priced = telemetry.with_cost(stream.withColumn("reset", F.coalesce("reset", F.lit(False))), prices)
    rows = priced.select("kind", F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("latency").cast("double"), F.lit(0.0)).alias("latency"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens")], F.coalesce("cost", F.lit(0.0)).alias("cost"), "reset")
    return rows.groupBy("kind").transformWithStateInPandas(Counters(), f"kind string, {TOTALS}", "update", "None")


def running_counters(stream: DataFrame) -> DataFrame:
    """Latency roll-up of a stream of events, for the complete or update mode."""
    return telemetry.latency_rollup(stream)


def last_state(rows: DataFrame, order: str = "batch", key: str = "session_id") -> DataFrame:
    """Of the sink's updates, those of each key's last batch."""
    last = rows.groupBy(key).agg(F.max(order).alias(order))
    return rows.join(last, [key, order]).drop(order)


def with_batch(query_rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write updates to path, a folder for each batch: a batch that is run again replaces its folder, so each counts once. Runs what is there and ends."""

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return query_rows.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def telemetry_stream(events: DataFrame, path: str, checkpoint: str, ts: str = "timestamp") -> StreamingQuery:
    """Append a stream of events as JSON lines in one folder a day. The file sink's log of batches makes each row count once, however often the query is stopped and restarted. Runs what is there and ends."""
    daily = events.withColumn("day", F.date_format(F.col(ts).cast("timestamp"), "yyyyMMdd"))
    return daily.writeStream.format("json").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def history_stream(turns: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of turns(session_id, turn, question, answer) to a history as two rows each; every row once. Runs what is there and ends."""
    return history.append_turns(turns).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def clean_for_corpus(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", tx.clean_text(F.col("text"), F.col("ext") == ".md"))
