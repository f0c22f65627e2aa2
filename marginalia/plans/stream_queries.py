"""Streaming jobs run to their end over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, history, telemetry
from ..streaming import jobs
from .answer_queries import usage_of
from .corpus_queries import TOKENS, shared
from .registry import ORACLE_SQL, load, query


def _source(spark, d, name: str):
    table = load(spark, d, name)
    if any(f.rstrip("/").endswith(f"/{name}.parquet") for f in table.inputFiles()[:1]):  # one file, not a folder of files
        return spark.readStream.schema(table.schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return spark.readStream.schema(table.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet")


def _split(df):
    return chunking.split_chars(df, 800, 100)


@query("stream_ingest", f"""SELECT source || '.' || lang AS doc, count(*) AS n_chunks FROM (SELECT source, lang, doc_id, unnest(range(0, greatest(0, ceil((length(text) - 800) / 700.0))::BIGINT + 1)) AS i FROM documents WHERE length(text) > 0) GROUP BY 1""")
def stream_ingest(spark, d):
    """Documents ingested from a stream, twice: the second run finds nothing new."""
    path = shared(spark, "ingest")
    for run in range(2):
        stream = _source(spark, d, "documents").select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("doc_name"), F.concat(F.lit("."), "lang").alias("ext"), "text")
        jobs.ingest_stream(stream, path, f"{path}-check{run}", _split).awaitTermination()
    corpus = jobs.Versions(spark, path).read("corpus", jobs.CORPUS)
    return corpus.groupBy(F.concat(F.regexp_extract("doc_name", "^([^/]*)/", 1), "ext").alias("doc")).agg(F.count("*").alias("n_chunks"))


@query("stream_index_refresh", f"WITH w AS (SELECT unnest(list_distinct({TOKENS})) AS term FROM documents) SELECT term, count(*) AS df FROM w GROUP BY term")
def stream_index_refresh(spark, d):
    """Term table of the index that the streaming ingest keeps."""
    path = shared(spark, "refresh")
    stream = _source(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_name"), F.lit("").alias("ext"), "text")
    jobs.ingest_stream(stream, path, f"{path}-check", lambda df: df.withColumn("chunk_index", F.lit(0).cast("long")).withColumn("chunk_text", F.col("text"))).awaitTermination()
    return jobs.Versions(spark, path).read("terms", jobs.TERMS)


@query("stream_session_tail", "WITH h AS (SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, CASE role WHEN 'user' THEN 'human' ELSE 'ai' END AS role, turn FROM conversations WHERE role IN ('user', 'assistant')), k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS n FROM h QUALIFY n <= 4) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY n DESC) AS pos, id, role FROM k")
def stream_session_tail(spark, d):
    path = shared(spark, "tail")
    tails = jobs.tail_sessions(history.as_history(_source(spark, d, "conversations")), 4)
    jobs.with_batch(tails, path, f"{path}-check").awaitTermination()
    rows = spark.read.schema("session_id long, pos long, created_at long, id long, role string, content string, batch int").parquet(path)
    return jobs.last_state(rows).select("session_id", "pos", "id", "role")


@query("stream_counters", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def stream_counters(spark, d):
    name = "counters_" + shared(spark, "").rpartition("-")[2]
    q = jobs.running_counters(_source(spark, d, "events").select("event_type", "value")).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", shared(spark, "counters")).start()
    q.awaitTermination()
    return spark.table(name)


FINAL = "CASE WHEN lang = 'de' THEN 'neu ' || text ELSE text END"


def _revisions(spark, d):
    """The documents as two streams find them: German texts change in between."""
    for run in range(2):
        text = F.when((F.col("lang") == "de") & F.lit(run == 1), F.concat(F.lit("neu "), "text")).otherwise(F.col("text"))
        yield _source(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_name"), F.lit(".md").alias("ext"), text.alias("text"))


@query("stream_replace", f"SELECT doc_id, greatest(0, ceil((length(t) - 800) / 700.0))::BIGINT + 1 AS n_chunks, md5(substring(t, 1, 800)) AS first FROM (SELECT doc_id, {FINAL} AS t FROM documents) WHERE length(t) > 0")
def stream_replace(spark, d):
    """Documents ingested twice; the second run finds German texts changed and replaces these alone."""
    path = shared(spark, "replace")
    for run, stream in enumerate(_revisions(spark, d)):
        jobs.ingest_stream(stream, path, f"{path}-check{run}", _split).awaitTermination()
    corpus = jobs.Versions(spark, path).read("corpus", jobs.CORPUS)
    first = F.max(F.when(F.col("chunk_index") == 0, F.md5("chunk_text"))).alias("first")
    return corpus.groupBy(F.col("doc_name").cast("long").alias("doc_id")).agg(F.count("*").alias("n_chunks"), first)


@query("stream_parse_replace", f"WITH w AS (SELECT unnest(list_distinct({TOKENS})) AS term FROM (SELECT {FINAL} AS text FROM documents)) SELECT term, count(*) AS df FROM w GROUP BY term")
def stream_parse_replace(spark, d):
    """Upload, parse, replace and index refresh in one job: page marks that the parse step removes never reach the index."""
    path = shared(spark, "parse")
    whole = lambda df: df.withColumn("chunk_index", F.lit(0).cast("long")).withColumn("chunk_text", F.col("text"))
    for run, stream in enumerate(_revisions(spark, d)):
        marked = stream.withColumn("text", F.concat("text", F.lit(" RN(7)")))
        jobs.ingest_stream(marked, path, f"{path}-check{run}", whole, jobs.clean_for_corpus).awaitTermination()
    return jobs.Versions(spark, path).read("terms", jobs.TERMS)


USAGE = """SELECT event_type AS kind, ts, value, event_id % 500 = 0 AS reset, coalesce(json_extract(props, '$.k')::BIGINT, 0) AS p, CASE WHEN event_type <> 'error' THEN coalesce(json_extract(props, '$.k')::BIGINT * 2, 0) ELSE 0 END AS c,
 CASE event_type WHEN 'click' THEN 0.03 ELSE 0.001 END::DOUBLE AS i, CASE event_type WHEN 'click' THEN 0.06 ELSE 0.002 END::DOUBLE AS o FROM events"""


@query("stream_usage_counters", f"""WITH e AS ({USAGE}), r AS (SELECT kind, max(ts) FILTER (reset) AS since FROM e GROUP BY kind), x AS (SELECT e.* FROM e JOIN r USING (kind) WHERE NOT reset AND (since IS NULL OR ts > since))
 SELECT r.kind, count(x.ts) AS n, round(coalesce(sum(value), 0), 4) AS total, coalesce(sum(p), 0)::BIGINT AS prompt_tokens, coalesce(sum(c), 0)::BIGINT AS completion_tokens, round(coalesce(sum((p * i + c * o) / 1000), 0), 4) AS cost FROM r LEFT JOIN x ON x.kind = r.kind GROUP BY r.kind""")
def stream_usage_counters(spark, d):
    """Calls, latency, tokens and cost by kind since its last reset; each 500th event resets its kind."""
    path = shared(spark, "usage")
    events = _source(spark, d, "events")
    rows = usage_of(events).select(F.col("event_type").alias("kind"), "ts", F.col("value").alias("latency"), "model", "prompt_tokens", "completion_tokens", (F.col("event_id") % 500 == 0).alias("reset"))
    jobs.with_batch(jobs.usage_counters(rows, telemetry.price_table(spark)), path, f"{path}-check").awaitTermination()
    last = jobs.last_state(spark.read.schema(f"kind string, {jobs.TOTALS}, batch long").parquet(path), key="kind")
    return last.select("kind", "n", F.round("total", 4).alias("total"), "prompt_tokens", "completion_tokens", F.round("cost", 4).alias("cost"))


@query("stream_telemetry_daily", ORACLE_SQL["telemetry_daily"])
def stream_telemetry_daily(spark, d):
    """Events written by the day, from a stream, and read back."""
    path = shared(spark, "telemetry")
    events = _source(spark, d, "events").select("event_id", F.col("ts").cast("string").alias("timestamp"), "event_type")
    jobs.telemetry_stream(events, path, f"{path}-check").awaitTermination()
    return telemetry.telemetry_daily(spark.read.schema("event_id long, timestamp string, event_type string").json(path).withColumn("ts", F.col("timestamp").cast("timestamp")))


@query("stream_history_append", ORACLE_SQL["history_append"])
def stream_history_append(spark, d):
    """User turns come as a stream, meet their replies and are appended to a history."""
    path = shared(spark, "history")
    reply = load(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    turns = _source(spark, d, "conversations").filter("role = 'user'").join(reply, ["conv_id", "turn"], "left").select(F.col("conv_id").alias("session_id"), F.col("turn"), F.col("text").alias("question"), "answer")
    jobs.history_stream(turns, path, f"{path}-check").awaitTermination()
    return spark.read.parquet(path)
