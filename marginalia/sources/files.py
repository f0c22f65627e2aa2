"""Sources and sinks: text folders, JSON lines, corpus tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx
from ..operators.embedding import batched_embed


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a new local one where that is unset and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-marginalia-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, for what is read twice and costs more than its rows."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_corpus(spark: SparkSession, path: str, suffixes: Iterable[str] = (".txt", ".md", ".html")) -> DataFrame:
    """One row per file of the folder and those below it: doc_name, ext, text, path."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").text(path, wholetext=True)
    place = F.col("_metadata.file_path")
    return files.select(tx.doc_name(place).alias("doc_name"), tx.doc_ext(place).alias("ext"), F.col("value").alias("text"), place.alias("path"))


def load_faq_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of a JSON-lines file in either shape; blank lines are skipped, bad ones kept apart."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schemas.FAQ_JSON, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r._bad").isNotNull()
    return parsed.filter(~bad).select("r.*").drop("_bad"), parsed.filter(bad).select(F.col("value").alias("line"))


def load_corrections(spark: SparkSession, path: str) -> DataFrame:
    """pos, old, new of a correction dictionary (one JSON object with a list)."""
    rules = spark.read.schema("replacements array<struct<old:string,new:string,note:string>>").json(path, multiLine=True)
    return rules.select(F.posexplode("replacements").alias("pos", "r")).select("pos", "r.old", "r.new").filter("old != '' and new is not null")


def triples_to_faq(df: DataFrame, source_doc: str, category: str = "general") -> DataFrame:
    """Of (query, pos, neg): question, answer (first positive or empty) and metadata."""
    return df.select(F.col("query").alias("question"), F.coalesce(F.get("pos", F.lit(0)), F.lit("")).alias("answer"), F.lit(source_doc).alias("source_doc"), F.lit(category).alias("category"), (F.coalesce(F.size("neg"), F.lit(0)) > 0).alias("has_negative"), F.lit(0.9).alias("confidence"), F.lit("auto").alias("created_by"))


def merge_faq_shapes(df: DataFrame) -> DataFrame:
    """Rows of schemas.FAQ_JSON in either shape as FAQ columns with defaults."""
    meta = lambda name, default: F.coalesce(F.col(f"metadata.{name}"), F.lit(default)).alias(name)
    return df.select(F.coalesce("question", "query").alias("question"), F.coalesce("answer", F.get("pos", F.lit(0)), F.lit("")).alias("answer"), meta("source_doc", "unknown"), meta("category", "general"), meta("confidence", 0.9), meta("created_by", "auto"))


def normalize_faq_hits(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, rejects): text trimmed, defaults filled; similarity must lie in [0, 1]."""
    clean = lambda c, d: F.coalesce(F.trim(c), F.lit(d)).alias(c)
    out = df.select("query_id", "id", clean("question", ""), clean("answer", ""), clean("category", "general"), clean("source_doc", "unknown"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    good = F.col("similarity").between(0, 1)
    return out.filter(good), out.filter(~good)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    chunks = spark.read.schema(schemas.CHUNKS).parquet(path)
    return chunks.withColumns({"doc_page": F.coalesce("doc_page", F.lit(0)), "chunk_index": F.coalesce("chunk_index", F.lit(0))})


def overwrite_corpus(new: DataFrame, path: str, buckets: int = 0) -> None:
    """Full refresh: one overwrite for all documents, by bucket of the document name where asked."""
    out = new.withColumn("doc_bucket", F.pmod(F.xxhash64("doc_name"), F.lit(buckets))).write.partitionBy("doc_bucket") if buckets else new.write
    out.mode("overwrite").parquet(path)


def upsert_by_doc(existing: DataFrame, new: DataFrame, key: str = "doc_name") -> DataFrame:
    """existing without the documents that new has, and new. Names are far smaller than chunks; Spark picks the join by their size."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_name"), F.lit(buckets)).cast("int")


def replace_buckets(spark: SparkSession, new: DataFrame, path: str, buckets: int, names: DataFrame | None = None) -> None:
    """upsert_by_doc on disk: only the buckets that new touches are rewritten. The documents of names(doc_name) go, too.

    1. The touched buckets as they shall be are staged under a name of their own. 2. A mark names the staging: from then on
    the change counts. 3. The buckets are overwritten from it. 4. Mark and staging go. A run that dies before 2 has changed
    nothing; one that dies later is finished by recover_buckets, which each change calls first, and read_buckets reads
    the staged buckets meanwhile, never half-written ones. One job at a time may write.
    """
    recover_buckets(spark, path)
    fresh = new.withColumn("doc_bucket", _bucket(buckets))
    known = fresh.select("doc_name", "doc_bucket")
    known = known if names is None else known.unionByName(names.select("doc_name", _bucket(buckets).alias("doc_bucket")))
    touched = [r[0] for r in known.select("doc_bucket").distinct().collect()]  # at most `buckets` numbers
    if not touched:
        return
    old = spark.read.parquet(path).filter(F.col("doc_bucket").isin(touched))
    name = uuid.uuid4().hex
    rest = old.select(*fresh.columns).join(known.select("doc_name").distinct(), "doc_name", "left_anti")
    rest.unionByName(fresh).write.partitionBy("doc_bucket").parquet(f"{path}/_staged/{name}")
    spark.createDataFrame([(name,)], "staged string").coalesce(1).write.mode("append").json(f"{path}/_replace")
    recover_buckets(spark, path)


def _staged(spark: SparkSession, path: str) -> str | None:
    """The staging that is marked, if a change is not finished."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_replace")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    row = spark.read.schema("staged string").json(f"{path}/_replace").first()
    return row and row[0]


def recover_buckets(spark: SparkSession, path: str) -> None:
    """Finish a change that is marked, and remove what unmarked ones have left. Done again, it does nothing."""
    name = _staged(spark, path)
    if name:
        staged = spark.read.parquet(f"{path}/_staged/{name}")
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_bucket").parquet(path)
    for left in ("_replace", "_staged"):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{left}")
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The corpus: its buckets, those of a change that is marked but not finished from its staging."""
    table, name = spark.read.parquet(path), _staged(spark, path)
    if not name:
        return table
    staged = spark.read.schema(table.schema).parquet(f"{path}/_staged/{name}")
    touched = [r[0] for r in staged.select("doc_bucket").distinct().collect()]  # at most as many as there are buckets
    return table.filter(~F.col("doc_bucket").isin(touched)).unionByName(staged)


def backfill_vectors(df: DataFrame, text_col: str, embed, vector_col: str = "chunk_vector") -> DataFrame:
    """Only rows without a vector reach embed (Column to Column); rows that stay without one go."""
    have = df.filter(F.col(vector_col).isNotNull())
    made = df.filter(F.col(vector_col).isNull()).withColumn(vector_col, embed(F.col(text_col)))
    return have.unionByName(made.filter(F.col(vector_col).isNotNull()))


def backfill_batched(df: DataFrame, text_col: str, load_model, vector_col: str = "chunk_vector", batch_size: int = 8) -> DataFrame:
    """backfill_vectors with a plug-in model, as embedding.batched_embed takes it: only rows without a vector are sent to it; rows that it fails on go."""
    have = df.filter(F.col(vector_col).isNotNull())
    made = batched_embed(df.filter(F.col(vector_col).isNull()).drop(vector_col), text_col, load_model, batch_size, vector_col)
    return have.unionByName(made.filter(F.col(vector_col).isNotNull()))


def one_each(docs: DataFrame) -> DataFrame:
    """docs(doc_name, ext, hash, ...) with one row a full name: of several that with the smallest hash, null first, whatever other columns there are."""
    rest = [c for c in docs.columns if c not in ("doc_name", "ext")]
    least = F.min_by(F.struct(*rest), F.coalesce("hash", F.lit(""))).alias("row")
    return docs.groupBy("doc_name", "ext").agg(least).select("doc_name", "ext", "row.*")


def changed_documents(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """docs(doc_name, ext, text) whose MD5 is not the one remembered for that full name. A hash that docs has already is taken."""
    hashed = docs if "hash" in docs.columns else docs.withColumn("hash", F.md5("text"))
    return hashed.join(seen.select("doc_name", "ext", "hash"), ["doc_name", "ext", "hash"], "left_anti")


def corpus_coverage(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"), F.count("parent_text").alias("n_parents"))


def list_documents(chunks: DataFrame, key: Column | str = "doc_name") -> DataFrame:
    return chunks.select(F.col(key).alias("doc_name") if isinstance(key, str) else key.alias("doc_name")).filter("doc_name is not null").distinct().orderBy("doc_name")


def append_corpus(new: DataFrame, path: str) -> None:
    """Append chunks; partitions are the batches."""
    new.write.mode("append").parquet(path)


def write_faq_jsonl(faq: DataFrame, path: str) -> None:
    """FAQ records as JSON lines; characters stay as they are."""
    meta = F.struct(*[c for c in ("source_doc", "category", "source_page", "confidence", "created_by") if c in faq.columns])
    faq.select("question", "answer", meta.alias("metadata")).write.mode("overwrite").json(path)


def append_telemetry(events: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Append events as JSON lines in one folder a day."""
    events.withColumn("day", F.date_format(F.col(ts).cast("timestamp"), "yyyyMMdd")).write.mode("append").partitionBy("day").json(path)


def corpus_stats(chunks: DataFrame, text_col: str = "chunk_text", tokenizer=tx.tokenize) -> DataFrame:
    """One row: chunks, chunks with a parent, documents, tokens."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.count("parent_text").alias("n_parents"), F.countDistinct("doc_name").alias("n_documents"), F.sum(F.size(tokenizer(F.col(text_col)))).alias("n_tokens"))
