"""Exact dedup (operator 7): an extendible-hash index kept on shared files.

Every text has a 64-bit hash. Copies are combined where they are read: an Arrow part of some MB gives one
entry (hash, text, least id, rows) for each of its texts, so a group that holds a third of all rows
reaches its owner as one entry a part. Entries lie as Parquet in the shared folder.

A directory of 2**depth slots, each pointing to a bucket by the first bits of the hash, starts with one
bucket; an overfull bucket splits and the directory doubles until every bucket holds at most `capacity`
hashes or `max_depth` is reached (longer buckets then stay as longer runs). The directory deals the
entries: ranges of buckets of about `owner_bytes` of text go to owner tasks, which read them in order of
bucket and hash. Entries of one hash form a chain, in which a text is told apart by comparing bytes; the chain
alone says which row stays and how large its group is. An owner holds one chain and one Arrow part.

The finished index (bucket, depth, hash, digest, chain, keeper, size) is probed through the directory, by
bucket, hash and digest.

Defined results: texts of any length are compared whole; null text counts as empty; a null doc_id sorts last; rows that repeat both the
text and the smallest doc_id stay once; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, vectext

Key = Callable[[Column], Column]


def directory(counts: dict[int, int], max_depth: int, capacity: int) -> list[tuple[int, int, int]]:
    """(slot, bucket, local depth) of all 2**depth slots, given entries by slot at max_depth.

    Starts with depth 0 and doubles while a bucket is overfull. A bucket's number is its prefix with a
    leading one, so that numbers are unique over depths.
    """
    full = np.zeros(1 << max_depth, np.int64)
    for k, v in counts.items():
        full[k] = v
    local = np.zeros(1, np.int64)
    for depth in range(max_depth + 1):
        held = full.reshape(1 << depth, -1).sum(1)
        overfull = (local == depth) & (held > capacity)
        if depth == max_depth or not overfull.any():
            break
        local = np.repeat(np.where(overfull, depth + 1, local), 2)
    depth = int(np.log2(len(local)))
    slots = np.arange(len(local))
    return [(int(s), int((1 << d) | (s >> (depth - d))), int(d)) for s, d in zip(slots, local, strict=True)]


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part of rows (hash, norm, doc_id) one entry a text: hash, norm, keep_id, n."""
    for part in vectext.parts(batches, "norm", 4 << 20):
        sums = pa.Table.from_batches([part]).group_by(["hash", "norm"]).aggregate([("doc_id", "min"), ("doc_id", "count", pc.CountOptions(mode="all"))])
        yield from sums.select(["hash", "norm", "doc_id_min", "doc_id_count"]).rename_columns(["hash", "norm", "keep_id", "n"]).to_batches()
    vectext.settle()


def gathered(entry: DataFrame, most: int = 64) -> DataFrame:
    """Entries of texts that came as more than `most` combined on, in tasks, by salt, then by text: each reaches its owner as one, however many parts hold it."""
    many = common.stored(entry.groupBy("hash").agg(F.count("*").alias("m")).filter(F.col("m") > most).select("hash"), "exact-many")
    if not many.limit(1).count():
        return entry
    hot, rest = entry.join(common.small_side(many), "hash"), entry.join(common.small_side(many), "hash", "left_anti")
    for salts in (most, 1):
        hot = hot.groupBy("hash", "norm", "bytes", F.pmod(F.xxhash64("keep_id", "n"), F.lit(salts)).alias("salt")).agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    return rest.unionByName(hot.select(*rest.columns))


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries in order of bucket and hash, the index rows: each hash's texts as a chain, by comparing bytes."""
    names, kinds = ["bucket", "depth", "hash", "text_sha256", "chain", "keep_id", "group_size"], [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    place: tuple[int, int, int] | None = None
    chain: list[list] = []  # [text, keep_id, group_size]

    def closed() -> list[tuple]:
        digests = sorted((hashlib.sha256(text).hexdigest(), keep, size) for text, keep, size in chain)
        return [(*place, digest, k, keep, size) for k, (digest, keep, size) in enumerate(digests)]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for part in vectext.parts(batches, "norm", 4 << 20):
        rows = []
        texts = part.column("norm").cast(pa.binary())
        own = zip(*(part.column(c).to_pylist() for c in ("bucket", "depth", "hash", "keep_id", "n")), strict=True)
        for i, (bucket, depth, key, keep, n) in enumerate(own):
            if (bucket, depth, key) != place:
                rows += closed() if place else []
                place, chain = (bucket, depth, key), []
            text = texts[i].as_py()
            for link in chain:
                if link[0] == text:
                    link[1] = keep if link[1] is None else link[1] if keep is None else min(link[1], keep)
                    link[2] += n
                    break
            else:
                chain.append([text, keep, n])
        if rows:
            yield batch(rows)
    if place:
        yield batch(closed())


class Index(NamedTuple):
    """rows: bucket, depth, hash, text_sha256, chain, keep_id, group_size; book: slot, bucket, depth, owner of the 2**top slots."""

    rows: DataFrame
    book: DataFrame
    top: int


def dealt(rows: DataFrame, book: DataFrame, top: int) -> DataFrame:
    """rows(hash) with what the directory says of their slots; it has 2**top slots, at most 65536 by default, so it is broadcast."""
    slot = F.shiftrightunsigned("hash", 64 - top).cast("int") if top else F.lit(0)
    return rows.withColumn("slot", slot).join(F.broadcast(book), "slot").drop("slot")


def build_index(docs: DataFrame, capacity: int = 4096, max_depth: int = 16, owner_bytes: int = 32 << 20, key: Key = F.xxhash64) -> Index:
    """Index of docs(doc_id, text).

    Counts by slot come to the driver and the directory goes back as a broadcast; both have at most
    2**max_depth rows (65536), whatever the input.
    """
    spark = docs.sparkSession
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.normalized(F.col("text")).alias("norm"))
    entry = norm.select(key(F.col("norm")).alias("hash"), "norm", "doc_id").mapInArrow(combined, "hash long, norm string, keep_id long, n long")
    entry = gathered(common.stored(entry.withColumn("bytes", F.octet_length("norm")), "exact-entries"))
    slot = F.shiftrightunsigned("hash", 64 - max_depth).cast("int").alias("slot")
    held = entry.groupBy("hash").agg(F.sum("bytes").alias("bytes")).groupBy(slot).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()
    slots = directory({r["slot"]: r["n"] for r in held}, max_depth, capacity)
    sizes = np.zeros(1 << max_depth, np.int64)
    for r in held:
        sizes[r["slot"]] = r["bytes"]
    sizes = sizes.reshape(len(slots), -1).sum(1)
    _, bucket_no = np.unique([b << (max_depth - d) for _, b, d in slots], return_inverse=True)  # in order of keys
    before = np.cumsum(np.bincount(bucket_no, sizes)) - np.bincount(bucket_no, sizes)
    owner = (before // owner_bytes).astype(np.int64)[bucket_no]
    book = spark.createDataFrame([(*row, int(o)) for row, o in zip(slots, owner, strict=True)], "slot int, bucket int, depth int, owner int")
    top = (len(slots) - 1).bit_length()
    mine = dealt(entry.drop("bytes"), book, top).repartitionById(int(owner.max()) + 1, "owner").sortWithinPartitions("bucket", "hash")
    index = mine.select("bucket", "depth", "hash", "norm", "keep_id", "n").mapInArrow(chained, "bucket int, depth int, hash long, text_sha256 string, chain int, keep_id long, group_size long")
    return Index(common.stored(index, "exact-index"), book, top)


def assign(docs: DataFrame, index: Index, key: Key = F.xxhash64) -> DataFrame:
    """docs with hash, text_sha256, keep_id and group_size: the directory names the bucket, the digest the link of the hash's chain."""
    norm = common.normalized(F.col("text"))
    keys = dealt(docs.withColumn("hash", key(norm)).withColumn("text_sha256", F.sha2(norm, 256)), index.book.select("slot", "bucket"), index.top)
    return keys.join(index.rows.select("bucket", "hash", "text_sha256", "keep_id", "group_size"), ["bucket", "hash", "text_sha256"]).drop("bucket")


def marks(docs: DataFrame, key: Key = F.xxhash64, **options: int) -> DataFrame:
    """doc_id, hash, text_sha256, keep_id, group_size, kept of each row of docs(doc_id, text); texts are not shuffled again."""
    found = assign(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), build_index(docs, key=key, **options), key).drop("text")
    once = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("group_size")) == 1
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & once)


def mark_exact(docs: DataFrame, **options: int | Key) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return marks(docs, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, **options: int) -> DataFrame:
    """docs without copies, with its own columns.

    What goes is told by (doc_id, hash). These keys are narrow and only those of copies, so the texts usually
    meet a broadcast of checked size; beyond that size they are shuffled. Rows that repeat a kept row are few
    and reduced to one by themselves.
    """
    keys = marks(docs, **options).filter("group_size > 1").groupBy("doc_id", "hash").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    keys = common.stored(keys.filter("not kept or n > 1").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "kept"), "exact-keys")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(common.normalized(F.col("text"))).alias("_h"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash"))
    rest = own.join(common.small_side(keys), same, "left_anti").select("row.*")
    repeats = common.stored(keys.filter("kept"), "exact-repeats")
    if not repeats.limit(1).count():
        return rest
    return rest.unionByName(own.join(common.small_side(repeats), same, "left_semi").dropDuplicates(["_doc", "_h"]).select("row.*"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_exact(common.table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
