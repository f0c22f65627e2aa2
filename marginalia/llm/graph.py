"""Connected components, and the pairs of a bucket that a first round left apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectext


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each vertex's larger (large) or smaller neighbours, itself among these, under its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    hung = both.join(least, "a")
    if large:
        return hung.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    own = least.select(F.col("a"), F.col("m").alias("b"))
    return hung.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).filter("a != b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every vertex of edges(a, b); root is the smallest vertex of its component.

    Alternating large-star and small-star steps. The number of rounds grows with the logarithm of the
    longest path; each round's edges are stored, and only their count and checksum reach the driver.
    """
    sign = None
    edges = common.stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        edges = common.stored(_stars(_stars(edges, True), False), name)
        r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if (r[0], r[1]) == sign or not r[0]:
            break
        sign = (r[0], r[1])
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


#: Of members' marks (n x bytes), their buckets and two index arrays: which pairs are worth a look at their texts.
Test = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _apart(test: Test):
    """Pairs of different roots within each (bucket, p, q) of partitions sorted by these and root."""

    def pairs(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = part.num_rows
        bucket, p, q, block, root, node = (part.column(c).to_numpy() for c in ("bucket", "p", "q", "block", "root", "node"))
        marks = vectext.text_bytes(part.column("mark"))[0].reshape(n, -1)
        new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])))
        ends = lambda begin: np.repeat(np.append(begin[1:], n), np.diff(np.append(begin, n)))
        other = ends(np.flatnonzero(new | np.concatenate(([True], root[1:] != root[:-1]))))
        count = ends(np.flatnonzero(new)) - other
        done = np.cumsum(count)
        lo = 0
        while lo < n:
            base = done[lo] - count[lo]
            hi = max(lo + 1, int(np.searchsorted(done, base + (1 << 18), "right")))
            i = np.repeat(np.arange(lo, hi), count[lo:hi])
            j = other[i] + np.arange(len(i)) - np.repeat(done[lo:hi] - count[lo:hi] - base, count[lo:hi])
            keep = (p[i] == q[i]) | (block[i] != block[j])  # two members of a block meet where it is alone
            i, j = i[keep], j[keep]
            keep = test(marks, bucket, i, j)
            i, j = i[keep], j[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 1 << 13:
                continue
            part = pa.concat_batches(held)
            last = np.ones(part.num_rows, bool)
            for c in ("bucket", "p", "q"):
                x = part.column(c).to_numpy()
                last &= x == x[-1]
            cut = part.num_rows - int(last.sum())
            if cut:
                yield from pairs(part.slice(0, cut))
            held = [part.slice(cut)]
        held = [b for b in held if b.num_rows]
        if held:
            yield from pairs(pa.concat_batches(held))

    return run


def pairs_apart(member: DataFrame, test: Test, block: int = 1024) -> DataFrame:
    """Distinct (a, b), a < b, of member(bucket, node, root, mark) with one bucket and different roots that pass the test.

    A bucket over `block` members is dealt in blocks, and each pair of blocks is one group; the bucket's most
    common root has blocks of its own, which need not meet each other.
    """
    sizes = member.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).filter("roots > 1")
    parts = lambda n: F.ceil(n / F.lit(block)).cast("int")
    sizes = sizes.select("bucket", F.col("top.root").alias("top"), (F.col("n") > block).alias("large"), parts(F.col("n") - F.col("top.n")).alias("rest"), parts(F.col("top.n")).alias("tops"))
    hashed, is_top = F.xxhash64("node", F.lit(9)), F.col("root") == F.col("top")
    number = F.when(~F.col("large"), 0).when(is_top, F.col("rest") + F.pmod(hashed, F.col("tops"))).otherwise(F.pmod(hashed, F.col("rest"))).cast("int")
    most = F.when(~F.col("large"), 0).when(is_top, F.col("rest") - 1).otherwise(F.col("rest") + F.col("tops") - 1)
    met = member.join(sizes, "bucket").select("bucket", "node", "root", "mark", number.alias("block"), most.alias("most"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("most")))).select("bucket", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), "block", "root", "node", "mark")
    return met.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "root").mapInArrow(_apart(test), "a long, b long").distinct()
