"""N-gram Jaccard join (operator 11): signature trees over word shingles, exact links, connected components.

1. Each text becomes its set of distinct four-word shingles (64-bit hashes). Texts with one and the same set
   are one node (128-bit key of the set, numbered by one of its rows).
2. Two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of each, whatever order all sets follow.
   The order is rare shingles first, by a count sketch of fixed size over all documents, then hash. Nodes that share
   such a shingle are a bucket; shingles that one node alone has make none.
3. Every bucket is a signature tree. A member is a leaf with its token bitmap (one or two bits a shingle, 4096 at most) and size;
   inner nodes hold the OR of their bitmaps, the range of sizes and the largest number of tokens that share bits. The tree is
   traversed against itself: a pair of nodes goes when its size ranges can't reach the similarity, when its common bits and
   shared tokens bound the overlap below what the smallest sizes need, or when both lie in one class already. Pairs of members
   are bounded by the bits that one has and the other lacks. Buckets of up to SMALL members are one node.
4. Pairs that are left are verified by the exact overlap of the whole sets, made from the texts again.
5. Links give classes as connected components. A bucket with more pairs left than `most` a member, as in a large group of
   near copies, first lets all members meet its middle ones (nearest to the majority of the bits). Once their links have merged
   classes, it is traversed again, with bitmaps eight times as wide and four times the allowance, until it has no pair of different classes left that
   wasn't verified. So no link between classes is lost, and a group of near copies stays linear.

A bucket of over `block` members is dealt in blocks, each pair of blocks a tree of its own. Nothing is collected but counters of fixed size.

Defined results: null, empty and blank texts have no shingle and are linked with nothing, not even with each other; texts of one to
three words have one shingle of all their words; the smallest doc_id names a component, null ids only where all are
null; repeated rows count each and are linked, having one set; texts of any length are taken whole; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph, sketch, vectext
from .vectext import U64

SLOTS = 1 << 20  # counters in each of the two rows of the sketch
SMALL, LEAF, FAN = 64, 16, 8
PART = 1 << 19  # bytes of text that a worker looks at at once
WORDS = 1 << 19  # words of bitmaps that it compares at once
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STEP = U64(0xD6E8FEB86659FD93)
_KEYS = U64(0x8CB92BA72F3D8DD7), U64(0xB5026F5AA96619E9)


def shingles(column: pa.Array, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets of rows): all shingles of each text with A-Z lowered, repeats included; rows with fewer words have one of them all."""
    raw, at = vectext.text_bytes(column)
    buf = _FOLD[raw]
    begin, end, row = vectext.words(buf, at)
    n = len(column)
    if not len(begin):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    word = vectext.Prefix(buf).spans(begin, end)
    count = np.bincount(row, minlength=n)
    size = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    offsets = np.concatenate(([0], np.cumsum(size)))
    first = np.repeat((np.cumsum(count) - count) - offsets[:-1], size) + np.arange(offsets[-1])
    length = np.repeat(np.minimum(count, width), size)
    h = word[first].copy()
    for k in range(1, width):
        more = np.flatnonzero(length > k)
        h[more] = h[more] * _STEP + word[first[more] + k]
    return vectext.mix(h + length.astype(U64)), offsets


def sets_of(column: pa.Array, width: int = 4) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    h, at = shingles(column, width)
    return [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & U64(SLOTS - 1)).astype(np.int64), ((h >> U64(24)) & U64(SLOTS - 1)).astype(np.int64) + SLOTS


def commonness(docs: DataFrame, width: int, floor: float) -> np.ndarray:
    """A number for each slot of the sketch: 0 for shares of up to `floor` occurrences a document, one more with each doubling."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for part in vectext.parts(batches, "text", PART):
            yield np.concatenate(_slots(shingles(part.column("text"), width)[0]))

    n = docs.count()
    share = sketch.totals(docs.select("text"), slots, 2 * SLOTS) / max(floor * n, 1.0)
    return np.where(share > 1, 1 + np.log2(np.maximum(share, 1)), 0).astype(np.uint8)


def bitmap_bits(n: int) -> int:
    """Bits for n shingles: a power of two from 256 to 4096, one to two a shingle."""
    return 1 << min(12, max(8, (n - 1).bit_length()))


def bitmap(s: np.ndarray, bits: int) -> bytes:
    out = np.zeros(bits, bool)
    out[((s >> U64(20)) & U64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


_SIGNED = "doc_id long, row long, t1 long, t2 long, k1 long, k2 long, n long, bits binary, prefix array<long>"


def _signed(sent, width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_, number, met = sent.value, TaskContext.get().partitionId() << 34, set()
        for part in vectext.parts(batches, "text", PART):
            keys, sizes, bits, prefix = [], [], [], []
            for s in sets_of(part.column("text"), width):
                n = len(s)
                key = (0, 0) if not n else tuple(int(vectext.mix(s ^ c).sum(dtype=U64).astype(np.int64)) for c in _KEYS)
                keys.append(key)
                sizes.append(n)
                if not n or key in met:  # copies in one task need one prefix
                    bits.append(None)
                    prefix.append(None)
                    continue
                if len(met) < 1 << 14:
                    met.add(key)
                a, b = _slots(s)
                order = np.argsort(np.minimum(common_[a], common_[b]), kind="stable")[: n + 1 + (-percent * n) // 100]
                bits.append(bitmap(s, bitmap_bits(n)))
                prefix.append(s[order].astype(np.int64))
            rows = np.arange(number, number + len(sizes))
            number += len(sizes)
            k1, k2 = np.array(keys, np.int64).reshape(-1, 2).T
            columns = [part.column("doc_id"), pa.array(rows), part.column("t1"), part.column("t2"), pa.array(k1), pa.array(k2), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "t1", "t2", "k1", "k2", "n", "bits", "prefix"])
        vectext.settle()

    return run


def _wide(width: int):
    """Bitmaps of 8 to 16 bits a shingle, for members of the buckets that are looked at again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vectext.parts(batches, "text", PART):
            sets = sets_of(part.column("text"), width)
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(n, pa.int64()), pa.array([bitmap(s, 8 * bitmap_bits(len(s))) for s in sets], pa.binary())], names=["node", "n", "bits"])
        vectext.settle()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (bucket, node) sorted by both: the distinct rows of buckets that hold several nodes."""
    last = None  # a row that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, node = (batch.column(c).to_numpy() for c in ("bucket", "node"))
        if last is not None:
            bucket, node = np.concatenate((last[0], bucket)), np.concatenate((last[1], node))
            several = last[2]
        else:
            several = False
        fresh = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])))
        bucket, node = bucket[fresh], node[fresh]
        same = bucket[1:] == bucket[:-1]
        keep = np.concatenate(([several], same)) | np.concatenate((same, [False]))
        last = bucket[-1:], node[-1:], bool(keep[-1])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[:-1][keep[:-1]]), pa.array(node[:-1][keep[:-1]])], names=["bucket", "node"])
    if last is not None and last[2]:
        yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(last[1])], names=["bucket", "node"])


class Members:
    """Members of buckets with bitmaps of one width; `guest` marks those of twice the width, folded."""

    def __init__(self, bucket, node, root, n, words, guest, block, percent: int) -> None:
        self.bucket, self.node, self.root, self.n, self.words, self.guest, self.block, self.percent = bucket, node, root, n, words, guest, block, percent

    def take(self, at: np.ndarray) -> Members:
        return Members(*(x[at] for x in (self.bucket, self.node, self.root, self.n, self.words, self.guest, self.block)), self.percent)

    def possible(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs, those of different classes whose sizes and bitmaps allow the similarity."""
        low, high = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        ok = (self.root[i] != self.root[j]) & (100 * low >= self.percent * high) & ~(self.guest[i] & self.guest[j]) & ((self.block[i] != self.block[j]) | (self.block[i] < 0))
        i, j = i[ok], j[ok]
        x, y = self.words[i], self.words[j]
        lack = np.bitwise_count(x & ~y).sum(1, dtype=np.int64), np.bitwise_count(y & ~x).sum(1, dtype=np.int64)
        overlap = np.minimum(self.n[i] - lack[0], self.n[j] - lack[1])
        ok = 100 * overlap >= self.percent * (self.n[i] + self.n[j] - overlap)
        return i[ok], j[ok]

    def small_pairs(self, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Possible pairs within each of the ranges, which are single nodes of a tree."""
        size = end - begin
        own = np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        rest = np.repeat(end, size) - own - 1
        done, most = np.cumsum(rest), WORDS // self.words.shape[1]
        lo = 0
        while lo < len(own):
            base = done[lo] - rest[lo]
            hi = max(lo + 1, int(np.searchsorted(done, base + most, "right")))
            i = np.repeat(own[lo:hi], rest[lo:hi])
            j = i + 1 + np.arange(len(i)) - np.repeat(done[lo:hi] - rest[lo:hi] - base, rest[lo:hi])
            yield self.possible(i, j)
            lo = hi

    def middle(self, count: int) -> np.ndarray:
        """The members nearest to the majority of all bits."""
        total = np.zeros(self.words.shape[1] * 64, np.int64)
        step = max(1, 8 * WORDS // len(total))
        for lo in range(0, len(self.n), step):
            total += np.unpackbits(np.ascontiguousarray(self.words[lo : lo + step]).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        most = np.packbits(2 * total > len(self.n), bitorder="little").view(U64)
        away = np.bitwise_count(self.words ^ most).sum(1, dtype=np.int64)
        return np.lexsort((self.node, away))[:count]


class Tree:
    """Signature tree of members: level 0 are members, each level above ORs FAN (first LEAF) nodes below."""

    def __init__(self, members: Members) -> None:
        self.members = members
        self.size, first = [], LEAF
        words, low, high = members.words, members.n, members.n
        hidden = members.n - np.bitwise_count(words).sum(1, dtype=np.int64)  # tokens that share a bit with another
        one, same = members.root, np.ones(len(members.n), bool)
        self.levels = [(words, low, high, hidden, one, same)]
        while len(low) > 1:
            at = np.arange(0, len(low), first)
            words, low, high, hidden = np.bitwise_or.reduceat(words, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(hidden, at)
            same = np.logical_and.reduceat(same & (one == np.repeat(one[at], np.diff(np.append(at, len(one))))), at)
            one = one[at]
            self.levels.append((words, low, high, hidden, one, same))
            self.size.append(first)
            first = FAN

    def alive(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether a pair of nodes may hold a pair of members to look at."""
        words, low, high, hidden, one, same = self.levels[level]
        percent = self.members.percent
        ok = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i]) & ~(same[i] & same[j] & (one[i] == one[j]))
        at = np.flatnonzero(ok)
        a, b = i[at], j[at]
        overlap = np.minimum(np.bitwise_count(words[a] & words[b]).sum(1, dtype=np.int64) + np.minimum(hidden[a], hidden[b]), np.minimum(high[a], high[b]))
        ok[at] = (100 + percent) * overlap >= percent * (low[a] + low[b])
        return ok

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Possible pairs of members, by traversal of the tree against itself."""
        top, most = len(self.levels) - 1, min(1 << 12, WORDS // self.members.words.shape[1])
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            if level == 0:
                yield self.members.possible(i, j)
                continue
            ok = self.alive(level, i, j)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            fan, below = self.size[level - 1], len(self.levels[level - 1][1])
            a = (i[:, None] * fan + np.repeat(np.arange(fan), fan)).ravel()
            b = (j[:, None] * fan + np.tile(np.arange(fan), fan)).ravel()
            ok = (a < below) & (b < below) & ((a < b) | ((a == b) & (level > 1)))
            a, b = a[ok], b[ok]
            for lo in range(0, len(a), most):
                stack.append((level - 1, a[lo : lo + most], b[lo : lo + most]))


def _ordered(m: Members) -> Members:
    """Like members side by side: by the first bits of two orders of the bits, then by size."""
    bits = m.words.shape[1]
    first = []
    for seed in (1, 2):
        word = np.random.default_rng(seed).permutation(bits)
        w = m.words[:, word]
        some = (w != 0).argmax(1)
        value = w[np.arange(len(w)), some]
        first.append(some * 64 + np.bitwise_count((value & -value.astype(np.int64).astype(U64)) - U64(1)).astype(np.int64))
    return m.take(np.lexsort((m.n, first[1], first[0])))


def _bucket_pairs(m: Members, begin: np.ndarray, end: np.ndarray, most: int, leaders: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, bucket if that is open still, else a) of buckets given as ranges of m."""
    size = end - begin
    small = size <= SMALL
    for i, j in m.small_pairs(begin[small], end[small]):
        yield m.node[i], m.node[j], np.zeros(0, np.int64)
    for lo, hi in zip(begin[~small].tolist(), end[~small].tolist(), strict=True):
        own = _ordered(m.take(np.arange(lo, hi)))
        found, n = [], 0
        for i, j in Tree(own).pairs():
            found.append((i, j))
            n += len(i)
            if n > most * (hi - lo):
                break
        if n > most * (hi - lo):
            for k in own.middle(leaders):
                i, j = own.possible(np.full(hi - lo, k), np.arange(hi - lo))
                yield own.node[i], own.node[j], np.zeros(0, np.int64)
            yield np.zeros(0, np.int64), np.zeros(0, np.int64), own.bucket[:1]
            continue
        for i, j in found:
            yield own.node[i], own.node[j], np.zeros(0, np.int64)


_FOUND = "a long, b long, open boolean"


def _candidates(percent: int, most: int, leaders: int):
    """Pairs of nodes of buckets, given as (bucket, p, q, block, node, root, n, bits) sorted by bucket, p and q; and rows (bucket, bucket, true) of buckets to look at again."""

    def pairs(part: pa.Table) -> Iterator[pa.RecordBatch]:
        col = lambda c: part.column(c).to_numpy()
        bucket, p, q = col("bucket"), col("p"), col("q")
        n, node, root, block = col("n"), col("node"), col("root"), np.where(p == q, -1, col("block"))
        group = np.cumsum(np.concatenate(([0], (bucket[1:] != bucket[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))))
        raw, at = vectext.text_bytes(part.column("bits").combine_chunks())
        width = np.diff(at)
        for w in np.unique(width).tolist():
            own, guest = width == w, width == 2 * w
            rows = np.flatnonzero(own | guest)
            words = np.empty((len(rows), w // 8), U64)
            is_guest = guest[rows]
            words[~is_guest] = raw[np.repeat(own, width)].view(U64).reshape(-1, w // 8)
            if is_guest.any():
                two = raw[np.repeat(guest, width)].view(U64).reshape(-1, w // 4)
                words[is_guest] = two[:, : w // 8] | two[:, w // 8 :]
            m = Members(bucket[rows], node[rows], root[rows], n[rows], words, is_guest, block[rows], percent)
            begin = vectext.runs(group[rows])
            end = np.append(begin[1:], len(rows))
            some = np.logical_or.reduceat(~is_guest, begin) & (end - begin > 1)
            for a, b, open_ in _bucket_pairs(m, begin[some], end[some], most, leaders):
                x, y = np.concatenate((np.minimum(a, b), open_)), np.concatenate((np.maximum(a, b), open_))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.arange(len(x)) >= len(a))], names=["a", "b", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 1 << 12:
                continue
            part = pa.Table.from_batches(held).combine_chunks()
            last = np.ones(part.num_rows, bool)
            for c in ("bucket", "p", "q"):
                x = part.column(c).to_numpy()
                last &= x == x[-1]
            cut = part.num_rows - int(last.sum())
            if cut:
                yield from pairs(part.slice(0, cut))
            held = part.slice(cut).combine_chunks().to_batches()
        if held and (part := pa.Table.from_batches(held)).num_rows:
            yield from pairs(part.combine_chunks())

    return run


def candidates(member: DataFrame, percent: int, most: int, leaders: int, block: int) -> DataFrame:
    """Distinct (a, b, open) of member(bucket, node, root, n, bits)."""
    sizes = member.groupBy("bucket").agg(F.count("*").alias("m")).filter(F.col("m") > block)
    parts = F.ceil(F.col("m") / F.lit(block)).cast("int")
    large = common.stored(sizes.select("bucket", parts.alias("parts")), "ngram-large")
    if large.limit(1).count():
        met = member.join(common.small_side(large), "bucket", "left").withColumn("block", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int"))
        met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
        met = met.select("bucket", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), "block", "node", "root", "n", "bits")
    else:
        met = member.select("bucket", *[F.lit(0).alias(c) for c in ("p", "q", "block")], "node", "root", "n", "bits")
    return met.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q").mapInArrow(_candidates(percent, most, leaders), _FOUND).distinct()


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, overlap, total) of pairs(a, b) whose sets, made of texts(node, text), reach the similarity."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vectext.parts(batches, "x", PART // 2):
            x, y = sets_of(part.column("x"), width), sets_of(part.column("y"), width)
            size = np.array([len(s) + len(t) for s, t in zip(x, y, strict=True)], np.int64)
            both = np.array([len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(x, y, strict=True)], np.int64)
            out = pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(both), pa.array(size - both)], names=["a", "b", "overlap", "total"])
            yield out.filter(pa.array(100 * both >= percent * (size - both)))
        vectext.settle()

    x = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    y = x.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return y.select("a", "b", "x", "y").mapInArrow(compute, "a long, b long, overlap long, total long")


def link(docs: DataFrame, width: int = 4, percent: int = 85, floor: float = 1e-3, most: int = 16, leaders: int = 8, block: int = 16384) -> tuple[DataFrame, DataFrame]:
    """(documents, links) of docs(doc_id, text).

    documents: doc_id, n_shingles, component_id. links: (a, b, overlap, total) of nodes, enough to join the components.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(7)).alias("t2"))
    order = spark.sparkContext.broadcast(commonness(docs, width, floor))
    signed = common.stored(docs.mapInArrow(_signed(order, width, percent), _SIGNED), "ngram-signed")
    first = F.min(F.when(F.col("prefix").isNotNull(), F.struct("row", "n", "bits", "prefix", "t1", "t2"))).alias("f")
    nodes = signed.filter("n > 0").groupBy("k1", "k2").agg(first, F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    nodes = common.stored(nodes.select("k1", "k2", "least", "copies", F.col("f.row").alias("node"), "f.n", "f.bits", "f.prefix", "f.t1", "f.t2"), "ngram-nodes")
    rows = nodes.select(F.explode("prefix").alias("bucket"), "node").repartition("bucket").sortWithinPartitions("bucket", "node")
    shared = common.stored(rows.mapInArrow(_shared, "bucket long, node long"), "ngram-buckets")
    marks = nodes.select("node", "n", "bits")
    member, done, links, roots, wide = shared.join(marks, "node").withColumn("root", F.col("node")), None, None, None, None
    while True:
        found = common.stored(candidates(member, percent, most, leaders, block), "ngram-pairs")
        pairs = found.filter("not open").select("a", "b")
        if done is not None:
            pairs = common.stored(pairs.join(done, ["a", "b"], "left_anti"), "ngram-pairs")
        if pairs.limit(1).count():
            needed = common.stored(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "t1", "t2"), "node"), "ngram-needed")
            texts = docs.select("t1", "t2", "text").join(common.small_side(needed), ["t1", "t2"]).select("node", "text").dropDuplicates(["node"])
            new = common.stored(verified(pairs, common.stored(texts, "ngram-texts"), width, percent), "ngram-links")
            links, done = new if links is None else links.unionByName(new), pairs if done is None else done.unionByName(pairs)
            roots = common.stored(graph.components(links.select("a", "b"), "ngram-roots"), "ngram-classes")
        open_ = common.stored(found.filter("open").select(F.col("a").alias("bucket")), "ngram-open")
        if not open_.limit(1).count():
            break
        again = common.stored(shared.join(common.small_side(open_), "bucket"), "ngram-again")
        if wide is None:  # later rounds look at fewer of these members
            needed = common.stored(again.select("node").distinct().join(nodes.select("node", "t1", "t2"), "node"), "ngram-needed")
            texts = docs.select("t1", "t2", "text").join(common.small_side(needed), ["t1", "t2"]).select("node", "text").dropDuplicates(["node"])
            wide = common.stored(texts.mapInArrow(_wide(width), "node long, n long, bits binary"), "ngram-wide")
        member = again.join(wide, "node")
        member = member.withColumn("root", F.col("node")) if roots is None else member.join(common.small_side(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
        most *= 4
    if links is None:
        links = spark.createDataFrame([], "a long, b long, overlap long, total long")
        roots = spark.createDataFrame([], "node long, root long")
    named = nodes.select("k1", "k2", "node", "least", "copies").join(roots, "node", "left").withColumn("in_class", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "node"))
    named = common.stored(named.filter("in_class or copies > 1"), "ngram-named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # Stored, so that a hot set is a skewed join that Spark can split; sets of one document need none.
    keyed = common.stored(named.join(least, "root").select("k1", "k2", "component_id", F.lit(True).alias("joined")), "ngram-keyed")
    out = signed.select("doc_id", "n", "k1", "k2").join(common.small_side(keyed), ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("joined"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), links


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(common.table(spark, sf_dir, "documents"))[0]


OP11_SQL = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT r, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS x FROM d),
 n AS (SELECT r, count(*) AS n FROM s GROUP BY r), k AS (SELECT list(r) AS rs FROM s GROUP BY x HAVING count(*) > 1), p AS (SELECT row_number() OVER () AS x, rs FROM k), u AS (SELECT x, unnest(rs) AS r FROM p),
 o AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM u a JOIN u b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r),
 e AS (SELECT a, b FROM o JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * o >= 85 * (na.n + nb.n - o)), l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 c AS (SELECT r, r AS root FROM d UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.r)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(m.doc_id) AS component_id FROM c JOIN d ON d.r = c.root JOIN d m ON m.r = c.r LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id"""
