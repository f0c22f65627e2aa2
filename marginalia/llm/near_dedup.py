"""MinHash near-dedup (operator 3): improved consistent weighted sampling over TF-IDF word shingles.

1. Document frequencies of five-word shingles over all documents: a count sketch of fixed size finds the
   few that may be in more than a share `floor` of the documents, and these are counted exactly.
2. Per document, `bands * rows` consistent weighted samples; the k-th occurrence of a shingle is an
   element of its own, so that element weights are idf only and the sum is tf-idf. Documents with the
   same shingles collapse to one node (128-bit content key).
3. Nodes that agree on a band share a bucket. Each member meets `leaders` of its bucket: the first
   ones by hash orders, half of which are the same in all buckets (so that bands propose the same
   pairs) and half the bucket's own (so that a member which no common leader resembles meets others
   too). A bucket of n members gives at most leaders * n pairs.
4. Pairs are verified by exact weighted Jaccard similarity of the whole shingle sets.
5. Links give classes as connected components. What leaders can't see is settled by a second pass: in
   every bucket that still holds several classes, all pairs of different classes that leaders did not
   settle are verified as well. Pairs within a class can't change it, so no class loses a link of its
   buckets, and a near-copy group of any size stays linear.

The weight of a shingle in a share s of the documents is its smoothed idf, scaled to the floor:
1 + ln(1 / max(s, floor)) / ln(1 / floor), from 1 (in every document) to 2 (in at most one of 1 / floor).
It depends on shares only, so it is the same at every size of the corpus.

The samples of two texts agree with a chance equal to their similarity; of pairs that share a bucket,
leaders and members are verified that agree in `least` of all samples or more (70 samples: a pair of
similarity 0.8 is missed by that with a chance of about 0.001, by having no bucket with 0.004; both fall
fast above 0.8). The second pass takes `fine` many more samples of the texts of buckets that hold several
classes, as there pairs just below the threshold are many (400 samples, a share of 0.74: about 0.001).

Buckets are never gathered: leaders are a map-side combined minimum, members join them by key, and
skewed keys are split by adaptive execution; the second pass deals large buckets as pairs of blocks. What
is broadcast is the sketch's truth values, and the frequent shingles with their counts: as their shares
add up to the mean number of shingles of a text, they are at most that number / floor.

Defined results: null and blank texts have no shingle; they form one class of their own kind; texts of
one to four words have one shingle of all their words; equal texts are always in one class; a null
doc_id takes part but never names a class unless all members are null; ties go to the smallest doc_id;
repeated rows count each; texts of any length are taken whole; an empty table gives an empty result; other
columns are ignored, also where their names clash with columns here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph, sketch, vectext
from .vectext import U64

SLOTS = 1 << 20  # counters in each of the two rows of the frequency sketch
_STEP, _NTH = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
_LOW48 = U64((1 << 48) - 1)


def elements(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, 48-bit element) sorted by row, then base shingle; repeats of a shingle within a row become elements of their own."""
    buf, at = vectext.text_bytes(column)
    begin, end, row = vectext.words(buf, at)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    word = vectext.Prefix(buf).spans(begin, end)
    count = np.bincount(row, minlength=len(column))
    first = np.cumsum(count) - count
    keys, rows = [], []
    for w in range(1, width + 1):  # rows with fewer words have one shingle of them all
        if w < width:
            where = first[count == w]
        else:
            where = np.flatnonzero(row[: max(0, len(row) - w + 1)] == row[w - 1 :]) if len(row) >= w else np.zeros(0, np.int64)
        if len(where):
            h = word[where].copy()
            for k in range(1, w):
                h = h * _STEP + word[where + k]
            keys.append(vectext.mix(h) & _LOW48)
            rows.append(row[where])
    key = (np.concatenate(rows).astype(U64) << U64(48)) | np.concatenate(keys)
    key.sort()
    begin = vectext.runs(key)
    nth = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
    row, h = (key >> U64(48)).astype(np.int64), key & _LOW48
    again = nth > 0
    h[again] = vectext.mix(h[again] + nth[again].astype(U64) * _NTH) & _LOW48
    return row, h


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in vectext.parts(batches, "text", 1 << 19):
        for k in range(0, part.num_rows, 1 << 16):
            yield part.slice(k, 1 << 16)
    vectext.settle()


class Weights:
    """ln of element weights: those of frequent elements, and one for all others."""

    def __init__(self, keys: np.ndarray, share: np.ndarray, floor: float) -> None:
        order = np.argsort(keys)
        self.keys, self.rare = keys[order], np.float32(np.log(2))
        self.ln = np.log1p(np.log(np.maximum(share[order], floor)) / np.log(floor)).astype(np.float32)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.keys & U64(0xFFFF)).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.rare)
        maybe = np.flatnonzero(self.seen[(h & U64(0xFFFF)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == h[maybe]
            out[maybe[hit]] = self.ln[at[hit]]
        return out


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An element's counters in the two rows of the sketch."""
    return (h & U64(SLOTS - 1)).astype(np.int64), ((h >> U64(24)) & U64(SLOTS - 1)).astype(np.int64) + SLOTS


def element_weights(docs: DataFrame, floor: float = 1e-3) -> Weights:
    """Weights of all elements of docs(text). Two passes; what comes to the driver is of fixed size or bounded by the floor."""
    spark = docs.sparkSession
    n = docs.count()

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for part in _rows(batches):
            yield np.concatenate(_slots(elements(part.column("text"))[1]))

    heavy = spark.sparkContext.broadcast(np.packbits(sketch.totals(docs.select("text"), slots, 2 * SLOTS) >= max(floor * n, 1)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.unpackbits(heavy.value).astype(bool)
        for part in _rows(batches):
            h = elements(part.column("text"))[1]
            a, b = _slots(h)
            keys, times = np.unique(h[maybe[a] & maybe[b]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(times)], names=["h", "n"])

    found = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > floor * n).toArrow()
    return Weights(found["h"].to_numpy().astype(U64), found["n"].to_numpy() / max(n, 1), floor)


class Sampler:
    """Consistent weighted samples. The random r, ln c and beta of an element come from tables of draws, indexed by bits of its hash."""

    def __init__(self, n: int, seed: int = 3, c_bits: int = 16) -> None:
        self.c_mask = U64((1 << c_bits) - 1)
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(1, 1 << 62, n, dtype=U64) * U64(2) + U64(1)
        self.r = rng.gamma(2, 1, (n, 1 << 12)).astype(np.float32)
        self.c = np.log(rng.gamma(2, 1, (n, 1 << c_bits))).astype(np.float32)
        self.beta = rng.random((n, 1 << 12)).astype(np.float32)

    def samples(self, row: np.ndarray, h: np.ndarray, ln_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows that have elements, their sample ids as rows x n)."""
        start = vectext.runs(row)
        size = np.diff(np.append(start, len(row)))
        out = np.zeros((len(start), len(self.odd)), U64)
        for j, odd in enumerate(self.odd):
            x = h * odd
            x ^= x >> U64(29)
            x *= U64(0x94D049BB133111EB)
            r = self.r[j].take((x >> U64(52)).astype(np.int64))
            beta = self.beta[j].take(((x >> U64(40)) & U64(4095)).astype(np.int64))
            t = np.floor(ln_w / r + beta)
            ln_a = self.c[j].take(((x >> U64(24)) & self.c_mask).astype(np.int64)) - r * (t - beta + 1)
            low = np.minimum.reduceat(ln_a, start)
            hit = np.flatnonzero(ln_a == np.repeat(low, size))
            hit = hit[vectext.runs(row[hit])]
            out[:, j] = vectext.mix(h[hit] + (t[hit].astype(np.int64).astype(U64) + U64(j * 64 + 32)) * _NTH)
        return row[start], out


def content_keys(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each row's multiset of elements."""
    out = []
    for salt in (0x1656667B19E3779F, 0x27D4EB2F165667C5):
        key = np.zeros(n, U64)
        if len(row):
            start = vectext.runs(row)
            key[row[start]] = np.add.reduceat(vectext.mix(h ^ U64(salt)), start)
        out.append(vectext.mix(key + U64(salt)).astype(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame, weights: Weights, bands: int, rows: int, seed: int = 3) -> DataFrame:
    """docs(key, doc_id, text) -> key, doc_id, node, node2, bands (empty for blank text), samples (two bytes each)."""
    send = docs.sparkSession.sparkContext.broadcast(weights)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(bands * rows, seed)
        for part in _rows(batches):
            n = part.num_rows
            row, h = elements(part.column("text"))
            a, b = content_keys(row, h, n)
            keys, marks = [[]] * n, [b""] * n
            if len(row):
                which, ids = sampler.samples(row, h, send.value.of(h))
                band = ids.reshape(len(which), bands, rows)
                mixed = band[:, :, 0].copy()
                for k in range(1, rows):
                    mixed = vectext.mix(mixed * _STEP + band[:, :, k])
                mixed = vectext.mix(mixed + np.arange(bands, dtype=U64) * _NTH).astype(np.int64)
                short = (ids & U64(0xFFFF)).astype(np.uint16)
                for i, w in enumerate(which):
                    keys[w], marks[w] = mixed[i], short[i].tobytes()
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(a), pa.array(b), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())], names=["key", "doc_id", "node", "node2", "bands", "samples"])

    return docs.select("key", "doc_id", "text").mapInArrow(compute, "key long, doc_id long, node long, node2 long, bands array<long>, samples binary")


def _agree(marks: np.ndarray, i: np.ndarray, j: np.ndarray, least: float, kind: type) -> np.ndarray:
    """Whether samples agree in a share `least` or more."""
    marks, out = np.ascontiguousarray(marks).view(kind), np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 14):  # in slices, so that memory is bounded
        out[k : k + (1 << 14)] = (marks[i[k : k + (1 << 14)]] == marks[j[k : k + (1 << 14)]]).mean(1) >= least
    return out


def _once(samples: int, least: float) -> graph.Test:
    """Marks are samples, one byte each, and four bytes of each band: a pair is looked at in the first band where it meets."""

    def test(marks: np.ndarray, bucket: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        keep = np.flatnonzero(_agree(marks[:, :samples], i, j, least, np.uint8))
        bands = np.ascontiguousarray(marks[:, samples:]).view(">u4")
        first = (bands[i[keep]] == bands[j[keep]]).argmax(1)
        out = np.zeros(len(i), bool)
        out[keep] = bands[i[keep], first] == bucket[i[keep]].astype(U64) & U64(0xFFFFFFFF)
        return out

    return test


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if n := part.num_rows:
                both = np.concatenate([vectext.text_bytes(part.column(c))[0].reshape(n, -1) for c in ("samples", "other_samples")])
                yield part.select(["a", "b"]).filter(pa.array(_agree(both, np.arange(n), np.arange(n, 2 * n), least, np.uint16)))

    return run


def candidate_pairs(nodes: DataFrame, leaders: int, least: float) -> DataFrame:
    """Distinct (a, b), a < b, of nodes(node, bands, samples): members of a bucket with its leaders."""
    member = nodes.select("node", "samples", F.explode("bands").alias("bucket"))
    order = [F.xxhash64("node", F.lit(k), *([F.col("bucket")] if k % 2 else [])) for k in range(leaders)]
    first = [F.min(F.struct(o.alias("o"), "node", "samples")).alias(f"l{k}") for k, o in enumerate(order)]
    lead = member.groupBy("bucket").agg(F.count("*").alias("n"), *first).filter("n > 1")
    lead = lead.select("bucket", F.array_distinct(F.array(*[F.struct(F.col(f"l{k}.node").alias("node"), F.col(f"l{k}.samples").alias("samples")) for k in range(leaders)])).alias("lead"))
    met = member.join(lead, "bucket").select("node", "samples", F.explode("lead").alias("l")).filter(F.col("node") != F.col("l.node"))
    met = met.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b"), "samples", F.col("l.samples").alias("other_samples"))
    return met.mapInArrow(_likely(least), "a long, b long").distinct()


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, elements as sorted 64-bit numbers) of nodes(node, key): texts fetched by key and checked by content key."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _rows(batches):
            n = part.num_rows
            row, h = elements(part.column("text"))
            keep = content_keys(row, h, n)[0] == part.column("node").to_numpy()
            at = np.searchsorted(row, np.arange(n + 1))
            sets = [np.sort(h[at[i] : at[i + 1]]).tobytes() for i in range(n)]
            out = pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], names=["node", "elements"])
            yield out.filter(pa.array(keep))

    wanted = docs.select("key", "text").join(common.small_side(nodes.select("key", "node")), "key")
    return wanted.select("node", "text").mapInArrow(compute, "node long, elements binary")


def fine_marks(docs: DataFrame, nodes: DataFrame, weights: Weights, samples: int) -> DataFrame:
    """(node, mark) of nodes(node, key): as many more samples of their texts, one byte each."""
    send = docs.sparkSession.sparkContext.broadcast(weights)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples, 7, 12)
        for part in _rows(batches):
            row, h = elements(part.column("text"))
            keep = content_keys(row, h, part.num_rows)[0] == part.column("node").to_numpy()
            which, ids = sampler.samples(row, h, send.value.of(h)) if len(row) else (row, np.zeros((0, samples), U64))
            marks = [b""] * part.num_rows
            for w, m in zip(which.tolist(), (ids & U64(0xFF)).astype(np.uint8), strict=True):
                marks[w] = m.tobytes()
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(marks, pa.binary())], names=["node", "mark"]).filter(pa.array(keep))

    wanted = docs.select("key", "text").join(common.small_side(nodes.select("key", "node")), "key")
    return wanted.select("node", "text").mapInArrow(compute, "node long, mark binary").dropDuplicates(["node"])


def weighted_jaccard(x: np.ndarray, y: np.ndarray, weights: Weights) -> float:
    """Of two sorted element arrays."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    w = np.exp(weights.of(both).astype(np.float64))
    shared = float(w[1:][both[:-1] == both[1:]].sum())
    total = float(w.sum()) - shared
    return shared / total if total else 1.0


def verified(pairs: DataFrame, sets: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """pairs(a, b) whose similarity reaches the threshold, with it."""
    send = pairs.sparkSession.sparkContext.broadcast(weights)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vectext.parts(batches, "x", 2 << 20):
            got = [weighted_jaccard(np.frombuffer(x, U64), np.frombuffer(y, U64), send.value) for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(got, pa.float64())], names=["a", "b", "similarity"])
            yield out.filter(pc.greater_equal(out.column("similarity"), threshold))

    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
    y = x.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
    return y.select("a", "b", "x", "y").mapInArrow(compute, "a long, b long, similarity double").dropDuplicates(["a", "b"])


def classify(docs: DataFrame, threshold: float = 0.8, bands: int = 14, rows: int = 5, leaders: int = 4, least: float = 0.65, fine: tuple[int, float] = (400, 0.74), floor: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(documents, links) of docs(doc_id, text).

    documents: key (a hash of id and text), doc_id, class_id (smallest doc_id of its class), class_key (that
    document's key), class_size. links: (a, b, similarity) of nodes, verified and enough to join the classes;
    pairs of documents within a class are not listed in full, as a class of n has up to n * n / 2.
    """
    doc_id = F.col("doc_id").cast("long")
    docs = docs.select(row_key(), doc_id.alias("doc_id"), "text")
    weights = element_weights(docs, floor)
    signed = common.stored(signatures(docs, weights, bands, rows), "near-signed")
    nodes = signed.groupBy("node", "node2").agg(F.min("key").alias("key"), F.first("bands").alias("bands"), F.first("samples").alias("samples"))
    nodes = nodes.filter(F.size("bands") > 0)

    def checked(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        keys = common.stored(signed.groupBy("node").agg(F.min("key").alias("key")).join(needed, "node"), "near-keys")
        sets = common.stored(shingle_sets(docs, keys), "near-sets")
        return common.stored(verified(pairs, sets, weights, threshold), "near-links")

    pairs = common.stored(candidate_pairs(nodes, leaders, least), "near-pairs")
    links = checked(pairs)
    roots = common.stored(graph.components(links.select("a", "b"), "near-roots"), "near-classes")
    member = common.stored(nodes.join(common.small_side(roots.select("node", "root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.explode("bands").alias("bucket")), "near-members")
    several = member.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("bucket")
    member = common.stored(member.join(several, "bucket"), "near-apart")
    open_ = common.stored(nodes.join(common.small_side(common.stored(member.select("node").distinct(), "near-open")), "node"), "near-open")
    marks = common.stored(fine_marks(docs, open_, weights, fine[0]), "near-marks")
    four = F.transform("bands", lambda b: F.lpad(F.hex(b.bitwiseAND(0xFFFFFFFF)), 8, "0"))
    marks = marks.join(open_.select("node", F.unhex(F.array_join(four, "")).alias("four")), "node").select("node", F.concat("mark", "four").alias("mark"))
    met = member.join(marks, "node").select("bucket", "node", "root", "mark")
    rest = common.stored(graph.pairs_apart(met, _once(*fine)).join(pairs, ["a", "b"], "left_anti"), "near-rest")
    if rest.limit(1).count():
        links = links.unionByName(checked(rest))
        roots = common.stored(graph.components(links.select("a", "b"), "near-roots"), "near-classes")
    placed = common.stored(signed.select("key", "doc_id", "node").join(common.small_side(roots), "node", "left").select("key", "doc_id", F.coalesce("root", "node").alias("root")), "near-placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first")
    # Classes of one need no partner; the others are stored, so that a hot class is a skewed join that Spark can split.
    sizes = common.stored(placed.groupBy("root").agg(first, F.count("*").alias("class_size")).filter("class_size > 1"), "near-sizes")
    out, many = placed.join(sizes, "root", "left"), F.col("class_size").isNotNull()
    return out.select("key", "doc_id", F.when(many, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("first.key", "key").alias("class_key"), F.coalesce("class_size", F.lit(1)).alias("class_size")), links


def row_key() -> Column:
    """A number for a row's id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("key")


def drop_near_copies(docs: DataFrame, **options: float) -> DataFrame:
    """One document of each class: that with the smallest doc_id; a row repeated as a whole stays once. Keeps the columns of docs.

    The keys of what goes are narrow, so the texts usually meet a broadcast of checked size, else a shuffle.
    """
    found = common.stored(classify(docs, **options)[0].groupBy("key").agg(F.max(F.col("key") == F.col("class_key")).alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1"), "near-keys")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key())
    rest = own.join(common.small_side(found.select("key")), "key", "left_anti").select("row.*")
    repeats = common.stored(found.filter("kept").select("key"), "near-repeats")
    if not repeats.limit(1).count():
        return rest
    return rest.unionByName(own.join(common.small_side(repeats), "key", "left_semi").dropDuplicates(["key"]).select("row.*"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"))[0].drop("key", "class_key")
