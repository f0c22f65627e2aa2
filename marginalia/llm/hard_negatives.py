"""Hard-negative mining (operator 12): exact scores of anchors against all rows by Strassen multiplication of int64 tiles.

1. Rows become tiles: up to TILE vectors of a partition, sorted by label, as one binary matrix of the
   narrowest integer type. Anchors become tiles of their own. Nothing is shuffled to make them.
2. Anchor tiles are dealt into slices, candidate tiles into groups; each pair of a slice and a group is a cell,
   in the shape that copies the fewest tiles. Cells are shuffled, never joined, so that no copy goes through the
   driver. A task holds a cell's anchor tiles and streams its candidate tiles past them.
3. Two tiles are multiplied by Strassen's recursion: odd sides get a zero row or column, seven products
   of halves replace eight, down to LEAF. All sums are int64 sums; they wrap modulo 2**64, so a score is
   exact whenever it fits in a long, whatever the intermediate sums do.
4. First pass: rows of two tiles that share a label. Each anchor keeps a heap of its best rows of the
   same label. Second pass: all pairs of tiles, but those of one and the same label; each anchor and
   positive keeps a heap of the best rows of other labels within its window. Both passes together multiply
   an anchor about once with each row.
5. Heaps are arrays of (score, id) per anchor (or anchor and positive), merged in each task as tiles go by;
   those of tasks merge in Spark by the same order, so a task or an anchor never holds more than `keep` rows a heap.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part, nor
those with a component whose integer doesn't fit in a long; vectors of different lengths count as if the
shorter were filled up with zeros, an empty one scores 0; a null id is never an anchor and comes last
among equal scores; repeated rows count each, also as anchors; ties go by id; empty tables give an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TILE, LEAF = 256, 32
#: Sorts a null id behind all others.
LAST = np.iinfo(np.int64).max
_TILES = "tile long, ids binary, labels binary, dim int, width int, vectors binary"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices, modulo 2**64. Odd sides are padded with zeros; sides up to `leaf` are multiplied plainly."""
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= leaf:
        return np.einsum("ik,kj->ij", a, b)  # for integers faster than @
    a = np.pad(a, ((0, n % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, m % 2)))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), np.int64)
    out[:h, :j] = m1 + m4 - m5 + m7
    out[:h, j:] = m3 + m5
    out[h:, :j] = m2 + m4
    out[h:, j:] = m1 - m2 + m3 + m6
    return out[:n, :m]


def integer_vectors(column: pa.Array, factor: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """floor(factor * x) of each component as int64, short rows filled with zeros; and which rows are whole: no null, no non-finite, no too large component."""
    n = len(column)
    flat = column.flatten()
    at = np.concatenate(([0], np.cumsum(np.nan_to_num(np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64))))
    x = np.floor(flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) * float(factor))
    fits = np.abs(x) < 2.0**63
    bad = np.concatenate(([0], np.cumsum(~fits)))
    good = (bad[at[1:]] == bad[at[:-1]]) & np.asarray(column.is_valid())
    size = np.diff(at)
    out = np.zeros((n, int(size.max(initial=0))), np.int64)
    row = np.repeat(np.arange(n), size)
    out[row, np.arange(len(x)) - at[row]] = np.where(fits, x, 0).astype(np.int64)
    return out, good


def _width(m: np.ndarray) -> int:
    """Bytes of the narrowest integer type for all of m."""
    lo, hi = int(m.min(initial=0)), int(m.max(initial=0))
    return next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= lo and hi < 1 << 8 * w - 1)


def tiles(rows: DataFrame, size: int = TILE, factor: int = 256) -> DataFrame:
    """Tiles of rows(id, label, vector): each holds up to `size` rows of a partition, sorted by label. Tile numbers are unique once the result is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def full(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, held, n
            dim = max(m.shape[1] for _, _, m in held)
            ids, labels = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            m = np.concatenate([np.pad(h[2], ((0, 0), (0, dim - h[2].shape[1]))) for h in held])
            lo = 0
            while n - lo >= size or (last and n > lo):
                cut = slice(lo, min(lo + size, n))
                w = _width(m[cut])
                one = ([number], [ids[cut].tobytes()], [labels[cut].tobytes()], [dim], [w], [m[cut].astype(f"i{w}").tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["tile", "ids", "labels", "dim", "width", "vectors"])
                number, lo = number + 1, cut.stop
            held, n = ([(ids[lo:], labels[lo:], m[lo:])], n - lo) if n > lo else ([], 0)

        for batch in batches:
            if not batch.num_rows:
                continue
            m, good = integer_vectors(batch.column("vector"), factor)
            if good.any():
                held.append((batch.column("id").fill_null(int(LAST)).to_numpy()[good], batch.column("label").to_numpy()[good], m[good]))
                n += int(good.sum())
            if n >= 4 * size:
                yield from full(False)
        if n:
            yield from full(True)

    return rows.filter("label is not null and vector is not null").sortWithinPartitions("label").mapInArrow(run, _TILES)


class Side:
    """A tile from row i of a batch; as copies, if it outlives the batch."""

    def __init__(self, batch: pa.RecordBatch, i: int, own: bool = False) -> None:
        got = lambda c: batch.column(c)[i]
        kept = lambda m: m.copy() if own else m
        self.tile = got("tile").as_py()
        self.ids, self.labels = (kept(np.frombuffer(got(c).as_buffer(), np.int64)) for c in ("ids", "labels"))
        self.m = kept(np.frombuffer(got("vectors").as_buffer(), f"i{got('width').as_py()}")).reshape(len(self.ids), got("dim").as_py())
        self.kinds = np.unique(self.labels)

    def part(self, label: int) -> slice:
        return slice(int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right")))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices."""
    dim = max(a.shape[1], b.shape[1])
    wide = lambda m: np.pad(m, ((0, 0), (0, dim - m.shape[1]))).astype(np.int64)
    return strassen(wide(a), np.ascontiguousarray(wide(b).T))


class Heaps:
    """The `keep` best (score, id) of each of `n` slots, best first: score descending, id ascending."""

    def __init__(self, n: int, keep: int) -> None:
        self.n, self.keep = n, keep
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: Scores below a slot's floor can't enter.
        self.floor = np.full(n, np.iinfo(np.int64).min)

    def merge(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.concatenate((self.slot, slot)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        stay = place < self.keep
        self.slot, self.score, self.id = slot[stay], score[stay], ids[stay]
        full = place == self.keep - 1
        self.floor[slot[full]] = score[full]


#: Anchor tiles that a slice has on average at most; pairs of tiles that a cell should have at most.
OPEN_TILES, CELL_TILES = 64, 1 << 14


def _grid(n_a: int, n_c: int, cells: int) -> tuple[int, int]:
    """(slices of anchor tiles, groups of candidate tiles), about `cells` cells: an anchor tile is copied to each group, a candidate tile to each slice."""
    cells = max(min(cells, n_a * n_c), -(-n_a * n_c // CELL_TILES))
    slices = max(1, min(n_a, round(math.sqrt(cells * n_a / max(1, n_c)))), -(-n_a // OPEN_TILES))
    return slices, max(1, min(n_c, -(-cells // slices)))


def _cells(a: DataFrame, c: DataFrame, slices: int, groups: int) -> DataFrame:
    """Tiles with their cell: each task has whole cells one after another, the anchor tiles of a cell (side 0) before its candidate tiles (side 1)."""
    dealt = lambda n: F.pmod(F.xxhash64("tile"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_to")
    asked = a.select("*", each(groups)).withColumn("cell", dealt(slices) * groups + F.col("_to")).withColumn("side", F.lit(0))
    met = c.select("*", each(slices)).withColumn("cell", F.col("_to") * groups + dealt(groups)).withColumn("side", F.lit(1))
    both = asked.drop("_to").unionByName(met.drop("_to"), allowMissingColumns=True)
    # The number is given, else few large tasks are made of cells that are small, but much work.
    return both.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell", "side")


def _heaps(keep: int, per: int, opened: Callable, scored: Callable):
    """Of cells: heaps, `per` an anchor, of what scored(anchor tile, what opened(batch, i) gives of it, candidate tile, heaps) merges; one row an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for a, _, h in held:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h.slot), a.tile)), pa.array(h.slot), pa.array(h.score), pa.array(h.id)], names=["tile", "slot", "score", "id"])

        for batch in batches:
            for i in range(batch.num_rows):
                if (own := batch.column("cell")[i].as_py()) != cell:
                    yield from out()
                    cell, held = own, []
                if batch.column("side")[i].as_py() == 0:
                    a = Side(batch, i, True)
                    held.append((a, opened(batch, i), Heaps(len(a.ids) * per, keep)))
                    continue
                c = Side(batch, i)
                for a, more, h in held:
                    scored(a, more, c, h)
        yield from out()

    return run


_ENTRY = "tile long, slot long, score long, id long"


def _best(heaps: DataFrame, keep: int) -> DataFrame:
    """Heaps of tasks merged: rank from 1 in each (tile, slot). Spark cuts to `keep` before and after the shuffle."""
    w = Window.partitionBy("tile", "slot").orderBy(F.col("score").desc(), "id")
    return heaps.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def _positives(keep: int):
    def scored(a: Side, _, c: Side, heaps: Heaps) -> None:
        for label in np.intersect1d(a.kinds, c.kinds, True):
            own, other = a.part(label), c.part(label)
            s = products(a.m[own], c.m[other])
            row, col = np.nonzero(s >= heaps.floor[own, None])
            heaps.merge(row + own.start, s[row, col], c.ids[other][col])

    return _heaps(keep, 1, lambda batch, i: None, scored)


def _negatives(keep: int, per: int):
    """Slots are anchor * per + positive; the windows of a tile come as arrays of slot, lowest and highest score."""

    def opened(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
        return tuple(batch.column(k)[i].values.to_numpy().copy() for k in ("slots", "lows", "highs"))

    def scored(a: Side, window: tuple[np.ndarray, ...], c: Side, heaps: Heaps) -> None:
        if len(a.kinds) == 1 and np.array_equal(a.kinds, c.kinds):
            return
        slot, low, high = window
        s, anchor = products(a.m, c.m), slot // per
        same = a.labels[:, None] == c.labels
        for k in range(per):  # the k-th positive of all anchors at once
            at = np.flatnonzero(slot % per == k)
            if not len(at):
                continue
            rows = anchor[at]
            own = s[rows]
            row, col = np.nonzero((own <= high[at, None]) & (own >= np.maximum(low[at], heaps.floor[slot[at]])[:, None]) & ~same[rows])
            if len(row):
                heaps.merge(slot[at][row], own[row, col], c.ids[col])

    return _heaps(keep, per, opened, scored)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, factor: int = 256, size: int = TILE) -> DataFrame:
    """Hard negatives of anchors among rows, both (id, label, vector); each anchor is a row of rows, too.

    An anchor's positives are its first `positives` rows of the same label but itself; for each, the first
    `negatives` rows of other labels whose score is `low` to `high` hundredths of the positive's: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score, by score, then id.
    """
    spark = rows.sparkSession
    pick = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector")
    c = common.stored(tiles(pick(rows), size, factor), "negatives-candidates")
    some = anchors.count()
    a = common.stored(tiles(pick(anchors).repartition(max(1, -(-some // (4 * size)))), size, factor), "negatives-anchors")
    slices, groups = _grid(a.count(), c.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # One more, as an anchor finds itself; it is one of several equal entries (score, id), so any of these may go.
    found = _best(_cells(a, c, slices, groups).mapInArrow(_positives(positives + 1), _ENTRY), positives + 1)
    own = common.stored(a.mapInArrow(_own, "tile long, slot long, anchor_id long, own long"), "negatives-own")
    w = Window.partitionBy("tile", "slot").orderBy("rank")
    me = (F.col("id") == F.col("anchor_id")) & (F.col("score") == F.col("own"))
    found = found.join(own, ["tile", "slot"]).withColumn("me", me & (F.sum(me.cast("int")).over(w) == 1)).filter("not me").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= positives)
    found = common.stored(found.select("tile", "slot", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "k"), "negatives-positives")

    # score * high / 100 rounded down and score * low / 100 rounded up, by whole hundreds and the rest, which can't overflow
    rest = "pmod(positive_score, 100)"
    hundreds = f"((positive_score - {rest}) div 100)"
    down, up = F.expr(f"{hundreds} * {high} + ({rest} * {high}) div 100"), F.expr(f"{hundreds} * {low} + ({rest} * {low} + 99) div 100")
    windows = found.select("tile", (F.col("slot") * positives + F.col("k") - 1).alias("slot"), up.alias("low"), down.alias("high")).filter("low <= high")
    windows = windows.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("slot", "low", "high"))).alias("w"))  # at most size * positives entries
    windows = windows.select("tile", F.col("w.slot").alias("slots"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    got = _best(_cells(a.join(windows, "tile"), c, slices, groups).mapInArrow(_negatives(negatives, positives), _ENTRY), negatives)
    got = got.select("tile", F.expr(f"slot div {positives}").alias("slot"), (F.col("slot") % positives + 1).cast("int").alias("k"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    shown = lambda c: F.when(F.col(c) != int(LAST), F.col(c)).alias(c)
    return got.join(found, ["tile", "slot", "k"]).select("anchor_id", shown("positive_id"), F.col("rank").cast("int").alias("rank"), shown("negative_id"), "positive_score", "negative_score")


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each anchor's id and its score with itself."""
    for batch in batches:
        for i in range(batch.num_rows):
            t = Side(batch, i)
            n = len(t.ids)
            wide = t.m.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t.tile)), pa.array(np.arange(n)), pa.array(t.ids), pa.array((wide * wide).sum(1))], names=["tile", "slot", "anchor_id", "own"])


def relabelled(embeddings: DataFrame) -> DataFrame:
    """id, label, vector; where the id is divisible by 7, the label is (label + 1) % 10."""
    label = F.col("label").cast("long")
    return embeddings.select(F.col("vec_id").cast("long").alias("id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.col("embedding").alias("vector"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relabelled(common.table(spark, sf_dir, "embeddings"))
    return mine(rows, rows.filter("id % 50 = 0"))


OP12_SQL = """WITH e AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.r AS ar, a.id AS anchor_id, c.id AS id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM e a, e c WHERE a.id % 50 = 0 AND a.r <> c.r),
 p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.ar, p.k ORDER BY n.score DESC, n.id)::INTEGER AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
 FROM p JOIN s n ON n.ar = p.ar AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score QUALIFY rank <= 3"""
