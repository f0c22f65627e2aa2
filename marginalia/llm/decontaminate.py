"""Benchmark decontamination (operator 4): q-gram lemma filtering and banded alignment.

Both sides are lower-cased with single spaces. An item of m characters that lies in a document with at
most e edits shares at least m + 1 - q - q * e of its q-grams with it, and these lie on diagonals (place
in the document minus place in the item) within e of each other. So, per document: look up every
q-gram in the index of benchmark q-grams, count hits by item and diagonal band (bands of width
2 (e + 1) that overlap by half), keep regions whose count reaches the bound, and align item and region
within the band. e is `rate` of the item's length, less for short items so that the bound stays positive.

The index is broadcast; its size is checked: a benchmark of more than `most_chars` characters is dealt
into slices below that bound, each a pass of its own over the documents. Documents are not shuffled.

Bands are counted for ranges of items whose shared q-grams are a bounded number, so that a phrase that is in
very many items needs no more memory.

Defined results: of several places of an item the one with the fewest edits, then the first, is reported; texts
of any length are searched whole; null texts and items count as empty; items with fewer than q characters are left out
(any text would hold them); repeated items count once each; repeated rows are returned each; an empty
benchmark flags nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectext
from .vectext import U64

Q = 8
BITS = 22
FOUND = "array<struct<item_id:long,begin:long,stop:long,edits:int>>"


def simplified(text: Column) -> Column:
    return F.lower(common.normalized(text))


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


class Index:
    """q-grams of items, with their item and place."""

    def __init__(self, ids: list[int], texts: list[str], q: int = Q, rate: float = 0.1) -> None:
        kept = [(i, t) for i, t in zip(ids, texts, strict=True) if len(t) >= q]
        self.ids, self.texts, self.q = [i for i, _ in kept], [t for _, t in kept], q
        self.points = [_points([t]) for t in self.texts]
        size = np.array([len(p) for p in self.points], np.int64)
        self.size, self.edits = size, np.minimum((size * rate).astype(np.int64), (size - q) // q)
        self.least = size + 1 - q - q * self.edits
        grams = [vectext.Prefix(p).spans(np.arange(len(p) - q + 1), np.arange(q, len(p) + 1)) for p in self.points]
        key = np.concatenate(grams) if grams else np.zeros(0, U64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.count = np.unique(key[order], return_counts=True)
        self.posting = np.repeat(np.arange(len(self.grams)), self.count) * len(self.ids) + self.item  # rising: q-gram, then item
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(self.grams >> U64(64 - BITS)).astype(np.int64)] = True

    def regions(self, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, first diagonal) of bands whose count of shared q-grams reaches the item's bound."""
        none = (np.zeros(0, np.int64),) * 3
        if len(points) < self.q or not len(self.grams):
            return none
        begin = np.arange(len(points) - self.q + 1)
        key = vectext.Prefix(points).spans(begin, begin + self.q)
        where = np.flatnonzero(self.seen[(key >> U64(64 - BITS)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.grams, key[where]), len(self.grams) - 1)
        real = self.grams[found] == key[where]
        where, found = where[real], found[real]
        row = np.searchsorted(at, where, "right") - 1
        whole = where + self.q <= at[row + 1]
        where, found, row = where[whole], found[whole], row[whole]
        return self._bands(where, found, row, at, 0, len(self.ids)) if len(where) else none

    def _bands(self, where: np.ndarray, found: np.ndarray, row: np.ndarray, at: np.ndarray, begin: int, end: int, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """regions, for items from begin to end, given the places, q-gram numbers and rows of the q-grams that are in the index."""
        n = len(self.ids)
        start, stop = np.searchsorted(self.posting, found * n + begin), np.searchsorted(self.posting, found * n + end)
        times = stop - start
        if times.sum() > most and end - begin > 1:
            half = (begin + end) // 2
            return tuple(np.concatenate(c) for c in zip(self._bands(where, found, row, at, begin, half, most), self._bands(where, found, row, at, half, end, most), strict=True))
        if not times.any():
            return (np.zeros(0, np.int64),) * 3
        each = np.repeat(start, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item = self.item[each]
        diagonal = np.repeat(where - at[row], times) - self.place[each]
        band = diagonal // (self.edits[item] + 1)
        group, known = np.repeat(row, times) * len(self.ids) + item, None
        low, high = int(band.min()) - 1, int(band.max())
        span, most_key = int(self.size.max()), 1 << 62
        if (int(group.max()) + 1) * (high - low + 1) * span >= most_key:  # numbers of the pairs that occur fit where those of all pairs don't
            known, group = np.unique(group, return_inverse=True)
        kind = group * (high - low + 1) + band - low
        if (int(group.max()) + 1) * (high - low + 1) * span < most_key:
            key = kind * span + self.place[each]
            key.sort()
            kind = key[vectext.runs(key)] // span  # an item's q-gram counts once, however often the text repeats it
        else:
            order = np.lexsort((self.place[each], kind))
            kind = kind[order][vectext.runs_of_pairs(kind[order], self.place[each][order])]
        first = vectext.runs(kind)
        kind, n = kind[first], np.diff(np.append(first, len(kind)))  # half bands; a band is a half and the next one
        group, band = kind // (high - low + 1), kind % (high - low + 1) + low
        joined = np.concatenate((kind, kind[band > low] - 1))
        total = np.concatenate((n, n[band > low]))
        order = np.argsort(joined, kind="stable")
        joined, total = joined[order], total[order]
        first = vectext.runs(joined)
        count, kind = np.add.reduceat(total, first), joined[first]
        group, band = kind // (high - low + 1), kind % (high - low + 1) + low
        group = group if known is None else known[group]
        item = group % len(self.ids)
        good = count >= self.least[item]
        return group[good] // len(self.ids), item[good], (band * (self.edits[item] + 1))[good]

    def align(self, text: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int] | None:
        """(edits, begin, end) of the best place of the item in text with diagonals in its band, if within the budget."""
        e, p = int(self.edits[item]), self.points[item]
        width, far = 2 * (e + 1), 1 << 40
        wide = np.full(len(p) + width + 1, -1, np.int64)  # text by diagonal + row, -1 outside
        begin, end = max(0, diagonal), min(len(text), diagonal + len(wide))
        if begin < end:
            wide[begin - diagonal : end - diagonal] = text[begin:end]
        one, step = 1 << 20, np.arange(width, dtype=np.int64) << 20
        inside = (np.arange(width) + diagonal >= 0) & (np.arange(width) + diagonal <= len(text))
        cost = np.where(inside, np.arange(width, dtype=np.int64), far)  # edits * 2**20 + begin
        for i, c in enumerate(p):
            here = wide[i : i + width]
            new = cost + np.where(here == c, 0, one)
            new[here < 0] = far
            new[:-1] = np.minimum(new[:-1], cost[1:] + one)
            new = np.minimum.accumulate(new - step) + step
            cost = np.minimum(new, far)
        best = int(cost.argmin())
        edits = int(cost[best]) >> 20
        if cost[best] >= far or edits > e:
            return None
        start = diagonal + (int(cost[best]) & (one - 1))
        return edits, start, min(len(text), diagonal + best + len(p))


def _search(index_of, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of()
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("begin", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32())]))
        for part in vectext.parts(batches, "_simple", 1 << 20):
            texts = part.column("_simple").to_pylist()
            points = _points(texts)
            at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            found: list[dict[int, tuple]] = [{} for _ in texts]
            rows, items, diagonals = index.regions(points, at)
            for r, i, d in zip(rows.tolist(), items.tolist(), diagonals.tolist(), strict=True):
                if i not in found[r] and (place := texts[r].find(index.texts[i])) >= 0:
                    found[r][i] = (0, place, place + len(index.texts[i]))  # no alignment can be better
                elif found[r].get(i, (1,))[0] and (hit := index.align(points[at[r] : at[r + 1]], i, d)) and (i not in found[r] or hit < found[r][i]):
                    found[r][i] = hit
            spans = [[{"item_id": index.ids[i], "begin": b, "stop": e, "edits": n} for i, (n, b, e) in sorted(f.items())] for f in found]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(spans, kind)], names=[*carry, "_found"])
        del index
        vectext.settle()

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, carry: list[str], q: int = Q, rate: float = 0.1, most_chars: int = 4 << 20) -> DataFrame:
    """docs[carry] with `found`: one (item_id, begin, stop, edits) for each item that the text holds; places are in the simplified text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), simplified(F.col("text")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = int(total // (most_chars // 2)) + 1  # half, as slices are dealt by hash
    out = docs.select(*carry, simplified(F.col("text")).alias("_simple"), F.array().cast(FOUND).alias("found"))
    for k in range(slices):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).orderBy("item_id", "text").collect()
        send = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
        keep = [*carry, "_simple", "found"]
        schema = common.wider(out, keep, f"_found {FOUND}")
        out = out.mapInArrow(_search(lambda s=send: Index(*s.value, q, rate), keep), schema).withColumn("found", F.concat("found", "_found")).drop("_found")
    return out.drop("_simple")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """docs that hold no benchmark item."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return find_leaks(own, benchmark, ["row"], **options).filter(F.size("found") == 0).select("row.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_leaks(docs, common.table(spark, sf_dir, "benchmark"), ["doc_id"])
    ordered = F.array_sort("found")
    return found.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.size("found").cast("long").alias("n_items"), F.transform(ordered, lambda f: f.item_id).alias("items"), F.array_min(F.transform("found", lambda f: f.edits)).alias("least_edits"), F.array_join(F.transform(ordered, lambda f: F.concat_ws(":", f.begin.cast("string"), f.stop.cast("string"))), ",").alias("spans"))
