"""Ranked lexical search (operator 13): top documents of every item by the Best Position Algorithm over impact lists.

1. One pass over the whole texts keeps, of each document, how many terms it has and which of the items' terms how
   often. What tasks are sent is the dictionary of the items' terms; a hash finds a term, its bytes confirm it.
2. Document counts of terms, number and total length of the documents are sums over all documents.
3. Documents are searched in blocks. A block holds, for each term, its impact list: documents by the term's part of their
   score, highest first. An item reads its lists side by side (sorted access); each document met for the first time is scored
   at once by direct access to its places in all lists of the item, and these places count as seen. A list's
   best position is the end of its contiguous seen places, which may lie far beyond what was read; no
   unseen document can exceed the sum of the impacts right after the best positions. Reading stops as soon as that sum is
   strictly below the k-th best score, so that ties with it are still found. Reads grow from `step` places, doubling.
4. A task carries an item's best k from block to block, so that later blocks stop at once; those of all tasks
   merge in Spark by score, then id.

Items are searched in slices of at most `most_terms` terms in all, so what is broadcast is bounded (some 30 MB)
whatever the number of items; each slice passes over the documents.

Defined results: null, empty and blank texts have no term and are never found, nor do they count; items
without a known term give no row; a score of 0 gives none; equal scores go by id, null ids last; repeated rows, of
documents and of items, count each; texts of any length are taken whole; empty tables give an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, vectext
from .vectext import U64

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sorts a null id behind all others.
LAST = np.iinfo(np.int64).max

_BYTES = np.arange(256)
_BLANK = ~((_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)))
_FOLD = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def terms_of(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0)))


class Spans:
    """Hashes of spans of a buffer, and their first and last eight bytes as numbers."""

    def __init__(self, buf: np.ndarray) -> None:
        self.hash = vectext.Prefix(buf).spans
        # A number at every byte: the eight bytes from there on.
        self.eight = np.ndarray((len(buf),), U64, buf.tobytes() + bytes(8), 0, (1,))

    def ends(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = _MASK[np.minimum(end - begin, 8)]
        return self.eight[begin] & mask, self.eight[np.maximum(begin, end - 8)] & mask


class Dictionary:
    """Numbers of terms: looked up by hash, confirmed by their bytes."""

    def __init__(self, terms: list[str]) -> None:
        self.size = len(terms)
        column = pa.array(terms, pa.string())
        buf, at = vectext.text_bytes(column)
        spans, begin, end = Spans(buf), at[:-1], at[1:]
        key = spans.hash(begin, end) if len(buf) else np.zeros(0, U64)
        head, tail = spans.ends(begin, end) if len(buf) else (key, key)
        order = np.argsort(key)
        self.key, self.number, self.length, self.head, self.tail = (x[order] for x in (key, np.arange(self.size), end - begin, head, tail))
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.key & U64(0xFFFF)).astype(np.int64)] = True
        # By name: terms over 16 bytes, whose middle is in neither number, and those that share a hash.
        twin = np.zeros(self.size, bool)
        twin[1:] = self.key[1:] == self.key[:-1]
        self.by_name = (self.length > 16) | np.isin(self.key, self.key[twin])
        self.name = {terms[k].encode(): int(k) for k in self.number[self.by_name]}

    def find(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in begin, term's number) of the spans that are terms."""
        if not self.size or not len(begin):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        spans = Spans(buf)
        key = spans.hash(begin, end)
        maybe = np.flatnonzero(self.seen[(key & U64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.key, key[maybe]), self.size - 1)
        hit = self.key[at] == key[maybe]
        maybe, at = maybe[hit], at[hit]
        head, tail = spans.ends(begin[maybe], end[maybe])
        same = (self.length[at] == end[maybe] - begin[maybe]) & (self.head[at] == head) & (self.tail[at] == tail)
        number = np.where(same, self.number[at], -1)
        for k in np.flatnonzero(self.by_name[at]):
            number[k] = self.name.get(buf[begin[maybe[k]] : end[maybe[k]]].tobytes(), -1)
        return maybe[number >= 0], number[number >= 0]


_ROWS = "doc_id long, n long, terms array<int>, times array<int>"


def _matches(dictionary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary.value
        for part in vectext.parts(batches, "text", 2 << 20):
            raw, at = vectext.text_bytes(part.column("text"))
            buf = _FOLD[raw]
            begin, end, row = vectext.words(buf, at, _BLANK[raw])
            n = np.bincount(row, minlength=part.num_rows) if len(row) else np.zeros(part.num_rows, np.int64)
            place, number = known.find(buf, begin, end)
            key, times = np.unique(row[place] * max(1, known.size) + number, return_counts=True)
            owner = key // max(1, known.size)
            offsets = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key - owner * max(1, known.size), times)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "terms", "times"])

    return run


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    return run


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Best:
    """The k best (score, id) so far, best first."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def kth(self) -> int:
        """Score that another document must reach to enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def merge(self, score: np.ndarray, ids: np.ndarray) -> None:
        enough = (score > 0) & (score >= self.kth)
        score, ids = np.concatenate((self.score, score[enough])), np.concatenate((self.id, ids[enough]))
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]


class Block:
    """Impact lists of some documents, with direct access from a document to its places in them."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, at: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray, n_docs: int, length: int) -> None:
        self.ids, self.at, self.term = ids, at, term
        doc = np.repeat(np.arange(len(ids)), np.diff(at))
        m = 100 - 90 + (90 * n * n_docs) // length
        self.impact = weight[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[doc]))
        order = np.lexsort((-self.impact, term))
        self.listed, self.height = doc[order], self.impact[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.begin = np.searchsorted(term[order], np.arange(len(weight) + 1))
        self.seen_doc, self.seen_place, self.wanted = np.zeros(len(ids), bool), np.zeros(len(order), bool), np.zeros(len(weight), bool)
        self.reads = 0

    def search(self, terms: np.ndarray, best: Best, step: int = 32) -> None:
        """Best positions: the documents of the block that belong into best."""
        begin, end = self.begin[terms], self.begin[terms + 1]
        some = end > begin
        terms, begin, end = terms[some], begin[some], end[some]
        first = begin.copy()  # the first unseen place of each list: right after its best position
        read, docs_met, places_met = 0, [], []
        self.wanted[terms] = True
        while True:
            left = first < end
            if not left.any() or int(self.height[first[left]].sum()) < best.kth:
                break
            span = begin[:, None] + np.arange(read, read + step)
            near = self.listed[span[span < end[:, None]]]
            self.reads += len(near)
            new = near[~self.seen_doc[near]]
            if len(new):
                self.seen_doc[new] = True
                new = np.unique(new)
                size = self.at[new + 1] - self.at[new]
                start = np.cumsum(size) - size
                own = np.repeat(self.at[new] - start, size) + np.arange(int(size.sum()))
                asked = self.wanted[self.term[own]]
                best.merge(np.add.reduceat(np.where(asked, self.impact[own], 0), start), self.ids[new])
                places = self.place[own[asked]]
                self.seen_place[places] = True
                docs_met.append(new)
                places_met.append(places)
            for k in np.flatnonzero(left):
                rest = self.seen_place[first[k] : end[k]]
                gap = int(rest.argmin())
                first[k] = end[k] if rest[gap] else first[k] + gap
            read, step = read + step, 2 * step
        self.wanted[terms] = False
        for d, p in zip(docs_met, places_met, strict=True):
            self.seen_doc[d], self.seen_place[p] = False, False


#: Postings of a block (about 100 bytes each while it is searched).
BLOCK = 1 << 20


def _search(sent, k: int, n_docs: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = sent.value
        best = [Best(k) for _ in items]

        def search(held: list[pa.RecordBatch]) -> None:
            part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            terms, times = part.column("terms"), part.column("times")
            at = np.concatenate(([0], np.cumsum(terms.value_lengths().to_numpy()))).astype(np.int64)
            block = Block(part.column("doc_id").fill_null(int(LAST)).to_numpy(), part.column("n").to_numpy(), at, terms.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64), weight, n_docs, length)
            for terms_of_item, b in zip(items, best, strict=True):
                block.search(terms_of_item, b)

        held, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                held.append(batch.slice(lo, 4096))
                size += len(held[-1].column("terms").flatten())
                if size >= BLOCK:
                    search(held)
                    held, size = [], 0
        if held:
            search(held)
        number = np.repeat(np.arange(len(items)), [len(b.score) for b in best])
        if len(number):
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.concatenate([b.id for b in best])), pa.array(np.concatenate([b.score for b in best]))], names=["item", "doc_id", "score"])

    return run


def rank(items: DataFrame, docs: DataFrame, k: int = 10, most_terms: int = 1 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of docs(doc_id, text) for each row of items(item_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), terms_of(F.col("text")).alias("terms")).filter(F.size("terms") > 0)
    asked = common.stored(asked, "lexical-items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    slices, found = -(-total // most_terms) or 1, None
    for s in range(slices):
        t = asked.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(slices)) == s).toArrow()  # about most_terms terms
        if t.num_rows:
            got = _slice(spark, docs, t["item_id"].to_pylist(), t["terms"].to_pylist(), k)
            found = got if found is None else found.unionAll(got)
    out = "item_id long, rank int, doc_id long, score long"
    return spark.createDataFrame([], out) if found is None else found


def _slice(spark: SparkSession, docs: DataFrame, item_ids: list, item_terms: list[list[str]], k: int) -> DataFrame:
    names = sorted({t for ts in item_terms for t in ts})
    number = {t: i for i, t in enumerate(names)}
    rows = common.stored(docs.mapInArrow(_matches(spark.sparkContext.broadcast(Dictionary(names))), _ROWS), "lexical-postings")
    n_docs, length = rows.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(names), np.int64)
    counted = rows.select("terms").mapInArrow(_frequencies(len(names)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a number a term of the slice
    df[counted["term"].to_numpy()] = counted["df"].to_numpy()
    sent = spark.sparkContext.broadcast(([np.array([number[t] for t in ts], np.int64) for ts in item_terms], weights(n_docs, df)))
    hits = rows.filter(F.size("terms") > 0).mapInArrow(_search(sent, k, n_docs, max(1, length)), "item long, doc_id long, score long")
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    hits = hits.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)
    ids = spark.createDataFrame(list(enumerate(item_ids)), "item long, item_id long")
    return hits.join(F.broadcast(ids), "item").select("item_id", "rank", F.when(F.col("doc_id") != int(LAST), F.col("doc_id")).alias("doc_id"), "score")


def op13_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(common.table(spark, sf_dir, "benchmark"), common.table(spark, sf_dir, "documents"))


_TERMS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"
OP13_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL), l AS (SELECT r, doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
 st AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM l), w AS (SELECT r, unnest(ts) AS term FROM l), p AS (SELECT r, term, count(*) AS tf FROM w GROUP BY r, term),
 f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), st),
 i AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark WHERE text IS NOT NULL),
 s AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // total))))::BIGINT AS score FROM i JOIN f USING (term) JOIN p USING (term) JOIN l USING (r), st GROUP BY q, item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""
