"""A text index that is built once, stored, and refreshed by small segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.segments import SegmentTables
from . import index
from .vector_search import _Heap

#: Query terms that tasks are sent at once; products and scores that a task makes at once.
MOST_ASKED, BLOCK = 1_000_000, 1 << 21
#: Tokens whose postings are shuffled at once, and the most parts that a change's postings are shuffled in.
PART_TOKENS, MOST_PARTS = 1 << 25, 8
_NO_ID = -(1 << 63)

def small_side(df: DataFrame, n: int, most: int = 1_000_000) -> DataFrame:
    """df of n rows of a few numbers each: broadcast up to `most` rows, else joined as Spark sees fit."""
    return F.broadcast(df) if n <= most else df


class StoredIndex(SegmentTables):
    """BM25 index of documents (id, text) in segments.

    postings(term, id, tf, dl) and terms(term, df) are bucketed and sorted by term, docs(id, dl) and dead(id) by id. A segment
    holds the postings of the documents that came, what they and the replaced ones change in the counts of terms, and the
    replaced ids: an older posting of such an id is dead. Readers merge: counts are sums over segments, and a posting
    counts if no later segment has its id among the dead. After `most_segments` a change compacts first.

    A null text counts as empty; a null id is an id like others; of several rows with one id in a change, all are indexed.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long", tokenizer: Callable[[Column], Column] = tx.tokenize, buckets: int = 8, most_segments: int = 16, more: dict[str, tuple[str, str]] | None = None) -> None:
        tables = {"postings": (f"term string, id {id_type}, tf long, dl long", "term"), "terms": ("term string, df long", "term"), "docs": (f"id {id_type}, dl long", "id"), "dead": (f"id {id_type}", "id")}
        super().__init__(spark, path, tables | (more or {}), buckets)
        self.tokenizer, self.most_segments, self.id_type = tokenizer, most_segments, id_type

    def live_docs(self) -> DataFrame:
        """id, dl, seq of the documents that count, each with the segment that holds it."""
        return self._without_dead(self.table("docs"))

    def _without_dead(self, rows: DataFrame) -> DataFrame:
        """rows(id, seq, ...) whose id isn't dead in a later segment."""
        if not self.facts.get("n_dead"):
            return rows
        gone = self.table("dead").groupBy(F.col("id").alias("_id")).agg(F.max("seq").alias("_gone"))
        gone = small_side(gone, int(self.facts["n_dead"]))
        return rows.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("seq") < F.col("_gone")), "left_anti")

    def live(self, name: str) -> DataFrame:
        if name in ("postings", "docs"):
            return self._without_dead(self.table(name)).drop("seq")
        if name == "terms":
            return self.table("terms").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        return self.table(name).filter(F.lit(False)).drop("seq") if name == "dead" else super().live(name)

    def compacted(self) -> dict[str, float]:
        return {**self.facts, "n_dead": 0.0}

    def begin(self) -> int:
        """The number of a new segment, after a compaction if there are many."""
        if len(self.lines) >= self.most_segments:
            self.compact()
        return self.new_seq()

    def add(self, new: DataFrame, gone: DataFrame | None = None, job: str = "", batch: int = 0, seq: int | None = None) -> None:
        """Index new(id, text) in place of what is there under these ids, without the ids of gone(id). seq: from begin(), if further tables have this segment already; they are committed with it."""
        seq, first = self.begin() if seq is None else seq, not self.lines
        tokens = new.select("id", self.tokenizer(F.coalesce("text", F.lit(""))).alias("tokens"))
        self.write("docs", tokens.select("id", F.size("tokens").cast("long").alias("dl")), seq)
        docs = self.table("docs", [seq])
        n_docs, n_tokens = docs.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        # Counted in the text's task and shuffled once. Shuffled postings are some times the text on disk, so those of many documents go part by part.
        parts = min(MOST_PARTS, 1 + n_tokens // PART_TOKENS)
        for k in range(parts):
            own = tokens if parts == 1 else tokens.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)
            self.write("postings", own.mapInArrow(_counted, f"term string, id {self.id_type}, tf long, dl long"), seq)
        terms, n_dead = self.table("postings", [seq]).groupBy("term").agg(F.count("*").alias("df")), 0.0
        if not first:
            ids = docs.select("id") if gone is None else docs.select("id").unionByName(gone.select("id"))
            # Nulls meet nulls; the sides are bucketed by id, the ids of a change are few.
            old = self.live_docs().join(ids.distinct().withColumnRenamed("id", "_new"), F.col("id").eqNullSafe(F.col("_new")), "left_semi").persist()
            held, lost, where, n_old = old.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)), F.collect_set("seq"), F.count_distinct(F.struct("id"))).first()  # at most most_segments numbers
            if held:
                self.write("dead", old.select("id").distinct(), seq)
                touched = self.table("postings", where)
                of_old = small_side(old.select(F.col("id").alias("_id"), F.col("seq").alias("_seq")).distinct(), n_old)
                less = touched.join(of_old, F.col("id").eqNullSafe(F.col("_id")) & (F.col("seq") == F.col("_seq")), "left_semi").groupBy("term").agg((-F.count("*")).alias("df"))
                terms = terms.unionByName(less).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
                n_dead = float(n_old)
            old.unpersist()
            n_docs, n_tokens, n_dead = n_docs - held + self.facts["n_docs"], n_tokens - lost + self.facts["n_tokens"], n_dead + self.facts["n_dead"]
        self.write("terms", terms, seq)
        seqs = [r["seq"] for r in self.lines] + [seq]
        df = self.table("terms", seqs).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        mean = df.agg(F.avg(F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0]
        self.commit(seq, job, batch, {"n_docs": float(n_docs), "n_tokens": float(n_tokens), "n_dead": n_dead, "floor": index.EPSILON * (mean or 0.0)})

    def index(self) -> index.Bm25Index:
        """The live index as plain tables."""
        stats = self.spark.createDataFrame([(int(self.facts.get("n_docs", 0)), int(self.facts.get("n_tokens", 0)))], "n_docs long, n_tokens long")
        return index.Bm25Index(self.live("postings").select("term", "id", "tf", "dl"), self.live("terms"), stats)

    def idf(self, terms: DataFrame | None = None) -> DataFrame:
        """term, df, idf; of all terms or of those in terms(term)."""
        df = self.table("terms") if terms is None else self.table("terms").join(terms, "term", "left_semi")
        df = df.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        raw = F.log(F.lit(self.facts.get("n_docs", 0.0)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        return df.select("term", "df", F.when(raw < 0, F.lit(self.facts.get("floor", 0.0))).otherwise(raw).alias("idf"))

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """(terms, (query_id, term, w), their number) of queries(query_id, text)."""
        asked = queries.select("query_id", F.explode(self.tokenizer(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
        n = asked.count()  # the queries alone
        terms = small_side(asked.select("term").distinct(), n)
        return terms, asked.join(self.idf(terms), "term").select("query_id", "term", (F.col("qf") * F.col("idf")).alias("w")), n

    def _parts(self, terms: DataFrame) -> DataFrame:
        """term, id, part: what an occurrence of a term in a live document is worth; all terms where none is dead."""
        postings = self.table("postings")
        if self.facts.get("n_dead"):
            postings = self._without_dead(postings.join(terms, "term", "left_semi"))
        length = index.K1 * (1 - index.B + index.B * F.col("dl") * self.facts.get("n_docs", 0.0) / max(1.0, self.facts.get("n_tokens", 0.0)))
        return postings.select("term", "id", (F.col("tf") * (index.K1 + 1) / (F.col("tf") + length)).alias("part"))

    def score(self, queries: DataFrame) -> DataFrame:
        """query_id, id, score of queries(query_id, text), as index.score_bm25. Postings are read by term where they lie; only scores are shuffled."""
        terms, weighted, n = self._asked(queries)
        hits = self._parts(terms).join(small_side(weighted, n), "term")
        return hits.groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") * F.col("part")), 6).alias("score"))

    def _best(self, queries: DataFrame, k: int, floor: float) -> DataFrame:
        """query_id, id, score, rank of the k best of score() from floor on.

        The postings of the queries' terms are dealt by document, so that a document's scores are made in one task, which keeps k a
        query: what is shuffled grows with these postings, not with documents times queries.
        """
        terms, weighted, n = self._asked(queries)
        if self.id_type != "long" or n > MOST_ASKED:
            return index.best(self.score(queries).filter(F.col("score") >= floor), k)
        own = weighted.toArrow()  # MOST_ASKED rows at most
        term, query = own["term"].combine_chunks().dictionary_encode(), own["query_id"].combine_chunks().dictionary_encode()
        no = term.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(no, kind="stable")
        start = np.searchsorted(no[order], np.arange(len(term.dictionary) + 1))
        numbered = self.spark.createDataFrame(pa.table({"term": term.dictionary.cast(pa.string()), "no": np.arange(len(term.dictionary), dtype=np.int32)}), "term string, no int")
        numbers = self.spark.createDataFrame(pa.table({"no": np.arange(len(query.dictionary)), "query_id": query.dictionary}))
        # Live parts of many documents: ids in order, so that a document ends where the next begins.
        dealt = self._parts(terms).join(F.broadcast(numbered), "term").select(F.coalesce("id", F.lit(_NO_ID)).alias("id"), "no", "part")
        weights = own["w"].combine_chunks().to_numpy()[order]
        found = dealt.repartition("id").sortWithinPartitions("id").mapInArrow(_scorer(start, query.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order], weights, len(query.dictionary), k, floor), "no long, id long, score double")
        hits = found.join(F.broadcast(numbers), "no").select("query_id", F.when(F.col("id") != _NO_ID, F.col("id")).alias("id"), "score")
        return index.best(hits, k)

    def topk(self, queries: DataFrame, k: int = 10, floor: float = 0.1, parents: DataFrame | None = None) -> DataFrame:
        """query_id, id, score, rank, as index.bm25_topk."""
        if parents is None:
            return self._best(queries, k, floor)
        return index.best(index.first_per_parent(self._best(queries, 2 * k, floor).drop("rank").join(parents, "id")), k)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, id, tf, dl of rows (id, tokens)."""
    for batch in batches:
        lists = batch.column("tokens")
        flat, size = lists.flatten().dictionary_encode(), np.diff(lists.offsets.to_numpy())
        if not len(flat):
            continue
        wide, code = len(flat.dictionary), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pair, tf = np.unique(np.repeat(np.arange(len(size)), size) * wide + code, return_counts=True)
        row = pa.array(pair // wide)
        yield pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(pair % wide)), batch.column("id").take(row), pa.array(tf.astype(np.int64)), pa.array(size.astype(np.int64)).take(row)], names=["term", "id", "tf", "dl"])


def _scorer(start: np.ndarray, query: np.ndarray, weight: np.ndarray, n_queries: int, k: int, floor: float):
    """Rows (id, no, part) in order of id -> the k best (query number, id, score) of a task. Term `no` has the queries and weights from start[no] to start[no + 1]."""
    count = np.diff(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap, held = _Heap(np.arange(n_queries), k), []
        heap.floor = np.full(n_queries, float(floor))

        def scored(ids: np.ndarray, no: np.ndarray, part: np.ndarray) -> None:
            """Scores of whole documents."""
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            made = np.append(0, np.cumsum(count[no]))[np.append(first, len(ids))]
            lo = 0
            while lo < len(first):
                hi = min(max(lo + 1, int(np.searchsorted(made, made[lo] + BLOCK, "right")) - 1), lo + max(1, BLOCK // n_queries), len(first))
                own = slice(first[lo], first[hi] if hi < len(first) else len(ids))
                times = count[no[own]]
                at = np.repeat(start[no[own]] - np.cumsum(times) + times, times) + np.arange(times.sum())
                doc = np.repeat(np.arange(hi - lo), np.diff(np.append(first[lo:hi], own.stop)))
                place = np.repeat(doc, times) * n_queries + query[at]
                score = np.bincount(place, np.repeat(part[own], times) * weight[at], (hi - lo) * n_queries)
                if floor <= 0:  # a document without any term of a query isn't found
                    apart = np.ones(len(score), bool)
                    apart[place] = False
                    score[apart] = -np.inf
                heap.merge_rounded(score.reshape(hi - lo, n_queries).T, ids[first[lo:hi]])
                lo = hi

        def whole(last: bool) -> None:
            nonlocal held
            ids, no, part = (np.concatenate(x) for x in zip(*held, strict=True))
            end = len(ids) if last else int(np.searchsorted(ids, ids[-1]))  # the last document may go on
            if end:
                scored(ids[:end], no[:end], part[:end])
            held = [(ids[end:], no[end:], part[end:])]

        n = 0
        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(c).to_numpy() for c in ("id", "no", "part")))
                n += batch.num_rows
                if n >= 1 << 16:
                    whole(False)
                    n = len(held[0][0])
        if held:
            whole(True)
        yield pa.RecordBatch.from_arrays([pa.array(heap.query), pa.array(heap.id), pa.array(heap.score)], names=["no", "id", "score"])

    return run
