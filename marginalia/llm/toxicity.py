"""Toxicity (operator 10): nearest labelled examples by exact TF-IDF cosine, block-max inverted index.

Labelled examples are a bounded sample: about `most_examples` labelled rows by a hash of the id; they and
their term counts are all that reaches the driver. Terms are lower-cased letter runs. The vocabulary
is every term of the sample, none left out: a term that no example has adds to no cosine and changes all
cosines of a text by one factor, so it changes no order and no vote. A weight is (1 + ln tf) * idf * link,
and vectors are of unit length; idf comes from the document frequencies over all documents, link is
the term's chi-square with the label over the number of examples (with equal weights function words
would decide who is near).

The index holds a posting list a term. Lists of more than a share 1 / FULL of the examples are full rows in
blocks of BLOCK examples with the largest weight of each block. A text reads its short lists first: the k-th
best sum of these is a least cosine, and a block of the long lists is read only where its largest weights can
reach it. So the k nearest are exact; ties go to the smaller id; sums run in one order for each text, so that
scores don't depend on the batch. Votes weighted by squared cosine give a share, which is calibrated by a
monotone fit of votes where two halves of the examples judge each other.

Every whole text is read twice in Arrow batches, to count document frequencies and to score; shuffled are the
labels of the sample and one counter a term and task.

Defined results: texts of any length are scored whole; null counts as empty text; a text that shares no term
with an example gets the calibrated share of label 1 among the examples; labels other than 0 and 1 are
not learned from; an id with both labels counts as 1; without examples every score is 0; repeated rows are
returned each, a repeated labelled id is one example a row; an empty table gives an empty result; other
columns are ignored, also where their names clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, sketch, vectext
from .vectext import U64

BLOCK = 64
#: A term in more than one of FULL examples is a full row of the index.
FULL = 8


def term_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term hash, count) of lower-cased texts, sorted by row, then term."""
    if len(column) > 1 << 16:  # a row's number has 16 bits below
        each = [term_counts(column.slice(k, 1 << 16)) for k in range(0, len(column), 1 << 16)]
        return np.concatenate([r + (k << 16) for k, (r, _, _) in enumerate(each)]), np.concatenate([t for _, t, _ in each]), np.concatenate([n for _, _, n in each])
    buf, at = vectext.text_bytes(column)
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    letter = ((buf >= 97) & (buf <= 122)) | (buf >= 128)
    clean = np.where(letter, buf, 32).astype(np.uint8)
    begin, end, row = vectext.words(clean, at)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    term = vectext.Prefix(clean).spans(begin, end) >> U64(16)
    key = (row.astype(U64) << U64(48)) | term
    key.sort()
    first = vectext.runs(key)
    return (key[first] >> U64(48)).astype(np.int64), key[first] & U64((1 << 48) - 1), np.diff(np.append(first, len(key)))


Example = tuple[int, int, np.ndarray, np.ndarray]


def flat(rows: list[Example]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the example, term, count) of all examples."""
    number = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    return number, np.concatenate([np.zeros(0, U64), *(r[2] for r in rows)]), np.concatenate([np.zeros(0, np.int64), *(r[3] for r in rows)])


def gather(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges first..end, one range after another, and the number of the range of each."""
    size = end - first
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) + (first - np.cumsum(size) + size)[which], which


class Index:
    """Block-max inverted index of labelled examples over the vocabulary `terms`, each with its idf."""

    def __init__(self, rows: list[Example], terms: np.ndarray, idf: np.ndarray, k: int) -> None:
        n, self.k, self.terms = len(rows), k, terms
        self.ids, self.y = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
        row, term, tf = flat(rows)
        place = np.searchsorted(terms, term)
        df = np.bincount(place, minlength=len(terms)).astype(float)
        self.share = self.y.mean() if n else 0.0
        spread = df * (n - df) * self.share * (1 - self.share)
        self.weight = idf * (np.bincount(place, self.y[row], minlength=len(terms)) - df * self.share) ** 2 / np.maximum(spread, 1e-9)
        row, place, value = self.vectors(row, term, tf, n)
        top = np.zeros(n, np.int64)  # the place of the heaviest term: like examples next to like, so that block maxima are tight
        order = np.lexsort((place, value, row))
        top[row[order]] = place[order]
        new = np.empty(n, np.int64)
        new[np.lexsort((self.ids, top))] = np.arange(n)
        self.ids[new], self.y[new] = self.ids.copy(), self.y.copy()
        order = np.lexsort((new[row], place))
        self.example, self.value, place = new[row][order].astype(np.int32), value[order], place[order]
        self.at = np.searchsorted(place, np.arange(len(terms) + 1))  # the postings of each term
        # Terms of many examples are full rows in blocks, with the largest weight of each block.
        many = np.flatnonzero(np.diff(self.at) * FULL > n)
        self.full = np.full(len(terms), -1)
        self.full[many] = np.arange(len(many))
        self.rows = np.zeros((len(many), -(-n // BLOCK), BLOCK))
        for f, t in enumerate(many.tolist()):
            self.rows[f].reshape(-1)[self.example[self.at[t] : self.at[t + 1]]] = self.value[self.at[t] : self.at[t + 1]]
        self.most = self.rows.max(2, initial=0)

    def vectors(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors as (row, place of the term, weight), by row, then term; sums run in that order, so that they don't depend on the batch."""
        place = np.searchsorted(self.terms, term)
        known = place < len(self.terms)
        known[known] = self.terms[place[known]] == term[known]
        row, place = row[known], place[known]
        value = (1 + np.log(tf[known])) * self.weight[place]
        size = np.sqrt(np.bincount(row, value * value, minlength=n))[row]
        some = size > 0
        return row[some], place[some], value[some] / size[some]

    def nearest(self, place: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (at most k) nearest examples of a unit vector that share a term with it, and their cosines, by cosine, then id."""
        full = self.full[place]
        rare, often = full < 0, full >= 0
        post, which = gather(self.at[place[rare]], self.at[place[rare] + 1])
        sim = np.bincount(self.example[post], value[rare][which] * self.value[post], minlength=self.rows.shape[1] * BLOCK)
        sim = sim.astype(float).reshape(-1, BLOCK)
        # What is shared in rare terms is a least cosine; a block that can't reach the k-th best of these is not read further.
        enough = np.partition(sim, sim.size - self.k, axis=None)[sim.size - self.k] if sim.size >= self.k else 0.0
        blocks = np.flatnonzero(sim.max(1) + value[often] @ self.most[full[often]] >= enough * (1 - 1e-9))
        sim = sim[blocks]
        some = slice(None) if len(blocks) == len(self.most.T) else blocks
        for f, v in zip(full[often].tolist(), value[often].tolist(), strict=True):
            sim += v * self.rows[f, some]
        example = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        sim = sim.ravel()
        least = max(np.partition(sim, len(sim) - self.k)[len(sim) - self.k], 0) if len(sim) >= self.k else 0
        good = np.flatnonzero((sim >= least) & (sim > 0))
        good = good[np.lexsort((self.ids[example[good]], -sim[good]))][: self.k]
        return example[good], sim[good]

    def votes(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Share of label 1 among the nearest, weighted by squared cosine, the examples' share where there is none; the examples, the cosines."""
        out, best, sim = np.full(n, self.share), np.full((n, self.k), -1), np.zeros((n, self.k))
        row, place, value = self.vectors(row, term, tf, n)
        at = np.searchsorted(row, np.arange(n + 1))
        for i in np.flatnonzero(np.diff(at)).tolist():
            near, cosine = self.nearest(place[at[i] : at[i + 1]], value[at[i] : at[i + 1]])
            if len(near):
                best[i, : len(near)], sim[i, : len(near)] = near, cosine
                weight = (cosine / cosine[0]) ** 2
                out[i] = (weight * self.y[near]).sum() / weight.sum()
        return out, best, sim


class Model:
    """Index over all examples, and the calibration of its votes: two halves of the examples judge each other, so no label enters its own vote."""

    def __init__(self, rows: list[Example], terms: np.ndarray, idf: np.ndarray, k: int) -> None:
        rows = sorted(rows, key=lambda r: r[0])
        self.index = Index(rows, terms, idf, k)
        self.steps = (np.zeros(1), np.array([self.index.share]))
        if len(rows) > 1:
            halves = rows[::2], rows[1::2]
            votes = [np.concatenate([other.votes(*(a for a in flat(half[b : b + 256])), len(half[b : b + 256]))[0] for b in range(0, len(half), 256)]) for half, other in zip(halves, (Index(h, terms, idf, k) for h in halves[::-1]), strict=True)]
            self.steps = monotone(np.concatenate(votes), np.array([r[1] for half in halves for r in half], np.float64))

    def score(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, and the examples and cosines behind them."""
        votes, best, sim = self.index.votes(row, term, tf, n)
        return np.clip(np.interp(votes, *self.steps), 0, 1), best, sim


def monotone(v: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps of the mean of y over v (pool adjacent violators), each shrunk a little to the overall mean."""
    order = np.argsort(v, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(v[order].tolist(), y[order].tolist(), strict=True):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][0] / pools[-2][2] == pools[-1][0] / pools[-1][2]):
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    p, mean = np.array(pools), y.mean()
    return p[:, 0] / p[:, 2], (p[:, 1] + mean) / (p[:, 2] + 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(common.id_bucket(doc_id, 5) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_examples: int = 4000, k: int = 15) -> Model:
    """Model of about most_examples rows of labels(doc_id, label), with the texts of docs(doc_id, text) and the document frequencies over all docs."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    n = known.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("example sample")), F.lit(1 << 20)) / float(1 << 20)
    sample = known.filter(draw < min(1.0, most_examples / max(n, 1))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vectext.parts(batches, "text", 2 << 20):
            row, term, tf = term_counts(part.column("text"))
            at = np.searchsorted(row, np.arange(part.num_rows + 1))
            cut = lambda a: pa.array([a[at[i] : at[i + 1]].tobytes() for i in range(part.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), cut(term), cut(tf.astype(np.int64))], names=["doc_id", "y", "term", "tf"])

    # The sample is bounded by most_examples rows of two numbers, so it is broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).join(F.broadcast(sample), "doc_id")
    got = texts.select("doc_id", "y", "text").mapInArrow(count, "doc_id long, y int, term binary, tf binary").collect()
    rows = [(r[0], r[1], np.frombuffer(bytes(r[2]), U64), np.frombuffer(bytes(r[3]), np.int64)) for r in got]
    terms = np.unique(flat(rows)[1])
    return Model(rows, terms, inverse_frequencies(docs, terms), k)


def inverse_frequencies(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """ln((1 + documents) / (1 + documents with the term)) + 1 of sorted terms, counted over all docs(text)."""
    known = docs.sparkSession.sparkContext.broadcast(terms)
    size = -(-(len(terms) + 1) // sketch.CHUNK) * sketch.CHUNK

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        terms = known.value
        for part in vectext.parts(batches, "_lower", 1 << 20):
            term = term_counts(part.column("_lower"))[1]
            place = np.searchsorted(terms, term)
            place = place[place < len(terms)] if not len(terms) else place[terms[np.minimum(place, len(terms) - 1)] == term]
            yield np.concatenate((place, np.full(part.num_rows, len(terms))))  # the counter after the last term counts the documents

    counts = sketch.totals(docs.select(F.lower("text").alias("_lower")), slots, size)
    return np.log((1 + counts[len(terms)]) / (1 + counts[: len(terms)])) + 1


def score_texts(docs: DataFrame, model: Model, carry: list[str], evidence: int = 3) -> DataFrame:
    """docs[carry] with score, and evidence: the nearest examples' ids and cosines."""
    send = docs.sparkSession.sparkContext.broadcast(model)
    schema = common.wider(docs, carry, "score double, evidence array<struct<doc_id:bigint,cosine:double>>")
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = send.value
        ids = model.index.ids
        for part in vectext.parts(batches, "_lower", 1 << 20):
            for b in range(0, part.num_rows, 4096):
                piece = part.slice(b, 4096)
                score, best, sim = model.score(*term_counts(piece.column("_lower")), piece.num_rows)
                shown = [[{"doc_id": int(ids[p]), "cosine": s} for p, s in zip(ps, ss, strict=True) if p >= 0] for ps, ss in zip(best[:, :evidence].tolist(), sim[:, :evidence].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in carry), pa.array(score), pa.array(shown, kind)], names=[*carry, "score", "evidence"])

    return docs.select(*carry, F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("_lower")).mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = common.table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    scored = score_texts(docs, fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
