"""Language ID (operator 6): error-correcting output codes over character n-grams.

Each language has a codeword; one binary classifier a bit, linear over hashed byte trigrams of the
lower-cased text, predicts that bit. Decoding weighs each bit's loss by how well its classifier does
on the training rows and takes the nearest codeword; a second codeword nearly as near flags the text
as ambiguous.

Training uses a bounded sample: about `per_language` rows of each of the `most_languages` languages with the
most rows, chosen by a hash of id and text, so the driver gets a bounded number of rows whatever the input. Prediction reads every
whole text in Arrow batches; nothing is shuffled.

Defined results: null text, or text without a letter, gives `und` with score 0; null labels and null texts are
not learned from; ties go to the language that comes first by code point; texts of any length are read whole;
other columns are ignored, whatever their names; with no labelled row everything is `und`; with one language all other text is that
language; repeated rows are returned each; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectext

DIM = 2048
UNKNOWN = "und"


def features(column: pa.Array, dim: int = DIM) -> np.ndarray:
    """Rows of square-rooted trigram counts with unit length. Bytes that are no letters count as one blank."""
    buf, at = vectext.text_bytes(column)
    n = len(column)
    out = np.zeros((n, dim), np.float32)
    if not len(buf):
        return out
    letter = ((buf >= 97) & (buf <= 122)) | (buf >= 128)
    b = np.where(letter, buf, 32).astype(np.uint32)
    c = np.concatenate((b, [32, 32])).astype(np.uint32)
    gram = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    slot = (gram >> np.uint32(32 - int(dim - 1).bit_length())).astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(at))
    keep = letter | np.concatenate((letter[1:], [False]))
    keep &= np.concatenate((row[1:] == row[:-1], [False]))
    out += np.bincount(row[keep] * dim + slot[keep], minlength=n * dim).reshape(n, dim).astype(np.float32)
    np.sqrt(out, out=out)
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.maximum(size, 1e-9)


def codewords(n: int, most: int = 63, seed: int = 5) -> np.ndarray:
    """n rows of +1/-1: all splits in two where these are few, else random ones; no constant or repeated column."""
    if n < 2:
        return np.ones((n, 1))
    if 2 ** (n - 1) - 1 <= most:
        return np.array([[1 if x else -1 for x in (True, *s)] for s in itertools.product((True, False), repeat=n - 1)][1:]).T.astype(float)
    rng = np.random.default_rng(seed)
    columns: dict[tuple[int, ...], None] = {}
    while len(columns) < most:
        c = rng.choice((-1, 1), n)
        if abs(c.sum()) < n:
            columns[tuple(c * c[0])] = None
    return np.array(list(columns)).T.astype(float)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Trust-weighted mean squared hinge loss of each codeword."""
        f = x @ self.weights[:-1] + self.weights[-1]
        loss = np.maximum(0, 1 - f[:, None, :] * self.code[None]) ** 2
        return (loss * self.trust).sum(2) / self.trust.sum()


def train(x: np.ndarray, labels: np.ndarray, ridge: float = 0.5) -> Model:
    """Ridge regression on the bits, each language weighing the same; bits are trusted by their share of right training rows."""
    languages = sorted(set(labels.tolist()))
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((x.shape[1] + 1, code.shape[1])), np.ones(code.shape[1]))
    y = np.searchsorted(languages, labels)
    target = code[y]
    weight = (len(y) / np.bincount(y) / len(languages))[y][:, None]
    a = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.linalg.solve(a.T @ (a * weight) + ridge * np.eye(a.shape[1]), a.T @ (target * weight))
    right = ((a @ w) * target > 0).mean(0)
    return Model(languages, code, w.astype(np.float32), np.log(np.maximum(right, 0.51) / np.maximum(1 - right, 1e-3)))


def fit(docs: DataFrame, label: str = "lang", per_language: int = 800, most_languages: int = 256) -> Model:
    """Model from docs(doc_id, text, label); about per_language rows of each language come to the driver as features."""
    known = docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(F.col(label)).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(label)).limit(most_languages).collect()}
    if not counts:
        return Model([], np.ones((0, 1)), np.zeros((DIM + 1, 1)), np.ones(1))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("language sample")), F.lit(1 << 20)) / float(1 << 20)
    sample = known.filter(draw < F.element_at(share, F.col(label))).select(F.lower("text").alias("text"), F.col(label).alias("label"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vectext.parts(batches, "text", 2 << 20):
            x = features(part.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), part.column("label")], names=["x", "label"])

    rows = sample.mapInArrow(compute, "x binary, label string").toArrow()
    if not rows.num_rows:
        return Model([], np.ones((0, 1)), np.zeros((DIM + 1, 1)), np.ones(1))
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float16).reshape(-1, DIM).astype(np.float32)
    return train(x, np.array(rows["label"].to_pylist()))


def predict(docs: DataFrame, model: Model, carry: list[str], margin: float = 0.02) -> DataFrame:
    """docs[carry] with lang_pred, score and ambiguous, for docs(text, carry...)."""
    schema = docs.select(*carry).schema
    for f in (("lang_pred", "string"), ("score", "double"), ("ambiguous", "boolean")):
        schema = schema.add(*f)
    languages = np.array([*model.languages, UNKNOWN])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vectext.parts(batches, "_lower", 1 << 20):
            n = part.num_rows
            spoken = part.column("_spoken").to_numpy(zero_copy_only=False).astype(bool) & bool(model.languages)
            pick, sure, unsure = np.full(n, len(languages) - 1), np.zeros(n), np.ones(n, bool)
            for k in range(0, n, 512):
                rows = np.flatnonzero(spoken[k : k + 512]) + k
                if not len(rows):
                    continue
                loss = model.losses(features(part.column("_lower").slice(k, 512))[rows - k])
                order = np.argsort(loss, axis=1, kind="stable")
                best = loss[np.arange(len(rows)), order[:, 0]]
                p = np.exp(-4 * (loss - best[:, None]))
                pick[rows], sure[rows] = order[:, 0], 1 / p.sum(1)
                unsure[rows] = loss[np.arange(len(rows)), order[:, 1]] - best < margin if loss.shape[1] > 1 else False
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(languages[pick]), pa.array(sure), pa.array(unsure)], names=[*carry, "lang_pred", "score", "ambiguous"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*carry, F.lower(text).alias("_lower"), text.rlike(r"\p{L}").alias("_spoken")).mapInArrow(score, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(common.id_bucket(doc_id, 4) == 2, F.lit(False))


def identify(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Train on the rows that are not held out and predict all."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return predict(docs, model, carry or ["doc_id"])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return identify(docs).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
