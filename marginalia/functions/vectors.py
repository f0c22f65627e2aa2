"""Column functions on vectors. Sums run in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def to_text(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))


def from_text(c: Column) -> Column:
    return F.from_json(c, "array<float>")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def embed_hash(c: Column, dim: int = 64) -> Column:
    """Unit vector of token counts by hash slot: the default embedding, without a model."""
    # Tokens as even numbers and the end of each slot as an odd one, sorted: the places of the ends tell the counts.
    slots = F.transform(tx.tokenize(F.coalesce(c, F.lit(""))), lambda t: 2 * F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
    marked = F.array_sort(F.concat(slots, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: 2 * j + 1)))
    ends = lambda held: F.filter(F.transform(held, lambda x, i: F.when(x % 2 == 1, i)), lambda i: i.isNotNull())
    counts = lambda at: F.zip_with(at, F.concat(F.array(F.lit(-1)), F.slice(at, 1, dim - 1)), lambda x, y: (x - y - 1).cast("double"))
    unit = lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))
    return let(marked, lambda held: let(ends(held), lambda at: let(counts(at), unit)))
