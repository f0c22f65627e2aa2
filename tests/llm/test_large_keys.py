"""Decontamination where row, item, band and place don't fit in one 64-bit number."""

import random

import numpy as np
import pytest

from marginalia.llm import decontaminate


@pytest.mark.parametrize("long", [600_000, 3_000_000])
def test_no_leak_is_lost_beside_a_long_text(long):
    """100,000 short items and a long one; 3,000 documents that each hold an item, and one long text, in one part."""
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    items = [word(12) for _ in range(100_000)]
    big = "".join(word(1000) for _ in range(600))
    index = decontaminate.Index(list(range(100_001)), [*items, big])
    texts = [f"{word(10)} {items[7 * k]} {word(10)}" for k in range(3000)]
    texts.append(("".join(word(1000) for _ in range(100)) * (long // 100_000 + 1))[:long])
    points = decontaminate._points(texts)
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    rows, found, _ = index.regions(points, at)
    assert {(r, 7 * r) for r in range(3000)} <= set(zip(rows.tolist(), found.tolist(), strict=True))


def test_hot_text_reaches_its_owner_once(spark):
    """A third of the rows are one text, dealt over many parts: one entry of it is left, with its count and smallest id."""
    import pyspark.sql.functions as F

    from marginalia.llm import exact_dedup

    text = F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), (F.col("id") % 700).cast("string")))
    rows = spark.range(3, 6003, 1, 90).select(F.xxhash64(text).alias("hash"), text.alias("norm"), F.when(F.col("id") % 6 == 0, F.col("id")).alias("keep_id"), F.lit(1).cast("long").alias("n"), F.octet_length(text).alias("bytes"))
    entry = rows.groupBy("hash", "norm", "bytes", F.spark_partition_id().alias("p")).agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")).drop("p")
    got = {r["norm"]: r for r in exact_dedup.gathered(rows).filter("norm = 'hot text'").collect()}
    assert len(got) == 1 and (got["hot text"]["n"], got["hot text"]["keep_id"]) == (2000, 6)
    few = exact_dedup.gathered(entry, most=8)
    assert few.filter("norm = 'hot text'").count() == 1 and few.agg(F.sum("n")).first()[0] == 6000


def test_term_counts_of_many_short_rows():
    import pyarrow as pa

    from marginalia.llm import toxicity

    row, term, n = toxicity.term_counts(pa.array(["a", "b a a"] * 40_000 + ["c"]))
    assert len(np.unique(row)) == 80_001 and int(n.sum()) == 160_001 and len(np.unique(term)) == 3
    assert (np.diff(row) >= 0).all()
