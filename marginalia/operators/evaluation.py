"""Retrieval evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def containing(passages: DataFrame, docs: DataFrame, most_short: int = 100_000) -> DataFrame:
    """query_id, id of docs(id, body) whose body contains the text of passages(query_id, text); ids are unique on both sides.

    The second to fourth piece between single spaces of a passage stand in a body that holds it as they are, so
    they are the join key, and only documents that share it are compared. Passages of fewer than five pieces
    have no such key; these alone are compared with every body.
    """
    pieces = F.split("text", " ")
    passages = passages.filter(F.col("text").isNotNull()).withColumn("n", F.size(pieces))
    keyed = passages.filter("n >= 5").select("query_id", F.xxhash64(F.slice(pieces, 2, 3)).alias("key"))
    words = docs.select("id", F.split("body", " ").alias("w")).filter(F.size("w") >= 5)
    keys = F.transform(F.sequence(F.lit(2), F.size("w") - 3), lambda i: F.xxhash64(F.slice("w", i, 3)))
    met = words.select("id", F.explode(F.array_distinct(keys)).alias("key")).join(keyed, "key").select("query_id", "id")
    long = met.join(docs, "id").join(passages.select("query_id", "text"), "query_id")
    out, short = long.filter(F.contains("body", "text")).select("query_id", "id"), passages.filter("n < 5").select("query_id", "text")
    parts = -(-short.count() // most_short)
    for k in range(parts):
        held = short.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k).toArrow()  # about most_short short texts
        found = docs.select("id", "body").filter("body is not null").mapInArrow(_holders(held), out.schema)
        out = out.unionByName(found)
    return out


def _holders(passages: pa.Table):
    """query_id, id of the bodies that hold one of passages(query_id, text); the empty text is in all of them."""
    by_text: dict[str, list] = {}
    for q, t in zip(passages["query_id"].to_pylist(), passages["text"].to_pylist(), strict=True):
        by_text.setdefault(t, []).append(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        finder, always = ahocorasick.Automaton(), by_text.get("", [])
        for t, qs in by_text.items():
            if t:
                finder.add_word(t, qs)
        finder.make_automaton()
        for batch in batches:
            rows = [(q, i) for i, body in zip(batch.column("id").to_pylist(), batch.column("body").to_pylist(), strict=True) for q in {*always, *(q for _, qs in (finder.iter(body) if len(finder) else ()) for q in qs)}]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in rows], passages.schema.field("query_id").type), pa.array([i for _, i in rows], batch.schema.field("id").type)], names=["query_id", "id"])

    return run


def evaluate_per_query(hits: DataFrame, relevance: DataFrame, k: int = 10) -> DataFrame:
    """query_id, precision, recall, hit, rr of hits(query_id, id, rank) against relevance(query_id, id)."""
    n = relevance.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    found = hits.filter(F.col("rank") <= k).join(relevance.withColumn("r", F.lit(1)), ["query_id", "id"], "left")
    per = found.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.count("r").alias("n_found"), F.min(F.when(F.col("r") == 1, F.col("rank"))).alias("first"))
    per = n.join(per, "query_id", "left")
    zero = F.lit(0)
    return per.select("query_id", F.round(F.coalesce(F.col("n_found") / F.col("n_hits"), F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce("n_found", zero) / F.col("n_relevant"), 6).alias("recall"), (F.coalesce("n_found", zero) > 0).cast("long").alias("hit"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def evaluate_retrieval(hits: DataFrame, relevance: DataFrame, k: int = 10) -> DataFrame:
    """One row: means over all queries with a relevant document."""
    return evaluate_per_query(hits, relevance, k).agg(F.count("*").alias("n_queries"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("rr"), 6).alias("mrr"))


def hit_term_matrix(hits: DataFrame, terms: list[str], content: str = "content") -> DataFrame:
    """query_id, id and one 0/1 column a term."""
    return hits.select("query_id", "id", *[F.contains(F.col(content), F.lit(t)).cast("long").alias(f"has_{i}") for i, t in enumerate(terms)])
