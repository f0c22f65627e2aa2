"""Fusion of result legs: reciprocal ranks, weighted scores, content keys, variants, interleaving, re-ranking.

A leg is hits(query_id, id, score); ranks are 1-based by score, ties by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import best, first_per_parent
from .vector_search import rank_of


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id, id, score_a, rank_a, size_a and the same of b, one row an id in either leg."""
    size = Window.partitionBy("query_id")
    x, y = (rank_of(leg).select("query_id", "id", F.col("score").alias(f"score_{n}"), F.col("rank").alias(f"rank_{n}")) for leg, n in ((a, "a"), (b, "b")))
    out = x.join(y, ["query_id", "id"], "full_outer")
    return out.withColumn("size_a", F.count("rank_a").over(size)).withColumn("size_b", F.count("rank_b").over(size))


def rrf_fuse(a: DataFrame, b: DataFrame, k: int = 60, top: int = 10, missing_rank: str = "oversample", parents: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, rank, rank_a, rank_b.

    score is 1/(k + rank_a) + 1/(k + rank_b). An id that a leg lacks has, for the score, the larger of the
    leg's size and 2 * top ('oversample'), or the size + 1 ('tail'); reported is size + 1, or -1 for 'tail'.
    With parents(id, parent_key) only the best id of each parent stays.
    """
    rank = lambda n: F.coalesce(F.col(f"rank_{n}"), F.greatest(F.col(f"size_{n}"), F.lit(2 * top)) if missing_rank == "oversample" else F.col(f"size_{n}") + 1)
    shown = lambda n: F.coalesce(F.col(f"rank_{n}"), F.col(f"size_{n}") + 1 if missing_rank == "oversample" else F.lit(-1).cast("long")).alias(f"rank_{n}")
    fused = _both(a, b).select("query_id", "id", F.round(1 / (k + rank("a")) + 1 / (k + rank("b")), 9).alias("score"), shown("a"), shown("b"))
    return best(fused if parents is None else first_per_parent(fused.join(parents, "id")), top)


def minmax_norm(hits: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Adds norm: the score from 0 to 1 within the leg; a leg of equal scores divides by 1."""
    w = Window.partitionBy(*keys)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("norm", F.round((F.col("score") - low) / F.when(high > low, high - low).otherwise(1.0), 6))


def linear_fuse(a: DataFrame, b: DataFrame, weight_b: float = 0.3, top: int = 10) -> DataFrame:
    """query_id, id, score, rank: (1 - weight_b) and weight_b of the legs' min-max scores; an absent id counts 0."""
    x, y = (minmax_norm(leg).select("query_id", "id", F.col("norm").alias(n)) for leg, n in ((a, "x"), (b, "y")))
    score = F.round((1 - weight_b) * F.coalesce("x", F.lit(0.0)) + weight_b * F.coalesce("y", F.lit(0.0)), 6)
    return best(x.join(y, ["query_id", "id"], "full_outer").select("query_id", "id", score.alias("score")), top)


def rrf_fuse_by_content(faq: DataFrame, doc: DataFrame, k: int = 60, top: int = 5) -> DataFrame:
    """Legs with content_key as well: sum of 1/(k + rank) over equal contents; an FAQ row represents its content before a document."""
    one = rank_of(faq).withColumn("priority", F.lit(0)).unionByName(rank_of(doc).withColumn("priority", F.lit(1)))
    grouped = one.groupBy("query_id", "content_key").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("priority", "rank", "id")).alias("r"))
    return best(grouped.select("query_id", "content_key", F.col("r.id").alias("id"), F.when(F.col("r.priority") == 0, "faq").otherwise("doc").alias("source"), "score"), top)


def merge_variants(hits: DataFrame, top: int = 10, parents: DataFrame | None = None) -> DataFrame:
    """Best score of each id over the variants of hits(query_id, variant, id, score), one a parent, the top ones."""
    merged = hits.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return best(merged if parents is None else first_per_parent(merged.join(parents, "id")), top)


def two_lists(faq: DataFrame, doc: DataFrame, k: int = 5) -> DataFrame:
    """query_id and two arrays of ids, unfused."""
    listed = lambda leg, n: best(leg, k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x.id).alias(n))
    empty = F.array().cast("array<long>")
    return listed(faq, "faq").join(listed(doc, "doc"), "query_id", "full_outer").select("query_id", F.coalesce("faq", empty).alias("faq"), F.coalesce("doc", empty).alias("doc"))


def interleave(a: DataFrame, b: DataFrame, top: int = 10) -> DataFrame:
    """Legs taken in turn, a first; an id counts where it comes first."""
    one = rank_of(a).select("query_id", "id", (2 * F.col("rank") - 1).alias("place")).unionByName(rank_of(b).select("query_id", "id", (2 * F.col("rank")).alias("place")))
    first = one.groupBy("query_id", "id").agg(F.min("place").alias("place"))
    return best(first.select("query_id", "id", (-F.col("place")).alias("score")), top).select("query_id", "id", "rank")


def overlap_share(hits: DataFrame) -> DataFrame:
    """Default second-stage scorer: share of the distinct query terms that the content has, of hits(query_terms, content_terms)."""
    share = F.size(F.array_intersect("query_terms", "content_terms")) / F.greatest(F.size(F.array_distinct("query_terms")), F.lit(1))
    return hits.withColumn("score", F.round(share, 6))


def rerank(hits: DataFrame, scorer=overlap_share, take: int = 20, keep: int = 5, floor: float = 0.5) -> DataFrame:
    """The first `take` hits scored again by scorer (DataFrame to DataFrame), floor applied, `keep` kept."""
    return best(scorer(best(hits, take).drop("rank", "score")).filter(F.col("score") >= floor).select("query_id", "id", "score"), keep)


def candidate_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("query_id", "id").unionByName(b.select("query_id", "id")).distinct()
