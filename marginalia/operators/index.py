"""Text index: postings, BM25 top-k, conjunctive match, highlighting, incremental update."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass
class Bm25Index:
    """postings(term, id, tf, dl), terms(term, df), stats(n_docs, n_tokens): one row."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def build_bm25(docs: DataFrame, id_col: str = "id", text_col: str = "text", tokenizer=tx.tokenize) -> Bm25Index:
    """Index of docs. Term counts combine on the map side; no document is gathered."""
    tokens = docs.select(F.col(id_col).alias("id"), tokenizer(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))
    postings = tokens.select("id", "dl", F.explode("tokens").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    # Document frequencies need no postings: distinct terms of each text combine on the map side.
    terms = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return Bm25Index(postings, terms, tokens.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens")))


def idf_table(index: Bm25Index) -> DataFrame:
    """term, df, idf: ln(N - df + .5) - ln(df + .5), negative values replaced by a quarter of the mean over all terms."""
    raw = index.terms.crossJoin(F.broadcast(index.stats)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg((EPSILON * F.avg("raw")).alias("floor"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def score_bm25(queries: DataFrame, index: Bm25Index, tokenizer=tx.tokenize) -> DataFrame:
    """query_id, id, score of queries(query_id, text). Repeated query terms count repeatedly."""
    asked = queries.select("query_id", F.explode(tokenizer(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    weighted = asked.join(idf_table(index), "term").select("query_id", "term", (F.col("qf") * F.col("idf")).alias("w"))
    hits = index.postings.join(asked.select("term").distinct(), "term", "left_semi").join(weighted, "term").crossJoin(F.broadcast(index.stats))
    length = K1 * (1 - B + B * F.col("dl") * F.col("n_docs") / F.col("n_tokens"))
    return hits.select("query_id", "id", (F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + length)).alias("s")).groupBy("query_id", "id").agg(F.round(F.sum("s"), 6).alias("score"))


def best(hits: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Adds rank; the k rows a query with the highest score, ties by id."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def first_per_parent(hits: DataFrame, parent_col: str = "parent_key") -> DataFrame:
    """The best hit of each parent a query."""
    w = Window.partitionBy("query_id", parent_col).orderBy(F.col("score").desc(), "id")
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def bm25_topk(queries: DataFrame, index: Bm25Index, parents: DataFrame | None = None, k: int = 10, floor: float = 0.1, tokenizer=tx.tokenize) -> DataFrame:
    """query_id, id, score, rank. With parents(id, parent_key): twice k hits are taken, then one a parent, then k."""
    hits = score_bm25(queries, index, tokenizer).filter(F.col("score") >= floor)
    if parents is None:
        return best(hits, k)
    return best(first_per_parent(best(hits, 2 * k).drop("rank").join(parents, "id")), k)


def fulltext_and(queries: DataFrame, index: Bm25Index, k: int = 5, tokenizer=tx.tokenize) -> DataFrame:
    """Documents with all terms of a query; score = sum of 1 + ln tf over the query's distinct terms."""
    asked = queries.select("query_id", F.array_distinct(tokenizer(F.col("text"))).alias("terms")).select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    # Only documents with a query's rarest term can have all; the postings of its other terms are looked up for these alone.
    rare = asked.join(index.terms, "term").groupBy("query_id", "n").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.count("*").alias("m")).filter("m = n")
    able = index.postings.select("term", "id").join(rare.select("query_id", "term"), "term").select("query_id", F.col("id").alias("_id"))
    needed = able.join(asked, "query_id").select("query_id", "n", F.col("term").alias("_term"), "_id")
    hits = index.postings.join(needed, (F.col("term") == F.col("_term")) & F.col("id").eqNullSafe(F.col("_id")))
    hits = hits.groupBy("query_id", "n", "id").agg(F.count("*").alias("m"), F.round(F.sum(1 + F.log("tf")), 6).alias("score"))
    return best(hits.filter("m = n").select("query_id", "id", "score"), k)


def highlight(hits: DataFrame) -> DataFrame:
    """Adds highlighted and matched to hits(content, terms): terms of two or more characters in **, longest first."""
    order = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    terms = F.array_sort(F.filter(F.array_distinct("terms"), lambda t: (F.length(t) > 1) & F.contains(F.col("content"), t)), order)
    simple = F.aggregate("matched", F.col("content"), lambda s, t: F.replace(s, t, F.concat(F.lit("**"), t, F.lit("**"))))
    return hits.withColumn("matched", terms).withColumn("highlighted", simple)


def update_bm25(index: Bm25Index, old: DataFrame, new: DataFrame, tokenizer=tx.tokenize) -> Bm25Index:
    """Index without the documents of old and with those of new, both (id, text): only touched rows are tokenised, and counts change by difference."""
    gone, come = build_bm25(old, tokenizer=tokenizer), build_bm25(new, tokenizer=tokenizer)
    postings = index.postings.join(old.select("id"), "id", "left_anti").select("term", "id", "tf", "dl").unionByName(come.postings)
    less = gone.terms.select("term", (-F.col("df")).alias("df"))
    terms = index.terms.unionByName(come.terms).unionByName(less).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    stats = index.stats.unionByName(come.stats).unionByName(gone.stats.select((-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return Bm25Index(postings, terms, stats)
