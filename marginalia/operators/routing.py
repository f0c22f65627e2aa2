"""Confidence routing, outcome codes, context packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .index import best

# Outcome codes with status and message.
OUTCOMES = (("validation_error", 400, "bad request"), ("retrieval_error", 503, "retrieval failed"), ("llm_error", 502, "generation failed"), ("timeout", 504, "timed out"), ("internal_error", 500, "internal error"))


def _ids(hits: DataFrame, name: str, k: int) -> DataFrame:
    top = best(hits, k)
    return top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x.id).alias(name), F.max("score").alias(f"{name}_score"))


def route(queries: DataFrame, faq_hits: DataFrame, doc_hits: DataFrame, high: float = 0.85, low: float = 0.62, k: int = 5, use_low: bool = True) -> DataFrame:
    """query_id, route, confidence, confidence_kind, faq, doc (ids by rank).

    No FAQ hit or best similarity below low: documents only, FAQ list emptied; at least high: FAQ only,
    documents emptied; else both. Hits outside [0, 1] are left out; an absent leg counts as empty.
    Confidence is the best similarity, or the best document score where documents stand alone.
    """
    good = faq_hits.filter(F.col("score").between(0, 1))
    r = queries.select("query_id").join(_ids(good, "faq", k), "query_id", "left").join(_ids(doc_hits, "doc", k), "query_id", "left")
    sim, none = F.col("faq_score"), F.array().cast("array<long>")
    low_rule = sim.isNull() | (sim < low) if use_low else sim.isNull()
    kind = F.when(low_rule, "DOC_ONLY").when(sim >= high, "FAQ_ONLY").otherwise("HYBRID")
    r = r.withColumn("route", kind)
    return r.select(
        "query_id",
        "route",
        F.when(F.col("route") == "DOC_ONLY", F.coalesce("doc_score", F.lit(0.0))).otherwise(sim).alias("confidence"),
        F.when(F.col("route") == "DOC_ONLY", "doc").otherwise("faq").alias("confidence_kind"),
        F.when(F.col("route") == "DOC_ONLY", none).otherwise(F.col("faq")).alias("faq"),
        F.when(F.col("route") == "FAQ_ONLY", none).otherwise(F.coalesce("doc", none)).alias("doc"),
    )


def map_outcome(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Adds status and message by error_code; unknown codes count as internal errors, no code as success. Spark picks the join by the size of codes."""
    return df.join(codes, "error_code", "left").withColumns({
        "status": F.when(F.col("error_code").isNull(), 200).otherwise(F.coalesce("status", F.lit(500))),
        "message": F.when(F.col("error_code").isNull(), "ok").otherwise(F.coalesce("message", F.lit("internal error"))),
    })


def outcome_table(spark) -> DataFrame:
    """Five rows."""
    return spark.createDataFrame(OUTCOMES, "error_code string, status int, message string")


def source_map(doc_hits: DataFrame, most: int = 5) -> DataFrame:
    """query_id, ref_id (1..most), doc_name, chapter_title, content of the best hits."""
    return best(doc_hits, most).select("query_id", F.col("rank").alias("ref_id"), "doc_name", tx.chapter_title(F.col("content")).alias("chapter_title"), "content")


def _block(tag: str, ref: Column, title: Column, body: Column) -> Column:
    return F.concat(F.lit(f'<{tag} id="'), ref, F.lit('" title="'), tx.xml_escape(title), F.lit('">'), tx.xml_escape(body), F.lit(f"</{tag}>"))


def pack_context(queries: DataFrame, faq: DataFrame, doc: DataFrame, max_faq: int = 3, max_doc: int = 5, template: str = "{context}\n\n{question}") -> tuple[DataFrame, DataFrame]:
    """(prompts(query_id, prompt), source map): FAQ entries F1.., never citable, then documents 1..; XML-escaped."""
    f = best(faq, max_faq).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", _block("faq", F.concat(F.lit("F"), F.col("rank").cast("string")), F.col("question"), F.col("answer")).alias("x")))).alias("f"))
    sources = source_map(doc, max_doc)
    title = F.when(F.col("chapter_title") != "", F.concat(F.col("doc_name"), F.lit(" · "), F.col("chapter_title"))).otherwise(F.col("doc_name"))
    d = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ref_id", _block("doc", F.col("ref_id").cast("string"), title, F.col("content")).alias("x")))).alias("d"))
    lines = lambda c: F.coalesce(F.array_join(F.transform(c, lambda v: v.x), "\n"), F.lit(""))
    context = F.array_join(F.filter(F.array(lines("f"), lines("d")), lambda x: x != ""), "\n")
    packed = queries.join(f, "query_id", "left").join(d, "query_id", "left")
    return packed.select("query_id", F.replace(F.replace(F.lit(template), F.lit("{context}"), context), F.lit("{question}"), F.col("text")).alias("prompt")), sources


def format_context(queries: DataFrame, hits: DataFrame, k: int = 5, empty: str = "（无相关资料）") -> DataFrame:
    """query_id, context: source and content blocks of the best hits."""
    block = F.concat(F.lit("来源："), F.col("doc_name"), F.lit("\n内容："), F.col("content"))
    joined = best(hits, k).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("x")))), lambda v: v.x), "\n\n").alias("context"))
    return queries.select("query_id").join(joined, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(empty)))


def expand_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Parent text for the final hits only: hits(.., parent_id, chunk_text) with parents(parent_id, parent_text); a missing or empty parent gives the chunk."""
    return hits.join(parents, "parent_id", "left").withColumn("content", parent_fallback(F.col("parent_text"), F.col("chunk_text"))).drop("parent_text")


def parent_fallback(parent: Column, chunk: Column) -> Column:
    return F.coalesce(F.nullif(parent, F.lit("")), chunk)


def parse_variants(df: DataFrame, n: int = 3) -> DataFrame:
    """query_id, variants: the question and up to n more lines of `generated`, list marks stripped, longer than 3, distinct."""
    lines = F.transform(F.split(F.coalesce("generated", F.lit("")), "\n"), lambda x: tx.trimmed(F.ltrim(x, F.lit("0123456789.-* "))))
    return df.select("query_id", F.slice(F.array_distinct(F.concat(F.array(F.col("text")), F.filter(lines, lambda x: F.length(x) > 3))), 1, n + 1).alias("variants"))
