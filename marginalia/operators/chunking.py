"""Splitters: one document row to many chunk rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def _joined_units(units: Column, first: Column, count: int) -> Column:
    """Units first .. first + count - 1 as one text; each is fetched by its place."""
    if count > 64:
        return F.array_join(F.slice(units, first + 1, count), "")
    return F.concat(*[F.coalesce(F.get(units, first + j), F.lit("")) for j in range(count)])


def split_chars(df: DataFrame, size: int = 150, overlap: int = 30, text_col: str = "text") -> DataFrame:
    """Windows of `size` characters that step by size - overlap; the last ends at the text's end. Adds chunk_index, chunk_text.

    One pass cuts the text into steps, and a window is a few steps put together: the time grows with the text's length, and a chunk
    row holds the text only where it is asked for.
    """
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text_col) - size) / float(step))).cast("int")
    rows = df.drop("chunk_index", "chunk_text")
    cut = rows.filter(F.length(text_col) > 0).withColumn("_units", F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)))
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(_joined_units(F.col("_units"), i, -(-size // step)), 1, size))
    return cut.select(*[F.col(f"`{c}`") for c in rows.columns], F.posexplode(windows).alias("chunk_index", "chunk_text")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def split_tokens(df: DataFrame, size: int = 512, overlap: int = 128, text_col: str = "text", tokenizer=tx.tokenize, joiner: str = " ") -> DataFrame:
    """Windows of `size` tokens; tokenizer maps a Column to an array of tokens without the control character U+0001.

    The tokens are joined once and cut into units that size and step are multiples of, so that a window is a few units put together.
    """
    step = size - overlap
    unit, mark, rows = math.gcd(size, step), "\x01", df.drop("chunk_index", "chunk_text")
    tokens = rows.withColumn("_tokens", tokenizer(F.col(text_col))).filter(F.size("_tokens") > 0)
    tokens = tokens.withColumn("_last", F.greatest(F.lit(0), F.ceil((F.size("_tokens") - size) / float(step))).cast("int"))
    units = F.regexp_extract_all(F.concat(F.array_join("_tokens", mark), F.lit(mark)), F.lit(f"(?:[^{mark}]*{mark}){{1,{unit}}}"), F.lit(0))
    tokens = tokens.withColumn("_units", units)
    whole = lambda i: _joined_units(F.col("_units"), i * (step // unit), size // unit)
    windows = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda i: F.replace(F.rtrim(whole(i), F.lit(mark)), F.lit(mark), F.lit(joiner)))
    return tokens.select(*[F.col(f"`{c}`") for c in rows.columns], F.posexplode(windows).alias("chunk_index", "chunk_text")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def _pieces(text: str, separators: Sequence[str], size: int) -> Iterator[str]:
    """Parts of at most `size` characters, cut at the first separator that helps; separators stay with the part before."""
    if len(text) <= size:
        yield text
        return
    sep = next((s for s in separators if s in text), "")
    rest = separators[list(separators).index(sep) + 1 :] if sep else ()
    if not sep:
        for i in range(0, len(text), size):
            yield text[i : i + size]
        return
    parts = text.split(sep)
    for i, p in enumerate(parts):
        p = p + sep if i + 1 < len(parts) else p
        if p:
            yield from _pieces(p, rest, size)


def _packed(text: str, separators: Sequence[str], size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(start, chunk): parts merged up to size, the next chunk repeating whole parts of at most overlap characters."""
    held: list[str] = []
    start = 0
    for p in _pieces(text, separators, size):
        while held and sum(map(len, held)) + len(p) > size:
            yield start, "".join(held)
            kept, n = [], 0
            while held and n + len(held[-1]) <= overlap and n + len(held[-1]) + len(p) <= size:
                n += len(held[-1])
                kept.insert(0, held.pop())
            start += sum(map(len, held))
            held = kept
            if sum(map(len, held)) + len(p) <= size:
                break
        held.append(p)
    if held:
        yield start, "".join(held)


def split_recursive(df: DataFrame, id_col: str, size: int = 1024, overlap: int = 128, text_col: str = "text", separators: Sequence[str] = ("\n\n", "\n", " ", "")) -> DataFrame:
    """id, chunk_index, start, chunk_text. Merging is sequential within a document, so it runs in Arrow batches."""
    kinds = f"{id_col} {df.schema[id_col].dataType.simpleString()}, chunk_index long, start long, chunk_text string"
    seps = tuple(s for s in separators if s)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, s, c) for i, t in zip(pdf[id_col], pdf[text_col], strict=True) for k, (s, c) in enumerate(_packed(t or "", seps, size, overlap))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "start", "chunk_text"])

    return df.select(id_col, text_col).mapInPandas(run, kinds)


def split_lines(df: DataFrame, size: int = 1000, text_col: str = "text") -> DataFrame:
    """Lines packed greedily into chunks of at most size characters; a longer line stands alone. Each line is looked at once, in Arrow batches."""

    def pack(text: str) -> list[str]:
        out, held, length = [], [], -1
        for line in text.split("\n"):
            if held and length + 1 + len(line) > size:
                out.append("\n".join(held))
                held, length = [], -1
            held.append(line)
            length += 1 + len(line)
        return [*out, "\n".join(held)]

    @F.pandas_udf("array<string>")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else pack(t))

    return df.select("*", F.posexplode(packed(text_col)).alias("chunk_index", "chunk_text")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def split_parents(df: DataFrame, id_col: str, levels: int = 2, min_len: int = 200, text_col: str = "text", opening: str = "开篇") -> DataFrame:
    """Sections by Markdown headings of at most `levels`, indented or not: id, section, heading, heading_level, content.

    Text before the first heading is section 0 with level 0; sections shorter than min_len go unless of level 1.
    """
    mark = rf"^[ \t]*(#{{1,{levels}}})[ \t]+(.*)$"
    lines = df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    w = Window.partitionBy(id_col).orderBy("pos")
    heads = lines.withColumn("level", F.length(F.regexp_extract("line", mark, 1))).withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(w).cast("long"))
    parts = heads.groupBy(id_col, "section").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "level"))).alias("ls"))
    first = F.col("ls")[0]
    out = parts.select(
        id_col,
        "section",
        F.when(first["level"] > 0, tx.trimmed(F.regexp_extract(first["line"], mark, 2))).otherwise(F.lit(opening)).alias("heading"),
        first["level"].cast("long").alias("heading_level"),
        tx.trimmed(F.array_join(F.transform("ls", lambda x: x.line), "\n")).alias("content"),
    )
    return out.filter((F.length("content") >= min_len) | ((F.col("heading_level") == 1) & (F.length("content") > 0)))


def heading_paths(parents: DataFrame, id_col: str) -> DataFrame:
    """Adds path: 'last level 1 > heading' below level 1, by position."""
    w = Window.partitionBy(id_col).orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("heading_level") == 1, F.col("heading")), ignorenulls=True).over(w)
    path = F.when((F.col("heading_level") > 1) & top.isNotNull(), F.concat(top, F.lit(" > "), F.col("heading"))).otherwise(F.col("heading"))
    return parents.withColumn("path", path)


def context_header(doc: Column, path: Column) -> Column:
    doc, path = F.coalesce(doc, F.lit("")), F.coalesce(path, F.lit(""))
    name = F.when(doc != "", F.concat(F.lit("《"), doc, F.lit("》"))).otherwise(F.lit(""))
    return F.when((doc == "") & (path == ""), F.lit("")).otherwise(F.concat(F.lit("以下内容出自"), name, path, F.lit("：")))


def split_pdr(df: DataFrame, id_col: str, doc_col: str, size: int = 512, overlap: int = 128, min_len: int = 200, tokenizer=tx.tokenize) -> DataFrame:
    """Children with their parents: sections with '# path' on top; a parent shorter than twice size is its own child. chunk_index is the place in the whole document."""
    parents = heading_paths(split_parents(df, id_col, min_len=min_len), id_col).join(df.select(id_col, F.col(doc_col).alias("doc_name")), id_col)
    parents = parents.withColumn("parent_text", F.concat(F.lit("# "), F.col("path"), F.lit("\n\n"), F.col("content"))).withColumn("parent_id", F.sha2(F.concat_ws("\u0001", "doc_name", "parent_text"), 256))
    small = F.length("parent_text") < 2 * size
    alone = parents.filter(small).withColumn("chunk_index", F.lit(0).cast("long")).withColumn("chunk_text", F.col("parent_text"))
    cut = split_tokens(parents.filter(~small), size, overlap, "parent_text", tokenizer)
    place = Window.partitionBy(id_col).orderBy("section", "chunk_index")
    numbered = alone.unionByName(cut).withColumn("chunk_index", (F.row_number().over(place) - 1).cast("long"))
    return numbered.withColumn("contextual_header", context_header(F.col("doc_name"), F.col("path")))


def enrich_chunks(df: DataFrame) -> DataFrame:
    """Adds enriched: the contextual header, or the source and page, above the chunk; of chunk_text, contextual_header, doc_name, doc_page."""
    source = F.concat(F.lit("【来源：《"), F.coalesce(F.nullif("doc_name", F.lit("")), F.lit("未知文献")), F.lit("》第"), F.coalesce("doc_page", F.lit(1)).cast("string"), F.lit("页】"))
    head = F.coalesce(F.nullif("contextual_header", F.lit("")), source)
    return df.withColumn("enriched", F.concat(head, F.lit("\n"), F.col("chunk_text")))


def dedup_chunks(df: DataFrame, doc_col: str = "doc_name", text_col: str = "enriched", order: str = "chunk_index") -> DataFrame:
    """First chunk of each text within a document; ordinals keep their gaps."""
    w = Window.partitionBy(doc_col, F.md5(text_col)).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def ingest_report(cut: DataFrame, doc_col: str = "doc_name", id_col: str = "doc_id", text_col: str = "chunk_text") -> DataFrame:
    """doc_name, n_docs, n_chunks, n_after: documents, chunks and distinct chunks within a document of each name, of one pass over the chunks."""
    each = cut.groupBy(doc_col, id_col, F.md5(text_col).alias("h")).agg(F.count("*").alias("n"))
    per = each.groupBy(doc_col, id_col).agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_after"))
    return per.groupBy(F.col(doc_col).alias("doc_name")).agg(F.count("*").alias("n_docs"), F.sum("n_chunks").alias("n_chunks"), F.sum("n_after").alias("n_after"))
