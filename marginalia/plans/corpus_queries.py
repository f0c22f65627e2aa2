"""Queries over the corpus: sources, cleaning, structure, chunks, text index."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions import text as tx
from ..functions import vectors as vf
from ..operators import chunking, index, structure
from ..operators.stored_index import StoredIndex
from ..sources import files
from .registry import load, query

# Names of a document in a corpus folder; the same text in SQL below.


def path_() -> Column:
    return F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/Doc "), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", F.lit(".TXT")).when(F.col("lang") == "fr", F.lit(".v2.md")).otherwise(F.lit("")))


PATH_SQL = "'/corpus/' || source || '/Doc ' || doc_id || CASE lang WHEN 'en' THEN '.TXT' WHEN 'fr' THEN '.v2.md' ELSE '' END"
TRIM_SQL = r"regexp_replace({0}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"


def trim_sql(c: str) -> str:
    return TRIM_SQL.format(c)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents")


def chunks(spark: SparkSession, d: str, size: int = 800, overlap: int = 100) -> DataFrame:
    """doc_id, id, chunk_index, chunk_text of all documents, first of equal chunks of a document."""
    cut = chunking.split_chars(docs(spark, d).select("doc_id", "text"), size, overlap).drop("text")
    return chunking.dedup_chunks(cut, "doc_id", "chunk_text").withColumn("id", F.col("doc_id") * 100000 + F.col("chunk_index"))


def chunks_sql(size: int = 800, overlap: int = 100) -> str:
    step = size - overlap
    return f"""
    cut AS (SELECT doc_id, i AS chunk_index, substring(text, i * {step} + 1, {size}) AS chunk_text
            FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - {size}) / {step}.0))::BIGINT + 1)) AS i FROM documents WHERE length(text) > 0)),
    chunks AS (SELECT *, doc_id * 100000 + chunk_index AS id FROM cut QUALIFY row_number() OVER (PARTITION BY doc_id, md5(chunk_text) ORDER BY chunk_index) = 1)"""


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def bm25_sql(k: int, floor: float = 0.1) -> str:
    """CTEs from d(id, text) and q(query_id, text) to bm(query_id, id, score, rank)."""
    return f"""
    tok AS (SELECT id, {TOKENS} AS ts FROM d), words AS (SELECT id, unnest(ts) AS term FROM tok),
    post AS (SELECT term, id, count(*) AS tf FROM words GROUP BY term, id),
    st AS (SELECT count(*) AS n, sum(len(ts)) AS t FROM tok),
    df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, st),
    idf AS (SELECT term, CASE WHEN r < 0 THEN (SELECT 0.25 * avg(r) FROM raw) ELSE r END AS idf FROM raw),
    qt AS (SELECT query_id, unnest({TOKENS}) AS term FROM q), qf AS (SELECT query_id, term, count(*) AS qf FROM qt GROUP BY query_id, term),
    sc AS (SELECT query_id, post.id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) * n / t))), 6) AS score
           FROM qf JOIN idf USING (term) JOIN post USING (term) JOIN tok ON tok.id = post.id, st GROUP BY query_id, post.id),
    bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc WHERE score >= {floor} QUALIFY rank <= {k})"""


def asked(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- sources and sinks -------------------------------------------------------------------------


@query("corpus_scan", f"""SELECT regexp_replace(regexp_extract({PATH_SQL}, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS doc_name,
 lower(regexp_extract(regexp_extract({PATH_SQL}, '([^/]*)$', 1), '.(\\.[^.]+)$', 1)) AS ext, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1, 2""")
def corpus_scan(spark, d):
    return docs(spark, d).groupBy(tx.doc_name(path_()).alias("doc_name"), tx.doc_ext(path_()).alias("ext")).agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("doc_name_from_path", """SELECT page_id, regexp_replace(regexp_extract(p, '([^/]*)/*$', 1), '(.)\\.[^.]*$', '\\1') AS doc_name,
 lower(regexp_extract(regexp_extract(p, '([^/]*)/*$', 1), '.(\\.[^.]+)$', 1)) AS ext FROM (SELECT page_id, regexp_replace(url, '\\?.*$', '') AS p FROM pages)""")
def doc_name_from_path(spark, d):
    path = F.regexp_replace("url", r"\?.*$", "")
    return load(spark, d, "pages").select("page_id", tx.doc_name(path).alias("doc_name"), tx.doc_ext(path).alias("ext"))


@query("faq_jsonl_load", "SELECT text AS question, text AS answer, CASE item_id % 4 WHEN 0 THEN 'unknown' ELSE 'bench' END AS source_doc, true AS good FROM benchmark WHERE item_id % 4 IN (0, 1) UNION ALL SELECT replace('{broken ' || text, chr(10), ' '), NULL, NULL, false FROM benchmark WHERE item_id % 4 = 3")
def faq_jsonl_load(spark, d):
    """Benchmark items written as JSON lines in both shapes, with blank and broken lines among them, read back."""
    items = load(spark, d, "benchmark")
    triple = F.to_json(F.struct(F.col("text").alias("query"), F.array("text").alias("pos"), F.array().cast("array<string>").alias("neg")))
    record = F.to_json(F.struct(F.col("text").alias("question"), F.col("text").alias("answer"), F.struct(F.lit("bench").alias("source_doc")).alias("metadata")))
    line = F.when(F.col("item_id") % 4 == 0, triple).when(F.col("item_id") % 4 == 1, record).when(F.col("item_id") % 4 == 2, F.lit("")).otherwise(F.concat(F.lit("{broken "), "text"))
    path = shared(spark, "faq")
    items.select(F.regexp_replace(line, "\n", " ").alias("value")).write.text(path)
    good, bad = files.load_faq_jsonl(spark, path)
    return files.merge_faq_shapes(good).select("question", "answer", "source_doc", F.lit(True).alias("good")).unionByName(bad.select(F.col("line").alias("question"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("source_doc"), F.lit(False).alias("good")))


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{files.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored_index(spark: SparkSession, d: str, name: str, rows: Callable[[], DataFrame]) -> StoredIndex:
    """The index `name` of rows() made of the documents under d: built at its first use, stored in the shared folder, and opened there from then on while the table's files stay the same."""
    file = F.struct("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    mark = docs(spark, d).select(file.alias("f")).distinct().agg(F.sum(F.xxhash64("f").cast("decimal(20,0)"))).first()[0]
    key = hashlib.md5(f"{d} {name} {mark}".encode()).hexdigest()
    store = StoredIndex(spark, f"{files.shared_dir(spark)}/index-{name}-{key}", buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not store.lines:
        store.add(rows())
    return store


@query("chunk_scan_defaults", """SELECT doc_id, coalesce(CASE WHEN lang <> 'en' THEN n_chars END, 0)::BIGINT AS doc_page, coalesce(CASE WHEN source <> 'src1' THEN doc_id END, 0)::BIGINT AS chunk_index FROM documents""")
def chunk_scan_defaults(spark, d):
    """A stored chunk table without some pages and indexes, read with defaults."""
    path = shared(spark, "chunks")
    page, at = F.when(F.col("lang") != "en", F.col("n_chars")).cast("int"), F.when(F.col("source") != "src1", F.col("doc_id")).cast("int")
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schemas.CHUNKS)}
    known = {"id": F.col("doc_id").alias("id"), "chunk_text": F.coalesce("text", F.lit("")).alias("chunk_text"), "doc_name": F.coalesce("source", F.lit("")).alias("doc_name"), "doc_page": page.alias("doc_page"), "chunk_index": at.alias("chunk_index")}
    files.append_corpus(docs(spark, d).select(*(empty | known).values()), path)
    return files.read_chunks(spark, path).select(F.col("id").alias("doc_id"), F.col("doc_page").cast("long").alias("doc_page"), F.col("chunk_index").cast("long").alias("chunk_index"))


@query("corpus_full_refresh", "SELECT source AS doc_name, doc_id, md5(text) AS hash FROM documents")
def corpus_full_refresh(spark, d):
    path, rows = shared(spark, "corpus"), docs(spark, d).select(F.col("source").alias("doc_name"), "doc_id", F.md5("text").alias("hash"))
    files.overwrite_corpus(rows.withColumn("hash", F.lit("old")), path)
    files.overwrite_corpus(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


@query("corpus_upsert_by_doc", "SELECT source, doc_id, CASE WHEN lang = 'de' OR source IN (SELECT source FROM documents WHERE lang = 'de') THEN 'new' ELSE 'old' END AS version FROM documents WHERE lang = 'de' OR source NOT IN (SELECT source FROM documents WHERE lang = 'de')")
def corpus_upsert_by_doc(spark, d):
    old = docs(spark, d).select("source", "doc_id", F.lit("old").alias("version"))
    new = docs(spark, d).filter("lang = 'de'").select("source", "doc_id", F.lit("new").alias("version"))
    return files.upsert_by_doc(old, new, "source")


@query("backfill_vectors", "SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS size FROM embeddings WHERE label <> 3")
def backfill_vectors(spark, d):
    """Vectors of label 1 are missing and made anew; those of label 3 can't be made and go."""
    e = load(spark, d, "embeddings").withColumn("kept", F.col("embedding"))
    rows = e.select("vec_id", "label", F.struct("label", "kept").alias("text"), F.when(~F.col("label").isin(1, 3), F.col("embedding")).alias("v"))
    full = files.backfill_vectors(rows, "text", lambda c: F.when(c["label"] == 1, c["kept"]), "v")
    return full.select("vec_id", "label", F.round(vf.dot(F.col("v"), F.col("v")), 4).alias("size"))


@query("corpus_coverage", "SELECT count(*) AS n_chunks, count(CASE WHEN n_chars >= 500 THEN text END) AS n_parents FROM documents")
def corpus_coverage(spark, d):
    return files.corpus_coverage(docs(spark, d).withColumn("parent_text", F.when(F.col("n_chars") >= 500, F.col("text"))))


@query("list_documents", "SELECT DISTINCT source AS doc_name FROM documents WHERE source IS NOT NULL")
def list_documents(spark, d):
    return files.list_documents(docs(spark, d), "source")


@query("ingest_skip_unchanged", "SELECT doc_id, md5(text) AS hash FROM documents WHERE NOT (lang = 'en' OR lang = 'fr')")
def ingest_skip_unchanged(spark, d):
    """English texts are known by their hash, French ones under another name, Spanish ones with an old hash."""
    new = docs(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("doc_name"), F.col("lang").alias("ext"), "text")
    seen = docs(spark, d).filter("lang <> 'de'").select(F.col("doc_id").cast("string").alias("doc_name"), F.col("lang").alias("ext"), F.when(F.col("lang") == "es", "old").otherwise(F.md5("text")).alias("hash"))
    return files.changed_documents(new, seen).select("doc_id", "hash")


@query("ingest_report", f"""WITH {chunks_sql()} SELECT source AS doc_name, count(DISTINCT d.doc_id) AS n_docs, sum(n_all)::BIGINT AS n_chunks, sum(n_kept)::BIGINT AS n_after FROM documents d
 LEFT JOIN (SELECT doc_id, count(*) AS n_all FROM cut GROUP BY doc_id) a USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_kept FROM chunks GROUP BY doc_id) k USING (doc_id) GROUP BY source""")
def ingest_report(spark, d):
    return chunking.ingest_report(chunking.split_chars(docs(spark, d).select("doc_id", "source", "text"), 800, 100), "source")


@query("corpus_scan_files", "SELECT item_id, '.txt' AS ext, md5(text || chr(10)) AS digest FROM benchmark")
def corpus_scan_files(spark, d):
    """A folder with a text file for each benchmark item, written and scanned; files of other kinds are passed over."""
    path, items = shared(spark, "folder"), load(spark, d, "benchmark")
    items.select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(f"{path}/books")
    items.write.json(f"{path}/notes")
    found = files.scan_corpus(spark, path)
    return found.select(F.regexp_extract("path", "item_id=([0-9]+)/", 1).cast("long").alias("item_id"), "ext", F.md5("text").alias("digest"))


@query("corpus_append", "SELECT source AS doc_name, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT source, doc_id FROM documents UNION ALL SELECT source, doc_id FROM documents WHERE lang = 'fr') GROUP BY source")
def corpus_append(spark, d):
    """Two batches appended to one corpus folder."""
    path, rows = shared(spark, "append"), docs(spark, d).select(F.col("source").alias("doc_name"), "doc_id")
    files.append_corpus(rows, path)
    files.append_corpus(docs(spark, d).filter("lang = 'fr'").select(F.col("source").alias("doc_name"), "doc_id"), path)
    return spark.read.schema(rows.schema).parquet(path).groupBy("doc_name").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("corpus_replace_buckets", "SELECT 'd' || doc_id % 500 AS doc_name, count(*) AS n, min(CASE WHEN doc_id % 500 < 40 THEN 'new' ELSE 'old' END) AS version, md5(min(text)) AS least FROM documents WHERE doc_id % 500 >= 40 OR lang = 'en' GROUP BY 1")
def corpus_replace_buckets(spark, d):
    """A corpus in buckets on disk; a change replaces 40 documents' rows by English ones and rewrites the touched buckets only."""
    path = shared(spark, "buckets")
    rows = docs(spark, d).select(F.concat(F.lit("d"), (F.col("doc_id") % 500).cast("string")).alias("doc_name"), "doc_id", "lang", "text")
    files.overwrite_corpus(rows.withColumn("version", F.lit("old")), path, 16)
    empty = rows.filter("doc_id % 500 < 40").select("doc_name").distinct()  # documents whose rows all go still take part by name
    files.replace_buckets(spark, rows.filter("doc_id % 500 < 40 and lang = 'en'").withColumn("version", F.lit("new")), path, 16, names=empty)
    return files.read_buckets(spark, path).groupBy("doc_name").agg(F.count("*").alias("n"), F.min("version").alias("version"), F.md5(F.min("text")).alias("least"))


@query("clean_corrections_file", "SELECT doc_id, replace(replace(replace(text, 'the ', 'THE '), 'que', 'QUE'), 'QUE ', 'que-') AS clean FROM documents")
def clean_corrections_file(spark, d):
    """Corrections from a JSON file over several lines, applied in its order."""
    path = shared(spark, "rules")
    lines = ['{', '  "replacements": [', *[f'    {{"old": "{o}", "new": "{n}", "note": ""}}{"," if k < len(RULES) - 1 else ""}' for k, (o, n) in enumerate(RULES)], '  ]', '}']
    spark.createDataFrame([("\n".join(lines),)], "value string").write.text(path)
    rules = files.load_corrections(spark, path).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "old", "new"))), lambda r: F.struct(r.old, r.new)).alias("rules"))  # one row
    return docs(spark, d).crossJoin(F.broadcast(rules)).select("doc_id", tx.apply_rules(F.col("text"), F.col("rules")).alias("clean"))


@query("backfill_embedded", "SELECT doc_id, length(text)::DOUBLE AS size, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS blanks FROM documents WHERE lang <> 'en' OR NOT contains(text, 'token')")
def backfill_embedded(spark, d):
    """English texts lack vectors; a model loaded once a task makes them in batches and fails on some texts, whose rows go, while the others of such a batch are made one by one."""
    size = F.array(F.length("text").cast("float"), F.length(F.regexp_replace("text", "[^ ]", "")).cast("float"))
    rows = docs(spark, d).select("doc_id", "lang", "text", F.when(F.col("lang") != "en", size).alias("chunk_vector"))
    full = files.backfill_batched(rows, "text", _counting_model)
    return full.select("doc_id", F.col("chunk_vector")[0].cast("double").alias("size"), F.col("chunk_vector")[1].cast("double").alias("blanks"))


def _counting_model():
    def model(texts):
        if any("token" in t for t in texts):
            raise ValueError("a text that the model can't take")
        return [[len(t), t.count(" ")] for t in texts]

    return model


# --- predicates and projections -----------------------------------------------------------------


@query("clean_drop_empty", "SELECT doc_id FROM documents WHERE length(regexp_replace(text, '[A-Za-z \\t\\r\\n.,]', '', 'g')) > 0")
def clean_drop_empty(spark, d):
    return docs(spark, d).filter(tx.non_empty(F.regexp_replace("text", r"[A-Za-z \t\r\n.,]", ""))).select("doc_id")


@query("chunk_min_len", f"WITH {chunks_sql()} SELECT id FROM chunks WHERE length({trim_sql('chunk_text')}) >= 50")
def chunk_min_len(spark, d):
    return chunks(spark, d).filter(tx.min_len(F.col("chunk_text"), 50)).select("id")


@query("page_number_norm", "SELECT page_id, CASE WHEN regexp_matches(p, '^[0-9]+$') THEN p::BIGINT + 1 ELSE 1 END AS doc_page FROM (SELECT page_id, regexp_extract(url, 'page=([0-9]*)', 1) AS p FROM pages)")
def page_number_norm(spark, d):
    return load(spark, d, "pages").select("page_id", tx.page_number(F.regexp_extract("url", "page=([0-9]*)", 1)).alias("doc_page"))


@query("question_guard", "SELECT doc_id, coalesce(length(text) BETWEEN 1 AND 2000, false) AS valid FROM documents")
def question_guard(spark, d):
    return docs(spark, d).select("doc_id", tx.valid_question(F.col("text")).alias("valid"))


def topic_() -> Column:
    return F.concat(F.element_at(F.array(*[F.lit(x) for x in ("哪一年 ", "评价 ", "关系 ", "说说 ", "")]), (F.col("item_id") % 5 + 1).cast("int")), F.col("text"))


@query("query_class", """SELECT item_id, ['fact','opinion','relation','explore','other'][item_id % 5 + 1] AS category, ['faq','hybrid','hybrid','doc','hybrid'][item_id % 5 + 1] AS route, [1.0,0.8,0.8,0.6,0.5][item_id % 5 + 1]::DOUBLE AS weight FROM benchmark""")
def query_class(spark, d):
    return load(spark, d, "benchmark").select("item_id", tx.classify_query(topic_()).alias("c")).select("item_id", "c.*")


@query("answer_blocklist", "SELECT conv_id, turn, contains(text, 'qu') OR contains(text, 'sch') AS blocked FROM conversations")
def answer_blocklist(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", tx.blocked(F.col("text"), ("qu", "sch")).alias("blocked"))


@query("safe_name", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_\\x{4E00}-\\x{9FFF}-]', '_', 'g') AS name FROM pages")
def safe_name(spark, d):
    return load(spark, d, "pages").select("page_id", tx.safe_name(F.col("url")).alias("name"))


@query("faq_defaults", """SELECT conv_id, turn, trim(text) AS question, coalesce(CASE WHEN role <> 'user' THEN trim(text) END, '') AS answer, coalesce(CASE WHEN role = 'system' THEN role END, 'general') AS category, 'unknown' AS source_doc, coalesce(CASE WHEN turn > 0 THEN turn / 4.0 END, 0)::DOUBLE AS similarity FROM conversations WHERE coalesce(CASE WHEN turn > 0 THEN turn / 4.0 END, 0) BETWEEN 0 AND 1""")
def faq_defaults(spark, d):
    c = load(spark, d, "conversations")
    raw = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), F.col("text").alias("question"), F.when(F.col("role") != "user", F.col("text")).alias("answer"), F.when(F.col("role") == "system", F.col("role")).alias("category"), F.lit(None).cast("string").alias("source_doc"), F.when(F.col("turn") > 0, F.col("turn") / 4.0).alias("similarity"))
    return files.normalize_faq_hits(raw)[0].withColumnsRenamed({"query_id": "conv_id", "id": "turn"})


@query("triples_to_faq", "SELECT text AS question, CASE WHEN item_id % 2 = 0 THEN lower(text) ELSE '' END AS answer, 'bench' AS source_doc, 'general' AS category, item_id % 3 = 0 AS has_negative, 0.9::DOUBLE AS confidence, 'auto' AS created_by FROM benchmark")
def triples_to_faq(spark, d):
    t = load(spark, d, "benchmark").select(F.col("text").alias("query"), F.when(F.col("item_id") % 2 == 0, F.array(tx.small_letters(F.col("text")), F.lit("second"))).otherwise(F.array().cast("array<string>")).alias("pos"), F.when(F.col("item_id") % 3 == 0, F.array(F.lit("no"))).otherwise(F.array().cast("array<string>")).alias("neg"))
    return files.triples_to_faq(t, "bench")


@query("faq_shape_merge", "SELECT text AS question, CASE WHEN item_id % 2 = 0 THEN lower(text) ELSE upper(text) END AS answer, CASE WHEN item_id % 2 = 0 THEN 'unknown' ELSE 'book' END AS source_doc, 'general' AS category, 0.9::DOUBLE AS confidence, 'auto' AS created_by FROM benchmark")
def faq_shape_merge(spark, d):
    even = F.col("item_id") % 2 == 0
    rows = load(spark, d, "benchmark").select(F.when(even, F.col("text")).alias("query"), F.when(even, F.array(tx.small_letters(F.col("text")))).alias("pos"), F.when(~even, F.col("text")).alias("question"), F.when(~even, tx.capitals(F.col("text"))).alias("answer"), F.when(~even, F.struct(F.lit("book").alias("source_doc"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("created_by"))).alias("metadata"))
    return files.merge_faq_shapes(rows)


# --- cleaning ------------------------------------------------------------------------------------

ENDS = (".", "!", "?")


@query("clean_ocr_join", f"""WITH l AS (SELECT doc_id, i, {trim_sql('line')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
 k AS (SELECT *, regexp_matches(line, '[.!?]$')::INT AS e FROM l WHERE line <> ''), g AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS para FROM k),
 p AS (SELECT doc_id, para, string_agg(line, '' ORDER BY i) AS t FROM g GROUP BY doc_id, para) SELECT doc_id, string_agg(t, chr(10) ORDER BY para) AS clean FROM p GROUP BY doc_id""")
def clean_ocr_join(spark, d):
    return docs(spark, d).select("doc_id", tx.join_broken_lines(F.col("text"), ENDS).alias("clean")).filter("clean <> ''")


# Noise put into every text, alike in SQL.


def noisy_() -> Column:
    return F.concat(F.lit("RN(7)pp《4 ===== @press\n(Page#12)"), F.col("text"), F.lit("\n\n\nfilename: x.zip\n(Page#3)第十四章武装叛乱的失获485 卷首语；end"))


NOISY_SQL = "'RN(7)pp《4 ===== @press' || chr(10) || '(Page#12)' || text || chr(10) || chr(10) || chr(10) || 'filename: x.zip' || chr(10) || '(Page#3)第十四章武装叛乱的失获485 卷首语；end'"
NOISE_SQL = ("RN[（(《][0-9]+[）)）。]", "RN\\([0-9]+\\)\\)", "pp[《<][0-9]+", "(?s)@.*?\\(Page#[0-9]+\\)", "\\(Page#[0-9]+\\)", "={5,}", "第[一二三四五六七八九十百]+章[^\\s0-9,，.。;；:：\\-—]{2,}[0-9]+", "总序站\\)|卷首语[;；]|急挡“标准属”", "(?i)Document\\s*generated\\s*by\\s*Anna''s\\s*Archive.*", "(?i)Some\\s*stats\\s*\\(more\\s*in\\s*the\\s*PDF\\s*attachments\\).*", "(?i)filename[:_].*zip")


def denoise_sql(c: str) -> str:
    for p in NOISE_SQL:
        c = f"regexp_replace({c}, '{p}', '', 'g')"
    return c


@query("clean_denoise", f"SELECT doc_id, {denoise_sql(NOISY_SQL)} AS clean FROM documents")
def clean_denoise(spark, d):
    return docs(spark, d).select("doc_id", tx.denoise(noisy_()).alias("clean"))


RULES = (("the ", "THE "), ("que", "QUE"), ("", "x"), ("QUE ", "que-"))


@query("clean_corrections", "SELECT doc_id, replace(replace(replace(text, 'the ', 'THE '), 'que', 'QUE'), 'QUE ', 'que-') AS clean FROM documents")
def clean_corrections(spark, d):
    rules = F.array(*[F.struct(F.lit(o).alias("old"), F.lit(n).alias("new")) for o, n in RULES])
    return docs(spark, d).select("doc_id", tx.apply_rules(F.col("text"), rules).alias("clean"))


@query("clean_normalize", f"""SELECT doc_id, {trim_sql("CASE WHEN lang = 'en' THEN regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g') ELSE regexp_replace(t, '\\n+', chr(10), 'g') END")} AS clean FROM (SELECT doc_id, lang, replace(text, '. ', '.' || chr(10) || chr(10) || chr(10) || chr(10)) || '  ' AS t FROM documents)""")
def clean_normalize(spark, d):
    t = F.concat(F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n\n\n")), F.lit("  "))
    return docs(spark, d).select("doc_id", tx.normalize_newlines(t, F.col("lang") == "en").alias("clean"))


@query("markdown_tidy", f"""SELECT doc_id, {trim_sql("regexp_replace(t, '\\n[0-9]{1,3}\\n', chr(10), 'g')")} AS tidy FROM (SELECT doc_id, '# ' || source || chr(10) || chr(10) || replace(replace(text, chr(10), chr(10) || chr(10) || chr(10)), '. ', '.' || chr(10)) AS t FROM documents)""")
def markdown_tidy(spark, d):
    t = F.concat(F.lit("# "), F.col("source"), F.lit("   \n\n\n\n"), F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n\n\n\n")), F.lit(". "), F.lit(".\t \n")), F.lit("\n12\n\n"))
    return docs(spark, d).select("doc_id", tx.markdown_tidy(t).alias("tidy"))


@query("clean_pipeline", f"""WITH l AS (SELECT doc_id, i, {trim_sql('line')} AS line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM (SELECT doc_id, {NOISY_SQL} AS t FROM documents))),
 k AS (SELECT *, regexp_matches(line, '[.!?]$')::INT AS e FROM l WHERE line <> ''), g AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS para FROM k),
 p AS (SELECT doc_id, para, string_agg(line, '' ORDER BY i) AS t FROM g GROUP BY doc_id, para), j AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY para) AS t FROM p GROUP BY doc_id)
 SELECT doc_id, md5({trim_sql("regexp_replace(replace(" + denoise_sql('t') + ", 'the ', 'THE '), '\\n+', chr(10), 'g')")}) AS digest FROM j""")
def clean_pipeline(spark, d):
    return docs(spark, d).select("doc_id", F.md5(tx.clean_text(noisy_(), False, RULES[:1], ENDS)).alias("digest"))


def _hit_sql() -> str:
    step, parts, names = "j", [], []
    for k, p in enumerate(NOISE_SQL):
        parts.append(f"h{k} AS (SELECT *, len(regexp_extract_all(t{k}, '{p}'))::BIGINT AS n{k}, regexp_replace(t{k}, '{p}', '', 'g') AS t{k + 1} FROM {step})")
        names.append((f"noise_{k:02d}", f"n{k}"))
        step = f"h{k}"
    last = f"t{len(NOISE_SQL)}"
    rows = " UNION ALL ".join([*[f"SELECT '{n}' AS rule, sum({c})::BIGINT AS hits, count(*) FILTER ({c} > 0) AS n_docs FROM {step}" for n, c in names], f"SELECT 'correction_00', sum((length({last}) - length(replace({last}, 'the ', ''))) // 4)::BIGINT, count(*) FILTER (contains({last}, 'the ')) FROM {step}"])
    return ", ".join(parts) + " " + rows


@query("clean_rule_hits", f"""WITH l AS (SELECT doc_id, i, {trim_sql('line')} AS line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM (SELECT doc_id, {NOISY_SQL} AS t FROM documents))),
 k AS (SELECT *, regexp_matches(line, '[.!?]$')::INT AS e FROM l WHERE line <> ''), g AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS para FROM k),
 p AS (SELECT doc_id, para, string_agg(line, '' ORDER BY i) AS t FROM g GROUP BY doc_id, para), j AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY para) AS t0 FROM p GROUP BY doc_id), {_hit_sql()}""")
def clean_rule_hits(spark, d):
    """How often every cleaning rule finds something, counted while it cleans."""
    noisy = docs(spark, d).select("doc_id", noisy_().alias("text"))
    return tx.rule_hits(tx.cleaned_with_hits(noisy, rules=RULES[:1], ends=ENDS))


# --- structure and quality -----------------------------------------------------------------------


@query("html_to_markdown")
def html_to_markdown(spark, d):
    return structure.html_to_markdown(load(spark, d, "pages"))


@query("ordered_assembly", "SELECT conv_id AS book_id, string_agg(text, chr(10) || chr(10) ORDER BY turn DESC) AS text FROM conversations WHERE role <> 'system' AND trim(text) <> '' GROUP BY conv_id")
def ordered_assembly(spark, d):
    """Conversations as books whose spine runs backwards; system turns are missing in the manifest."""
    c = load(spark, d, "conversations")
    spine = c.select(F.col("conv_id").alias("book_id"), (-F.col("turn")).alias("pos"), F.col("turn").alias("item"))
    manifest = c.filter("role <> 'system'").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("item"), F.concat(F.lit("t"), "turn").alias("href"))
    return structure.assemble_ordered(spine, manifest, c.select(F.col("conv_id").alias("book_id"), F.concat(F.lit("t"), "turn").alias("href"), F.col("text").alias("md")))


@query("doc_quality", """SELECT doc_id, total_chars, script_chars, headings, round(CASE WHEN total_chars > 0 THEN script_chars / total_chars ELSE 0 END, 6) AS share, reason, reason = 'ok' AS valid FROM (
 SELECT *, CASE WHEN doc_id % 97 > 50 AND total_chars < 5000 THEN 'scan' WHEN total_chars < 1000 THEN 'short' WHEN script_chars / total_chars < 0.75 THEN 'script' ELSE 'ok' END AS reason FROM (
 SELECT doc_id, length(text) AS total_chars, len(regexp_extract_all(text, '\\p{L}')) AS script_chars, len(regexp_extract_all(text, '(?m)^#{1,4}\\s')) AS headings FROM documents))""")
def doc_quality(spark, d):
    q = structure.document_quality(docs(spark, d).withColumn("pics", F.col("doc_id") % 97), "text", "pics", r"\p{L}", 1000, 0.75)
    return q.select("doc_id", "total_chars", "script_chars", "headings", F.round("share", 6).alias("share"), "reason", "valid")


# --- chunks --------------------------------------------------------------------------------------

# Documents as Markdown books: a heading for the source and one for each line break.


def book_() -> Column:
    return F.concat(F.lit("preface of "), F.col("source"), F.lit("\n# "), F.col("source"), F.lit("\n## part\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n## part\n")))


BOOK_SQL = "'preface of ' || source || chr(10) || '# ' || source || chr(10) || '## part' || chr(10) || replace(text, chr(10), chr(10) || '## part' || chr(10))"
PARENTS_SQL = f"""l AS (SELECT doc_id, unnest(string_split(b, chr(10))) AS line, generate_subscripts(string_split(b, chr(10)), 1) AS i FROM (SELECT doc_id, {BOOK_SQL} AS b FROM documents)),
 s AS (SELECT *, length(regexp_extract(line, '^(#{{1,2}})[ \\t]+(.*)$', 1)) AS lv FROM l), n AS (SELECT *, sum((lv > 0)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM s),
 a AS (SELECT doc_id, section::BIGINT AS section, {trim_sql("string_agg(line, chr(10) ORDER BY i)")} AS content, max(lv) AS heading_level, max(CASE WHEN lv > 0 THEN {trim_sql("regexp_extract(line, '^(#{1,2})[ \\t]+(.*)$', 2)")} END) AS h FROM n GROUP BY doc_id, section),
 parents AS (SELECT doc_id, section, CASE WHEN heading_level > 0 THEN h ELSE '开篇' END AS heading, heading_level::BIGINT AS heading_level, content FROM a WHERE length(content) >= 200 OR (heading_level = 1 AND length(content) > 0))"""


def books(spark, d):
    return docs(spark, d).select("doc_id", "source", book_().alias("text"))


@query("split_parents", f"WITH {PARENTS_SQL} SELECT * FROM parents")
def split_parents(spark, d):
    return chunking.split_parents(books(spark, d), "doc_id")


@query("heading_path", f"""WITH {PARENTS_SQL} SELECT doc_id, section, CASE WHEN heading_level > 1 AND top IS NOT NULL THEN top || ' > ' || heading ELSE heading END AS path
 FROM (SELECT *, last_value(CASE WHEN heading_level = 1 THEN heading END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM parents)""")
def heading_path(spark, d):
    return chunking.heading_paths(chunking.split_parents(books(spark, d), "doc_id"), "doc_id").select("doc_id", "section", "path")


@query("split_pdr", f"""WITH {PARENTS_SQL}, hp AS (SELECT doc_id, section, content, CASE WHEN heading_level > 1 AND top IS NOT NULL THEN top || ' > ' || heading ELSE heading END AS path
  FROM (SELECT *, last_value(CASE WHEN heading_level = 1 THEN heading END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM parents)),
 pt AS (SELECT doc_id, section, source, path, '# ' || path || chr(10) || chr(10) || content AS parent_text FROM hp JOIN documents USING (doc_id)), tk AS (SELECT *, {TOKENS.replace('text', 'parent_text')} AS ts FROM pt WHERE length(parent_text) >= 256),
 cut AS (SELECT doc_id, section, source, path, parent_text, 0 AS i, parent_text AS chunk_text FROM pt WHERE length(parent_text) < 256 UNION ALL
  SELECT doc_id, section, source, path, parent_text, i, array_to_string(ts[i * 96 + 1 : i * 96 + 128], ' ') FROM (SELECT *, unnest(range(0, greatest(0, ceil((len(ts) - 128) / 96.0))::BIGINT + 1)) AS i FROM tk WHERE len(ts) > 0))
 SELECT doc_id, section, sha256(source || chr(1) || parent_text) AS parent_id, row_number() OVER (PARTITION BY doc_id ORDER BY section, i) - 1 AS chunk_index, chunk_text, '以下内容出自《' || source || '》' || path || '：' AS contextual_header FROM cut""")
def split_pdr(spark, d):
    return chunking.split_pdr(books(spark, d), "doc_id", "source", 128, 32, tokenizer=tx.latin_tokens).select("doc_id", "section", "parent_id", "chunk_index", "chunk_text", "contextual_header")


@query("split_token_window", f"""SELECT doc_id, i AS chunk_index, array_to_string(ts[i * 96 + 1 : i * 96 + 128], ' ') AS chunk_text FROM (SELECT doc_id, ts, unnest(range(0, greatest(0, ceil((len(ts) - 128) / 96.0))::BIGINT + 1)) AS i FROM (SELECT doc_id, {TOKENS} AS ts FROM documents) WHERE len(ts) > 0)""")
def split_token_window(spark, d):
    return chunking.split_tokens(docs(spark, d).select("doc_id", "text"), 128, 32, tokenizer=tx.latin_tokens).select("doc_id", "chunk_index", "chunk_text")


@query("split_char_window", f"WITH {chunks_sql(150, 30)} SELECT doc_id, chunk_index, chunk_text FROM cut")
def split_char_window(spark, d):
    return chunking.split_chars(docs(spark, d).select("doc_id", "text")).select("doc_id", "chunk_index", "chunk_text")


@query("split_recursive")
def split_recursive(spark, d):
    return chunking.split_recursive(docs(spark, d), "doc_id")


@query("split_lines", """WITH p AS (SELECT doc_id, list_reduce(list_transform(string_split(text, chr(10)), lambda x: {'done': []::VARCHAR[], 'cur': x}), lambda a, x: CASE WHEN length(a.cur) + 1 + length(x.cur) > 1000 THEN {'done': list_append(a.done, a.cur), 'cur': x.cur} ELSE {'done': a.done, 'cur': a.cur || chr(10) || x.cur} END) AS r FROM documents WHERE text IS NOT NULL),
 c AS (SELECT doc_id, list_append(r.done, r.cur) AS cs FROM p) SELECT doc_id, generate_subscripts(cs, 1) - 1 AS chunk_index, unnest(cs) AS chunk_text FROM c""")
def split_lines(spark, d):
    return chunking.split_lines(docs(spark, d).select("doc_id", "text")).select("doc_id", "chunk_index", "chunk_text")


@query("chunk_context_header", "SELECT doc_id, CASE WHEN lang = 'en' AND doc_id % 2 = 0 THEN '' ELSE '以下内容出自' || CASE WHEN lang = 'en' THEN '' ELSE '《' || source || '》' END || CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'a > b' END || '：' END AS header FROM documents")
def chunk_context_header(spark, d):
    return docs(spark, d).select("doc_id", chunking.context_header(F.when(F.col("lang") != "en", F.col("source")), F.when(F.col("doc_id") % 2 == 1, "a > b")).alias("header"))


@query("chunk_enrich", f"""WITH {chunks_sql()} SELECT id, CASE WHEN doc_id % 2 = 0 THEN 'head of ' || source ELSE '【来源：《' || CASE WHEN lang = 'en' THEN '未知文献' ELSE source END || '》第' || (doc_id % 7)::VARCHAR || '页】' END || chr(10) || chunk_text AS enriched FROM chunks JOIN documents USING (doc_id)""")
def chunk_enrich(spark, d):
    cut = chunking.split_chars(docs(spark, d).select("doc_id", "text", F.when(F.col("lang") != "en", F.col("source")).alias("doc_name"), (F.col("doc_id") % 7).alias("doc_page"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("head of "), "source")).alias("contextual_header")), 800, 100)
    rich = chunking.dedup_chunks(chunking.enrich_chunks(cut), "doc_id")
    return rich.select((F.col("doc_id") * 100000 + F.col("chunk_index")).alias("id"), "enriched")


@query("dedup_chunk_hash", f"WITH {chunks_sql(150, 30)} SELECT doc_id, chunk_index, md5(chunk_text) AS hash FROM chunks")
def dedup_chunk_hash(spark, d):
    return chunks(spark, d, 150, 30).select("doc_id", "chunk_index", F.md5("chunk_text").alias("hash"))


# --- text index ----------------------------------------------------------------------------------


@query("tokenize_corpus", f"SELECT doc_id, len({TOKENS}) AS n_tokens, md5(array_to_string({TOKENS}, ' ')) AS digest FROM documents")
def tokenize_corpus(spark, d):
    t = docs(spark, d).select("doc_id", tx.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("corpus_token_stats", f"SELECT count(*) AS n_docs, sum(len({TOKENS}))::BIGINT AS n_tokens FROM documents")
def corpus_token_stats(spark, d):
    rows = docs(spark, d).select(F.col("text").alias("chunk_text"), F.lit(None).cast("string").alias("parent_text"), F.col("source").alias("doc_name"))
    return files.corpus_stats(rows, tokenizer=tx.latin_tokens).select(F.col("n_chunks").alias("n_docs"), "n_tokens")


@query("bm25_index", f"""WITH w AS (SELECT unnest(list_distinct({TOKENS})) AS term FROM documents), df AS (SELECT term, count(*) AS df FROM w GROUP BY term),
 raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, (SELECT count(*) AS n FROM documents)), m AS (SELECT 0.25 * avg(r) AS least FROM raw) SELECT term, df, round(CASE WHEN r < 0 THEN least ELSE r END, 6) AS idf FROM raw, m""")
def bm25_index(spark, d):
    return index.idf_table(index.build_bm25(docs(spark, d), "doc_id")).select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_topk", f"WITH {chunks_sql()}, d AS (SELECT id, chunk_text AS text FROM chunks), q AS (SELECT item_id AS query_id, text FROM benchmark), {bm25_sql(5)} SELECT query_id, id, score, rank FROM bm")
def bm25_topk(spark, d):
    return stored_index(spark, d, "chunks", lambda: chunks(spark, d).select("id", F.col("chunk_text").alias("text"))).topk(asked(spark, d), 5)


def document_index(spark, d) -> StoredIndex:
    return stored_index(spark, d, "documents", lambda: docs(spark, d).select(F.col("doc_id").alias("id"), "text"))


def revised(spark, d, run: int) -> DataFrame:
    """id, text of the documents as the run-th ingest finds them: English ones first, then all, German ones then changed and Spanish ones gone."""
    rows = docs(spark, d).select(F.col("doc_id").alias("id"), "text", "lang")
    if run == 0:
        return rows.filter("lang in ('en', 'de', 'es')").select("id", "text")
    return rows.filter("lang in ('fr', 'de')").select("id", F.when(F.col("lang") == "de", F.concat(F.lit("zweite Fassung "), "text")).otherwise(F.col("text")).alias("text"))


REVISED_SQL = "d AS (SELECT doc_id AS id, CASE WHEN lang = 'de' THEN 'zweite Fassung ' || text ELSE text END AS text FROM documents WHERE lang IN ('en', 'fr', 'de')), q AS (SELECT item_id AS query_id, text FROM benchmark)"


def segmented(spark, d) -> StoredIndex:
    """An index of two ingests: two segments, the second with changed and deleted documents."""
    store = StoredIndex(spark, shared(spark, "segments"), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    store.add(revised(spark, d, 0))
    store.add(revised(spark, d, 1), gone=docs(spark, d).filter("lang = 'es'").select(F.col("doc_id").alias("id")))
    return store


@query("bm25_segments_topk", f"WITH {REVISED_SQL}, {bm25_sql(10)} SELECT query_id, id, score, rank FROM bm")
def bm25_segments_topk(spark, d):
    """Search over segments equals search over an index of the final documents."""
    return segmented(spark, d).topk(asked(spark, d), 10)


@query("bm25_segments_compacted", f"WITH {REVISED_SQL}, w AS (SELECT id, unnest({TOKENS}) AS term FROM d), p AS (SELECT term, id, count(*) AS tf FROM w GROUP BY term, id) SELECT term, count(*) AS df, sum(tf)::BIGINT AS n, md5(min(id) || ' ' || max(id)) AS ids FROM p GROUP BY term")
def bm25_segments_compacted(spark, d):
    """Postings after compaction and the removal of old files are those of the final documents."""
    store = segmented(spark, d)
    store.compact()
    store.vacuum()
    counted = store.index().postings.groupBy("term").agg(F.count("*").alias("m"), F.sum("tf").alias("n"), F.md5(F.concat_ws(" ", F.min("id"), F.max("id"))).alias("ids"))
    return store.index().terms.join(counted, "term", "full").select("term", F.when(F.col("m") == F.col("df"), F.col("df")).alias("df"), "n", "ids")


DOC_HITS = f"d AS (SELECT doc_id AS id, text FROM documents), q AS (SELECT item_id AS query_id, text FROM benchmark), {bm25_sql(10)}"


def doc_hits(spark, d, k: int = 10) -> DataFrame:
    return document_index(spark, d).topk(asked(spark, d), k)


@query("fulltext_and", f"""WITH d AS (SELECT doc_id AS id, text FROM documents), q AS (SELECT item_id AS query_id, text FROM benchmark), {bm25_sql(1)}, n AS (SELECT query_id, count(*) AS n FROM qf GROUP BY query_id),
 h AS (SELECT query_id, id, count(*) AS m, round(sum(1 + ln(tf)), 6) AS score FROM qf JOIN post USING (term) GROUP BY query_id, id) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h JOIN n USING (query_id) WHERE m = n QUALIFY rank <= 5""")
def fulltext_and(spark, d):
    return index.fulltext_and(asked(spark, d), document_index(spark, d).index())


@query("highlight_hits", r"""SELECT doc_id, replace(replace(replace(text, 'tion', '**tion**'), 'que', '**que**'), 'er', '**er**') AS highlighted, array_to_string(list_filter(['tion', 'que', 'er'], lambda t: contains(text, t)), ' ') AS matched FROM documents""")
def highlight_hits(spark, d):
    hits = docs(spark, d).select("doc_id", F.col("text").alias("content"), F.array(*[F.lit(t) for t in ("er", "a", "que", "tion", "er")]).alias("terms"))
    return index.highlight(hits).select("doc_id", "highlighted", F.array_join("matched", " ").alias("matched"))


@query("dedup_parent", f"WITH {DOC_HITS}, p AS (SELECT query_id, id, score, source FROM bm JOIN documents ON doc_id = id QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) = 1) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p QUALIFY rank <= 5")
def dedup_parent(spark, d):
    parents = docs(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("parent_key"))
    return document_index(spark, d).topk(asked(spark, d), 5, parents=parents).select("query_id", "id", "score", "rank")


@query("embed_hash")
def embed_hash(spark, d):
    return docs(spark, d).select("doc_id", vf.embed_hash(F.col("text"), 16).alias("vector"))


@query("vector_text_codec", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, len(embedding) AS n FROM embeddings")
def vector_text_codec(spark, d):
    v = vf.from_text(vf.to_text(F.col("embedding")))
    return load(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"), F.size("v").cast("long").alias("n"))
