"""Queries over retrieval legs, routing, answers, history and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import citations, evaluation, fusion, history, index, routing, telemetry
from ..operators import vector_search as vs
from ..sources import files
from .corpus_queries import DOC_HITS, TOKENS, asked, bm25_sql, doc_hits, docs, trim_sql
from .registry import load, query

# --- vector legs: the halves of an embedding stand for two kinds of vectors of one corpus ---------


EVERY = 20  # every so many-th vector is a query, against all vectors


def vectors(spark, d, part: tuple[int, int] = (1, 64)) -> tuple[DataFrame, DataFrame]:
    e = load(spark, d, "embeddings").select("vec_id", F.slice("embedding", part[0], part[1] - part[0] + 1).alias("vector"))
    return e.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "vector"), e.select(F.col("vec_id").alias("id"), "vector")


def leg(spark, d, part=(1, 64), k=20) -> DataFrame:
    return vs.vector_topk(*vectors(spark, d, part), k)


def leg_sql(name: str, part=(1, 64), k=20) -> str:
    a, b = part
    return f"""{name} AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(q.embedding[{a}:{b}]::DOUBLE[], c.embedding[{a}:{b}]::DOUBLE[]), 6) AS score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding[{a}:{b}]::DOUBLE[], c.embedding[{a}:{b}]::DOUBLE[]), 6) DESC, c.vec_id) AS rank
      FROM embeddings q, embeddings c WHERE q.vec_id % {EVERY} = 0 QUALIFY rank <= {k})"""


A, B = (1, 32), (33, 64)
LEGS = f"{leg_sql('a', A)}, {leg_sql('b', B)}"
BOTH = """f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.rank AS ra, b.rank AS rb FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id),
 g AS (SELECT *, count(ra) OVER (PARTITION BY query_id) AS na, count(rb) OVER (PARTITION BY query_id) AS nb FROM f)"""
TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank"


def legs(spark, d) -> tuple[DataFrame, DataFrame]:
    return leg(spark, d, A), leg(spark, d, B)


def parents_of(spark, d) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 50).alias("parent_key"))


@query("vector_topk", f"WITH {leg_sql('a', k=10)} SELECT * FROM a")
def vector_topk(spark, d):
    return leg(spark, d, k=10)


@query("faq_topk", f"WITH {leg_sql('a', k=5)} SELECT * FROM a")
def faq_topk(spark, d):
    return vs.faq_topk(*vectors(spark, d))


@query("faq_vector_threshold", f"WITH {leg_sql('a', k=10)} SELECT query_id, id, score, {TOP} FROM a WHERE score > 0.4")
def faq_vector_threshold(spark, d):
    return vs.vector_topk(*vectors(spark, d), k=10, min_sim=0.4)


@query("vector_topk_lsh")
def vector_topk_lsh(spark, d):
    return vs.vector_topk_lsh(*vectors(spark, d), k=10)


@query("vector_topk_blocks", f"WITH {leg_sql('a', k=10)} SELECT * FROM a")
def vector_topk_blocks(spark, d):
    """The same search in small blocks: ten or more on each side."""
    return vs.vector_topk(*vectors(spark, d), k=10, most_values=512, groups=3)


@query("vector_lsh_recall", f"SELECT count(*) AS n_queries, true AS recall_reached, true AS few_scored FROM embeddings WHERE vec_id % {EVERY} = 0")
def vector_lsh_recall(spark, d):
    """Mean recall@10 of the approximate search is 0.9 or more; it scores at most a tenth of all pairs."""
    q, v = vectors(spark, d)
    n = v.count()
    recall = vs.recall_at_k(vs.vector_topk_lsh(q, v, k=10), vs.vector_topk(q, v, k=10))
    return recall.agg(F.count("*").alias("n_queries"), (F.avg("recall") >= 0.9).alias("recall_reached"), F.lit(max(10, min(100, -(-n // 10))) <= 0.1 * n).alias("few_scored"))


@query("leg_ranks", f"WITH {LEGS} SELECT query_id, id, 'a' AS leg, rank FROM a UNION ALL SELECT query_id, id, 'b', rank FROM b")
def leg_ranks(spark, d):
    a, b = legs(spark, d)
    return vs.rank_of(a.drop("rank")).select("query_id", "id", F.lit("a").alias("leg"), "rank").unionByName(vs.rank_of(b.drop("rank")).select("query_id", "id", F.lit("b").alias("leg"), "rank"))


@query("rrf_fusion", f"""WITH {LEGS}, {BOTH}, s AS (SELECT query_id, id, round(1.0 / (60 + coalesce(ra, greatest(na, 20))) + 1.0 / (60 + coalesce(rb, greatest(nb, 20))), 9) AS score, coalesce(ra, na + 1) AS rank_a, coalesce(rb, nb + 1) AS rank_b FROM g),
 p AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, id % 50 ORDER BY score DESC, id) = 1) SELECT query_id, id, score, rank_a, rank_b, id % 50 AS parent_key, {TOP} FROM p QUALIFY rank <= 10""")
def rrf_fusion(spark, d):
    return fusion.rrf_fuse(*legs(spark, d), parents=parents_of(spark, d))


@query("rrf_fusion_tail", f"""WITH {LEGS}, {BOTH} SELECT query_id, id, round(1.0 / (60 + coalesce(ra, na + 1)) + 1.0 / (60 + coalesce(rb, nb + 1)), 9) AS score, coalesce(ra, -1) AS rank_a, coalesce(rb, -1) AS rank_b, {TOP} FROM g QUALIFY rank <= 10""")
def rrf_fusion_tail(spark, d):
    return fusion.rrf_fuse(*legs(spark, d), missing_rank="tail")


NORM = "round((score - min(score) OVER w) / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1 END, 6)"


@query("minmax_norm", f"WITH {leg_sql('a', A)} SELECT query_id, id, {NORM} AS norm FROM a WINDOW w AS (PARTITION BY query_id)")
def minmax_norm(spark, d):
    return fusion.minmax_norm(leg(spark, d, A)).select("query_id", "id", "norm")


@query("linear_fusion", f"""WITH {LEGS}, x AS (SELECT query_id, id, {NORM} AS n FROM a WINDOW w AS (PARTITION BY query_id)), y AS (SELECT query_id, id, {NORM} AS n FROM b WINDOW w AS (PARTITION BY query_id)),
 s AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.id, y.id) AS id, round(0.7 * coalesce(x.n, 0) + 0.3 * coalesce(y.n, 0), 6) AS score FROM x FULL JOIN y ON x.query_id = y.query_id AND x.id = y.id) SELECT query_id, id, score, {TOP} FROM s QUALIFY rank <= 10""")
def linear_fusion(spark, d):
    return fusion.linear_fuse(*legs(spark, d))


@query("rrf_cross_source", f"""WITH {LEGS}, u AS (SELECT query_id, id, rank, 0 AS p FROM a UNION ALL SELECT query_id, id, rank, 1 FROM b), k AS (SELECT *, sha1('content ' || (id % 100)) AS content_key FROM u),
 s AS (SELECT query_id, content_key, round(sum(1.0 / (60 + rank)), 9) AS score, min((p, rank, id)) AS r FROM k GROUP BY query_id, content_key), t AS (SELECT query_id, content_key, r[3] AS id, CASE WHEN r[1] = 0 THEN 'faq' ELSE 'doc' END AS source, score FROM s) SELECT *, {TOP} FROM t QUALIFY rank <= 5""")
def rrf_cross_source(spark, d):
    key = tx.content_hash(F.concat(F.lit(" Content  "), (F.col("id") % 100).cast("string")))
    a, b = legs(spark, d)
    return fusion.rrf_fuse_by_content(a.withColumn("content_key", key), b.withColumn("content_key", key))


VARIANTS = f"v AS (SELECT query_id % 5 AS query_id, id, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)"


@query("multi_query_merge", f"WITH {LEGS}, {VARIANTS}, p AS (SELECT *, id % 50 AS parent_key FROM v QUALIFY row_number() OVER (PARTITION BY query_id, id % 50 ORDER BY score DESC, id) = 1) SELECT *, {TOP} FROM p QUALIFY rank <= 10")
def multi_query_merge(spark, d):
    a, b = legs(spark, d)
    hits = a.unionByName(b).select((F.col("query_id") % 5).alias("query_id"), F.col("query_id").alias("variant"), "id", "score")
    return fusion.merge_variants(hits, 10, parents_of(spark, d))


@query("hybrid_two_lists", f"WITH {LEGS} SELECT query_id, (SELECT string_agg(id, ',' ORDER BY rank) FROM a WHERE a.query_id = q.query_id AND rank <= 5) AS faq, (SELECT string_agg(id, ',' ORDER BY rank) FROM b WHERE b.query_id = q.query_id AND rank <= 5) AS doc FROM (SELECT DISTINCT query_id FROM a) q")
def hybrid_two_lists(spark, d):
    a, b = legs(spark, d)
    return fusion.two_lists(a.drop("rank"), b.drop("rank")).select("query_id", F.array_join("faq", ",").alias("faq"), F.array_join("doc", ",").alias("doc"))


@query("interleave_fusion", f"WITH {LEGS}, s AS (SELECT query_id, id, -min(p) AS score FROM (SELECT query_id, id, 2 * rank - 1 AS p FROM a UNION ALL SELECT query_id, id, 2 * rank FROM b) GROUP BY query_id, id) SELECT query_id, id, {TOP} FROM s QUALIFY rank <= 10")
def interleave_fusion(spark, d):
    a, b = legs(spark, d)
    return fusion.interleave(a.drop("rank"), b.drop("rank"))


@query("candidate_union", f"WITH {LEGS} SELECT query_id, id FROM a UNION SELECT query_id, id FROM b")
def candidate_union(spark, d):
    return fusion.candidate_union(*legs(spark, d))


@query("rerank_second_stage", f"""WITH {DOC_HITS}, t AS (SELECT bm.query_id, bm.id, list_distinct({TOKENS.replace('text', 'q.text')}) AS qt, {TOKENS.replace('text', 'd.text')} AS dt FROM bm JOIN q USING (query_id) JOIN d USING (id)),
 s AS (SELECT query_id, id, round(len(list_intersect(qt, dt)) / greatest(len(qt), 1), 6) AS score FROM t) SELECT query_id, id, score, {TOP} FROM s WHERE score >= 0.5 QUALIFY rank <= 5""")
def rerank_second_stage(spark, d):
    hits = doc_hits(spark, d).join(asked(spark, d).select("query_id", tx.latin_tokens(F.col("text")).alias("query_terms")), "query_id").join(docs(spark, d).select(F.col("doc_id").alias("id"), tx.latin_tokens(F.col("text")).alias("content_terms")), "id")
    return fusion.rerank(hits.drop("rank"))


@query("parent_expand", f"WITH {DOC_HITS} SELECT query_id, id, rank, CASE WHEN lang = 'en' THEN source || ' parent' ELSE d.text END AS content FROM bm JOIN d USING (id) JOIN documents ON doc_id = id WHERE rank <= 3")
def parent_expand(spark, d):
    full = docs(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("chunk_text"), F.when(F.col("lang") == "en", F.col("source")).otherwise(F.concat("source", F.lit("?"))).alias("parent_id"))
    parents = docs(spark, d).select(F.col("source").alias("parent_id"), F.concat("source", F.lit(" parent")).alias("parent_text")).distinct()
    return routing.expand_parents(doc_hits(spark, d, 3).join(full, "id"), parents).select("query_id", "id", "rank", "content")


@query("parent_fallback", "SELECT doc_id, CASE WHEN lang = 'fr' OR lang = 'de' THEN text ELSE source END AS content FROM documents")
def parent_fallback(spark, d):
    parent = F.when(F.col("lang") == "fr", F.lit("")).when(F.col("lang") != "de", F.col("source"))
    return docs(spark, d).select("doc_id", routing.parent_fallback(parent, F.col("text")).alias("content"))


RELEVANT = "rel AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents x ON contains(x.text, b.text))"


@query("retrieval_eval", f"""WITH {DOC_HITS}, {RELEVANT}, n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id), m AS (SELECT bm.query_id, count(*) AS h, count(rel.id) AS f, min(CASE WHEN rel.id IS NOT NULL THEN rank END) AS first FROM bm LEFT JOIN rel USING (query_id, id) GROUP BY bm.query_id),
 p AS (SELECT round(coalesce(f / h, 0), 6) AS precision, round(coalesce(f, 0) / n, 6) AS recall, (coalesce(f, 0) > 0)::BIGINT AS hit, round(coalesce(1.0 / first, 0), 6) AS rr FROM n LEFT JOIN m USING (query_id))
 SELECT count(*) AS n_queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit_rate, round(avg(rr), 6) AS mrr FROM p""")
def retrieval_eval(spark, d):
    """Relevant: documents that hold the passage."""
    return evaluation.evaluate_retrieval(doc_hits(spark, d), holders(spark, d))


def holders(spark, d) -> DataFrame:
    """query_id, id of documents that hold a passage."""
    return evaluation.containing(asked(spark, d), docs(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("body")))


@query("hit_term_matrix", f"WITH {DOC_HITS} SELECT query_id, id, contains(d.text, 'tion')::BIGINT AS has_0, contains(d.text, 'token')::BIGINT AS has_1, contains(d.text, 'License')::BIGINT AS has_2 FROM bm JOIN d USING (id)")
def hit_term_matrix(spark, d):
    hits = doc_hits(spark, d).join(docs(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id")
    return evaluation.hit_term_matrix(hits, ["tion", "token", "License"])


# --- routing and context -------------------------------------------------------------------------


def routed(spark, d, **options) -> DataFrame:
    q = load(spark, d, "embeddings").filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"))
    # Each query finds itself, so FAQ scores are lowered by query: all routes occur.
    faq = leg(spark, d, k=5).filter(F.col("query_id") % 8 != 0).withColumn("score", F.round(F.col("score") * (0.5 + F.col("query_id") % 60 / 100.0), 6))
    r = routing.route(q, faq.drop("rank"), leg(spark, d, A, 10).drop("rank"), **options)
    return r.select("query_id", "route", "confidence", "confidence_kind", F.array_join("faq", ",").alias("faq"), F.array_join("doc", ",").alias("doc"))


def route_sql(high: float, low: str) -> str:
    return f"""WITH {leg_sql('fa', k=5)}, {leg_sql('dh', A, 10)}, f AS (SELECT query_id, id, rank, round(score * (0.5 + query_id % 60 / 100.0)::DOUBLE, 6) AS score FROM fa WHERE query_id % 8 <> 0), g AS (SELECT * FROM f WHERE score BETWEEN 0 AND 1),
 h AS (SELECT *, {TOP.replace('AS rank', 'AS rk')} FROM g), x AS (SELECT query_id, max(score) AS sim, string_agg(id, ',' ORDER BY rk) AS faq FROM h GROUP BY query_id), y AS (SELECT query_id, max(score) AS ds, string_agg(id, ',' ORDER BY rank) AS doc FROM dh WHERE rank <= 5 GROUP BY query_id),
 r AS (SELECT vec_id AS query_id, sim, faq, ds, doc, CASE WHEN sim IS NULL OR {low} THEN 'DOC_ONLY' WHEN sim >= {high} THEN 'FAQ_ONLY' ELSE 'HYBRID' END AS route FROM embeddings LEFT JOIN x ON x.query_id = vec_id LEFT JOIN y ON y.query_id = vec_id WHERE vec_id % {EVERY} = 0)
 SELECT query_id, route, (CASE WHEN route = 'DOC_ONLY' THEN coalesce(ds, 0) ELSE sim END)::DOUBLE AS confidence, CASE WHEN route = 'DOC_ONLY' THEN 'doc' ELSE 'faq' END AS confidence_kind, CASE WHEN route = 'DOC_ONLY' THEN '' ELSE faq END AS faq, CASE WHEN route = 'FAQ_ONLY' THEN '' ELSE coalesce(doc, '') END AS doc FROM r"""


@query("route_queries", route_sql(0.85, "sim < 0.62"))
def route_queries(spark, d):
    return routed(spark, d)


@query("route_queries_strict", route_sql(0.90, "false"))
def route_queries_strict(spark, d):
    return routed(spark, d, high=0.90, use_low=False)


@query("outcome_codes", """SELECT event_id, CASE event_type WHEN 'error' THEN 502 WHEN 'click' THEN 200 WHEN 'view' THEN 504 ELSE 500 END AS status, CASE event_type WHEN 'error' THEN 'generation failed' WHEN 'click' THEN 'ok' WHEN 'view' THEN 'timed out' ELSE 'internal error' END AS message FROM events""")
def outcome_codes(spark, d):
    code = F.when(F.col("event_type") == "error", "llm_error").when(F.col("event_type") == "view", "timeout").when(F.col("event_type") != "click", F.col("event_type"))
    return routing.map_outcome(load(spark, d, "events").select("event_id", code.alias("error_code")), routing.outcome_table(spark)).select("event_id", F.col("status").cast("int").alias("status"), "message")


# Conversations as questions: the first user turn asks, assistant turns are documents, system turns FAQ.


def content_() -> Column:
    return F.concat(F.when(F.col("turn") % 2 == 1, F.concat(F.lit("intro\n## "), F.col("role"), F.lit("\n"))).otherwise(F.lit("")), F.col("text"))


CONTENT_SQL = "CASE WHEN turn % 2 = 1 THEN 'intro' || chr(10) || '## ' || role || chr(10) ELSE '' END || text"


def talk(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = load(spark, d, "conversations")
    q = c.groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("text"))
    base = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), (1.0 / (1 + F.col("turn"))).alias("score"), F.concat(F.lit("talk <"), F.col("role"), F.lit("> & co")).alias("doc_name"), content_().alias("content"), F.col("role"), F.col("text"))
    return q, base.filter("role <> 'assistant'").withColumnsRenamed({"text": "answer"}).withColumn("question", F.col("doc_name")), base.filter("role = 'assistant'")


ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
PACK_SQL = f"""WITH q AS (SELECT conv_id AS query_id, min_by(text, turn) AS text FROM conversations GROUP BY conv_id),
 f AS (SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, 'talk <' || role || '> & co' AS n, text AS a FROM conversations WHERE role <> 'assistant'),
 s AS (SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, 'talk <' || role || '> & co' AS n, {CONTENT_SQL} AS c, CASE WHEN turn % 2 = 1 THEN role ELSE '' END AS t FROM conversations WHERE role = 'assistant'),
 fx AS (SELECT query_id, string_agg('<faq id="F' || r || '" title="' || {ESC.format('n')} || '">' || {ESC.format('a')} || '</faq>', chr(10) ORDER BY r) AS x FROM f WHERE r <= 3 GROUP BY query_id),
 dx AS (SELECT query_id, string_agg('<doc id="' || r || '" title="' || {ESC.format("CASE WHEN t <> '' THEN n || ' · ' || t ELSE n END")} || '">' || {ESC.format('c')} || '</doc>', chr(10) ORDER BY r) AS x FROM s WHERE r <= 5 GROUP BY query_id)"""


@query("pack_context", PACK_SQL + " SELECT q.query_id, md5(concat_ws(chr(10), fx.x, dx.x) || chr(10) || chr(10) || q.text) AS digest FROM q LEFT JOIN fx USING (query_id) LEFT JOIN dx USING (query_id)")
def pack_context(spark, d):
    return routing.pack_context(*talk(spark, d))[0].select("query_id", F.md5("prompt").alias("digest"))


@query("chapter_title", f"SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN role ELSE '' END AS title FROM conversations")
def chapter_title(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", tx.chapter_title(content_()).alias("title"))


@query("format_context", f"""WITH s AS (SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, '来源：talk <' || role || '> & co' || chr(10) || '内容：' || {CONTENT_SQL} AS x FROM conversations WHERE role = 'assistant'), a AS (SELECT query_id, string_agg(x, chr(10) || chr(10) ORDER BY r) AS x FROM s WHERE r <= 5 GROUP BY query_id)
 SELECT conv_id AS query_id, coalesce(any_value(x), '（无相关资料）') AS context FROM conversations LEFT JOIN a ON query_id = conv_id GROUP BY conv_id""")
def format_context(spark, d):
    q, _, doc = talk(spark, d)
    return routing.format_context(q, doc)


@query("parse_variants", """WITH l AS (SELECT item_id, text, unnest(string_split('1. ' || replace(text, '. ', chr(10) || '- ') || chr(10) || 'abc', chr(10))) AS x, generate_subscripts(string_split('1. ' || replace(text, '. ', chr(10) || '- ') || chr(10) || 'abc', chr(10)), 1) AS i FROM benchmark),
 t AS (SELECT item_id, text, i, regexp_replace(regexp_replace(x, '^[0-9.*\\- ]+', ''), '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') AS v FROM l), k AS (SELECT item_id, v, min(i) AS i FROM t WHERE length(v) > 3 AND v <> text GROUP BY item_id, v), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM k)
 SELECT b.item_id AS query_id, text || coalesce('|' || string_agg(v, '|' ORDER BY n), '') AS variants FROM benchmark b LEFT JOIN r ON r.item_id = b.item_id AND n <= 3 GROUP BY b.item_id, text""")
def parse_variants(spark, d):
    rows = asked(spark, d).withColumn("generated", F.concat(F.lit("1. "), F.replace(F.col("text"), F.lit(". "), F.lit("\n- ")), F.lit("\nabc")))
    return routing.parse_variants(rows).select("query_id", F.array_join("variants", "|").alias("variants"))


# --- answers: every document as an answer whose sentences cite sources 1 to 4 in turn -------------


def answers(spark, d) -> DataFrame:
    said = F.array_join(F.transform(F.split("text", r"\. "), lambda x, i: F.concat(x, F.lit(" ["), (i % 4 + 1).cast("string"), F.lit("]。"))), "")
    return docs(spark, d).select(F.col("doc_id").alias("answer_id"), F.concat(F.when(F.col("lang") == "fr", F.lit("关系 ")).otherwise(F.lit("")), said).alias("answer"), "text", "source", "lang")


def sources(spark, d) -> DataFrame:
    """1: nothing of the text; 2: too short; 3: the whole text; 4 is missing."""
    each = F.array(F.struct(F.lit(1).alias("ref_id"), F.concat(F.lit("nothing of this is there "), F.col("source")).alias("content")), F.struct(F.lit(2).alias("ref_id"), F.lit("short").alias("content")), F.struct(F.lit(3).alias("ref_id"), F.col("text").alias("content")))
    return docs(spark, d).select(F.col("doc_id").alias("answer_id"), F.concat(F.lit("《"), F.col("source"), F.lit("(2nd)")).alias("doc_name"), F.when(F.col("lang") == "en", F.lit("chapter")).otherwise(F.lit("")).alias("chapter_title"), F.explode(each).alias("e")).select("answer_id", "doc_name", "chapter_title", "e.*")


SKIP_SQL = "[" + ",".join(f"'{w}'" for w in citations.SKIP) + "]"
GENERIC_SQL = "[" + ",".join(f"'{w}'" for w in citations.GENERIC) + "]"
ANSWERS_SQL = r"""ans AS (SELECT doc_id AS answer_id, text, source, lang, CASE WHEN lang = 'fr' THEN '关系 ' ELSE '' END || array_to_string(list_transform(string_split(text, '. '), lambda x, i: x || ' [' || ((i - 1) % 4 + 1) || ']。'), '') AS answer FROM documents),
 src AS (SELECT answer_id, '1' AS ref_id, 'nothing of this is there ' || source AS content FROM ans UNION ALL SELECT answer_id, '2', 'short' FROM ans UNION ALL SELECT answer_id, '3', text FROM ans),
 parts AS (SELECT answer_id, lang, unnest(p) AS part, generate_subscripts(p, 1) AS pos FROM (SELECT answer_id, lang, regexp_extract_all(answer, '[^。！？\n]*[。！？\n]\s*|[^。！？\n]+$') AS p FROM ans)),
 cited AS (SELECT answer_id, lang, pos, """ + trim_sql("part") + r""" AS sentence, unnest(regexp_extract_all(part, '\[([0-9]+)\]', 1)) AS ref_id FROM parts)"""
TERMS_SQL = rf"""terms AS (SELECT *, list_filter(list_transform(list_sort(list_transform(list_distinct(w), lambda t: {{'p': list_position(w, t), 't': t}})), lambda s: s.t), lambda t: length(t) >= 2 AND NOT list_contains({SKIP_SQL}, t))[1:15] AS terms FROM (
 SELECT *, list_concat(list_concat(flatten(list_transform(regexp_extract_all(plain, '["''](.+?)["'']', 1), lambda x: regexp_extract_all(x, '[\p{{L}}\p{{N}}]+'))), regexp_extract_all(plain, '(?:[0-9]{{1,4}}|[一二三四五六七八九十百千]+)(?:年|月|日|升|石|顷|亩|人|户|卷)?')), regexp_extract_all(plain, '\p{{Lu}}[\p{{L}}\p{{N}}]*|[一-龥]+')) AS w
 FROM (SELECT *, regexp_replace(sentence, '\[[0-9]+\]', '', 'g') AS plain FROM cited)))"""
SCORE_SQL = f"""sup AS (SELECT t.*, content, c, list_filter(c, lambda x: contains(coalesce(content, ''), x)) AS hit FROM (SELECT *, list_filter(terms, lambda x: NOT list_contains({GENERIC_SQL}, x)) AS c FROM terms) t LEFT JOIN src USING (answer_id, ref_id)),
 sco AS (SELECT *, round(CASE WHEN len(c) = 0 THEN 1.0 WHEN len(list_filter(hit, lambda x: length(x) >= 3)) > 0 THEN greatest(0.5, len(list_filter(hit, lambda x: length(x) >= 3)) / len(list_filter(c, lambda x: length(x) >= 3))) ELSE len(hit) / len(c) END, 6) AS score FROM sup)"""
ISSUES_SQL = f"""{ANSWERS_SQL}, {TERMS_SQL}, {SCORE_SQL},
 jud AS (SELECT *, content IS NOT NULL AND length({trim_sql("coalesce(content, '')")}) >= 20 AS checked, CASE WHEN lang = 'fr' THEN greatest(0.15, 0.3 - 0.1) ELSE 0.3 END AS lim FROM sco),
 iss AS (SELECT answer_id, pos, ref_id, sentence, CASE WHEN content IS NULL THEN 'CRITICAL' WHEN NOT checked THEN 'WARNING' WHEN score < 0.1 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, (CASE WHEN checked THEN score ELSE 0 END)::DOUBLE AS score, CASE WHEN content IS NULL THEN 'unknown' WHEN NOT checked THEN 'short' ELSE 'unsupported' END AS reason FROM jud WHERE NOT checked OR score < lim)"""
REPAIR_SQL = """fst AS (SELECT t.answer_id, t.ref_id, min_by(terms, pos) AS terms FROM terms t JOIN (SELECT DISTINCT answer_id, ref_id FROM iss WHERE severity = 'CRITICAL') x USING (answer_id, ref_id) GROUP BY t.answer_id, t.ref_id),
 rep AS (SELECT f.answer_id, f.ref_id, s.ref_id AS new_id, round(len(list_filter(terms, lambda x: contains(s.content, x))) / len(terms), 6) AS share FROM fst f JOIN src s ON s.answer_id = f.answer_id AND s.ref_id <> f.ref_id WHERE len(terms) > 0 AND round(len(list_filter(terms, lambda x: contains(s.content, x))) / len(terms), 6) >= 0.5 QUALIFY row_number() OVER (PARTITION BY f.answer_id, f.ref_id ORDER BY share DESC, s.ref_id) = 1)"""


@query("cited_sentences", f"WITH {ANSWERS_SQL} SELECT answer_id, ref_id, sentence FROM cited")
def cited_sentences(spark, d):
    return citations.cited_sentences(answers(spark, d)).select("answer_id", "ref_id", "sentence")


@query("fact_terms", f"WITH {ANSWERS_SQL}, {TERMS_SQL} SELECT answer_id, ref_id, sentence, array_to_string(terms, '|') AS terms FROM terms")
def fact_terms(spark, d):
    c = citations.cited_sentences(answers(spark, d))
    return c.select("answer_id", "ref_id", "sentence", F.array_join(citations.fact_terms(F.col("sentence")), "|").alias("terms"))


@query("citation_support", f"WITH {ANSWERS_SQL}, {TERMS_SQL}, {SCORE_SQL} SELECT answer_id, ref_id, sentence, score FROM sco WHERE ref_id IN ('1', '3')")
def citation_support(spark, d):
    c = citations.cited_sentences(answers(spark, d)).withColumn("terms", citations.fact_terms(F.col("sentence")))
    s = sources(spark, d).filter("ref_id <> 2").select("answer_id", F.col("ref_id").cast("string").alias("ref_id"), "content")
    return citations.citation_support(c.join(s, ["answer_id", "ref_id"])).select("answer_id", "ref_id", "sentence", "score")


@query("citation_missing", f"WITH {ANSWERS_SQL} SELECT DISTINCT answer_id, ref_id FROM cited ANTI JOIN src USING (answer_id, ref_id)")
def citation_missing(spark, d):
    return citations.citation_missing(answers(spark, d), sources(spark, d))


def issues(spark, d) -> DataFrame:
    return citations.verify_citations(answers(spark, d), sources(spark, d))


@query("citation_verify", f"WITH {ISSUES_SQL} SELECT answer_id, ref_id, sentence, severity, score, reason FROM iss")
def citation_verify(spark, d):
    return issues(spark, d).select("answer_id", "ref_id", "sentence", "severity", "score", "reason")


@query("citation_repair", f"WITH {ISSUES_SQL}, {REPAIR_SQL} SELECT answer_id, ref_id, new_id FROM rep")
def citation_repair(spark, d):
    return citations.repair_citations(answers(spark, d), sources(spark, d), issues(spark, d))


@query("citation_sanitize", rf"""WITH {ISSUES_SQL}, {REPAIR_SQL}, w AS (SELECT answer_id, ref_id, max((severity = 'CRITICAL')::INT) AS crit FROM iss GROUP BY answer_id, ref_id),
 n AS (SELECT answer_id, ref_id, CASE WHEN crit = 0 THEN '[' || ref_id || '·存疑]' WHEN new_id IS NOT NULL THEN '<' || new_id || '>' ELSE '（史料记载）' END AS new FROM w LEFT JOIN rep USING (answer_id, ref_id)),
 p AS (SELECT answer_id, max(CASE ref_id WHEN '1' THEN new END) AS n1, max(CASE ref_id WHEN '2' THEN new END) AS n2, max(CASE ref_id WHEN '3' THEN new END) AS n3, max(CASE ref_id WHEN '4' THEN new END) AS n4 FROM n GROUP BY answer_id)
 SELECT answer_id, md5(CASE WHEN p.answer_id IS NULL THEN answer ELSE {trim_sql("regexp_replace(regexp_replace(replace(replace(replace(replace(answer, '[4]', coalesce(n4, '[4]')), '[3]', coalesce(n3, '[3]')), '[2]', coalesce(n2, '[2]')), '[1]', coalesce(n1, '[1]')), '<([0-9]+)>', '[\\1]', 'g'), '[ \\t]{2,}', ' ', 'g')")} END) AS digest FROM ans LEFT JOIN p USING (answer_id)""")
def citation_sanitize(spark, d):
    found = files.kept(issues(spark, d).select("answer_id", "ref_id", "severity"), "issues")
    fixed = citations.repair_citations(answers(spark, d), sources(spark, d), found)
    return citations.sanitize_answers(answers(spark, d), found, fixed).select("answer_id", F.md5("answer").alias("digest"))


@query("issue_report", f"WITH {ISSUES_SQL} SELECT answer_id, md5(string_agg(format('[{{}}] [{{}}] {{}} {{:.2f}}', severity, ref_id, reason, score), chr(10) ORDER BY pos, ref_id)) AS digest FROM iss GROUP BY answer_id")
def issue_report(spark, d):
    return citations.issue_report(issues(spark, d)).select("answer_id", F.md5("report").alias("digest"))


# Answers that cite 3 before 1, doubt 2 and name an unknown source.


def order_() -> Column:
    return F.concat(F.col("text"), F.lit(" [3] then [1] and [2·存疑] or [9], [3·存疑] again [1]"))


ORDER_SQL = "text || ' [3] then [1] and [2·存疑] or [9], [3·存疑] again [1]'"


@query("citation_extract", f"SELECT doc_id AS answer_id, unnest([1, 2, 3])::BIGINT AS n, unnest(['3', '1', '2']) AS ref_id FROM documents")
def citation_extract(spark, d):
    said = docs(spark, d).select(F.col("doc_id").alias("answer_id"), order_().alias("answer"))
    return citations.extract_citations(said, sources(spark, d)).select("answer_id", "n", "ref_id")


@query("citation_renumber", """SELECT doc_id AS answer_id, md5(text || ' [1] then [2] and [3·存疑] or [9], [1·存疑] again [2]') AS digest,
 chr(10) || '---' || chr(10) || '**引用来源：**' || chr(10) || '[1] 《' || source || '》' || c || '（引用存疑）' || chr(10) || '[2] 《' || source || '》' || c || chr(10) || '[3] 《' || source || '》' || c || '（引用存疑）' AS footer FROM (SELECT *, CASE WHEN lang = 'en' THEN '· chapter' ELSE '' END AS c FROM documents)""")
def citation_renumber(spark, d):
    said = docs(spark, d).select(F.col("doc_id").alias("answer_id"), order_().alias("answer"))
    return citations.renumber_citations(said, sources(spark, d)).select("answer_id", F.md5("answer").alias("digest"), "footer")


@query("strip_footer", "SELECT doc_id, " + trim_sql(r"CASE WHEN doc_id % 5 = 3 THEN text ELSE regexp_replace(text, '\*+\s*$', '') END") + " AS answer FROM documents")
def strip_footer(spark, d):
    tails = F.array(*[F.lit(x) for x in ("\n---\n**引用来源：**\n[1] 《a》", "\n来源：a\nb", "\n参考文献: x", " **", "")])
    return docs(spark, d).select("doc_id", tx.strip_footer(F.concat("text", F.element_at(tails, (F.col("doc_id") % 5 + 1).cast("int")))).alias("answer"))


# --- history and telemetry -----------------------------------------------------------------------

HISTORY_SQL = "h AS (SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, CASE role WHEN 'user' THEN 'human' ELSE 'ai' END AS role, text AS content, turn AS created_at FROM conversations WHERE role IN ('user', 'assistant'))"


def past(spark, d) -> DataFrame:
    return history.as_history(load(spark, d, "conversations"))


@query("history_roles", f"WITH {HISTORY_SQL} SELECT id, session_id, role FROM h")
def history_roles(spark, d):
    return past(spark, d).select("id", "session_id", "role")


@query("session_last_n", f"WITH {HISTORY_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS n FROM h QUALIFY n <= 4) SELECT id, session_id, role, content, row_number() OVER (PARTITION BY session_id ORDER BY n DESC) AS pos FROM k")
def session_last_n(spark, d):
    return history.last_n_messages(past(spark, d), 4).select("id", "session_id", "role", "content", "pos")


@query("rewrite_context", f"WITH {HISTORY_SQL}, w AS (SELECT *, coalesce(string_agg(CASE role WHEN 'human' THEN '用户' ELSE 'AI' END || '：' || left(content, 100), chr(10)) OVER (PARTITION BY session_id ORDER BY created_at, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM h) SELECT session_id, id, content, context FROM w WHERE role = 'human'")
def rewrite_context(spark, d):
    return history.turn_context(past(spark, d))


@query("session_stats", f"WITH {HISTORY_SQL} SELECT session_id, count(*) AS n_messages, count(*) FILTER (role = 'human') AS n_human, count(*) FILTER (role = 'ai') AS n_ai FROM h GROUP BY session_id")
def session_stats(spark, d):
    return history.session_stats(past(spark, d))


@query("history_append", """SELECT conv_id AS session_id, turn * 2 AS pos, 'human' AS role, text AS content FROM conversations WHERE role = 'user' UNION ALL
 SELECT a.conv_id, a.turn * 2 + 1, 'ai', b.text FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'""")
def history_append(spark, d):
    c = load(spark, d, "conversations")
    reply = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    turns = c.filter("role = 'user'").join(reply, ["conv_id", "turn"], "left").select(F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("question"), "answer")
    return history.append_turns(turns)


@query("telemetry_daily", "SELECT strftime(ts, '%Y%m%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def telemetry_daily(spark, d):
    return telemetry.telemetry_daily(load(spark, d, "events"))


@query("latency_rollup", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def latency_rollup(spark, d):
    return telemetry.latency_rollup(load(spark, d, "events"))


def usage(spark, d) -> DataFrame:
    return usage_of(load(spark, d, "events")).select("model", "prompt_tokens", "completion_tokens", F.col("user_id").alias("session_id"))


def usage_of(events: DataFrame) -> DataFrame:
    """Adds model, prompt_tokens, completion_tokens to a batch or stream of events."""
    k = F.get_json_object("props", "$.k").cast("long")
    model = F.when(F.col("event_type") == "click", "gpt-4").when(F.col("event_type") == "view", "deepseek-chat").otherwise(F.col("event_type"))
    return events.withColumns({"model": model, "prompt_tokens": k, "completion_tokens": F.when(F.col("event_type") != "error", k * 2)})


@query("token_cost_rollup", """SELECT model, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, round(sum((p * i + c * o) / 1000), 4) AS cost, count(DISTINCT user_id) AS n_sessions, floor((sum(p) + sum(c)) / greatest(count(DISTINCT user_id), 1))::BIGINT AS tokens_per_session FROM (
 SELECT user_id, CASE event_type WHEN 'click' THEN 'gpt-4' WHEN 'view' THEN 'deepseek-chat' ELSE event_type END AS model, coalesce(json_extract(props, '$.k')::BIGINT, 0) AS p, CASE WHEN event_type <> 'error' THEN coalesce(json_extract(props, '$.k')::BIGINT * 2, 0) ELSE 0 END AS c, CASE event_type WHEN 'click' THEN 0.03 WHEN 'view' THEN 0.001 ELSE 0.001 END::DOUBLE AS i, CASE event_type WHEN 'click' THEN 0.06 WHEN 'view' THEN 0.002 ELSE 0.002 END::DOUBLE AS o FROM events) GROUP BY model""")
def token_cost_rollup(spark, d):
    return telemetry.token_cost_rollup(usage(spark, d), telemetry.price_table(spark))


@query("load_test_summary", "SELECT event_type AS status, count(*) AS n, min(value) AS least, round(avg(value), 4) AS mean, max(value) AS most FROM events GROUP BY event_type")
def load_test_summary(spark, d):
    return telemetry.load_summary(load(spark, d, "events").select(F.col("value").alias("latency_ms"), F.col("event_type").alias("status")))
