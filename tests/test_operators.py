"""Rules of single operators on small frames, with the cases where they are easily got wrong."""

import math

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.functions import vectors as vf
from marginalia.operators import chunking, citations, evaluation, fusion, history, index, routing, structure
from marginalia.operators import vector_search as vs
from marginalia.plans import answer_queries
from marginalia.sources import files
from marginalia.streaming import jobs


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(("raw", "clean"), [
    ("甲乙\n丙。\n丁", "甲乙丙。\n丁"), ("王 洪 文！\nDeep Seek", "王洪文！\nDeep Seek"), ("  　a?\n\n\nb\n", "a?\nb"), ("", ""), ("“引。”\n下", "“引。”\n下"),
])
def test_broken_lines(spark, raw, clean):
    assert one(spark, raw, tx.join_broken_lines) == clean


@pytest.mark.parametrize(("raw", "clean"), [
    ("aRN(7)b", "ab"), ("RN(12))x", ")x"), ("pp《4y", "y"), ("@pub\nyear(Page#508)z", "z"), ("(Page#3)", ""), ("==== =====", "==== "), ("第十四章武装叛乱的失获485", ""),
    ("# 第二章 隋朝，581—617年", "# 第二章 隋朝，581—617年"), ("卷首语；a", "a"), ("a Document generated by ANNA'S Archive x\nb", "a \nb"), ("filename: q.zip!", "!"),
])
def test_noise(spark, raw, clean):
    assert one(spark, raw, tx.denoise) == clean


def test_text_functions(spark):
    assert one(spark, "a\n\n\n\nb\n", lambda c: tx.normalize_newlines(c, True)) == "a\n\nb"
    assert one(spark, "a\n\n\n\nb\n", tx.normalize_newlines) == "a\nb"
    assert one(spark, "# T\n\n\n\nx  \n12\ny", tx.markdown_tidy) == "# T\n\nx\ny"
    assert one(spark, "Ab 贞观二年 x1 王", tx.tokenize) == ["ab", "贞观", "观二", "二年", "x1", "王"]
    assert one(spark, "/a/b/Book.v1.EPUB", tx.doc_name) == "Book.v1" and one(spark, "/a/b/Book.v1.EPUB", tx.doc_ext) == ".epub"
    assert one(spark, ".hidden", tx.doc_name) == ".hidden"
    assert [one(spark, x, tx.page_number) for x in ("0", "7", "x", None)] == [1, 8, 1, 1]
    assert one(spark, "intro\n## 第一节\nx", tx.chapter_title) == "第一节" and one(spark, "a\nb\nc\nd\ne\n# f", tx.chapter_title) == ""
    assert one(spark, "<a> & 'b'", tx.xml_escape) == "&lt;a&gt; &amp; &#x27;b&#x27;"
    for tail in ("\n---\n**引用来源：**\n[1] 《a》", "\n来源：x", "引用来源: y\nz", "\n参考文献：q", " **"):
        assert one(spark, "答案[1]" + tail, tx.strip_footer) == "答案[1]"
    assert one(spark, "唐朝哪一年和谁", lambda c: tx.classify_query(c)["category"]) == "fact"
    assert one(spark, "x推翻y", tx.blocked) is True
    unit = one(spark, "a b a", vf.embed_hash)
    assert sum(x * x for x in unit) == pytest.approx(1, abs=1e-6) and set(one(spark, "", vf.embed_hash)) == {0.0}


def test_html():
    html = '<head><title>T</title><style>x{}</style></head><nav>no</nav><!-- ad --><h2>第一章</h2><p><b>bold<br>next<p>第三卷<ul><li>one &amp; two<li>three</ul><blockquote>q</blockquote><script>var t="</p>"</script>'
    got = structure.markdown_of(html)
    assert "no" not in got.split() and "ad" not in got.split() and "var" not in got
    assert "## 第一章" in got and "# 第三卷" in got and "**bold\nnext**" in got and "- one & two" in got and "> q" in got
    assert structure.markdown_of(None) == ""


def test_splitters(spark):
    text = "".join(chr(97 + i % 26) for i in range(401))
    df = spark.createDataFrame([(1, text), (2, "ab"), (3, "")], "id long, text string")
    rows = chunking.split_chars(df).collect()
    cut = [r["chunk_text"] for r in sorted(rows, key=lambda r: r["chunk_index"]) if r["id"] == 1]
    assert cut[0] == text[:150] and "".join([cut[0], *(c[30:] for c in cut[1:])]) == text and {r["id"] for r in rows} == {1, 2}
    long = spark.createDataFrame([(1, "\n\n".join("word " * k for k in (3, 80, 400, 1)))], "id long, text string")
    parts = sorted(chunking.split_recursive(long, "id", 200, 40).collect(), key=lambda r: r["chunk_index"])
    whole = long.first()["text"]
    assert all(len(r["chunk_text"]) <= 200 and whole[r["start"] :].startswith(r["chunk_text"]) for r in parts)
    assert parts[0]["start"] == 0 and all(b["start"] <= a["start"] + len(a["chunk_text"]) for a, b in zip(parts, parts[1:], strict=False))
    assert parts[-1]["start"] + len(parts[-1]["chunk_text"]) == len(whole)
    lines = chunking.split_lines(spark.createDataFrame([("aa\nbb\ncccccccc\nd",)], "text string"), 5).collect()
    assert [r["chunk_text"] for r in lines] == ["aa\nbb", "cccccccc", "d"]


def test_parents(spark):
    body = "x" * 200
    md = f"before {body}\n# A\n## same\n{body}\n## short\nx\n# B\n## same\n{body}\n### deep"
    parents = chunking.heading_paths(chunking.split_parents(spark.createDataFrame([(1, md)], "id long, text string"), "id"), "id").orderBy("section").collect()
    assert [(r["heading"], r["heading_level"], r["path"]) for r in parents] == [("开篇", 0, "开篇"), ("A", 1, "A"), ("same", 2, "A > same"), ("B", 1, "B"), ("same", 2, "B > same")]
    assert parents[-1]["content"].endswith("### deep")


def test_enrich_and_dedup(spark):
    df = spark.createDataFrame([("d", 0, "t", "", 3), ("d", 1, "t", "", 3), ("e", 0, "t", "h", None)], "doc_name string, chunk_index int, chunk_text string, contextual_header string, doc_page int")
    rows = chunking.dedup_chunks(chunking.enrich_chunks(df)).orderBy("doc_name").collect()
    assert [(r["doc_name"], r["enriched"]) for r in rows] == [("d", "【来源：《d》第3页】\nt"), ("e", "h\nt")]


def test_faq_sources(spark, tmp_path):
    (tmp_path / "faq.jsonl").write_text('{"query":"q","pos":["a","b"],"neg":[]}\n\n{bad\n{"question":"x","answer":"y","metadata":{"category":"c"}}\n')
    good, bad = files.load_faq_jsonl(spark, str(tmp_path / "faq.jsonl"))
    assert sorted((r["question"], r["answer"], r["category"]) for r in files.merge_faq_shapes(good).collect()) == [("q", "a", "general"), ("x", "y", "c")]
    assert [r["line"] for r in bad.collect()] == ["{bad"]
    (tmp_path / "rules.json").write_text('{"replacements":[{"old":"a","new":"b"},{"old":"","new":"x"}]}')
    assert [(r["old"], r["new"]) for r in files.load_corrections(spark, str(tmp_path / "rules.json")).collect()] == [("a", "b")]
    folder = tmp_path / "books"
    folder.mkdir()
    (folder / "a.TXT").write_text("no")
    (folder / "b.md").write_text("x\ny")
    assert [(r["doc_name"], r["ext"], r["text"]) for r in files.scan_corpus(spark, str(folder)).collect()] == [("b", ".md", "x\ny")]


def test_refresh_and_upsert(spark, tmp_path):
    path = str(tmp_path / "corpus")
    new = lambda *rows: spark.createDataFrame(rows, "doc_name string, chunk_text string")
    files.overwrite_corpus(new(("a", "1"), ("b", "1"), ("c", "1")), path, 3)
    files.replace_buckets(spark, new(("b", "2"), ("d", "2")), path, 3)
    assert sorted((r[0], r[1]) for r in spark.read.parquet(path).select("doc_name", "chunk_text").collect()) == [("a", "1"), ("b", "2"), ("c", "1"), ("d", "2")]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "b d e f"), (4, None)], "id long, text string")
    built = index.build_bm25(docs)
    idf = {r["term"]: r["idf"] for r in index.idf_table(built).collect()}
    raw = {t: math.log(4 - n + 0.5) - math.log(n + 0.5) for t, n in {"a": 1, "b": 3, "c": 1, "d": 1, "e": 1, "f": 1}.items()}
    assert idf["b"] == pytest.approx(0.25 * sum(raw.values()) / 6) and idf["a"] == pytest.approx(raw["a"])
    got = index.bm25_topk(spark.createDataFrame([(7, "a a b")], "query_id long, text string"), built, k=5).collect()
    avg = 9 / 4
    want = 2 * idf["a"] * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg)) + idf["b"] * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / avg))
    assert got[0]["id"] == 1 and got[0]["score"] == pytest.approx(want, abs=1e-6)
    changed = index.update_bm25(built, docs.filter("id = 2"), spark.createDataFrame([(2, "c c z"), (5, "a")], "id long, text string"))
    again = index.build_bm25(spark.createDataFrame([(1, "a b a"), (2, "c c z"), (3, "b d e f"), (4, None), (5, "a")], "id long, text string"))
    for name in ("postings", "terms", "stats"):
        x, y = getattr(changed, name), getattr(again, name)
        assert sorted(map(tuple, x.select(sorted(x.columns)).collect())) == sorted(map(tuple, y.select(sorted(y.columns)).collect()))


def test_lsh_recall(spark, small):
    from marginalia.plans.answer_queries import vectors

    q, v = vectors(spark, small)
    recall = vs.recall_at_k(vs.vector_topk_lsh(q, v, 10), vs.vector_topk(q, v, 10)).agg(F.avg("recall")).first()[0]
    assert recall >= 0.9
    sliced = vs.vector_topk(q, v, 3, most_values=200)
    assert sorted(map(tuple, sliced.collect())) == sorted(map(tuple, vs.vector_topk(q, v, 3).collect()))


def leg(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id long, id long, score double")


def test_fusion(spark):
    a, b = leg(spark, (1, 10, 0.9), (1, 11, 0.5), (1, 12, 0.5)), leg(spark, (1, 11, 3.0), (2, 20, 1.0))
    got = {(r["query_id"], r["id"]): r for r in fusion.rrf_fuse(a, b, top=5).collect()}
    assert got[1, 11]["score"] == pytest.approx(1 / 62 + 1 / 61) and got[1, 10]["score"] == pytest.approx(1 / 61 + 1 / 70) and got[1, 10]["rank_b"] == 2
    assert got[2, 20]["score"] == pytest.approx(1 / 70 + 1 / 61) and got[2, 20]["rank_a"] == 1
    tail = {r["id"]: r for r in fusion.rrf_fuse(a, b, missing_rank="tail").collect()}
    assert tail[10]["score"] == pytest.approx(1 / 61 + 1 / 62) and tail[10]["rank_b"] == -1
    assert {r["id"]: r["score"] for r in fusion.linear_fuse(a, b).collect()} == {10: 0.7, 11: 0.0, 12: 0.0, 20: 0.0}  # one equal score: range 1
    assert [r["id"] for r in fusion.interleave(a, b).filter("query_id = 1").orderBy("rank").collect()] == [10, 11, 12]


def test_routing(spark):
    q = spark.createDataFrame([(i,) for i in range(5)], "query_id long")
    faq = leg(spark, (0, 1, 0.85), (1, 1, 0.849), (2, 1, 0.62), (3, 1, 0.619), (4, 1, 1.2), (4, 2, -0.1))
    doc = leg(spark, (1, 7, 0.03), (3, 8, 0.02))
    r = {x["query_id"]: x for x in routing.route(q, faq, doc).collect()}
    assert [r[i]["route"] for i in range(5)] == ["FAQ_ONLY", "HYBRID", "HYBRID", "DOC_ONLY", "DOC_ONLY"]
    assert r[3]["confidence"] == 0.02 and r[3]["faq"] == [] and r[0]["doc"] == [] and r[4]["confidence"] == 0
    assert {x["query_id"]: x["route"] for x in routing.route(q, faq, doc, high=0.9, use_low=False).collect()}[3] == "HYBRID"


ANSWER = "李靖于贞观四年击败东突厥 [1]。另有 abc [2]！无据 [9]。"


def test_citations(spark):
    answers = spark.createDataFrame([(1, ANSWER), (2, "none")], "answer_id long, answer string")
    sources = spark.createDataFrame([(1, 1, "《唐太宗传》(新版)", "第一节", "完全无关的文字，谈论别的人物、别的地方与别的事情，没有任何对应。"), (1, 2, "b", "", "short"), (1, 3, "c", "", "李靖于贞观四年击败东突厥，这是史书的记载，见于多种资料之中，可以查证。")], "answer_id long, ref_id long, doc_name string, chapter_title string, content string")
    issues = {r["ref_id"]: r for r in citations.verify_citations(answers, sources).collect()}
    assert (issues["1"]["severity"], issues["2"]["reason"], issues["9"]["reason"]) == ("CRITICAL", "short", "unknown")
    found = citations.verify_citations(answers, sources)
    fixed = citations.repair_citations(answers, sources, found)
    assert ("1", "3") in [(r["ref_id"], r["new_id"]) for r in fixed.collect()]
    clean = {r["answer_id"]: r["answer"] for r in citations.sanitize_answers(answers, found, fixed).collect()}
    assert "[3]" in clean[1] and "[2·存疑]" in clean[1] and "[9]" not in clean[1] and clean[2] == "none"
    swapped = spark.createDataFrame([(1, "x [2] y [1] z [2·存疑] [7]")], "answer_id long, answer string")
    out = citations.renumber_citations(swapped, sources).first()
    assert out["answer"] == "x [1] y [2] z [1·存疑] [7]"
    assert out["footer"].split("\n")[-2:] == ["[1] 《b》（引用存疑）", "[2] 《唐太宗传》· 第一节"]


def test_history_and_tail(spark, tmp_path):
    rows = [(i, i % 2, "human" if i % 3 else "ai", f"m{i}", i // 2 * 0 + (5 if i in (4, 6) else i)) for i in range(20)]
    schema = "id long, session_id long, role string, content string, created_at long"
    batch = history.last_n_messages(spark.createDataFrame(rows, schema), 4)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[10:], rows[:10]):  # late rows come second
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.with_batch(jobs.tail_sessions(stream, 4), out, str(tmp_path / "check")).awaitTermination()
    last = jobs.last_state(spark.read.parquet(out))
    assert sorted((r["session_id"], r["pos"], r["id"]) for r in last.collect()) == sorted((r["session_id"], r["pos"], r["id"]) for r in batch.collect())


def test_ingest_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "store")
    put = lambda *rows: spark.createDataFrame(rows, "doc_name string, ext string, text string").coalesce(1).write.mode("append").parquet(source)
    split = lambda df: chunking.split_chars(df, 10, 2)
    run = lambda: jobs.ingest_stream(spark.readStream.schema("doc_name string, ext string, text string").parquet(source), path, str(tmp_path / "check"), split).awaitTermination()
    put(("a", ".txt", "one two three four"), ("a", ".md", "other"), ("e", ".txt", ""))
    run()
    run()  # nothing new
    put(("a", ".txt", "five six"), ("a", ".md", "other"))
    run()
    store = jobs.Versions(spark, path)
    corpus = sorted((r["doc_name"], r["ext"], r["chunk_text"]) for r in store.read("corpus", jobs.CORPUS).collect())
    assert corpus == [("a", ".md", "other"), ("a", ".txt", "five six")]
    assert store.read("seen", jobs.SEEN).count() == 3
    again = index.build_bm25(spark.createDataFrame([("a.txt", "five six"), ("a.md", "other")], "id string, text string"))
    assert sorted(map(tuple, store.read("terms", jobs.TERMS).collect())) == sorted(map(tuple, again.terms.collect()))


def test_ingest_stream_over_two_checkpoints(spark, tmp_path):
    """A new checkpoint starts its batches at 0 again; its update is seen all the same, and a batch is applied once."""
    path, schema = str(tmp_path / "store"), "doc_name string, ext string, text string"
    split = lambda df: chunking.split_chars(df, 10, 2)
    for k, names in enumerate((["a", "b"], ["c"])):
        for n in names:
            spark.createDataFrame([(n, ".txt", f"text of {n}")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in{k}"))
        jobs.ingest_stream(stream, path, str(tmp_path / f"check{k}"), split).awaitTermination()
    store = jobs.Versions(spark, path)
    assert {r["doc_name"] for r in store.read("seen", jobs.SEEN).collect()} == {"a", "b", "c"}
    assert store.applied(str(tmp_path / "check1"), 0) and not store.applied(str(tmp_path / "check1"), 1)


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 9, 1)], "query_id long, id long, rank long")
    relevant = spark.createDataFrame([(1, 6), (1, 8), (3, 1)], "query_id long, id long")
    r = evaluation.evaluate_retrieval(hits, relevant, 5).first()
    assert (r["n_queries"], r["precision"], r["recall"], r["hit_rate"], r["mrr"]) == (2, 0.25, 0.25, 0.5, 0.25)


def test_batched_embed(spark):
    from marginalia.operators.embedding import batched_embed

    def load():
        def model(texts):
            if any("bad" in t for t in texts):
                raise ValueError
            return [[len(t), 1] for t in texts]

        return model

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "four")], "id long, text string").coalesce(1)
    assert {r["id"]: r["chunk_vector"] for r in batched_embed(df, "text", load, 3).collect()} == {1: [1, 1], 2: None, 3: None, 4: [4, 1]}


def test_sinks(spark, tmp_path):
    faq = spark.createDataFrame([("问?", "答", "book")], "question string, answer string, source_doc string")
    files.write_faq_jsonl(faq, str(tmp_path / "faq"))
    assert "问?" in spark.read.text(str(tmp_path / "faq")).first()[0]
    assert [r["source_doc"] for r in files.merge_faq_shapes(files.load_faq_jsonl(spark, str(tmp_path / "faq"))[0]).collect()] == ["book"]
    events = spark.createDataFrame([("2024-01-02 03:04:05", "x"), ("2024-01-03 00:00:00", "y")], "timestamp string, event_type string")
    files.append_telemetry(events, str(tmp_path / "log"))
    files.append_telemetry(events, str(tmp_path / "log"))
    assert sorted((r["day"], r["count"]) for r in spark.read.json(str(tmp_path / "log")).groupBy("day").count().collect()) == [(20240102, 2), (20240103, 2)]


def test_containing(spark):
    """Documents that hold a passage, against a plain search: passages at the borders, over line breaks, short, empty, inside words."""
    bodies = [(1, "a b c d e f g"), (2, "xa b c d ey"), (3, "a b\nc d e f"), (4, "a  b c d e"), (5, ""), (6, None), (7, "c d"), (8, "a b c d e a b c d e"), (9, "é b c d é")]
    asked = [(1, "a b c d e"), (2, "c d"), (3, "b\nc d e f"), (4, ""), (5, None), (6, "a  b c d"), (7, "b c d e f g h"), (8, "é b c d é")]
    got = evaluation.containing(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(bodies, "id long, body string")).collect()
    assert sorted(map(tuple, got)) == [(q, i) for q, t in asked for i, b in bodies if t is not None and b is not None and t in b]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_verified_rows_carry_no_source_text(spark, small):
    """What is asked of a source's text is asked once, below the step that makes rows of the sentences that cite it."""
    plan = _plan(answer_queries.issues(spark, small)).split("\n")
    rows = next(k for k, line in enumerate(plan) if "Generate explode(" in line)
    assert not any("content" in line for line in plan[:rows]) and "content" in "".join(plan[rows:])


def test_repair_reads_each_source_once(spark, small):
    """A share is computed once, and first sentences are found before the join with critical ids."""
    issues = spark.createDataFrame([(1, "4", "CRITICAL")], "answer_id long, ref_id string, severity string")
    plan = _plan(citations.repair_citations(answer_queries.answers(spark, small), answer_queries.sources(spark, small), issues))
    assert plan.count("filter(terms") == 1
    assert plan.index("LeftSemi" if "LeftSemi" in plan else "Join Inner, ((answer_id") < plan.index("min_by(")


def test_sanitize_finds_issues_once(spark, small):
    """The issues are kept; of the plan that remains, only the repair cuts answers into sentences."""
    assert _plan(answer_queries.citation_sanitize(spark, small)).count("posexplode(split(answer") == 1
