"""Segment tables, the stored index and the ingest that writes them."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import chunking, index
from marginalia.operators.stored_index import StoredIndex
from marginalia.streaming import jobs

ROWS = [(1, "a b a"), (2, "b c"), (3, "b d e f"), (4, None), (5, ""), (None, "a z")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same_index(store, docs):
    want, got = index.build_bm25(docs), store.index()
    assert rows_of(got.postings) == rows_of(want.postings.select("term", "id", "tf", "dl"))
    assert rows_of(got.terms) == rows_of(want.terms)
    assert rows_of(got.stats) == rows_of(want.stats)
    q = docs.sparkSession.createDataFrame([(7, "a a b"), (8, "z"), (9, None), (10, "nowhere")], "query_id long, text string")
    assert rows_of(store.topk(q, 3)) == rows_of(index.bm25_topk(q, want, k=3))


def test_changes_equal_a_rebuild(spark, tmp_path):
    store = StoredIndex(spark, str(tmp_path / "index"), buckets=2)
    assert rows_of(store.topk(spark.createDataFrame([(1, "a")], "query_id long, text string"))) == []
    store.add(frame(spark, ROWS))
    same_index(store, frame(spark, ROWS))
    store.add(frame(spark, [(2, "x"), (9, "a")]), gone=frame(spark, [(3, ""), (None, ""), (77, "")]).select("id"))
    now = frame(spark, [(1, "a b a"), (2, "x"), (4, None), (5, ""), (9, "a")])
    same_index(store, now)
    store.add(frame(spark, [(2, "b c")]))
    now = frame(spark, [(1, "a b a"), (2, "b c"), (4, None), (5, ""), (9, "a")])
    same_index(store, now)
    assert len(store.lines) == 3
    store.compact()
    assert len(store.lines) == 1 and store.facts["n_dead"] == 0
    same_index(store, now)
    store.vacuum()
    same_index(StoredIndex(spark.newSession(), str(tmp_path / "index")), now)


def test_unnamed_files_do_not_count(spark, tmp_path):
    """A change that dies before its line is in the log leaves files that nobody reads; the change can be made again."""

    class Dies(StoredIndex):
        def commit(self, *a, **b):
            raise OSError("lost")

    path = str(tmp_path / "index")
    StoredIndex(spark, path, buckets=2).add(frame(spark, ROWS))
    with pytest.raises(OSError):
        Dies(spark, path).add(frame(spark, [(1, "changed"), (8, "new")]))
    store = StoredIndex(spark, path)
    same_index(store, frame(spark, ROWS))
    store.add(frame(spark, [(1, "changed"), (8, "new")]))
    now = frame(spark, [(1, "changed"), (8, "new"), *ROWS[1:]])
    same_index(store, now)
    store.vacuum()
    same_index(store, now)
    assert len(list((tmp_path / "index" / "g0" / "postings").glob("seq=*"))) == 2


def test_compaction_by_itself(spark, tmp_path):
    store = StoredIndex(spark, str(tmp_path / "index"), buckets=2, most_segments=3)
    for k in range(5):
        store.add(frame(spark, [(k, f"t{k} a"), (0, f"again {k}")]) if k else frame(spark, [(0, "first")]))
    assert len(store.lines) <= 3
    same_index(store, frame(spark, [(0, "again 4"), *[(k, f"t{k} a") for k in range(1, 5)]]))


def test_search_reads_postings_without_exchange(spark, tmp_path):
    store = StoredIndex(spark, str(tmp_path / "index"), buckets=3)
    for k in range(3):
        store.add(frame(spark, [(k, f"a b t{k}"), (k + 10, "a")]))
    q = spark.createDataFrame([(1, "a t1")], "query_id long, text string")
    plan = store.score(q)._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "FileScan" in line and "[term" in line and "tf#" in line)
    depth = plan[at].index("FileScan")
    above = [line for line in plan[:at] if not line[: min(depth, len(line))].strip(" :+-|*()0123456789")]
    assert any("Join" in line for line in plan[:at])
    joins = [i for i in range(at) if "Join" in plan[i]]
    assert not any("Exchange" in plan[i] for i in range(joins[-1], at)), above
    # With no broadcast the bucketed sides meet in place: the terms are dealt, the postings are not.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        terms = spark.createDataFrame([("a",), ("t1",)], "term string")
        plan = store.table("postings").join(terms, "term")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_ingest_replaces_in_segments(spark, tmp_path):
    """A stream's second run changes one document, empties one, adds one; corpus, hashes and index follow in one small segment."""
    schema = "doc_name string, ext string, text string"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    split = lambda df: chunking.split_chars(df, 12, 2)
    tidy = lambda df: df.withColumn("text", F.trim("text"))
    run = lambda: jobs.ingest_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "check"), split, tidy).awaitTermination()
    put(("a", ".txt", "  one two three four five"), ("b", ".txt", "six"), ("c", ".txt", "seven"))
    run()
    put(("a", ".txt", "eight  "), ("b", ".txt", " "), ("d", ".md", "nine"), ("c", ".txt", "seven"))
    run()
    store = jobs.Versions(spark, str(tmp_path / "store"))
    assert len(store.lines) == 2
    assert rows_of(store.read("corpus", jobs.CORPUS)) == [("a", ".txt", 0, "eight"), ("c", ".txt", 0, "seven"), ("d", ".md", 0, "nine")]
    assert {r["doc_name"] for r in store.read("seen", jobs.SEEN).collect()} == set("abcd")
    second = store.lines[1]["seq"]
    assert rows_of(store.table("seen", [second]).select("doc_name")) == [("a",), ("b",), ("d",)]
    want = index.build_bm25(spark.createDataFrame([("a.txt", "eight"), ("c.txt", "seven"), ("d.md", "nine")], "id string, text string"))
    assert rows_of(store.read("terms", jobs.TERMS)) == rows_of(want.terms)
    assert rows_of(store.read("postings", jobs.POSTINGS)) == rows_of(want.postings.select("term", "id", "tf", "dl"))
    store.compact()
    assert rows_of(store.read("corpus", jobs.CORPUS)) == [("a", ".txt", 0, "eight"), ("c", ".txt", 0, "seven"), ("d", ".md", 0, "nine")]
    assert store.applied(str(tmp_path / "check"), 0) and not store.applied(str(tmp_path / "other"), 0)


def test_search_by_document(spark, tmp_path, monkeypatch):
    """The best of a task equal the best of all scores, in small blocks, with any floor, many segments and a null id; no score is shuffled but the best."""
    import numpy as np
    from pyspark.sql import functions as F

    from marginalia.operators import index, stored_index

    rng = np.random.default_rng(4)
    texts = [(i if i else None, " ".join(f"w{x}" for x in rng.zipf(1.5, rng.integers(0, 60)) if x < 400)) for i in range(300)]
    df = spark.createDataFrame(texts, "id long, text string")
    queries = spark.createDataFrame([(f"q{i}", " ".join(f"w{x}" for x in rng.integers(1, 60, 8)) + " w1 w1") for i in range(9)] + [("none", "zzz"), ("no text", None)], "query_id string, text string")
    store = stored_index.StoredIndex(spark, f"file://{tmp_path}/by-document", buckets=3)
    store.add(df)
    for block, floor in ((1 << 21, 0.1), (40, 0.1), (40, -9.0)):
        monkeypatch.setattr(stored_index, "BLOCK", block)
        found = store.topk(queries, 7, floor)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "keys=[query_id" not in plan.split("MapInArrow")[0]
        want = index.best(store.score(queries).filter(F.col("score") >= floor), 7)
        key = lambda r: (r["query_id"], r["id"], round(r["score"], 5), r["rank"])
        assert sorted(map(key, found.collect()), key=repr) == sorted(map(key, want.collect()), key=repr)
        store.add(df.filter("id % 3 = 1").withColumn("text", F.concat("text", F.lit(" w2 w3"))), df.filter("id % 7 = 2").select("id"))


def test_all_terms_by_the_rarest(spark):
    """Only documents with the rarest term of a query meet its other terms; an unknown term leaves nothing, a null id is an id."""
    from marginalia.operators import index

    texts = [(i if i else None, "a b" + " c" * (i % 2) + (" d" if i % 10 == 0 else "")) for i in range(60)]
    built = index.build_bm25(spark.createDataFrame(texts, "id long, text string"))
    queries = spark.createDataFrame([(1, "a d"), (2, "b c a a"), (3, "a x"), (4, "")], "query_id long, text string")
    found = index.fulltext_and(queries, built, 50)
    assert "_term" in found._jdf.queryExecution().executedPlan().toString()
    got = {q: [r["id"] for r in sorted((r for r in found.collect() if r["query_id"] == q), key=lambda r: r["rank"])] for q in (1, 2, 3, 4)}
    assert got == {1: [None, 10, 20, 30, 40, 50], 2: list(range(1, 60, 2)), 3: [], 4: []}


def test_streams_have_as_many_buckets_as_shuffles(spark, tmp_path):
    from marginalia.streaming import jobs

    assert jobs.Versions(spark, f"file://{tmp_path}/versions").buckets == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_ingest_leaves_no_shuffles(spark, tmp_path):
    """Texts are dealt once, nothing is cached, and a job's shuffles are gone when it ends; of several rows of a document that with the smallest hash counts."""
    import hashlib
    import time
    from pathlib import Path

    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffles = lambda: {f: f.stat().st_size for d in dirs for f in Path(d).rglob("shuffle_*.data")}
    text = lambda i: " ".join(hashlib.md5(f"{i} {k}".encode()).hexdigest() for k in range(120))
    schema = "doc_name string, ext string, text string"
    rows = [(f"d{i}", ".txt", text(i)) for i in range(200)] + [("d3", ".txt", "another"), ("d4", ".txt", None), ("d5", ".txt", text(5)), (None, ".txt", "no name")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    there = shuffles()
    split = lambda df: chunking.split_chars(df, 800, 100)
    jobs.ingest_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "check"), split).awaitTermination()
    for _ in range(50):
        if not (left := {f: n for f, n in shuffles().items() if f not in there}):
            break
        time.sleep(0.2)
    assert sum(left.values()) < 0.05 * sum(len(r[2] or "") for r in rows)
    store = jobs.Versions(spark, str(tmp_path / "store"))
    seen = {(r["doc_name"], r["hash"]) for r in store.read("seen", jobs.SEEN).collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert len(seen) == 201 and {("d3", min(md5(text(3)), md5("another"))), ("d4", None), ("d5", md5(text(5))), (None, md5("no name"))} <= seen
    third = {r["chunk_text"] for r in store.read("corpus", jobs.CORPUS).filter("doc_name = 'd3'").collect()}
    assert third == ({"another"} if md5("another") < md5(text(3)) else {r["chunk_text"] for r in split(spark.createDataFrame(rows[3:4], schema)).collect()})


def test_postings_in_parts(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    from marginalia.operators import stored_index

    monkeypatch.setattr(stored_index, "PART_TOKENS", 4)
    store = StoredIndex(spark, str(tmp_path / "index"), buckets=2)
    store.add(frame(spark, ROWS))
    same_index(store, frame(spark, ROWS))
    store.add(frame(spark, [(2, "x b c d e f g h"), (9, "a")]), gone=frame(spark, [(None, "")]).select("id"))
    same_index(store, frame(spark, [(2, "x b c d e f g h"), (9, "a"), *[r for r in ROWS if r[0] not in (2, None)]]))
    found = list((tmp_path / "index" / "g0" / "postings").glob("seq=*/*.parquet"))
    assert len(found) > 4
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in found} == {"ZSTD"}
