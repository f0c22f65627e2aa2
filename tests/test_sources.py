"""Replacement on disk with recovery, cutting in linear time, counts of cleaning rules, file sources."""

import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.operators import chunking, structure
from marginalia.sources import files

DOC = "doc_name string, chunk_text string"


def corpus(spark, path):
    return sorted((r["doc_name"], r["chunk_text"]) for r in files.read_buckets(spark, path).collect())


def test_replace_recovers(spark, tmp_path, monkeypatch):
    """A change that dies before its mark changed nothing; one that dies after it is read from its staging and finished by the next."""
    path = str(tmp_path / "corpus")
    new = lambda *rows: spark.createDataFrame(rows, DOC)
    files.overwrite_corpus(new(("a", "1"), ("b", "1"), ("c", "1")), path, 3)
    real = files.recover_buckets
    calls = []

    def dies(s, p):
        calls.append(p)
        if len(calls) % 2 == 0:  # the first call of a change finds nothing to do; the second comes after the mark
            raise OSError("lost")
        real(s, p)

    monkeypatch.setattr(files, "recover_buckets", dies)
    with pytest.raises(OSError):
        files.replace_buckets(spark, new(("b", "2"), ("d", "2")), path, 3)
    monkeypatch.undo()
    want = [("a", "1"), ("b", "2"), ("c", "1"), ("d", "2")]
    assert corpus(spark, path) == want  # from the staging
    assert ("b", "1") in [(r["doc_name"], r["chunk_text"]) for r in spark.read.parquet(path).collect()]
    files.replace_buckets(spark, new(("c", "3")), path, 3, names=new(("a", "")))
    assert corpus(spark, path) == [("b", "2"), ("c", "3"), ("d", "2")]
    assert not (tmp_path / "corpus" / "_staged").exists() and not (tmp_path / "corpus" / "_replace").exists()
    (tmp_path / "corpus" / "_staged" / "x").mkdir(parents=True)
    files.recover_buckets(spark, path)
    assert corpus(spark, path) == [("b", "2"), ("c", "3"), ("d", "2")] and not (tmp_path / "corpus" / "_staged").exists()


@pytest.mark.parametrize("size, overlap", [(10, 3), (10, 0), (7, 6), (100, 99), (1, 0), (12, 8)])
def test_windows_by_units(spark, size, overlap):
    texts = ["", None, "a", "abcdefghij", "abcdefghijk", "é\n😀" * 40, "x" * 250]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    step = size - overlap
    last = lambda n: max(0, -(-(n - size) // step))
    got = sorted((r["id"], r["chunk_index"], r["chunk_text"]) for r in chunking.split_chars(df, size, overlap).collect())
    assert got == [(i, k, t[k * step : k * step + size]) for i, t in enumerate(texts) if t for k in range(last(len(t)) + 1)]
    words = [" ".join(f"w{k}" for k in range(n)) for n in (0, 1, 9, 10, 11, 57)]
    df = spark.createDataFrame(list(enumerate(words)), "id long, text string")
    got = sorted((r["id"], r["chunk_index"], r["chunk_text"]) for r in chunking.split_tokens(df, size, overlap).collect())
    assert got == [(i, k, " ".join(t.split()[k * step : k * step + size])) for i, t in enumerate(words) if t for k in range(last(len(t.split())) + 1)]


def test_long_text_is_cut_in_linear_time(spark):
    took = []
    for n in (1, 10):
        df = spark.range(1).select("id", F.repeat(F.lit("lorem ipsum é dolor "), n * 100_000).alias("text"))
        begin = time.time()
        cut = chunking.split_chars(df, 800, 100).agg(F.count("*"), F.sum(F.length("chunk_text"))).first()
        tokens = chunking.split_tokens(df, 512, 128, tokenizer=tx.latin_tokens).agg(F.count("*")).first()[0]
        took.append(time.time() - begin)
        assert cut[0] == -(-(n * 2_000_000 - 800) // 700) + 1 and tokens == -(-(n * 400_000 - 512) // 384) + 1
    assert took[1] < 40 * max(took[0], 0.5)
    plan = chunking.split_chars(df, 800, 100).select("id", "chunk_text")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" in plan and "[text#" not in plan.split("Generate")[0]


def test_rule_hits_in_the_same_pass(spark, tmp_path):
    df = spark.createDataFrame([(1, "RN(7) the end the. ===== RN(8)"), (2, "nothing"), (3, None)], "id long, text string")
    cleaned = tx.cleaned_with_hits(df, is_markdown=True, rules=[("the ", "THE "), ("", "x")])
    want = [r["clean"] for r in df.select("id", tx.clean_text(F.col("text"), True, [("the ", "THE ")]).alias("clean")).orderBy("id").collect()]
    assert [r["clean"] for r in cleaned.orderBy("id").collect()] == want
    hits = {r["rule"]: (r["hits"], r["n_docs"]) for r in tx.rule_hits(cleaned).collect()}
    assert hits["noise_00"] == (2, 1) and hits["correction_00"] == (1, 1) and hits["noise_05"] == (1, 1) and hits["noise_01"] == (0, 0)
    # The counts can ride on the write itself: one scan, one pass.
    seen = Observation("cleaning")
    total = F.sum(F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h.hits)).alias("hits")
    cleaned.observe(seen, total, F.count("*").alias("n")).select("id", "clean").write.parquet(str(tmp_path / "out"))
    assert seen.get == {"hits": 4, "n": 3}
    assert tx.rule_hits(cleaned)._jdf.queryExecution().executedPlan().toString().count("Scan ") == 1


def test_rule_hits_search_each_text_once(spark):
    """Each rule searches a text once, and nothing below the count of hits cleans it for a filter."""
    df = spark.createDataFrame([("RN(7) and RN(8) x\n@a (Page#2)====== b",), (None,), ("",)], "text string").repartition(2)
    found = tx.rule_hits(tx.cleaned_with_hits(df))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(tx.NOISE[0]) == 1 and plan.count("={5,}") == 1
    hits = {r["rule"]: (r["hits"], r["n_docs"]) for r in found.collect()}
    assert (hits["noise_00"], hits["noise_03"], hits["noise_05"], hits["noise_10"]) == ((2, 1), (1, 1), (1, 1), (0, 0)) and len(hits) == len(tx.NOISE)


def test_indented_headings_and_document_ordinals(spark):
    body = "word " * 300
    df = spark.createDataFrame([(1, "d", f"open {body}\n  # A\n{body}\n\t## B\n{body}")], "id long, doc string, text string")
    assert [(r["heading"], r["heading_level"]) for r in chunking.split_parents(df, "id").orderBy("section").collect()] == [("开篇", 0), ("A", 1), ("B", 2)]
    got = sorted((r["section"], r["chunk_index"]) for r in chunking.split_pdr(df, "id", "doc", 128, 32).collect())
    assert [k for _, k in got] == list(range(len(got))) and len({s for s, _ in got}) == 3


def test_quality_counts_files(spark):
    df = spark.createDataFrame([("x" * 10, ["a.html", "b.XHTML", "c.png", "d.JPEG", "e.css"]), ("y", None)], "text string, names array<string>")
    got = structure.document_quality(df, files="names", scan_images=1, scan_chars=100).collect()
    assert [(r["n_html"], r["n_images"], r["reason"]) for r in got] == [(2, 2, "scan"), (0, 0, "short")]


def test_scan_takes_suffixes_and_paths(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("1\n2\n")
    (tmp_path / "y.md").write_text("")
    (tmp_path / "z.json").write_text("{}")
    got = sorted((r["doc_name"], r["ext"], r["text"], r["path"].endswith("a/x.txt")) for r in files.scan_corpus(spark, str(tmp_path)).collect())
    assert got == [("x", ".txt", "1\n2\n", True), ("y", ".md", "", False)] or got == [("x", ".txt", "1\n2\n", True)]  # Spark gives no row for an empty file


def test_backfill_in_batches(spark):
    def load():
        def model(texts):
            if "bad" in texts:
                raise ValueError
            return [[len(t)] for t in texts]

        return model

    df = spark.createDataFrame([(1, "aa", None), (2, "bad", None), (3, "ccc", [9.0]), (4, None, None), (5, "d", None)], "id long, text string, chunk_vector array<float>").coalesce(1)
    assert {r["id"]: r["chunk_vector"] for r in files.backfill_batched(df, "text", load).collect()} == {1: [2.0], 3: [9.0], 5: [1.0]}
