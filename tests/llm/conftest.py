import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash long, row string, line string, score double, found int, key string, block int"
WORDS = {"en": "the of and to in that for with was is on as by this from have not are which were".split(), "fr": "le la les des une que qui dans pour avec sur est pas mais nous vous être était éan çe".split()}


def sentence(rng, lang, n):
    base = WORDS[lang]
    return " ".join(rng.choice(base) if rng.random() < 0.5 else "".join(rng.choice(base) for _ in range(2)) for _ in range(n))


def rows():
    """Documents with copies, near copies, shared passages, secrets, licenses, leaks, nulls, blanks and long texts."""
    rng, out = random.Random(7), []
    passage = sentence(rng, "en", 70)
    for i in range(120):
        lang = "en" if i % 3 else "fr"
        t = sentence(rng, lang, rng.choice((3, 20, 60, 150))) + ".\n" + sentence(rng, lang, 30) + "."
        if i % 11 == 0:
            t += "\n" + passage
        if i % 17 == 0:
            t += f'\ntoken = "{i:040x}" and AKIA{i:020d}X'
        if i % 19 == 0:
            t += "\nReleased under the MIT License."
        if i % 5 == 0 and lang == "en":
            t += " you idiot moron"
        out.append([i, t, lang, f"src{min(i % 4, 1)}"])
    texts = [r[1] for r in out]
    for k in range(30):  # a hot group of copies, and near copies
        out.append([1000 + k, texts[3] + "\n" + sentence(random.Random(1), "en", 100), "en", "src0"])
        words = (texts[7] + " " + sentence(random.Random(2), "en", 150)).split(" ")
        words[40 + k] = f"other{k}"
        out.append([2000 + k, " ".join(words), "en", "src1"])
    out += [[3000, None, "en", "src0"], [3001, "", "fr", None], [3002, " \n\t ", None, "src9"], [3003, "12345 $$$", "en", "src9"], [3004, "word", "en", "src9"], [None, texts[5], "en", "src0"], [None, None, None, None]]
    out += [[5, texts[5], "en", "src0"], [5, texts[5], "en", "src0"], [6, texts[9], "fr", None], [4000, sentence(rng, "en", 30000), "en", "src0"], [4001, "é" * 3000 + "\U0001f600" * 70, "fr", "src2"]]
    return [(*r, None if r[1] is None else len(r[1]), 1, "x", "y", 0.5, 2, "k", 3) for r in out]


VECTORS = "vec_id long, embedding array<float>, label int, score double, tile long, kind string"


def vectors():
    """Vectors with ties, repeated rows, a hot label, nulls, other lengths and components that are no number."""
    rng, out = random.Random(3), []
    for i in range(400):
        v = [rng.choice((-0.5, -0.1, 0.0, 0.3, 0.7)) for _ in range(33)]
        out.append((i, v, 1 if rng.random() < 0.4 else rng.randrange(10)))
    out += [(50, out[50][1], 3), (50, out[50][1], out[50][2]), (60, out[50][1], 1), (None, out[50][1], 1), (None, out[100][1], 4)]
    out += [(1000, None, 1), (1050, out[1][1], None), (1100, [0.1, None] * 16, 1), (1150, [float("nan")] * 33, 1), (1200, [float("inf")] * 33, 2), (1250, [], 1), (1300, out[2][1][:20], 5), (1350, out[3][1] * 2, 6), (None, None, None)]
    return [(*r, 0.5, 1, "k") for r in out]


ITEMS = 12


@pytest.fixture(scope="session")
def tricky(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tricky"))
    docs = rows()
    leak = [(i, sentence(random.Random(100 + i), "en", 20)) for i in range(ITEMS)] + [(50, None), (51, ""), (52, "ab")]
    docs += [(6000 + i, sentence(random.Random(i), "en", 30) + " " + leak[i][1] + " the end", "en", "src0", 1, 1, "", "", 0.0, 0, "", 0) for i in range(4)]
    edited = leak[5][1][:30] + "q" + leak[5][1][31:60] + leak[5][1][61:]
    docs.append((6010, "well " + edited.upper() + "\n of", "en", "src0", 1, 1, "", "", 0.0, 0, "", 0))
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(leak, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(vectors(), VECTORS).repartition(3).write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(r[0], 1, int("idiot" in (r[1] or ""))) for r in docs if r[0] is not None] + [(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], VECTORS).write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d
