"""Operators 11 to 13 against brute force and SQL, on the fixture and on groups of near copies."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import hard_negatives, lexical_rank, ngram_join
from marginalia.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(lexical_rank.TERM)
FOLD = str.maketrans(lexical_rank.UPPER, lexical_rank.LOWER)


def shingle_set(text, width=4):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def linked(rows, percent=85):
    """doc_id, size, component by looking at all pairs that share a shingle."""
    sets, by, parent = [shingle_set(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j, s in enumerate(sets):
        for i, both in Counter(i for x in s for i in by[x]).items():
            if 100 * both >= percent * (len(s) + len(sets[i]) - both):
                parent[find(i)] = find(j)
        for x in s:
            by[x].append(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def test_ngram_join_equals_brute_force(spark, tricky):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tricky}/documents.parquet").collect()]
    assert found(QUERIES["op11_ngram_join"](spark, tricky)) == linked(rows)


@pytest.mark.parametrize("options", [{}, {"most": 1, "leaders": 1}, {"block": 40}, {"percent": 60, "most": 1, "leaders": 2, "block": 64}])
def test_ngram_join_of_near_copy_groups(spark, options):
    """Two groups of 150 near copies around the threshold, some with an upper-case or very long text, and texts that share a passage only."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, passage = [], [word() for _ in range(60)]
    for g in range(2):
        base = [word() for _ in range(120)]
        for k in range(150):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = word()
            rows.append((1000 * g + k, " ".join(w).upper() if k % 9 == 0 else "\n".join(w)))
    rows += [(5000 + k, " ".join(passage + [word() for _ in range(60)])) for k in range(120)]
    long = [word() for _ in range(20000)]
    rows += [(9000, " ".join(long)), (9001, " ".join(long[:-900])), (9002, " ".join(long[:12000])), (None, rows[0][1]), (None, "a b"), (9003, "A\tb"), (9004, "a b c"), (9005, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    documents, links = ngram_join.link(df, **options)
    assert found(documents) == linked(rows, options.get("percent", 85))
    assert links.filter(100 * F.col("overlap") < options.get("percent", 85) * F.col("total")).count() == 0


def members(n=300, seed=1, bits=512):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 1 << 62, 200).astype(np.uint64) for _ in range(4)]
    sets = []
    for k in range(n):
        s = base[k % 4].copy()
        change = rng.choice(200, rng.integers(0, 60), replace=False)
        s[change] = rng.integers(0, 1 << 62, len(change)).astype(np.uint64)
        sets.append(np.unique(s[: int(rng.integers(120, 201))]))
    words = np.array([np.frombuffer(ngram_join.bitmap(s, bits), np.uint64) for s in sets])
    m = ngram_join.Members(np.zeros(n, np.int64), np.arange(n), np.arange(n) // 2, np.array([len(s) for s in sets]), words, np.zeros(n, bool), np.full(n, -1), 85)
    return m, sets


def test_tree_loses_no_pair():
    m, sets = members()
    order = ngram_join._ordered(m)
    got = {tuple(sorted((int(order.node[i]), int(order.node[j])))) for a, b in ngram_join.Tree(order).pairs() for i, j in zip(a, b, strict=True)}
    want = set()
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if i // 2 != j // 2 and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                want.add((j, i))
    assert want and want <= got
    assert len(got) < 0.3 * len(sets) ** 2 / 2


def test_shared_over_batches():
    b, n = [1, 1, 1, 2, 3, 3, 4, 5, 5, 5], [7, 7, 7, 7, 7, 8, 1, 2, 2, 3]
    for cut in range(1, 10):
        parts = [pa.RecordBatch.from_arrays([pa.array(b[k : k + cut]), pa.array(n[k : k + cut])], names=["bucket", "node"]) for k in range(0, 10, cut)]
        got = [(r["bucket"], r["node"]) for p in ngram_join._shared(iter(parts)) for r in p.to_pylist()]
        assert got == [(3, 7), (3, 8), (5, 2), (5, 3)]


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (64, 64, 64), (70, 33, 129), (200, 65, 100), (0, 4, 4), (40, 0, 40)])
def test_strassen_is_exact(shape):
    n, k, m = shape
    rng = np.random.default_rng(2)
    for most in (1 << 8, 1 << 62):  # sums wrap alike
        a, b = rng.integers(-most, most, (n, k)), rng.integers(-most, most, (k, m))
        assert (hard_negatives.strassen(a, b, leaf=8) == a @ b).all()


def mined(rows):
    """Brute force of op12 in Python integers."""
    use = []
    for i, v, label, *_ in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, (i, v, label) in enumerate(use):
        if i is None or i % 50:
            continue
        scores = [(sum(x * y for x, y in zip(v, w, strict=False)), j, other == label) for b, (j, w, other) in enumerate(use) if a != b]
        for p, pid, _ in sorted((s for s in scores if s[2]), key=order)[:5]:
            negatives = sorted((s for s in scores if not s[2] and 50 * p <= 100 * s[0] <= 95 * p), key=order)[:3]
            out += [(i, pid, r + 1, s[1], p, s[0]) for r, s in enumerate(negatives)]
    return sorted(out, key=repr)


NEGATIVES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def test_hard_negatives_equal_brute_force(spark, tricky):
    rows = [tuple(r) for r in spark.read.parquet(f"{tricky}/embeddings.parquet").collect()]
    got = sorted((tuple(r[c] for c in NEGATIVES) for r in QUERIES["op12_hard_negatives"](spark, tricky).collect()), key=repr)
    assert got == mined(rows) and len(got) > 50


def test_hard_negatives_in_small_tiles(spark, tricky):
    rows = hard_negatives.relabelled(spark.read.parquet(f"{tricky}/embeddings.parquet"))
    got = sorted((tuple(r[c] for c in NEGATIVES) for r in hard_negatives.mine(rows, rows.filter("id % 50 = 0"), size=7).collect()), key=repr)
    assert got == mined([tuple(r) for r in spark.read.parquet(f"{tricky}/embeddings.parquet").collect()])


def test_hard_negatives_send_no_copies_to_the_driver(spark, tricky):
    """Copies of tiles are shuffled: a broadcast would first collect all of them in the driver."""
    rows = hard_negatives.relabelled(spark.read.parquet(f"{tricky}/embeddings.parquet"))
    plan = hard_negatives.mine(rows, rows.filter("id % 50 = 0"), size=7)._jdf.queryExecution().executedPlan().toString().split("\n")
    deep = [len(x) - len(x.lstrip(" :+-*()0123456789")) for x in plan]
    for at in (i for i, x in enumerate(plan) if "BroadcastExchange" in x):
        below = [x for i, x in enumerate(plan) if i > at and all(deep[j] > deep[at] for j in range(at + 1, i + 1))]
        assert not any("explode" in x for x in below)
    assert any("explode" in x for x in plan)


def test_hard_negatives_copy_few_tiles():
    for anchors, rows, cells in ((52, 2448, 2400), (1, 9, 48), (9, 400, 400), (0, 5, 8), (5000, 250000, 4000)):
        slices, groups = hard_negatives._grid(anchors, rows, cells)
        assert anchors * groups + rows * slices <= 2.5 * (max(cells, anchors * rows / hard_negatives.CELL_TILES) * max(1, anchors) * rows) ** 0.5 + rows
        assert anchors <= slices * hard_negatives.OPEN_TILES and slices * groups >= min(cells, anchors * rows)


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(4)
    slot, score, ids = rng.integers(0, 5, 400), rng.integers(-4, 5, 400), rng.integers(0, 90, 400)
    one, two = hard_negatives.Heaps(5, 3), hard_negatives.Heaps(5, 3)
    one.merge(slot, score, ids)
    for at in np.array_split(rng.permutation(400), 9):
        two.merge(slot[at], score[at], ids[at])
    for x in ("slot", "score", "id", "floor"):
        assert (getattr(one, x) == getattr(two, x)).all()


def ranked(items, docs, k=10):
    """Brute force of op13 over all documents."""
    each = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    each = [(i, c, sum(c.values())) for i, c in each if c]
    n_docs, total = len(each), sum(n for _, _, n in each)
    df = Counter(t for _, c, _ in each for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(FOLD)))
        scores = []
        for i, c, n in each:
            m = 10 + 90 * n * n_docs // total
            s = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            scores.append((s, i))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return sorted(out, key=repr)


RANKED = ("item_id", "rank", "doc_id", "score")


@pytest.mark.parametrize("most_terms", [1 << 20, 40])
def test_lexical_rank_equals_brute_force(spark, tricky, most_terms):
    items, docs = spark.read.parquet(f"{tricky}/benchmark.parquet"), spark.read.parquet(f"{tricky}/documents.parquet")
    more = spark.createDataFrame([(7, "The OF and ünïcode 12345 you idiot"), (8, "the"), (9, "nowhere-seen-term"), (10, "a" * 40 + " " + "é" * 3000), (8, "the"), (None, "that with")], "item_id long, text string")
    items = items.select("item_id", "text").unionByName(more)
    got = sorted((tuple(r[c] for c in RANKED) for r in lexical_rank.rank(items, docs, most_terms=most_terms).collect()), key=repr)
    assert got == ranked([tuple(r) for r in items.collect()], [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_block_search_reads_few_places():
    """Documents of two terms: best positions end the search long before the lists end, and the result is that of all documents."""
    rng = np.random.default_rng(6)
    n = 20000
    at, term = np.arange(n + 1) * 3, np.tile(np.arange(3), n)
    times = np.concatenate([rng.zipf(1.8, n * 3)]).clip(1, 500)
    length = np.add.reduceat(times, at[:-1])
    block = lexical_rank.Block(np.arange(n), length, at, term, times, np.array([900, 400, 0]), n, int(length.sum()))
    best = lexical_rank.Best(10)
    block.search(np.array([0, 1, 2]), best)
    score = np.add.reduceat(block.impact, at[:-1])
    want = np.lexsort((np.arange(n), -score))[:10]
    assert best.id.tolist() == want.tolist() and best.score.tolist() == score[want].tolist()
    assert block.reads < n
    assert not block.seen_doc.any() and not block.seen_place.any() and not block.wanted.any()


def test_dictionary_confirms_bytes():
    terms = ["a", "ab", "abcdefgh", "abcdefgx", "x" * 16, "x" * 17, "x" * 18, "y" * 8 + "mm" + "z" * 8, "été", "0"]
    texts = [*terms, "b", "abcdefg", "y" * 8 + "nn" + "z" * 8, "x" * 19]
    d = lexical_rank.Dictionary(terms)
    buf = np.frombuffer(" ".join(texts).encode(), np.uint8)
    from marginalia.llm import vectext

    begin, end, _ = vectext.words(buf, np.array([0, len(buf)]))
    place, number = d.find(buf, begin, end)
    assert place.tolist() == list(range(len(terms))) and number.tolist() == list(range(len(terms)))
    assert lexical_rank.Dictionary([]).find(buf, begin, end)[0].tolist() == []


@pytest.mark.parametrize("name", ["op11_ngram_join", "op12_hard_negatives", "op13_lexical_rank"])
def test_equals_sql(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    r = c.execute(ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    want = sorted(r.fetchall())
    assert sorted(tuple(x[k] for k in names) for x in QUERIES[name](spark, small).collect()) == want


def test_ngram_large_group_below_the_threshold(spark, monkeypatch):
    """Texts whose small bitmaps can't tell that they are too far apart are told by wide ones, not by their texts."""
    from marginalia.llm import ngram_join

    met, rng = [], random.Random(4)
    texts = []
    for i in range(300):
        words = [f"w{k}" for k in range(120)]
        for k in rng.sample(range(5, 115), 2):
            words[k] = f"x{i}y{k}"
        texts.append(" ".join(words))
    verified = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *a: met.append(pairs.count()) or verified(pairs, *a))
    rows = ngram_join.link(spark.createDataFrame([*enumerate(texts), (300, texts[7])], "doc_id long, text string"))[0].collect()
    sets = [{tuple(x[k : k + 4]) for k in range(117)} for x in (t.split() for t in texts)]
    top = list(range(300))
    for i in range(300):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and top[i] != top[j]:
                lo, hi = sorted((top[i], top[j]))
                top = [lo if x == hi else x for x in top]
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate([*top, top[7]]))
    assert sum(met) < 5000
