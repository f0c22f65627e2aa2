"""Citations in answers: extraction, support, verdicts, repair, sanitising, renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

DOUBT = "·存疑"
CITE = r"\[([0-9]+)(?:·存疑)?\]"
# Words that are no facts, terms too general to support a claim, words of relation questions.
SKIP = ("1.", "2.", "3.", "4.", "5.", "6.", "7.", "8.", "9.", "0.", "第一", "第二", "第三", "第四", "第五", "首先", "其次", "最后", "总之", "此外", "同时", "根据", "关于", "有关", "以及", "或者", "但是", "可以", "进行", "通过", "需要", "成为", "形成", "说明", "表明", "反映", "体现", "显示", "具有", "存在", "发生", "产生", "导致", "因此", "所以", "由于", "因为", "虽然", "直接", "间接", "核心", "重要", "主要", "具体", "详细", "进一步", "一定程度上", "之一")
GENERIC = ("贞观", "唐太宗", "太宗", "唐初", "唐朝", "唐代", "皇帝", "大臣", "诏令", "政策", "制度", "根据参考资料", "参考资料", "史料记载")
RELATION = ("关系", "影响", "作用", "联系", "区别", "比较", "意义")
FALLBACK = "（史料记载）"


def cited_sentences(answers: DataFrame, *carry: str) -> DataFrame:
    """answer_id, carry, pos, sentence, ref_id: one row for each [n] in a sentence of answers(answer_id, answer)."""
    parts = answers.select("answer_id", *carry, F.posexplode(F.split("answer", r"(?<=[。！？\n])\s*")).alias("pos", "part"))
    return parts.select("answer_id", *carry, F.col("pos").cast("long").alias("pos"), tx.trimmed(F.col("part")).alias("sentence"), F.explode(F.regexp_extract_all("part", F.lit(r"\[([0-9]+)\]"), F.lit(1))).alias("ref_id"))


def fact_terms(sentence: Column, most: int = 15) -> Column:
    """Default term extractor: words of quoted text, numbers with units, capitalised words and Han runs; distinct, two characters or more."""
    plain = F.regexp_replace(sentence, r"\[[0-9]+\]", "")
    quoted = F.flatten(F.transform(F.regexp_extract_all(plain, F.lit("[\"'](.+?)[\"']"), F.lit(1)), lambda q: F.regexp_extract_all(q, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    numbers = F.regexp_extract_all(plain, F.lit(r"(?:[0-9]{1,4}|[一二三四五六七八九十百千]+)(?:年|月|日|升|石|顷|亩|人|户|卷)?"), F.lit(0))
    names = F.regexp_extract_all(plain, F.lit(r"\p{Lu}[\p{L}\p{N}]*|[一-龥]+"), F.lit(0))
    skip = F.array(*[F.lit(w) for w in SKIP])
    return F.slice(F.filter(F.array_distinct(F.concat(quoted, numbers, names)), lambda t: (F.length(t) >= 2) & ~F.array_contains(skip, t)), 1, most)


def _score(terms: Column, hit: Column) -> Column:
    """Support of a sentence with these hard terms by a source that has those of hit."""
    core = lambda t: (F.length(t) >= 3) | F.contains(t, F.lit("·"))
    n_core, hit_core = F.size(F.filter(terms, core)), F.size(F.filter(hit, core))
    return F.round(F.when(F.size(terms) == 0, 1.0).when(hit_core > 0, F.greatest(F.lit(0.5), hit_core / n_core)).otherwise(F.size(hit) / F.size(terms)), 6)


def _hard(terms: Column) -> Column:
    return F.array_except(terms, F.array(*[F.lit(w) for w in GENERIC]))


def citation_support(df: DataFrame, terms: str = "terms", content: str = "content") -> DataFrame:
    """Adds score and unmatched: the share of hard terms that the source has; core terms (three characters or more, or with ·) count first."""
    df = df.withColumn("_all", _hard(F.col(terms)))
    df = df.withColumn("_hit", F.filter("_all", lambda t: F.contains(F.col(content), t)))
    return df.withColumn("score", _score(F.col("_all"), F.col("_hit"))).withColumn("unmatched", F.array_except("_all", "_hit")).drop("_all", "_hit")


def citation_missing(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Cited (answer_id, ref_id) that sources(answer_id, ref_id, ..) lacks."""
    return cited_sentences(answers).select("answer_id", "ref_id").distinct().join(sources.select("answer_id", F.col("ref_id").cast("string").alias("ref_id")), ["answer_id", "ref_id"], "left_anti")


def verify_citations(answers: DataFrame, sources: DataFrame, threshold: float = 0.3, extractor=fact_terms) -> DataFrame:
    """Issues: answer_id, pos, ref_id, sentence, severity, score, reason, unmatched.

    Unknown id: CRITICAL. Source below 20 characters: WARNING. Support below the threshold (less where the
    answer asks for relations): CRITICAL under 0.1, else WARNING.
    """
    relation = F.exists(F.array(*[F.lit(w) for w in RELATION]), lambda w: F.contains(F.col("answer"), w))
    limit = F.when(relation, F.greatest(F.lit(0.15), F.lit(threshold - 0.1))).otherwise(F.lit(threshold))
    text = F.coalesce("content", F.lit(""))
    known = sources.select("answer_id", F.col("ref_id").cast("string").alias("ref_id"), text.alias("content"), (F.length(tx.trimmed(text)) < 20).alias("short"))
    cited = cited_sentences(answers.select("answer_id", "answer", limit.alias("limit")), "limit").withColumn("_all", _hard(extractor(F.col("sentence"))))
    # A source meets the sentences that cite it once, as a group. All that asks its text is done there: what is
    # asked of it after the sentences are rows again is asked for each of them, with a copy of the text.
    met = cited.groupBy("answer_id", "ref_id").agg(F.first("limit").alias("limit"), F.collect_list(F.struct("pos", "sentence", "_all")).alias("cites")).join(known, ["answer_id", "ref_id"], "left")
    checked, none = F.coalesce(~F.col("short"), F.lit(False)), F.array().cast("array<string>")
    hits = F.transform("cites", lambda s: F.struct(s.pos.alias("pos"), s.sentence.alias("sentence"), s._all.alias("_all"), F.when(checked, F.filter(s._all, lambda t: F.contains(F.col("content"), t))).otherwise(none).alias("_hit")))
    judged = F.transform(hits, lambda s: F.struct(s.pos.alias("pos"), s.sentence.alias("sentence"), F.when(checked, _score(s._all, s._hit)).otherwise(0.0).alias("score"), F.when(checked, F.array_except(s._all, s._hit)).otherwise(none).alias("unmatched")))
    found = met.select("answer_id", "ref_id", "short", F.explode(F.filter(judged, lambda s: ~checked | (s.score < F.col("limit")))).alias("s"))
    short = F.col("short")
    severity = F.when(short.isNull(), "CRITICAL").when(short, "WARNING").when(F.col("s.score") < 0.1, "CRITICAL").otherwise("WARNING")
    reason = F.when(short.isNull(), "unknown").when(short, "short").otherwise("unsupported")
    return found.select("answer_id", "s.pos", "ref_id", "s.sentence", severity.alias("severity"), "s.score", reason.alias("reason"), "s.unmatched")


def repair_citations(answers: DataFrame, sources: DataFrame, issues: DataFrame, least: float = 0.5, extractor=fact_terms) -> DataFrame:
    """answer_id, ref_id, new_id: for critical ids, the other source with the largest share of the terms of the first sentence that cites it."""
    critical = issues.filter("severity = 'CRITICAL'").select("answer_id", "ref_id").distinct()
    # First sentences before the join: map-side minima, so that the others are not shuffled.
    first = cited_sentences(answers).groupBy("answer_id", "ref_id").agg(F.min_by("sentence", "pos").alias("sentence"))
    terms = first.join(critical, ["answer_id", "ref_id"]).withColumn("terms", extractor(F.col("sentence"))).filter(F.size("terms") > 0)
    other = sources.select("answer_id", F.col("ref_id").cast("string").alias("new_id"), "content")
    share = F.round(F.size(F.filter("terms", lambda t: F.contains(F.col("content"), t))) / F.size("terms"), 6)
    tried = terms.join(other, "answer_id").filter("new_id != ref_id").select("answer_id", "ref_id", "new_id", share.alias("share"))
    w = Window.partitionBy("answer_id", "ref_id").orderBy(F.col("share").desc(), F.col("new_id").cast("long"))
    return tried.withColumn("n", F.row_number().over(w)).filter((F.col("n") == 1) & (F.col("share") >= least)).select("answer_id", "ref_id", "new_id")


def sanitize_answers(answers: DataFrame, issues: DataFrame, repairs: DataFrame) -> DataFrame:
    """answer_id, answer: critical ids repaired or replaced by a neutral remark, ids with warnings alone marked as doubtful."""
    worst = issues.groupBy("answer_id", "ref_id").agg(F.max((F.col("severity") == "CRITICAL").cast("int")).alias("critical"))
    cite = lambda x: F.concat(F.lit("["), x, F.lit("]"))
    new = F.when(F.col("critical") == 0, F.concat(F.lit("["), F.col("ref_id"), F.lit(DOUBT + "]"))).when(F.col("new_id").isNotNull(), cite(F.col("new_id"))).otherwise(F.lit(FALLBACK))
    rules = worst.join(repairs, ["answer_id", "ref_id"], "left").groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ref_id").cast("long").alias("o"), cite(F.col("ref_id")).alias("old"), new.alias("new")))).alias("rules"))
    # Marks first, so that a repaired id is not taken for a cited one.
    mark = lambda i: F.concat(F.lit("\u0001"), i.cast("string"), F.lit("\u0002"))
    places = F.sequence(F.lit(0), F.size("rules") - 1)
    held = F.aggregate(places, F.col("answer"), lambda s, i: F.replace(s, F.get("rules", i)["old"], mark(i)))
    out = answers.join(rules, "answer_id", "left").withColumn("_held", F.when(F.col("rules").isNotNull(), held))
    put = F.aggregate(places, F.col("_held"), lambda s, i: F.replace(s, mark(i), F.get("rules", i)["new"]))
    return out.select("answer_id", F.when(F.col("rules").isNull(), F.col("answer")).otherwise(tx.trimmed(F.regexp_replace(put, r"[ \t]{2,}", " "))).alias("answer"))


def extract_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, n (order of first use), ref_id: distinct cited ids that are known."""
    ids = answers.select("answer_id", F.posexplode(F.array_distinct(F.regexp_extract_all("answer", F.lit(CITE), F.lit(1)))).alias("pos", "ref_id"))
    known = ids.join(sources.select("answer_id", F.col("ref_id").cast("string").alias("ref_id"), "doc_name", "chapter_title"), ["answer_id", "ref_id"])
    return known.withColumn("n", F.row_number().over(Window.partitionBy("answer_id").orderBy("pos")).cast("long")).drop("pos")


def renumber_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, answer, footer: known ids renumbered 1.. by first use, all at once, and a list of sources."""
    used = extract_citations(answers, sources)
    short = F.trim(F.trim(F.regexp_replace("doc_name", r"\(.*$", "")), F.lit("《》"))
    rows = used.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("n", "ref_id", short.alias("doc"), F.coalesce("chapter_title", F.lit("")).alias("title")))).alias("used"))
    out = answers.join(rows, "answer_id", "left")
    held = F.aggregate("used", F.col("answer"), lambda s, u: F.replace(F.replace(s, F.concat(F.lit("["), u.ref_id, F.lit("]")), F.concat(F.lit("[\u0001"), u.n.cast("string"), F.lit("]"))), F.concat(F.lit("["), u.ref_id, F.lit(DOUBT + "]")), F.concat(F.lit("[\u0001"), u.n.cast("string"), F.lit(DOUBT + "]"))))
    text = F.when(F.col("used").isNull(), F.col("answer")).otherwise(F.replace(held, F.lit("\u0001"), F.lit("")))
    out = out.withColumn("new", text)
    doubt = lambda u: F.when(F.contains(F.col("new"), F.concat(F.lit("["), u.n.cast("string"), F.lit(DOUBT + "]"))), "（引用存疑）").otherwise("")
    line = lambda u: F.concat(F.lit("["), u.n.cast("string"), F.lit("] 《"), u.doc, F.lit("》"), F.when(u.title != "", F.concat(F.lit("· "), u.title)).otherwise(""), doubt(u))
    footer = F.when(F.col("used").isNull(), F.lit("")).otherwise(F.concat(F.lit("\n---\n**引用来源：**\n"), F.array_join(F.transform("used", line), "\n")))
    return out.select("answer_id", F.col("new").alias("answer"), footer.alias("footer"))


def issue_report(issues: DataFrame) -> DataFrame:
    """answer_id, report: one line an issue, in order."""
    # A tie of the third digit goes by the binary value, as C's printf has it; Java's rounds the decimal digits up.
    ties = F.array(*[F.lit(f"{(2 * n + 1) / 200:.2f}") for n in range(100)])
    tie = F.col("score").between(0, 1) & (F.round("score", 3) == F.col("score")) & (F.round(F.col("score") * 1000) % 10 == 5)
    score = F.when(tie, F.get(ties, F.floor(F.round(F.col("score") * 1000) / 10).cast("int"))).otherwise(F.format_string("%.2f", "score"))
    line = F.format_string("[%s] [%s] %s %s", "severity", "ref_id", "reason", score)
    return issues.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref_id", line.alias("x")))), lambda v: v.x), "\n").alias("report"))
