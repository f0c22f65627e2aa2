"""Column functions on text: cleaning rules, names, tokens, predicates. Catalyst expressions only."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Line ends that close a sentence, longest first.
SENTENCE_ENDS = ("。」", "」", "。", "！", "？", "”", "…", "!", "?")
# Noise patterns of scanned books, in the order in which they are removed.
NOISE = (
    r"RN[（\(《][0-9]+[）\)）。]",
    r"RN\([0-9]+\)\)",
    r"pp[《<][0-9]+",
    r"(?s)@.*?\(Page#[0-9]+\)",
    r"\(Page#[0-9]+\)",
    r"={5,}",
    r"第[一二三四五六七八九十百]+章[^\s0-9,，.。;；:：\-—]{2,}[0-9]+",
    r"总序站\)|卷首语[;；]|急挡“标准属”",
    r"(?i)Document\s*generated\s*by\s*Anna's\s*Archive.*",
    r"(?i)Some\s*stats\s*\(more\s*in\s*the\s*PDF\s*attachments\).*",
    r"(?i)filename[:_].*zip",
)
# Query classes with keywords, route and weight, in order of test.
QUERY_CLASSES = (
    ("fact", ("什么时候", "哪一年", "哪里人", "职位", "职务", "几月", "哪天"), "faq", 1.0),
    ("opinion", ("为什么", "怎么看", "评价", "意义", "影响"), "hybrid", 0.8),
    ("relation", ("和", "与", "关系", "合作", "矛盾"), "hybrid", 0.8),
    ("explore", ("介绍一下", "说说", "讲讲", "什么是"), "doc", 0.6),
)
# Words that make an answer unsafe.
BLOCKED_WORDS = ("反动", "推翻", "暴乱")


def trimmed(c: Column) -> Column:
    """Without blanks, tabs and line ends on either side."""
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def non_empty(c: Column) -> Column:
    return F.length(trimmed(F.coalesce(c, F.lit("")))) > 0


def min_len(c: Column, n: int = 50) -> Column:
    return F.length(trimmed(F.coalesce(c, F.lit("")))) >= n


def valid_question(c: Column, most: int = 2000) -> Column:
    return F.coalesce(F.length(c).between(1, most), F.lit(False))


def blocked(c: Column, words: Iterable[str] = BLOCKED_WORDS) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def page_number(c: Column) -> Column:
    """0-based page text to 1-based number; missing or no number: 1."""
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("long") + 1).otherwise(F.lit(1).cast("long"))


def doc_name(path: Column) -> Column:
    """Last part of a path without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")


def doc_ext(path: Column) -> Column:
    """Lower-case suffix with its dot, or empty."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)/*$", 1), r".(\.[^.]+)$", 1))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_一-鿿\-]", "_")


def join_broken_lines(c: Column, ends: Sequence[str] = SENTENCE_ENDS) -> Column:
    """Lines trimmed and joined until one closes a sentence; what is left over is a last paragraph. One pass within the row."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(F.regexp_replace(trimmed(x), "　", ""), "(?<=[一-龥]) (?=[一-龥])", "")), lambda x: x != "")
    closes = lambda x: F.exists(F.array(*[F.lit(e) for e in ends]), lambda e: F.endswith(x, e))
    joined = F.array_join(F.transform(lines, lambda x: F.concat(x, F.when(closes(x), F.lit("\n")).otherwise(F.lit("")))), "")
    return F.regexp_replace(joined, "\n$", "")


def denoise(c: Column, patterns: Iterable[str] = NOISE) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    return c


def apply_corrections(c: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Each old text replaced by its new one, in order; for a short list known at plan time."""
    for old, new in rules:
        if old:
            c = F.replace(c, F.lit(old), F.lit(new))
    return c


def apply_rules(c: Column, rules: Column) -> Column:
    """The same for an array column of struct(old, new), as a joined rule table gives it."""
    return F.aggregate(rules, c, lambda acc, r: F.when(r.old != "", F.replace(acc, r.old, r.new)).otherwise(acc))


def normalize_newlines(c: Column, is_markdown: Column | bool = False) -> Column:
    md = F.lit(is_markdown) if isinstance(is_markdown, bool) else is_markdown
    return trimmed(F.when(md, F.regexp_replace(c, r"\n{3,}", "\n\n")).otherwise(F.regexp_replace(c, r"\n+", "\n")))


def clean_text(c: Column, is_markdown: Column | bool = False, rules: Iterable[tuple[str, str]] = (), ends: Sequence[str] = SENTENCE_ENDS) -> Column:
    """Line joining (not for Markdown), noise rules, corrections, line ends."""
    md = F.lit(is_markdown) if isinstance(is_markdown, bool) else is_markdown
    return normalize_newlines(apply_corrections(denoise(F.when(md, c).otherwise(join_broken_lines(c, ends))), rules), md)


def cleaned_with_hits(df: DataFrame, text_col: str = "text", is_markdown: Column | bool = False, rules: Iterable[tuple[str, str]] = (), ends: Sequence[str] = SENTENCE_ENDS) -> DataFrame:
    """df with clean, as clean_text gives it, and hits: an array of (rule, hits), how often each noise rule and correction found something, in the order of the rules.

    Every rule counts and replaces on what the rules before it have left, in one pass over the row.
    """
    md = F.lit(is_markdown) if isinstance(is_markdown, bool) else is_markdown
    out, counts = df.withColumn("clean", F.when(md, F.col(text_col)).otherwise(join_broken_lines(F.col(text_col), ends))), []
    for k, p in enumerate(NOISE):
        # The pieces between the matches tell both, by one search; no rule matches an empty string.
        out = out.withColumn(f"_s{k}", F.split("clean", p, -1))
        out = out.withColumns({f"_n{k}": F.array_size(f"_s{k}").cast("long") - 1, "clean": F.array_join(f"_s{k}", "")}).drop(f"_s{k}")
        counts.append((f"noise_{k:02d}", f"_n{k}"))
    for k, (old, new) in enumerate((o, n) for o, n in rules if o):
        found = (F.length("clean") - F.length(F.replace("clean", F.lit(old), F.lit("")))) / len(old)
        out = out.withColumns({f"_c{k}": found.cast("long"), "clean": F.replace("clean", F.lit(old), F.lit(new))})
        counts.append((f"correction_{k:02d}", f"_c{k}"))
    hits = F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(F.col(c), F.lit(0)).alias("hits")) for name, c in counts])
    return out.withColumns({"clean": normalize_newlines(F.col("clean"), md), "hits": hits}).drop(*[c for _, c in counts])


def rule_hits(cleaned: DataFrame) -> DataFrame:
    """rule, hits, n_docs of cleaned_with_hits: how often each rule found something, and in how many rows. An aggregate with map-side combine."""
    # Outer: for a plain explode Spark adds a filter on the array's size below, which cleans every text a second time.
    each = cleaned.select(F.explode_outer("hits").alias("h")).select("h.rule", "h.hits").filter("rule is not null")
    return each.groupBy("rule").agg(F.sum("hits").alias("hits"), F.count_if(F.col("hits") > 0).alias("n_docs"))


def markdown_tidy(c: Column) -> Column:
    c = F.regexp_replace(c, r"\n{4,}", "\n\n\n")
    c = F.regexp_replace(c, r"(?m)[ \t\r]+$", "")
    c = F.regexp_replace(c, r"(?m)^(#{1,4}[ \t]+[^\n]+)\n{3,}", "$1\n\n")
    return trimmed(F.regexp_replace(c, r"\n[0-9]{1,3}\n", "\n"))


def tokenize(c: Column) -> Column:
    """Lower-case runs of letters and digits; a run of Han characters becomes its character bigrams (a single one itself)."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"[一-龥]+|[\p{L}\p{N}&&[^一-龥]]+"), F.lit(0))
    bigrams = lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[一-龥]"), bigrams(r)).otherwise(F.array(r))))


def latin_tokens(c: Column) -> Column:
    """The same for text without Han runs: no per-token branch."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def classify_query(c: Column, classes: Sequence[tuple] = QUERY_CLASSES) -> Column:
    """struct(category, route, weight) of the first class with a keyword in the text."""
    out = F.struct(F.lit("other").alias("category"), F.lit("hybrid").alias("route"), F.lit(0.5).alias("weight"))
    for name, words, route, weight in reversed(classes):
        hit = F.struct(F.lit(name).alias("category"), F.lit(route).alias("route"), F.lit(weight).alias("weight"))
        out = F.when(c.rlike("|".join(words)), hit).otherwise(out)
    return out


def chapter_title(c: Column) -> Column:
    """First of the first five lines that starts with '#', without the marks; else empty."""
    head = F.slice(F.split(trimmed(c), "\n"), 1, 5)
    found = F.get(F.filter(head, lambda x: F.startswith(trimmed(x), F.lit("#"))), F.lit(0))
    return F.coalesce(trimmed(F.regexp_replace(trimmed(found), "^#+", "")), F.lit(""))


def xml_escape(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


# Begins of source lists; each goes on to the end of the text.
FOOTERS = (
    r"(?s)\n---+\s*\n?\*\*引用来源：.*\z",
    r"(?s)\n\*\*引用来源：.*\z",
    r"(?s)\n来源[：:].*\z",
    r"(?s)引用来源[：:].*\z",
    r"(?s)\n参考文献[：:].*\z",
)


def strip_footer(c: Column) -> Column:
    """Without source lists that the writer of an answer added by hand."""
    for p in FOOTERS:
        c = F.regexp_replace(c, p, "")
    return trimmed(F.regexp_replace(c, r"\*+\s*\z", ""))


# Letters whose capital is one other letter, though full case mapping writes several.
_CAPITALS = {"ß": "ẞ"} | {chr(x): chr(x + 8) for lo in (0x1F80, 0x1F90, 0x1FA0) for x in range(lo, lo + 8)} | {"ᾳ": "ᾼ", "ῃ": "ῌ", "ῳ": "ῼ"}
_SEVERAL = [chr(x) for x in range(0x80, 0x10000) if not 0xD800 <= x < 0xE000 and len(chr(x).upper()) > 1]


def _each(c: Column, odd: Sequence[str], to: Sequence[str], change) -> Column:
    """change(c), but each letter of odd becomes its partner in to, wherever it stands. Other texts, nearly all, take one pass."""
    table = F.create_map(*[F.lit(x) for pair in zip(odd, to, strict=True) for x in pair])
    one = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(table, x), change(x))), "")
    return F.when(F.rlike(c, F.lit("[" + "".join(odd) + "]")), one).otherwise(change(c))


def capitals(c: Column) -> Column:
    """c in capitals, letter by letter: a text keeps its number of characters (ß becomes ẞ, ﬁ stays)."""
    return _each(c, _SEVERAL, [_CAPITALS.get(x, x) for x in _SEVERAL], F.upper)


def small_letters(c: Column) -> Column:
    """c in small letters, letter by letter: no final sigma, İ becomes i."""
    return _each(c, ["İ", "Σ"], ["i", "σ"], F.lower)


def content_hash(c: Column) -> Column:
    return F.sha1(F.regexp_replace(F.lower(trimmed(c)), r"[ \t\r\n]+", " "))
