"""HTML to Markdown, ordered assembly, document quality."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags that go with their content.
NOISE_TAGS = frozenset(
    ("script", "style", "img", "svg", "nav", "footer", "header", "aside", "form", "input", "button", "iframe", "canvas", "video", "audio", "source", "track", "embed", "object", "noscript", "template")
)
VOID = frozenset("br hr img input link meta embed area base col source track wbr".split())
CHAPTER = re.compile(r"^第[0-9一二三四五六七八九十百零]+[章篇卷部编]$")


class _Markdown(HTMLParser):
    """Writes Markdown blocks while tags open and close; an unclosed inline tag ends with its block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.held, self.prefix, self.hidden, self.inline = "", "", [], []

    def flush(self) -> None:
        for mark in reversed(self.inline):
            self.held += mark
        self.inline = []
        body = "\n".join(" ".join(x.split()) for x in self.held.split("\x00")).strip()
        body = re.sub(r"\*{4,}|(?<!\*)\*\*\s*\*\*(?!\*)", "", body).strip()
        if body:
            self.blocks.append(("# " if CHAPTER.match(body) and not self.prefix else self.prefix) + body)
        self.held = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in NOISE_TAGS:
            if tag not in VOID:
                self.hidden.append(tag)
        elif not self.hidden:
            if re.fullmatch("h[1-6]", tag):
                self.flush()
                self.prefix = "#" * min(int(tag[1]), 4) + " "
            elif tag in ("strong", "b", "em", "i"):
                mark = "**" if tag in ("strong", "b") else "*"
                if mark not in self.inline:
                    self.held += mark
                    self.inline.append(mark)
            elif tag == "br":
                self.held += "\x00"
            elif tag in ("p", "div", "section", "article", "ul", "ol", "table", "tr", "title", "head", "body"):
                self.flush()
                self.prefix = ""
            elif tag in ("li", "blockquote"):
                self.flush()
                self.prefix = "- " if tag == "li" else "> "
            elif tag in ("td", "th"):
                self.held += " "

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
        elif tag in ("strong", "b", "em", "i"):
            mark = "**" if tag in ("strong", "b") else "*"
            if mark in self.inline:
                self.inline.remove(mark)
                self.held += mark
        elif tag not in VOID and tag not in ("span", "a", "td", "th"):
            self.flush()
            self.prefix = ""

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.held += data


def markdown_of(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return "\n\n".join(parser.blocks)


def html_to_markdown(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and markdown. Comments and noise tags go with their content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "markdown": [markdown_of(h) for h in pdf[html_col]]})

    return df.select(id_col, html_col).mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, markdown string")


def assemble_ordered(spine: DataFrame, manifest: DataFrame, parts: DataFrame, id_col: str = "book_id") -> DataFrame:
    """spine(book, pos, item), manifest(book, item, href), parts(book, href, md): md of each book in spine order; missing and blank parts skipped."""
    found = spine.join(manifest, [id_col, "item"]).join(parts, [id_col, "href"]).filter(F.trim("md") != "")
    return found.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "md"))), lambda x: x.md), "\n\n").alias("text"))


def document_quality(df: DataFrame, text_col: str = "text", images: str | None = None, script: str = "[一-龥]", min_chars: int = 3000, min_share: float = 0.15, scan_images: int = 50, scan_chars: int = 5000, files: str | None = None) -> DataFrame:
    """Adds total_chars, script_chars, headings, share, valid, reason; the first rule that fails gives the reason. With files, an array column of file names, n_html and n_images, too."""
    n = F.length(text_col).cast("long")
    if files:
        named = lambda p: F.coalesce(F.size(F.filter(files, lambda f: F.lower(f).rlike(p))), F.lit(0)).cast("long")
        df = df.withColumns({"n_html": named(r"\.x?html?$"), "n_images": named(r"\.(jpe?g|png|gif|svg|webp)$")})
        images = images or "n_images"
    pictures = F.col(images) if images else F.lit(0)
    out = df.withColumns({"total_chars": n, "script_chars": F.regexp_count(text_col, F.lit(script)).cast("long"), "headings": F.regexp_count(text_col, F.lit(r"(?m)^#{1,4}\s")).cast("long")})
    out = out.withColumn("share", F.when(F.col("total_chars") > 0, F.col("script_chars") / F.col("total_chars")).otherwise(0.0))
    reason = F.when((pictures > scan_images) & (F.col("total_chars") < scan_chars), "scan").when(F.col("total_chars") < min_chars, "short").when(F.col("share") < min_share, "script").otherwise("ok")
    return out.withColumn("reason", reason).withColumn("valid", F.col("reason") == "ok")
