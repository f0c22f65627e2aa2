"""Where Spark's functions and the check SQL differ in details of text."""

import duckdb
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.operators import citations


def test_case_letter_by_letter(spark):
    """faq_shape_merge: ß has one capital letter, ligatures none, and a sigma at a word's end is one like others."""
    odd = [chr(x) for x in range(1, 0x10000) if not 0xD800 <= x < 0xE000 and (len(chr(x).upper()) > 1 or len(chr(x).lower()) > 1 or x in (0x3A3, 0xDF, 0x41, 0x61))]
    texts = [*odd, "Enbeßge ΟΔΟΣ, ﬁn İst", "", "plain Text", "".join(odd)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i long, t string")
    got = {r["i"]: (r["u"], r["l"]) for r in df.select("i", tx.capitals(F.col("t")).alias("u"), tx.small_letters(F.col("t")).alias("l")).collect()}
    c = duckdb.connect()
    assert got.pop(-1) == (None, None)
    assert got == {i: c.execute("SELECT upper(?), lower(?)", [t, t]).fetchone() for i, t in enumerate(texts)}


def test_report_rounds_ties_as_sql(spark):
    """issue_report: 1/8 is a tie in binary and goes to the even digit; other scores go by their binary value."""
    scores = sorted({round(n / m, 6) for m in range(1, 16) for n in range(m + 1)} | {(2 * n + 1) / 200 for n in range(100)} | {0.0, 1.0, 0.994999, 0.125001})
    issues = spark.createDataFrame([(i, 0, "1", "WARNING", "unsupported", s) for i, s in enumerate(scores)], "answer_id long, pos long, ref_id string, severity string, reason string, score double")
    got = {r["answer_id"]: r["report"] for r in citations.issue_report(issues).collect()}
    assert got[scores.index(0.125)].endswith(" 0.12")
    c = duckdb.connect()
    assert got == {i: c.execute("SELECT format('[{}] [{}] {} {:.2f}', 'WARNING', '1', 'unsupported', ?::DOUBLE)", [s]).fetchone()[0] for i, s in enumerate(scores)}
