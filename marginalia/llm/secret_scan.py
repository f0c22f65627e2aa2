"""Secret scans (operator 9): candidates by pattern, verdicts by corpus-wide ownership.

One Arrow pass finds candidates in every whole text. Hashes of the candidate values are then
counted by owner and by repository over the whole corpus; a value that many owners or many
repositories carry is an example that was copied around, a value that stays with one owner looks
live. Only candidates are shuffled, never texts; counts are combined on the map side, so a value
that a third of the corpus repeats costs a few rows a task.

A repository is a distinct text of an owner: exact copies and repeated rows of one owner count once.

Defined results: null text is empty, a null owner is an owner of its own; an empty table gives an empty
result; repeated rows are returned each by itself; rows are told apart by position, not by id, so null and
repeated ids are kept; spans that begin together are ordered by kind; texts of any length are scanned whole;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectext

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = ("assign", "access", "hex")
# A private key is its header, header fields, and either all up to the footer or, where that is cut off, the base64 lines.
_GAP = r"(?:\s|\\+[nr])"
PEM = rf"""-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----(?:{_GAP}*[A-Za-z][A-Za-z-]{{2,30}}:(?:(?!-----)[^\n\\])*+)*+(?:([A-Za-z0-9+/=\s\\"',;.#>*]*+)-----END [A-Z ]{{0,30}}PRIVATE KEY-----|((?:{_GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}})*+(?:{_GAP}*+[A-Za-z0-9+/]++(?:={{1,2}}|={{0,2}}(?=\s*\Z)))?))"""
# Further kinds, reported only where ownership says that they look live.
EXTRA = {
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*",
    "pem": PEM,
    "vendor": r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})",
    "random": r"[A-Za-z0-9+/_-]{32,}={0,2}",
}
KINDS = (*BASE, *EXTRA)
PLACEHOLDER = re.compile(r"(?i)example|changeme|placeholder|dummy|sample|xxxx|(.)\1{7}")

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(r"[0-9a-f]{24,}")
_EXTRA = {k: re.compile(v) for k, v in EXTRA.items()}

FOUND = "doc_id long, owner string, repo long, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:int,begin:int,stop:int,value:long,plain:boolean>>"


def _bits(text: str) -> float:
    """Shannon entropy per character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def _random(text: str) -> bool:
    return bool(_bits(text) >= 4 and re.search("[0-9]", text) and re.search("[A-Z]", text) and re.search("[a-z]", text))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(begin, kind, end, value) of the base kinds by begin, then kind. Runs of 24 or more are the runs of the wider pattern that are long enough."""
    out = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def key_body(m: re.Match) -> str:
    """The base64 characters of a private key: equal for equal keys, however they are wrapped, quoted or escaped."""
    return re.sub(r"\\+[nr]|[^A-Za-z0-9+/=]", "", m[1] if m[1] is not None else m[2])


def _plain(kind: int, value: str) -> bool:
    """A placeholder by its wording. A key body is long enough to hold such letters by chance, so there it is a body of few or hardly any different characters."""
    if KINDS[kind] == "pem":
        return _bits(value) < 3 or len(value) < 64 and bool(PLACEHOLDER.search(value))
    return bool(PLACEHOLDER.search(value))


def extra_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Further candidates that overlap no span so far; a private key may hold or meet spans of the base kinds, which don't replace it."""
    out = list(taken)
    for k, kind in enumerate(KINDS[len(BASE) :], len(BASE)):
        for m in _EXTRA[kind].finditer(text):
            if kind == "pem":
                out.append((m.start(), k, m.end(), key_body(m)))
            elif (kind != "random" or _random(m[0])) and all(m.end() <= b or m.start() >= e for b, _, e, _ in out):
                out.append((m.start(), k, m.end(), m[0]))
    return sorted(out[len(taken) :])


def _value(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _hex_rows(column: pa.Array) -> np.ndarray:
    """Rows with a run of at least 24 lower-case hex digits."""
    buf, at = vectext.text_bytes(column)
    good = np.concatenate(([False], ((buf >= 48) & (buf <= 57)) | ((buf >= 97) & (buf <= 102)), [False]))
    edge = np.flatnonzero(good[1:] != good[:-1])
    begin, end = edge[::2], edge[1::2]
    rows = np.zeros(len(column), bool)
    rows[np.searchsorted(at, begin[end - begin >= 24], "right") - 1] = True  # a run over two rows only adds a row to look at
    long = begin[end - begin >= 24]
    rows[np.minimum(np.searchsorted(at, end[end - begin >= 24] - 1, "right") - 1, len(column) - 1)] = True
    if len(long):  # nor is a row between them missed
        for b, e in zip(np.searchsorted(at, long, "right") - 1, np.searchsorted(at, end[end - begin >= 24] - 1, "right") - 1, strict=True):
            rows[b : e + 1] = True
    return rows


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = hashlib.sha256(b"").hexdigest()
    schema = pa.schema([("doc_id", pa.int64()), ("owner", pa.string()), ("repo", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("found", pa.list_(pa.struct([("kind", pa.int32()), ("begin", pa.int32()), ("stop", pa.int32()), ("value", pa.int64()), ("plain", pa.bool_())])))])
    for part in vectext.parts(batches, "text", 8 << 20):
        text = part.column("text").fill_null("")
        look = _hex_rows(text)
        for pattern in (r"(?i)password|passwd|secret|token|api_?key", r"AKIA|eyJ|-----BEGIN|gh[pousr]_|xox[abprs]-|sk_live_", r"[A-Za-z0-9+/_-]{32}"):
            look |= pc.match_substring_regex(text, pattern).to_numpy(zero_copy_only=False)
        n = len(text)
        counts, digest, found = np.zeros((3, n), np.int64), [none] * n, [[] for _ in range(n)]
        for i in np.flatnonzero(look):
            t = text[int(i)].as_py()
            base = base_spans(t)
            for _, k, _, _ in base:
                counts[k, i] += 1
            if base:
                digest[i] = hashlib.sha256(",".join(f"{BASE[k]}:{b}:{e}" for b, k, e, _ in base).encode()).hexdigest()
            found[i] = [{"kind": k, "begin": b, "stop": e, "value": _value(v), "plain": _plain(k, v)} for b, k, e, v in sorted(base + extra_spans(t, base))]
        yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("owner"), part.column("repo"), *(pa.array(c) for c in counts), pa.array(digest), pa.array(found, schema.field("found").type)], schema=schema)


def scan_secrets(docs: DataFrame, owner_col: str = "source", max_owners: int = 2, max_repos: int = 20) -> tuple[DataFrame, DataFrame]:
    """(documents, values) for docs(doc_id, text, owner_col).

    values: one row per candidate value with n_repos, n_owners
    and verdict 'live' or 'example' ('example': over max_owners owners or max_repos repositories, or a
    placeholder by its wording). documents: doc_id, the base counts and digest, n_live, n_example and
    spans, which holds all base spans and those of further kinds that look live.
    """
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("")) if owner_col in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), owner.alias("owner"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("repo")).mapInArrow(_scan, FOUND)
    rows = common.stored(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")
    some = F.size("found") > 0
    each = rows.filter(some).select("row", "owner", F.explode("found").alias("f")).select("row", "owner", "f.*")
    by_repo = rows.filter(some).select("owner", "repo", F.explode(F.array_distinct(F.transform("found", lambda f: F.struct(f.value.alias("value"), f.plain.alias("plain"))))).alias("v")).select("owner", "repo", "v.*").groupBy("value", "owner", "repo").agg(F.max("plain").alias("plain"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count("*").alias("n"), F.max("plain").alias("plain"))
    values = by_owner.groupBy("value").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"), F.max("plain").alias("plain"))
    values = values.select("value", "n_repos", "n_owners", F.when(F.col("plain") | (F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos), "example").otherwise("live").alias("verdict"))
    judged = each.join(values.select("value", (F.col("verdict") == "live").alias("live")), "value").groupBy("row").agg(F.collect_list(F.struct("begin", "kind", "stop", "live")).alias("found"))
    fixed = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    shown = F.filter(F.array_sort("found"), lambda f: (f.kind < len(BASE)) | f.live)
    name = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform(shown, lambda f: F.concat_ws(":", F.get(name, f.kind), f.begin.cast("string"), f.stop.cast("string"))), ",")
    with_some = rows.filter(some).drop("found").join(judged, "row").select(*fixed, spans.alias("spans"), F.size(F.filter("found", lambda f: f.live)).cast("long").alias("n_live"), F.size(F.filter("found", lambda f: ~f.live)).cast("long").alias("n_example"))
    without = rows.filter(~some).select(*fixed, F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"))
    return without.unionByName(with_some), values


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(common.table(spark, sf_dir, "documents"))[0]
