"""Line dedup (operator 1): segment-partition edit join.

Lines are what stands between line breaks, with single spaces; equal lines are one node. Two lines are
linked if their edit distance is at most min(max_edits, n // per_edit), n being the shorter one's
characters: by default 1 edit from 10 characters, 2 from 20; below 10 that is equality. A line of n
characters is cut into one segment more than its budget. Two lines within the budget share a segment of
the shorter one at a start that length difference and segment number bound, so each line is indexed by
its segments (key: its length, segment number, content) and probes, for its own and each smaller length
in reach, the few admissible substrings. Candidates are verified by banded bit-parallel edit distance.

Tuples (key, line) go to owners of key ranges as sorted compressed runs. They carry how many letters of
each of 32 groups a line has; an edit changes two groups at most, by one, so lines within max_edits agree in
all groups of one of 2 * max_edits + 1 shares: buckets are made by key and share, and a pair is looked at
only if its counts differ by 2 * max_edits at most. In each bucket all lines meet its first indexed line, the leader; these links are
verified and give classes; then lines of a bucket that are still in different classes meet each other.
A near-copy group of n lines so costs n links, not n * n, and no class loses a link. Keys that a
fixed-size count sketch finds heavy go another way: their leaders are map-side combined minima, and large
buckets meet as pairs of blocks, so that one segment that a third of all lines share meets no single task.
Buckets that still hold many lines of other classes than their largest are split by what their lines have beside
the shared segment: that rest is within the same budget, so it is cut into segments again, round by round (`rest_pairs`).

Result: one row per line of each document with its class, the first line (by doc_id, place) of which
stays, and n_links, how many different lines are within its text's budget. Links with leaders and between classes
make the classes; as no link leaves a class, all are then counted within these (`count_links`). Lines are known by 96 bits of hash; the edit join
groups and compares the lines themselves.

Defined results: null and blank texts and lines have no row; a null doc_id sorts last; of the places of a
class the least (doc_id, line_no) stays, and rows that repeat it are all kept; very long lines are compared
whole, without the ends they share, in matrices of bounded size; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph, sketch, vectext
from .suffix_dedup import RUN, _ids_in, _ids_out, _run_batch, squeeze, unsqueeze, unsqueeze_count
from .vectext import U64

BITS = 48
GROUPS = 32  # letter groups, two bits each
SLOTS = 1 << 18  # counters of the key sketch
INDEX, PROBE = 1, 2
_A, _B = U64(0xD1342543DE82EF95), U64(0xAF251AF3B0F025B5)


def nth(i: int) -> np.uint64:
    """A constant for number i."""
    return U64((i + 1) * int(_B) % (1 << 64))



def segments(length: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and sizes (rows x n) of n even segments; the last ones take what is left over."""
    base, rest = length // n, length % n
    size = base[:, None] + (np.arange(n)[None] >= (n - rest)[:, None])
    return np.cumsum(size, 1) - size, size


def points_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows and their offsets."""
    texts = column.to_pylist()
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def budget(size: np.ndarray, edits: int, per_edit: int) -> np.ndarray:
    """Edits that a pair may differ by, given the size of its shorter line."""
    return np.minimum(size // per_edit, edits)


def grams(prefix: vectext.Prefix, begin: np.ndarray, less: np.ndarray, own: np.ndarray, size: np.ndarray, salt: np.ndarray, most: int) -> Iterator[tuple]:
    """Of strings (spans under prefix) with a budget `own` that look for strings `less` characters shorter: (strings, keys, begins in these, widths, whether at the segment's own place)."""
    for c in range(most + 1):
        for t in range(max(1, c), most + 1):
            which = np.flatnonzero((less == c) & (own == t))
            if not len(which):
                continue
            start, width = segments(size[which] - c, t + 1)
            for i in range(t + 1):
                # Admissible shifts: i edits at most before the segment, t - i after it.
                for shift in range(max(-i, c - (t - i)), min(i, c + t - i) + 1):
                    b = start[:, i] + shift
                    ok = np.flatnonzero((b >= 0) & (b + width[:, i] <= size[which]) & (width[:, i] > 0))
                    b, w, k = b[ok], width[ok, i], which[ok]
                    h = prefix.spans(begin[k] + b, begin[k] + b + w)
                    yield k, vectext.mix(h + salt[k] + nth(i)), b, w, c == 0 and shift == 0


def tuples(points: np.ndarray, at: np.ndarray, edits: int, per_edit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, role) of all index and probe substrings."""
    keys, rows, roles = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for row, _, key, role, _, _ in _placed(points, at, edits, per_edit):
        rows.append(row)
        keys.append(key)
        roles.append(np.full(len(row), role, np.uint8))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(roles)


def _placed(points: np.ndarray, at: np.ndarray, edits: int, per_edit: int) -> Iterator[tuple]:
    """(row, less, key, role, begin, width) of all index and probe substrings, in groups of one role."""
    size, prefix = np.diff(at), vectext.Prefix(points)
    for c in range(edits + 1):
        salt = (size - c).astype(U64) * _A
        for row, key, b, w, indexed in grams(prefix, at[:-1], np.full(len(size), c), budget(size - c, edits, per_edit), size, salt, edits):
            yield row, c, key >> U64(64 - BITS), (INDEX | PROBE) if indexed else PROBE, b, w


def letter_counts(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit number a row: how many letters it has of each of 32 groups, modulo 4, two bits a group. An edit takes a letter, adds one, or both."""
    n = len(at) - 1
    group = (vectext.mix(np.arange(0x500, dtype=U64) + _B) >> U64(59)).astype(np.int64)
    of = group[np.minimum(points, 0x4FF)] if not len(points) or points.max() < 0x500 else (vectext.mix(points.astype(U64) + _B) >> U64(59)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(n) * GROUPS, np.diff(at)) + of, minlength=n * GROUPS).reshape(n, GROUPS).astype(U64) & U64(3)
    return (counts << (np.arange(GROUPS, dtype=U64) * U64(2))[None]).sum(1, dtype=U64)


def share_mask(s: int, shares: int) -> np.uint64:
    """The bits of every shares-th letter group from s on."""
    return U64(sum(3 << 2 * g for g in range(s, GROUPS, shares)))


_HIGH, _LOW = U64(0xAAAAAAAAAAAAAAAA), U64(0x5555555555555555)


def close(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Whether the letter counts differ by at most 2 * edits in all (each group's difference modulo 4, up or down)."""
    d = ((a | _HIGH) - (b & _LOW)) ^ ((a ^ ~b) & _HIGH)  # all groups' differences modulo 4 at once
    one, two = d & _LOW, (d & _HIGH) >> U64(1)
    return np.bitwise_count(one).astype(np.int64) + 2 * np.bitwise_count(two & ~one) <= 2 * edits


def marks(counts: np.ndarray, roles: np.ndarray) -> np.ndarray:
    """n x 9 bytes: letter counts and role."""
    return np.concatenate((np.ascontiguousarray(counts).view(np.uint8).reshape(-1, 8), roles.astype(np.uint8)[:, None]), 1)


def _worth(edits: int) -> graph.Test:
    def test(marks: np.ndarray, bucket: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """One of the two is indexed by the key, and few letter groups differ."""
        counts, indexed = np.ascontiguousarray(marks[:, :8]).view(U64).ravel(), (marks[:, 8] & INDEX) > 0
        return (indexed[i] | indexed[j]) & close(counts[i], counts[j], edits)

    return test


def heavy_slots(lines: DataFrame, edits: int, per_edit: int, least: int = 2000, times: float = 8.0) -> np.ndarray:
    """Sketch slots with more than `least` tuples and `times` the mean: 2**18 truth values, whatever the input."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for part in vectext.parts(batches, "line", 2 << 20):
            yield (tuples(*points_of(part.column("line")), edits, per_edit)[1] % U64(SLOTS)).astype(np.int64)

    total = sketch.totals(lines.select("line"), slots, SLOTS)
    return total > max(least, times * total.mean())


def _deal(edits: int, per_edit: int, parts: int, heavy: np.ndarray):
    """Sorted runs of light keys by owner; heavy keys, each with its share of the letter counts, as one run of owner -1."""
    shares = 2 * edits + 1

    def rows_of(p: int, block: int, ids: np.ndarray, counts: np.ndarray, row: np.ndarray, key: np.ndarray, role: np.ndarray) -> tuple:
        used, no = np.unique(row, return_inverse=True)
        head = squeeze((np.diff(key, prepend=U64(0)), 8), (no, 4), (role, 1))
        return p, block, len(key), _ids_out(ids[used]), len(head).to_bytes(4, "big") + head + counts[used].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for part in vectext.parts(batches, "line", 1 << 20):
            ids = part.column("line_id").to_numpy()
            order = np.argsort(ids)
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            points, at = points_of(part.column("line"))
            row, key, role = tuples(points, at, edits, per_edit)
            counts, ids, row = letter_counts(points, at)[order], ids[order], place[row]
            hot = heavy[(key % U64(SLOTS)).astype(np.int64)]
            rows = []
            if hot.any():
                r, k, o = row[hot], key[hot], role[hot]
                split = np.concatenate([vectext.mix(k + (counts[r] & share_mask(g, shares)) * _A + nth(g)) for g in range(shares)])
                by = np.argsort(split, kind="stable")
                rows.append(rows_of(-1, block, ids, counts, np.tile(r, shares)[by], split[by], np.tile(o, shares)[by]))
                row, key, role = row[~hot], key[~hot], role[~hot]
            by = np.argsort(key, kind="stable")
            row, key, role = row[by], key[by], role[by]
            cut = np.searchsorted(key, [((p << BITS) + parts - 1) // parts for p in range(parts)] + [1 << BITS])
            rows += [rows_of(p, block, ids, counts, *(a[cut[p] : cut[p + 1]] for a in (row, key, role))) for p in np.flatnonzero(np.diff(cut)).tolist()]
            yield _run_batch(rows)
            block += 1

    return run


def _run_tuples(n: int, known: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, role, letter counts) of a run."""
    head = int.from_bytes(data[:4], "big")
    key, no, role = unsqueeze(data[4 : 4 + head], n, 8, 4, 1)
    no = no.astype(np.int64)
    return np.cumsum(key), _ids_in(known, unsqueeze_count(known))[no], role.astype(np.uint8), np.frombuffer(data[4 + head :], U64)[no]


def _heavy_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            key, line, role, counts = _run_tuples(r["n"], r["ids"], r["tuples"])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(line), pa.array(counts.view(np.int64)), pa.array(role.astype(np.int32))], names=["bucket", "node", "counts", "role"])


def _pairs_of(edits: int):
    """Of one owner's light keys, by share of the letter counts: the pairs with each bucket's first indexed line; and all members of buckets of three or more."""
    shares = 2 * edits + 1

    def run(group: pa.Table) -> pa.Table:
        key, line, role, count = (np.concatenate(c) for c in zip(*(_run_tuples(*r) for r in zip(group["n"].to_pylist(), group["ids"].to_pylist(), group["tuples"].to_pylist(), strict=True)), strict=True))
        order = np.argsort(key, kind="stable")
        first = vectext.runs(key[order])
        size = np.diff(np.append(first, len(key)))
        live = order[np.repeat(size > 1, size)]
        key, line, role, count = key[live], line[live], role[live], count[live]
        pairs, members = [np.zeros((0, 2), np.int64)], []
        for g in range(shares):
            sub = vectext.mix(key + (count & share_mask(g, shares)) * _A + nth(g))
            by = np.lexsort((~role, line, sub))  # a line that has a key twice counts once, as indexed if it is
            by = by[vectext.runs_of_pairs(sub[by], line[by])]
            sub, own, indexed, c = sub[by], line[by], (role[by] & INDEX) > 0, count[by]
            start = vectext.runs(sub)
            if not len(start):
                continue
            size = np.diff(np.append(start, len(sub)))
            lead = np.minimum.reduceat(np.where(indexed, np.arange(len(sub)), len(sub)), start)
            good = (size > 1) & (lead < len(sub))
            y = np.flatnonzero(np.repeat(good, size))
            x = np.repeat(lead, size)[y]
            keep = (x != y) & close(c[x], c[y], edits)
            a, b = own[x[keep]], own[y[keep]]
            pairs.append(np.stack((np.minimum(a, b), np.maximum(a, b)), 1))
            more = np.repeat(good & (size > 2), size)
            members.append((sub[more], own[more], marks(c[more], role[by][more])))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        sub, own, mark = (np.concatenate(c) for c in zip(*members, strict=True)) if members else (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros((0, 9), np.uint8))
        n, m = len(pairs), len(sub)
        fill = lambda x, before, after: pa.array(np.concatenate((np.zeros(before, np.int64), x, np.zeros(after, np.int64))))
        return pa.table({"a": fill(pairs[:, 0], 0, m), "b": fill(pairs[:, 1], 0, m), "bucket": fill(sub.view(np.int64), n, 0), "node": fill(own, n, 0), "mark": pa.array([None] * n + [x.tobytes() for x in mark], pa.binary())})

    return run


def banded_distances(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Edit distances of pairs whose lengths differ by edits at most and exceed them; edits + 1 where larger.

    One 64-bit word a pair holds the vertical differences of the band of 2 * edits + 2 rows, and all
    pairs advance by a column at once; bit 2 * edits + 1 is the lowest row of the band.
    """
    n_a, n_b = (np.array([len(t) for t in x], np.int64) for x in (a, b))
    if not len(a):
        return np.zeros(0, np.int64)
    width, pad = 2 * edits + 2, edits + 1
    one, mask = U64(1), U64((1 << (2 * edits + 2)) - 1)
    wide = int(max(n_a.max(), n_b.max())) + 2 * pad + 2
    own = np.full((wide, len(a)), 0xFFFFFFFF, np.uint32)  # pattern, pad rows before it
    text = np.full((wide, len(a)), 0xFFFFFFFE, np.uint32)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        own[pad : pad + len(x), k] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
        text[: len(y), k] = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), np.uint32)
    plus = np.full(len(a), (((1 << (edits + 1)) - 1) << (width - edits - 1)), U64)
    minus, score = np.zeros(len(a), U64), np.full(len(a), edits, np.int64)
    for j in range(int(n_b.max())):
        c, same = text[j], np.zeros(len(a), U64)
        for k in range(width):
            same |= (own[j + k] == c).astype(U64) << U64(k)
        zero = ((((same & plus) + plus) ^ plus) | same | minus) & mask
        up = (minus | ~(zero | plus)) & mask
        down = plus & zero
        live = j < n_b
        diagonal = live & (j < n_a - edits)
        score[diagonal & ((zero >> U64(width - 1)) & one == 0)] += 1
        flat = np.flatnonzero(live & ~diagonal)
        if len(flat):
            bit = (n_a[flat] + edits - j).astype(U64)
            score[flat] += ((up[flat] >> bit) & one).astype(np.int64) - ((down[flat] >> bit) & one).astype(np.int64)
        plus = (down | ~((zero >> one) | up)) & mask
        minus = (zero >> one) & up
    return np.minimum(score, edits + 1)


def trimmed(x: str, y: str, edits: int) -> tuple[str, str]:
    """x and y without most of what they share at both ends; edits + 1 characters stay."""
    most = max(0, min(len(x), len(y)) - edits - 1)
    k = len(os.path.commonprefix((x[:most], y[:most])))
    most -= k
    e = len(os.path.commonprefix((x[len(x) - most :][::-1], y[len(y) - most :][::-1]))) if most else 0
    return x[k : len(x) - e], y[k : len(y) - e]


def distances(both: list[tuple[str, str]], edits: int, cells: int = 1 << 20) -> np.ndarray:
    """Edit distances of pairs; edits + 1 where larger. Like lengths together, in matrices of bounded size."""
    both = [trimmed(x, y, edits) for x, y in both]
    wide = np.array([max(len(x), len(y)) for x, y in both])
    order, got, k = np.argsort(wide, kind="stable"), np.zeros(len(both), np.int64), 0
    while k < len(order):
        n = max(1, min(512, cells // (int(wide[order[min(k + 511, len(order) - 1)]]) + 16)))
        o = order[k : k + n]
        got[o] = banded_distances([both[i][0] for i in o], [both[i][1] for i in o], edits)
        k += n
    return got


def _verify(edits: int, per_edit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vectext.parts(batches, "x", 1 << 18):
            both = list(zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True))
            most = budget(np.array([min(len(x), len(y)) for x, y in both]), edits, per_edit)
            got = distances(both, edits)
            out = pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(got)], names=["a", "b", "edits"])
            yield out.filter(pa.array(got <= most))

    return run


_GROUP = ("root", "share", "key", "p", "q")


def _by_share(edits: int):
    """Lines of large classes once for each share of their letter counts; the others once, as share -1."""
    shares = 2 * edits + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vectext.parts(batches, "line", 1 << 20):
            large = part.column("large").to_numpy(zero_copy_only=False).astype(bool)
            letters = letter_counts(*points_of(part.column("line")))
            row = np.concatenate((np.flatnonzero(~large), np.repeat(np.flatnonzero(large), shares)))
            share = np.concatenate((np.full(int((~large).sum()), -1), np.tile(np.arange(shares), int(large.sum()))))
            key = np.where(share < 0, U64(0), letters[row] & np.array([*(share_mask(g, shares) for g in range(shares)), U64(0)], U64)[share])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column("root").take(take), pa.array(share, pa.int32()), pa.array(key.view(np.int64)), part.column("node").take(take), part.column("line").take(take)], names=["root", "share", "key", "node", "line"])

    return run


def _link_counts(edits: int, per_edit: int):
    """(node, n_links) of groups (root, share, key, p, q) in sorted partitions: the links of each line within its group."""
    shares = 2 * edits + 1

    def counts(part: pa.RecordBatch) -> pa.RecordBatch:
        n, lines, (points, at) = part.num_rows, part.column("line").to_pylist(), points_of(part.column("line"))
        letters, size, found = letter_counts(points, at), np.diff(at), np.zeros(part.num_rows, np.int64)
        share, p, q, block = (part.column(c).to_numpy() for c in ("share", "p", "q", "block"))
        new = np.ones(n, bool)
        new[1:] = np.logical_or.reduce([(x := part.column(c).to_numpy())[1:] != x[:-1] for c in _GROUP])
        begin = np.flatnonzero(new)
        rest = np.repeat(np.append(begin[1:], n), np.diff(np.append(begin, n))) - np.arange(n) - 1
        done, lo = np.cumsum(rest), 0
        while lo < n:
            base = done[lo] - rest[lo]
            hi = max(lo + 1, int(np.searchsorted(done, base + (1 << 18), "right")))
            i = np.repeat(np.arange(lo, hi), rest[lo:hi])
            j = i + 1 + np.arange(len(i)) - np.repeat(done[lo:hi] - rest[lo:hi] - base, rest[lo:hi])
            keep = ((p[i] == q[i]) | (block[i] != block[j])) & (np.abs(size[i] - size[j]) <= edits) & close(letters[i], letters[j], edits)
            i, j = i[keep], j[keep]
            differ = letters[i] ^ letters[j]
            first = np.ones(len(i), bool)  # a pair counts at the first share in which it agrees
            for g in range(shares - 1):
                first &= (share[i] <= g) | (differ & share_mask(g, shares) != 0)
            i, j = i[first], j[first]
            for k in range(0, len(i), 1 << 13):
                a, b = i[k : k + (1 << 13)], j[k : k + (1 << 13)]
                ok = distances([(lines[x], lines[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], edits) <= budget(np.minimum(size[a], size[b]), edits, per_edit)
                found += np.bincount(a[ok], minlength=n) + np.bincount(b[ok], minlength=n)
            lo = hi
        return pa.RecordBatch.from_arrays([part.column("node"), pa.array(found)], names=["node", "n_links"]).filter(pa.array(found > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 1 << 12 and sum(b.nbytes for b in held) < 1 << 21:
                continue
            part = pa.concat_batches(held)
            last = np.ones(part.num_rows, bool)
            for c in _GROUP:
                x = part.column(c).to_numpy()
                last &= x == x[-1]
            cut = part.num_rows - int(last.sum())
            if cut:
                yield counts(part.slice(0, cut))
            held = [part.slice(cut)]
        held = [b for b in held if b.num_rows]
        if held:
            yield counts(pa.concat_batches(held))

    return run


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line of all lines that are not blank."""
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    odd = F.lit(False)  # few lines have white space other than single spaces, and only these need a pattern
    for c in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(F.col("line"), F.lit(c))
    clean = F.trim(F.when(odd, F.regexp_replace("line", common.LONG_WS, " ")).otherwise(F.col("line")))
    return parts.select("doc_id", F.col("line_no").cast("long").alias("line_no"), clean.alias("line")).filter("line <> ''")


def checked(pairs: DataFrame, lines: DataFrame, max_edits: int, per_edit: int) -> DataFrame:
    """(a, b, edits) of those of pairs(a, b) whose lines(line_id, line) are within their budget."""
    ids = common.stored(pairs.select(F.col("a").alias("line_id")).unionAll(pairs.select(F.col("b").alias("line_id"))).distinct(), "line-ids")
    texts = common.stored(lines.select("line_id", "line").join(common.small_side(ids), "line_id", "left_semi"), "line-texts", "zstd")
    x = pairs.join(texts.select(F.col("line_id").alias("a"), F.col("line").alias("x")), "a")
    both = x.join(texts.select(F.col("line_id").alias("b"), F.col("line").alias("y")), "b").filter(F.abs(F.length("x") - F.length("y")) <= max_edits)
    return common.stored(both.select("a", "b", "x", "y").mapInArrow(_verify(max_edits, per_edit), "a long, b long, edits long"), "line-links")


def _leaders_sql(heavy: DataFrame, edits: int) -> DataFrame:
    """Pairs of each member of heavy(bucket, node, counts, role) with its bucket's first two indexed lines, by map-side combined minima."""
    first = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("o"), "node", "counts")).alias(f"l{k}") for k in range(2)]
    lead = heavy.filter(F.col("role").bitwiseAND(INDEX) != 0).groupBy("bucket").agg(*first)
    met = heavy.join(lead, "bucket").select("node", "counts", F.explode(F.array("l0", "l1")).alias("l")).filter(F.col("node") != F.col("l.node"))
    x = F.col("counts").bitwiseXOR(F.col("l.counts"))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    near = F.bit_count(x.bitwiseAND(F.lit(0x5555555555555555))) <= 2 * edits
    return met.filter(near).select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b"))


def _rests(edits: int, per_edit: int):
    """Lines with the large buckets they are in -> the buckets these split into.

    A pair of a bucket agrees in one segment exactly, so what each has beside it, put together, is within the
    same budget, and is cut into segments again. `state` is less and the cuts (begin, width) made so far; it is
    empty in buckets that split no further, as the rest has fewer characters than segments.
    """
    shares = 2 * edits + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vectext.parts(batches, "line", 1 << 18):
            lines, points, at = part.column("line").to_pylist(), *points_of(part.column("line"))
            counts, seen = letter_counts(points, at), part.column("seen").to_pylist()
            items = [(r, tuple(x["state"]), x["bucket"], x["role"]) for r, xs in enumerate(seen) for x in xs if x["state"]]
            first = [(r, x["bucket"]) for r, xs in enumerate(seen) for x in xs if not x["state"]]
            if first:  # not split yet: the segments that brought the line into these buckets
                mine = np.unique(vectext.mix(np.array([b for _, b in first], np.int64).view(U64) ^ vectext.mix(np.array([r for r, _ in first], U64))))
                for row, c, key, role, b, w in _placed(points, at, edits, per_edit):
                    hit = np.zeros(len(row), bool)
                    for g in range(shares):
                        sub = vectext.mix(key + (counts[row] & share_mask(g, shares)) * _A + nth(g))
                        hit |= np.isin(vectext.mix(sub ^ vectext.mix(row.astype(U64))), mine)
                    items += [(r, (c, x, y), k, role) for r, x, y, k in zip(row[hit].tolist(), b[hit].tolist(), w[hit].tolist(), key[hit].view(np.int64).tolist(), strict=True)]
            for lo in range(0, len(items), 1 << 12):
                yield _split(part, lines, counts, items[lo : lo + (1 << 12)], edits, per_edit)

    return run


def _split(part: pa.RecordBatch, lines: list[str], counts: np.ndarray, items: list[tuple], edits: int, per_edit: int) -> pa.RecordBatch:
    """Rows (bucket, node, root, mark, role, state) of items (row, state, bucket, role)."""
    row, less, role = (np.array([x[k] if k != 1 else x[1][0] for x in items], np.int64) for k in (0, 1, 3))
    salt = np.array([x[2] for x in items], np.int64).view(U64)
    own = budget(np.array([len(lines[r]) for r in row], np.int64) - less, edits, per_edit)
    rests = []
    for r, state, _, _ in items:
        rest = lines[r]
        for b, w in zip(state[1::2], state[2::2], strict=True):
            rest = rest[:b] + rest[b + w :]
        rests.append(rest)
    points, at = points_of(pa.array(rests))
    size = np.diff(at)
    done = np.flatnonzero(size - less <= own)
    own[done] = 0
    which, keys, roles, states = [done], [salt[done]], [role[done]], [[]] * len(done)
    for k, key, b, w, indexed in grams(vectext.Prefix(points), at[:-1], less, own, size, vectext.mix(salt), edits):
        which.append(k)
        keys.append(key)
        roles.append(role[k] if indexed else np.full(len(k), PROBE))
        states += [[*items[i][1], x, y] for i, x, y in zip(k.tolist(), b.tolist(), w.tolist(), strict=True)]
    which, key, role = np.concatenate(which), np.concatenate(keys), np.concatenate(roles)
    mark = marks(counts[row[which]], role)
    take = pa.array(row[which])
    columns = [pa.array(key.view(np.int64)), part.column("node").take(take), part.column("root").take(take), pa.array([x.tobytes() for x in mark], pa.binary()), pa.array(role, pa.int32()), pa.array(states, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "node", "root", "mark", "role", "state"])


_SPLIT = "bucket long, node long, root long, mark binary, role int, state array<int>"


def rest_pairs(member: DataFrame, lines: DataFrame, edits: int, per_edit: int, most: int = 256) -> DataFrame:
    """Pairs (a, b) of member(bucket, node, root, mark) of one bucket and different roots that are worth a look at their texts.

    Buckets with `most` members or fewer beside their largest class meet in full. The others are split by the
    segments of what their lines have beside the shared one, and again, until the rest has fewer characters than
    segments; so a text that all lines share brings no two of them together. A round is a shuffle of the lines in
    question; the number of rounds grows with the logarithm of their length.
    """
    role = F.conv(F.hex(F.substring("mark", 9, 1)), 16, 10).cast("int")
    member = member.select("bucket", "node", "root", "mark", role.alias("role"), F.array().cast("array<int>").alias("state"), F.lit(True).alias("splits"))
    found = None
    while True:
        several = member.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.col("role").bitwiseAND(INDEX)).alias("any"), F.first("splits").alias("splits"))
        several = common.stored(several.filter("lo < hi and any > 0").select("bucket", (F.col("splits") & (F.col("n") > most)).alias("large")), "line-several")
        open_ = common.stored(member.drop("splits").join(common.small_side(several), "bucket"), "line-open", "zstd")
        beside = open_.filter("large").groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg((F.sum("n") - F.max("n")).alias("n"))
        large = common.stored(beside.filter(F.col("n") > most).select("bucket"), "line-large")
        pairs = graph.pairs_apart(open_.join(common.small_side(large), "bucket", "left_anti").select("bucket", "node", "root", "mark"), _worth(edits))
        found = pairs if found is None else found.unionByName(pairs)
        if not large.limit(1).count():
            return found.distinct()
        each = open_.join(common.small_side(large), "bucket", "left_semi").groupBy("node", "root").agg(F.collect_list(F.struct("bucket", "role", "state")).alias("seen"))
        rows = each.join(lines.select(F.col("line_id").alias("node"), "line"), "node")
        member = common.stored(rows.select("node", "root", "line", "seen").mapInArrow(_rests(edits, per_edit), _SPLIT), "line-rests", "zstd").withColumn("splits", F.size("state") > 0)


def edit_links(lines: DataFrame, max_edits: int = 2, per_edit: int = 10, per_part: int = 400_000, heavy: np.ndarray | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, roots) of lines(line_id, line), distinct lines: (a, b, edits) verified, and (node, root) of linked lines.

    links join each class: first those with a leader of a bucket, then all between lines that these left
    in different classes. Pairs within a class are not listed in full, as a class of n has up to n * n / 2.
    """
    size = lines.agg(F.count("*")).first()[0]
    parts = int(size * (max_edits + 1) * (max_edits + 2) // per_part) + 1
    heavy = heavy_slots(lines, max_edits, per_edit) if heavy is None else heavy
    runs = lines.select("line_id", "line").mapInArrow(_deal(max_edits, per_edit, parts, heavy), RUN)
    runs = common.stored(runs, "line-runs") if heavy.any() else runs
    found = runs.filter("part >= 0").groupBy("part").applyInArrow(_pairs_of(max_edits), "a long, b long, bucket long, node long, mark binary")
    found = common.stored(found, "line-buckets", "zstd")
    pairs, member = found.filter("mark is null").select("a", "b"), found.filter("mark is not null").select("bucket", "node", "mark")
    if heavy.any():
        hot = common.stored(runs.filter("part < 0").mapInArrow(_heavy_rows, "bucket long, node long, counts long, role int").distinct(), "line-heavy", "zstd")
        pairs = pairs.unionByName(_leaders_sql(hot, max_edits))
        mark = F.concat(F.reverse(F.unhex(F.lpad(F.hex("counts"), 16, "0"))), F.unhex(F.lpad(F.hex("role"), 2, "0")))
        member = member.unionByName(hot.select("bucket", "node", mark.alias("mark")))
    pairs = common.stored(pairs.distinct(), "line-pairs")
    links = checked(pairs, lines, max_edits, per_edit)
    roots = common.stored(graph.components(links.select("a", "b"), "line-roots"), "line-classes")
    rooted = member.join(common.small_side(roots), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"), "mark")
    rest = common.stored(rest_pairs(rooted, lines, max_edits, per_edit).join(pairs, ["a", "b"], "left_anti"), "line-rest")
    if rest.limit(1).count():
        links = links.unionByName(checked(rest, lines, max_edits, per_edit))
        roots = common.stored(graph.components(links.select("a", "b"), "line-roots"), "line-classes")
    return links, roots


def count_links(lines: DataFrame, roots: DataFrame, max_edits: int = 2, per_edit: int = 10, block: int = 512, size: int = 1 << 20) -> DataFrame:
    """(node, n_links) of lines(line_id, line) in roots(node, root), classes that no link leaves: how many other lines are within a line's budget.

    All lines of a class meet. Those of classes over `block` lines meet only where they agree in a share of their
    letter counts, as all pairs within max_edits do in one. Groups over `block` lines or `size` characters are
    dealt in blocks, each pair of blocks a group, so pairs exist in no table; of those looked at by letter counts, only close ones are compared.
    """
    large = common.stored(roots.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("root", F.lit(True).alias("large")), "line-large-classes")
    each = roots.join(common.small_side(large), "root", "left").select("node", "root", F.coalesce("large", F.lit(False)).alias("large"))
    each = lines.select(F.col("line_id").alias("node"), "line").join(common.small_side(common.stored(each, "line-rooted")), "node")
    member = each.select("root", "large", "node", "line").mapInArrow(_by_share(max_edits), "root long, share int, key long, node long, line string")
    member = common.stored(member, "line-shares", "zstd")
    parts = F.ceil(F.greatest(F.count("*") / block, F.sum(F.length("line")) / size)).cast("int")
    dealt = common.stored(member.groupBy("root", "share", "key").agg(parts.alias("parts")).filter("parts > 1"), "line-dealt")
    met = member.join(common.small_side(dealt), ["root", "share", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = met.withColumn("block", F.pmod(F.xxhash64("node", F.lit(11)), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("root", "share", "key", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), "block", "node", "line")
    found = met.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_link_counts(max_edits, per_edit), "node long, n_links long")
    return found.groupBy("node").agg(F.sum("n_links").alias("n_links"))


def classify_lines(docs: DataFrame, max_edits: int = 2, per_edit: int = 10) -> tuple[DataFrame, DataFrame]:
    """(lines, links) of docs(doc_id, text).

    lines: doc_id, line_no, class_doc, class_line (first place of its class), class_size, n_links, kept.
    """
    found = lines_of(docs)
    names = [F.xxhash64("line").alias("node"), F.hash("line").alias("node2")]
    seen = common.stored(found.select("doc_id", "line_no", *names), "line-places", "zstd")
    unique = found.filter(F.length("line") >= per_edit).groupBy("line").agg(F.lit(1).alias("n")).select("line", *names, F.monotonically_increasing_id().alias("line_id"))
    unique = common.stored(unique, "line-unique", "zstd")
    links, roots = edit_links(unique, max_edits, per_edit)
    roots = common.stored(roots.join(count_links(unique, roots, max_edits, per_edit), "node", "left").select(F.col("node").alias("line_id"), "root", "n_links"), "line-classes")
    known = common.stored(unique.select("line_id", "node", "node2").join(common.small_side(roots.select("line_id")), "line_id", "left_semi"), "line-known")
    named = roots.join(known, "line_id").join(known.select(F.col("line_id").alias("root"), F.col("node").alias("top"), F.col("node2").alias("top2")), "root")
    named = common.stored(named.select("node", "node2", "top", "top2", "n_links"), "line-named")
    placed = seen.join(common.small_side(named), ["node", "node2"], "left")
    placed = common.stored(placed.select("doc_id", "line_no", F.coalesce("top", "node").alias("top"), F.coalesce("top2", "node2").alias("top2"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "line-placed", "zstd")
    first = placed.groupBy("top", "top2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no")).alias("first"), F.count("*").alias("class_size"))
    # Lines of their own need no partner; what is left is stored, so that a hot class is a skewed join that Spark can split.
    first = common.stored(first.filter("class_size > 1"), "line-first")
    out = placed.join(first, ["top", "top2"], "left")
    many = F.col("class_size").isNotNull()
    out = out.select("doc_id", "line_no", F.when(many, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("class_doc"), F.coalesce("first.line_no", "line_no").alias("class_line"), F.coalesce("class_size", F.lit(1)).alias("class_size"), "n_links")
    kept = F.col("doc_id").eqNullSafe(F.col("class_doc")) & (F.col("line_no") == F.col("class_line"))
    return out.withColumn("kept", kept), links


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_lines(common.table(spark, sf_dir, "documents"))[0]
