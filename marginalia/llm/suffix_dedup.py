"""Suffix dedup (operator 8): bytes of strings that also start in an earlier document.

External induced sorting of sampled suffixes. Suffix tuples of every byte would need many times the disk
that the input takes, so only suffixes at content-chosen places are sorted and the others induced from
these, as induced sorting does with its local minima: within every `length`-byte window the place whose
`seed`-byte hash is least (the leftmost of equal ones) is an anchor. Equal windows have their anchors at
equal offsets, so windows can only be equal if their anchors' suffixes share the seed.

1. Texts are packed into blocks of about `block_bytes`, stored once in the shared folder.
2. First level: each block sends suffix tuples of its anchors (seed name, name of the stretch of all windows
   that hang on the anchor, document), the first document of each name only, as sorted compressed runs on
   disk, dealt by seed. Owners of key ranges merge the runs: an anchor whose whole stretch starts in an
   earlier document too is settled as repeated; a seed that no other document has, as unique; the first
   documents of seeds with several stretches stay open, at the borders of repeated passages.
3. Second level, on these few anchors: tuples carry the stretch itself. Owners sort them by the suffix that
   starts at the anchor and keep the common prefix of neighbours; then, step by step to the left, the order
   of the suffixes one byte longer is induced from the last one and that byte. At step k, the suffixes in
   one run of common prefixes of `length` - k bytes and of one induced rank hold equal windows: bytes are
   compared, not hashes. A window is repeated if its group has an earlier document.
4. Verdicts return to the blocks by number; settled stretches and open windows give the covered bytes.

First-level names have `key_bits` for the seed, by corpus size, and 40 bits for the stretch on top of an
equal seed: at 100 TB the chance of one false match in the whole corpus is below 1 in 10,000. Shuffled are
compressed runs and packed blocks. A passage in a third of all documents sends one tuple a block to its
owner and is never a pair. Owners have about `per_part` tuples, so corpora of any size are more owners.

Defined results: null text is empty (no bytes, nothing removed); a null doc_id sorts after all others;
rows with the same doc_id do not count as earlier than each other; repeated rows are returned each;
texts below `length` bytes lose nothing; a text over `block_bytes` is a block of its own, taken whole; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectext
from .vectext import U64

LAST = np.iinfo(np.int64).max  # stands for a null id
PAD = 255  # no byte of UTF-8; stands outside a stretch
UNIQUE, REPEATED, OPEN = 0, 1, 2
STRETCH = 40  # bits of a stretch name
RUN = "part int, block long, n int, ids binary, tuples binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def squeeze(*arrays: tuple[np.ndarray, int]) -> bytes:
    """The low bytes of unsigned arrays as compressed byte planes."""
    planes = [np.ascontiguousarray(a.astype(U64).view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes() for a, n in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unsqueeze(data: bytes, n: int, *widths: int) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), [], 0
    for w in widths:
        a = np.zeros((n, 8), np.uint8)
        a[:, :w] = raw[at : at + n * w].reshape(w, n).T
        out.append(a.view(U64).ravel())
        at += n * w
    return out


def _ids_out(ids: np.ndarray) -> bytes:
    return squeeze((np.diff(ids, prepend=0).astype(np.int64).view(U64), 8))


def _ids_in(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unsqueeze(data, n, 8)[0].view(np.int64))


def unsqueeze_count(ids: bytes) -> int:
    return len(zstandard.ZstdDecompressor().decompress(ids)) // 8


class Block:
    """Bytes of some documents, ordered by id, with the anchors of all their windows."""

    def __init__(self, ids: np.ndarray, buf: np.ndarray, at: np.ndarray, length: int, seed: int) -> None:
        self.ids, self.buf, self.at, self.length = ids, buf, at, length
        none = np.zeros(0, np.int64)
        self.anchor = self.low = self.high = self.doc = none
        self.prefix = vectext.Prefix(buf)
        width = length - seed + 1
        if len(buf) < length:
            return
        begin = np.arange(len(buf) - seed + 1)
        name = self.prefix.spans(begin, begin + seed)
        least = (name & ~U64(0xFFFFFFFF)) | begin.astype(U64)
        step = 1
        while step * 2 <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < width:
            rest = width - step
            least = np.minimum(least[:-rest], least[rest:])
        place = (least & U64(0xFFFFFFFF)).astype(np.int64)
        room = np.ones(len(buf) - length + 1, bool)  # windows within one document
        for e in at[1:-1]:
            room[max(0, e - length + 1) : max(0, e)] = False
        window = np.flatnonzero(room[: len(place)])
        if not len(window):
            return
        place = place[window]
        first = vectext.runs(place)  # a window's anchor lies in its own document, so no run spans two
        end = np.append(first[1:], len(place)) - 1
        self.anchor, self.low, self.high = place[first], window[first], window[end]
        self.doc = np.searchsorted(at, self.low, "right") - 1
        self.seed = name[self.anchor]

    def tuples(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(order, head, seed names, stretch names) of the anchors, in order of seed, stretch and place; head: begins of equal names."""
        key = self.seed >> U64(64 - bits) if len(self.anchor) else np.zeros(0, U64)
        stretch = self.prefix.spans(self.low, self.high + self.length) if len(key) else key
        stretch = vectext.mix(stretch + (self.anchor - self.low).astype(U64)) >> U64(64 - STRETCH)
        order = np.lexsort((self.anchor, stretch, key))
        key, stretch = key[order], stretch[order]
        return order, vectext.runs_of_pairs(key, stretch), key, stretch

    def spread(self, order: np.ndarray, head: np.ndarray, states: np.ndarray) -> np.ndarray:
        """States of all anchors, from those of the heads: later documents of a name repeat it, and its first document is as its head."""
        size = np.diff(np.append(head, len(order)))
        id_ = self.ids[self.doc[order]]
        out = np.empty(len(order), np.uint8)
        out[order] = np.where(id_ > np.repeat(id_[head], size), REPEATED, np.repeat(states, size)) if len(head) else states
        return out

    def open_heads(self, order: np.ndarray, head: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Anchors that go to the second level, in order of seed: one for each open name."""
        return order[head[states == OPEN]]

    def covered(self, sure: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Mask of the bytes under repeated windows: those of the anchors `sure`, and the windows at `more`."""
        step = np.zeros(len(self.buf) + 1, np.int32)
        np.add.at(step, self.low[sure], 1)
        np.add.at(step, self.high[sure] + self.length, -1)
        np.add.at(step, more, 1)
        np.add.at(step, more + self.length, -1)
        return np.cumsum(step[:-1]) > 0

    def results(self, mask: np.ndarray) -> pa.RecordBatch:
        rows = []
        for i in range(len(self.ids)):
            b, e = self.at[i], self.at[i + 1]
            gone, text = mask[b:e], self.buf[b:e]
            n = int(gone.sum())
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
            rows.append((None if self.ids[i] == LAST else int(self.ids[i]), int(e - b), n, spans, hashlib.sha256((text[~gone] if n else text).tobytes()).hexdigest()))
        doc_id, size, removed, spans, digest = zip(*rows, strict=True) if rows else ((),) * 5
        return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _packed(ids: np.ndarray, buf: np.ndarray, at: np.ndarray, block: int) -> pa.RecordBatch:
    kind = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary())])
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([_ids_out(ids)], pa.binary()), pa.array([squeeze((np.diff(at), 8))], pa.binary()), pa.array([zstandard.ZstdCompressor(level=3).compress(buf.tobytes())], pa.binary())], schema=kind)


def _unpacked(n: int, ids: bytes, sizes: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.concatenate(([0], np.cumsum(unsqueeze(sizes, n, 8)[0].astype(np.int64))))
    return _ids_in(ids, n), np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8) if at[-1] else np.zeros(0, np.uint8), at


def _take(buf: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pieces = [buf[at[i] : at[i + 1]] for i in which.tolist()]
    return np.concatenate(pieces) if pieces else buf[:0], np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64)


def _pack(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for part in vectext.parts(batches, "text", block_bytes):
            for k in range(0, part.num_rows, 1 << 15):
                piece = part.slice(k, 1 << 15)
                ids = piece.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                yield _packed(ids[order], *_take(*vectext.text_bytes(piece.column("text")), order), block)
                block += 1

    return run


def _runs_of(block: int, ids: np.ndarray, doc: np.ndarray, key: np.ndarray, bits: int, parts: int, *more: tuple[np.ndarray, int]) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """Cut sorted tuples into the owners' ranges of the key; each run carries the ids of the documents it names."""
    cut = np.searchsorted(key, [((p << bits) + parts - 1) // parts for p in range(parts)] + [1 << bits])
    for p in np.flatnonzero(np.diff(cut)).tolist():
        s = slice(cut[p], cut[p + 1])
        used, doc_no = np.unique(doc[s], return_inverse=True)
        yield p, block, s.stop - s.start, _ids_out(ids[used]), squeeze((np.diff(key[s], prepend=U64(0)), 8), (doc_no, 2), *((a[s], w) for a, w in more))


def _run_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "n", "ids", "tuples"])


def _packed_states(group: pa.Table, states: np.ndarray) -> pa.Table:
    """States (rows of bytes) in the order of a group's runs, cut up by run again."""
    cut = np.cumsum([0, *group["n"].to_pylist()])
    return pa.table({"block": group["block"], "part": group["part"], "states": pa.array([zstandard.ZstdCompressor(level=1).compress(states[cut[i] : cut[i + 1]].tobytes()) for i in range(group.num_rows)], pa.binary())})


def _runs_in(group: pa.Table, *widths: int) -> Iterator[tuple[np.ndarray, ...]]:
    for n, ids, data in zip(group["n"].to_pylist(), group["ids"].to_pylist(), group["tuples"].to_pylist(), strict=True):
        key, doc, *more = unsqueeze(data, n, 8, 2, *widths)
        yield np.cumsum(key), _ids_in(ids, unsqueeze_count(ids))[doc.astype(np.int64)], *more


def _merge(group: pa.Table) -> pa.Table:
    """First-level states of one owner's runs."""
    key, doc, name = (np.concatenate(c) for c in zip(*_runs_in(group, STRETCH // 8), strict=True))
    order = np.lexsort((doc, name, key))
    key, doc, name = key[order], doc[order], name[order]
    fine = np.append(vectext.runs_of_pairs(key, name), len(key))
    first = np.repeat(doc[fine[:-1]], np.diff(fine))
    coarse = vectext.runs(key)
    size = np.diff(np.append(coarse, len(key)))
    differs = np.minimum.reduceat(first, coarse) != np.maximum.reduceat(first, coarse)  # a seed's stretches have several first documents
    out = np.empty(len(key), np.uint8)
    out[order] = np.where(doc > first, REPEATED, np.where(np.repeat(differs, size), OPEN, UNIQUE))
    return _packed_states(group, out)


def induced(seed: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, right: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """n x steps: whether the window that begins k bytes before the anchor starts in an earlier document too.

    right: bytes from the anchor on; left: bytes before it, from the anchor outwards; windows from `high`
    bytes before the anchor (the first one) to `low`.
    """
    n = len(seed)
    names = np.concatenate((seed.astype(">u8").view(np.uint8).reshape(n, 8), right), 1)
    order = np.argsort(np.ascontiguousarray(names).view(f"V{names.shape[1]}").ravel(), kind="stable")
    names, left, doc, low, high = names[order], left[order], doc[order], low[order], high[order]
    same = names[1:] == names[:-1]
    common_ = np.where(same.all(1), same.shape[1], same.argmin(1)) - 8  # common prefix of neighbouring suffixes
    rank, out = np.zeros(n, np.int64), np.zeros((n, left.shape[1] + 1), bool)
    for k in range(left.shape[1] + 1):
        if k:  # the order of suffixes one byte longer, from that of the last step
            rank = np.unique(rank << 8 | left[:, k - 1], return_inverse=True)[1]
        run = np.concatenate(([0], np.cumsum(common_ < length - k)))
        here = np.flatnonzero((low <= k) & (k <= high))
        if not len(here):
            continue
        group = run[here] * n + rank[here]
        by = np.lexsort((doc[here], group))
        begin = vectext.runs(group[by])
        first = np.repeat(doc[here][by][begin], np.diff(np.append(begin, len(by))))
        out[order[here[by]], k] = doc[here][by] > first
    return out


def _states(tables: pa.Table, level: int, width: int = 1) -> np.ndarray:
    """A block's states of a level in the order of its tuples."""
    rows = sorted((p, s) for k, p, s in zip(tables["level"].to_pylist(), tables["part"].to_pylist(), tables["states"].to_pylist(), strict=True) if k == level)
    flat = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(s) for _, s in rows), np.uint8)
    return flat if width == 1 else flat.reshape(-1, width)


def mark_repeats(docs: DataFrame, length: int = 50, seed: int = 24, block_bytes: int = 2 << 20, per_part: int = 250_000) -> DataFrame:
    """One row per document of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    packed = common.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_pack(block_bytes), "block long, n int, ids binary, sizes binary, bytes binary"), "suffix-blocks", "none")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(60, max(32, int(total).bit_length() + 8))
    parts = int(total // (per_part * (length - seed + 2) // 2)) + 1
    before = length - seed  # bytes before an anchor that a window can hold
    none = pa.RecordBatch.from_pylist([], schema=pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("tuples", pa.binary())]))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(*_unpacked(r["n"], r["ids"], r["sizes"], r["bytes"]), length, seed)
                order, head, key, stretch = b.tuples(bits)
                yield _run_batch(list(_runs_of(r["block"], b.ids, b.doc[order[head]], key[head], bits, parts, (stretch[head], STRETCH // 8))))

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        """Second-level tuples of a block: each open name with its stretch, as bytes around the anchor."""
        out = [none]
        for r in left.to_pylist() if right.num_rows else []:
            b = Block(*_unpacked(r["n"], r["ids"], r["sizes"], r["bytes"]), length, seed)
            order, head, _, _ = b.tuples(bits)
            a = b.open_heads(order, head, _states(right, 1))
            if len(a):
                place = b.anchor[a]
                end, begin = b.high[a] + length, b.low[a]
                around = place[:, None] + np.arange(-before, length)
                ok = (around >= begin[:, None]) & (around < end[:, None])
                around = np.where(ok, b.buf[np.where(ok, around, 0)], PAD)
                out.append(_run_batch(list(_runs_of(r["block"], b.ids, b.doc[a], b.seed[a] >> U64(64 - bits), bits, parts, (place - b.high[a], 1), (place - begin, 1), *((around[:, k], 1) for k in range(before + length))))))
        return pa.Table.from_batches(out)

    def settle(group: pa.Table) -> pa.Table:
        """Second-level states of one owner: a byte for each window of each tuple."""
        columns = [np.concatenate(c) for c in zip(*_runs_in(group, *[1] * (2 + before + length)), strict=True)]
        around = np.stack(columns[4:], 1).astype(np.uint8)
        return _packed_states(group, induced(columns[0], columns[1], columns[2].astype(np.int64), columns[3].astype(np.int64), around[:, before:], around[:, :before][:, ::-1], length).astype(np.uint8))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            b = Block(*_unpacked(r["n"], r["ids"], r["sizes"], r["bytes"]), length, seed)
            order, head, key, stretch = b.tuples(bits)
            heads = _states(right, 1)
            states = b.spread(order, head, heads)
            # All anchors of an open name's first document have the windows of its head.
            windows = _states(right, 2, before + 1)
            no = np.full(len(head), -1)
            no[heads == OPEN] = np.arange(len(windows))
            each = np.empty(len(order), np.int64)
            each[order] = np.repeat(no, np.diff(np.append(head, len(order))))
            open_ = np.flatnonzero(states == OPEN)
            which, k = np.nonzero(windows[each[open_]]) if len(open_) else (open_, open_)
            out.append(b.results(b.covered(states == REPEATED, b.anchor[open_][which] - k)))
        empty = Block(np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64), length, seed).results(np.zeros(0, bool))
        return pa.Table.from_batches([*out, empty])

    verdict = "block long, part int, states binary"
    first = common.stored(packed.mapInArrow(anchors, RUN).groupBy("part").applyInArrow(_merge, verdict).withColumn("level", F.lit(1)), "suffix-first", "none")
    tuples = packed.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(contexts, RUN)
    second = common.stored(tuples.groupBy("part").applyInArrow(settle, verdict).withColumn("level", F.lit(2)), "suffix-second", "none")
    return packed.groupBy("block").cogroup(first.unionByName(second).groupBy("block")).applyInArrow(finish, RESULT)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
