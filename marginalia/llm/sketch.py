"""Count sketches of fixed size: sums of hashed counters over all rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 4096


def _merge(group: pa.Table) -> pa.Table:
    codec, total = pa.Codec("zstd"), np.zeros(CHUNK, np.int64)
    for blob in group["counts"]:
        total += np.frombuffer(codec.decompress(blob.as_py(), CHUNK * 8), np.int64)
    return pa.table({"chunk": group["chunk"].slice(0, 1), "counts": pa.array([codec.compress(total.tobytes(), asbytes=True)], pa.binary())})


def totals(df: DataFrame, slots_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], size: int) -> np.ndarray:
    """`size` counters (a multiple of CHUNK): how often slots_of names each slot. They come to the driver, as many whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(size, np.int64), [], 0
        for slots in slots_of(batches):
            held.append(slots)
            n += len(slots)
            if n > size // 4:  # often enough for a bounded list, seldom enough for the cost of all counters
                total += np.bincount(np.concatenate(held), minlength=size)
                held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size)
        pieces, codec = total.reshape(-1, CHUNK), pa.Codec("zstd")
        some = np.flatnonzero(pieces.any(1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([codec.compress(pieces[k].tobytes(), asbytes=True) for k in some], pa.binary())], names=["chunk", "counts"])

    merged = df.mapInArrow(run, "chunk int, counts binary")
    for salts in (16, 1):  # task sketches merge in two steps
        merged = merged.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(salts))).groupBy("chunk", "salt").applyInArrow(_merge, "chunk int, counts binary")
    codec, total = pa.Codec("zstd"), np.zeros((size // CHUNK, CHUNK), np.int64)
    for r in merged.collect():
        total[r["chunk"]] = np.frombuffer(codec.decompress(bytes(r["counts"]), CHUNK * 8), np.int64)
    return total.ravel()
