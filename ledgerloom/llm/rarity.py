"""How often shingles occur in a corpus, as a table of fixed size.

Each task counts the shingles of all its texts into buckets by hash; the parts
are added up 64 at a time until one is left, which reaches the driver as one
byte for each bucket: its class, four steps for each doubling of the count. The
class of a shingle is thus a rule that all tasks share; several shingles may
share a bucket, which makes a class too high and never changes what is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .text import FOLD, chunks

#: Buckets of one slice of the table.
SLICE_BITS = 16
FAN = 64
_PART = "part bigint, slice int, size int, counts binary"


def _packed(counts: np.ndarray) -> bytes:
    return pa.compress(counts.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=(1 << SLICE_BITS) * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _counted(k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            for chunk in chunks(batch.column(0), FOLD):
                if table is None:
                    table = np.zeros(1 << bits, np.uint32)
                np.add.at(table, (chunk.shingles(k)[0] >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        for i, counts in enumerate([] if table is None else table.reshape(-1, 1 << SLICE_BITS)):
            if counts.any():
                data = _packed(np.minimum(counts, 65_535).astype(np.uint16))
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([i], pa.int32()), pa.array([2], pa.int32()), pa.array([data], pa.binary())], ["part", "slice", "size", "counts"])

    return run


def _added(part: pa.Table) -> pa.Table:
    total = np.zeros(1 << SLICE_BITS, np.uint64)
    for size, data in zip(part["size"].to_pylist(), part["counts"]):
        total += _unpacked(data.as_py(), {2: np.uint16, 8: np.uint64}[size])
    return pa.table({"part": pa.array([part["part"][0].as_py() // FAN], pa.int64()), "slice": part["slice"].slice(0, 1), "size": pa.array([8], pa.int32()), "counts": pa.array([_packed(total)], pa.binary())})


def classes(texts: DataFrame, k: int, bits: int) -> np.ndarray:
    """The class of each bucket. texts: one column of texts."""
    spark = texts.sparkSession
    scratch = Scratch(spark)
    parts = scratch(texts.mapInArrow(_counted(k, bits), _PART))
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = parts.groupBy("slice", F.floor(F.col("part") / FAN)).applyInArrow(_added, _PART)
        left = -(-left // FAN)
        if left == 1:
            break
    out = np.zeros(1 << bits, np.uint8)
    got = parts.select("slice", "counts").toArrow()
    for i, data in zip(got["slice"].to_pylist(), got["counts"]):
        counts = _unpacked(data.as_py(), np.uint64)
        out[i << SLICE_BITS : (i + 1) << SLICE_BITS] = np.minimum(255, np.round(4 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)
    scratch.clear()
    return out
