"""Token-ID output: best-fit-decreasing packing into fixed rows.

Each task tokenises whole texts, adds an end token, splits what is longer than
a row into row-sized pieces without loss, and packs pieces by best fit in
decreasing order. A segment tree over capacities finds the fullest open row
that still takes a piece. Packing works on buffers of ``buffer_tokens``, so a
task's memory is bounded whatever its partition holds.

A task writes, below the folder given: ``ids-*.bin``, the matrix of ids in
rows of ``seq_len`` little-endian unsigned integers, unused places holding the
end token; ``cu-*.npy``, pairs of (row, cumulative segment length), each row
beginning with 0; and ``resets-*.npy``, pairs of (row, place) at which positions
start again at 0. The vocabulary is read on the driver and travels by broadcast.

Defined cases: null and empty texts are one end token; repeated rows are each
packed; a null id stays null; an empty table writes nothing.
"""

from __future__ import annotations

import base64
import importlib.util
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import filesystem, written
from .store import shared_dir, stored

SEGMENT = "doc_id bigint, piece int, n_pieces int, file string, row bigint, start int, length int"


@dataclass(frozen=True)
class Vocabulary:
    """A rank file of a public byte-level BPE, the module beside it that names its split pattern, and a free id to end texts."""

    path: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    module: str = "/opt/tokenizers/__init__.py"
    end: int = 50256

    def read(self) -> tuple[str, dict[bytes, int]]:
        """The split pattern and the ranks, read where it is called: on the driver."""
        spec = importlib.util.spec_from_file_location("_vocabulary", self.module)
        known = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(known)
        with open(self.path, "rb") as f:
            return known.PATTERN, {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    def load(self):
        return encoding(*self.read())


def encoding(pattern: str, ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts as unsigned integers, the end id last."""

    def __init__(self, pattern: str, ranks: dict[bytes, int], end: int):
        self.encoding, self.end = encoding(pattern, ranks), end
        self.dtype = np.dtype("<u2" if max(self.encoding.max_token_value, end) < 65536 else "<u4")

    def __call__(self, text: str) -> np.ndarray:
        return np.array([*self.encoding.encode_ordinary(text), self.end], self.dtype)


class Capacities:
    """Which capacities 0..top some open row has: a segment tree of counts, searched for the least one that is enough."""

    def __init__(self, top: int):
        self.size = 1 << max(1, top.bit_length())
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, need: int) -> int:
        """The least capacity >= need in use, or -1."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(lengths: np.ndarray, seq_len: int) -> list[list[int]]:
    """Rows as lists of piece numbers; pieces in decreasing order, each to the fullest row that takes it."""
    rows, open_rows, tree = [], {}, Capacities(seq_len)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = tree.least(n)
        if room < 0:
            row, room = len(rows), seq_len
            rows.append([])
        else:
            row = open_rows[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        if room > n:
            open_rows.setdefault(room - n, []).append(row)
            tree.add(room - n, 1)
    return rows


def pack(docs: DataFrame, to: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: Vocabulary = Vocabulary(), seq_len: int = 2048, buffer_tokens: int = 1 << 20) -> DataFrame:
    """Writes the matrices and returns the stored rows of SEGMENT."""
    to = to or f"{shared_dir(docs.sparkSession)}/packed"
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        encoder = Encoder(*shipped.value, vocabulary.end)
        part, base = f"{TaskContext.get().partitionId():06d}", 0
        name = f"{to}/ids-{part}.bin"
        cu, resets, pieces, held = [], [], [], 0

        def flush(out) -> pa.RecordBatch:
            nonlocal base, pieces, held
            rows = best_fit(np.array([len(p[3]) for p in pieces]), seq_len)
            matrix = np.full((len(rows), seq_len), encoder.end, encoder.dtype)
            found, sums, begins = [], [], []
            for r, members in enumerate(rows):
                at = 0
                sums.append((base + r, 0))
                for i in members:
                    doc, k, n, ids = pieces[i]
                    matrix[r, at : at + len(ids)] = ids
                    found.append((doc, k, n, name, base + r, at, len(ids)))
                    begins.append((base + r, at))
                    at += len(ids)
                    sums.append((base + r, at))
            out.write(matrix.tobytes())
            cu.append(np.array(sums, np.int64))
            resets.append(np.array(begins, np.int64))
            base, pieces, held = base + len(rows), [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "piece", "n_pieces", "file", "row", "start", "length"])

        def all_batches():
            yield first
            yield from batches

        with written(name) as out:
            for batch in all_batches():
                for doc, text in zip(batch.column(0), batch.column(1)):
                    ids = encoder(text.as_py() or "")
                    n = -(-len(ids) // seq_len)
                    for k in range(n):
                        pieces.append((doc.as_py(), k, n, ids[k * seq_len : (k + 1) * seq_len]))
                        held += len(pieces[-1][3])
                        if held >= buffer_tokens:
                            yield flush(out)
            if pieces:
                yield flush(out)
        for kind, values in (("cu", cu), ("resets", resets)):
            packed = io.BytesIO()
            np.save(packed, np.concatenate(values))
            with written(f"{to}/{kind}-{part}.npy") as out:
                out.write(packed.getvalue())

    return stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SEGMENT))


def read_ids(segments: DataFrame, seq_len: int = 2048, dtype: str = "<u2") -> DataFrame:
    """The ids of each segment from the files: SEGMENT and ids (array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(dtype).itemsize
        for batch in batches:
            ids = []
            for file, row, start, length in zip(*(batch.column(c).to_pylist() for c in ("file", "row", "start", "length"))):
                fs, path = filesystem(file)
                with fs.open_input_file(path) as f:
                    f.seek((row * seq_len + start) * width)
                    ids.append(np.frombuffer(f.read(length * width), dtype).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

    return segments.mapInArrow(run, SEGMENT + ", ids array<int>")
