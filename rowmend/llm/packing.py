"""Bounded-space online packing of token ids into sequences.

Each task packs the documents of its partition as they come: a fixed number of windows is open, a document goes to the
window it fills best, and when none has room the fullest is topped up with the document's head and emitted. What is
still open at the end (at most `windows` windows a task) is merged: the leftovers of 16 partitions are packed together.

Inputs: null text is an empty text, which has the end id alone; a document longer than a sequence is cut; a null doc_id
is kept. Rows with one doc_id are packed as documents of their own, each with its own starts and tokens. Every id of every
document lies in exactly one piece. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmend.llm.common import BATCH_BYTES, group_starts, lean, save, small_batches, whole_groups
from rowmend.llm.tokens import tokenizer

#: Words whose ids a worker keeps: fewer than the tokenizer's own number, as the worker may hold memory of other stages.
WORDS = 200_000
PIECE = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
NAMES = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]


class Packer:
    """Places pieces (doc_id, start, ids, doc_tokens) into windows of `size` ids; `done` collects emitted windows."""

    def __init__(self, size: int, windows: int | None, min_cut: int = 8):
        self.size, self.windows, self.min_cut = size, windows, min_cut
        self.room: list[tuple[int, int]] = []  # (room left, window number), sorted
        self.open: dict[int, list] = {}
        self.done: list[list] = []
        self.next = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while total - start >= self.size:
            self.done.append([(doc_id, start, ids[start : start + self.size], total)])
            start += self.size
        if start < total:
            self.place((doc_id, start, ids[start:], total))

    def place(self, piece: tuple) -> None:
        doc_id, start, ids, total = piece
        k = bisect_left(self.room, (len(ids), -1))
        if k == len(self.room) and self.windows is not None and len(self.open) >= self.windows:
            room, window = self.room.pop(0)
            if room >= self.min_cut:
                self.open[window].append((doc_id, start, ids[:room], total))
                start, ids = start + room, ids[room:]
            self.done.append(self.open.pop(window))
            k = bisect_left(self.room, (len(ids), -1))
        if k == len(self.room):
            self.open[self.next] = []
            self.room.append((self.size, self.next))
            self.next += 1
            self.room.sort()
            k = bisect_left(self.room, (len(ids), -1))
        room, window = self.room.pop(k)
        self.open[window].append((doc_id, start, ids, total))
        if room == len(ids):
            self.done.append(self.open.pop(window))
        else:
            insort(self.room, (room - len(ids), window))


def _batch(windows: list[list], first: int | None) -> pa.RecordBatch:
    """Rows of the windows; sequence ids count from `first`, or are null for leftovers."""
    rows = [(d, s, np.ascontiguousarray(ids, "<u4").tobytes(), t, None if first is None else first + k, o) for k, w in enumerate(windows) for (d, s, ids, t), o in zip(w, np.cumsum([0] + [len(p[2]) for p in w[:-1]]).tolist(), strict=True)]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=NAMES)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 2048, windows: int = 32, merge: int = 16) -> DataFrame:
    """Pieces of all documents (doc_id, text): doc_id, start, ids (uint32 little-endian), doc_tokens, sequence_id, offset."""

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, task, emitted = Packer(size, windows), TaskContext.get().partitionId(), 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer(tokenizer_path, WORDS).encode(batch.column(1), end_id), strict=True):
                packer.add(doc_id, ids)
                if len(packer.done) >= 256:
                    yield _batch(packer.done, (task << 33) + emitted)
                    emitted += len(packer.done)
                    packer.done = []
        yield _batch(packer.done, (task << 33) + emitted)
        left = _batch(list(packer.open.values()), None)
        yield left.set_column(5, "offset", pa.array([task] * left.num_rows, pa.int64()))  # a leftover's offset holds its task until the merge

    def second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["team"], 1):
            starts = group_starts(table, ["team"])
            for lo, hi in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                part = table.slice(lo, hi - lo)
                packer = Packer(size, None)
                pieces = [(d, s, np.frombuffer(i, "<u4"), t) for d, s, i, t in zip(*(part.column(c).to_pylist() for c in NAMES[:4]), strict=True)]
                for piece in sorted(pieces, key=lambda p: (-len(p[2]), p[0] is None, p[0] or 0, p[1])):
                    packer.place(piece)
                yield _batch(packer.done + list(packer.open.values()), (1 << 62) + (int(part.column("team")[0].as_py()) << 33))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = save(small_batches(texts, size=BATCH_BYTES).mapInArrow(lean(first_round, keeps=True), PIECE))
    left = packed.where("sequence_id is null").withColumn("team", F.floor(F.col("offset") / merge))
    merged = left.repartition("team").sortWithinPartitions("team").mapInArrow(lean(second_round), PIECE)
    return packed.where("sequence_id is not null").unionByName(merged)
