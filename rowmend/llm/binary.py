"""Token-id output: canonical length-limited Huffman codes from global counts, independent blocks, table-driven decoding.

The file format is a folder of two Parquet tables, so that any store Spark writes to can hold it. `codebook` has the
code length of each id (canonical codes follow from the lengths). `blocks` has one row per block: the documents it
holds, the bit stream, and a checkpoint (the bits used) for every `SEGMENT` ids, from which all segments of a block are
decoded side by side. Documents lie in ascending doc_id order over parts and blocks; each block can be read alone.

Inputs: null text is an empty text, which has the end id alone; null doc_ids come first; repeated doc_ids follow each
other. An empty table gives empty files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowmend.llm.common import delete_saved, save, small_batches
from rowmend.llm.tokens import narrow, tokenizer, widen

LIMIT = 18
SEGMENT = 128
BLOCK = 1 << 17
BLOCKS = "part int, block int, first long, doc_ids array<long>, doc_tokens array<long>, checkpoints binary, bits binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for positive counts, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit in codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    lists, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        lists.append(by < n)
        both = both[by]
        packages = both[0 : len(both) // 2 * 2 : 2] + both[1 : len(both) // 2 * 2 : 2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(lists):
        used = int(is_leaf[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes: by length, then id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = np.asarray(ids, np.int64)[order], np.asarray(lengths, np.int64)[order]
        self.codes = np.zeros(len(order), np.uint64)
        code, last = 0, 0
        for k, n in enumerate(self.lengths.tolist()):
            code <<= n - last
            self.codes[k], last = code, n
            code += 1
        self.longest = int(self.lengths[-1]) if len(order) else 0

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Bit stream (big-endian 32-bit words) and the bits used by each segment."""
        top = int(max(self.ids.max(), ids.max())) + 1
        length, code = np.zeros(top, np.int64), np.zeros(top, np.uint64)
        length[self.ids], code[self.ids] = self.lengths, self.codes
        n, c = length[ids], code[ids]
        at = np.concatenate([[0], np.cumsum(n)])
        word, shift = at[:-1] >> 5, (64 - n - (at[:-1] & 31)).astype(np.uint64)
        wide = c << shift
        total = int(at[-1] + 31 >> 5) + 1
        # The codes' bits don't overlap, so sums of them stay exact in doubles.
        words = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), total) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), total + 1)[:total]
        used = np.add.reduceat(n, np.arange(0, len(n), SEGMENT))
        return words.astype(np.uint64).astype(">u4").tobytes(), used.astype("<u2").tobytes()

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For every value of the next `longest` bits: the id and its code's length."""
        spans = 1 << (self.longest - self.lengths)
        ids, lengths = np.repeat(self.ids, spans), np.repeat(self.lengths, spans)
        missing = (1 << self.longest) - len(ids)
        return np.concatenate([ids, np.zeros(missing, np.int64)]).astype(np.uint32), np.concatenate([lengths, np.ones(missing, np.int64)]).astype(np.int64)


def decode(bits: bytes, checkpoints: bytes, n: int, table: tuple[np.ndarray, np.ndarray], longest: int) -> np.ndarray:
    words = np.concatenate([np.frombuffer(bits, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
    used = np.frombuffer(checkpoints, "<u2").astype(np.int64)
    at = np.concatenate([[0], np.cumsum(used)[:-1]])
    lanes = len(at)
    out = np.zeros((SEGMENT, lanes), np.uint32)
    mask, ids, lengths = np.uint64((1 << longest) - 1), *table
    for k in range(min(SEGMENT, n)):
        if k == n - (lanes - 1) * SEGMENT:  # the last segment may be shorter
            lanes -= 1
            at = at[:lanes]
        word = at >> 5
        both = (words[word] << np.uint64(32)) | words[word + 1]
        key = (both >> (64 - longest - (at & 31)).astype(np.uint64)) & mask
        out[k, :lanes] = ids[key]
        at = at + lengths[key]
    return out.T.reshape(-1)[:n]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, parts: int | None = None) -> None:
    """Encode the texts of `docs` (doc_id, text) and write them to `path` in ascending doc_id order."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, held = [], []
            for ids in tokenizer(tokenizer_path).encode(batch.column(1), end_id):
                sizes.append(len(ids))
                held.append(narrow(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(held, pa.binary())], names=["doc_id", "n", "ids"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for size, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = np.bincount(widen(x.as_buffer(), size))
                if len(n) > len(total):
                    n[: len(total)] += total
                    total = n
                else:
                    total[: len(n)] += n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = save(small_batches(texts).mapInArrow(encode, "doc_id long, n long, ids binary"))
    counts = tokens.select("n", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most one row an id of the vocabulary
    lengths = code_lengths(counts["n"].to_numpy(np.int64))
    book_rows = spark.createDataFrame(counts.assign(bits=lengths)[["id", "bits"]].astype("int64"), "id long, bits long") if len(counts) else spark.createDataFrame([], "id long, bits long")
    book_rows.coalesce(1).write.parquet(f"{path}/codebook")
    ids = counts["id"].to_numpy(np.int64)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, part, number, first = Codebook(ids, lengths), TaskContext.get().partitionId(), 0, 0
        doc_ids, held, size = [], [], 0

        def block() -> pa.RecordBatch:
            bits, checkpoints = book.encode(np.concatenate(held))
            row = [[part], [number], [first], [doc_ids], [[len(h) for h in held]], [checkpoints], [bits]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(row, types, strict=True)], names=["part", "block", "first", "doc_ids", "doc_tokens", "checkpoints", "bits"])

        for batch in batches:
            for doc_id, n, x in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2), strict=True):
                doc_ids.append(doc_id)
                held.append(widen(x.as_buffer(), n))
                size += len(held[-1])
                if size >= BLOCK:
                    yield block()
                    number, first, doc_ids, held, size = number + 1, first + size, [], [], 0
        if held:
            yield block()

    sized = (parts, "doc_id") if parts else ("doc_id",)
    dealt = tokens.repartitionByRange(*sized).sortWithinPartitions("doc_id", "ids")
    dealt.mapInArrow(blocks, BLOCKS).write.parquet(f"{path}/blocks")
    delete_saved(tokens)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files; start: the ids of all documents before it."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()  # at most one row an id of the vocabulary
    ids, lengths = book["id"].to_numpy(np.int64), book["bits"].to_numpy(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Codebook(ids, lengths)
        table = code.table() if len(ids) else None
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["doc_tokens"], np.int64)
                out = decode(row["bits"], row["checkpoints"], int(sizes.sum()), table, code.longest)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + ends - sizes), pa.array([out[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)], pa.binary())],
                    names=["doc_id", "start", "ids"],
                )

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # One row a part (the number of parts is that of the write's tasks), so the running sum is small.
    parts = blocks.select("part", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.join(F.broadcast(parts.select("part", before.alias("base"))), "part").withColumn("base", F.col("base") + F.col("first"))
    return blocks.select("doc_ids", "doc_tokens", "checkpoints", "bits", "base").mapInArrow(run, "doc_id long, start long, ids binary")
