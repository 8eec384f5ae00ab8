"""Helpers shared by the training-data operators: shared storage, text hashing, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised helpers take at once; a longer text is taken alone and whole.
SLICE_BYTES = 1 << 18
#: Bytes of an Arrow batch of texts in the operators that ask for it (see `small_batches`).
BATCH_BYTES = 1 << 20

#: Rows of few narrow columns that one task takes, and broadcasts hold, where their number is known.
TASK_ROWS = 100_000

#: What drops the models that tasks of this worker process have kept for later tasks of their kind.
_drops: list[Callable[[], None]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder. Only a local session that has none gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/rowmend-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has saved: once the operators' results are written elsewhere."""
    _delete(spark, shared_dir(spark).rsplit("/", 1)[0])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame, rows: int = 1000, size: int | None = None) -> DataFrame:
    """`df`, after setting its session's Arrow batches to `rows` rows if they are Spark's default: texts can be long.

    With `size`, batches also end at about so many bytes, and Parquet readers hold `rows` rows at once.
    """
    limits = [("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", rows)]
    if size:
        limits += [("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", size), ("spark.sql.parquet.columnarReaderBatchSize", "4096", rows)]
    conf = df.sparkSession.conf
    for name, default, limit in limits:
        if conf.get(name, default) == default:
            conf.set(name, str(limit))
    return df


def save(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write to the shared folder as Parquet and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fitting(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """`df`, which takes `rows` rows in or out at most, in a task for `each` rows, one a core at least, where there are more."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def small(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """`df` (saved, of a few narrow columns) marked for broadcast if it has at most `rows` rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def delete_saved(*frames: DataFrame) -> None:
    """Remove files of tables written by `save` that no later result reads."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/rowmend-" in folder:
                _delete(df.sparkSession, folder)


def lean(run: Callable, keeps: bool = False) -> Callable:
    """`run` of a mapInArrow, after which its worker gives freed memory back: Spark keeps workers, and Arrow and malloc what they once had.

    Unless it `keeps` them, the models that tasks of other kinds have left in the worker are dropped first.
    """

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            drop_models()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    """Return this process's freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def keep_models(drop: Callable[[], None]) -> None:
    """Have `drop` called before tasks of this process that don't keep models."""
    _drops.append(drop)


def drop_models() -> None:
    for drop in _drops:
        drop()


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 3; rows with 1 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def crc_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


# ---------------------------------------------------------------- text in numpy


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of at most `limit` bytes, or one row. Nulls are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    _, off_buf, data_buf = texts.buffers()
    offsets = np.frombuffer(off_buf, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, len(texts))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _placed(code: np.ndarray) -> np.ndarray:
    return mix64(mix64(code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + np.uint64(0xD1B54A32D192ED03))


_PLACED = _placed(np.arange(64 * 256))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (maximal runs without ASCII white space) of all rows, and per row the index of its first."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    begin[cuts] = solid[cuts]
    starts = np.flatnonzero(begin)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    spans = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data) - starts[0]) - np.repeat(starts - starts[0], spans)
    # Each byte at its place has a hash of its own; a word's is mixed from their sum.
    code = place * 256 + data[starts[0] :]
    value = _PLACED[np.minimum(code, len(_PLACED) - 1)]
    far = np.flatnonzero(code >= len(_PLACED))
    value[far] = _placed(code[far])
    value[~solid[starts[0] :]] = 0
    return mix64(np.add.reduceat(value, starts - starts[0])), first


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingle hashes); fewer words than `words` make one shingle, none make none."""
    factors = [np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1) + 0x2545F4914F6CDD1D * k * k) % 2**64 | 1) for k in range(words)]
    for row, end, data, offsets in text_slices(texts):
        hashes, first = word_hashes(data, offsets)
        n = len(hashes) - words + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for k in range(words):
            if n > 0:
                rolled += hashes[k : k + n] * factors[k]
        rolled = mix64(rolled)
        for i in range(end - row):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo >= words:
                yield row + i, np.unique(rolled[lo : hi - words + 1])
            elif hi > lo:
                short = np.uint64(hi - lo)
                total = np.array([short], np.uint64)
                for k in range(hi - lo):
                    total = mix64(total * factors[0] + hashes[lo + k])
                yield row + i, total
            else:
                yield row + i, np.zeros(0, np.uint64)


# ---------------------------------------------------------------- groups within sorted partitions


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], target: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups: the partition must be dealt by and sorted on `keys`. Small groups come together."""
    kept: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        rows += batch.num_rows
        if rows < target:
            continue
        table = pa.Table.from_batches(kept).combine_chunks()
        cut = int(group_starts(table, keys)[-1])
        if cut:
            yield table.slice(0, cut)
            kept = table.slice(cut).to_batches()
            rows = table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(kept).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow with a function from one batch or table to a dict of columns, kept to the schema's order."""
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays([out[n] for n in names], names=names)

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- connected components


class Forest:
    """Union-find over 0..n-1; the smaller root wins."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        up = np.array(self.up, np.int64)
        while (next_up := up[up]).tobytes() != up.tobytes():
            up = next_up
        return up


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges, `TASK_ROWS` or somewhat more at once, become stars around the smallest id: fewer edges, the same components."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) >= TASK_ROWS:
            yield _stars(kept)
            kept = []
    if kept:
        yield _stars(kept)


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    u, v = (np.concatenate([b.column(k).to_numpy() for b in batches]) for k in (0, 1))
    ids, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    forest = Forest(len(ids))
    for a, b in zip(codes[: len(u)].tolist(), codes[len(u) :].tolist(), strict=True):
        forest.union(a, b)
    root = forest.roots()
    out = root != np.arange(len(ids))
    return pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(ids[root[out]])], names=["u", "v"])


def are_stars(edges: DataFrame, rows: int) -> bool:
    """Whether every u of `edges` (u > v, distinct, `rows` at most) has one v, which is no u: then v is its component's smallest id."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("downs"), F.lit(0).alias("ups")), F.struct(F.col("v").alias("id"), F.lit(0).alias("downs"), F.lit(1).alias("ups")))).alias("end"))
    met = fitting(ends.groupBy("end.id").agg(F.sum("end.downs").alias("downs"), F.max("end.ups").alias("ups")), 2 * rows)
    return met.where("downs > 1 or downs = 1 and ups = 1").isEmpty()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, component_id) for every id of `edges` (u, v long; `rows` at most, if that is known) that isn't the smallest of its component.

    Alternating large and small stars on joins and minima; each round is written to the shared folder, so no
    group of edges and no component is ever held by one task. Ends when all edges are stars.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    now = pairs.mapInArrow(lean(_contract), "u long, v long").distinct()
    now = save(now if rows is None else fitting(now, rows))
    while not are_stars(now, rows := now.count()):
        few = F.broadcast if 2 * rows <= TASK_ROWS else lambda df: df
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = fitting(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * rows)
        large = both.join(few(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # a row for each edge
        down = fitting(large.groupBy("u").agg(F.min("v").alias("m")), rows)
        close = large.join(few(down), "u")
        close = close.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        new = save(fitting(close.where("u <> v").distinct(), 2 * rows))
        delete_saved(now)
        now = new
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))


def joined_on(joined: DataFrame, links: DataFrame) -> DataFrame:
    """`components` of all links that `joined` (id, component_id) stands for and of more `links` (u, v long), saved.

    The new links are taken as ones between components, so that only these go through the rounds.
    """
    of, rows = small(joined), links.count()
    for end in ("u", "v"):
        links = links.join(of.select(F.col("id").alias(end), F.col("component_id").alias("of")), end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    more = components(links, rows)
    now = joined.join(small(more).select(F.col("id").alias("component_id"), F.col("component_id").alias("of")), "component_id", "left")
    out = save(now.select("id", F.coalesce("of", "component_id").alias("component_id")).unionByName(more))
    delete_saved(more)
    return out
