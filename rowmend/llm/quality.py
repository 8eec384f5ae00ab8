"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

A text's features are its byte 4-grams and 8-grams, each kind hashed into `BUCKETS` buckets. Two generative models, one of the target texts
and one of all raw texts, give each text a log importance weight, the log ratio of its probabilities; beyond `LENGTH` n-grams it is scaled
to that length, else the length of a text and not its kind would decide. Texts are sampled
without replacement in proportion to the weights: each gets its log weight plus Gumbel noise (from a hash of its id, so
a rerun draws the same) and the k highest stay, where k is the number of texts that the models don't put in the raw
model's favour by more than `slack` nats. The k-th key is found exactly by counting keys in ever finer ranges.

The target model may come from a bounded sample of labelled rows (`FIT_ROWS`); the raw model counts every text.

Inputs: null texts and texts under four bytes have no n-grams, log weight 0 and take part like others. Without target
texts both models agree and everything stays. Rows repeated under one id draw the same noise and stay or go together;
at the k-th key ties stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmend.llm.common import BATCH_BYTES, lean, save, small_batches, text_slices

SIZES, BUCKETS = (4, 8), 1 << 16
LENGTH = 400
FIT_ROWS = 20_000
PRIOR = 0.03  # weight of the raw model in the target model, as a share of the target's n-grams


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Buckets of all byte n-grams (n is 4 or 8) of a slice, those across two texts too."""
    if len(data) < n:
        return np.zeros(0, np.int64)
    data = np.ascontiguousarray(data)
    if n == 4:
        every = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
        return (every * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64)
    every = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return (every * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).view(np.int64) + BUCKETS


def _spans(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end position of each text's own n-grams."""
    return offsets[:-1], np.maximum(offsets[1:] - (n - 1), offsets[:-1])


def gram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all buckets over every text of `texts` (text): summed in the tasks, then by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                for n in SIZES:
                    g = _grams(data, n)
                    tails = np.unique((offsets[1:-1, None] - np.arange(1, n)).ravel())  # starts of those across two texts
                    total += np.bincount(g, minlength=2 * BUCKETS) - np.bincount(g[tails[(tails >= 0) & (tails < len(g))]], minlength=2 * BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["bucket", "n"])

    out = np.zeros(2 * BUCKETS)
    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2 * BUCKETS rows
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the two models by bucket, the target's smoothed by the raw one; 0 where either has seen nothing at all."""
    if not target.sum() or not raw.sum():
        return np.zeros(2 * BUCKETS)
    q = (raw + 0.1) / (raw.sum() + 0.2 * BUCKETS)
    weight = PRIOR * target.sum()
    p = (target + weight * q) / (target.sum() + weight)
    return np.log(p) - np.log(q)


def log_weights(docs: DataFrame, ratio: np.ndarray, names: tuple[str, str]) -> DataFrame:
    """`docs` (text and any columns) with the number of n-grams and the log weight under `names`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, data, offsets in text_slices(batch.column("text")):
                own, found = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1)
                for size in SIZES:
                    sums = np.concatenate([[0.0], np.cumsum(ratio[_grams(data, size)])])
                    lo, hi = _spans(offsets, size)
                    lo = np.minimum(lo, len(sums) - 1)
                    hi = np.maximum(np.minimum(hi, len(sums) - 1), lo)
                    own += hi - lo
                    found += sums[hi] - sums[lo]
                n.append(own)
                weight.append(found * np.minimum(1.0, LENGTH / np.maximum(own, 1)))
            added = [pa.array(np.concatenate(n)), pa.array(np.round(np.concatenate(weight), 6))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lean(run), f"{full}, `{names[0]}` long, `{names[1]}` double")


def kth_largest(df: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest value of a double column: 12 bits of its order at a time, counted in Spark."""
    # Doubles as text in hexadecimal don't sort; this maps them to longs that do.
    scaled = df.where(F.col(key).isNotNull()).select(F.greatest(F.lit(-(2**52)), F.least(F.lit(2**52), F.round(F.col(key) * 2**20).cast("long"))).alias("v"))
    low, width, left = -(2**52), 2**54, k
    while width > 1:
        step = max(1, width // 4096)
        bins = scaled.where((F.col("v") >= low) & (F.col("v") < low + width)).groupBy(F.floor((F.col("v") - low) / step).alias("b")).count().toPandas().sort_values("b", ascending=False)
        above = 0
        for b, n in zip(bins["b"].tolist(), bins["count"].tolist(), strict=True):
            if above + n >= left:
                low, width, left = low + int(b) * step, step, left - above
                break
            above += n
        else:
            return None
    return low / 2**20


def resample(docs: DataFrame, target: DataFrame, slack: float = 30.0, seed: int = 7, names: tuple[str, ...] = ("n_grams", "log_weight", "key", "selected")) -> DataFrame:
    """`docs` (doc_id, text and any columns) with the four columns of `names`, against `target` (text).

    Columns of `docs` that clash with `names` give way. The texts are read three times and never shuffled: for the raw
    model, for the keys, and for the result, which draws the same keys again.
    """
    docs = small_batches(docs, size=BATCH_BYTES).drop(*[c for c in docs.columns if c.lower() in names])
    n_grams, weight, key, selected = names
    ratio = log_ratio(gram_counts(target), gram_counts(docs))
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.lit(2**40)).cast("double") + 0.5) / 2**40
    drawn = F.round((F.col(weight) - F.log(-F.log(uniform))) * 2**20) / 2**20
    keys = save(log_weights(docs.select("doc_id", "text"), ratio, (n_grams, weight)).select(F.col(weight), drawn.alias(key)))
    k = keys.where(F.col(weight) >= -slack).count()
    bar = kth_largest(keys, key, k) if k else None
    out = log_weights(docs, ratio, (n_grams, weight)).withColumn(key, drawn)
    return out.withColumn(selected, (F.col(key) >= bar) if bar is not None else F.lit(False))
