"""Language ID by compression: per-language zstandard raw-content dictionaries, the smallest encoding wins.

A text is cut into chunks that are each compressed with every language's dictionary, so that the dictionary counts all
along a long text; the language with the smallest sum is the guess. A guess is rejected where the runner-up needs less
than `margin` more bytes (as a share of the winner's).

Dictionaries come from a bounded sample of labelled rows: `DOCS` documents a language, by hash of the id, and of each
the first `SLICE` bytes (training only; texts to be identified are always taken whole).

Inputs: null text or text without a letter gives `und`, score 0, rejected. With no labelled rows every row is `und`.
Ties go to the language with more labelled rows, then to the one that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmend.llm.common import BATCH_BYTES, lean, small_batches

DOCS, SLICE, CHUNK, LEVEL = 48, 2048, 4096, 5
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case words of the whole text; signs and digits tell no language."""
    return _OTHER.sub(" ", text.lower()).encode()


def fit(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionary content by language from (doc_id, text, lang); at most DOCS * SLICE bytes a language."""
    rows = labelled.where("lang is not null and doc_id is not null and length(text) > 0")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = rows.select("doc_id", "lang").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DOCS)
    texts = rows.join(F.broadcast(picked.select("doc_id", "rank").dropDuplicates(["doc_id"])), "doc_id")  # DOCS rows a language
    sample = texts.select("lang", "rank", "doc_id", F.substring("text", 1, SLICE).alias("text")).toPandas().sort_values(["lang", "rank", "doc_id"])
    rows_of = dict(rows.groupBy("lang").count().collect())
    made = {lang: b"".join(letters(t)[:SLICE] for t in part["text"]) for lang, part in sample.groupby("lang")}
    return dict(sorted(made.items(), key=lambda x: (-rows_of[x[0]], x[0])))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.005, names: tuple[str, ...] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """`docs` (text and any columns) with guess, score (0 to 1) and rejection under `names`; clashing columns of `docs` give way."""
    languages = list(dictionaries)  # in order of preference
    schema = f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean"
    made: list = []

    def sizes(text: str) -> np.ndarray:
        data = letters(text)
        total = np.zeros(len(languages), np.int64)
        for at in range(0, len(data), CHUNK):
            chunk = data[at : at + CHUNK]
            for k, c in enumerate(made):
                total[k] += len(c.compress(chunk))
        return total

    def verdict(text: str | None) -> tuple[str, float, bool]:
        if not text or not languages or not _LETTER.search(text):
            return "und", 0.0, True
        if len(languages) == 1:
            return languages[0], 1.0, False
        total = sizes(text)
        best, second = np.argsort(total, kind="stable")[:2]
        gap = (total[second] - total[best]) / total[best]
        return languages[best], float(1 - np.exp(-100 * gap)), bool(gap < margin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        if not made:
            for lang in languages:
                content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                content.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False))
        for batch in batches:
            found = [verdict(t) for t in batch.column("text").to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [[], [], []]
            added = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    clash = [c for c in docs.columns if c.lower() in names]
    kept = small_batches(docs.drop(*clash), size=BATCH_BYTES)
    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(lean(run), f"{full}, {schema}")
