"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, with exception phrases, normalised by length.

Folding: lower case, look-alike letters of other scripts and digit or sign substitutions become Latin letters, l and i
become one letter (1 and ! stand for both), everything but letters and marks becomes one space. Lexicon entries are
folded word starts (" stem") or whole words (" word "). Exception phrases are longer patterns; a match inside one
doesn't count.

The lexicon is learnt from a bounded sample of labelled rows (`FIT_ROWS`, by hash of the id): word starts that a good
share of toxic texts have and clean ones hardly ever, chosen so that each entry explains toxic texts that the entries
before it don't. Two features, the weight found and the weight found for each word, go to a logistic score.

Inputs: null and empty text have weight 0. With no labelled rows the lexicon is empty and scores are 0.5 or below. Of
several labels of one id a toxic one counts; rows with one id are scored each by its own text. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmend.llm.common import delete_saved, save, small_batches

FIT_ROWS = 12_000
# Look-alikes and substitutions.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "i", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
_FOLD = {ord(a): b for a, b in (LOOKALIKES | DIGITS).items()} | {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)}
_OTHER = re.compile(r"[\W\d_]+")
_EDGE_SIGNS = re.compile(r"(?<!\w)[!|$@]+|[!|$@]+(?!\w)")
_ODD = re.compile(f"[0-9@$!|{''.join(LOOKALIKES)}\u200b-\u200d\u2060\ufeff\u00ad]")
STARTS = range(3, 10)
RATIO = 12  # times as common among toxic texts as among clean ones, at least


def folded(text: str) -> str:
    """Folded text with a space before, between and after words."""
    text = text.lower()
    if _ODD.search(text):
        text = (_EDGE_SIGNS.sub(" ", text) if any(s in text for s in "!|$@") else text).translate(_FOLD)
    return " " + _OTHER.sub(" ", text.replace("l", "i")).strip() + " "


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    intercept: float = -2.0
    slopes: tuple[float, float] = (0.0, 0.0)


def candidates(words: set[str]) -> set[str]:
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:k]}" for w in words for k in STARTS if len(w) > k}


def sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of at most `rows` rows of `labels` (doc_id, toxic), by hash of the id, with the text of `docs`."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.where("text is not null").join(F.broadcast(known), "doc_id").select(F.col("text").cast("string").alias("text"), "toxic")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, least: int = 5) -> Lexicon:
    """Learn entries, weights, exceptions and the score's scale from at most `rows` rows of `labels`."""
    known = save(sample(docs, labels, rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (bad if toxic else good).update(candidates(set(folded(text).split())))
        terms = list(bad.keys() | good.keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([bad[t] for t in terms], pa.int64()), pa.array([good[t] for t in terms], pa.int64())], names=["term", "bad", "good"])

    counted = known.mapInArrow(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counted = save(counted.where("bad >= 2 or good >= 2"))
    totals = known.agg(F.count_if(F.col("toxic") == 1).alias("b"), F.count_if(F.col("toxic") != 1).alias("g")).first()
    bad_rows, good_rows = totals["b"], totals["g"]
    found = counted.where((F.col("bad") >= least) & (F.col("good") * bad_rows * RATIO <= F.col("bad") * max(good_rows, 1))).toPandas()
    weight = {t: math.log((b + 0.5) / (bad_rows + 1)) - math.log((g + 0.5) / (good_rows + 1)) for t, b, g in zip(found["term"], found["bad"], found["good"], strict=True)}
    good_of = dict(zip(found["term"], found["good"], strict=True))
    holds: dict[str, set[int]] = defaultdict(set)
    beside: dict[str, set[str]] = defaultdict(set)  # the words before an entry: few where toxic texts are copies

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_: set[tuple[int, str, str]] = set()
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = folded(text).split()
                rows_.update((i, t, before) for before, word in zip(["", *w], w, strict=False) for t in candidates({word}) if t in weight)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_, strict=True) if rows_ else [[]] * 3, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["i", "term", "before"])

    numbered = known.where("toxic = 1").select(F.monotonically_increasing_id().alias("i"), "text")
    for i, t, before in numbered.mapInArrow(hold, "i long, term string, before string").toPandas().itertuples(index=False):  # of the bounded sample, telling terms alone
        holds[t].add(i)
        beside[t].add(before)
    out = Lexicon()
    left = set().union(*holds.values()) if holds else set()
    while left:
        # Most unexplained toxic texts less the clean ones; then the longer entry.
        gain = {t: len(h & left) - 2 * good_of[t] for t, h in holds.items()}
        best = max(gain, key=lambda t: (gain[t], len(t), t), default=None)
        if best is None or gain[best] < least:
            break
        out.weights[best] = weight[best]
        left -= holds.pop(best)
    # Further entries that explain nothing new here but are as telling: common, hardly ever clean, in many contexts.
    for t in sorted(holds, key=lambda t: (-len(holds[t]), -len(t), t)):
        common = len(holds[t]) >= max(4 * least, 0.01 * bad_rows) and good_of[t] * bad_rows * 100 <= len(holds[t]) * good_rows
        nested = any(t.startswith(x) or x.startswith(t) for x in out.weights)
        if common and len(beside[t]) >= 0.4 * len(holds[t]) and not nested:
            out.weights[t] = weight[t]
    out.exceptions = _exceptions(known, counted, out)
    scaled = known.select("text", "toxic").mapInArrow(_features(out), "toxic int, x1 double, x2 double").toPandas()
    out.intercept, out.slopes = _logistic(scaled[["x1", "x2"]].to_numpy(), scaled["toxic"].to_numpy())
    delete_saved(known, counted)
    return out


def _exceptions(known: DataFrame, counted: DataFrame, lexicon: Lexicon) -> list[str]:
    """Words that begin with an entry, and entries' words with the word before them, that clean texts have and toxic ones don't."""
    by_size: dict[int, list[str]] = defaultdict(list)
    for t in lexicon.weights:
        by_size[len(t)].append(t)
    starts = reduce(lambda a, b: a | b, (F.substring("term", 1, n).isin(terms) for n, terms in by_size.items()), F.lit(False))
    words = counted.where(starts & F.col("term").endswith(" ") & (F.col("good") >= 2) & (F.col("bad") == 0)).select("term")

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = folded(text).split()
                found += {(f" {a} {b} ", toxic) for a, b in zip(w, w[1:], strict=False) if not candidates({b}).isdisjoint(lexicon.weights)}
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([int(t == 1) for _, t in found], pa.int64())], names=["term", "toxic"])

    beside = known.select("text", "toxic").mapInArrow(phrases, "term string, toxic long").groupBy("term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    rows = words.unionByName(beside.where("bad = 0 and n >= 3").select("term")).collect()  # of the bounded sample
    return sorted({r["term"] for r in rows} - lexicon.weights.keys())


def _features(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            x = np.array([matcher.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["toxic", "x1", "x2"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[float, float]]:
    """Newton steps with a small ridge; slopes are never negative."""
    if not len(y):
        return -2.0, (0.0, 0.0)
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(3), a.T @ (y - p) - 0.1 * w)
    return float(w[0]), (max(0.0, float(w[1])), max(0.0, float(w[2])))


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.machine = lexicon, ahocorasick.Automaton()
        for t, w in lexicon.weights.items():
            self.machine.add_word(t, (len(t), w))
        for t in lexicon.exceptions:
            self.machine.add_word(t, (len(t), None))
        if len(self.machine):
            self.machine.make_automaton()

    def features(self, text: str | None) -> tuple[float, float]:
        """Weight found, and weight for each word, both on a log scale."""
        if not text or not len(self.machine):
            return 0.0, 0.0
        t = folded(text)
        hits, barred = [], []
        for end, (n, w) in self.machine.iter(t):
            (barred if w is None else hits).append((end - n + 1, end, w))
        if barred:
            # A hit is barred if an exception begins no later and ends no earlier: the farthest end of those that begin so far.
            barred.sort(key=lambda b: b[0])
            starts, ends = [b[0] for b in barred], list(accumulate((b[1] for b in barred), max))
            hits = [h for h in hits if not ((k := bisect_right(starts, h[0])) and ends[k - 1] >= h[1])]
        weight = sum(h[2] for h in hits)
        return math.log1p(weight), math.log1p(100 * weight / max(1, t.count(" ") - 1))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of every row of `docs` (doc_id, text); score 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            x = np.array([matcher.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, 2)
            z = lexicon.intercept + x @ np.array(lexicon.slopes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["doc_id", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
