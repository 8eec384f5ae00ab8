"""Ranked lexical search: the k best documents of every item, exactly, by trees over items and documents.

An item's terms have weights and a document's terms impacts (integers, never negative), so a score is a sum of products.
Documents are dealt by their strongest term into blocks of at most `BLOCK`; a block's tree holds, for every node, the
highest impact of each term below it. Items form a tree of their own, a node holding all terms below it. A pair of nodes
can't hold a score above the sum of weight times highest impact over the node's terms, so it is dropped, with all its
items and documents, where that is below the weakest k-th score of these items. Otherwise the taller side is opened; what
is left are single items and leaves, taken in falling order of their bounds and scored.

K-th scores to start with come from each item's `SEEDS` blocks of highest bound. A task goes on with the k-th scores of the
blocks that it has searched, and returns at most k documents an item.

Terms are maximal runs of ASCII letters and digits and of all code points above 127, A-Z lower-cased. Items are taken in
turns of about `TURN` distinct terms, so that what reaches the driver and the tasks (an item's terms, their document
counts) is bounded by that or by one item; all documents' counts are made by Spark.

Inputs: null and empty texts hold no term. Rows with one item_id are one item, with the terms of all; a null item_id is an
id. Every document row counts, repeated rows and null ids too; a null doc_id comes after all others. Empty tables give
empty results.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmend.llm.common import delete_saved, save, small_batches

BLOCK, LEAF, FAN, ITEM_FAN, SEEDS, TURN = 2048, 16, 8, 4, 2, 200_000
LAST = np.iinfo(np.int64).max
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in order, as UTF-8."""
    return (text or "").encode().translate(_TERM).split()


def _segments(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of some rows, and where each row starts among them. No row is empty."""
    size = ptr[rows + 1] - ptr[rows]
    start = np.concatenate([[0], np.cumsum(size)])
    return np.arange(start[-1]) - np.repeat(start[:-1] - ptr[rows], size), start[:-1]


class Documents:
    """The tree of a block: documents in order of their strongest terms, nodes of LEAF documents, then of FAN nodes."""

    def __init__(self, ids: np.ndarray, ptr: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.ids = ids
        self.levels = [(ptr, term, impact)]
        fan = LEAF
        while len(self.levels[-1][0]) > 2 or len(self.levels) == 1:
            self.levels.append(self._above(*self.levels[-1], fan))
            fan = FAN

    @staticmethod
    def _above(ptr: np.ndarray, term: np.ndarray, impact: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node = np.repeat(np.arange(len(ptr) - 1) // fan, np.diff(ptr))
        by = np.lexsort((term, node))
        node, term, impact = node[by], term[by], impact[by]
        first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (term[1:] != term[:-1])]))
        kept = node[first]
        return np.searchsorted(kept, np.arange(node[-1] + 2)), term[first], np.maximum.reduceat(impact, first)

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        fan = LEAF if level == 1 else FAN
        out = (nodes[:, None] * fan + np.arange(fan)).ravel()
        return out[out < len(self.levels[level - 1][0]) - 1]


class Items:
    """The tree of items: terms as sorted ids; a node's terms are those of all items below it."""

    def __init__(self, names: list, held: list[np.ndarray], weight: np.ndarray):
        by = sorted(range(len(held)), key=lambda i: sorted(held[i].tolist(), key=lambda t: (-int(weight[t]), t))[:4])
        self.names, self.weight = [names[i] for i in by], weight
        self.terms, self.kids, self.first, self.last, self.height = [held[i] for i in by], [[]] * len(by), list(range(len(by))), list(range(1, len(by) + 1)), [0] * len(by)
        level = list(range(len(by)))
        while len(level) > 1:
            groups = [level[k : k + ITEM_FAN] for k in range(0, len(level), ITEM_FAN)]
            level = []
            for g in groups:
                level.append(len(self.terms))
                self.terms.append(np.unique(np.concatenate([self.terms[i] for i in g])))
                self.kids.append(g)
                self.first.append(self.first[g[0]])
                self.last.append(self.last[g[-1]])
                self.height.append(self.height[g[0]] + 1)
        self.root = level[0]


class Search:
    """The best k documents of every item over the blocks given one after another."""

    def __init__(self, items: Items, k: int, floor: np.ndarray | None = None):
        n = len(items.names)
        self.items, self.k, self.scored, self.all = items, k, 0, 0
        self.score, self.id = [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        self.floor = np.ones(n, np.int64) if floor is None else floor.copy()
        self.dense = np.zeros(len(items.weight), np.int64)

    def run(self, docs: Documents, only: list[int] | None = None) -> None:
        self.docs = docs
        top = len(docs.levels) - 1
        self.all += len(docs.ids) * (len(only) if only else len(self.items.names))
        for a in only or [self.items.root]:
            self._pairs(a, top, np.arange(len(docs.levels[top][0]) - 1))

    def _sums(self, a: int, level: int, nodes: np.ndarray) -> np.ndarray:
        """Sums of weight times (highest) impact over the terms of item node `a`, exact in 64 bits."""
        ptr, term, impact = self.docs.levels[level]
        at, start = _segments(ptr, nodes)
        held = self.items.terms[a]
        self.dense[held] = self.items.weight[held]
        out = np.add.reduceat(self.dense[term[at]] * impact[at], start)
        self.dense[held] = 0
        return out

    def _pairs(self, a: int, level: int, nodes: np.ndarray) -> None:
        items = self.items
        bounds = self._sums(a, level, nodes)
        near = bounds >= self.floor[items.first[a] : items.last[a]].min()
        nodes, bounds = nodes[near], bounds[near]
        if not len(nodes):
            return
        if items.height[a] and items.height[a] >= level - 1:
            for c in items.kids[a]:
                self._pairs(c, level, nodes)
        elif level > 1:
            self._pairs(a, level - 1, self.docs.below(level, nodes))
        else:
            self._leaves(a, nodes, bounds)

    def _leaves(self, a: int, nodes: np.ndarray, bounds: np.ndarray) -> None:
        by = np.argsort(-bounds, kind="stable")
        for lo in range(0, len(by), 16):
            part = by[lo : lo + 16]
            part = part[bounds[part] >= self.floor[a]]
            if not len(part):
                return
            rows = self.docs.below(1, nodes[part])
            scores = self._sums(a, 0, rows)
            self.scored += len(rows)
            fit = scores >= self.floor[a]
            if fit.any():
                score, ids = np.concatenate([self.score[a], scores[fit]]), np.concatenate([self.id[a], self.docs.ids[rows[fit]]])
                best = np.lexsort((ids, -score))[: self.k]
                self.score[a], self.id[a] = score[best], ids[best]
                if len(best) == self.k:
                    self.floor[a] = max(self.floor[a], self.score[a][-1])

    def found(self) -> pa.RecordBatch:
        sizes = [len(s) for s in self.score]
        names = [n for n, c in zip(self.items.names, sizes, strict=True) for _ in range(c)]
        columns = [pa.array(names, pa.int64()), pa.array(np.concatenate(self.id)), pa.array(np.concatenate(self.score))]
        return pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])


FOUND = "item_id long, doc_id long, score long"


def _vectors(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf) of all documents with a term: n counts all terms, the arrays hold the numbered ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found := terms(text):
                    held = Counter(map(numbers.get, found))
                    held.pop(None, None)
                    ids = sorted(held)
                    out.append((LAST if i is None else i, len(found), ids, [held[t] for t in ids]))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=["doc_id", "n", "term", "tf"])

    rows = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


def _blocks(vectors: DataFrame, weight: np.ndarray, n_docs: int, n_terms: int, block: int) -> DataFrame:
    """(block, tree, term, impact): trees of documents with similar strongest terms, and the highest impacts at their roots."""

    def impacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            term, tf = batch.column("term"), batch.column("tf")
            ptr = np.concatenate([[0], np.cumsum(term.value_lengths().to_numpy())])
            t, f = term.flatten().to_numpy(), tf.flatten().to_numpy()
            m = 50 + (50 * batch.column("n").to_numpy() * n_docs) // n_terms
            x = (1_000_000_000 * f) // (1000 * f + 20 * np.repeat(m, np.diff(ptr)))
            row = np.repeat(np.arange(batch.num_rows), np.diff(ptr))
            best = np.lexsort((t, -x * weight[t], row))[ptr[:-1]]
            x = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), term, x, pa.array(t[best])], names=["doc_id", "term", "impact", "lead"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                kept.append(batch.slice(lo, block))
                while sum(b.num_rows for b in kept) >= block:
                    whole = pa.Table.from_batches(kept)
                    yield tree(whole.slice(0, block))
                    kept = whole.slice(block).to_batches()
        if sum(b.num_rows for b in kept):
            yield tree(pa.Table.from_batches(kept))

    def tree(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        term, impact = rows.column("term").chunk(0), rows.column("impact").chunk(0)
        ptr = np.concatenate([[0], np.cumsum(term.value_lengths().to_numpy())])
        docs = Documents(rows.column("doc_id").to_numpy(), ptr, term.flatten().to_numpy(), impact.flatten().to_numpy())
        _, top, most = docs.levels[-1]
        columns = [pa.array([pickle.dumps(docs, 5)], pa.binary()), pa.array([top], pa.list_(pa.int32())), pa.array([most], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["tree", "term", "impact"])

    rows = vectors.where(F.size("term") > 0).mapInArrow(impacts, "doc_id long, term array<int>, impact array<long>, lead int")
    salted = rows.withColumn("salt", F.xxhash64("doc_id", "term"))
    dealt = salted.repartitionByRange("lead", "salt").sortWithinPartitions("lead", "salt").drop("lead", "salt")
    return dealt.mapInArrow(grow, "tree binary, term array<int>, impact array<long>").withColumn("block", F.expr("uuid()"))


def _seeds(blocks: DataFrame, items: Items) -> DataFrame:
    """(item, block): each item's blocks of highest bound at the root; a task passes on SEEDS an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, str]]] = [[] for _ in items.names]
        dense = np.zeros(len(items.weight), np.int64)
        for batch in batches:
            for name, term, impact in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                t = term.values.to_numpy()
                dense[t] = impact.values.to_numpy()
                for i, b in enumerate(best):
                    held = items.terms[i]
                    b.append((int((dense[held] * items.weight[held]).sum()), name))
                    b.sort(reverse=True)
                    del b[SEEDS:]
                dense[t] = 0
        rows = [(i, name, bound) for i, b in enumerate(best) for bound, name in b if bound > 0]
        kinds = (pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["item", "block", "bound"])

    each = blocks.select("block", "term", "impact").mapInArrow(run, "item int, block string, bound long")
    first = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "block"))
    return each.withColumn("rank", first).where(F.col("rank") <= SEEDS).groupBy("block").agg(F.collect_list("item").alias("items"))


def _searched(trees: DataFrame, items: Items, k: int, floor: np.ndarray | None = None) -> DataFrame:
    """(item_id, doc_id, score) from trees, with the items to search them for where `items` is a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, k, floor)
        for batch in batches:
            for row in range(batch.num_rows):
                only = batch.column("items")[row].as_py() if "items" in batch.schema.names else None
                search.run(pickle.loads(batch.column("tree")[row].as_buffer()), only)
        yield search.found()

    return small_batches(trees, 100).mapInArrow(run, FOUND)


def _turn(docs: DataFrame, asked: DataFrame, k: int, block: int) -> DataFrame:
    """The best documents of the items in `asked` (item_id, term)."""
    rows = asked.collect()  # about TURN rows
    numbers = {t: i for i, t in enumerate(sorted({r["term"].encode() for r in rows}))}
    by_item: dict = {}
    for r in rows:
        by_item.setdefault(r["item_id"], []).append(numbers[r["term"].encode()])
    vectors = save(_vectors(docs, numbers))
    total = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return vectors.sparkSession.createDataFrame([], FOUND)
    df = np.zeros(len(numbers), np.int64)
    for r in vectors.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # at most one row a term
        df[r["term"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    items = Items(list(by_item), [np.array(sorted(t), np.int64) for t in by_item.values()], weight)
    blocks = save(_blocks(vectors, weight, total["docs"], total["terms"], block))
    seeds = save(_seeds(blocks, items))
    tried = _searched(blocks.select("block", "tree").join(seeds, "block").select("tree", "items"), items, k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    place = {n: i for i, n in enumerate(items.names)}
    floor = np.ones(len(items.names), np.int64)
    for r in tried.withColumn("rank", rank).where(F.col("rank") == k).select("item_id", "score").collect():  # one row an item
        floor[place[r["item_id"]]] = r["score"]
    out = save(_searched(blocks.select("tree"), items, k, floor))
    delete_saved(vectors, blocks, seeds)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 50, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0, ties to the smaller doc_id.

    docs: doc_id, text; items: item_id, text.
    """

    def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(i, t.decode()) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in set(terms(text))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), pa.array([t for _, t in pairs], pa.string())], names=["item_id", "term"])

    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(item_terms, "item_id long, term string")
    asked = save(asked.distinct())
    turns = math.ceil(asked.count() / TURN)
    if not turns:
        found = docs.sparkSession.createDataFrame([], FOUND)
    else:
        found = reduce(DataFrame.unionByName, [_turn(docs, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == t), k, block) for t in range(turns)])
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("item_id", "rank", F.when(F.col("doc_id") != int(LAST), F.col("doc_id")).alias("doc_id"), "score")
