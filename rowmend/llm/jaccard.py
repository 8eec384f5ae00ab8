"""N-gram Jaccard join: count-vector R-trees over shingle groups, bounds by summed coordinate minima, exact checks.

Every text becomes a set of word shingles and a point: the number of its shingles in each of `GROUPS` hash groups.
The overlap of two sets is at most the sum of the coordinate minima of their points, and that of two boxes of points
at most the sum of the minima of their upper corners, so R-trees of points prune whole blocks of pairs.

A single R-tree over a whole corpus can't be dealt to tasks: its boxes overlap almost everywhere in this many
dimensions. So the points are first dealt to cells, without loss: shingles have one order over the whole corpus, and two
sets that reach the threshold t share one of the first n - ceil(t n) + 1 shingles of each (n: its size), for the first
shingle they share can't come later in a set that shares t n of its shingles. A cell is such a shingle. The order puts
those of often used hash buckets last (`BUCKETS` counts over the whole corpus), so that passages shared by many texts
hardly make cells. Each cell gets an R-tree, which is joined with itself; the surviving pairs are checked exactly on the
whole sets.

Equal sets are merged before anything else, so copies cost one point. First every set is in the cells of its first
`FIRST` shingles alone, which joins most components; then in all of its cells, of which those inside one component are
left out. Inside a cell only a spanning forest of the surviving pairs between components goes to the exact check; where
one of them fails, its cell goes round again with all of its pairs, and further where these are too many for one turn,
until every surviving pair is either checked or inside a component of checked links, so no link between components is
lost. From the second turn on, a pair that shares several cells belongs to the first of them. Cells beyond `CHUNK` points are dealt as pairs of
chunks, in the first round as pairs with the first chunk.

Inputs: null text, empty text and text without words have an empty set and link with nothing. Repeated doc_ids with
equal text merge like copies. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmend.llm.common import BATCH_BYTES, Forest, delete_saved, fitting, group_starts, joined_on, lean, save, shingle_sets, small, small_batches, whole_groups

GROUPS = 256
BUCKETS = 18  # bits
FIRST = 3
CHUNK = 2000
LEAF = 16
PAIRS = 2048
CUT = 2
#: Cells of more than two sets that are broadcast to look their members up (16 bytes each); more are joined by a shuffle.
LOOKED_UP = 1_000_000
#: Points, texts and pairs of sets that a task takes where their number is known (see `fitting`).
POINTS_EACH, TEXTS_EACH, PAIRS_EACH = 10_000, 5_000, 1_000


def bucket_ranks(texts: DataFrame, words: int) -> np.ndarray:
    """The place of each hash bucket (top bits of a shingle's hash) in the order by its number of sets' shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKETS, np.int64)
        for batch in batches:
            for _, s in shingle_sets(batch.column(0), words):
                np.add.at(total, (s >> np.uint64(64 - BUCKETS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counts = texts.select("text").mapInArrow(lean(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 1 << BUCKETS rows
    total = np.zeros(1 << BUCKETS, np.int64)
    total[counts["bucket"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    ranks = np.empty(1 << BUCKETS, np.uint32)
    ranks[np.argsort(total, kind="stable")] = np.arange(1 << BUCKETS, dtype=np.uint32)
    return ranks


def first_shingles(s: np.ndarray, ranks: np.ndarray, num: int, den: int) -> np.ndarray:
    """Cell keys of a set in order: its first shingles by bucket rank, then hash, as many as the threshold asks for."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    most = n + (-num * n // den) + 1
    low = np.uint64(64 - BUCKETS)
    keys = ranks[(s >> low).astype(np.int64)].astype(np.uint64) << low | s & np.uint64((1 << 64 - BUCKETS) - 1)
    return np.sort(np.partition(keys, most - 1)[:most] if most < n else keys).view(np.int64)


def set_points(texts: DataFrame, words: int, ranks: np.ndarray, num: int, den: int) -> DataFrame:
    """(doc_id, n, f1, f2, cells array<long>, point binary): one row per document."""
    schema = "doc_id long, n long, f1 long, f2 long, cells array<long>, point binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, cells, points = [], [], [], [], []
            for _, s in shingle_sets(batch.column(1), words):
                n.append(len(s))
                f1.append(int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0)
                f2.append(int((s * np.uint64(0x9E3779B97F4A7C15) ^ (s >> np.uint64(29))).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                points.append(_narrow(np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)).tobytes() if len(s) else b"")
                cells.append(first_shingles(s, ranks, num, den))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(cells, pa.list_(pa.int64())), pa.array(points, pa.binary())],
                names=["doc_id", "n", "f1", "f2", "cells", "point"],
            )

    return texts.mapInArrow(lean(run), schema)


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes that hold them all."""
    return counts.astype("<u1" if counts.max() < 1 << 8 else "<u2" if counts.max() < 1 << 16 else "<u4")


class Tree:
    """R-tree over points of one cell, packed by size and then by coordinates; boxes as arrays level by level."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((*(points[:, g] for g in range(points.shape[1] - 1, -1, -1)), sizes))
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels = [(self.points, self.sizes, self.sizes)]
        while len(self.levels[-1][0]) > 1:
            hi, small, large = self.levels[-1]
            cut = np.arange(0, len(hi), LEAF)
            self.levels.append((np.maximum.reduceat(hi, cut), np.minimum.reduceat(small, cut), np.maximum.reduceat(large, cut)))

    def blocks(self, num: int, den: int) -> np.ndarray:
        """Pairs (i <= j) of bottom blocks whose bound doesn't exclude a link, found from the root down."""
        pairs = np.zeros((1, 2), np.int64)
        for hi, small, large in reversed(self.levels[1:]):
            # By size first; the boxes of what is left are compared some at a time, as each pair takes 3 KiB.
            a, b = pairs.T
            pairs = pairs[(large[a] * den >= small[b] * num) & (large[b] * den >= small[a] * num) | (a == b)]
            keep = [may_link(hi[a], hi[b], small[a], small[b], num, den) | (a == b) for a, b in (pairs[k : k + PAIRS].T for k in range(0, len(pairs), PAIRS))]
            pairs = pairs[np.concatenate(keep)]
            if hi is self.levels[1][0]:
                break
            below = len(self.levels[self._level(hi) - 1][0])
            grid = (pairs[:, None, :] * LEAF + np.stack(np.meshgrid(np.arange(LEAF), np.arange(LEAF), indexing="ij"), -1).reshape(1, -1, 2)).reshape(-1, 2)
            pairs = grid[(grid[:, 0] <= grid[:, 1]) & (grid[:, 1] < below)]
        return pairs

    def _level(self, hi: np.ndarray) -> int:
        return next(k for k, level in enumerate(self.levels) if level[0] is hi)


def may_link(a: np.ndarray, b: np.ndarray, size_a, size_b, num: int, den: int) -> np.ndarray:
    """Upper bound of the overlap against what the threshold num/den asks of sets of these sizes."""
    return (num + den) * np.minimum(a, b).sum(-1) >= num * (size_a + size_b)


def cell_pairs(ids: np.ndarray, points: np.ndarray, sizes: np.ndarray, component: np.ndarray, failed: np.ndarray, turn: int, num: int, den: int, elsewhere: np.ndarray | None = None, cut_off: float = CUT) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of one cell to check next, and whether there are more of them: surviving pairs between components.

    First turn: a spanning forest of them, in tree order. Later turns: all but the `failed` ones and those that also
    share one of the cells before this one (`elsewhere`: which of these each point is in), at most cut_off * 4**turn
    for each point; the rest come in the next turn.
    """
    none = np.zeros(0, np.int64)
    if len(ids) < 2 or (component == component[0]).all():
        return none, none, False
    tree, n = Tree(points, sizes), len(ids)
    own = ids[tree.order]
    box, size, linked = tree.points, tree.sizes, Forest(n)
    first: dict[int, int] = {}
    for i, c in enumerate(component[tree.order].tolist()):
        linked.union(first.setdefault(c, i), i)
    by = np.argsort(own)
    a, b = by[np.searchsorted(own[by], failed)]
    seen = np.append(np.unique(np.minimum(a, b) * n + np.maximum(a, b)), n * n)
    before = elsewhere[tree.order].astype(np.float32) if elsewhere is not None else None
    blocks = tree.blocks(num, den)
    blocks = blocks[np.lexsort((blocks[:, 0], blocks[:, 1] - blocks[:, 0]))]
    cut = np.arange(0, n, LEAF)
    x, y = (g.ravel() for g in np.meshgrid(np.arange(LEAF), np.arange(LEAF), indexing="ij"))
    found: list[np.ndarray] = []
    count, most = 0, max(1, int(cut_off * 4**turn * n))
    for same_offset in np.split(blocks, np.flatnonzero(np.diff(blocks[:, 1] - blocks[:, 0])) + 1):
        root = linked.roots()
        low, high = np.minimum.reduceat(root, cut), np.maximum.reduceat(root, cut)
        p, q = same_offset.T
        open_blocks = same_offset[np.minimum(low[p], low[q]) != np.maximum(high[p], high[q])]
        for k in range(0, len(open_blocks), 32):
            p, q = open_blocks[k : k + 32].T
            i, j = (p[:, None] * LEAF + x).ravel(), (q[:, None] * LEAF + y).ravel()
            ok = (i < j) & (j < n)
            i, j = i[ok], j[ok]
            ok = root[i] != root[j]
            i, j = i[ok], j[ok]
            ok = seen[np.searchsorted(seen, i * n + j)] != i * n + j
            i, j = i[ok], j[ok]
            ok = may_link(box[i], box[j], size[i], size[j], num, den)
            i, j = i[ok], j[ok]
            if before is not None and len(i):
                ok = (before[i] * before[j]).sum(1) == 0
                i, j = i[ok], j[ok]
            if not turn and len(i):
                ok = np.fromiter((linked.union(u, v) for u, v in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
                i, j = i[ok], j[ok]
            found.append(np.stack([own[i], own[j]]))
            count += len(i)
        if turn and count > most:
            break
    pairs = np.sort(np.concatenate([*found, np.zeros((2, 0), np.int64)], axis=1)[:, : most if turn else None], axis=0)
    return pairs[0], pairs[1], bool(turn) and count > most


def _before(cells: pa.Array, cell: int) -> np.ndarray | None:
    """For each row of cell keys: which keys below `cell` it holds, of those that several rows hold."""
    keys, rows = cells.flatten().to_numpy(), np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
    rows, keys = rows[keys < cell], keys[keys < cell]
    held, code, count = np.unique(keys, return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[code]
    out = np.zeros((len(cells), int((count > 1).sum())), bool)
    out[rows[column >= 0], column[column >= 0]] = True
    return out if out.shape[1] else None


def _candidates(rows: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """rows: (cell, i, j, kind, id, n, point, cells, component, other), kind 0 points and kind 1 failed pairs -> (cell, i, j, a, b), and a row with null a and b where the cell has more."""
    keys, cut_off = ["cell", "i", "j"], CUT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 5_000):
            col = {c: table.column(c).to_numpy() for c in ("cell", "i", "j", "kind", "id", "n", "component", "other")}
            is_point = col["kind"] == 0
            points = np.zeros((table.num_rows, GROUPS), np.int32)
            raw = table.column("point").combine_chunks().filter(pa.array(is_point))
            for i, p in zip(np.flatnonzero(is_point).tolist(), raw.to_pylist(), strict=True):
                points[i] = np.frombuffer(p, f"<u{len(p) // GROUPS}")
            cells = table.column("cells").combine_chunks()
            starts = group_starts(table, keys)
            ends = np.append(starts[1:], table.num_rows)
            twos = starts[(ends - starts == 2) & is_point[starts] & is_point[np.minimum(starts + 1, table.num_rows - 1)]] if not turn else starts[:0]
            good = twos[may_link(points[twos], points[twos + 1], col["n"][twos], col["n"][twos + 1], num, den) & (col["component"][twos] != col["component"][twos + 1])]
            at, a, b = [good], [np.minimum(col["id"][good], col["id"][good + 1])], [np.maximum(col["id"][good], col["id"][good + 1])]
            rest: list[int] = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s == 1 or e - s == 2 and not turn:
                    continue
                p = np.arange(s, e)[is_point[s:e]]
                k = np.arange(s, e)[~is_point[s:e]]
                elsewhere = _before(cells.take(pa.array(p)), int(col["cell"][s])) if turn else None
                x, y, more = cell_pairs(col["id"][p], points[p], col["n"][p], col["component"][p], np.stack([col["id"][k], col["other"][k]]), turn, num, den, elsewhere, cut_off)
                at, a, b = [*at, np.full(len(x), s)], [*a, x], [*b, y]
                rest += [s] * more
            s = np.concatenate([*at, np.array(rest, np.int64)])
            none = pa.nulls(len(rest), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(col[c][s]) for c in keys), *(pa.concat_arrays([pa.array(np.concatenate(v)), none]) for v in (a, b))],
                names=["cell", "i", "j", "a", "b"],
            )

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "kind")
    return dealt.mapInArrow(lean(run), "cell long, i int, j int, a long, b long")


def _checked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, ok): exact Jaccard of the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append((num + den) * both >= num * (len(p) + len(q)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    a, b = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    met = small(pairs).join(a, "a").join(b, "b").select("a", "b", "x", "y")
    return fitting(met, pairs.count() + sets.count() * PAIRS_EACH // POINTS_EACH, PAIRS_EACH).mapInArrow(lean(run), "a long, b long, ok boolean")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [s.tobytes() for _, s in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.binary())], names=["doc_id", "items"])

    return docs.mapInArrow(lean(run), "doc_id long, items binary")


def _dealt(points: DataFrame, joined: DataFrame, first: int | None) -> DataFrame:
    """(cell, i, j, id, n, point) of the sets `points` in cells that hold sets of two components or more; of cells with the same members, one.

    Of a cell's first few shingles (`first`), chunks meet the first chunk alone: rows in proportion to the members, as what
    this joins of a large group needn't be compared any more when all cells, with all pairs of chunks, come.
    """
    cells = F.slice("cells", 1, first) if first else F.col("cells")
    known = points.select("doc_id", cells.alias("cells")).join(small(joined), F.col("doc_id") == F.col("id"), "left")
    in_cells = known.select("doc_id", F.coalesce("component_id", "doc_id").alias("component"), F.explode("cells").alias("cell"))
    marks = [F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.bit_xor(F.xxhash64("doc_id")).alias("mark")]
    shared = in_cells.groupBy("cell").agg(*marks).where("low < high").groupBy("size", "least", "most", "mark").agg(F.min("cell").alias("cell"))
    members = points.agg(F.coalesce(F.sum(F.size(cells)), F.lit(0))).first()[0]
    shared = save(fitting(shared.select("cell", "size", "least", "most"), members))
    # Most shared cells have two members, which the aggregate names; only larger ones are looked up.
    twos = shared.where("size = 2").select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), F.explode(F.array("least", "most")).alias("id"))
    larger = shared.where("size > 2").select("cell", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
    member = in_cells.drop("component").join(small(larger, LOOKED_UP), "cell").select("cell", "chunks", F.col("doc_id").alias("id"))
    mine = F.pmod(F.xxhash64("cell", "id"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    partners = F.when(F.col("mine") > 0, F.array(F.lit(0))).otherwise(every) if first else every
    dealt = member.withColumn("mine", mine).withColumn("with", F.explode(partners))
    dealt = dealt.select("cell", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "id").unionByName(twos)
    rows = shared.agg(F.coalesce(F.sum(F.col("size") * (F.lit(2) if first else F.ceil(F.col("size") / CHUNK))), F.lit(0))).first()[0]
    out = save(fitting(dealt.join(points.select(F.col("doc_id").alias("id"), "n", "point"), "id"), points.count() + rows, POINTS_EACH))
    delete_saved(shared)
    return out


def jaccard_components(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs` (doc_id, text).

    Links: Jaccard of the sets of `words`-word shingles at least num/den. component_id: smallest doc_id reachable.
    Rows whose doc_id is null stay alone, with a null component. An empty table gives an empty result.
    """
    texts = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), size=BATCH_BYTES)
    points = save(set_points(texts, words, bucket_ranks(texts, words), num, den))
    print_of = ["n", "f1", "f2"]
    rows = points.count()
    classes = save(fitting(points.where("n > 0 and doc_id is not null").groupBy(*print_of).agg(F.min("doc_id").alias("rep")), rows))
    reps = points.where("n > 0").join(small(classes.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi")
    reps = save(fitting(reps.dropDuplicates(["doc_id"]), rows, POINTS_EACH))

    spark = docs.sparkSession
    joined = spark.createDataFrame([], "id long, component_id long")
    checked: list[DataFrame] = []
    sets: list[DataFrame] = []
    for first in (FIRST, None):
        dealt = _dealt(reps, joined, first)
        again, held, asked, turn = None, None, [], 0
        while True:
            todo = dealt.withColumn("cells", F.lit(None).cast("array<long>"))
            if again is not None:
                if held is None:  # the dealt cells of each set: a pair that shares others is in one component
                    held = save(dealt.groupBy("id").agg(F.collect_set("cell").alias("cells")))
                todo = dealt.join(small(again), ["cell", "i", "j"], "left_semi").join(held, "id")
            now = todo.join(small(joined), "id", "left").select("cell", "i", "j", F.lit(0).alias("kind"), "id", "n", "point", "cells", F.coalesce("component_id", "id").alias("component"), F.lit(0).cast("long").alias("other"))
            if asked:
                failed = reduce(DataFrame.unionByName, asked).join(reduce(DataFrame.unionByName, checked).where("not ok"), ["a", "b"]).join(again, ["cell", "i", "j"], "left_semi")
                zero, no_set = F.lit(0).cast("long"), F.lit(None)
                now = now.unionByName(failed.select("cell", "i", "j", F.lit(1).alias("kind"), F.col("a").alias("id"), zero.alias("n"), no_set.cast("binary").alias("point"), no_set.cast("array<long>").alias("cells"), zero.alias("component"), F.col("b").alias("other")))
            answers = save(_candidates(now, turn, num, den))
            found, more = answers.where("a is not null"), answers.where("a is null").select("cell", "i", "j")
            asked.append(found)
            known, asked_now = sum(df.count() for df in checked), answers.count()
            pairs = found.select("a", "b").distinct()
            if checked:
                pairs = pairs.join(reduce(DataFrame.unionByName, checked).select("a", "b"), ["a", "b"], "left_anti")
            pairs = save(fitting(pairs, asked_now + known))
            ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().withColumn("known", F.lit(None).cast("boolean"))
            if sets:
                ends = ends.drop("known").join(reduce(DataFrame.unionByName, sets).select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
            ends = save(fitting(ends, 2 * (asked_now + known)))
            involved = ends.where("known is null").select("doc_id")
            if asking := involved.count():
                asking_texts = texts.join(small(involved), "doc_id", "left_semi").dropDuplicates(["doc_id"])
                sets.append(save(_sets(fitting(asking_texts, asking, TEXTS_EACH), words)))
            if not pairs.isEmpty():
                compared = reduce(DataFrame.unionByName, sets).join(small(ends.select("doc_id")), "doc_id", "left_semi")
                checked.append(save(_checked(pairs, compared, num, den)))
                new = checked[-1].where("ok").select(F.col("a").alias("u"), F.col("b").alias("v"))
                if not new.isEmpty():
                    before, joined = joined, joined_on(joined, new)
                    delete_saved(before)
            delete_saved(ends, pairs)
            if first:
                break  # what failed or is left goes on in all cells
            last = again
            # After the first turn a cell has asked for all of its pairs unless it says that there are more.
            if not turn and checked:
                failing = found.join(reduce(DataFrame.unionByName, checked).where("not ok"), ["a", "b"], "left_semi")
                more = more.unionByName(failing.select("cell", "i", "j"))
            again = save(fitting(more.distinct(), asked_now + known))
            delete_saved(*([] if last is None else [last]))
            if again.isEmpty():
                delete_saved(again)
                break
            turn += 1
        delete_saved(dealt, *asked, *([] if held is None else [held]))
    classes_of = classes.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select(*print_of, F.coalesce("component_id", "rep").alias("component_id"))
    out = points.select("doc_id", *print_of).join(classes_of, print_of, "left")
    out = save(fitting(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), 2 * rows))
    delete_saved(points, classes, reps, joined, *sets, *checked)
    return out
