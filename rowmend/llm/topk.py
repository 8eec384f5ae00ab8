"""Exact top-k inner-product search by dual cover trees.

Points and queries go down one tree together. Its upper levels are built by Spark, one round a level: a node of more than
`BLOCK` points or queries gets `FAN` of its vectors as centres and each of its rows goes to the nearest one. A node whose
vectors can't be told apart is cut by a hash of the id. What is left are blocks; in its task each block becomes two cover
trees, of its points and of its queries (a node's children cover balls of its radius divided by `BASE` around centres
further apart than that; groups of at most `FEW` points are put together as leaves with a covering radius of their own).
A pair of nodes can't hold a score above
    <a, b> + r_a |b| + r_b |a| + r_a r_b        (centres a, b; covering radii r)
so it is dropped when that is below the worst k-th score of the query node's queries. Queries first search the points of
their own block, which gives k-th scores to start with. Then pairs of nodes are opened from the root down, level by level,
and what is left are pairs of blocks, whose trees are searched in the same way. A data tree is read once for up to
`PAIRS` query trees.

Inputs: vectors that are null, empty or hold null or non-finite components take no part; vectors of different lengths
never meet; a null id takes no part; of rows with one id each counts, but never against a query of the same id. Ties go
to the smaller id. Fewer than k candidates give fewer rows; an empty table gives none. Other columns are ignored. Scores
are exact while they fit in 62 bits.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmend.llm.common import delete_saved, group_starts, save, whole_groups

BLOCK, FAN, LEAF, Q_LEAF, FEW, BASE, PAIRS = 2048, 64, 64, 16, 2, 1.3, 64
NONE = np.iinfo(np.int64).min


class CoverTree:
    """Cover tree over integer vectors; a node is a range of the reordered points whose first is its centre."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.leaf = leaf
        nodes: list[tuple[int, int, float, list[int]]] = []
        order: list[np.ndarray] = []
        self._x = vectors.astype(np.float64)
        self._grow(np.arange(len(ids)), order, nodes, 0)
        by = np.concatenate(order)
        del self._x
        held = next((t for t in (np.int8, np.int16, np.int32) if np.abs(vectors).max() <= np.iinfo(t).max), np.int64)
        self.ids, self.vectors = ids[by], vectors[by].astype(held)
        self.lo, self.hi, self.radius, kids = (list(c) for c in zip(*nodes, strict=True))
        self.lo, self.hi, self.radius = np.array(self.lo), np.array(self.hi), np.array(self.radius)
        self.kids = [np.array(k, np.int64) for k in kids]
        self.inner = np.array([len(k) > 0 for k in kids])

    def _grow(self, points: np.ndarray, order: list, nodes: list, start: int, last: bool = False) -> int:
        """Adds the node of `points`, whose first is the centre; returns its number."""
        x = self._x[points]
        far = np.sqrt(((x - x[0]) ** 2).sum(1))
        node, radius = len(nodes), float(far.max())
        nodes.append((start, start + len(points), radius, []))
        if last or len(points) <= self.leaf or radius == 0:
            order.append(points)
            return node
        reach = radius / BASE
        groups, few, rest = [points[far <= reach]], [], points[far > reach]
        x = x[far > reach]
        size = (x * x).sum(1)
        while len(rest):
            near = size - 2 * (x @ x[0]) + size[0] <= reach**2
            near[0] = True
            (groups if near.sum() > FEW else few).append(rest[near])
            rest, x, size = rest[~near], x[~near], size[~near]
        few_points = np.concatenate([*few, np.zeros(0, np.int64)])
        whole = [(g, False) for g in groups] + [(few_points[k : k + self.leaf], True) for k in range(0, len(few_points), self.leaf)]
        for g, last in whole:
            nodes[node][3].append(self._grow(g, order, nodes, start, last))
            start += len(g)
        return node

    def prepare(self) -> CoverTree:
        self.exact = self.vectors.astype(np.float64)
        self.norms = np.sqrt((self.exact**2).sum(1))
        return self


class Search:
    """Best k of each query against several trees; `floor` holds k-th scores that are known before."""

    def __init__(self, queries: CoverTree, k: int, floor: np.ndarray | None = None):
        n = len(queries.ids)
        self.q, self.k, self.scored = queries, k, 0
        self.score, self.id = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)
        self.floor = np.full(n, NONE) if floor is None else floor.copy()

    def bounds(self, a: int, d: CoverTree, nodes: np.ndarray) -> np.ndarray:
        q, i, j = self.q, self.q.lo[a], d.lo[nodes]
        return bound(d.exact[j] @ q.exact[i], q.norms[i], q.radius[a], d.norms[j], d.radius[nodes])

    def _near(self, a: int, d: CoverTree, nodes: np.ndarray) -> np.ndarray:
        return nodes[self.bounds(a, d, nodes) >= self.floor[self.q.lo[a] : self.q.hi[a]].min()]

    def run(self, d: CoverTree) -> None:
        self._pairs(0, d, np.zeros(1, np.int64))

    def _pairs(self, a: int, d: CoverTree, nodes: np.ndarray) -> None:
        """Node `a` of the queries against nodes of the data: whichever side is wider is opened."""
        q = self.q
        nodes = self._near(a, d, nodes)
        while len(nodes):
            inner = d.inner[nodes]
            if q.inner[a] and (not inner.any() or q.radius[a] >= d.radius[nodes[inner]].max()):
                for c in q.kids[a].tolist():
                    self._pairs(c, d, nodes)
                return
            if not inner.any():
                self._leaves(a, d, nodes)
                return
            wide = inner & ((d.radius[nodes] > q.radius[a]) | (not q.inner[a]))
            nodes = np.concatenate([nodes[~wide], self._near(a, d, np.concatenate([d.kids[n] for n in nodes[wide].tolist()]))])

    def _leaves(self, a: int, d: CoverTree, nodes: np.ndarray) -> None:
        q, qs = self.q, slice(self.q.lo[a], self.q.hi[a])
        top = self.bounds(a, d, nodes)
        by = np.argsort(-top)
        nodes, top = nodes[by], top[by]
        while len(nodes) and top[0] >= self.floor[qs].min():
            # As many leaves as make some points, few of them until k-th scores are known; of a leaf of equal points, as many at once.
            sizes = np.cumsum(d.hi[nodes] - d.lo[nodes])
            n = max(1, int(np.searchsorted(sizes, 128 if self.floor[qs].min() == NONE else 1024)))
            at = np.concatenate([np.arange(d.lo[x], d.hi[x]) for x in nodes[:n].tolist()])
            for lo in range(0, len(at), 1024):
                self._score(qs, d, at[lo : lo + 1024])
            nodes, top = nodes[n:], top[n:]

    def _score(self, qs: slice, d: CoverTree, at: np.ndarray) -> None:
        q = self.q
        self.scored += (qs.stop - qs.start) * len(at)
        if float(q.norms[qs].max()) * float(d.norms[at].max()) < 2**52:
            scores = (q.exact[qs] @ d.exact[at].T).astype(np.int64)
        else:
            scores = q.vectors[qs].astype(np.int64) @ d.vectors[at].astype(np.int64).T
        i, j = np.nonzero((scores >= self.floor[qs, None]) & (q.ids[qs, None] != d.ids[None, at]))
        if not len(i):
            return
        rows = np.unique(i) + qs.start
        who = np.concatenate([np.repeat(rows, self.k), i + qs.start])
        score, ids = np.concatenate([self.score[rows].ravel(), scores[i, j]]), np.concatenate([self.id[rows].ravel(), d.ids[at][j]])
        by = np.lexsort((ids, ~score, who))  # highest score first, empty places last
        first = np.searchsorted(who[by], rows)
        keep = by[first[:, None] + np.arange(self.k)]
        self.score[rows], self.id[rows] = score[keep], ids[keep]
        self.floor[rows] = np.maximum(self.floor[rows], self.score[rows, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query ids, point ids and scores."""
        i, j = np.nonzero(self.score != NONE)
        return self.q.ids[i], self.id[i, j], self.score[i, j]


def bound(dot, norm_a, radius_a, norm_b, radius_b):
    """The highest score of points of two balls, with room for rounding."""
    return dot + radius_a * norm_b + radius_b * norm_a + radius_a * radius_b + 1e-9 * (norm_a + radius_a) * (norm_b + radius_b) + 1e-6


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part: floor(scale * component)."""
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(sound & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _moved(rows: DataFrame, pivots: DataFrame, salts: DataFrame) -> DataFrame:
    """rows (vec_id, v, asks, node) of wide nodes, each with the number of the nearest pivot of its node and the distance."""
    salt = F.pmod(F.xxhash64("vec_id", "asks"), "salts").cast("int")
    of_rows = rows.join(salts, "node").select("node", salt.alias("salt"), F.lit(1).alias("kind"), "vec_id", "v", "asks")
    of_pivots = pivots.join(salts, "node").select("node", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("number").alias("vec_id"), "v", F.lit(False).alias("asks"))
    keys = ["node", "salt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            starts = group_starts(table, keys)
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                g = table.slice(lo, hi - lo)
                centre = g.column("kind").to_numpy() == 0
                x = _matrix(g.column("v")).astype(np.float64)
                p, x = x[centre], x[~centre]
                near = np.concatenate([np.argmin((p**2).sum(1)[None] - 2 * (x[s : s + 4096] @ p.T), axis=1) for s in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)
                number = g.column("vec_id").to_numpy()[centre]
                kept = g.filter(pa.array(~centre))
                columns = [kept.column(c).combine_chunks() for c in ("vec_id", "v", "asks", "node")]
                far = np.sqrt(((x - p[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(number[near]), pa.array(far)], names=["vec_id", "v", "asks", "node", "number", "far"])

    dealt = of_rows.unionByName(of_pivots).repartition(*keys).sortWithinPartitions(*keys, "kind", "vec_id")
    return dealt.mapInArrow(run, "vec_id long, v array<long>, asks boolean, node string, number long, far double")


def _levels(rows: DataFrame, block: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """rows (vec_id, v, asks) with their block; per level (parent, node, centre, radius, q_radius) of its nodes; and what was saved for them."""
    todo, done, levels = save(rows.withColumn("node", F.size("v").cast("string")).withColumn("stuck", F.lit(False))), [], []
    used = [todo]
    while True:
        sizes = save(todo.groupBy("node", "stuck").agg(F.greatest(F.count_if(~F.col("asks")), F.count_if("asks")).alias("n")))
        wide = sizes.where((F.col("n") > block) & ~F.col("stuck"))
        rest = sizes.where((F.col("n") <= block) | F.col("stuck")).select("node", F.ceil(F.col("n") / block).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("vec_id"), "parts").cast("string")
        done.append(todo.join(rest, "node").select("vec_id", "v", "asks", F.concat("node", F.lit("#"), part).alias("block")))
        if wide.isEmpty():
            break
        salts = wide.select("node", F.ceil(F.col("n") / (16 * block)).cast("int").alias("salts"), F.col("n").alias("before"))
        order = Window.partitionBy("node").orderBy(F.xxhash64("vec_id"), "vec_id")
        fan = F.least(F.lit(FAN), F.ceil(2 * F.col("before") / block))
        drawn = todo.join(salts, "node").withColumn("number", F.row_number().over(order)).where(F.col("number") <= FAN).where(F.col("number") <= fan)
        pivots = save(drawn.groupBy("node", "v").agg(F.min("number").cast("long").alias("number")).select("node", "number", "v"))
        now = save(_moved(todo.join(wide.select("node"), "node", "left_semi"), pivots, salts.select("node", "salts")))
        stats = now.groupBy("node", "number").agg(F.max(F.when(~F.col("asks"), F.col("far"))).alias("radius"), F.max(F.when(F.col("asks"), F.col("far"))).alias("q_radius"), F.greatest(F.count_if(~F.col("asks")), F.count_if("asks")).alias("n"))
        child = F.concat_ws("/", "node", F.col("number").cast("string"))
        nodes = save(stats.join(pivots, ["node", "number"]).join(salts, "node").select(F.col("node").alias("parent"), child.alias("node"), F.col("v").alias("centre"), "radius", "q_radius", (F.col("n") > 0.9 * F.col("before")).alias("stuck")))
        levels.append(nodes.drop("stuck"))
        todo = save(now.withColumn("node", child).drop("number", "far").join(nodes.select("node", "stuck"), "node"))
        used += [sizes, pivots, now, nodes, todo]
    return reduce(DataFrame.unionByName, done), levels, used


BLOCKS = "block string, d_centre array<double>, radius double, tree binary, q_centre array<double>, q_radius double, q_tree binary, floor binary, worst double, query_id array<long>, vec_id array<long>, score array<long>"


def _blocks(rows: DataFrame, k: int) -> DataFrame:
    """One row a block: its trees, and what its queries find among its points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.list_(pa.float64()), pa.float64(), pa.binary(), pa.list_(pa.float64()), pa.float64(), pa.binary(), pa.binary(), pa.float64(), *[pa.list_(pa.int64())] * 3]
        names = [c.strip().split(" ")[0] for c in BLOCKS.split(",")]
        for table in whole_groups(batches, ["block"], 1):
            starts = group_starts(table, ["block"])
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                g = table.slice(lo, hi - lo)
                ids, x, asks = g.column("vec_id").to_numpy(), _matrix(g.column("v")), g.column("asks").to_numpy()
                row: list = [g.column("block")[0].as_py(), *[None] * 11]
                data = CoverTree(ids[~asks], x[~asks]) if not asks.all() else None
                if data:
                    row[1:4] = data.vectors[0].astype(float).tolist(), float(data.radius[0]), pickle.dumps(data, 5)
                if asks.any():
                    queries = CoverTree(ids[asks], x[asks], Q_LEAF)
                    row[4:7] = queries.vectors[0].astype(float).tolist(), float(queries.radius[0]), pickle.dumps(queries, 5)
                    search = Search(queries.prepare(), k)
                    if data:
                        search.run(data.prepare())
                    worst = int(search.floor.min())
                    row[7:9] = search.floor.tobytes(), -np.inf if worst == NONE else float(worst)
                    row[9:] = (c.tolist() for c in search.found())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    return rows.repartition("block").sortWithinPartitions("block", "asks", "vec_id").mapInArrow(run, BLOCKS)


def _searched(pairs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) from pairs (q, d) of blocks: a data tree comes first, then the query trees to search it with."""
    salts = pairs.groupBy("d").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("q"), "salts").cast("int")
    asked = pairs.join(salts, "d").select("d", salt.alias("salt"), "q").join(blocks.select(F.col("block").alias("q"), F.col("q_tree").alias("tree"), "floor"), "q").select("d", "salt", F.lit(1).alias("kind"), "tree", "floor")
    trees = blocks.select(F.col("block").alias("d"), "tree").join(salts, "d").select("d", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "tree", F.lit(None).cast("binary").alias("floor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = None
        for batch in batches:
            for kind, tree, floor in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                loaded = pickle.loads(tree.as_buffer()).prepare()
                if kind == 0:
                    data = loaded
                    continue
                search = Search(loaded, k, np.frombuffer(floor.as_buffer(), np.int64))
                search.run(data)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in search.found()], names=["query_id", "vec_id", "score"])

    dealt = asked.unionByName(trees).repartition("d", "salt").sortWithinPartitions("d", "salt", "kind")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score long")


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def _opened(levels: list[DataFrame], blocks: DataFrame) -> DataFrame:
    """Pairs (q, d) of blocks whose bounds, and those of all nodes above them, reach the queries' worst k-th score."""
    node = F.substring_index("block", "#", 1)
    # All nodes above each block: the prefixes of its path.
    above = F.transform(F.sequence(F.lit(1), F.size(F.split(node, "/"))), lambda n: F.array_join(F.slice(F.split(node, "/"), F.lit(1), n), "/"))
    worst = blocks.where("worst is not null").select("worst", F.explode(above).alias("node")).groupBy("node").agg(F.min("worst").alias("worst"))
    of_blocks = blocks.select(node.alias("parent"), F.col("block").alias("node"), "d_centre", "radius", "q_centre", "q_radius", "worst")
    still = of_blocks.withColumn("parent", F.col("node"))
    inner = [level.join(worst, "node", "left").select("parent", "node", F.transform("centre", lambda x: x.cast("double")).alias("d_centre"), "radius", F.transform("centre", lambda x: x.cast("double")).alias("q_centre"), "q_radius", "worst") for level in levels]
    nodes = save(reduce(DataFrame.unionByName, [of_blocks, still, *inner]))
    norm = lambda c: F.sqrt(_dot(c, c))
    q_side = nodes.where("q_radius is not null").select(F.col("parent").alias("q"), F.col("node").alias("q_next"), "q_centre", "q_radius", norm("q_centre").alias("q_norm"), "worst")
    d_side = nodes.where("radius is not null").select(F.col("parent").alias("d"), F.col("node").alias("d_next"), "d_centre", "radius", norm("d_centre").alias("norm"))
    roots = blocks.select(F.substring_index(node, "/", 1).alias("root")).distinct()
    pairs = save(roots.select(F.col("root").alias("q"), F.col("root").alias("d")))
    for _ in range(len(levels) + 1):
        both = pairs.join(q_side, "q").join(d_side, "d")
        top = bound(_dot("q_centre", "d_centre"), F.col("q_norm"), F.col("q_radius"), F.col("norm"), F.col("radius"))
        new = save(both.where(top >= F.col("worst")).select(F.col("q_next").alias("q"), F.col("d_next").alias("d")))
        delete_saved(pairs)
        pairs = new
    delete_saved(nodes)
    return pairs


def top_k(points: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products among `points` of another id.

    points, queries: (vec_id, v array<long>) as `quantised` gives them.
    """
    rows = points.select("vec_id", "v", F.lit(False).alias("asks")).unionByName(queries.select("vec_id", "v", F.lit(True).alias("asks")))
    dealt, levels, used = _levels(rows, block)
    blocks = save(_blocks(dealt, k))
    pairs = save(_opened(levels, blocks).where("q <> d"))
    own = blocks.where("query_id is not null").select(F.explode(F.arrays_zip("query_id", "vec_id", "score")).alias("x")).select("x.query_id", "x.vec_id", "x.score")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = own.unionByName(_searched(pairs, blocks, k)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = save(ranked.select("query_id", "rank", "vec_id", "score"))
    delete_saved(*used, blocks, pairs)
    return out
