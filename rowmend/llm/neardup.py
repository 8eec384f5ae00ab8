"""Embedding near-duplicates by NN-descent.

A neighbour graph starts from random-hyperplane cells and is refined by joining each vector's neighbours with one
another: whoever shares a neighbour is compared, and the closest `K` stay on each list. Links are the pairs at or above
the threshold. Whatever is compared and linked is joined at once, before any list is cut: groups of compared vectors
give their links as stars of joined vectors, which connect the same. A list full of links is saturated and may hide
more of them. It is enlarged by the `K` closest vectors outside of the component that its links lead to; one of those
that turns out to be linked joins the components, and the refinement goes on while a component of more than `K` vectors
grows this way. Links are counted among all vectors of a component, block by block.
Recall is audited: sampled vectors are compared with every vector of their label, each of them weighs the same, and the
sample grows until `LINKED` of them have links (or to `AUDIT_MOST` vectors). The refinement goes on while less than
`recall` of their links are found; where `most` turns don't reach that, all vectors of a label are compared block by block.

Equal vectors of a label are merged before anything else and counted at the end.

Inputs: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label, link with
nothing: n_links 0, component_id their own id, kept. Vectors of different lengths never link. Null ids stay with nulls.
Of different vectors with one id the smallest takes part (by label, length, components), the others link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmend.llm.common import components, delete_saved, group_starts, save, whole_groups

K, CELL, TREES, BLOCK, AUDIT = 8, 128, 4, 512, 200
LINKED, AUDIT_MOST = 100, 20_000


def _unit(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _grouped(df: DataFrame, keys: list[str], fn, schema: str, names: list[str]) -> DataFrame:
    """fn(table of one group) -> list of columns, over groups dealt by `keys`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 5000):
            starts = group_starts(table, keys)
            found = [out for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True) if (out := fn(table.slice(lo, hi - lo))) is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _joined(near: np.ndarray) -> np.ndarray:
    """The first row that links lead to from each row of a symmetric link matrix."""
    label = np.arange(len(near))
    sub = np.flatnonzero(near.any(1))
    near, own = near[np.ix_(sub, sub)], np.arange(len(sub))
    while len(sub):
        least = np.minimum(own, np.where(near, own, len(sub)).min(1))
        least = least[least]
        if (least == own).all():
            break
        own = least
    label[sub] = sub[own]
    return label


def _near(ids: np.ndarray, x: np.ndarray, component: np.ndarray, n: int, threshold: float) -> list[np.ndarray]:
    """(u, v, cos) of compared vectors: the n closest of each, the n closest outside of what links join if those are
    all links, and with a cos of NaN each vector and the first one that links join it with."""
    s = x @ x.T
    np.fill_diagonal(s, -2)
    n = min(n, len(ids) - 1)
    label = _joined(s >= threshold)
    best = np.argpartition(-s, n - 1, axis=1)[:, :n]
    cos = np.take_along_axis(s, best, 1)
    full = np.flatnonzero(cos.min(1) >= threshold)
    outside = np.where((label[full, None] == label) | (component[full, None] == component), -2, s[full])
    beyond = np.argpartition(-outside, n - 1, axis=1)[:, :n]
    far = np.take_along_axis(outside, beyond, 1).ravel()
    real = far > -2
    star = np.flatnonzero(label != np.arange(len(ids)))
    u = np.concatenate([np.repeat(ids, n), np.repeat(ids[full], n)[real], ids[star]])
    v = np.concatenate([ids[best].ravel(), ids[beyond].ravel()[real], ids[label[star]]])
    return [u, v, np.concatenate([cos.ravel(), far[real], np.full(len(star), np.nan)])]


def _first_lists(points: DataFrame, turn: int, threshold: float) -> DataFrame:
    """(u, v, cos) of `_near` within cells of random hyperplanes, from TREES sets of them."""
    sizes = points.groupBy("label", "width").agg(F.count("*").alias("n"))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            width = batch.column("width").to_numpy()
            out = np.zeros((len(width), TREES), np.int64)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                if w not in planes:
                    planes[w] = np.random.default_rng(1000 * turn + int(w)).standard_normal((int(w), TREES * 24))
                bits = _unit(batch.column("x").take(pa.array(at)), int(w)) @ planes[w] > 0
                out[at] = (bits.reshape(len(at), TREES, 24) << np.arange(24)).sum(-1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(out), pa.list_(pa.int64()))], names=[*batch.schema.names, "codes"])

    coded = points.select("label", "width", "id", "x").mapInArrow(codes, "label long, width int, id long, x array<double>, codes array<long>")
    bits = F.greatest(F.lit(0), F.least(F.lit(24), F.ceil(F.log2(F.col("n") / CELL)))).cast("int")
    cells = coded.join(F.broadcast(sizes.select("label", "width", bits.alias("bits"))) if sizes.limit(10_001).count() <= 10_000 else sizes.select("label", "width", bits.alias("bits")), ["label", "width"])
    cells = cells.select("label", "width", "id", "x", "bits", F.posexplode("codes").alias("tree", "code")).withColumn("code", F.expr("code % cast(pow(2, bits) as bigint)")).drop("bits")
    keys = ["label", "width", "tree", "code"]
    # Hot cells are cut by a hash of the id; each set of planes cuts another way.
    parts = save(cells.groupBy(*keys).agg(F.ceil(F.count("*") / (4 * CELL)).alias("parts")))
    cells = cells.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("tree", "id"), "parts"))

    def closest(g: pa.Table):
        if g.num_rows < 2:
            return None
        ids, x = g.column("id").to_numpy(), _unit(g.column("x"), int(g.column("width")[0].as_py()))
        return _near(ids, x, ids, K, threshold)

    return _grouped(cells, [*keys, "part"], closest, "u long, v long, cos double", ["u", "v", "cos"])


def _linked(pairs: DataFrame, threshold: float) -> DataFrame:
    """(u, v) that links join: nothing is cut here."""
    return pairs.where(F.isnan("cos") | (F.col("cos") >= threshold)).select("u", "v")


def _closest(pairs: DataFrame) -> DataFrame:
    """The K closest of each list inside and outside of its vector's component."""
    return pairs.withColumn("r", F.row_number().over(Window.partitionBy("u", "outside").orderBy(F.col("cos").desc(), "v"))).where(F.col("r") <= K).drop("r")


def _shortest(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """(u, v, cos, outside): the K closest of each list inside and outside of its vector's component, once each."""
    once = pairs.where(~F.isnan("cos")).groupBy("u", "v").agg(F.max("cos").alias("cos"))
    a, b = (member.select(F.col("id").alias(c), F.col("component_id").alias(f"c{c}")) for c in "uv")
    once = once.join(a, "u", "left").join(b, "v", "left")
    return _closest(once.select("u", "v", "cos", (F.coalesce("cu", "u") != F.coalesce("cv", "v")).alias("outside")))


def _refined(lists: DataFrame, points: DataFrame, member: DataFrame, threshold: float) -> DataFrame:
    """Neighbours of neighbours: everyone on or pointing at u's list is compared with one another, at u."""
    back = _closest(lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "cos", "outside"))
    around = lists.select("u", "v").unionByName(back.select("u", "v")).unionByName(points.select(F.col("id").alias("u"), F.col("id").alias("v"))).distinct()
    around = around.join(points.select(F.col("id").alias("v"), "width", "x"), "v").join(member.withColumnRenamed("id", "v"), "v", "left")

    def compare(g: pa.Table):
        if g.num_rows < 3:
            return None
        ids, x = g.column("v").to_numpy(), _unit(g.column("x"), int(g.column("width")[0].as_py()))
        return _near(ids, x, g.column("component_id").to_numpy(), 3, threshold)

    around = around.select("u", "v", "width", "x", F.coalesce("component_id", "v").alias("component_id"))
    return _grouped(around, ["u"], compare, "u long, v long, cos double", ["u", "v", "cos"])


def _members(edges: DataFrame) -> DataFrame:
    """(id, component_id) of all ends of `edges` (u, v)."""
    joined = save(components(edges))
    out = save(joined.unionByName(joined.select(F.col("component_id").alias("id"), "component_id").distinct()))
    delete_saved(joined)
    return out


def _grew(edges: DataFrame, member: DataFrame) -> bool:
    """Whether `edges` (u, v) lead out of a component of more than K vectors, whose lists may be saturated."""
    sized = member.join(member.groupBy("component_id").agg(F.count("*").alias("n")), "component_id")
    a, b = (sized.select(F.col("id").alias(c), F.col("component_id").alias(f"c{c}"), F.col("n").alias(f"n{c}")) for c in "uv")
    ends = edges.join(a, "u", "left").join(b, "v", "left")
    return not ends.where((F.coalesce("cu", "u") != F.coalesce("cv", "v")) & (F.greatest("nu", "nv") > K)).isEmpty()


def _counted(points: DataFrame, group: DataFrame, threshold: float) -> DataFrame:
    """(id, n): for each member of `group` (id, component_id), the copies of other members that it links with, block by block."""
    sized = group.groupBy("component_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    members = points.join(group, "id").join(sized, "component_id").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.select("component_id", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "copies", "width", "x")

    def count(g: pa.Table):
        ids, mine, copies = (g.column(c).to_numpy() for c in ("id", "mine", "copies"))
        x = _unit(g.column("x"), int(g.column("width")[0].as_py()))
        i, j = int(g.column("i")[0].as_py()), int(g.column("j")[0].as_py())
        a, b = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        s = x[a] @ x[b].T >= threshold
        if i == j:
            np.fill_diagonal(s, False)
            return ids[a], s @ copies[b]
        return np.concatenate([ids[a], ids[b]]), np.concatenate([s @ copies[b], s.T @ copies[a]])

    rows = _grouped(pairs, ["component_id", "i", "j"], count, "id long, n long", ["id", "n"])
    return rows.groupBy("id").agg(F.sum("n").alias("n"))


def _exact(points: DataFrame, threshold: float) -> DataFrame:
    """(u, v) that connect what links connect, from all pairs of a label, block by block."""
    sized = points.groupBy("label", "width").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = points.join(sized, ["label", "width"]).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("label", "width", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "x")

    def compare(g: pa.Table):
        ids, mine, x = g.column("id").to_numpy(), g.column("mine").to_numpy(), _unit(g.column("x"), int(g.column("width")[0].as_py()))
        i, j = int(g.column("i")[0].as_py()), int(g.column("j")[0].as_py())
        near = np.zeros((len(ids), len(ids)), bool)
        a, b = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        near[np.ix_(a, b)] = x[a] @ x[b].T >= threshold
        near |= near.T
        np.fill_diagonal(near, False)
        label = _joined(near)
        star = np.flatnonzero(label != np.arange(len(ids)))
        return ids[star], ids[label[star]]

    return _grouped(dealt, ["label", "width", "i", "j"], compare, "u long, v long", ["u", "v"])


def audit(points: DataFrame, member: DataFrame, threshold: float, rows: int = AUDIT) -> tuple[float, int]:
    """Mean over sampled vectors that have links of the share of them whose ends `member` (id, component_id) joins (1 without any); and how many have links."""
    drawn, linked, shares = 0, 0, 0.0
    while linked < LINKED and drawn < AUDIT_MOST:
        sample = points.orderBy(F.xxhash64("id"), "id").offset(drawn).limit(rows).toPandas()
        if sample.empty:
            break
        n, share = _found_of(sample, points, member, threshold)
        drawn, linked, shares = drawn + len(sample), linked + n, shares + share
        rows = min(4 * rows, 16 * AUDIT)
    return shares / linked if linked else 1.0, linked


def _found_of(sample, points: DataFrame, member: DataFrame, threshold: float) -> tuple[int, float]:
    """The number of sampled vectors with links, and the sum of the joined shares of them."""
    by: dict[tuple, tuple] = {}
    for key, g in sample.groupby(["label", "width"]):
        x = np.stack(g["x"].to_numpy()).astype(float)
        x = x / np.abs(x).max(1, keepdims=True)
        by[key] = g["id"].to_numpy(), x / np.sqrt((x * x).sum(1, keepdims=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, width, ids = (batch.column(c).to_numpy() for c in ("label", "width", "id"))
            for key, (all_own, all_y) in by.items():
                at = np.flatnonzero((label == key[0]) & (width == key[1]))
                x = _unit(batch.column("x").take(pa.array(at)), key[1]) if len(at) else None
                for lo in range(0, len(all_own) if len(at) else 0, AUDIT):
                    own, y = all_own[lo : lo + AUDIT], all_y[lo : lo + AUDIT]
                    i, j = np.nonzero(y @ x.T >= threshold)
                    other = own[i] != ids[at][j]
                    yield pa.RecordBatch.from_arrays([pa.array(own[i][other]), pa.array(ids[at][j][other])], names=["u", "v"])

    true = points.select("label", "width", "id", "x").mapInArrow(run, "u long, v long")
    a, b = (member.select(F.col("id").alias(c), F.col("component_id").alias(f"c{c}")) for c in "uv")
    each = true.join(a, "u", "left").join(b, "v", "left").groupBy("u").agg((F.count_if(F.coalesce("cu", "u") == F.coalesce("cv", "v")) / F.count("*")).alias("share"))
    r = each.agg(F.count("*").alias("n"), F.sum("share").alias("share")).first()
    return r["n"], r["share"] or 0.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.99, turns: int = 2, most: int = 8, report: dict | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding, label).

    `report` gets the last audit: its recall, how many sampled vectors had links, the turns, and whether the exact
    comparison took over.
    """
    report = {} if report is None else report
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    sound = sound & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.coalesce(sound, F.lit(False)).alias("sound"))
    merged = rows.where("sound").groupBy("label", "x").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    points = save(merged.select("label", F.size("x").alias("width"), "id", "copies", "x"))
    if not points.groupBy("id").count().where("count > 1").isEmpty():
        first = points.groupBy("id").agg(F.min(F.struct("label", "width", "x", "copies")).alias("p"))
        points = save(first.select("p.label", "p.width", "id", "p.copies", "p.x"))
    if points.isEmpty():
        out = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return out.withColumn("kept", F.lit(True))
    found, turn = save(_first_lists(points, 0, threshold)), 0
    member = _members(_linked(found, threshold))
    lists = save(_shortest(found, member))
    delete_saved(found)
    while True:
        fresh, met = [], []
        for _ in range(turns):
            met.append(found := save(_refined(lists, points, member, threshold)))
            fresh.append(_linked(found, threshold))
            before, lists = lists, save(_shortest(lists.drop("outside").unionByName(found), member))
            delete_saved(before)
        fresh = save(reduce(DataFrame.unionByName, fresh).distinct())
        delete_saved(*met)
        grew = _grew(fresh, member)
        before, member = member, _members(member.select(F.col("id").alias("u"), F.col("component_id").alias("v")).unionByName(fresh))
        delete_saved(fresh, before)
        turn += 1
        found_share, linked = audit(points, member, threshold)
        enough = found_share >= recall
        report.update(recall=found_share, linked=linked, turns=turn, exact=False)
        if enough and not grew:
            break
        if not enough and turn >= most:
            before, member = member, _members(_exact(points, threshold))
            delete_saved(before)
            report.update(exact=True)
            break
        pairs, read = lists.drop("outside"), [lists]
        if not enough:
            found = save(_first_lists(points, turn, threshold))
            before, member = member, _members(member.select(F.col("id").alias("u"), F.col("component_id").alias("v")).unionByName(_linked(found, threshold)))
            delete_saved(before)
            pairs, read = pairs.unionByName(found), [lists, found]
        lists = save(_shortest(pairs, member))
        delete_saved(*read)
    delete_saved(lists)
    links = save(_counted(points, member, threshold))
    copies = rows.where("sound").join(points.select("label", "x", "id", "copies"), ["label", "x"], "left").select("vec_id", "id", "copies")
    alone = rows.where(~F.col("sound")).select("vec_id", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("copies"))
    out = copies.unionByName(alone).join(member, "id", "left").join(links, "id", "left")
    out = out.select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"), F.coalesce("component_id", "id", "vec_id").alias("component_id"))
    out = save(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
    delete_saved(points, member, links)
    return out
