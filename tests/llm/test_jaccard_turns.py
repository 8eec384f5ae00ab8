"""The Jaccard join's bookkeeping: few files and tasks for few rows, no turn that can't find anything."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from rowmend.llm import common, jaccard


@pytest.fixture
def many_partitions(spark):
    """64 shuffle partitions that Spark doesn't put together."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def smallest(ids, links):
    up = {i: i for i in ids}
    while any(up[a] != up[b] for a, b in links):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    return up


def near_groups(rng):
    """Three groups of three: near copies inside a group; pairs of groups pass the bound and fail the check."""
    base, texts = [f"w{x}" for x in rng.integers(0, 10**6, 3000)], []
    for _ in range(3):
        group = list(base)
        for k in rng.integers(0, 3000, 60):
            group[k] = f"g{rng.integers(0, 10**9)}"
        for _ in range(3):
            w = list(group)
            for k in rng.integers(0, 3000, 12):
                w[k] = f"v{rng.integers(0, 10**9)}"
            texts.append(" ".join(w))
    return texts


def test_no_turn_after_all_pairs_were_asked_and_few_files(many_partitions, monkeypatch):
    spark, texts, turns, files = many_partitions, near_groups(np.random.default_rng(8)), [], []
    candidates, save = jaccard._candidates, jaccard.save

    def saved(df, *a):
        out = save(df, *a)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(jaccard, "_candidates", lambda rows, turn, num, den: turns.append(turn) or candidates(rows, turn, num, den))
    monkeypatch.setattr(jaccard, "save", saved)
    out = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts + [f"only {k} of its kind" for k in range(300)])), "doc_id long, text string").repartition(3))
    got = {r.doc_id: r.component_id for r in out.collect()}
    sets = [set(zip(*(t.split()[k:] for k in range(4)))) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(9), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert got == smallest(range(9), links) | {k: k for k in range(9, 309)} and len(links) == 9
    assert turns == [0, 0, 1]
    assert max(files) <= 64 and len(out.inputFiles()) <= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("each", [2, 100_000])  # by shuffles, by broadcasts
def test_links_added_to_components(many_partitions, monkeypatch, each):
    spark, rng = many_partitions, np.random.default_rng(each)
    monkeypatch.setattr(common, "TASK_ROWS", each)
    joined, known = spark.createDataFrame([], "id long, component_id long"), []
    for links in ([(i, i + 1) for i in range(40, 70)], rng.integers(0, 90, (25, 2)).tolist()):
        known += links
        joined = common.joined_on(joined, spark.createDataFrame(links, "u long, v long").repartition(5))
        want = {i: m for i, m in smallest(range(90), known).items() if i != m}
        rows = joined.collect()
        assert len(rows) == len(want) and {r.id: r.component_id for r in rows} == want


def test_edges_of_a_task_are_contracted_over_its_batches():
    batches = [pa.record_batch({"u": pa.array([i + 1]), "v": pa.array([i])}) for i in range(50)]
    out = pa.Table.from_batches(list(common._contract(iter(batches))))
    assert out.num_rows == 49 + 1 and set(out.column("v").to_pylist()) == {0}
