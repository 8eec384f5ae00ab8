"""Ranked lexical search against plain scoring of every pair."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from rowmend.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, k):
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(s for _, _, s in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = {}
    for item in {i for i, _ in items}:
        asked = {t for i, text in items if i == item for t in words(text)}
        scores = []
        for i, c, size in held:
            m = 50 + (50 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        for rank, (score, no_id, i) in enumerate(sorted(scores)[:k], 1):
            out[item, rank] = (None if no_id else i, -score)
    return out


def result(df):
    rows = df.collect()
    got = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in rows}
    assert len(got) == len(rows)
    return got


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{int(rng.zipf(1.3)) % 400}"
    docs = [(i, " ".join(word() for _ in range(int(rng.integers(0, 60))))) for i in range(n)]
    docs += [(n + 1, None), (n + 2, ""), (None, docs[3][1]), (None, "Größe w1 ÄÖ x W2-w3"), docs[3], docs[3], (n + 3, " ".join(f"w{k % 500}" for k in range(60_000)))]
    items = [(i, " ".join(word() for _ in range(8))) for i in range(40)] + [(100, None), (101, ""), (None, "w1 größe"), (5, "w7 W9"), (102, "nowhere"), (103, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("block,turn", [(64, ranked.TURN), (ranked.BLOCK, 60)])
def test_same_as_all_pairs(spark, monkeypatch, block, turn):
    monkeypatch.setattr(ranked, "TURN", turn)
    docs, items = corpus(1, 900)
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, rank int")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id int, text string, doc_id int")
    assert result(ranked.search(d, i, 20, block)) == plain(docs, items, 20)


def test_bounds_prune():
    rng = np.random.default_rng(2)
    ptr, term = np.arange(0, 4001, 4), np.sort((rng.integers(0, 25, (1000, 1)) * 20 + rng.permuted(np.tile(np.arange(20), (1000, 1)), axis=1)[:, :4]), axis=1)
    by = np.argsort(term[:, 0], kind="stable")
    impact = rng.integers(1, 1000, 4000)
    docs = ranked.Documents(np.arange(1000), ptr, term[by].ravel(), impact)
    weight = rng.integers(1, 100, 500)
    items = ranked.Items(list(range(60)), [np.sort(rng.choice(20, 5, replace=False)) + 20 * (i % 25) for i in range(60)], weight)
    search = ranked.Search(items, 5)
    search.run(docs)
    assert search.scored < 0.2 * search.all
    x = np.zeros((1000, 500), np.int64)
    x[np.repeat(np.arange(1000), 4), term[by].ravel()] = impact
    for i in range(60):
        scores = x[:, items.terms[i]] @ weight[items.terms[i]]
        best = np.lexsort((np.arange(1000), -scores))[:5]
        assert search.id[i].tolist() == best.tolist() and search.score[i].tolist() == scores[best].tolist()


def test_empty(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = some.withColumnRenamed("doc_id", "item_id")
    for d, i in ((none, items), (some, items.limit(0)), (none, items.limit(0)), (some.withColumn("text", some.text.substr(9, 9)), items)):
        assert ranked.search(d, i).isEmpty()
