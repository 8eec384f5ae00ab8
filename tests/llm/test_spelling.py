"""Spelling variants against plain loops."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rowmend.llm import spelling
from rowmend.llm.queries import QUERIES

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")


def counted(rows, every=97):
    out = Counter()
    for i, text in rows:
        for w in RUN.findall(text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            out[w] += 1
    return out


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(words, times=2):
    pairs = {w: [o for o in words if abs(len(w) - len(o)) < 2 and near(w, o)] for w in words}
    form = {}
    for w, others in pairs.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (words[w], len(pairs[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w in words}


def result(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def vocabulary(seed, n, letters, longest):
    rng = np.random.default_rng(seed)
    words = {"".join(rng.choice(list(letters), rng.integers(1, longest))) for _ in range(n)}
    for w in list(words)[: n // 2]:  # planted variants
        at, c = int(rng.integers(0, len(w))), str(rng.choice(list(letters)))
        words |= {w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]}
    return {w: int(rng.integers(1, 60)) for w in words if w}


@pytest.mark.parametrize("block", [40, spelling.BLOCK])
def test_same_as_all_pairs(spark, block):
    words = vocabulary(3, 700, "abcdeéß", 7)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert result(spelling.variants(df, block=block)) == plain(words)


def test_more_letters_than_groups(spark):
    words = vocabulary(4, 500, "".join(map(chr, range(0x4E00, 0x4E40))) + "ab", 5)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert result(spelling.variants(df, block=50)) == plain(words)


def test_equal_counts_long_words_ties_and_repeated_rows(spark):
    import itertools

    words = {"".join(p): 5 for p in itertools.permutations("abcde")} | {"".join(p): 20 for p in list(itertools.permutations("abcdx"))[:60]}
    words |= {"z" * 50_000: 3, "z" * 49_999: 9, "z" * 49_998 + "y": 1, "q" * 7: 1, "q" * 6: 4, "q" * 5: 4}
    rows = [(w, n) for w, n in words.items() if n != 20] + [(w, 10) for w, n in words.items() if n == 20] * 2 + [(None, 4), ("", 4)]
    df = spark.createDataFrame(rows, "word string, n long")
    assert result(spelling.variants(df, block=16)) == plain(words)


TEXTS = [(0, "The thé THÉ ×÷ Ābc naïve-coöperate it's"), (None, "nothing Nothing"), (3, None), (4, ""), (-7, "ÀÿÉ" * 40 + " \U0001f600end"), (5, "y" * 100_000 + " y")] + [(i, "there thers thEre abcde") for i in range(400)]


@pytest.mark.parametrize("slice_", [8, spelling.SLICE])
def test_counts(spark, monkeypatch, slice_):
    monkeypatch.setattr(spelling, "SLICE", slice_)
    df = spark.createDataFrame([(i, t, 1) for i, t in TEXTS], "doc_id long, text string, n long")
    got = {r.word: r.n for r in spelling.word_counts(df, every=97).collect()}
    want = dict(counted(TEXTS))
    assert got | {"": 0} == {w: n for w, n in want.items() if w} | {"": 0}
    assert {r.word: r.n for r in spelling.word_counts(df).collect()} == dict(counted(TEXTS, 0))


def test_query(spark, tmp_path):
    spark.createDataFrame(TEXTS * 2, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in QUERIES["op12_spelling"](spark, str(tmp_path)).collect()}
    assert got == plain({w: n for w, n in counted(TEXTS * 2).items() if len(w) >= 5 and n >= 3})


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).isEmpty()
    assert spelling.word_counts(spark.createDataFrame([], "doc_id long, text string"), every=97).isEmpty()
