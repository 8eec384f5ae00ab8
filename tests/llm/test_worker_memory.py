"""A Python worker keeps little of what a task took, and a task takes little at once: Spark keeps workers for later tasks."""

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path as public_path

from rowmend.llm import common, jaccard, tokens

TASKS = """
import re
import numpy as np
import pyarrow as pa
from rowmend.llm import jaccard, quality


class Frame:  # in place of a DataFrame: keeps the function that a task runs
    columns, schema = ["doc_id", "text"], []

    def mapInArrow(self, run, schema):
        return run


def mb(what):
    return int(re.search(what + r":\\s+(\\d+) kB", open("/proc/self/status").read())[1]) / 1024


draw = np.random.default_rng(0)
words = np.array(["".join(chr(97 + c) for c in draw.integers(0, 26, 6)) for _ in range(5000)])
texts = [" ".join(words[draw.integers(0, 5000, 1000)]) for _ in range(500)]
batches = [pa.record_batch({"doc_id": pa.array(range(500)), "text": pa.array(texts)}) for _ in range(4)]
ranks = np.arange(1 << jaccard.BUCKETS, dtype=np.uint32)
tasks = [jaccard.set_points(Frame(), 5, ranks, 80, 100), jaccard._sets(Frame(), 5), quality.log_weights(Frame(), np.ones(2 * quality.BUCKETS), ("n", "w"))]
began, most = mb("VmRSS"), mb("VmHWM")
for run in tasks:
    for _ in run(iter(batches)):
        pass
print(mb("VmRSS") - began, mb("VmHWM") - most)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="memory can't be read here")
def test_worker_gives_memory_back():
    path = os.pathsep.join(x for x in (os.getcwd(), *sys.path) if x)
    out = subprocess.run([sys.executable, "-c", TASKS], env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, check=True)
    kept, taken = map(float, out.stdout.split())
    assert kept < 12 and taken < 45


def test_memory_goes_back_when_a_task_ends_or_fails(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))

    def fails(batches):
        yield from batches
        raise ValueError

    assert list(common.lean(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and len(calls) == 1
    with pytest.raises(ValueError):
        list(common.lean(fails)(iter([1])))
    assert len(calls) == 2


WORDS = """
import re
import sys
import numpy as np
import pyarrow as pa
from rowmend.llm import common, packing, tokens


def mb(what):
    return int(re.search(what + r":\\s+(\\d+) kB", open("/proc/self/status").read())[1]) / 1024


def texts(first):
    draw = np.random.default_rng(first)
    return pa.array([" ".join("".join(chr(97 + c) for c in w) for w in draw.integers(0, 26, (500, 7))) for _ in range(1000)])


batches = [texts(k) for k in range(2)]
tokens.tokenizer(sys.argv[1], packing.WORDS)
common.give_back()
open("/proc/self/clear_refs", "w").write("5")  # the peak counts from here
began = mb("VmRSS")
for batch in batches:
    for _ in tokens.tokenizer(sys.argv[1], packing.WORDS).encode(batch, 1):
        pass
print(mb("VmHWM") - began)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="memory can't be read here")
def test_a_million_words_take_little():
    path = os.pathsep.join(x for x in (os.getcwd(), *sys.path) if x)
    out = subprocess.run([sys.executable, "-c", WORDS, public_path("word_bpe_49k.json")], env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, check=True)
    assert float(out.stdout) < 170


def test_other_tasks_drop_the_tokenizer():
    kept = tokens.tokenizer(public_path("word_bpe_49k.json"))
    assert list(common.lean(iter, keeps=True)([1])) == [1] and tokens.tokenizer(public_path("word_bpe_49k.json")) is kept
    assert list(common.lean(iter)([1])) == [1] and not tokens._made


def test_used_words_stay():
    mine = tokens.WordTokenizer(public_path("word_bpe_49k.json"), keep=20)
    plain = mine.library
    for k in range(30):
        text = "again and again " * 3 + " ".join(f"word{chr(97 + k % 26)}{chr(97 + j)}, 7{j}" for j in range(8))
        found = next(mine.encode(pa.array([text]), 1)).tolist()
        assert found == [*plain.encode(text, add_special_tokens=False).ids, 1]
        assert {"again", "and"} <= set(mine.kept.number) and len(mine.kept.number) <= 60


def test_blocks_in_parts(monkeypatch):
    draw = np.random.default_rng(1)
    points = draw.integers(0, 3, (300, jaccard.GROUPS)).astype(np.int32)
    points[100:] = points[draw.integers(0, 100, 200)]
    tree = jaccard.Tree(points, points.sum(1))
    whole = tree.blocks(80, 100)
    monkeypatch.setattr(jaccard, "PAIRS", 3)
    assert (tree.blocks(80, 100) == whole).all() and len(whole) > 18


def test_batches_of_long_texts_are_small(spark):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.unset(n)
        texts = common.small_batches(spark.range(0, 200, 1, 1).selectExpr("repeat(string(id), 20000) as text"), size=common.BATCH_BYTES)

        def rows(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

        found = [r["n"] for r in texts.mapInArrow(rows, "n long").collect()]
        assert sum(found) == 200 and max(found) < 70
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
