"""The streaming Viterbi commits where paths meet, and gives the ids of stretches taken one by one."""

import numpy as np
import pyarrow as pa

from rowmend.llm import pieces
from rowmend.llm.queries import tokenizer_file


def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    return [r.text for r in rows] + ["", None, "  two  spaces  ", "ends with spaces   ", "   ", "▁literal ▁ marks▁", "x" * 3000, "ä\U0001f600 \n\t end ", " ".join(["a", "bb", "ccc"] * 500)]


def test_commits_come_from_meeting_paths(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    streamed, single = pieces.Vocabulary(path), pieces.Vocabulary(path)
    real = single.viterbi
    single.viterbi = lambda stretches, joined=False: real(stretches)
    given = texts(spark)
    got, want = list(streamed.encode(pa.array(given))), list(single.encode(pa.array(given)))
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True)) and len(got) == len(given)
    assert streamed.decode(got) == [t or "" for t in given]
    assert streamed.met > 20 * streamed.ended and single.met < single.ended
