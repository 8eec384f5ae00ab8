"""SentencePiece encoding and decoding by streaming Viterbi.

The best-scoring sequence of vocabulary pieces is found in a window of a few times the longest piece's length: each end
position in it has the best score and one back pointer. Later pieces can only start from the last `longest` positions;
as soon as the paths back from all of these run through one boundary, the ids up to it are committed and the window
starts anew from there. Only where they don't meet the window is doubled, so memory doesn't grow with the text.

Many streams run side by side, one in each lane of an array. All paths also meet where no piece holds the characters on
both sides, that is before a run of space marks (unless the vocabulary has a piece that goes on after such a run; then a
text is one stretch and one stream). What lies between recurs: each worker keeps the ids of such stretches once its streams
have committed them, looks them up, and streams all others of a slice, in the order of the text.

Text is encoded as is: a space in front, spaces as the space mark; characters without a piece, and literal space marks,
as byte pieces, each byte at a cost below every piece. Decoding gives back the very text. The piece scores come from
the model file; a BPE file's scores are merge ranks, for which this is the best-scoring segmentation, not the merge order's.
Of equal scores, the one with the longer last piece wins.

Inputs: null and empty text give no ids and decode to an empty text. Repeated rows give equal rows; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmend.llm.common import small_batches, text_slices
from rowmend.llm.tokens import SLICE, Kept

MARK = "▁"
LITERAL = "\udfff"  # stands for a mark of the text itself; no text holds it, and it takes three bytes as the mark does
CODES = 0x110000
CELLS = 1 << 17  # positions in the windows of one array
LANE = 1536  # characters of a stream


class Vocabulary:
    def __init__(self, path: str, keep: int = 500_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        plain = [i for i in range(len(self.pieces)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.scores = {self.pieces[i]: model.get_score(i) for i in plain}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_cost = 10 * min(self.scores.values(), default=-1.0) - 10
        self.longest = max(map(len, self.scores), default=1)
        self.crosses = any(MARK in p.lstrip(MARK) for p in self.scores)
        self.windows = 0  # arrays of windows so far
        self.met, self.ended = 0, 0  # windows committed where all paths met, and at the end of their stream
        self.kept = Kept(keep)
        self._trie({self.pieces[i]: i for i in plain})
        held = [bytes([b]) if (b := {i: b for b, i in self.bytes.items()}.get(i)) is not None else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw, self.raw_ends = np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)], dtype=np.int32)

    def _trie(self, ids: dict[str, int]) -> None:
        """Nodes by number (0: root): piece id or -1, its score, and children by node and character."""
        node, child = {"": 0}, {}
        for p in ids:
            for k in range(1, len(p) + 1):
                if p[:k] not in node:
                    node[p[:k]] = len(node)
                    child[node[p[: k - 1]] * CODES + ord(p[k - 1])] = node[p[:k]]
        self.piece = np.array([ids.get(p, -1) for p in node], np.int32)
        self.score = np.array([self.scores.get(p, -np.inf) for p in node])
        self.first = np.full(CODES + 1, -1, np.int32)
        for key, n in child.items():
            if key < CODES:
                self.first[key] = n
        self.keys = np.array(sorted(child), np.int64)
        self.nodes = np.array([child[k] for k in self.keys.tolist()], np.int32)

    def _edges(self, chars: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """score and id (-1: bytes) of the piece that ends at [e, , lane] and begins longest - k before it, at [, k, ]."""
        sizes, longest = end - at, self.longest
        score = np.full((int(sizes.max()) + 1, longest, len(at)), -np.inf)
        piece = np.full(score.shape, -1, np.int32)
        lane = np.repeat(np.arange(len(at)), sizes)
        s = np.arange(len(lane)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = at[lane] + s
        c = chars[place]
        size = 1 + (c > 0x7F).astype(np.int8) + (c > 0x7FF) + (c > 0xFFFF)
        score[s + 1, longest - 1, lane] = self.byte_cost * size
        node = self.first[c]
        for n in range(1, longest + 1):
            on = node >= 0
            lane, s, place, node = lane[on], s[on], place[on], node[on]
            if not len(lane):
                break
            real = self.piece[node] >= 0
            score[s[real] + n, longest - n, lane[real]] = self.score[node[real]]
            piece[s[real] + n, longest - n, lane[real]] = self.piece[node[real]]
            more = place + n < end[lane]
            lane, s, place, node = lane[more], s[more], place[more], node[more]
            key = node.astype(np.int64) * CODES + chars[place + n]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            node = np.where(self.keys[k] == key, self.nodes[k], -1)
        return score, piece

    def _stream(self, chars: np.ndarray, at: np.ndarray, stop: np.ndarray, took: np.ndarray) -> None:
        """Viterbi over the lanes [at, stop) side by side, longest first; `took` gets piece id + 1, or -1 for bytes, at the
        start of each committed piece."""
        base = 4 * self.longest
        window = np.full(len(at), base)
        while len(at):
            # Lanes whose window had to grow go alone.
            now = np.flatnonzero(window == base) if (window == base).any() else np.arange(1)
            here, end = at[now], np.minimum(stop[now], at[now] + window[now])
            order = np.argsort(here - end, kind="stable")
            now, here, end = now[order], here[order], end[order]
            sizes = end - here
            score, piece = self._edges(chars, here, end)
            self.windows += 1
            steps, longest, lanes = score.shape
            best = np.full((steps + longest, lanes), -np.inf)  # of end position e at e + longest - 1
            best[longest - 1] = 0
            back = np.zeros((steps, lanes), np.int64)
            live = np.searchsorted(-sizes, -np.arange(steps), side="right")
            for e in range(1, steps):
                m = live[e]
                value = best[e - 1 : e - 1 + longest, :m] + score[e, :, :m]
                k = value.argmax(0)
                back[e, :m] = longest - k
                best[e - 1 + longest, :m] = value[k, np.arange(m)]
            done = end == stop[now]
            goal = sizes.copy()
            goal[~done] = meetings(back, sizes, np.flatnonzero(~done), longest)
            self.met, self.ended = self.met + int(((goal > 0) & ~done).sum()), self.ended + int(done.sum())
            window[now] = np.where(goal > 0, base, 2 * window[now])
            lane, e = np.arange(lanes), goal
            while len(lane := lane[e > 0]):
                e = e[e > 0]
                n = back[e, lane]
                got = piece[e, longest - n, lane]
                e = e - n
                took[here[lane] + e] = np.where(got < 0, -1, got + 1)
            at[now] += goal
            on = at < stop
            at, stop, window = at[on], stop[on], window[on]

    def viterbi(self, stretches: list[str], joined: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of non-empty marked stretches one after another, and how many each has.

        `joined`: the stretches begin with marks and no piece goes on into the next one, so many make one stream of about
        LANE characters; one that ends with a mark, which a piece could add to the next one's, ends its stream.
        """
        chars = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        stop = np.cumsum(sizes)
        took = np.zeros(len(chars), np.int32)
        last = stop
        if joined and len(stretches):
            number = (stop - sizes) // LANE + np.cumsum(chars[stop - 1] == ord(MARK)) - (chars[stop - 1] == ord(MARK))
            last = stop[np.append(np.flatnonzero(np.diff(number)), len(stop) - 1)]
        start = np.concatenate([[0], last[:-1]])
        order = np.argsort(start - last, kind="stable")
        width = np.minimum(last - start, 4 * self.longest)[order]
        lo = 0
        while lo < len(order):
            hi = lo + max(1, CELLS // int(width[lo]))
            part = order[lo:hi]
            self._stream(chars, start[part], last[part], took)
            lo = hi
        at = np.flatnonzero(took)
        each = np.ones(len(at), np.int64)
        odd = np.flatnonzero(took[at] < 0)
        raw = [chr(c).replace(LITERAL, MARK).encode() for c in chars[at[odd]].tolist()]
        each[odd] = list(map(len, raw))
        ids = np.repeat((took[at] - 1).astype(np.uint32), each)
        if raw:
            first = (np.cumsum(each) - each)[odd]
            held = np.array([self.bytes[b] for r in raw for b in r], np.uint32)
            ids[np.repeat(first - np.cumsum(each[odd]) + each[odd], each[odd]) + np.arange(len(held))] = held
        ends = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(at, stop)]
        return ids, np.diff(ends, prepend=0)

    def _learn(self, stretches: list[str]) -> None:
        self.kept.hold(stretches, *self.viterbi([s.replace(MARK, LITERAL).replace(" ", MARK) for s in stretches], not self.crosses))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """uint32 ids of each text; a null is an empty text."""
        for _, _, data, offsets in text_slices(texts, SLICE):
            full = np.diff(offsets) > 0
            data = np.insert(data, offsets[:-1][full], 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(full)])
            space = data == 32
            begin = np.zeros(len(data), bool)
            if not self.crosses:
                begin[1:] = space[1:] & ~space[:-1]
            begin[offsets[:-1][full]] = True
            starts = np.flatnonzero(begin)
            stretches = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data))
            flat, ends = self.kept.ids_of(stretches.dictionary_encode(), self._learn)
            cuts = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield flat[lo:hi]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The text of each array of ids."""
        flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int64)
        starts = self.raw_ends[flat]
        sizes = self.raw_ends[flat + 1] - starts
        ends = np.cumsum(sizes, dtype=np.int64)
        text = self.raw[np.repeat(starts - ends + sizes, sizes) + np.arange(int(sizes.sum()))]
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, ids)])].tolist()
        return [text[lo:hi].tobytes().decode("utf-8", "replace")[1:] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def meetings(back: np.ndarray, last: np.ndarray, lanes: np.ndarray, longest: int) -> np.ndarray:
    """For some lanes of back pointers [position, lane]: the last boundary on the paths back from all positions that a later
    piece can start from, which are the `longest` ones up to `last`; 0 if they don't meet."""
    at = last[lanes, None] - np.arange(longest)
    at = np.where(at > 0, at, last[lanes, None])
    apart = np.arange(len(lanes))
    while len(apart):
        far = at[apart].max(1)
        apart, far = apart[split := at[apart].min(1) < far], far[split]
        now = at[apart]
        at[apart] = np.where(now == far[:, None], (far - back[far, lanes[apart]])[:, None], now)
    return at[:, 0]


_made: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _made:
        _made[path] = Vocabulary(path)
    return _made[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) with ids as little-endian unsigned 32-bit integers, for every row of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x.astype("<u4").tobytes() for x in vocabulary(path).encode(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` (doc_id, ids) with the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x.as_buffer(), "<u4") if x.is_valid else np.zeros(0, np.uint32) for x in batch.column(1)]
            texts: list[str] = []
            at = 0
            while at < len(held):
                size, stop = 0, at
                while stop < len(held) and (stop == at or size < 1 << 20):
                    size += len(held[stop])
                    stop += 1
                texts += vocabulary(path).decode(held[at:stop])
                at = stop
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
