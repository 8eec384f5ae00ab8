"""Spelling variants: all words at one inserted, deleted or replaced code point, by a trie over letter counts.

A word's vector counts its letters in `GROUPS` groups: the most frequent letters of the vocabulary alone, the rest together.
Words lie in a trie by these counts, one group a level. Two near words differ by a surplus of at most one and a deficit of
at most one, so a search goes down the trie and may spend each once; what it reaches at the leaves is verified. Of two near
words only one searches: the longer one, or the one whose surplus comes on an earlier level than its deficit.

The upper levels are joins: words of a node that holds more than `BLOCK` of them are dealt to its children, `STEP` levels a
round, and so are the searches that come that far, with what is left of their budget. What remains are blocks: each task
keeps the trie of one block and takes the block's searches in slices. At a leaf the surplus and the deficit are known
letters, so the few texts that a word can become are made and looked up; hits are compared letter by letter. A node that no
level can split (more than `BLOCK` words of equal counts) is cut by hash, and its searches visit all parts.

Inputs: a word that is null or empty takes no part; of repeated words the counts are added. Ties go to the word that is
smaller in code-point order. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmend.llm.common import delete_saved, group_starts, mix64, save, small, small_batches, whole_groups

GROUPS, BLOCK, STEP, SLICE, SHORT = 32, 16384, 3, 1 << 20, 64
_R = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

# ---------------------------------------------------------------- counting words

_WORD = np.zeros(256, bool)
_WORD[[*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_shifts(longest: int) -> np.ndarray:
    """For n zero bytes after a text: what each of the 32 bits of its crc becomes, row n, column bit."""
    table = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)  # crc of a byte from state 0
    out = np.empty((longest + 1, 32), np.uint32)
    out[0] = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for n in range(longest):
        out[n + 1] = (out[n] >> 8) ^ table[out[n] & 0xFF]
    return out


def _damaged(ids: list, doc: np.ndarray, codes: np.ndarray, words: list[bytes], every: int) -> tuple[np.ndarray, np.ndarray]:
    """crc32 of `<id>:<word>` of each occurrence, and where `every` divides it; combined from the crcs of ids and words."""
    whole = [w if w.isascii() else w.decode("latin-1").encode() for w in words]
    n_bytes = np.array([len(w) for w in whole])
    crc = np.array([zlib.crc32(w) for w in whole], np.uint32)
    start = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = crc[codes]
    size = n_bytes[codes]
    by = np.argsort(size, kind="stable")
    lengths, first = np.unique(size[by], return_index=True)
    shift = _crc_shifts(min(int(lengths[-1]), SHORT))
    for length, lo, hi in zip(lengths.tolist(), first.tolist(), [*first[1:].tolist(), len(by)], strict=True):
        if length > SHORT:
            h[by[lo:hi]] = [zlib.crc32(whole[c], int(start[d])) for c, d in zip(codes[by[lo:hi]].tolist(), doc[by[lo:hi]].tolist(), strict=True)]
            continue
        moved = np.zeros(len(start), np.uint32)
        for bit in range(32):
            moved ^= np.where((start >> np.uint32(bit)) & np.uint32(1), shift[length, bit], np.uint32(0))
        h[by[lo:hi]] ^= moved[doc[by[lo:hi]]]
    return h, np.flatnonzero(h % np.uint32(every) == 0)


def _tally(ids: list, texts: list[str], every: int) -> dict[bytes, int]:
    """Occurrences of the words of some texts, as latin-1."""
    data = np.frombuffer("\n".join(texts).encode("latin-1", "replace"), np.uint8)
    solid = np.concatenate([[False], _WORD[data], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return {}
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    letters = _LOWER[data[solid[1:-1]]]
    kind = pa.large_binary()
    held = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
    codes, words = held.indices.to_numpy(), held.dictionary.to_pylist()
    counts = np.bincount(codes, minlength=len(words))
    out = {}
    if every:
        borders = np.cumsum([len(t) + 1 for t in texts])
        h, hit = _damaged(ids, np.searchsorted(borders, starts, side="right"), codes, words, every)
        counts -= np.bincount(codes[hit], minlength=len(words))
        for code, value in zip(codes[hit].tolist(), h[hit].tolist(), strict=True):
            w = words[code]
            at = value % len(w)
            w = w[:at] + w[at + 1 :]
            out[w] = out.get(w, 0) + 1
    for w, n in zip(words, counts.tolist(), strict=True):
        if n:
            out[w] = out.get(w, 0) + n
    return out


def word_counts(docs: DataFrame, every: int = 0, longer: int = 1) -> DataFrame:
    """(word, n): runs `[A-Za-zÀ-ÿ]+` of whole texts, A-Z lower-cased, of at least `longer` code points.

    With `every`, an occurrence loses the code point crc % length where `every` divides the crc32 of `<doc_id>:<word>`
    (a null id counts as empty text). Null texts hold no word. Counts are added within slices before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lo, size = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0, 0
            for row, n in enumerate([*[len(t or "") for t in texts], None]):
                if n is None or size and size + n > 4 * SLICE:
                    found = _tally(ids[lo:row], [t or "" for t in texts[lo:row]], every)
                    kept = [(w.decode("latin-1"), c) for w, c in found.items() if len(w) >= longer]
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([c for _, c in kept], pa.int64())], names=["word", "n"])
                    lo, size = row, 0
                size += n or 0

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- words in numpy


class Words:
    """Some words as arrays: lengths, hashes, and counts by group; letters are read in slices."""

    def __init__(self, words: list[str], single: dict[int, int]):
        self.words, self.single = words, single
        self.size = np.array([len(w) for w in words], np.int64)
        self.hash, self.counts = np.zeros(len(words), np.uint64), np.zeros((len(words), GROUPS), np.int32)
        for rows in self.slices():
            points, group, inside = self.letters(rows)
            powers = np.cumprod(np.full(points.shape[1] + 1, _R, np.uint64))
            self.hash[rows] = (value(points) * powers[: points.shape[1]] * inside).sum(1, dtype=np.uint64)
            flat = (np.arange(len(rows))[:, None] * GROUPS + group)[inside]
            self.counts[rows] = np.bincount(flat, minlength=len(rows) * GROUPS).reshape(len(rows), GROUPS)

    def slices(self) -> Iterator[np.ndarray]:
        """Rows in slices of at most SLICE letters after padding, or one row."""
        by, lo = np.argsort(self.size, kind="stable"), 0
        while lo < len(by):
            hi = lo + 1
            room = np.arange(1, len(by) - lo + 1) * np.maximum(self.size[by[lo:]], 1)
            hi = lo + max(1, int(np.searchsorted(room, SLICE, side="right")))
            yield by[lo:hi]
            lo = hi

    def letters(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points, groups and a mask of real places of some words, padded to the longest."""
        width = int(self.size[rows].max())
        inside = np.arange(width) < self.size[rows][:, None]
        points = np.zeros((len(rows), width), np.uint32)
        points[inside] = np.frombuffer("".join([self.words[r] for r in rows.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4")
        kinds, at = np.unique(points, return_inverse=True)
        group = np.array([self.single.get(p, GROUPS - 1) for p in kinds.tolist()])[at].reshape(points.shape)
        return points, group, inside


def value(points: np.ndarray) -> np.ndarray:
    return mix64(points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


class Trie:
    """Trie of the words of a block by group counts: sorted distinct vectors, a node being a range of them on a level."""

    def __init__(self, words: Words):
        self.words = words
        self.vectors = np.unique(words.counts, axis=0)
        self.keys, node = [], np.zeros(len(self.vectors), np.int64)
        self.node = [node]
        for level in range(GROUPS):
            key = node * (1 << 32) + self.vectors[:, level]
            self.keys.append(key)
            node = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            self.node.append(node)
        self.by = np.argsort(words.hash, kind="stable")
        self.sorted = words.hash[self.by]
        self.rest = sorted({ord(c) for w in words.words for c in w if ord(c) not in words.single})

    def _child(self, level: int, lo: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.node[level][lo] * (1 << 32) + counts
        return np.searchsorted(self.keys[level], key), np.searchsorted(self.keys[level], key, side="right")

    def reach(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of `counts`, surplus group, deficit group) of the leaves within the budget; -1 where none is spent.

        Slices of the front are kept on a stack and the deepest goes on first; a node with one vector is settled at once.
        """
        n = len(counts)
        start = np.arange(n), np.zeros(n, np.int64), np.full(n, len(self.vectors)), np.zeros(n, np.int64)
        stack, rows, plus, minus = [(0, start)], [], [], []
        while stack:
            level, (q, lo, hi, spent) = stack.pop()
            one = hi - lo == 1
            if one.any():
                d = counts[q[one]] - self.vectors[lo[one]]
                more, less = np.maximum(d, 0), np.maximum(-d, 0)
                s, t = np.where(more.any(1), more.argmax(1), -1), np.where(less.any(1), less.argmax(1), -1)
                ok = (more.sum(1) <= 1) & (less.sum(1) <= 1) & ((t < 0) | ((s >= 0) & (s < t)))
                rows.append(q[one][ok])
                plus.append(s[ok])
                minus.append(t[ok])
                q, lo, hi, spent = q[~one], lo[~one], hi[~one], spent[~one]
            if not len(q):
                continue
            if len(q) > SLICE // 4:
                half = len(q) // 2
                stack += [(level, (q[:half], lo[:half], hi[:half], spent[:half])), (level, (q[half:], lo[half:], hi[half:], spent[half:]))]
                continue
            at, nexts = counts[q, level].astype(np.int64), []
            # Equal counts spend nothing; one letter less in the trie is a surplus, one more a deficit, in this order.
            for change, allowed in ((0, spent >= 0), (-1, spent == 0), (1, spent == 1)):
                new_lo, new_hi = self._child(level, lo[allowed], at[allowed] + change)
                some = new_hi > new_lo
                nexts.append((q[allowed][some], new_lo[some], new_hi[some], (spent[allowed] + abs(change))[some]))
            stack.append((level + 1, tuple(np.concatenate(c) for c in zip(*nexts, strict=True))))
        return np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*plus, np.zeros(0, np.int64)]), np.concatenate([*minus, np.zeros(0, np.int64)])

    def near(self, asks: Words) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of `asks`, row of the block's words) of near words."""
        groups = {g: [p] for p, g in asks.single.items()} | {GROUPS - 1: self.rest}
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for rows in asks.slices():
            q, s, t = self.reach(asks.counts[rows])
            points, group, inside = asks.letters(rows)
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(points.shape[1], _R, np.uint64)])) * _R
            parts = value(points) * powers[:-1] * inside
            before = np.concatenate([np.zeros((len(rows), 1), np.uint64), np.cumsum(parts, axis=1, dtype=np.uint64)], axis=1)
            whole = before[:, -1]
            step = max(1, SLICE // points.shape[1])
            for cut in range(0, len(q), step):
                qq, ss, tt = q[cut : cut + step], s[cut : cut + step], t[cut : cut + step]
                source = np.where((ss < 0) & (tt < 0), GROUPS - 1, ss)
                e, i = np.nonzero((group[qq] == source[:, None]) & inside[qq])
                row, gone = qq[e], tt[e] < 0
                gone &= ss[e] >= 0
                deleted = before[row[gone], i[gone]] + (whole[row[gone]] - before[row[gone], i[gone] + 1]) * _BACK
                self._look(rows[row[gone]], i[gone], None, deleted, asks, found)
                e, i, row = e[~gone], i[~gone], row[~gone]
                target = np.where(tt[e] < 0, GROUPS - 1, tt[e])
                for g in np.unique(target).tolist():
                    of = target == g
                    for p in groups.get(g, []):
                        new = whole[row[of]] - parts[row[of], i[of]] + value(np.array([p])) * powers[i[of]]
                        self._look(rows[row[of]], i[of], chr(p), new, asks, found)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate([np.stack(f, 1) for f in found]), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def _look(self, rows: np.ndarray, at: np.ndarray, letter: str | None, hashes: np.ndarray, asks: Words, found: list) -> None:
        """Looks texts up by hash and verifies the hits; of two words that find each other only the smaller counts."""
        lo, hi = np.searchsorted(self.sorted, hashes), np.searchsorted(self.sorted, hashes, side="right")
        hit = np.flatnonzero(hi > lo)
        a, b = [], []
        for k, i, first, last in zip(rows[hit].tolist(), at[hit].tolist(), lo[hit].tolist(), hi[hit].tolist(), strict=True):
            w = asks.words[k]
            text = w[:i] + (letter or "") + w[i + 1 :]
            twice = letter is not None and ord(letter) not in asks.single and ord(w[i]) not in asks.single
            if text == w or twice and text < w:
                continue
            for j in self.by[first:last].tolist():
                if self.words.words[j] == text:
                    a.append(k)
                    b.append(j)
        if a:
            found.append((np.array(a), np.array(b)))


# ---------------------------------------------------------------- dealing and searching


def _single_letters(words: DataFrame) -> dict[int, int]:
    """Code point -> group of the letters that more words hold than others; at most GROUPS - 1 rows reach the driver."""
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).where("letter <> ''")
    rows = letters.groupBy("letter").count().orderBy(F.desc("count"), "letter").limit(GROUPS - 1).collect()
    return {ord(r["letter"]): g for g, r in enumerate(rows)}


def _dealt(words: DataFrame, single: dict[int, int], block: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """words with their block, the blocks that each word has to search, and what was saved for them."""
    letters = [chr(p) for p in single]
    n_of = [F.length("word") - F.length(F.translate("word", c, "")) for c in letters]
    root = F.substring("word", 1, 0).alias("node")  # not a constant, so that the joins by node stay equi-joins
    todo, asks = words.select("word", "n", root), words.select("word", "n", root, F.lit(0).alias("spent"))
    level, homes, visits, used = 0, [], [], []
    while True:
        sizes = save(todo.groupBy("node").agg(F.count("*").alias("size")))
        used.append(sizes)
        last = level >= len(letters)
        wide = (F.col("size") > block) & ~F.lit(last)
        parts = F.when(F.lit(last), F.ceil(F.col("size") / block)).otherwise(1).cast("int")
        known = small(sizes)
        done = todo.join(known, "node").where(~wide)
        homes.append(done.select("word", "n", "node", F.pmod(F.xxhash64("word"), parts).cast("int").alias("part")))
        going = asks.join(known, "node")
        visits.append(going.where(~wide).select("word", "n", "node", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")))
        if sizes.where(wide).isEmpty():
            break
        counts = F.array(*n_of[level : level + STEP])
        width = len(n_of[level : level + STEP])
        child = lambda node, v: F.concat(node, F.lit("."), F.array_join(v.cast("array<string>"), "."))
        todo = save(todo.join(known, "node").where(wide).select("word", "n", child(F.col("node"), counts).alias("node")))
        each = F.explode(F.array(*[F.struct(F.array(*[F.lit(x) for x in d]).alias("d"), F.lit(a).alias("from"), F.lit(b).alias("spent")) for d, a, b in _changes(width)]))
        moved = going.where(wide).select("word", "n", "node", "spent", counts.alias("counts"), each.alias("change")).where("spent = change.from")
        to = F.zip_with("counts", F.col("change.d"), lambda x, y: x + y)
        moved = moved.select("word", "n", child(F.col("node"), to).alias("node"), F.col("change.spent").alias("spent"))
        there = save(todo.select("node").distinct())
        asks = save(moved.join(small(there), "node", "left_semi"))
        used += [todo, asks, there]
        level += STEP
    return reduce(DataFrame.unionByName, homes), reduce(DataFrame.unionByName, visits), used


def _changes(width: int) -> list[tuple[list[int], int, int]]:
    """(changes of the counts, budget spent before, budget spent after): a surplus is spent before a deficit."""
    out = [([0] * width, s, s) for s in (0, 1, 2)]
    for i in range(width):
        unit = [int(k == i) for k in range(width)]
        out += [([-x for x in unit], 0, 1), (unit, 1, 2)]
        out += [([int(k == j) - x for k, x in enumerate(unit)], 0, 2) for j in range(i + 1, width)]
    return out


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, other, n_other): every ordered pair of words at one inserted, deleted or replaced code point. words: (word, n)."""
    words = words.where("word <> ''")
    single = _single_letters(words)
    homes, visits, used = _dealt(words, single, block)
    visits = save(visits)
    salts = save(visits.groupBy("node", "part").agg(F.ceil(F.count("*") / (4 * block)).cast("int").alias("salts")))
    keys = ["node", "part", "salt"]
    asked = visits.join(small(salts), ["node", "part"]).select("node", "part", F.pmod(F.xxhash64("word"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "word", "n")
    data = homes.join(small(salts), ["node", "part"]).select("node", "part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            starts = group_starts(table, keys)
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                g = table.slice(lo, hi - lo)
                kind, n, text = g.column("kind").to_numpy(), g.column("n").to_numpy(), g.column("word").to_pylist()
                m = int(np.searchsorted(kind, 1))
                if not 0 < m < len(kind):
                    continue
                i, j = Trie(Words(text[:m], single)).near(Words(text[m:], single))
                a, b = [text[m + k] for k in i.tolist()], [text[k] for k in j.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(a + b, pa.string()), pa.array(b + a, pa.string()), pa.array(np.concatenate([n[j], n[m + i]]))], names=["word", "other", "n_other"])

    dealt = data.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "kind")
    out = save(dealt.mapInArrow(run, "word string, other string, n_other long"))
    delete_saved(*used, visits, salts)
    return out


def variants(words: DataFrame, times: int = 2, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct words with counts.

    form: the near word of largest count (ties: the smaller one), if that is at least `times` (2 or more) times the word's
    own; root: where following forms ends. Counts grow with each form, so this ends after few rounds of doubled steps.
    """
    words = save(words.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n")))
    pairs = near_pairs(words, block)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    strong = -F.col("best.less") >= times * F.col("n")
    known = save(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")))
    steps = save(known.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = save(steps.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        ended = new.where("moved").isEmpty()
        delete_saved(steps)
        steps = new.drop("moved")
        if ended:
            break
    out = save(known.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")))
    delete_saved(words, pairs, known, steps)
    return out
