"""Token ids of whole texts by a public tokenizer file, with a bounded cache of words."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rowmend.llm.common import give_back, keep_models, text_slices

#: Bytes of text whose distinct words are looked up together; a longer text is taken alone and whole.
SLICE = 1 << 20
#: Characters that the library encodes at once (its results take some 50 times that); a longer word is taken alone.
LOT = 1 << 16
#: Words of one pre-token each, whatever stands beside them.
_LETTERS = re.compile("[a-zA-ZªµºÀ-ÖØ-öø-ÿ]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[list(b".,;:!?")] = True


class Kept:
    """Ids of words, side by side in one array, for about `keep` words (and 16 ids a word) at a time: then the half used most stays."""

    def __init__(self, keep: int):
        self.keep = keep
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int32)  # of the ids of word number i, at i + 1
        self.uses = np.zeros(1 << 16, np.uint32)  # of word number i, halved whenever words go

    def hold(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, used = len(self.number), int(self.ends[len(self.number)])
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), np.uint32)])
        if n + len(words) + 1 > len(self.ends):
            more = len(self.ends) + len(words)
            self.ends = np.concatenate([self.ends, np.zeros(more, np.int32)])
            self.uses = np.concatenate([self.uses, np.zeros(more, np.uint32)])
        self.ids[used : used + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(words)] = used + np.cumsum(sizes)
        self.number.update(zip(words, range(n, n + len(words)), strict=True))

    def _thin(self) -> None:
        """Forget all but the most used words, as many as `keep` / 2 with at most 8 ids each on average."""
        n, ids, ends, uses, words = len(self.number), self.ids, self.ends, self.uses, list(self.number)
        sizes = np.diff(ends[: n + 1])
        best = np.argsort(uses[:n], kind="stable")[::-1][: self.keep // 2]
        best = np.sort(best[np.cumsum(sizes[best], dtype=np.int64) <= 8 * self.keep])
        self._clear()
        if len(best):
            sizes = sizes[best]
            places = np.repeat(ends[best] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            self.hold([words[i] for i in best.tolist()], ids[places], sizes)
            self.uses[: len(best)] = uses[best] >> 1

    def ids_of(self, words: pa.DictionaryArray, learn: Callable[[list[str]], None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and where each word's ids end. `learn` holds the words it is given."""
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.number) > self.keep or self.ends[len(self.number)] > 16 * self.keep:
            self._thin()
        known = self.number.get
        number = np.fromiter((known(w, -1) for w in distinct), np.int32, len(distinct))
        if len(new := np.flatnonzero(number < 0)):
            missing = [distinct[i] for i in new.tolist()]
            learn(missing)
            number[new] = np.fromiter(map(self.number.__getitem__, missing), np.int32, len(new))
        at = words.indices.to_numpy()
        self.uses[number] += np.bincount(at, minlength=len(distinct)).astype(np.uint32)
        codes = number[at]
        # Words come from slices below 2 GiB, and no id takes less than a byte, so 32 bits hold all places.
        starts = self.ends[codes]
        sizes = self.ends[codes + 1] - starts
        ends = np.cumsum(sizes, dtype=np.int32)
        at = np.repeat(starts - ends + sizes, sizes)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], ends


class WordTokenizer:
    """Encodes texts with a lower-casing `tokenizers` file whose pre-tokenizer never joins text across white space, nor
    a letter with a sign after it, and whose pre-tokens end with pieces in "</w>".

    Such a text's ids are its words' ids one after another, so the library encodes each distinct word once, and its ids
    are kept for at most `keep` words at a time.
    """

    def __init__(self, path: str, keep: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        pieces = self.library.get_vocab()
        self.closes = np.zeros(max(pieces.values(), default=0) + 1, bool)
        self.closes[[i for piece, i in pieces.items() if piece.endswith("</w>")]] = True
        self.kept = Kept(keep)

    def _learn(self, words: list[str]) -> None:
        """Words of one pre-token go to the library side by side: each ends where a piece in "</w>" does."""
        plain: list[str] = []
        single: list[str] = []
        for w in words:
            (plain if _LETTERS.fullmatch(w) else single).append(w)
        lines = [plain[k : k + 500] for k in range(0, len(plain), 500)]
        for line, e in zip(lines, self._encoded([" ".join(line) for line in lines]), strict=True):
            ends = np.flatnonzero(self.closes[e]) + 1
            if len(ends) == len(line) and ends[-1] == len(e):
                self.kept.hold(line, e, np.diff(ends, prepend=0))
            else:
                single += line
        found = self._encoded(single)
        if found:
            self.kept.hold(single, np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found)))

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        lot = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // LOT
        cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), len(texts)] if texts else []
        return [np.array(e.ids, np.uint32) for lo, hi in pairwise(cuts) for e in self.library.encode_batch_fast(texts[lo:hi], add_special_tokens=False)]

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """uint32 ids of each text with `end_id` after them; a null is an empty text."""
        for _, _, data, offsets in text_slices(texts, SLICE):
            parts = pc.ascii_split_whitespace(_spaced(data, offsets))
            flat, ends = self.kept.ids_of(parts.flatten().dictionary_encode(), self._learn)
            counts = pc.list_value_length(parts).to_numpy()
            cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                out = np.empty(hi - lo + 1, np.uint32)
                out[:-1] = flat[lo:hi]
                out[-1] = end_id
                yield out


def _spaced(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The texts with A-Z in lower case and a space between a letter and a sign after it, which leaves their ids alone.

    Texts with characters past U+00FF keep their case (marks may compose with one case only), and those with "<|" too
    (the library looks for special tokens before it lowers).
    """
    low = _LOWER[data]
    odd = data >= 0xC4
    odd[1:] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    for row in np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1).tolist():
        low[offsets[row] : offsets[row + 1]] = data[offsets[row] : offsets[row + 1]]
    after = _LETTER[low[:-1]]
    after[1:] |= (low[:-2] == 0xC3) & (low[1:-1] != 0x97) & (low[1:-1] != 0xB7)  # U+00C0 to U+00FF but the two signs
    at = np.flatnonzero(after & _SIGN[low[1:]]) + 1
    low = np.insert(low, at, 32)
    offsets = offsets + np.searchsorted(at, offsets)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(low))


def narrow(ids: np.ndarray) -> bytes:
    """The ids in two bytes each if all fit, else in four; read back with `widen` and their number."""
    return ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4").tobytes()


def widen(held, n: int) -> np.ndarray:
    return np.frombuffer(held, "<u2" if len(held) == 2 * n else "<u4")


_made: dict[tuple[str, int], WordTokenizer] = {}
keep_models(_made.clear)


def tokenizer(path: str, keep: int = 500_000) -> WordTokenizer:
    """One tokenizer for each file and worker process, until a task of another kind drops it."""
    if (path, keep) not in _made:
        _made[path, keep] = WordTokenizer(path, keep)
        give_back()  # of what reading the file took
    return _made[path, keep]
