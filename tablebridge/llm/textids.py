"""Ids of whole texts from ids of their distinct words: split, look up, gather, all in columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space as the tokenizers' patterns have it, and characters on which Arrow may think otherwise.
SPLIT = re.compile("[\t-\r \x85\xa0  -     　]+")
DOUBTFUL = r"[\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]"
# Marks around letters that stand apart from them, unless normalisation makes a mark of a letter's part: ASCII punctuation without ' < | >.
MARKS = r"[!-&(-/:;=?@\[-`{}~]"
PLAIN = rf"^(?P<a>{MARKS}*)(?P<b>\p{{L}}+)(?P<c>{MARKS}*)$"


#: Characters of a run from which on it is not kept in the cache.
LONG_RUN = 200


@lru_cache(1)
def changing_letters() -> str:
    """Class of the letters that NFC or lower case turns into something other than letters, such as a letter and a combining mark."""
    found = []
    for c in range(0x80, 0x110000):
        x = chr(c)
        if x.isalpha() and not "".join([y.lower() for y in unicodedata.normalize("NFC", x)]).isalpha():
            found.append(rf"\x{{{c:x}}}")
    return f"[{''.join(found)}]"


def gather(flat: np.ndarray, ends: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the stretches flat[ends[i]:ends[i + 1]] for all i of index; with the ends of each."""
    size = (ends[1:] - ends[:-1])[index]
    out = np.zeros(len(index) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    at = np.repeat(ends[index] - out[:-1], size)
    at += np.arange(out[-1])
    return flat[at], out


class TextIds:
    """Encoder of texts whose runs between white space have ids of their own.

    ``plain`` gives the ids of words of letters or of marks only, ``odd`` of any other run; both take many at a time and return
    all ids in a row and how many each has. A word is split from the marks around it only if normalisation leaves it letters. Ids of runs
    of up to LONG_RUN characters are cached until the cache holds about ``size`` bytes, then it is emptied; each worker has its own.
    """

    def __init__(self, plain: Callable[[list[str]], tuple[np.ndarray, list[int]]], odd: Callable[[list[str]], tuple[np.ndarray, list[int]]], size: int = 100_000_000) -> None:
        self.plain, self.odd, self.size = plain, odd, size
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.flat, self.ends = np.empty(0, np.uint32), np.zeros(2, np.int64)
        self.held = 0

    def _learn(self, words: list[str], how: Callable[[list[str]], tuple[np.ndarray, list[int]]]) -> None:
        new = [w for w in words if w not in self.index]
        for k in range(0, len(new), 2000):
            ids, sizes = how(some := new[k : k + 2000])
            at = len(self.index)
            self.index.update((w, at + i) for i, w in enumerate(some))
            self.flat = np.concatenate([self.flat, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.held += sum(map(len, some)) + 4 * len(ids) + 250 * len(some)

    def _forget(self, since: tuple[int, int]) -> None:
        """Drop what was learned since a state (entries, bytes)."""
        count, self.held = since
        while len(self.index) > count:
            self.index.popitem()
        self.ends = self.ends[: count + 1]
        self.flat = self.flat[: self.ends[-1]]

    def _places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (each with ``end_id``, if given) and their ends; null is empty."""
        texts = pc.fill_null(texts, "")
        doubtful = pc.match_substring_regex(texts, DOUBTFUL)
        if pc.any(doubtful).as_py():
            texts = pa.array([" ".join(SPLIT.split(t)) if d else t for t, d in zip(texts.to_pylist(), doubtful.to_pylist(), strict=True)], pa.string())
            lists = pa.array([[w for w in t.split(" ")] if d else None for t, d in zip(texts.to_pylist(), doubtful.to_pylist(), strict=True)], pa.list_(pa.string()))
            lists = pc.if_else(doubtful, lists, pc.utf8_split_whitespace(texts))
        else:
            lists = pc.utf8_split_whitespace(texts)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        words, where = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        cut = pc.extract_regex(words, PLAIN)
        fits = cut.is_valid().to_numpy(zero_copy_only=False)
        fits &= ~pc.match_substring_regex(words, changing_letters()).to_numpy(zero_copy_only=False)
        if self.held > self.size:
            self.clear()
        table = np.zeros((len(words), 3), np.int64)
        cut = cut.filter(pa.array(fits))
        parts = [pc.dictionary_encode(pc.ascii_lower(cut.field(name))) for name in "abc"]
        known = [p.dictionary.to_pylist() for p in parts]
        for some in known:
            self._learn([w for w in some if len(w) <= LONG_RUN], self.plain)
        rest = words.filter(pa.array(~fits)).to_pylist()
        self._learn([w for w in rest if len(w) <= LONG_RUN], self.odd)
        state = len(self.index), self.held
        self._learn([w for w in rest if len(w) > LONG_RUN], self.odd)
        table[~fits, 0] = self._places(rest)
        for k, (part, some) in enumerate(zip(parts, known, strict=True)):
            self._learn([w for w in some if len(w) > LONG_RUN], self.plain)
            if some:
                table[fits, k] = self._places(some)[part.indices.to_numpy(zero_copy_only=False)]
        ids, at = gather(self.flat, self.ends, table[where].ravel())
        self._forget(state)
        ends = at[3 * np.concatenate([[0], np.cumsum(counts)])]
        if end_id is None:
            return ids, ends
        return np.insert(ids, ends[1:], np.uint32(end_id)), ends + np.arange(len(ends))
