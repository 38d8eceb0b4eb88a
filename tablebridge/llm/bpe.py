"""Byte-pair encoding with a priority queue over a linked symbol list, and decoding by the vocabulary."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import text_slices
from .textids import TextIds, gather

def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@lru_cache(1)
def newer() -> tuple[dict[int, str], dict[int, str]]:
    """Letters and numbers newer than Python's Unicode tables: their lower case by the library's, and those unknown to it, as an unassigned character."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    known = regex.compile(r"[\p{L}\p{N}]")
    some = [x for c in range(0x80, 0x110000) if unicodedata.category(x := chr(c)) == "Cn" and known.match(x)]
    theirs = {x for x, _ in pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True).pre_tokenize_str(" ".join(some))}
    lower = normalizers.Lowercase()
    return {ord(x): lower.normalize_str(x) for x in some}, {ord(x): "\u0378" for x in some if x not in theirs}


class Bpe:
    """Encoder and decoder of a ``tokenizers`` JSON file of the word-end BPE kind.

    Reads its vocabulary, merges, special tokens and split pattern; NFC, lower case for each character, white
    space dropped. Special tokens in a text are kept whole.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("unk_token") or spec.get("post_processor"):
            raise ValueError("not a word-end byte-level BPE file")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for k, v in [*self.vocab.items(), *self.special.items()]:
            self.names[v] = k
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pieces = regex.compile(pattern)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        self.texts = TextIds(self._words, self._words)
        names = [(" " + x).encode() for x in self.names]
        self.name_bytes = np.frombuffer(b"".join(names), np.uint8)
        self.name_ends = np.cumsum([0, *map(len, names)])

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply merges, lowest rank first and leftmost among equals, until none is left.

        The symbols are a doubly linked list in arrays; the queue holds (rank, position, left, right), and an
        entry whose symbols have changed since is stale and skipped.
        """
        n = len(symbols)
        sym, prev, nxt = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
        get = self.merges.get
        queue = [(m[0], i, sym[i], sym[i + 1], m[1]) for i in range(n - 1) if (m := get((sym[i], sym[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = nxt[i] if sym[i] == a else -1
            if j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = new, -1
            nxt[i] = k = nxt[j]
            if k >= 0:
                prev[k] = i
                if m := get((new, sym[k])):
                    heapq.heappush(queue, (m[0], i, new, sym[k], m[1]))
            h = prev[i]
            if h >= 0 and (m := get((sym[h], new))):
                heapq.heappush(queue, (m[0], h, sym[h], new, m[1]))
        return [x for x in sym if x >= 0]

    def _word(self, word: str) -> list[int]:
        letters = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        letters[-1] += self.end
        return self.merge([self.vocab[x] for x in letters])

    def _run(self, run: str) -> list[int]:
        """Ids of a run without white space."""
        ids: list[int] = []
        for k, part in enumerate(self.cut.split(run) if self.cut else [run]):
            if k % 2:
                ids.append(self.special[part])
            elif part:
                lower = plain = part.lower()
                if not part.isascii():
                    small, hidden = newer()
                    lower = "".join([c.lower() for c in unicodedata.normalize("NFC", part)]).translate(small)
                    plain = lower.translate(hidden)
                for m in self.pieces.finditer(plain):
                    ids += self._word(lower[m.start() : m.end()])
        return ids

    def _words(self, runs: list[str]) -> tuple[np.ndarray, list[int]]:
        ids = [self._run(r) for r in runs]
        return np.array([i for x in ids for i in x], np.uint32), [len(x) for x in ids]

    def encode(self, text: str | None) -> list[int]:
        return self.texts.encode(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings in a row; without a decoder in the file a blank stands between them."""
        return " ".join([self.names[i] for i in ids if i < len(self.names)])

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """UTF-8 of decode() for each stretch of ids."""
        raw, at = gather(self.name_bytes, self.name_ends, ids)
        cut = at[ends].tolist()
        raw = raw.tobytes()
        return [raw[a + 1 : b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


@lru_cache(2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: bool = False, texts: bool = False) -> DataFrame:
    """Append ``n_tokens, ids_sha256, decoded_sha256`` (with ``ids`` also ``ids``, with ``texts`` also ``decoded``) to every row.

    A map, without shuffle; each worker keeps a cache of encoded words that is bounded in bytes. Null and empty texts have no ids and
    an empty decoded text. Columns of the new names are replaced, others pass unchanged; repeated rows stay repeated; an empty table
    stays empty; a text of any length is encoded whole.
    """
    more = [*(["ids"] if ids else []), *(["decoded"] if texts else [])]
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", *more)
    schema = StructType(docs.schema.fields[:]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    for name in more:
        schema = schema.add(name, ArrayType(IntegerType()) if name == "ids" else "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for b in text_slices(whole, text):
                flat, ends = bpe.texts.encode(b.column(text))
                raw, cut = flat.astype("<u4").tobytes(), (4 * ends).tolist()
                back = bpe.decode_many(flat, ends)
                b = b.append_column("n_tokens", pa.array(np.diff(ends)))
                b = b.append_column("ids_sha256", pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.string()))
                b = b.append_column("decoded_sha256", pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()))
                if ids:
                    b = b.append_column("ids", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32))))
                if texts:
                    b = b.append_column("decoded", pa.array([x.decode() for x in back], pa.string()))
                yield b

    return docs.mapInArrow(run, schema)
