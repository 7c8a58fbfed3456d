"""BPE encoding and decoding by batched numpy merge rounds.

The distinct new words of a batch, of any length, lie in one flat array of symbols. Each round finds every word's
lowest-ranked adjacent pair, merges it wherever the word has it and looks up the pairs that this
made, by binary search over the sorted keys of all merges. Words drop out when no pair is left.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import ship, sparing, steps, text_or_empty

_NONE = np.int64(2**31 - 1)
#: Separators for str.split() that the vocabulary's pattern for white space does not know.
_ODD_GAPS = "\x1c\x1d\x1e\x1f"
_GAPS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")

# The letters and numbers that Unicode 16.0 added; the files' library knows them, later ones it does not.
_NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# The small letters of capitals that Unicode 16.0 and 17.0 added.
_NEW_SMALL = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}


class WordBpe:
    """The encoder of a vocabulary file of kind BPE with word ends, lower case and no white space."""

    def __init__(self, path: str, cache_words: int = 200_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = np.empty(max(*vocab.values(), *self.special.values()) + 1, object)
        self.names[:] = ""
        for token, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = token
        end = spec["model"]["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = len(self.names)
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.ranks = np.argsort(keys, kind="stable")
        self.keys = keys[self.ranks]
        shown = self._byte_characters()
        self.inner = np.array([vocab[c] for c in shown], np.int64)
        self.last = np.array([vocab[c + end] for c in shown], np.int64)
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        # The file's pattern means Unicode's white space by \s, without the separators U+001C to U+001F.
        self.words = regex.compile(splits[0].replace(r"[^\s", r"[^\t-\r \x85\p{Z}"))
        # Code points that the pattern's tables know and the files' library does not read as some other character.
        known = {c for a, b in _NEW_LETTERS + _NEW_NUMBERS for c in range(a, b + 1)}
        later = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and ord(c) not in known)
        self.unknown = dict.fromkeys(map(ord, regex.findall(r"[\p{L}\p{N}\p{Z}]", later)), "\ue000")
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ids: dict[str, bytes] = {}
        self.cache_words = cache_words

    @staticmethod
    def _byte_characters() -> list[str]:
        """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = iter(range(0x100, 0x200))
        return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; ``_NONE`` where no merge has it."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (UTF-8, not empty) one after another, and how many each word has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        own = np.arange(len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(size)
        symbols[ends - 1] = self.last[data[ends - 1]]
        ranks = np.full(len(symbols), _NONE)
        ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
        ranks[ends - 1] = _NONE
        while len(own):
            lowest = np.minimum.reduceat(ranks, ends - size)
            live = lowest != _NONE
            if not live.all():
                keep = np.repeat(live, size)
                done.append((own[~live], size[~live], symbols[~keep]))
                symbols, ranks, own, size, lowest = symbols[keep], ranks[keep], own[live], size[live], lowest[live]
                ends = np.cumsum(size)
                if not len(own):
                    break
            word = np.repeat(np.arange(len(own)), size)
            at = np.flatnonzero(ranks == lowest[word])
            if len(at) > len(own):
                at = self._apart(symbols, ranks, at, word[at], lowest, ends - size, ends)
            word = word[at]
            symbols[at] = self.made[ranks[at]]
            ranks[at] = _NONE
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, ranks = symbols[keep], ranks[keep]
            at = at - np.arange(len(at))
            size = size - np.bincount(word, minlength=len(size))
            ends = np.cumsum(size)
            after = at[at + 1 < ends[word]]
            ranks[after] = self.rank(symbols[after], symbols[after + 1])
            before = at[at > (ends - size)[word]] - 1
            ranks[before] = self.rank(symbols[before], symbols[before + 1])
        count = np.zeros(len(words), np.int64)
        for index, sizes, _ in done:
            count[index] = sizes
        first = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int64)
        for index, sizes, ids in done:
            inside = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            flat[np.repeat(first[index], sizes) + inside] = ids
        return flat, count

    def _apart(self, symbols: np.ndarray, ranks: np.ndarray, at: np.ndarray, word: np.ndarray, lowest: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the places ``at`` of words' lowest pairs, those that a round may merge at once.

        Places that overlap are taken from the left, every other one. Where a merge would make a lower pair, at any moment
        between this round's merges, that pair would come first: such a word merges its leftmost place alone.
        """
        place = np.arange(len(at))
        first = np.r_[True, at[1:] != at[:-1] + 1]
        own = (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0
        at, word = at[own], word[own]
        made = self.made[ranks[at]]
        meets = at[1:] == at[:-1] + 2
        meets &= word[1:] == word[:-1]
        left = (at > starts[word]) & ~np.r_[False, meets]
        right = at + 2 < ends[word]
        lower = np.zeros(len(lowest), bool)
        for a, b, owner in (
            (symbols[at[left] - 1], made[left], word[left]), (made[right], symbols[at[right] + 2], word[right]), (made[:-1][meets], made[1:][meets], word[1:][meets]),
        ):
            lower[owner[self.rank(a, b) < lowest[owner]]] = True
        return at[np.r_[True, word[1:] != word[:-1]] | ~lower[word]]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of ``ids``, special ones too, with a space between them: the file names no decoder."""
        return " ".join(self.names[ids].tolist())

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces without white space into the cache."""
        parts: list[bytes] = []
        counts: list[int] = []
        for piece in pieces:
            plain = (piece if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ").translate(_NEW_SMALL)).lower()
            if plain.isalpha():
                parts.append(plain.encode())
                counts.append(1)
            else:
                words = self.words.findall(plain) if plain.isascii() else self._split(plain)
                parts += [w.encode() for w in words]
                counts.append(len(words))
        flat, sizes = self.merge_words(parts)
        word_ends = np.concatenate(([0], np.cumsum(sizes)))
        ends = word_ends[np.concatenate(([0], np.cumsum(counts)))].tolist()
        packed = flat.astype("<u4").tobytes()
        self.ids.update({p: packed[4 * a : 4 * b] for p, a, b in zip(pieces, ends, ends[1:])})

    def _split(self, plain: str) -> list[str]:
        """The pattern's words, with characters that its library does not know read as other characters."""
        known = plain.translate(self.unknown)
        return self.words.findall(plain) if known == plain else [plain[m.start() : m.end()] for m in self.words.finditer(known)]

    def pieces(self, text: str) -> list[str]:
        """The text without its white space; special tokens stand alone."""
        parts = [text] if self.specials is None or "<|" not in text else self.specials.split(text)
        found: list[str] = []
        for part in parts:
            if part in self.special:
                found.append(part)
            else:
                found += [p for p in _GAPS.split(part) if p] if any(c in part for c in _ODD_GAPS) else part.split()
        return found

    def encode_batch(self, texts: Iterable[str]) -> list[tuple[bytes, str]]:
        """For each text its ids, packed as little-endian unsigned 32-bit integers, and what they decode to."""
        if len(self.ids) > self.cache_words:
            self.ids.clear()
        if not self.ids:
            for token, i in self.special.items():
                self.ids[token] = np.array([i], "<u4").tobytes()
        split = [self.pieces(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.ids)
        if new:
            self._learn(list(new))
        packed = [b"".join(map(self.ids.__getitem__, pieces)) for pieces in split]
        return [(p, self.decode(np.frombuffer(p, "<u4"))) for p in packed]


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """The encoder of a file, read once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", step_bytes: int = 1 << 20, more: Sequence[Column] = ()) -> DataFrame:
    """(id, ids, decoded) of every row: ids packed as little-endian unsigned 32-bit integers, and the text that they decode to.

    Whole texts are encoded, without limit or padding; special tokens in a text become their ids.
    A null text counts as empty, and an empty text has no ids. Repeated rows are encoded alike.
    ``more`` are further columns of ``docs`` to carry along. A worker holds one step of texts and a bounded cache of words. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        for part in steps(batches, "text", step_bytes):
            coded = coder.encode_batch(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([a for a, _ in coded], pa.binary()), pa.array([b for _, b in coded], pa.string()), *[part.column(c) for c in names]], ["id", "ids", "decoded", *names])

    ship(docs.sparkSession)
    carried = docs.select(*more)
    names = [f"_m{i}" for i in range(len(carried.columns))]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"), *[c.alias(n) for c, n in zip(more, names)])
    types = "".join(f", {n} {f.dataType.simpleString()}" for n, f in zip(names, carried.schema))
    coded = rows.mapInArrow(sparing(run), "id long, ids binary, decoded string" + types)
    return coded.withColumnsRenamed({"id": id_col, **dict(zip(names, carried.columns))})
