"""BPE encoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round gives every adjacent pair its merge rank by binary search
over the sorted pair keys, takes each word's lowest rank and merges that pair wherever the word has it, from left to
right; words without a known pair are done and leave the array. Each distinct word is encoded once for as long as a
bounded cache holds it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
from tokenizers import Tokenizer
from xxhash import xxh3_64_intdigest

#: Distinct words that a worker remembers; past it the cache starts anew, so memory stays bounded.
CACHE_WORDS = 120_000
#: Symbols that one batch of merge rounds holds at most, but for a single longer word.
ROUND_SYMBOLS = 1 << 17
NO_RANK = np.iinfo(np.int64).max

#: Texts of only these characters lower-case letter by letter, have no combining marks, and hold in UTF-8 no byte over
#: U+007F but in letters: numpy cuts them. An apostrophe may begin a contraction; U+001C to U+001F are white space to
#: Python alone. Other texts go through the tokenizer's own normaliser and pattern.
ODD = re.compile("[^\x00-\x1b\x20-&(-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]")
SPACE, LETTER, DIGIT, MARK = range(4)
KIND = np.full(256, MARK, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
KIND[48:58] = DIGIT
#: Words of up to EXACT bytes have keys of their own: their bytes and, in the highest byte, their size. Longer ones are hashed,
#: eight bytes at a time up to HASHED bytes.
EXACT, HASHED = 7, 64
#: A cached word of up to so many bytes is known by its key once its bytes are the same too; longer ones by their bytes alone.
COMPARED = 16
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SIZED, _FIRST, _SECOND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


def _eights(letters: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros behind the end."""
    padded = np.append(letters, np.zeros(HASHED, np.uint8))
    return np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(padded) - 7,), (1,), writeable=False)


def word_keys(letters: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit key of each word, which lies at ``at`` in ``letters`` and has ``size`` > 0 bytes: of its own for short words, a
    hash for others."""
    eight, sizes = _eights(letters), size.astype(np.uint64)
    key = eight[at] & _MASK[np.minimum(size, 8)]
    key |= (sizes << np.uint64(56)) * (size <= EXACT)
    long = np.flatnonzero((size > EXACT) & (size <= HASHED))
    if len(long):
        h = _mixed(key[long] + sizes[long] * _SIZED)
        for done in range(8, HASHED, 8):
            more = np.flatnonzero(size[long] > done)
            if not len(more):
                break
            own = long[more]
            h[more] = _mixed((h[more] ^ (eight[at[own] + done] & _MASK[np.minimum(size[own] - done, 8)])) * _SIZED + np.uint64(done))
        key[long] = h
    for i in np.flatnonzero(size > HASHED).tolist():
        key[i] = xxh3_64_intdigest(letters[at[i] : at[i] + size[i]].tobytes())
    return key


def word_bytes(letters: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words of up to COMPARED bytes as two numbers that hold all of them, and the size: (3, word)."""
    eight = _eights(letters)
    return np.stack([eight[at] & _MASK[np.minimum(size, 8)], eight[at + 8] & _MASK[np.clip(size - 8, 0, 8)], size.astype(np.uint64)])


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 bytes stand for themselves, the
    others take the letters from U+0100 on in ascending order."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in sorted(shown)} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTable:
    """The merges of a tokenizer file as arrays: sorted keys (left id times vocabulary size plus right id), the rank
    of each and the id that it makes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.size = max(chain(self.vocab.values(), self.special.values())) + 1
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        keys = np.array([self.vocab[a] * self.size + self.vocab[b] for a, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.byte_of = byte_letters()
        self.inner, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for letter, byte in self.byte_of.items():
            self.inner[byte], self.last[byte] = self.vocab[letter], self.vocab[letter + self.suffix]
        self.names = [""] * self.size
        for name, i in chain(self.vocab.items(), self.special.items()):
            self.names[i] = name

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols and start offsets of the words that lie at ``starts`` in ``symbols``; no word is empty."""
        n_words = len(starts)
        word = np.repeat(np.arange(n_words), np.diff(np.append(starts, len(symbols))))
        rank, makes = self._ranked(symbols, word, np.arange(len(symbols)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, first)
            low_of = np.repeat(low, np.diff(np.append(first, len(word))))
            over = low_of == NO_RANK
            if over.any():
                done.append((symbols[over], word[over]))
            hit = (rank == low_of) & ~over
            before = np.append(False, hit[:-1])
            if (hit & before).any():  # of overlapping hits (a a a) every other one holds, from the left
                index = np.arange(len(hit))
                hit &= (index - np.maximum.accumulate(np.where(hit & ~before, index, 0))) % 2 == 0
                before = np.append(False, hit[:-1])
            symbols = np.where(hit, makes, symbols)
            keep = ~over & ~before
            # Only the pairs that a merge touches get a new rank.
            merged = hit[keep]
            symbols, word, rank, makes = symbols[keep], word[keep], rank[keep], makes[keep]
            fresh = np.flatnonzero(merged | np.append(merged[1:], False))
            rank[fresh], makes[fresh] = self._ranked(symbols, word, fresh)
        if not done:
            return symbols, starts
        symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.searchsorted(word[order], np.arange(n_words))

    def _ranked(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of the pairs that begin at ``at``; a word's last symbol begins none."""
        after = np.minimum(at + 1, len(symbols) - 1)
        key = symbols[at] * self.size + symbols[after]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = (self.keys[found] == key) & (word[at] == word[after]) & (after > at)
        return np.where(ok, self.ranks[found], NO_RANK), self.made[found]


class Coder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does, without truncation or padding."""

    def __init__(self, path: str, special: bool = True, keep_text: bool = False) -> None:
        """special: strings of special tokens in a text become their ids; else they are ordinary text. keep_text: words are
        remembered with their ids and tokens as text, which ``with_text`` needs."""
        self.keep_text = keep_text
        self.table = MergeTable(path)
        tokenizer = Tokenizer.from_file(path)
        self.normalise, self.cut = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("|".join(map(re.escape, sorted(self.table.special, key=len, reverse=True)))) if special and self.table.special else None
        self._forget()

    def _forget(self) -> None:
        self.code: dict[int | bytes, int] = {}
        self.held = np.zeros((3, 0), np.uint64)
        self.start, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.id_text: list[bytes] = []
        self.token_text: list[bytes] = []

    def _library_words(self, text: str) -> list[bytes]:
        """The words of any text by the tokenizer's own steps; a special token is 0xFF and its id."""
        out: list[bytes] = []
        at = 0
        for m in [*self.special.finditer(text), None] if self.special else [None]:
            if part := text[at : m.start() if m else len(text)]:
                out += [bytes(map(self.table.byte_of.__getitem__, x)) for x, _ in self.cut(self.normalise(part))]
            if m:
                out.append(b"\xff%d" % self.table.special[m[0]])
                at = m.end()
        return out

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All texts' bytes, the start and size of each word there, and each text's number of words."""
        plain = [not ODD.search(x) and not (self.special and self.special.search(x)) for x in texts]
        body = b"\n".join([x.lower().encode() for x, ok in zip(texts, plain, strict=True) if ok] + [b""])
        letters = np.frombuffer(body, np.uint8)
        kind = KIND[letters]
        begins = np.append(True, kind[1:] != kind[:-1])[: len(kind)] | (kind == DIGIT)
        at = np.flatnonzero(begins)
        size = np.diff(np.append(at, len(letters)))
        real = kind[at] != SPACE
        at, size = at[real], size[real]
        breaks = np.cumsum([len(x.lower().encode()) + 1 for x, ok in zip(texts, plain, strict=True) if ok]) if any(plain) else np.zeros(0, np.int64)
        n_plain = np.diff(np.append(0, np.searchsorted(at, breaks)))
        if all(plain):
            return letters, at, size, n_plain
        other = [[] if ok else self._library_words(x) for x, ok in zip(texts, plain, strict=True)]
        flat = list(chain.from_iterable(other))
        more = np.fromiter(map(len, flat), np.int64, len(flat))
        n_words = np.fromiter(map(len, other), np.int64, len(other))
        n_words[plain] = n_plain
        # Words in the order of their texts.
        whose = np.repeat(np.arange(len(texts)), n_words)
        is_plain = np.array(plain)[whose]
        starts, sizes = np.empty(len(whose), np.int64), np.empty(len(whose), np.int64)
        starts[is_plain], sizes[is_plain] = at, size
        starts[~is_plain], sizes[~is_plain] = len(body) + np.cumsum(more) - more, more
        return np.frombuffer(body + b"".join(flat), np.uint8), starts, sizes, n_words

    def _learn(self, raw: list[bytes]) -> None:
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(size)
        letters = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.table.inner[letters]
        symbols[ends - 1] = self.table.last[letters[ends - 1]]
        starts = ends - size
        self.held = np.append(self.held, word_bytes(letters, starts, size), 1)
        merged: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        low = 0
        while low < len(raw):
            high = max(low + 1, int(np.searchsorted(ends, starts[low] + ROUND_SYMBOLS)))
            ids, first = self.table.merge(symbols[starts[low] : ends[high - 1]], starts[low:high] - starts[low])
            merged.append(ids)
            counts.append(np.diff(np.append(first, len(ids))))
            low = high
        flat, count = np.concatenate(merged), np.concatenate(counts)
        begin = np.cumsum(count) - count
        special = [i for i in np.flatnonzero(letters[starts] == 255).tolist()]
        for i in special:
            flat[begin[i]], count[i] = int(raw[i][1:]), 1
        self.start = np.append(self.start, len(self.flat) + begin)
        self.count = np.append(self.count, count)
        self.flat = np.append(self.flat, flat.astype(np.uint32))
        if self.keep_text:
            ids = flat.tolist()
            names = [self.table.names[i] for i in ids]
            digits = list(map(str, ids))
            for a, b in zip(begin.tolist(), (begin + count).tolist(), strict=True):
                self.id_text.append(" ".join(digits[a:b]).encode())
                self.token_text.append(" ".join(names[a:b]).encode())

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The cache's numbers of all texts' words, and each text's number of words."""
        if len(self.code) > CACHE_WORDS:
            self._forget()
        letters, at, size, n_words = self._words(texts)
        if not len(at):
            return at, n_words
        body, code = letters.tobytes(), np.empty(len(at), np.int64)
        own = np.flatnonzero(size <= COMPARED)
        key = word_keys(letters, at[own], size[own])
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.append(True, ordered[1:] != ordered[:-1])[: len(key)]
        first = own[order[fresh]]
        back = np.empty(len(key), np.int64)
        back[order] = np.cumsum(fresh) - 1
        code[own] = np.array(self._numbers(ordered[fresh].tolist(), body, at[first], size[first]), np.int64)[back]
        other = size > COMPARED
        hashed = np.flatnonzero((size > EXACT) & ~other)
        other[hashed] = (self.held[:, code[hashed]] != word_bytes(letters, at[hashed], size[hashed])).any(0)  # two words of one key
        words = [body[a : a + n] for a, n in zip(at[other].tolist(), size[other].tolist(), strict=True)]
        code[other] = self._numbers(words, body, at[other], size[other])
        return code, n_words

    def _numbers(self, keys: list[int] | list[bytes], body: bytes, at: np.ndarray, size: np.ndarray) -> list[int]:
        """The cache's numbers of words by their keys; new ones are learned from their bytes."""
        found = list(map(self.code.get, keys))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            fresh = dict(zip((keys[i] for i in reversed(new)), reversed(new), strict=True))
            first = list(fresh.values())[::-1]
            known = len(self.code)
            self._learn([body[a : a + n] for a, n in zip(at[first].tolist(), size[first].tolist(), strict=True)])
            for n, i in enumerate(first):
                self.code[keys[i]] = known + n
            for i in new:
                found[i] = self.code[keys[i]]
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one uint32 array, and each text's number of ids."""
        code, n_words = self.codes(texts)
        count = self.count[code]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(self.start[code] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(np.append(0, np.append(0, ends)[np.cumsum(n_words)]))

    def with_text(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """Of each text: the number of ids, the decimal ids joined by spaces, and the decoded text in UTF-8."""
        code, n_words = self.codes(texts)
        counts = np.append(0, np.cumsum(self.count[code]))
        listed, ends = code.tolist(), np.cumsum(n_words).tolist()
        for a, b in zip([0, *ends], ends, strict=False):
            own = listed[a:b]
            yield int(counts[b] - counts[a]), b" ".join(map(self.id_text.__getitem__, own)), b" ".join(map(self.token_text.__getitem__, own))


@lru_cache(maxsize=1)
def coder(path: str, special: bool = True, keep_text: bool = False) -> Coder:
    """The worker's coder: tasks that reuse the Python worker reuse its cache."""
    return Coder(path, special, keep_text)
