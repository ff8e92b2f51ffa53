"""Character n-gram tables as sorted arrays, for candidate scores inside tasks. The same measure as ``score_candidates``."""

from __future__ import annotations

from math import log

import numpy as np

#: The weights of the bigram mix (pair, unigram, uniform) and of the trigram mix (triple, bigram, unigram, uniform).
BIGRAM_MIX = (0.85, 0.12, 0.03)
TRIGRAM_MIX = (0.80, 0.15, 0.04, 0.01)
#: Counts by which the neighbours must have been seen more often with one of two characters than with the other.
EVIDENCE = 3


class NgramModel:
    """``(text, place, character there, candidate)`` to the difference of log probabilities, or null without evidence. Pairs and
    triples are numbers (characters by their place among the sorted ones) in sorted arrays, 12 bytes each."""

    def __init__(self, unigrams: dict[str, int], pairs: tuple[np.ndarray, np.ndarray, np.ndarray], triples: tuple[np.ndarray, ...] | None = None, least_evidence: int = EVIDENCE) -> None:
        """pairs: two arrays of characters and one of counts; triples: three and one, or null."""
        self.least_evidence = least_evidence
        self.chars = sorted(unigrams)
        self.index = {c: i for i, c in enumerate(self.chars)}
        self.unigram = unigrams
        self.total, self.vocabulary = sum(unigrams.values()), len(unigrams)
        self.pairs = self._sorted(pairs)
        self.triples = self._sorted(triples) if triples is not None else None

    def _sorted(self, grams: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        *parts, counts = grams
        names = np.array(self.chars, dtype=str) if self.chars else np.zeros(0, "U1")
        key = np.zeros(len(counts), np.int64)
        known = np.ones(len(counts), bool)
        for part in parts:
            at = np.minimum(np.searchsorted(names, part), max(len(names) - 1, 0))
            known &= names[at] == part if len(names) else False
            key = key * len(names) + at
        key, counts = key[known], np.asarray(counts)[known]
        order = np.argsort(key)
        return key[order], counts[order].astype(np.int32 if not len(counts) or counts.max() < 1 << 31 else np.int64)

    def count(self, *chars: str) -> int:
        """How often the characters followed one another; 0 if not known."""
        keys, counts = self.pairs if len(chars) == 2 else self.triples
        key = 0
        for c in chars:
            at = self.index.get(c)
            if at is None:
                return 0
            key = key * self.vocabulary + at
        at = int(keys.searchsorted(key))
        return int(counts[at]) if at < len(keys) and keys[at] == key else 0

    def log_p(self, b: str, a: str = "", z: str = "") -> float:
        """Of ``b`` after ``a`` (after ``z, a`` with triples). Without ``a``, or with one that is not known, the unigram part
        stands alone; an unknown ``b`` has 1/V."""
        uniform = 1 / self.vocabulary
        seen = self.unigram.get(b)
        if seen is None:
            return log(uniform)
        uni = (seen + 1) / (self.total + self.vocabulary)
        if a not in self.unigram:
            return log(uni)
        p = BIGRAM_MIX[0] * self.count(a, b) / max(self.unigram[a], 1) + BIGRAM_MIX[1] * uni + BIGRAM_MIX[2] * uniform
        if self.triples is not None and z and (three := self.count(z, a, b)) and (two := self.count(z, a)):
            p = TRIGRAM_MIX[0] * three / two + TRIGRAM_MIX[1] * p + TRIGRAM_MIX[2] * uni + TRIGRAM_MIX[3] * uniform
        return log(p)

    def __call__(self, text: str, i: int, orig: str, cand: str) -> float | None:
        if not self.vocabulary:
            return None
        two = self.triples is not None
        p2, p1, n1, n2 = (text[k] if 0 <= k < len(text) else "" for k in (i - 2, i - 1, i + 1, i + 2))
        evidence = (abs(self.count(p1, cand) - self.count(p1, orig)) if p1 else 0) + (abs(self.count(cand, n1) - self.count(orig, n1)) if n1 else 0)
        if evidence < self.least_evidence:
            return None
        delta = self.log_p(cand, p1, p2) - self.log_p(orig, p1, p2)
        if n1:
            delta += self.log_p(n1, cand, p1) - self.log_p(n1, orig, p1)
        if two and n2:
            delta += self.log_p(n2, n1, cand) - self.log_p(n2, n1, orig)
        return delta
