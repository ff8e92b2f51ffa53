"""Segmentation into the most probable words of a lexicon, for use inside pandas UDFs."""

from __future__ import annotations

import re
from math import log

import ahocorasick

LATIN = re.compile("[A-Za-z0-9]+")
#: Characters of the texts, and of the runs in them, whose cuts are remembered.
REMEMBERED, REMEMBERED_RUNS = 200_000, 400_000

Token = tuple[str, str, int, int]


class Segmenter:
    """Cuts runs of text into words by the largest product of relative frequencies (dynamic programming over the graph of
    all lexicon words, which an automaton finds in one pass). Characters outside the lexicon are words of their own, tagged
    ``x``; runs of Latin letters and digits stay together, tagged ``eng`` unless the lexicon has them. Unknown words are not
    guessed. Characters of no word end what is weighed together, so a text is cut run by run. Recent cuts are remembered, as runs
    come again and stages ask for the same text and neighbourhoods; callers do not change them."""

    def __init__(self, lexicon: dict[str, tuple[int, str]], overrides: dict[str, str] | None = None) -> None:
        self.words, self.tags = lexicon, overrides or {}
        self.total = log(sum(f for f, _ in lexicon.values()) or 1)
        used = [w for w, (freq, _) in lexicon.items() if w and freq and freq > 0]
        self.sizes = [len(w) for w in used]
        self.scores = [log(lexicon[w][0]) - self.total for w in used]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, word in enumerate(used):
            self.automaton.add_word(word, i)
        if used:
            self.automaton.make_automaton()
        self.inside = re.compile(f"[{re.escape(''.join(sorted({*''.join(used)})))}]+") if used else None
        self.memo: dict[str, list[Token]] = {}
        self.runs: dict[str, list[Token]] = {}
        self.held = self.held_runs = 0

    def __reduce__(self) -> tuple:
        return Segmenter, (self.words, self.tags)

    def tag(self, word: str) -> str:
        known = self.words.get(word)
        return self.tags.get(word) or (known[1] if known else "eng" if LATIN.fullmatch(word) else "x")

    def cut(self, text: str) -> list[Token]:
        """``word, tag, start, end`` in order."""
        if text in self.memo:
            return self.memo[text]
        out: list[Token] = []
        at = 0
        for m in LATIN.finditer(text):
            self._cut_run(text, at, m.start(), out)
            out.append((m[0], self.tag(m[0]), m.start(), m.end()))
            at = m.end()
        self._cut_run(text, at, len(text), out)
        self.held += len(text)
        if self.held > REMEMBERED:
            self.memo.clear()
            self.held = len(text)
        self.memo[text] = out
        return out

    def _cut_run(self, text: str, begin: int, end: int, out: list[Token]) -> None:
        """Stretches of characters that words have, each cut by itself, and the others character by character."""
        at = begin
        for m in self.inside.finditer(text, begin, end) if self.inside else ():
            first, last = m.span()
            if at < first:
                self._alone(text, at, first, out)
            run = m[0]
            tokens = self.runs.get(run)
            if tokens is None:
                tokens = self._weighed(run)
                self.held_runs += len(run)
                if self.held_runs > REMEMBERED_RUNS:
                    self.runs.clear()
                    self.held_runs = len(run)
                self.runs[run] = tokens
            out += [(word, tag, first + i, first + j) for word, tag, i, j in tokens]
            at = last
        if at < end:
            self._alone(text, at, end, out)

    def _alone(self, text: str, begin: int, end: int, out: list[Token]) -> None:
        own, known = self.tags, self.words
        out += [(c, own.get(c) or (known[c][1] if c in known else "x"), i, i + 1) for i, c in enumerate(text[begin:end], begin)]

    def _weighed(self, run: str) -> list[Token]:
        """Of equal products the longer word at the first difference."""
        n = len(run)
        found: list[list[int]] = [[] for _ in range(n)]  # words by their start, shorter ones first
        for last, i in self.automaton.iter(run):
            found[last + 1 - self.sizes[i]].append(i)
        best = [0.0] * (n + 1)
        step = [1] * n
        for i in range(n - 1, -1, -1):
            top, far = best[i + 1] - self.total, 1
            for k in found[i]:
                size = self.sizes[k]
                score = self.scores[k] + best[i + size]
                if score >= top:
                    top, far = score, size
            best[i], step[i] = top, far
        out: list[Token] = []
        i, known, own = 0, self.words, self.tags
        while i < n:
            j = i + step[i]
            word = run[i:j]
            out.append((word, own.get(word) or (known[word][1] if word in known else "x"), i, j))  # no Latin letters here
            i = j
        return out
