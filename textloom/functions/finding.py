"""Which of very many words a text holds, also while it changes: an Aho-Corasick automaton for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import ahocorasick


class Finder:
    """Finds all of a list's words in one pass over a text, whatever their number. Empty words are never found. Only the words
    are pickled; a worker builds the automaton once."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = list(words)
        places: dict[str, list[int]] = {}
        for i, word in enumerate(self.words):
            if word:
                places.setdefault(word, []).append(i)
        self.longest = max(map(len, places), default=0)
        self.automaton = ahocorasick.Automaton()
        for word, own in places.items():
            self.automaton.add_word(word, tuple(own))
        if places:
            self.automaton.make_automaton()

    def __reduce__(self) -> tuple:
        return Finder, (self.words,)

    def hits(self, text: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, tuple[int, ...]]]:
        """Where each word in ``text[start:end]`` ends (exclusive), and which words of the list it is."""
        if self.longest:
            for last, own in self.automaton.iter(text, start, len(text) if end is None else end):
                yield last + 1, own

    def any(self, text: str) -> bool:
        return next(self.hits(text), None) is not None

    def found(self, text: str, start: int = 0, end: int | None = None) -> set[int]:
        return {i for _, own in self.hits(text, start, end) for i in own}


class Queue:
    """The words of a text in the list's order. Words that a change brings in come up too, if their turn is not over."""

    def __init__(self, finder: Finder, text: str) -> None:
        self.finder, self.turn = finder, -1
        self.known = finder.found(text)
        self.waiting = list(self.known)
        heapify(self.waiting)

    def next(self) -> int | None:
        self.turn = heappop(self.waiting) if self.waiting else None
        return self.turn

    def changed(self, text: str, spans: Iterable[tuple[int, int]]) -> None:
        """``text`` is new inside ``spans``, which come in order. Only what can reach into them is looked at."""
        reach = self.finder.longest - 1
        low = high = 0
        windows = []
        for start, end in spans:
            start, end = max(0, start - reach), min(len(text), end + reach)
            if start > high:
                windows.append((low, high))
                low = start
            high = end
        for low, high in [*windows, (low, high)]:
            for i in self.finder.found(text, low, high) - self.known:
                self.known.add(i)
                if i > self.turn:
                    heappush(self.waiting, i)
