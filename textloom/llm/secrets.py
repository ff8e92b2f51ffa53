"""Secret scans (operator 6): fixed patterns, and guess costs of values in a credential context.

The cost of a value is that of its cheapest cut into words, dates, repeats, keyboard walks and brute-force spans, found by
dynamic programming; a value that costs more than a limit is taken for a secret. Words come from a tokenizer's vocabulary,
whose order stands for frequency.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import mapped, small_batches
from textloom.llm.tokens import tokenizer_path

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run that is too short holds no other that is long enough
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "guess")

#: Where a value is looked at by its cost: after a credential's name and a sign of assignment.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|auth)[ _-]?key|credentials?|auth|bearer)["']?\x20*(?::=|=>|[:=])\x20*["'`]?([^\s"'`<>,;]{6,})""", re.IGNORECASE | re.ASCII)
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")

#: Guesses, as a power of ten, from which on a value is a secret.
LEAST_GUESSES = 10.0
WORD_LEAST, WORD_MOST = 3, 24
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:[12]\d|3[01]|0?[1-9])|(?:[12]\d|3[01]|0?[1-9])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")


def _neighbours() -> set[tuple[str, str]]:
    """Pairs of keys that a walk may step between: side by side, or touching in the next row (rows are shifted by half a
    key), a key itself not."""
    place = {c: (2 * x + y, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    return {(a, b) for a, (xa, ya) in place.items() for b, (xb, yb) in place.items() if a != b and abs(ya - yb) <= 1 and abs(xa - xb) <= (2 if ya == yb else 1)}


class GuessCost:
    """log10 of the guesses that a value takes."""

    def __init__(self, ranks: dict[str, int]) -> None:
        self.ranks, self.near = ranks, _neighbours()

    def __call__(self, value: str) -> float:
        n, low = len(value), value.lower()
        best = [0.0] + [float("inf")] * n
        spans = self._spans(value, low)
        for end in range(1, n + 1):
            best[end] = best[end - 1] + log10(self._letters(value[end - 1]))
            for start, cost in spans.get(end, ()):
                best[end] = min(best[end], best[start] + cost)
        return best[n]

    @staticmethod
    def _letters(c: str) -> int:
        return 10 if c.isdigit() else 26 if c.isalpha() else 33

    def _spans(self, value: str, low: str) -> dict[int, list[tuple[int, float]]]:
        """By end: starts and costs of the words, dates, walks and repeats. Every such span costs a little to choose."""
        out: dict[int, list[tuple[int, float]]] = {}
        n, choose = len(value), log10(4)

        def add(start: int, end: int, guesses: float) -> None:
            out.setdefault(end, []).append((start, choose + log10(max(guesses, 1))))

        for start in range(n):
            for end in range(start + WORD_LEAST, min(n, start + WORD_MOST) + 1):
                if rank := self.ranks.get(low[start:end]):
                    part = value[start:end]
                    add(start, end, rank * (1 if part.islower() else 2 if part.istitle() or part.isupper() else 2 ** min(10, len(part))))
            if m := DATE.match(value, start):
                add(start, m.end(), 365 * 120)
        start = 0
        for i in range(1, n + 1):  # walks: maximal runs of steps to neighbours, or of constant distance (abc, 531)
            if i < n and (low[i - 1], low[i]) in self.near:
                continue
            if i - start >= 3:
                add(start, i, len(ROWS) * 12 * 4 ** min(6, (i - start) / 2) * (i - start))
            start = i
        start, step = 0, None
        for i in range(1, n + 1):
            now = ord(low[i]) - ord(low[i - 1]) if i < n else None
            if now == step and now is not None and abs(now) <= 2:
                continue
            if step is not None and i - start >= 3 and abs(step) <= 2:
                add(start, i, 36 * 4 * (i - start))
            start, step = i - 1, now
        for period in range(1, min(n // 2, 16) + 1):  # repeats of a short unit
            run = 0
            for i in range(period, n + 1):
                if i < n and low[i] == low[i - period]:
                    run += 1
                    continue
                if run >= max(period, 2):
                    start = i - run - period
                    add(start, i, 26.0**period * (run // period + 1))
                run = 0
        return out


@lru_cache(maxsize=1)
def cost_model(tokenizer: str) -> GuessCost:
    with open(tokenizer, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = [w.removesuffix("</w>") for w, _ in sorted(vocab.items(), key=lambda x: x[1]) if w.endswith("</w>")]
    return GuessCost({w: i + 1 for i, w in enumerate(dict.fromkeys(w for w in words if len(w) >= WORD_LEAST and w.isalpha()))})


def find_spans(text: str, cost: GuessCost, least: float = LEAST_GUESSES) -> list[tuple[str, int, int]]:
    """``kind, start, end`` in code points, by start and then kind. A costed value that a base span overlaps adds none."""
    low = text.lower()
    spans: list[tuple[str, int, int]] = []
    if any(x in low for x in ASSIGN_HINTS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    if any(x in low for x in CONTEXT_HINTS):
        begins, farthest = zip(*sorted((a, b) for _, a, b in spans), strict=True) if spans else ((), ())
        farthest = list(accumulate(farthest, max))  # the farthest end of the base spans up to each
        for m in CONTEXT.finditer(text):
            start, end = m.span(1)
            before = bisect_left(begins, end)
            if not (before and farthest[before - 1] > start) and cost(m[1]) >= least:
                spans.append(("guess", start, end))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(df: DataFrame, tokenizer: str | None = None, least: float = LEAST_GUESSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess``, one row for each row of ``df``; null text is empty
    and has no spans (the digest of the empty string). Other columns of ``df`` are not read."""
    path = tokenizer or tokenizer_path()

    def make():
        cost = cost_model(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = find_spans(text, cost, least)
                base = [x for x in spans if x[0] != "guess"]
                kinds = [k for k, _, _ in spans]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), sha256(_joined(base).encode()).hexdigest(), _joined(spans), kinds.count("guess")))
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()], strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

        return step

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return mapped(texts, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")


def redact_secrets(df: DataFrame, mark: str = "[SECRET]", tokenizer: str | None = None, least: float = LEAST_GUESSES, text_col: str = "text") -> DataFrame:
    """``df`` with every found span of ``text_col`` replaced by ``mark`` (spans that overlap or touch: one mark). Null text
    stays null; all other columns pass through unchanged, whatever their names."""
    path = tokenizer or tokenizer_path()

    @F.pandas_udf("string")
    def clean(texts):
        cost = cost_model(path)

        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for _, a, b in find_spans(text, cost, least):
                if a > at or not out:
                    out += [text[at:a], mark]
                at = max(at, b)
            return "".join([*out, text[at:]])

        return texts.map(one, na_action="ignore")

    small_batches(df)
    return df.withColumn(text_col, clean(F.col(text_col)))
