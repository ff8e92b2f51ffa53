"""Periodic runs of words: all lags, vectorised (operator 13).

A text's words become numbers. For every shift up to a third of the text the numbers are compared with themselves that far
on; stretches of equal places are runs. A stretch long enough for a run of period q covers several neighbours of any grid of
step q/2, so for each shift the grid is compared first, many shifts and documents at a time, and only texts with enough equal
neighbours there are compared place by place. Texts of many words are dealt to tasks by ranges of shifts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import mapped, plain_bytes, settled

#: A run has so many words and is so many times its period.
LEAST_WORDS, LEAST_EXPONENT = 24, 3
#: Neighbours of the grid that every stretch of a run covers.
PROBES = 4
#: Texts of more bytes are dealt to tasks by ranges of shifts, of which each is LAG_WORK comparisons if no grid helps; longer
#: texts have larger ranges, MOST_RANGES at most.
LONG_BYTES, LAG_WORK, MOST_RANGES = 1 << 16, 1 << 28, 64

RUN = "array<struct<start: int, length: int, period: int>>"
RESULT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which word stands at each place of the text that is examined, for the documents (a tenth, told by their ids) into which
    a repeat is written; null for the others, those without an id among them."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def _needed(q: int | np.ndarray) -> int | np.ndarray:
    """Equal places in a row that make a run of period ``q``: its length but for one period."""
    return np.maximum(LEAST_WORDS - q, (LEAST_EXPONENT - 1) * q)


def _smallest_period(run: np.ndarray, q: int) -> int:
    """Of a run with period ``q``, three times as long at least. Its smallest period divides q."""
    for prime in _primes(q):
        while q % prime == 0 and np.array_equal(run[q // prime :], run[: -(q // prime)]):
            q //= prime
    return q


def _primes(n: int) -> Iterator[int]:
    d = 2
    while d * d <= n:
        if n % d == 0:
            yield d
            while n % d == 0:
                n //= d
        d += 1
    if n > 1:
        yield n


class _Found:
    """The runs of one text so far, as columns."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int]] = []
        self.table = np.zeros((3, 0), np.int64)

    def covers(self, q: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which stretches of equal places lie in a known run whose period divides ``q``: no other run of period q has a place
        there that equals the one ``q`` on, as it would share a period's words with the known one and so be it."""
        if self.table.shape[1] < len(self.rows):
            self.table = np.array(self.rows, np.int64).T
        start, length, period = self.table[:, q % self.table[2] == 0] if len(self.rows) else self.table
        return ((start[:, None] <= first) & (last + q < (start + length)[:, None])).any(0) if len(start) else np.zeros(len(first), bool)


def find_runs(words: np.ndarray, bounds: np.ndarray, lags: tuple[int, int] | None = None) -> list[list[tuple[int, int, int]]]:
    """``start, length, period`` of each text's runs, by start and period. ``words`` holds the texts' numbers one after another,
    the longest text first; no two texts share a number. With ``lags`` only runs whose period is in that range (end exclusive)."""
    sizes = np.diff(bounds)
    found = [_Found() for _ in sizes]
    # Places beyond the end equal nothing.
    body = np.concatenate([words, np.full((int(sizes[0]) if len(sizes) else 0) + LEAST_WORDS, -1, words.dtype)])
    low, high = lags or (1, 1 + (int(sizes[0]) // LEAST_EXPONENT if len(sizes) else 0))
    q = low
    while q < high:
        n_texts = int(np.searchsorted(-sizes, -max(LEAST_WORDS, LEAST_EXPONENT * q), "right"))
        if not n_texts:
            break
        most = min(high - q, max(1, q // 16))
        step = int(_needed(q)) // PROBES
        n = int(bounds[n_texts])
        n_grid = max(0, -(-(n - q) // step))
        grid = body[: n_grid * step : step]
        further = np.lib.stride_tricks.as_strided(body[q:], (most, n_grid), (body.strides[0], body.strides[0] * step), writeable=False)
        same = grid == further
        hits = same[:, : n_grid - PROBES + 1] if n_grid >= PROBES else same[:, :0]
        for k in range(1, PROBES if hits.size else 1):
            hits = hits & same[:, k : n_grid - PROBES + 1 + k]
        if hits.size and hits.any():
            row, at = np.nonzero(hits)
            text = np.searchsorted(bounds, at * step, "right") - 1
            fresh = np.append(True, (np.diff(at) != 1) | (np.diff(row) != 0) | (np.diff(text) != 0))
            ends = np.append(np.flatnonzero(fresh)[1:], len(at)) - 1
            row, text, first = row[fresh], text[fresh], at[fresh] * step
            last = np.minimum((at[ends] + PROBES - 1) * step, bounds[text + 1] - 1 - q - row)
            for k in np.unique(row).tolist():
                lag, own = q + k, row == k
                for i in np.unique(text[own]).tolist():
                    mine = own & (text == i)
                    if sizes[i] >= LEAST_EXPONENT * lag and not found[i].covers(lag, first[mine] - bounds[i], last[mine] - bounds[i]).all():
                        _scan(words[bounds[i] : bounds[i + 1]], lag, found[i], lags)
        q += most
    return [sorted(x for x in f.rows if not lags or lags[0] <= x[2]) for f in found]


def _scan(words: np.ndarray, q: int, found: _Found, lags: tuple[int, int] | None) -> None:
    """Compares a whole text with itself ``q`` on and keeps the runs among its stretches. With ``lags`` the runs of smaller
    periods are kept too, for what they cover; their owners report them."""
    same = np.zeros(len(words) - q + 2, bool)
    np.equal(words[:-q], words[q:], out=same[1:-1])
    edge = np.flatnonzero(same[1:] != same[:-1])
    start, stop = edge[::2], edge[1::2]
    long = stop - start >= _needed(q)
    start, stop = start[long], stop[long]
    if len(start):
        known = found.covers(q, start, stop - 1)
        for a, b in zip(start[~known].tolist(), stop[~known].tolist(), strict=True):
            period = _smallest_period(words[a : b + q], q)
            if period == q or lags:
                found.rows.append((a, b + q - a, period))


def numbered(texts: list[bytes], doc_ids: list[int | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text, repeats written in; their numbers one text after another; and where each text begins. Words are
    told apart by their bytes, and no two texts share a number."""
    words, numbers, fresh = [], [], count()
    for text, doc_id in zip(texts, doc_ids, strict=True):
        own = text.split()  # of bytes: the six ASCII white spaces
        if (place := planted(len(own), doc_id)) is not None:
            own = [own[i] for i in place.tolist()]
        known = dict.fromkeys(own)
        known = dict(zip(known, fresh, strict=False))
        words.append(own)
        numbers.append(np.fromiter(map(known.__getitem__, own), np.int32, len(own)))
    return words, np.concatenate([*numbers, np.zeros(0, np.int32)]), np.append(0, np.cumsum([len(x) for x in words]))


def report(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """A row's columns but for its id, from its words and its runs by start and period."""
    kept = words
    if runs:
        start, length, period = np.array(runs, np.int64).T
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, start + period, 1)
        np.add.at(depth, start + length, -1)
        kept = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    listed = "".join(f"{a},{n},{p}\n" for a, n, p in runs).encode()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(words), len(runs), *top, sha256(listed).hexdigest(), sha256(b" ".join(kept)).hexdigest()


def _rows(ids: list, rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split(" ")[0] for x in RESULT.split(", ")]
    kinds = [pa.string() if x.endswith("sha256") else pa.int64() for x in names]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([ids, *zip(*rows, strict=True)], kinds, strict=True)], names)


def _short(docs: DataFrame) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            order = sorted(range(len(texts)), key=lambda i: -texts[i].count(b" ") - texts[i].count(b"\n"))
            words, numbers, bounds = numbered([texts[i] for i in order], [ids[i] for i in order])
            by = np.argsort(-np.diff(bounds), kind="stable")
            numbers = np.concatenate([numbers[bounds[i] : bounds[i + 1]] for i in by.tolist()])
            runs = find_runs(numbers, np.append(0, np.cumsum(np.diff(bounds)[by])))
            return _rows([ids[order[i]] for i in by.tolist()], [report(words[i], r) for i, r in zip(by.tolist(), runs, strict=True)])

        return step

    return mapped(docs, make, RESULT)


def lag_ranges(n_words: int, work: int = LAG_WORK) -> list[tuple[int, int]]:
    """Ranges of shifts (end exclusive) of at most ``work`` comparisons, but for a single shift, that make up all shifts up to a
    third of the words. Where that would be more than about MOST_RANGES, ranges are wider."""
    most, out, low = n_words // LEAST_EXPONENT, [], 1
    work = max(work, n_words * most // MOST_RANGES)
    while low <= most:
        high = min(most + 1, low + max(1, work // max(n_words - low, 1)))
        out.append((low, high))
        low = high
    return out


def _long(docs: DataFrame, work: int) -> DataFrame:
    """Texts are written once, compressed; tasks get a text's numbers and a range of shifts, and their runs come together by
    text (a text of n words has fewer than n runs)."""

    def number():
        squeeze = zstandard.ZstdCompressor(level=3).compress

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            numbers, ranges = [], []
            for text, doc_id in zip(texts, batch.column(0).to_pylist(), strict=True):
                own = numbered([text], [doc_id])[1]
                numbers.append(squeeze(own.tobytes()))
                ranges.append([{"low": a, "high": b} for a, b in lag_ranges(len(own), work)])
            kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze(x) for x in texts]), pa.array(numbers), pa.array(ranges, kind)], ["doc_id", "text", "numbers", "ranges"])

        return step

    texts = settled(mapped(docs, number, "doc_id long, text binary, numbers binary, ranges array<struct<low: int, high: int>>").withColumn("row", F.monotonically_increasing_id()))
    ranges = texts.select("row", "numbers", F.explode("ranges").alias("r")).select("row", "numbers", "r.low", "r.high").repartition(F.xxhash64("row", "low"))

    def search():
        expand = zstandard.ZstdDecompressor().decompress

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            runs = []
            for numbers, low, high in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                own = np.frombuffer(expand(numbers), np.int32)
                runs.append([dict(zip(("start", "length", "period"), x, strict=True)) for x in find_runs(own, np.array([0, len(own)]), (low, high))[0]])
            kind = pa.list_(pa.struct([(x, pa.int32()) for x in ("start", "length", "period")]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, kind)], ["row", "runs"])

        return step

    runs = mapped(ranges, search, f"row long, runs {RUN}").groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    both = texts.select("row", "text", "doc_id").join(runs, "row", "left")

    def finish():
        expand = zstandard.ZstdDecompressor().decompress

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, rows = batch.column(2).to_pylist(), []
            for doc_id, text, runs in zip(ids, batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = numbered([expand(text)], [doc_id])[0][0]
                rows.append(report(words, sorted((r["start"], r["length"], r["period"]) for r in runs or ())))
            return _rows(ids, rows)

        return step

    return mapped(both, finish, RESULT)


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_bytes: int = LONG_BYTES, work: int = LAG_WORK) -> DataFrame:
    """``doc_id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256``: one row for each row of
    ``df``. A run is a stretch of LEAST_WORDS words or more, LEAST_EXPONENT times its smallest period or more, that no
    neighbouring word extends; of all runs there are the number, the one of greatest length by period (ties: smallest start,
    then period) and a digest, and a digest of the words that are left once every run is cut to its first period.

    Words are runs without ASCII white space. A tenth of the documents get a repeat written in first (``planted``). Null text has
    no words; texts without a run have null in ``start`` to ``exponent_milli``. Rows that repeat and rows with null ids are
    rows of their own; null ids have no repeat written in. Only the two named columns are read. Texts of more than
    ``long_bytes`` are searched by ranges of shifts, each of at most ``work`` comparisons; the result is the same."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), plain_bytes(F.col(text_col).cast("string")).alias("text"))
    long = F.octet_length("text") > long_bytes
    return _short(docs.filter(~long)).unionByName(_long(docs.filter(long), work))
