"""Codes of vectors: product quantisation by Lloyd rounds with Elkan's bounds (operator 12).

Vectors are whole numbers, cut into parts; every part position has a codebook of its own. The first assignment measures all
entries and writes, for each part of each vector, an upper bound to its entry and a lower bound to each entry of the codebook.
Later rounds never measure all again: bounds are shifted by as far as the entries have moved since, entries that the triangle
inequality rules out are skipped, and what is left is compared in whole numbers, so that ties are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import mapped, settled, sliced, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Labels up to which their sums are broadcast (some 20 MB); more are joined by a shuffle.
MOST_LABELS = 200_000
#: Squared distances stay below it, so that they are whole numbers in floating point.
EXACT = 1 << 53
#: Rounding of square roots and of stored bounds is far smaller than this share.
SLACK = 1e-5


def usable(vector: Column | str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    x = F.col(vector) if isinstance(vector, str) else vector
    inf = float("inf")
    return F.coalesce(~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == inf)), F.lit(False))


def whole_parts(vectors: np.ndarray, parts: int, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` of rows of components, as (row, part, place)."""
    made = np.floor(vectors * scale)
    size = made.shape[1] // parts
    if made.size and 4 * size * float(np.abs(made).max()) ** 2 >= EXACT:
        raise ValueError("components are too large for exact distances")
    return made.astype(np.int64).reshape(len(made), parts, size)


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """All squared distances between whole-number rows; every number on the way is below EXACT, so floating point is exact."""
    x, book = x.astype(float), book.astype(float)
    return ((x * x).sum(1)[:, None] + (book * book).sum(1) - 2 * (x @ book.T)).astype(np.int64)


class Bounds:
    """What is stored of a batch of parts: the entry of the first assignment, an upper bound to it, and lower bounds to all
    entries, rounded down to one of 256 steps between the least and the greatest."""

    def __init__(self, entry: np.ndarray, upper: np.ndarray, low: np.ndarray, step: np.ndarray, lower: np.ndarray) -> None:
        self.entry, self.upper, self.low, self.step, self.lower = entry, upper, low, step, lower

    @classmethod
    def first(cls, x: np.ndarray, book: np.ndarray) -> Bounds:
        far = squared(x, book)
        entry = far.argmin(1)
        root = np.sqrt(far)
        low = (root.min(1) * (1 - SLACK)).astype(np.float32)
        step = np.maximum((root.max(1) - low) / 255, 1e-6).astype(np.float32)
        lower = np.clip(np.floor((root - low[:, None]) / step[:, None] * (1 - SLACK)), 0, 255).astype(np.uint8)
        return cls(entry, (root[np.arange(len(x)), entry] * (1 + SLACK)).astype(np.float32), low, step, lower)

    def nearest(self, x: np.ndarray, book: np.ndarray, moved: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (ties to the lower) and squared distance. ``moved`` is how far each entry is from where it was when
        the bounds were stored, ``halves`` half the distances between entries."""
        rows = np.arange(len(x))
        entry = self.entry
        own = ((x - book[entry]) ** 2).sum(1)
        lower = (self.low[:, None] + self.lower * self.step[:, None]) * (1 - SLACK) - moved * (1 + SLACK)
        # A first look with the stored upper bound; only rows in which another entry may be as near need the true distance.
        upper = (self.upper + moved[entry]) * (1 + SLACK)
        may = lower <= upper[:, None]
        open_ = np.flatnonzero(may.sum(1) > may[rows, entry])
        best, least = entry.copy(), own.copy()
        if len(open_):
            near = np.sqrt(own[open_]) * (1 + SLACK)
            may = may[open_] & (lower[open_] <= near[:, None]) & (halves[entry[open_]] <= near[:, None])
            may[np.arange(len(open_)), entry[open_]] = True
            at, other = np.nonzero(may)
            far = ((x[open_][at] - book[other]) ** 2).sum(1)
            starts = np.searchsorted(at, np.arange(len(open_)))
            low = np.minimum.reduceat(far, starts)
            first = np.minimum.reduceat(np.where(far == low[at], other, len(book)), starts)
            best[open_], least[open_] = first, low
        return best, least


class Assigner:
    """Assigns parts of stored rows to the entries of ``books`` by bounds that were taken with the codebooks ``stored``."""

    def __init__(self, stored: np.ndarray, books: np.ndarray) -> None:
        self.books = books
        self.moved = np.sqrt(((books - stored) ** 2).sum(2))
        self.halves = np.array([np.sqrt(np.maximum(squared(b, b), 0)) / 2 * (1 - SLACK) for b in books])

    def __call__(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whole-number parts, entries and squared distances, as (row, part[, place])."""
        parts, entries, size = self.books.shape
        n = batch.num_rows
        column = lambda name, kind, *shape: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(n, parts, *shape)
        x = column("whole", np.int32, size).astype(np.int64)
        first, upper, low, step = (column(c, k) for c, k in (("entry", np.uint8), ("upper", np.float32), ("low", np.float32), ("step", np.float32)))
        lower = column("lower", np.uint8, entries)
        found = [Bounds(first[:, p].astype(np.int64), upper[:, p], low[:, p], step[:, p], lower[:, p]).nearest(x[:, p], self.books[p], self.moved[p], self.halves[p]) for p in range(parts)]
        return x, np.stack([a for a, _ in found], 1), np.stack([d for _, d in found], 1)


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def _stored(vectors: DataFrame, books: np.ndarray, label_type: str) -> DataFrame:
    """``vec_id, whole, label`` and the bounds of the first assignment."""
    parts = len(books)
    names = ["vec_id", "whole", "label", "entry", "upper", "low", "step", "lower"]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = whole_parts(np.stack([*batch.column(1).to_numpy(zero_copy_only=False)]).astype(float), parts)
            found = [Bounds.first(x[:, p], books[p]) for p in range(parts)]
            columns = [np.stack([getattr(b, name) for b in found], 1) for name in ("entry", "upper", "low", "step", "lower")]
            columns[0] = columns[0].astype(np.uint8)
            return pa.RecordBatch.from_arrays([batch.column(0), _bytes(x.astype(np.int32)), batch.column(2), *map(_bytes, columns)], names)

        return step

    return mapped(vectors, make, f"vec_id long, whole binary, label {label_type}, " + ", ".join(f"{x} binary" for x in names[3:]))


def _moved(state: DataFrame, stored: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: tasks add up their parts by entry, so each sends one row for each entry at most."""
    parts, entries, size = books.shape
    sums = [f"s{i}" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = Assigner(stored, books)
        total, count = np.zeros((parts * entries, size), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for part in sliced(batch):
                x, entry, _ = assign(part)
                slot = (entry + np.arange(parts) * entries).ravel()
                np.add.at(total, slot, x.reshape(-1, size))
                count += np.bincount(slot, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *(pa.array(total[used, i]) for i in range(size))], ["slot", "n", *sums])

    small_batches(state)
    rows = state.drop("vec_id", "label").mapInArrow(run, ", ".join(f"{x} long" for x in ["slot", "n", *sums]))
    got = rows.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in sums)).toArrow()  # parts * entries rows at most
    out = books.reshape(-1, size).copy()
    if got.num_rows:
        total = np.stack([got[x].to_numpy() for x in sums], 1)
        out[got["slot"].to_numpy()] = total // got["n"].to_numpy()[:, None]
    return out.reshape(books.shape)


def quantise(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``: each vector as the indexes of its parts' nearest codebook entries (two
    hex digits each), its squared distance from them, that summed over all rows of its label (null is a label), and a digest of
    the codebooks. Components are ``floor(1024 * x)``. Codebooks start as the parts of the ``entries`` (256 at most) rows of
    smallest id (null ids last, ties by components) and move to their parts' means, rounded down, ``rounds`` times.

    Vectors that are null or hold null or non-finite components are left out, and so are those whose length is not the
    commonest one that divides into ``parts`` (ties: the longer). Rows that repeat are rows of their own. No such vector gives
    no rows. Components beyond some 10^6 are refused, as distances would no longer be exact. Only the named columns are read."""
    kept = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label")).filter(usable("vector"))
    label_type = dict(kept.dtypes)["label"]
    label_type = "int" if label_type == "void" else label_type
    length = F.size("vector")
    common = kept.filter((length > 0) & (length % parts == 0)).groupBy(length.alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if common is None:
        return df.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    vectors = kept.filter(length == common["length"]).select("vec_id", "vector", F.col("label").cast(label_type).alias("label"))
    seeds = vectors.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).toArrow()
    first = whole_parts(np.stack([*seeds["vector"].to_numpy()]).astype(float), parts).transpose(1, 0, 2)
    state = settled(_stored(vectors, first, label_type))
    books = first
    for _ in range(rounds):
        books = _moved(state, first, books)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        assign = Assigner(first, books)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            _, entry, far = assign(batch)
            return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([bytes(row).hex() for row in entry.astype(np.uint8)]), pa.array(far.sum(1))], ["vec_id", "label", "code", "error"])

        return step

    coded = settled(mapped(state, make, f"vec_id long, label {label_type}, code string, error long"))
    of_label = settled(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "own")
    few = of_label.count() <= MOST_LABELS
    digest = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    joined = coded.join(F.broadcast(of_label) if few else of_label, F.col("label").eqNullSafe(F.col("own")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
