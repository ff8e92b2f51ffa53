"""N-grams and neighbourhoods of whole Arrow columns of text, by numpy: no step runs for a character or a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together, and n-grams over a vocabulary that are counted in one array; others are sorted.
SLICE_BYTES, MOST_CELLS = 1 << 22, 1 << 22


def slices(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a string column of ``size`` bytes at most (SLICE_BYTES if not given), but for single long texts, each with the
    row that it begins at."""
    size = size or SLICE_BYTES
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + size, "right")), start + 1)
        yield start, column.slice(start, stop - start)
        start = stop


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all rows as numbers, one row after another, and each row's number of them. Null is empty."""
    texts = pc.fill_null(column, "")
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    return codes, pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def strings(columns: list[np.ndarray]) -> pa.Array:
    """Rows of characters, given by column as numbers, as strings; 0 is no character."""
    flat = np.ascontiguousarray(np.stack(columns, axis=1), dtype="<u4")
    return pa.array(flat.view(f"<U{len(columns)}").ravel().tolist(), pa.string())


def _ranked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct characters in order, and each character's place among them, from 1 on."""
    present = np.zeros(int(codes.max(initial=0)) + 1, bool)
    present[codes] = True
    known = np.flatnonzero(present)
    rank = np.zeros(len(present), np.int64)
    rank[known] = np.arange(1, len(known) + 1)
    return known, rank[codes]


def counted_grams(column: pa.Array, n: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """What begins at each character of each row, up to ``n`` characters long and shorter at a row's end, and how often."""
    for _, part in slices(column):
        codes, sizes = characters(part)
        if not len(codes):
            continue
        known, rank = _ranked(codes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters from here to the row's end
        base, key = len(known) + 1, rank
        if base**n >= 1 << 62:
            raise ValueError(f"n-grams of {n} over {base} characters")
        for k in range(1, n):
            after = np.zeros_like(rank)
            after[:-k] = rank[k:]
            after[left <= k] = 0
            key = key * base + after
        if base**n <= MOST_CELLS:
            counts = np.bincount(key, minlength=1)
            found = np.flatnonzero(counts)
            counts = counts[found]
        else:
            found, counts = np.unique(key, return_counts=True)
        names, parts = np.concatenate([[0], known]), []
        for _ in range(n):
            parts.append(names[found % base])
            found = found // base
        yield strings(parts[::-1]), counts


def neighbourhoods(column: pa.Array, wanted: np.ndarray | None, shifts: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.Array]]]:
    """Rows, places in them, and the characters there and at each of ``shifts`` from there (empty beyond the text), of the
    ``wanted`` characters, or of all."""
    for start, part in slices(column):
        codes, sizes = characters(part)
        ends = np.cumsum(sizes)
        if wanted is None:
            at = np.arange(len(codes))
        else:
            is_wanted = np.zeros(max(int(codes.max(initial=0)), int(wanted.max(initial=0))) + 1, bool)
            is_wanted[wanted] = True
            at = np.flatnonzero(is_wanted[codes])
        if not len(at):
            continue
        row = np.searchsorted(ends, at, "right")
        first = (ends - sizes)[row]
        known, rank = _ranked(codes)
        names = pa.array(["", *map(chr, known.tolist())])
        found = []
        for d in (0, *shifts):
            x = at + d
            inside = (x >= first) & (x < ends[row])
            found.append(names.take(pa.array(np.where(inside, rank[np.clip(x, 0, len(codes) - 1)], 0))))
        yield start + row, at - first, found
