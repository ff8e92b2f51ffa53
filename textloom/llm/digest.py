"""Improbable-feature digests of documents (operator 2).

Every window of 32 bytes has an entropy; how many windows of the whole corpus share that entropy ranks it, the rarest
first. A window that is the least ranked in many of the runs of windows over it is a feature; a feature's hash sets bits
in Bloom filters that are chained as they fill, and two digests are alike as far as their filters share more bits than
chance gives.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import SLICE_BYTES, mapped, plain_bytes, sliced, small_batches

WINDOW = 32
#: Entropies are told apart in as many steps; scaled sums of n log n are whole numbers, so equal windows have equal ones.
STEPS = 1000
#: A run of RUN windows elects its least ranked one, the leftmost of equals; windows elected VOTES times or more are features.
RUN, VOTES = 24, 6
FILTER_BITS, FILTER_FEATURES, FEATURE_BITS = 2048, 160, 5
_SCALE = 1 << 20
_NLOGN = np.array([0] + [round(n * np.log2(n) * _SCALE) for n in range(1, WINDOW + 1)], np.int64)
_MOST = int(_NLOGN[WINDOW])
_STEP = 1 << 15


def entropy_steps(data: np.ndarray) -> np.ndarray:
    """For each window of ``data`` its entropy's step, 0 (one byte value) to STEPS. Sliding by a byte changes the counts of
    two values only; how often a byte occurs among the bytes of the windows before and after it is counted by shifted comparisons."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int16)
    after, before = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for at in range(0, n, _STEP):  # a stretch stays in the processor's cache
        part = data[at : at + _STEP + WINDOW]
        m = min(_STEP, n - at)
        for d in range(1, WINDOW):
            k = min(m, len(part) - d)
            if k <= 0:
                break
            same = part[:k] == part[d : d + k]
            after[at : at + k] += same
            before[at + d : at + d + k] += same
    first = np.bincount(data[:WINDOW], minlength=256)
    gone = after[: n - WINDOW].astype(np.int64) + 1  # count of the byte that leaves, in the window that it leaves
    come = before[WINDOW:].astype(np.int64)  # count of the byte that comes, among the bytes that stay
    delta = _NLOGN[gone - 1] - _NLOGN[gone] + _NLOGN[come + 1] - _NLOGN[come]
    total = np.append(0, np.cumsum(delta)) + int(_NLOGN[first].sum())
    return ((_MOST - total) * STEPS // _MOST).astype(np.int16)


def features(steps: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Start positions of the features in a text whose windows have these entropy steps. Windows of one byte value only
    (step 0) are none."""
    n = len(steps)
    if not n:
        return np.zeros(0, np.int64)
    key = (rank[steps].astype(np.int64) << 32) | np.arange(n)
    if n <= RUN:
        elected, votes = np.array([key.min() & 0xFFFFFFFF]), np.array([RUN])
    else:
        padded = np.full(-(-n // RUN) * RUN, np.iinfo(np.int64).max)
        padded[:n] = key
        blocks = padded.reshape(-1, RUN)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(behind[: n - RUN + 1], ahead[RUN - 1 : n]) & 0xFFFFFFFF
        at = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        elected, votes = low[at], np.diff(np.append(at, len(low)))
    # Texts of few runs elect what they can.
    least = min(VOTES, max(1, n - RUN + 1))
    return elected[(votes >= least) & (steps[elected] > 0)]


def digests(bodies: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Each text's chained filters, one row of bytes each; no row for an empty text. Equal texts have equal digests. A text
    without features (shorter than a window, say) has one, itself. The texts' entropies are computed in one array."""
    steps = entropy_steps(np.frombuffer(b"".join(bodies), np.uint8))
    out, start = [], 0
    for body in bodies:
        out.append(_digest(body, steps[start : max(start, start + len(body) - WINDOW + 1)], rank))
        start += len(body)
    return out


def _digest(data: bytes, steps: np.ndarray, rank: np.ndarray) -> np.ndarray:
    hashed, view = xxhash.xxh3_64_intdigest, memoryview(data)
    found = features(steps, rank)
    codes = np.fromiter((hashed(view[i : i + WINDOW]) for i in found.tolist()), np.uint64, len(found))
    if data and not len(codes):
        codes = np.array([hashed(data)], np.uint64)
    if not len(codes):
        return np.zeros((0, FILTER_BITS // 8), np.uint8)
    _, first = np.unique(codes, return_index=True)
    codes = codes[np.sort(first)]  # a feature that repeats is put in once
    bits = (codes[:, None] >> (np.uint64(11) * np.arange(FEATURE_BITS, dtype=np.uint64))) & np.uint64(FILTER_BITS - 1)
    chain = np.arange(len(codes)) // FILTER_FEATURES
    out = np.zeros((int(chain[-1]) + 1, FILTER_BITS), np.uint8)
    out[chain[:, None], bits.astype(np.int64)] = 1
    return np.packbits(out, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter of the digest with fewer filters takes its best overlap in the other, less what two such filters
    share by chance; the mean counts. Equal digests give 1 (two empty ones too), an empty one and another 0."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    set_a, set_b = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    best = np.zeros(len(a))
    for i, row in enumerate(a):
        both = np.bitwise_count(row & b).sum(1, dtype=np.int64)
        chance = set_a[i] * set_b / FILTER_BITS
        most = np.minimum(set_a[i], set_b)
        best[i] = max(0.0, float(np.max((both - chance) / np.maximum(most - chance, 1e-9))))
    return float(min(1.0, best.mean()))


def text_of(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def rarity(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """The rank of each entropy step by the number of windows in all texts that have it, the rarest first; equal counts by
    step. Counts are summed inside tasks, so STEPS + 1 sums reach the driver whatever the corpus holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            for part in sliced(batch):
                bodies = part.column(1).to_pylist()
                steps = entropy_steps(np.frombuffer(b"".join(bodies), np.uint8))
                inside = np.ones(len(steps), bool)  # not across two texts
                end = 0
                for x in bodies:
                    end += len(x)
                    inside[max(end - len(x), end - WINDOW + 1) : end] = False
                total += np.bincount(steps[inside], minlength=STEPS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["step", "n"])

    small_batches(df)
    texts = df.select(F.lit(0).alias("none"), plain_bytes(F.col(text_col).cast("string")).alias("b"))
    n = np.zeros(STEPS + 1, np.int64)
    for r in texts.mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():
        n[r.step] = r.n
    rank = np.empty(STEPS + 1, np.int64)
    rank[np.lexsort((np.arange(STEPS + 1), n))] = np.arange(STEPS + 1)
    return rank


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: np.ndarray | None = None) -> DataFrame:
    """``doc_id, fingerprint`` (base64 of the chained filters) of every row; null text is empty and has an empty one."""
    rank = rarity(df, text_col) if rank is None else rank

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_of(x) for x in digests(batch.column(1).to_pylist(), rank)])], ["doc_id", "fingerprint"])

        return step

    return mapped(df.select(F.col(id_col).cast("long").alias("doc_id"), plain_bytes(F.col(text_col).cast("string")).alias("text")), make, "doc_id long, fingerprint string")


#: Rows of a part that is sorted by id, and parts at most.
PART_ROWS, MOST_PARTS = 1000, 100_000
#: Cuts are doubles; the largest that is a long.
_FAR = float(2**63 - 1024)


def in_order(docs: DataFrame) -> DataFrame:
    """``part, copied, at, doc_id, text``, sorted within partitions so that in each part every document is followed by the
    next one in ascending id, and the last by a copy of the next part's first (after all: of the table's first). ``docs`` is
    ``doc_id, text``; null ids come first, equal ids by text. Parts are cut at approximate quantiles of the ids; what
    reaches the driver is a few numbers for each part."""
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("at"))
    n = docs.count()
    parts = max(1, min(-(-n // PART_ROWS), MOST_PARTS))
    cuts = np.unique(np.array(docs.approxQuantile("at", [i / parts for i in range(1, parts)], 0.2 / parts), dtype=np.float64).clip(-_FAR, _FAR).astype(np.int64)) if parts > 1 else np.zeros(0, np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def part_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, at.to_numpy(), "right").astype(np.int32))

    firsts = sorted((r.part, r.first) for r in docs.select("at").withColumn("part", part_of("at")).groupBy("part").agg(F.min("at").alias("first")).collect())
    if not firsts:
        return docs.select(F.lit(0).alias("part"), F.lit(False).alias("copied"), "at", "doc_id", "text")
    follows = docs.sparkSession.createDataFrame([(part, first) for (part, _), (_, first) in zip(firsts, firsts[1:] + firsts[:1], strict=True)], "part int, at long")
    copies = docs.join(F.broadcast(follows), "at")  # as many rows as parts, but for ids that repeat
    both = docs.withColumn("part", part_of("at")).withColumn("copied", F.lit(False)).unionByName(copies.withColumn("copied", F.lit(True)))
    return both.repartition("part").sortWithinPartitions("part", "copied", "at", "text").select("part", "copied", "at", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """``text`` with its last half (of the code points, rounded down) replaced by as much of ``following``'s beginning."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row: how like a
    text's digest is to that of the text with its second half replaced by the next document's beginning, and to the next
    document's. The only document of a table is its own next one. Other columns of ``df`` are not read."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rank = rarity(docs)

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        """Results for all rows that have their next one behind them."""
        pairs = [(i, a, b) for i, (a, b) in enumerate(zip(rows, rows[1:], strict=False)) if a[0] == b[0] and not a[1]]
        if not pairs:
            return None
        changed = [edited(a[3], b[3]).encode() for _, a, b in pairs]
        own = digests([r[3].encode() for r in rows], rank)
        new = digests(changed, rank)
        columns = [
            pa.array([a[2] for _, a, _ in pairs], pa.int64()),
            pa.array([len(a[3]) for _, a, _ in pairs], pa.int64()),
            pa.array([sha256(x).hexdigest() for x in changed]),
            pa.array([text_of(own[i]) for i, _, _ in pairs]),
            pa.array([text_of(x) for x in new]),
            pa.array([likeness(own[i], x) for (i, _, _), x in zip(pairs, new, strict=True)]),
            pa.array([likeness(own[i], own[i + 1]) for i, _, _ in pairs]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                rows.append(row)
                size += len(row[3])
                if size >= SLICE_BYTES:
                    if (out := flush(rows)) is not None:
                        yield out
                    rows, size = rows[-1:], len(rows[-1][3])
        if (out := flush(rows)) is not None:
            yield out

    ordered = in_order(docs)
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
