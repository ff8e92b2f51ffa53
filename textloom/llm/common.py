"""What the corpus operators share: the shared scratch folder, checkpoints, Arrow mapping."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.tables import unused  # noqa: F401 (helper names that no input has)

#: Rows that a Python worker takes at a time inside an Arrow batch, and the bytes of text after which a slice ends.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 19
#: Rows of an Arrow batch. With long texts Spark's usual 10,000 would be a gigabyte.
BATCH_ROWS = 256

#: Filters by which a pass over the texts leaves out what is alone have so many bits for each key, up to so many in all (64 MB,
#: enough for some hundred million keys). Fuller filters let more through, which exact joins then drop.
KEY_BITS, MOST_FILTER_BITS = 8, 1 << 29

#: The words of a text: runs of anything but the ASCII space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("*",)))


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the cluster's checkpoint folder, so that later steps neither recompute it nor lose it
    with an executor. Where the session names no folder, a local session gets one of its own; a cluster, whose machines
    could not share it, is refused."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="textloom-"))
    return df.checkpoint()


def freed(df: DataFrame) -> DataFrame:
    """``settled``, and the shuffle files that led to it go at once: else they stay until the driver collects its garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return settled(df.select("*"))  # a plan of its own, which takes the setting
    finally:
        conf.set(name, before) if before is not None else conf.unset(name)


def plain_bytes(text: Column) -> Column:
    """A text's UTF-8 bytes; null is empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def small_batches(df: DataFrame) -> None:
    """Arrow batches of ``df``'s session hold BATCH_ROWS rows at most from here on: plans are run later, so this cannot be
    undone when a function returns. A session that asks for fewer keeps its own number."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))


def mapped(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``df`` through a function of small record batches. ``make`` runs once in each task and returns that function."""
    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in sliced(batch):
                if (out := step(part)) is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most SLICE_ROWS rows and, but for single long rows, SLICE_BYTES of its second column."""
    sizes = batch.column(1)
    if not (pa.types.is_binary(sizes.type) or pa.types.is_string(sizes.type) or pa.types.is_large_binary(sizes.type) or pa.types.is_large_string(sizes.type)):
        yield batch
        return
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and (total + n > SLICE_BYTES or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values of an unsigned 64-bit array, by minima from block borders."""
    n = len(key)
    if n < width:
        return key[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def bloom_of(keys: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of a column of hashes, two bits each. ``keys`` is read twice, so it should be a written table. Its size
    follows the number of keys; MOST_FILTER_BITS / 64 numbers reach the driver at most. Each task sends its bits once, about a
    byte each."""
    size = min(1 << max(KEY_BITS * keys.count(), 1 << 16).bit_length(), MOST_FILTER_BITS)
    chunk = min(size, 1 << 16)

    def own_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool) if size <= 1 << 20 else None
        packed = np.zeros(size // 8, np.uint8)
        some = False
        for batch in batches:
            key = batch.column(0).drop_null().to_numpy().view(np.uint64)
            if not len(key):
                continue
            some = True
            at = np.concatenate([key, key >> np.uint64(32)]) & np.uint64(size - 1)
            if bits is not None:
                bits[at.astype(np.int64)] = True
            else:
                np.bitwise_or.at(packed, (at >> np.uint64(3)).astype(np.int64), (np.uint64(1) << (at & np.uint64(7))).astype(np.uint8))
        if bits is not None:
            packed = np.packbits(bits, bitorder="little")
        for i in range(size // chunk if some else 0):
            part = packed[i * chunk // 8 : (i + 1) * chunk // 8]
            if not part.any():
                continue
            at = np.flatnonzero(np.unpackbits(part, bitorder="little"))
            gaps = np.diff(at, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2).T  # low bytes, then high ones, nearly all zero
            dense = len(at) * 8 >= chunk
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([dense]), pa.array([part.tobytes() if dense else gaps.tobytes()], pa.binary())], ["chunk", "dense", "bits"])

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, dense, body in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                part = np.frombuffer(body, np.uint8)
                if not dense:
                    bits = np.zeros(chunk, bool)
                    bits[np.cumsum(np.ascontiguousarray(part.reshape(2, -1).T).view("<u2").ravel(), dtype=np.int64)] = True
                    part = np.packbits(bits, bitorder="little")
                out[i] = out[i] | part if i in out else part
        for i, part in out.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["chunk", "bits"])

    parts = keys.select(F.col(column).cast("long").alias("key")).mapInArrow(own_bits, "chunk int, dense boolean, bits binary")
    found = parts.repartition("chunk").mapInArrow(united, "chunk int, bits binary").toArrow()
    out = np.zeros(size // 8, np.uint8)
    for i, part in zip(found["chunk"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[i * chunk // 8 : (i + 1) * chunk // 8] = np.frombuffer(part, np.uint8)
    return out.view(np.uint64)


def may_hold(bloom: np.ndarray, key: np.ndarray) -> np.ndarray:
    last = np.uint64(64 * len(bloom) - 1)
    has = lambda bit: (bloom[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)
    return (has(key & last) & has((key >> np.uint64(32)) & last)).astype(bool)
