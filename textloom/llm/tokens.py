"""Encoding, packing and counting of tokens (operators 7, 8 and 3).

Null text is empty text throughout; a null id is kept as it is. Rows that repeat are encoded as often as they come.
Only the named columns are read, so further columns of the input, whatever their names, do not matter.
"""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.bpe import coder
from textloom.llm.common import mapped, settled, small_batches

SEQUENCE = 2048
#: Tokens of a batch of sequences of one length.
BATCH_TOKENS = 1 << 16
#: The id that ends a document in packed sequences, and the one that ends it in flat token files.
PACK_END, FILE_END = 1, 49407
BLOCK_TOKENS = 1 << 16
#: Blocks whose summaries one task scans; a file of any length is scanned group by group.
GROUP_BLOCKS = 1 << 10


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _text_frame(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encode_documents(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, decoded string``: every text's ids without special tokens added, and the ids decoded
    again (token strings joined by spaces, as a tokenizer file without a decoder does). An empty text has no ids."""
    path = tokenizer or tokenizer_path()

    def make():
        code = coder(path)
        names = np.array(code.table.names, dtype=object)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, count = code.encode(batch.column(1).to_pylist())
            ends = np.cumsum(count)
            decoded = [" ".join(names[ids[a:b]]) for a, b in zip(ends - count, ends, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32)))
            return pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded)], ["doc_id", "ids", "decoded"])

        return step

    return mapped(_text_frame(df, id_col, text_col), make, "doc_id long, ids array<int>, decoded string")


def encoding_digests(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what ``encode_documents`` gives, without carrying it."""
    path = tokenizer or tokenizer_path()

    def make():
        code = coder(path, keep_text=True)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(n, sha256(ids).hexdigest(), sha256(text).hexdigest()) for n, ids, text in code.with_text(batch.column(1).to_pylist())]
            n, ids, text = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return mapped(_text_frame(df, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def binary_lengths(n: np.ndarray, most: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of ``n`` tokens: as many of the length ``most`` (a power of two) as fit, then the rest's binary
    digits from the largest down. Gives each piece's document, start and length; a piece is never longer than ``most``."""
    whole, rest = n // most, n % most
    bits = most.bit_length() - 1
    digit = (rest[:, None] >> np.arange(bits - 1, -1, -1)) & 1
    doc = np.concatenate([np.repeat(np.arange(len(n)), whole), np.nonzero(digit)[0]])
    length = np.concatenate([np.full(int(whole.sum()), most), 1 << (bits - 1 - np.nonzero(digit)[1])])
    order = np.argsort(doc, kind="stable")
    doc, length = doc[order], length[order]
    ends = np.cumsum(length)
    return doc, ends - length - (np.cumsum(n) - n)[doc], length


def pack_documents(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = SEQUENCE, end: int = PACK_END, with_ids: bool = True, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Power-of-two decomposition: a document's ids and its end id are cut into pieces whose lengths are powers of two,
    and every piece is a sequence of its own, so none crosses documents and none has padding. Sequences of one length are a
    bucket of the input's partition, dealt in order into batches of ``batch_tokens``: a ``batch_id`` has one length, and
    only the last batch of a bucket is short.

    ``doc_id, start, length, ids_crc32, doc_tokens, batch_id``, if asked for ``ids``, and ``sequence_id, offset``. An empty
    text is its end id alone. Both numbers are unique in the table and have gaps."""
    path = tokenizer or tokenizer_path()
    bits = most.bit_length()

    def make():
        from pyspark import TaskContext

        code, task = coder(path), TaskContext.get().partitionId() << 38
        filled = np.zeros(bits, np.int64)  # sequences so far of each bucket

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, count = code.encode(batch.column(1).to_pylist())
            ends = np.cumsum(count)
            flat = np.insert(ids, ends, end).astype("<u4")
            n = count + 1
            doc, start, length = binary_lengths(n, most)
            begin = (np.cumsum(n) - n)[doc] + start
            body = memoryview(flat.tobytes())
            crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            bucket = np.log2(length).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            count = np.bincount(bucket, minlength=bits)
            nth = np.empty(len(bucket), np.int64)
            nth[order] = np.arange(len(bucket)) - np.repeat(np.cumsum(count) - count - filled, count)
            filled[:] += count
            dealt = task + (bucket << 32) + nth * length // max(batch_tokens, most)
            out = [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(dealt)]
            if with_ids:  # pieces lie one after another in flat
                out.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(flat)), pa.int32()), pa.array(flat.astype(np.int32))))
            return pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "batch_id", *["ids"] * with_ids])

        return step

    pieces = mapped(_text_frame(df, id_col, text_col), make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, batch_id long" + ", ids array<int>" * with_ids)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def token_blocks(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = FILE_END, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """Flat token files of a corpus, one for each partition of the input, in blocks of equal size: ``shard, block, payload``
    (little-endian ids of ``width`` bytes, the end id after each document; documents run across blocks, and strings of
    special tokens in a text are ordinary text) and ``doc_ids``, those of the
    documents that end in the block, in order. The scan does not read ``doc_ids``."""
    path = tokenizer or tokenizer_path()

    def run(batches):
        from pyspark import TaskContext

        from textloom.llm.common import sliced

        code, shard, block = coder(path, special=False), TaskContext.get().partitionId(), 0
        if code.table.size > 1 << (8 * width):
            raise ValueError(f"a vocabulary of {code.table.size} does not fit ids of {width} bytes")
        kind = {2: "<u2", 4: "<u4"}[width]
        held, owners, at = np.zeros(0, kind), [], []  # owners' end ids lie at `at` in held

        def out(n: int) -> pa.RecordBatch:
            nonlocal held, owners, at, block
            k = int(np.searchsorted(at, n))
            made = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([held[:n].tobytes()]), pa.array([owners[:k]], pa.list_(pa.int64()))], ["shard", "block", "payload", "doc_ids"])
            held, owners, at, block = held[n:], owners[k:], [x - n for x in at[k:]], block + 1
            return made

        for batch in batches:
            for part in sliced(batch):
                ids, count = code.encode(part.column(1).to_pylist())
                ends = np.cumsum(count)
                at += (len(held) + ends + np.arange(len(ends))).tolist()
                owners += part.column(0).to_pylist()
                held = np.append(held, np.insert(ids, ends, end).astype(kind))
                while len(held) >= block_tokens:
                    yield out(block_tokens)
        if len(held):
            yield out(len(held))

    small_batches(df)
    return _text_frame(df, id_col, text_col).mapInArrow(run, "shard int, block long, payload binary, doc_ids array<long>")


def scan_separators(blocks: DataFrame, end: int = FILE_END, group_blocks: int = GROUP_BLOCKS, width: int = 2) -> DataFrame:
    """Documents of flat, unindexed token files: ``shard, block, nth, start, n_tokens``, one row for each end id, with the
    block that holds the end id, its number there, the document's start in the file and its tokens with the end id. Tokens
    after a file's last end id are a document too; it ends in no block's end id and has ``closed`` false.

    ``blocks`` is ``shard, block, payload``: a file's blocks in order, whole tokens of ``width`` bytes, of any sizes. Each
    block is searched once with numpy. Where the document that a block continues began comes from a prefix scan over block
    summaries in two levels (groups of blocks, then a file's groups), so no task ever holds more than one level of one file.
    An empty block has no rows; a null payload counts as empty."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ends = [np.flatnonzero(np.frombuffer(x or b"", kind) == end) for x in batch.column(2).to_pylist()]
            offsets = np.append(0, np.cumsum([len(x) for x in ends]))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x or b"") // width for x in batch.column(2).to_pylist()], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ends), pa.int64()))], ["shard", "block", "n", "ends"])

        return step

    found = settled(mapped(blocks.select("shard", F.col("block").cast("long").alias("block"), F.coalesce("payload", F.lit(b"")).alias("payload")), make, f"shard {dict(blocks.dtypes)['shard']}, block long, n long, ends array<long>"))
    summary = found.select("shard", "block", "n", F.try_element_at("ends", F.lit(-1)).alias("last"), F.floor(F.col("block") / group_blocks).alias("group"))
    # What precedes: tokens, and the position after the last end id in file coordinates, first by group and then inside it.
    in_group = W.partitionBy("shard", "group").orderBy("block")
    local = summary.withColumn("base", F.sum("n").over(in_group) - F.col("n")).withColumn("after", F.max(F.col("base") + F.col("last") + 1).over(in_group.rowsBetween(W.unboundedPreceding, -1)))
    groups = summary.groupBy("shard", "group").agg(F.sum("n").alias("group_n"))
    tails = local.groupBy("shard", "group").agg(F.max(F.col("base") + F.col("last") + 1).alias("group_after"))
    in_file = W.partitionBy("shard").orderBy("group")
    groups = groups.join(tails, ["shard", "group"]).withColumn("group_base", F.sum("group_n").over(in_file) - F.col("group_n"))
    groups = groups.withColumn("before", F.coalesce(F.max(F.col("group_base") + F.col("group_after")).over(in_file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    groups = groups.withColumn("is_last", F.lead("group").over(in_file).isNull())
    placed = local.join(groups, ["shard", "group"]).select("shard", "block", (F.col("group_base") + F.col("base")).alias("base"), F.coalesce(F.col("group_base") + F.col("after"), "before").alias("open"), ((F.col("is_last")) & (F.lead("block").over(in_group).isNull())).alias("is_end"), F.col("n").alias("size"))
    joined = found.join(placed, ["shard", "block"])
    starts = F.transform("ends", lambda x, i: F.struct((i + 1).alias("nth"), F.when(i == 0, F.col("open")).otherwise(F.col("base") + F.get("ends", i - 1) + 1).alias("start"), (F.col("base") + x + 1).alias("stop"), F.lit(True).alias("closed")))
    file_end = F.col("base") + F.col("size")
    open_at = F.coalesce(F.col("base") + F.try_element_at("ends", F.lit(-1)) + 1, "open")
    rest = F.when(F.col("is_end") & (open_at < file_end), F.array(F.struct((F.size("ends") + 1).alias("nth"), open_at.alias("start"), file_end.alias("stop"), F.lit(False).alias("closed")))).otherwise(F.array().cast("array<struct<nth:int,start:bigint,stop:bigint,closed:boolean>>"))
    return joined.select("shard", "block", F.explode(F.concat(starts, rest)).alias("d")).select("shard", "block", F.col("d.nth").cast("long").alias("nth"), F.col("d.start"), (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), F.col("d.closed").alias("closed"))


def token_counts(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, shard, start, n_tokens`` of a corpus by way of its flat token files: they are written, scanned for end ids,
    and the scan's rows are given the ids that the writer noted. An empty text is its end id alone."""
    files = settled(token_blocks(df, tokenizer, id_col, text_col))
    docs = scan_separators(files.select("shard", "block", "payload")).filter("closed")
    owners = files.select("shard", "block", F.posexplode("doc_ids").alias("p", "doc_id")).select("shard", "block", (F.col("p") + 1).cast("long").alias("nth"), "doc_id")
    return docs.join(owners, ["shard", "block", "nth"], "left").select("doc_id", "shard", "start", "n_tokens")
