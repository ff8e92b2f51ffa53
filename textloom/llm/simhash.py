"""SimHash near-duplicates by multi-index hashing (operator 1)."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bloom_of, mapped, may_hold, plain_bytes, settled, small_batches, unused
from textloom.llm.components import components
from textloom.llm.passages import named_only, shingles_of, words_of

SHINGLE = 3
SEED = 42
#: Differing bits up to which fingerprints link; with two segments, one of them differs in at most one bit.
MOST_BITS, SEGMENTS, SEGMENT_BITS = 3, 2, 32


def fingerprint_batch(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The fingerprints of UTF-8 texts: a bit is set if it is in over half the hashes of the word shingles."""
    digest = xxhash.xxh64_intdigest
    hashes: list[list[int]] = []
    for text in texts:
        words = text.lower().split()  # of bytes: A to Z alone, and the six ASCII white spaces
        if len(words) < size:
            hashes.append([digest(b" ".join(words), SEED)] if words else [])
        else:
            hashes.append([digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(size)), strict=False)])
    count = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(hashes), np.uint64)
    flat = np.fromiter(chain.from_iterable(hashes), np.uint64, int(count.sum()))
    some = np.flatnonzero(count)
    if len(some):
        starts = (np.cumsum(count) - count)[some]
        set_bits = np.add.reduceat(np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), starts, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * set_bits > count[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long). Null text is empty; a text without words has fingerprint zero."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprint_batch(batch.column(1).to_pylist()).view(np.int64))], ["doc_id", "fp"])

        return step

    return mapped(df.select(F.col(id_col).cast("long").alias("doc_id"), plain_bytes(F.col(text_col).cast("string")).alias("text")), make, "doc_id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS * i).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def links(distinct_fps: DataFrame) -> DataFrame:
    """All pairs ``a, b`` of different fingerprints at most MOST_BITS apart, each once, from a column ``fp`` of distinct
    values. The table holds each fingerprint's two segments; probes enumerate the ball of radius one around a segment, and
    of a pair that differs in a bit, only the side that has it clear sets it. A candidate from the second segment counts
    only if the first could not find it, so no pair is given twice. Both sides are dealt by segment value, of
    which there are 2**32: of n different fingerprints a bucket holds n / 2**32 on average, however many documents share
    them. Only texts made for it could fill one bucket with fingerprints that differ elsewhere; Spark splits such a join
    like any skewed one, but its work grows with the square of that bucket."""
    fp = F.col("fp")
    flips = lambda key: F.filter(F.transform(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)), lambda bit: key.bitwiseAND(bit) == 0)
    segments = F.explode(F.array(*(F.struct(F.lit(i).alias("seg"), _segment(fp, i).alias("key")) for i in range(SEGMENTS)))).alias("s")
    table = distinct_fps.select(fp.alias("b"), segments).select("b", "s.seg", "s.key")
    probes = distinct_fps.select(fp.alias("a"), segments).select("a", "s.seg", F.col("s.key").alias("own"))
    probes = probes.select("a", "seg", "own", F.explode(F.concat(F.array("own"), F.transform(flips(F.col("own")), lambda bit: F.col("own").bitwiseOR(bit)))).alias("key"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    found = probes.join(table, ["seg", "key"]).filter(
        (F.bit_count(apart) <= MOST_BITS)
        & ((F.col("own") != F.col("key")) | (F.col("a") < F.col("b")))
        & ((F.col("seg") == 0) | (F.bit_count(_segment(apart, 0)) > 1))
    )
    return found.select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row for each row of ``df``. ``fingerprint`` is 16 hex digits;
    ``component_id`` is the least id of all documents reachable over links of at most MOST_BITS differing bits, copies
    included. Null ids do not count for it; a component of null ids alone has null. Only the two named columns are read."""
    docs = settled(fingerprints(df, id_col, text_col))
    distinct = settled(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(links(distinct))
    owned = distinct.join(label, distinct.fp == label.a, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    owned = settled(owned)
    least = owned.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = owned.join(least, "component").select("fp", "component_id")
    return docs.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near copies by similarity ------------------------------------------------------------------------------------------

#: Near copies share this much of their five-word shingles (Jaccard's measure). Their fingerprints are taken of word pairs,
#: which an edit touches less, and are wide: WIDE segments of 32 bits, each probed with a ball of radius one.
SIMILAR, COPY_SHINGLE, PAIR, WIDE = 0.8, 5, 2, 12
_MIX = np.random.default_rng(31).integers(0, 1 << 63, (WIDE // 2, 2), np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprints(bodies: list[bytes]) -> np.ndarray:
    """A row of WIDE unsigned 32-bit segments for each text. Texts of fewer than two words have zeros."""
    flat = np.frombuffer(b"\n".join(bodies).lower(), np.uint8)
    at, size = words_of(flat)
    length = np.fromiter(map(len, bodies), np.int64, len(bodies))
    bounds = np.searchsorted(at, np.append(0, np.cumsum(length + 1)))
    shingle = shingles_of(flat, at, size, PAIR)
    count = np.maximum(np.diff(bounds) - PAIR + 1, 0)
    some = np.flatnonzero(count)
    out = np.zeros((len(bodies), WIDE), np.uint32)
    for k, i in enumerate(some.tolist()):
        own = np.unique(shingle[bounds[i] : bounds[i] + count[i]])
        mixed = own[:, None] * _MIX[None, :, 0]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[None, :, 1]
        mixed ^= mixed >> np.uint64(29)
        set_bits = np.zeros(32 * WIDE, np.int64)
        for a in range(0, len(own), 4096):  # bits of so many shingles at a time
            set_bits += np.unpackbits(np.ascontiguousarray(mixed[a : a + 4096]).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * set_bits > len(own), bitorder="little").view(np.uint32)
    return out


#: Shingle sets that a task keeps while it compares pairs.
KNOWN_SETS = 1024


def shingle_sets(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number and identifier of each text's set of COPY_SHINGLE words in a row (of fewer words: the sequence)."""
    count, told = np.zeros(len(bodies), np.int64), np.zeros(len(bodies), np.uint64)
    for i, body in enumerate(bodies):
        flat = np.frombuffer(body.lower(), np.uint8)
        at, size = words_of(flat)
        own = np.unique(shingles_of(flat, at, size, max(1, min(COPY_SHINGLE, len(at)))))
        count[i], told[i] = len(own), xxhash.xxh64_intdigest(own.tobytes(), SEED)
    return count, told


def _hits(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, node`` of each segment of ``texts`` (``id, node, segments array<long>``), and ``key, node, owner`` for each such key that
    a text has or comes to by setting a clear bit; ``owner`` is the node of the text of least id that has it."""
    owned = F.transform("segments", lambda x, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(x))
    clear = lambda key: F.filter(F.transform(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)), lambda i: key.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))), lambda other: other != key)
    owners = texts.select("id", "node", F.explode(owned).alias("key"))
    least = owners.groupBy("key").agg(F.min(F.struct("id", "node")).alias("low")).select("key", F.col("low.node").alias("owner"))
    probes = texts.select("node", F.explode(owned).alias("of")).select("node", F.explode(F.concat(F.array("of"), clear(F.col("of")))).alias("key"))
    return owners.select("key", "node"), settled(probes.join(least, "key").select("key", "node", "owner"))


def _other_links(texts: DataFrame, owners: DataFrame, hits: DataFrame, label: DataFrame, similar: float) -> DataFrame:
    """``a, b``: all pairs of texts with near segments (``_hits``) that ``label`` (``a, component``) does not connect and whose numbers of
    shingles ``n`` let them be ``similar``. Of a segment's texts those of its commonest component are paired with the others
    alone, so a group that is connected costs no pairs."""
    told = texts.select("node", "n").join(label.select(F.col("a").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    probes = hits.select("key", "node").join(told, "node")  # owners are among them
    mixed = probes.groupBy("key", "component").agg(F.count("*").alias("rows")).groupBy("key").agg(F.max_by("component", "rows").alias("common"), F.count("*").alias("components"))
    mixed = mixed.filter("components > 1").select("key", "common")
    owners = owners.join(mixed, "key").join(told, "node").select("key", F.col("node").alias("owner"), F.col("component").alias("owned"), F.col("n").alias("size"), "common")
    probes = probes.join(mixed, "key")
    alike = (F.col("component") != F.col("owned")) & (F.least("n", "size") >= F.lit(similar) * F.greatest("n", "size"))
    fewer = probes.filter("component <> common").drop("common").join(owners.drop("common"), "key")
    more = probes.filter("component = common").drop("common").join(owners.filter("owned <> common").drop("common"), "key")
    return fewer.unionByName(more).filter(alike).select(F.greatest("node", "owner").alias("a"), F.least("node", "owner").alias("b")).distinct()


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``th, th2, n_bytes, kept_id, is_kept`` of each text that has copies or near copies: its hashes and size, the least id of its
    group, and whether it is the text that stays (that of least id; of several under that id, of least hashes). Texts are linked
    where fingerprints are near and the sets of their five-word shingles (words in lower case; of fewer words, the sequence)
    are ``similar`` or more; groups are connected by links. Different texts are told apart also where rows share an id. Null ids
    are left out; null text is empty, and texts without words are alike. Only the two named columns are read."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), plain_bytes(F.col(text_col).cast("string")).alias("text")).filter("id is not null")
    key = [F.xxhash64("text").alias("th"), F.hash("text").alias("th2"), F.octet_length("text").alias("n_bytes")]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            bodies = batch.column(1).to_pylist()
            segments = wide_fingerprints(bodies).astype(np.int64)
            count, told = shingle_sets(bodies)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(segments) + 1) * WIDE, pa.int32()), pa.array(segments.ravel()))
            return pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], lists, pa.array(count), pa.array(told.view(np.int64))], ["id", "th", "th2", "n_bytes", "segments", "n", "told"])

        return step

    own = mapped(docs.select("id", "text", *key), make, "id long, th long, th2 int, n_bytes int, segments array<long>, n long, told long")
    # Exact copies are one row, and a node of its own, from here on.
    texts = own.groupBy("th", "th2", "n_bytes").agg(F.min("id").alias("id"), F.max("id").alias("most"), F.first("segments").alias("segments"), F.first("n").alias("n"), F.first("told").alias("told"))
    texts = settled(texts.withColumn("node", F.monotonically_increasing_id()))
    # Texts of one set of shingles are linked to the least of them, which alone is looked up by its segments; sets so small that
    # no other set is similar are not.
    first = settled(texts.groupBy("n", "told").agg(F.min(F.struct("id", "node", "segments")).alias("low")).select("n", "told", "low.*"))
    same = texts.select("n", "told", "node").join(first.select("n", "told", F.col("node").alias("low")), ["n", "told"]).filter("node <> low")
    wide = first.filter(F.col("n") >= F.lit(similar) * (F.col("n") + 1))
    same = same.select(F.greatest("node", "low").alias("a"), F.least("node", "low").alias("b"))
    owners, hits = _hits(wide)
    # To the least owner first: a group of n near copies gives links in proportion to n.
    links = hits.filter("node <> owner").select(F.greatest("node", "owner").alias("a"), F.least("node", "owner").alias("b"))
    pairs = settled(links.unionByName(same).distinct())

    def verified(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        named = settled(texts.join(nodes, "node", "left_semi").select("id", "th", "node"))
        bodies = settled(named_only(docs, named).join(named, ["id", "th"]).dropDuplicates(["node"]))
        both = pairs.join(bodies.select(F.col("node").alias("a"), F.col("text").alias("own")), "a").join(bodies.select(F.col("node").alias("b"), F.col("text").alias("other")), "b")
        return settled(mapped(both.select("a", "b", "other", "own"), compare, "a long, b long"))

    def compare():
        expand, known = zstandard.ZstdDecompressor().decompress, {}

        def shingles(body: bytes) -> np.ndarray:
            if body not in known:
                if len(known) >= KNOWN_SETS:
                    known.clear()
                flat = np.frombuffer(expand(body).lower(), np.uint8)
                at, size = words_of(flat)
                known[body] = np.unique(shingles_of(flat, at, size, max(1, min(COPY_SHINGLE, len(at)))))
            return known[body]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for other, mine in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = shingles(mine), shingles(other)
                n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(n >= similar * (len(x) + len(y) - n))
            return pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep))

        return step

    near = verified(pairs)
    label = settled(components(near))
    rest = settled(_other_links(wide, owners, hits, label, similar).join(pairs, ["a", "b"], "left_anti"))
    label = components(near.unionByName(verified(rest)))
    # A text without links is its own group.
    grouped = settled(texts.drop("segments", "n", "told").join(label.select(F.col("a").alias("node"), "component"), "node", "left").withColumn("group", F.coalesce("component", "node")))
    kept = grouped.groupBy("group").agg(F.min(F.struct("id", "th", "th2", "node")).alias("kept"))
    told = grouped.join(kept, "group").withColumn("is_kept", F.col("node") == F.col("kept.node"))
    return told.filter(~F.col("is_kept") | (F.col("most") != F.col("id"))).select("th", "th2", "n_bytes", F.col("kept.id").alias("kept_id"), "is_kept")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``df`` without the rows of the texts that ``near_copies`` names, but for those that stand under its group's least id with the
    text that stays. Rows with null ids stay, and so do all columns, whatever their names. Texts are not shuffled: rows that a
    filter does not let through stay at once, the others are told by a join on hashes."""
    th, th2, size, kept_id, is_kept, h, h2, n, may = unused(df, "th", "th2", "size", "kept_id", "is_kept", "h", "h2", "n", "may")
    drop = settled(near_copies(df, id_col, text_col, similar).toDF(th, th2, size, kept_id, is_kept))
    shared = df.sparkSession.sparkContext.broadcast(bloom_of(drop, th))
    small_batches(df)

    @F.pandas_udf("boolean")
    def may_have(h: pd.Series) -> pd.Series:
        return pd.Series(may_hold(shared.value, h.to_numpy().view(np.uint64)))

    body = plain_bytes(F.col(text_col).cast("string"))
    told = df.withColumns({h: F.xxhash64(body), h2: F.hash(body), n: F.octet_length(body)}).withColumn(may, may_have(h))
    match = (F.col(h) == F.col(th)) & (F.col(h2) == F.col(th2)) & (F.col(n) == F.col(size))
    stays = F.col(kept_id).isNull() | F.col(id_col).isNull() | (F.col(is_kept) & (F.col(id_col).cast("long") == F.col(kept_id)))
    kept = told.filter(F.col(may)).join(drop, match, "left").filter(stays)
    return kept.select(*df.columns).unionByName(told.filter(~F.col(may)).select(*df.columns))
