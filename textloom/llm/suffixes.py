"""Exact removal of repeated byte strings (operator 10), by bucket-pointer refinement.

Suffixes fall into buckets by their first q bytes; a bucket identifier is a hash of those bytes, so it is the same in every
task. Identifiers of 2q bytes are made from the identifiers at an offset and q further on, up to the full length, each level
from the one below. Only sampled suffixes enter the first round: every string of LENGTH bytes owns the least identifier
of its q-grams, so two equal strings own the same one at the same place. Suffixes alone in their bucket leave. The rest
are refined by the identifier of all that their owner's strings span: where that is shared, all those strings repeat. What
is left is refined string by string.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bloom_of, mapped, may_hold, plain_bytes, settled, sliding_least, small_batches

LENGTH, GRAM = 200, 32
_LETTER = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_ODD = np.random.default_rng(12).integers(0, 1 << 63, (12, 2), np.uint64) * np.uint64(2) + np.uint64(1)


def refine(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Identifiers of the strings that begin with those of ``a`` and go on with those of ``b``."""
    x = a * _ODD[level, 0] + b * _ODD[level, 1]
    return x ^ (x >> np.uint64(29))


def identifiers(data: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """By length (powers of two up to ``most``) the bucket identifiers of all strings of that length."""
    out = {1: _LETTER[data]}
    q, level = 1, 0
    while q < most and len(out[q]) > q:
        out[2 * q] = refine(out[q][:-q], out[q][q:], level)
        q, level = 2 * q, level + 1
    while q < most:
        q *= 2
        out[q] = np.zeros(0, np.uint64)
    return out


def owners(gram: np.ndarray, length: int) -> np.ndarray:
    """For each string of ``length`` bytes the position of the least q-gram in it, the first of equals."""
    key = (gram >> np.uint64(32) << np.uint64(32)) | np.arange(len(gram), dtype=np.uint64)
    return (sliding_least(key, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)


#: Buckets of at most so many kinds are told apart in one task each; larger ones in shuffles.
BUCKET_KINDS = 1024
#: Neighbouring strings of a suffix that large buckets tell together before they are told one by one.
CELL = 16


def _anchors(docs: DataFrame, length: int, columns: str, bloom: np.ndarray | None = None, by: str = "b") -> DataFrame:
    """Sampled suffixes with some of the columns ``id, th, s, e, b, c, off, text, n``. The strings that start at ``s`` to ``e``
    of a document own one q-gram, ``off`` after ``s``, of bucket ``b``; ``c`` identifies all bytes that they span, ``text``.
    With ``bloom``, only suffixes whose ``by`` it may hold. Where ``n`` or ``text`` is asked for, a batch's suffixes of one
    kind (``b, c``) are one row, the first, and ``n`` counts them; otherwise neighbours of one kind (in a run of one byte,
    say) are one range."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom) if bloom is not None else None
    wanted = columns.split()
    types = {"id": "long", "th": "int", "s": "int", "e": "int", "b": "long", "c": "long", "off": "int", "text": "binary", "n": "long"}

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            bodies = batch.column(1).to_pylist()
            flat = b"".join(bodies)
            size = np.fromiter(map(len, bodies), np.int64, len(bodies))
            begin = np.cumsum(size) - size
            gram = identifiers(np.frombuffer(flat, np.uint8), GRAM)[GRAM]
            own = owners(gram, length)
            count = np.maximum(size - length + 1, 0)
            if not count.sum():
                return None
            doc = np.repeat(np.arange(len(bodies)), count)
            start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + begin[doc]
            p = own[start]
            first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            s, e, p, doc = start[first], start[np.append(first[1:], len(p)) - 1], p[first], doc[first]
            if shared is not None and by == "b":
                s, e, p, doc = (x[keep] for keep in [may_hold(shared.value, gram[p])] for x in (s, e, p, doc))
            view, hashed = memoryview(flat), xxhash.xxh3_64_intdigest
            c = np.fromiter((hashed(view[x:y]) for x, y in zip(s.tolist(), (e + length).tolist(), strict=True)), np.uint64, len(s))
            if shared is not None and by == "c":
                s, e, p, doc, c = (x[keep] for keep in [may_hold(shared.value, c)] for x in (s, e, p, doc, c))
            kind, total = refine(gram[p], c, 8), np.ones(len(s), np.int64)
            if "n" in wanted or "text" in wanted:
                _, some, total = np.unique(kind, return_index=True, return_counts=True)
                s, e, p, doc, c = (x[some] for x in (s, e, p, doc, c))
            else:
                fresh = np.append(True, (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1]) | (s[1:] != e[:-1] + 1))[: len(s)]
                some = np.flatnonzero(fresh)
                e = e[np.append(some[1:], len(s))[: len(some)] - 1]
                s, p, doc, c = (x[some] for x in (s, p, doc, c))
            at = pa.array(doc)
            make_column = {
                "n": lambda: pa.array(total),
                "id": lambda: batch.column(0).take(at),
                "th": lambda: batch.column(2).take(at),
                "s": lambda: pa.array((s - begin[doc]).astype(np.int32)),
                "e": lambda: pa.array((e - begin[doc]).astype(np.int32)),
                "b": lambda: pa.array(gram[p].view(np.int64)),
                "c": lambda: pa.array(c.view(np.int64)),
                "off": lambda: pa.array((p - s).astype(np.int32)),
                "text": lambda: pa.array([flat[x:y] for x, y in zip(s.tolist(), (e + length).tolist(), strict=True)], pa.binary()),
            }
            return pa.RecordBatch.from_arrays([make_column[x]() for x in wanted], wanted)

        return step

    return mapped(docs.select("id", "text", "th"), make, ", ".join(f"{x} {types[x]}" for x in wanted))


def _strings(bodies: list[bytes], offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """All strings of ``length`` bytes in the spans of some suffixes: the suffix's number, the string's number in it, the
    place of the owned q-gram in the string, and the identifier of its bytes; then the identifiers of all powers of two."""
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    level = identifiers(np.frombuffer(b"".join(bodies), np.uint8), 1 << (length.bit_length() - 1))
    count = size - length + 1
    whose = np.repeat(np.arange(len(bodies)), count)
    nth = np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count)
    at = nth + (np.cumsum(size) - size)[whose]
    return whose, nth, offs[whose] - nth, _identifier(level, at, length), level


def _identifier(level: dict[int, np.ndarray], at: np.ndarray, length: int) -> np.ndarray:
    """Identifiers of the strings of any length at ``at``, from the powers of two that make up the length."""
    out = np.zeros(len(at), np.uint64)
    for q in sorted(level, reverse=True):
        if length >= q:
            out = refine(out, level[q][at], 11)
            length, at = length - q, at + q
    return out


def _marks(batch: pa.RecordBatch, whose: np.ndarray, nth: np.ndarray) -> pa.RecordBatch:
    """``id, th, s, e`` of marked strings, in ranges."""
    fresh = np.append(True, (whose[1:] != whose[:-1]) | (nth[1:] != nth[:-1] + 1))[: len(whose)]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(whose))[: len(first)] - 1
    at = pa.array(whose[first])
    s = batch.column("s").to_numpy()[whose[first]]
    return pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("th").take(at), pa.array((s + nth[first]).astype(np.int32)), pa.array((s + nth[last]).astype(np.int32))], ["id", "th", "s", "e"])


def _told_in_buckets(kinds: DataFrame, length: int) -> DataFrame:
    """``id, th, s, e``: ranges of strings that two kinds of one bucket share (``b, off, text, id, th, s``, buckets of at most
    BUCKET_KINDS). Rows come sorted by bucket, so a task holds whole buckets in turn."""

    def run(batches):
        held: pa.RecordBatch | None = None

        def told(rows: pa.RecordBatch) -> pa.RecordBatch:
            whose, nth, place, w, _ = _strings(rows.column("text").to_pylist(), rows.column("off").to_numpy().astype(np.int64), length)
            key = refine(refine(rows.column("b").to_numpy().view(np.uint64)[whose], place.astype(np.uint64), 10), w, 9)
            order = np.argsort(key)
            key = key[order]
            same = key[1:] == key[:-1]
            again = np.sort(order[np.append(same, False) | np.append(False, same)]) if len(key) else order
            return _marks(rows, whose[again], nth[again])

        for batch in batches:
            rows = pa.concat_batches([held, batch]) if held is not None else batch
            b = rows.column("b").to_numpy()
            whole = int(np.searchsorted(b, b[-1])) if rows.num_rows else 0  # all but the last bucket
            if whole and (out := told(rows.slice(0, whole))).num_rows:
                yield out
            held = rows.slice(whole)
        if held is not None and held.num_rows and (out := told(held)).num_rows:
            yield out

    small_batches(kinds)
    ordered = kinds.repartition("b").sortWithinPartitions("b").select("b", "off", "text", "id", "th", "s")
    return ordered.mapInArrow(run, "id long, th int, s int, e int")


def _told_by_cells(kinds: DataFrame, length: int) -> DataFrame:
    """The same for large buckets, in shuffles: up to CELL neighbouring strings of a suffix, at the same places around the
    owned q-gram, are a cell. Only cells that share their core, the bytes that all strings of such a cell have in common, can
    share a string. A cell whose strings are all shared is marked whole; of the other kinds of cells with one core, one
    each is told string by string."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            bodies, offs = batch.column("text").to_pylist(), batch.column("off").to_numpy().astype(np.int64)
            whose, nth, place, w, level = _strings(bodies, offs, length)
            size = np.fromiter(map(len, bodies), np.int64, len(bodies))
            k = place // CELL
            first = np.flatnonzero(np.append(True, (whose[1:] != whose[:-1]) | (k[1:] != k[:-1])))
            last = np.append(first[1:], len(whose))
            who, cell = whose[first], k[first]
            core = _identifier(level, (np.cumsum(size) - size + offs)[who] - CELL * cell, length - CELL + 1)
            view, hashed = memoryview(w.astype("<u8").tobytes()), xxhash.xxh3_64_intdigest
            kind = np.fromiter((hashed(view[8 * x : 8 * y], seed=int(p)) for x, y, p in zip(first.tolist(), last.tolist(), place[first], strict=True)), np.uint64, len(first))
            at = pa.array(who)
            lo = batch.column("s").to_numpy()[who] + nth[first]
            strings = pa.ListArray.from_arrays(pa.array(np.append(first, len(w)), pa.int32()), pa.array(w.view(np.int64)))
            values = [batch.column("b").take(at), pa.array(cell.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(kind.view(np.int64)), batch.column("id").take(at), batch.column("th").take(at), pa.array(lo.astype(np.int32)), pa.array((lo + last - first - 1).astype(np.int32)), pa.array(place[first].astype(np.int32)), strings]
            return pa.RecordBatch.from_arrays(values, ["b", "cell", "core", "kind", "id", "th", "s", "e", "place", "ws"])

        return step

    cells = settled(mapped(kinds.select("b", "text", "off", "id", "th", "s"), make, "b long, cell int, core long, kind long, id long, th int, s int, e int, place int, ws array<long>"))
    one = settled(cells.groupBy("b", "cell", "core", "kind").agg(F.count("*").alias("n"), *(F.first(x).alias(x) for x in ("id", "th", "s", "place", "ws"))))
    whole = cells.join(one.filter("n > 1").select("b", "cell", "core", "kind"), ["b", "cell", "core", "kind"]).select("id", "th", "s", "e")
    several = settled(one.groupBy("b", "cell", "core").agg(F.count("*").alias("kinds")).filter("kinds > 1").drop("kinds"))
    strings = one.join(several, ["b", "cell", "core"]).select("b", "id", "th", "s", "place", F.posexplode("ws").alias("i", "w"))
    strings = settled(strings.select("b", "w", (F.col("place") - F.col("i")).alias("place"), "id", "th", (F.col("s") + F.col("i")).alias("s")))
    twice = settled(strings.groupBy("b", "place", "w").agg(F.count("*").alias("m")).filter("m > 1").drop("m"))
    return whole.unionByName(strings.join(twice, ["b", "place", "w"]).select("id", "th", "s", F.col("s").alias("e")))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``id, th, spans array<struct<s, e>>`` of each document (``id, text binary, th``) that has a string of ``length``
    bytes which also starts elsewhere: the starts of such strings, as ranges."""
    kinds = settled(_anchors(docs, length, "b c n").groupBy("b", "c").agg(F.sum("n").alias("n")))
    # Suffixes with all their span shared: all their strings repeat.
    full = settled(kinds.filter("n > 1").select("b", "c"))
    whole = _anchors(docs, length, "id th s e b c", bloom_of(full, "c"), "c").join(full, ["b", "c"]).select("id", "th", "s", "e")
    # Buckets of several kinds: one suffix stands for each kind.
    buckets = settled(kinds.groupBy("b").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    first = [F.first(x).alias(x) for x in ("id", "th", "s", "off", "text")]
    spans = settled(_anchors(docs, length, "id th s b c off text", bloom_of(buckets, "b"), "b").groupBy("b", "c").agg(*first).join(buckets, "b"))
    small = _told_in_buckets(spans.filter(F.col("kinds") <= BUCKET_KINDS), length)
    marks = whole.unionByName(small)
    if not buckets.filter(F.col("kinds") > BUCKET_KINDS).isEmpty():
        marks = marks.unionByName(_told_by_cells(spans.filter(F.col("kinds") > BUCKET_KINDS), length))
    return marks.distinct().groupBy("id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _covered(n: int, spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under the strings that start in the given ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["s"], x["e"] + length) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed`` (``start:end`` of each removed run, joined by commas) of
    every row. A byte goes if a string of ``length`` bytes over it also starts anywhere else in the table, the same document
    included. Null text is empty; texts shorter than ``length`` lose nothing; rows that repeat, ids included, are each
    other's copies. Other columns of ``df`` are not read."""
    text = plain_bytes(F.col(text_col).cast("string"))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "text", F.hash("text").alias("th"))
    found = repeated_spans(docs.select("id", "text", "th"), length)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for body, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs = _covered(len(body), spans, length)
                ends = [0, *(b for _, b in runs)]
                kept = b"".join(body[x:y] for x, y in zip(ends, [*(a for a, _ in runs), len(body)], strict=True))
                rows.append((len(body), len(body) - len(kept), len(runs), sha256(kept).hexdigest(), ",".join(f"{a}:{b}" for a, b in runs)))
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()] * 2, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

        return step

    joined = docs.join(found, ["id", "th"], "left").select("doc_id", "text", "spans")
    return mapped(joined, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed string")
