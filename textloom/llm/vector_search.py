"""Nearest vectors by a forest of hash prefixes (operator 11).

A tree gives each vector a long string of bits, the sides of random hyperplanes on which it lies, and keeps the strings
sorted. A query descends to the longest prefix that strings share with its own and ascends in all trees at once, a bit at a
time, until the prefixes have enough candidates and, by how near the nearest of them are, would have shown a nearer vector with
the probability asked for. So close neighbours end the ascent deep down, where few vectors are, and without any the query sees
most of the table. Vectors lie in blocks, each with a forest of its own, wherever Spark has put them: they do not move to the
queries, which are sent to all tasks, a bounded number at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.common import settled, small_batches
from textloom.llm.vector_codes import usable

NEAREST, EVERY = 20, 20
#: Trees, bits of a string, and the share of neighbours that the ascent may leave unseen.
TREES, BITS, UNSEEN = 16, 32, 0.05
#: Components of the vectors of a block, and of the queries that one job broadcasts (32 MB as doubles).
BLOCK_COMPONENTS, QUERY_COMPONENTS = 1 << 20, 1 << 22
#: Queries that look at a block together, and pairs that are measured together.
SLICE, PAIRS = 256, 1 << 16
#: A query that would see so large a share of a block sees all of it.
DENSE = 0.25
#: Scores this near to the last place (by the product of the norms) are measured again before places are dealt.
ROUNDING = 1e-9


def planes(length: int, trees: int, bits: int) -> np.ndarray:
    """The hyperplanes of all trees for vectors of ``length``, one dimension more included."""
    return np.random.default_rng([17, length]).standard_normal((length + 1, trees * bits))


def strings(sides: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """Bit strings as numbers that sort like them: (tree, row)."""
    value = np.zeros((len(sides), trees), np.uint64)
    for i in range(bits):
        value = (value << np.uint64(1)) | sides.reshape(len(sides), trees, bits)[:, :, i].astype(np.uint64)
    return np.ascontiguousarray(value.T)


class Forest:
    """The trees over a block of vectors of one length. The largest inner product is the smallest angle once every vector has one
    component more that brings it to the length of the longest, and queries have zero there."""

    def __init__(self, vectors: np.ndarray, trees: int, bits: int) -> None:
        self.vectors, self.bits = vectors, bits
        squares = (vectors * vectors).sum(1)
        self.longest = float(np.sqrt(squares.max()))
        self.planes = planes(vectors.shape[1], trees, bits)
        rest = np.sqrt(np.maximum(self.longest**2 - squares, 0))
        own = strings((vectors @ self.planes[:-1] + rest[:, None] * self.planes[-1]) > 0, trees, bits)
        self.order = np.argsort(own, axis=1, kind="stable")
        self.sorted = np.take_along_axis(own, self.order, 1)

    def ranges(self, prefix: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where, in each tree, the strings lie that share the first ``level`` bits of a query's string: (tree, query)."""
        tail = (np.uint64(1) << (self.bits - level).astype(np.uint64)) - np.uint64(1)
        low = [np.searchsorted(tree, own & ~tail) for tree, own in zip(self.sorted, prefix, strict=True)]
        high = [np.searchsorted(tree, own | tail, "right") for tree, own in zip(self.sorted, prefix, strict=True)]
        return np.array(low), np.array(high)

    def ascended(self, prefix: np.ndarray, enough: int) -> np.ndarray:
        """The longest prefix at which each query's trees together show ``enough`` vectors; 0 if there are not so many."""
        low, high = np.zeros(prefix.shape[1], np.int64), np.full(prefix.shape[1], self.bits)
        while (low < high).any():
            mid = (low + high + 1) // 2
            a, b = self.ranges(prefix, mid)
            met = (b - a).sum(0) >= enough
            low, high = np.where(met, mid, low), np.where(met, high, mid - 1)
        return low

    def seen(self, prefix: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of query and row that share a prefix of ``level`` bits in some tree, each once, by query."""
        low, high = self.ranges(prefix, level)
        size = (high - low).ravel()
        at = np.repeat(low.ravel() - np.cumsum(size) + size, size) + np.arange(size.sum())
        tree, query = (np.repeat(x.ravel(), size) for x in np.indices(low.shape))
        pair = np.unique(query * len(self.vectors) + self.order[tree, at])
        return pair // len(self.vectors), pair % len(self.vectors)

    def scores(self, queries: np.ndarray, query: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Inner products of pairs, each summed in the same way wherever it is computed."""
        parts = [(queries[query[a : a + PAIRS]] * self.vectors[row[a : a + PAIRS]]).sum(1) for a in range(0, len(query), PAIRS)]
        return np.concatenate([*parts, np.zeros(0)])

    def sure_level(self, reached: np.ndarray, norms: np.ndarray, unseen: float) -> np.ndarray:
        """The longest prefix that a vector with a score of ``reached`` or more shares with the query in some tree, but for a
        probability of ``unseen``."""
        cosine = np.clip(reached / (self.longest * norms), -1, 1)
        alike = np.clip(1 - np.arccos(cosine) / np.pi, 1e-9, 1 - 1e-9)
        return np.clip(np.floor(np.log(1 - unseen ** (1 / len(self.sorted))) / np.log(alike)), 0, self.bits).astype(np.int64)


class Best:
    """The best ``k`` pairs of score and id of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def add(self, first: int, count: int, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """More pairs of ``count`` queries from ``first`` on; ``query`` counts from there."""
        own = slice(first, first + count)
        query = np.concatenate([np.repeat(np.arange(count), self.k), query])
        score = np.concatenate([self.score[own].ravel(), score])
        ids = np.concatenate([self.id[own].ravel(), ids])
        order = np.lexsort((ids, -score, query))
        starts = np.searchsorted(query[order], np.arange(count))
        top = order[starts[:, None] + np.arange(self.k)]
        self.score[own], self.id[own] = score[top], ids[top]


def _places(query: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th best score of each of ``n`` queries; -inf where there are fewer."""
    order = np.lexsort((-score, query))
    count = np.bincount(query, minlength=n)
    at = np.cumsum(count) - count + k - 1
    return np.where(count >= k, score[order][np.minimum(at, max(len(order) - 1, 0))] if len(order) else -np.inf, -np.inf)


def look(forest: Forest, ids: list[np.ndarray], queries: np.ndarray, best: Best, first: int, unseen: float = UNSEEN) -> None:
    """Puts what a block has near ``queries`` into ``best``; ``ids`` are those of each row of the block (of equal vectors)."""
    m, n, k = len(queries), len(forest.vectors), best.k
    norms = np.sqrt((queries * queries).sum(1))
    prefix = strings(queries @ forest.planes[:-1] > 0, len(forest.sorted), forest.bits)
    level = forest.ascended(prefix, 2 * k)
    query, row = forest.seen(prefix, level)
    score = forest.scores(queries, query, row)
    reached = np.maximum(_places(query, score, m, k), best.score[first : first + m, -1])
    sure = forest.sure_level(reached, norms, unseen)
    low, high = forest.ranges(prefix, np.minimum(level, sure))
    dense = (high - low).sum(0) >= DENSE * n
    further = np.flatnonzero((sure < level) & ~dense)
    if len(further):
        keep = ~np.isin(query, further)
        more = forest.seen(prefix[:, further], sure[further])
        query, row = np.append(query[keep], further[more[0]]), np.append(row[keep], more[1])
        score = np.append(score[keep], forest.scores(queries, further[more[0]], more[1]))
    if dense.any():
        whole = np.flatnonzero(dense)
        keep = ~dense[query]
        product = queries[whole] @ forest.vectors.T
        last = np.partition(product, max(n - k, 0), axis=1)[:, max(n - k, 0)]
        at, near = np.nonzero(product >= (last - ROUNDING * forest.longest * norms[whole])[:, None])
        query, row = np.append(query[keep], whole[at]), np.append(row[keep], near)
        score = np.append(score[keep], forest.scores(queries, whole[at], near))
    told = score >= np.maximum(_places(query, score, m, k), best.score[first : first + m, -1])[query]
    query, row, score = query[told], row[told], score[told]
    sizes = np.fromiter((len(ids[i]) for i in row.tolist()), np.int64, len(row))
    named = np.concatenate([*(ids[i] for i in row.tolist()), np.zeros(0, np.int64)])
    best.add(first, m, np.repeat(query, sizes), np.repeat(score, sizes), named)


def _search(groups: DataFrame, asked: DataFrame, k: int, trees: int, bits: int, unseen: float) -> DataFrame:
    """``q, query_id, n_rows, score, vec_id, own``: candidates of the queries in ``asked`` (``vec_id, vector, n_rows``), the best of
    each task."""
    table = asked.toArrow()  # QUERY_COMPONENTS in all, about
    vectors = [np.asarray(x, float) for x in table["vector"].to_numpy()]
    lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    of_length = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}
    value = {n: np.stack([vectors[i] for i in at.tolist()]) for n, at in of_length.items()}
    shared = groups.sparkSession.sparkContext.broadcast((table["vec_id"].to_numpy(), table["n_rows"].to_numpy(), of_length, value))
    names = ["q", "query_id", "n_rows", "score", "vec_id", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, n_rows, of_length, value = shared.value
        best = {n: Best(len(x), k + 1) for n, x in value.items()}
        held: dict[int, tuple[list, list]] = {n: ([], []) for n in value}

        def settle(n: int) -> None:
            rows, ids = held[n]
            if rows:
                forest = Forest(np.stack(rows).astype(float), trees, bits)
                for a in range(0, len(value[n]), SLICE):
                    look(forest, ids, value[n][a : a + SLICE], best[n], a, unseen)
            rows.clear()
            ids.clear()

        for batch in batches:
            for vector, ids in zip(*(x.to_numpy(zero_copy_only=False) for x in batch.columns), strict=True):
                if len(vector) in held:
                    held[len(vector)][0].append(vector)
                    held[len(vector)][1].append(ids)
                    if len(held[len(vector)][0]) * len(vector) >= BLOCK_COMPONENTS:
                        settle(len(vector))
        for n, at in of_length.items():
            settle(n)
            own = (value[n] * value[n]).sum(1)
            for a in range(0, len(at), SLICE):
                score, ids = best[n].score[a : a + SLICE], best[n].id[a : a + SLICE]
                q, place = np.nonzero(score > -np.inf)
                mine = at[a + q]
                score, ids = score[q, place], ids[q, place]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (mine, query_ids[mine], n_rows[mine], score, ids, (ids == query_ids[mine]) & (score == own[a + q]))], names)

    small_batches(groups)
    return groups.select("vector", "ids").mapInArrow(run, "q long, query_id long, n_rows long, score double, vec_id long, own boolean")


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, every: int = EVERY, trees: int = TREES, bits: int = BITS, unseen: float = UNSEEN) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` the ``k`` other rows of largest inner product
    that the forest finds, nearest first, ties to the smaller id; all others, if there are fewer. Scores are of the vectors
    themselves, in double precision.

    Rows whose vector is null, empty, zero, or holds a null or non-finite component take no part, and neither do rows with null
    ids. Vectors of another length than the query's are no candidates. A row that repeats is a candidate and a query as often
    as it comes; of rows with one id, each has the others as candidates. Only the two named columns are read. Equal vectors are
    one from here on, with the least ``k + 1`` ids, as no other can be among the nearest; they are cut to these before any shuffle."""
    element = dict(df.select(F.col(vector_col)).dtypes)[vector_col]
    kept = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if element == "array<float>" else "array<double>").alias("vector"))
    kept = kept.filter(F.col("vec_id").isNotNull() & usable("vector") & F.exists("vector", lambda x: x != 0))
    place = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    groups = settled(kept.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    queries = settled(kept.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "vector").agg(F.count("*").alias("n_rows")))
    total = queries.agg(F.sum(F.size("vector"))).first()[0] or 0
    jobs = max(1, -(-total // QUERY_COMPONENTS))
    found = []
    for i in range(jobs):
        asked = queries if jobs == 1 else queries.filter(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(jobs)) == i)
        seen = _search(groups, asked, k, trees, bits, unseen)
        place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        top = seen.withColumn("place", place).filter(F.col("place") <= k + 1)
        listed = top.groupBy("q", "query_id", "n_rows").agg(F.array_sort(F.collect_list(F.struct("place", "score", "vec_id", "own"))).alias("near"))
        own = F.array_position(F.transform("near", lambda x: x["own"]), True)
        others = F.slice(F.filter("near", lambda x, at: at + 1 != own), 1, k)
        rows = listed.select("query_id", F.explode(F.array_repeat(others, F.col("n_rows").cast("int"))).alias("near"))
        rows = rows.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
        found.append(rows if jobs == 1 else settled(rows))
    return reduce(DataFrame.unionByName, found)
