"""Searches and codes of vectors (operators 11 and 12) against brute force."""

from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from textloom.llm import queries, vector_codes, vector_search

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def table(spark):
    return sorted((r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect())


def neighbours(rows, every, k):
    """Of each query, by its place in ``rows``: score and id of its nearest."""
    x = np.array([v for _, v, _ in rows], float)
    out = {}
    for i, (own, _, _) in enumerate(rows):
        if own % every == 0:
            score = (x * x[i]).sum(1)
            out[i] = sorted((-score[j], rows[j][0]) for j in range(len(rows)) if j != i)[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (-r.score, r.vec_id)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in out.values())
    return {q: [x[i] for i in sorted(x)] for q, x in out.items()}


def recall(got, want):
    return np.mean([len({i for _, i in got[q]} & {i for _, i in near}) / len(near) for q, near in want.items()])


def test_op11(spark, table):
    want = {table[i][0]: near for i, near in neighbours(table, 20, 20).items()}
    got = found(queries.QUERIES["op11_nearest"](spark, DATA))
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in got)
    assert recall(got, want) >= 0.95
    for q, near in got.items():
        assert near == sorted(near)
        if {i for _, i in near} == {i for _, i in want[q]}:
            assert np.allclose([s for s, _ in near], [s for s, _ in want[q]], atol=1e-12) and [i for _, i in near] == [i for _, i in want[q]]


def test_clusters_end_the_ascent_early(spark):
    """Neighbours that are near are found without a look at the whole block, in several blocks and by several jobs."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(150, 32)) * 3
    rows = [(i, [float(v) for v in (centres[i % 150] + rng.normal(size=32) * 0.3).astype(np.float32)], 0) for i in range(6000)]
    data = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = {rows[i][0]: near for i, near in neighbours(rows, 20, 10).items()}
    assert recall(found(vector_search.nearest(data, k=10)), want) >= 0.95
    looked = vector_search.Forest(np.array([v for _, v, _ in rows]), vector_search.TREES, vector_search.BITS)
    asked = np.array([rows[0][1]])
    best = vector_search.Best(1, 11)
    seen = []
    counted = looked.seen
    looked.seen = lambda *a: seen.append(counted(*a)) or seen[-1]
    vector_search.look(looked, [np.array([i]) for i, *_ in rows], asked, best, 0)
    assert sum(len(x[0]) for x in seen) < 1500


def test_small_blocks_and_many_jobs(spark, table, monkeypatch):
    want = {table[i][0]: near for i, near in neighbours(table, 20, 20).items()}
    monkeypatch.setattr(vector_search, "QUERY_COMPONENTS", 700)
    data = spark.read.parquet(f"{DATA}/embeddings.parquet")
    got = found(vector_search.nearest(data))
    assert got.keys() == want.keys() and recall(got, want) >= 0.95


def odd_rows():
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)], i % 3) for i in range(1, 90)]
    rows += [(100 + i, [1.0] * 8, 7) for i in range(60)]  # a hot vector
    rows += [(20, [1.0] * 8, None), (20, [1.0] * 8, None), (40, [2.0] * 8, None)]  # repeated ids and rows
    rows += [(200, None, 1), (220, [], 1), (240, [0.0] * 8, 1), (260, [1.0, None] * 4, 1), (280, [nan] * 8, 1), (300, [inf] + [1.0] * 7, 1), (None, [3.0] * 8, 1), (320, [1.0] * 12, None), (340, [1.0] * 3, None)]
    return rows


def test_op11_odd_rows(spark):
    rows = odd_rows()
    data = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = found(vector_search.nearest(data.select("*", *(F.lit("x").alias(c) for c in ("q", "score", "own", "vector", "ids", "place"))), k=5))
    taking = [r for r in rows if r[0] is not None and r[1] and len(r[1]) == 8 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    want = {}
    for i, near in neighbours(taking, 20, 5).items():
        want.setdefault(taking[i][0], []).append(near)
    assert got.keys() == want.keys()
    for q in want:
        if len(want[q]) == 1:
            assert [i for _, i in got[q]] == [i for _, i in want[q][0]], q
    counts = {r.query_id: r["n"] for r in vector_search.nearest(data, k=5).groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert counts[20] == 5 * len(want[20]) and counts[100] == 5
    assert vector_search.nearest(data.filter("false")).count() == 0
    assert vector_search.nearest(data.filter("vec_id in (320, 340)")).count() == 0
    few = found(vector_search.nearest(data.filter("vec_id in (100, 101, 120)")))
    assert {q: [i for _, i in near] for q, near in few.items()} == {100: [101, 120], 120: [100, 101]}


def codes(rows, parts=4, entries=256, rounds=4):
    whole = np.floor(np.array([v for _, v, _ in rows], float) * 1024).astype(np.int64)
    x = whole.reshape(len(rows), parts, -1)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = x[order].transpose(1, 0, 2).copy()

    def assign():
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        return far.argmin(2), far.min(2)

    for _ in range(rounds):
        entry, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (entry[:, p] == e).any():
                    own = x[entry[:, p] == e, p]
                    books[p, e] = own.sum(0) // len(own)
    entry, far = assign()
    digest = sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
    error = far.sum(1).tolist()
    of_label = {}
    for (_, _, label), e in zip(rows, error, strict=True):
        of_label[label] = of_label.get(label, 0) + e
    return sorted(((i, bytes(c).hex(), e, of_label[label], digest) for (i, _, label), c, e in zip(rows, entry.astype(np.uint8), error, strict=True)), key=repr)


def test_op12(spark, table):
    assert sorted(map(tuple, queries.QUERIES["op12_codes"](spark, DATA).collect()), key=repr) == codes(table)


@pytest.mark.parametrize("most_labels", [0, 10])
def test_op12_odd_rows(spark, monkeypatch, most_labels):
    monkeypatch.setattr(vector_codes, "MOST_LABELS", most_labels)
    rows = odd_rows()
    data = spark.createDataFrame(rows, SCHEMA).repartition(4)
    taking = [r for r in rows if r[1] and len(r[1]) == 8 and all(v is not None and np.isfinite(v) for v in r[1])]
    clashing = data.select("*", *(F.lit("x").alias(c) for c in ("whole", "entry", "upper", "low", "vector", "error", "own", "code")))
    got = sorted(map(tuple, vector_codes.quantise(clashing, entries=16).collect()), key=repr)
    assert got == codes(taking, entries=16)
    assert vector_codes.quantise(data.filter("false")).count() == 0
    assert vector_codes.quantise(data.filter("vec_id = 340 or embedding is null")).count() == 0


def test_bounds_skip_most(table):
    """The bounds leave few entries to measure, and never the wrong ones."""
    rng = np.random.default_rng(1)
    book = rng.integers(-500, 500, (64, 16))
    x = book[rng.integers(0, 64, 4000)] + rng.integers(-60, 60, (4000, 16))
    bounds = vector_codes.Bounds.first(x, book)
    moved = book + rng.integers(-5, 5, book.shape)
    halves = np.sqrt(vector_codes.squared(moved, moved)) / 2
    entry, far = bounds.nearest(x, moved, np.sqrt(((moved - book) ** 2).sum(1)), halves)
    want = vector_codes.squared(x, moved)
    assert (entry == want.argmin(1)).all() and (far == want.min(1)).all()
    with pytest.raises(ValueError):
        vector_codes.whole_parts(np.full((1, 8), 1e9), 4)
