"""Periodic runs (operator 13) against a plain comparison of all places at all lags."""

import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from textloom.llm import periods, queries
from tests.llm.test_edges import CLASH, ROWS
from tests.llm.test_edges import SCHEMA as ODD_SCHEMA


def runs_of(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_of(words)
    kept = [w for i, w in enumerate(words) if not any(a + q <= i < a + m for a, m, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, n, len(runs), *best, milli, sha256("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()).hexdigest(), sha256(" ".join(kept).encode()).hexdigest())


def test_op13(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.QUERIES["op13_periods"](spark, DATA).collect()))
    assert got == sorted(expected(*r) for r in docs)
    assert sum(r[2] for r in got) > 20


@pytest.mark.parametrize("long_bytes", [periods.LONG_BYTES, 30])
def test_odd_rows(spark, long_bytes):
    odd = [r for r in ROWS if r[0] not in (9, 10)] + [(10, "a " * 600 + "b c " * 90, "en", "s", 1), (11, "x y " * 7 + "z", None, None, 0), (12, " ".join("abcabcab" * 4), "en", "s", 1), (10, "a\tb\n" * 50, "en", "s", 1)]
    data = spark.createDataFrame(odd, ODD_SCHEMA).repartition(3)
    clashing = data.select("*", *(F.lit("x").alias(c) for c in [*CLASH, "row", "numbers", "ranges", "runs", "low", "high"]))
    got = sorted(map(tuple, periods.periodic_runs(clashing, long_bytes=long_bytes, work=2000).collect()), key=repr)
    assert got == sorted((expected(r[0], r[1]) for r in odd), key=repr)
    assert periods.periodic_runs(data.filter("false"), long_bytes=long_bytes).count() == 0


def test_random_words():
    """Texts searched together, and each by ranges of lags."""
    rng = random.Random(3)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 5)):
            t: list[int] = []
            while len(t) < rng.choice([0, 10, 50, 300]):
                t += [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randint(1, 20))] * rng.randint(1, 12)
            texts.append(t)
        texts.sort(key=len, reverse=True)
        own = [np.array(t, np.int32) + 100 * i for i, t in enumerate(texts)]
        want = [runs_of(t) for t in texts]
        assert periods.find_runs(np.concatenate(own), np.append(0, np.cumsum([len(t) for t in texts]))) == want
        for x, w in zip(own, want, strict=True):
            ranges = [periods.find_runs(x, np.array([0, len(x)]), r)[0] for r in periods.lag_ranges(len(x), 200)]
            assert sorted(y for part in ranges for y in part) == w


def test_long_text():
    """All lags match in a text of one word; a known run covers its multiples."""
    one = np.zeros(40_000, np.int32)
    assert periods.find_runs(one, np.array([0, len(one)])) == [[(0, 40_000, 1)]]
    assert periods.lag_ranges(0) == periods.lag_ranges(2) == [] and len(periods.lag_ranges(3_000_000)) <= 2 * periods.MOST_RANGES
