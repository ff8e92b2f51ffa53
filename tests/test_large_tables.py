"""Queries over tables with odd rows, and steps that must not be made twice or by row."""

import random
from collections import Counter
from difflib import SequenceMatcher
from threading import Thread

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import DATA
from textloom.functions import confusing, counting, differences
from textloom.functions import rewriting as R
from textloom.functions.segmenting import Segmenter
from textloom.jobs import queries
from textloom.operators import correcting, ngrams, parsing
from textloom.sources import tables


def against_sql(spark, tmp_path, name, docs):
    """A query and its twin over ``docs`` (``doc_id, text``)."""
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    found = con.execute(f"select {', '.join(df.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=repr), sorted(found, key=repr)


def test_cap_with_ties_and_texts_that_do_not_count(spark, tmp_path):
    """Texts without a counted character are in wherever they stand; a text comes after the others of its place."""
    docs = [(0, "a" * 400_000), (1, "A。"), (2, "b" * 500_000), (2, "c" * 300_000), (2, "d" * 100_000), (3, "e" * 10), (4, "A"), (5, None), (None, "f" * 10), (None, "B")]
    got, wanted = against_sql(spark, tmp_path, "corpus_cap", docs)
    assert got == wanted and {x[0] for x in got} == {0, 1, 2, 4, 5, None} and len(got) == 6


def test_cap_that_rows_without_a_place_reach(spark, tmp_path):
    docs = [(0, "a" * 400_000), (None, "b" * 700_000), (None, "c" * 300_000), (None, "B")]
    got, wanted = against_sql(spark, tmp_path, "corpus_cap", docs)
    assert got == wanted and len(got) == 3


TEXTS = ["天地玄黄宇宙洪荒", "", None, "a", "在𠀀再", "x" * 50, "在再在再在再", "玄黄", "他"] * 3


def test_grams_and_neighbours_of_slices(monkeypatch):
    """Arrays of text give what a walk over each text gives, in one slice or many, counted in one array or sorted."""
    column = pa.array(TEXTS)
    wanted = np.array(sorted(map(ord, "在再他")))
    for size, cells in ((1 << 22, 1 << 22), (40, 0), (1, 1 << 22)):
        monkeypatch.setattr(counting, "SLICE_BYTES", size)
        monkeypatch.setattr(counting, "MOST_CELLS", cells)
        for n in (1, 2, 3):
            got = Counter()
            for grams, counts in counting.counted_grams(column, n):
                got.update(dict(zip(grams.to_pylist(), counts.tolist(), strict=True)))
            assert got == Counter(t[i : i + n] for t in TEXTS if t for i in range(len(t)))
        for some in (wanted, None):
            got = []
            for rows, places, found in counting.neighbourhoods(column, some, (-1, 2)):
                got += zip(rows.tolist(), places.tolist(), *(x.to_pylist() for x in found), strict=True)
            assert got == [(k, i, c, t[i - 1] if i else "", t[i + 2 : i + 3]) for k, t in enumerate(TEXTS) if t for i, c in enumerate(t) if some is None or c in "在再他"]


def test_segments_are_counted_once(spark, tmp_path, monkeypatch):
    """The tables of all lengths come from one reading of the segments."""
    calls = []
    counted = ngrams.count_grams
    monkeypatch.setattr(ngrams, "count_grams", lambda *a: calls.append(a) or counted(*a))
    docs = [(i, t) for i, t in enumerate(["abcab, kv. vabc", "ab", "kakv kavk", None, "A. b"])]
    for name in ("next_char_scores", "candidate_scores", "candidate_scores_triples"):
        calls.clear()
        got, wanted = against_sql(spark, tmp_path / name, name, docs)
        assert len(calls) == 1 and got and got == wanted


@pytest.mark.parametrize("most", [200_000, 3])
def test_verdicts_without_a_shuffle_of_tokens(spark, tmp_path, monkeypatch, most):
    """Tokens in arrays: the verdicts of the SQL, and no row of a token is dealt out; with few words allowed, by the table's way."""
    monkeypatch.setattr(parsing, "MOST_ROLE_WORDS", most)
    monkeypatch.setattr(parsing, "MOST_LOOKED_UP", 2_000_000 if most > 3 else 3)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(60).collect()
    for name in ("phrase_verdicts", "dependency_verdicts"):
        got, wanted = against_sql(spark, tmp_path / name, name, [*map(tuple, docs), (10**6, None), (10**6 + 1, "")])
        assert got and got == wanted
        if most > 3:
            plan = queries.QUERIES[name](spark, str(tmp_path / name))._jdf.queryExecution().optimizedPlan().toString()
            assert "Aggregate" not in plan and "Join" not in plan


def test_texts_are_corrected_once_to_be_written(spark, tmp_path):
    """Corrected texts and suggestions are written from one pass; nothing else stays."""
    seen = spark.sparkContext.accumulator(0)

    def doubled(text):
        seen.add(1)
        return text.replace("的的", "的")

    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["的的好", "好", None, "的的的的"])], "doc_id long, text string")
    tables.write_corrections(correcting.proofread(texts, [R.Stage("s", "r", "源", 1.0, doubled)]), str(tmp_path / "out"))
    assert seen.value == 3 and sorted(x.name for x in (tmp_path / "out").iterdir()) == ["corrected", "suggestions"]
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "corrected")).collect()} == {(0, "的的好", "的好"), (1, "好", "好"), (2, None, None), (3, "的的的的", "的的")}
    assert spark.read.parquet(str(tmp_path / "out" / "suggestions")).groupBy("doc_id").count().count() == 2


def test_tokens_and_suggestions_of_slices(spark, monkeypatch):
    """Tasks hold the tokens and suggestions of a slice of texts, not of a batch; the rows are the same."""
    texts = spark.createDataFrame([(i, "天地的的玄黄" * (i % 4) or None) for i in range(40)], "doc_id long, text string").coalesce(1)
    known = spark.createDataFrame([("天地", 60, "n"), ("玄", 5, "x")], "word string, freq long, tag string")
    stages = [R.Stage("s", "r", "源", 1.0, lambda t: t.replace("的的", "的"))]
    got = []
    for size in (1, 100, 1 << 18):
        monkeypatch.setattr(correcting, "TEXT_BYTES", size)
        monkeypatch.setattr(correcting, "OUT_ROWS", size)
        cut, fixed = correcting.tag_tokens(texts, known), correcting.proofread(texts, stages)
        got.append((sorted(map(tuple, cut.collect())), sorted(map(tuple, correcting.suggestions_of(fixed).collect())), fixed.filter("corrected is null").count()))
        assert "MapInArrow" in cut._jdf.queryExecution().toString() and "MapInArrow" in fixed._jdf.queryExecution().toString()
    assert got[0] == got[1] == got[2] and got[0][2] == 10
    assert [x[1:] for x in got[0][0] if x[0] == 1] == [(0, "天地", "n", 0, 2), (1, "的", "x", 2, 3), (2, "的", "x", 3, 4), (3, "玄", "x", 4, 5), (4, "黄", "x", 5, 6)]
    assert len(got[0][1]) == 60


def test_a_run_is_cut_alike_wherever_it_stands():
    """Of equal products the longer word comes first, whatever follows in the text; rounding of long sums decided before."""
    rng = random.Random(3)
    words = {w: (rng.randint(1, 900), "n") for w in ("地", "地地", "的", "的地", "地的", "天", "天地")}
    cutter = Segmenter(words)
    for _ in range(300):
        run = "".join(rng.choices("地的天", k=rng.randint(1, 12)))
        alone = [w for w, *_ in Segmenter(words).cut(run)]
        text = f"{'天 地。' * rng.randint(0, 400)}黄{run}，x{'的地 ' * rng.randint(0, 400)}"
        at = text.index("黄") + 1
        assert [w for w, _, i, _ in cutter.cut(text) if at <= i < at + len(run)] == alone
        assert all(text[i:j] == w for w, _, i, j in cutter.cut(text))


def test_swapped_characters_are_told_without_a_search(monkeypatch):
    """Changes place by place are what SequenceMatcher finds, and are found without it; others still by it."""
    rng = random.Random(4)
    for _ in range(400):
        before = "".join(rng.choices("abcdef一二", k=rng.randint(1, 60)))
        after = before.translate(str.maketrans({"一": "1", "二": "2"} if rng.random() < 0.7 else {"a": "b"}))
        wanted = [tuple(x[1:]) for x in SequenceMatcher(None, before, after, autojunk=False).get_opcodes() if x[0] != "equal"]
        assert differences.differing(before, after) == wanted
    monkeypatch.setattr(differences, "SequenceMatcher", None)
    assert differences.differing("一b二二d", "1b22d") == [(0, 1, 0, 1), (2, 4, 2, 4)]


def test_later_passes_look_where_something_changed():
    """Confusions are put to their questions again only near a change; a text in which nothing changes is read once."""
    asked = []
    fix = confusing.Confusions({"现在": (900, "t"), "天": (9, "n")})
    ask = fix._changed
    fix._changed = lambda chars, i, *rest: asked.append(i) or ask(chars, i, *rest)
    text = "再见了。" + "他再天天。" * 200 + "现再好"
    fix(text)
    first = sum(c in fix.noted for c in text)
    assert first <= len(asked) < 2 * first


def test_one_of_many_writers_gets_a_number(spark, tmp_path):
    """Of writers that publish the same number at the same time one succeeds, and what stands there is its own."""
    for n in range(40):
        won = []

        def publish(name, n=n, won=won):
            if tables._published(spark, str(tmp_path), n, name, ""):
                won.append(name)

        writers = [Thread(target=publish, args=(f"w{k}",)) for k in range(4)]
        [w.start() for w in writers]
        [w.join() for w in writers]
        assert len(won) == 1 and tables._version(spark, str(tmp_path), n) == won
