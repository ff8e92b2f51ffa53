"""Names from several sources, and n-gram tables as a model inside the corrector."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from textloom.functions.confusing import Confusions, name_places
from textloom.jobs import golden, queries
from textloom.operators import correcting, lexicon, ngrams

SPANS = "doc_id long, start int, end int"


def united(spans):
    out = set()
    for doc in {s[0] for s in spans if s[0] is not None}:
        own = sorted((a, b) for d, a, b in spans if d == doc and a is not None and b is not None and a < b)
        merged = []
        for a, b in own:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(doc, a, b) for a, b in merged}
    return out


def test_unite_spans(spark):
    rng = random.Random(4)
    one = [(rng.randrange(6), a := rng.randrange(40), a + rng.randrange(6)) for _ in range(80)]
    two = [(rng.randrange(8), a := rng.randrange(40), a + rng.randrange(6)) for _ in range(80)] + [(None, 1, 2), (1, None, 3), (1, 3, None), (2, 5, 4)]
    got = correcting.unite_spans(spark.createDataFrame(one, SPANS), spark.createDataFrame(two, SPANS))
    assert set(map(tuple, got.collect())) == united(one + two)
    assert correcting.unite_spans(spark.createDataFrame([], SPANS)).count() == 0


def test_names_of_a_model_stay(spark):
    known = golden.lexicon()
    assert Confusions(known)("以经来了") == "已经来了" and Confusions(known)("以经来了", [(0, 2)]) == "以经来了"
    freq = lambda w: known.get(w, (0,))[0]
    assert name_places("王得福来了", [(0, 3), (3, 5), (0, 1), (None, 2)], freq) == {0, 1, 2, 3, 4}
    assert name_places("非常", [(0, 2)], freq) == set()  # a word, whatever a model says
    texts = spark.createDataFrame([(1, "以经来了", "x"), (2, "以经来了", "x"), (3, None, "x"), (None, "以经来了", "x")], "doc_id long, text string, __spans string")
    words = spark.createDataFrame([(w, f, t) for w, (f, t) in known.items()], "word string, freq long, tag string")
    got = correcting.correct_confusions(texts, words, names=spark.createDataFrame([(1, 0, 2), (1, 0, 2), (9, 0, 1)], SPANS))
    assert got.columns == texts.columns and sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "以经来了", "x"), (2, "已经来了", "x"), (3, None, "x"), (None, "已经来了", "x")], key=repr)


def test_filter_ner_spans(spark):
    texts = spark.createDataFrame([(1, "王得福在上海市"), (2, None), (3, "上海市")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, 3), (1, 0, 3), (1, 4, 7), (1, 0, 1), (1, 0, 6), (2, 0, 2), (3, 0, 3), (4, 0, 2)], SPANS)
    words = spark.createDataFrame([("上海市", 500), ("王得福", 3)], "word string, freq long")
    assert {tuple(r) for r in lexicon.filter_ner_spans(spans, texts, words).collect()} - {(2, 0, 2)} == {(1, 0, 3)}


@pytest.mark.parametrize("triples", [False, True])
def test_the_model_scores_as_the_join_does(spark, triples):
    """Every window of the tables: the same evidence rule and the same difference."""
    segs = ngrams.segments(queries.script(spark, DATA))
    tables = [ngrams.train_ngrams(segs, n) for n in ((1, 2, 3) if triples else (1, 2))]
    model = ngrams.collect_model(*tables)
    texts = queries.script(spark, DATA).filter(F.length("text") < 800)
    whole = {r.doc_id: r.text for r in texts.collect()}
    rows = ngrams.score_candidates(texts, queries._confusions(spark), *tables).collect()
    assert len(rows) > 1000 and any(r.delta is not None for r in rows)
    for r in rows:
        delta = model(whole[r.doc_id], r.pos, r.orig, r.cand)
        assert (delta is None) == (r.delta is None) and (delta is None or abs(delta - r.delta) < 1e-9), r


def test_the_model_decides_in_the_corrector(spark):
    segs = spark.createDataFrame([("大树根很长",)] * 5 + [("树跟",)], "seg string")
    model = ngrams.collect_model(ngrams.train_ngrams(segs, 1), ngrams.train_ngrams(segs, 2))
    none = spark.createDataFrame([], "word string, freq long, tag string")
    texts = spark.createDataFrame([(1, "树跟很长")], "doc_id long, text string")
    assert Confusions({}, lambda *a: None)("树根") == "树根"
    assert correcting.correct_confusions(texts, none, model).first().text in ("树根很长", "树跟很长")
    assert model("树根很", 1, "根", "跟") < 0 and model("x", 0, "x", "y") is None
    with pytest.raises(ValueError):
        ngrams.collect_model(ngrams.train_ngrams(segs, 1), ngrams.train_ngrams(segs, 2), most=2)
    empty = ngrams.collect_model(ngrams.train_ngrams(segs.filter("false"), 1), ngrams.train_ngrams(segs.filter("false"), 2))
    assert empty("树根", 1, "根", "跟") is None
