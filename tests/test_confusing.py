"""Confusable characters, names, variants and particles, with a small lexicon of their own."""

import pytest

from textloom.functions import particles
from textloom.functions.confusing import Confusions, Variants, proper_nouns
from textloom.functions.rewriting import Terms, distance
from textloom.jobs import golden
from textloom.operators import correcting

@pytest.fixture(scope="module")
def lexicon():
    return golden.lexicon()


def test_sentences(lexicon, spark):
    cases = golden.sentences()
    table = spark.createDataFrame([("all", str(i), a, b) for i, (a, b) in enumerate(cases)], "case_group string, label string, input string, expected string")
    known = spark.createDataFrame([(w, f, t) for w, (f, t) in lexicon.items()], "word string, freq long, tag string")
    got = correcting.correct_confusions(table.selectExpr("input", "input AS output"), known, text_col="output")
    row = correcting.evaluate_cases(got, table).first()
    assert (row.passed, row.failed) == (len(cases), 0) and len(cases) > 100


def test_model_decides_what_the_lexicon_leaves():
    assert Confusions({}, lambda text, i, orig, cand: 1.0)("树根") == "树跟"
    assert Confusions({}, lambda text, i, orig, cand: -1.0)("树根") == "树根"
    assert Confusions({})("树根") == "树根" and Confusions({})("") == "" and Confusions({})("abc") == "abc"


def test_forced_places_stay(lexicon):
    assert Confusions(lexicon)("鬼鬼崇崇，付责") == "鬼鬼祟祟，负责"


def test_names(lexicon):
    freq = lambda w: lexicon.get(w, (0,))[0]
    for text, named in {"王建国先生来了": "王建国", "李总同意": "李", "柳溪镇很安静": "柳溪", "远山科技公司": "远山科技", "欧阳娜娜唱歌": "欧阳娜娜", "李子很好吃": "", "上海市欢迎你": "", "王在开会": "", "周未": ""}.items():
        at = proper_nouns(text, freq)
        assert {*range(len(named))} <= at and (named or not at), text


def test_variants():
    words = {"水份": (33, "n"), "杯水": (46, "n"), "坐落": (80, "v"), "一座": (900, "m"), "这": (9000, "r"), "才": (500, "d"), "人材": (100, "n"), "案语": (60, "n"), "余辉": (60, "n"), "那末": (60, "c"), "座落": (30, "v")}
    fix = Variants({"水份": "水分", "人材": "人才", "案语": "按语", "余辉": "余晖", "那末": "那么", "座落": "坐落"}, words)
    cases = {"一杯水份": "一杯水分", "人材是": "人才是", "这人材": "这人材", "案语": "按语", "余辉": "余辉", "那末好": "那么好", "那末年": "那末年", "一座落": "一座落", "无": "无"}
    assert {t: fix(t) for t in cases} == cases and Variants({}, words)("水份") == "水份"


def test_clauses():
    tagged = lambda text: [(*x.rsplit("/", 1), 1000) for x in text.split()]
    assert {k: particles.decide(tagged(k)) for k in golden.CLAUSES} == golden.CLAUSES
    assert particles.decide([]) == "" and particles.pre_fix("做完得，然后走") == "做完的，然后走"


def test_particles_of_texts(spark):
    known = spark.createDataFrame([("他", 9000, "r"), ("跑", 900, "v"), ("快", 900, "a"), ("认真", 900, "a"), ("态度", 900, "n")], "word string, freq long, tag string")
    texts = spark.createDataFrame([(1, "他跑的快，认真地态度。长的漂亮"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.text for r in correcting.correct_particles(texts, known).orderBy("doc_id").collect()] == ["他跑得快，认真的态度。长得漂亮", None, ""]


def test_terms_of_a_text():
    terms = Terms([("Kubernetes", 2.0), ("K8s", 2.0), ("k8S", 9.0), ("PyTorch", 4.5), ("数据", 2.0)])
    assert terms("用k八s，kubernetse和Python") == "用K8s，Kubernetes和Python" or terms("kubernetse，k八s") == "Kubernetes，K8s"
    assert distance("abc", "acb") == 2 and distance("", "ab") == 2


def test_all_stages(spark, lexicon):
    stages = correcting.default_stages(lexicon=lexicon, terms=[("K8s", 2.0)], variants={"水份": "水分"}, user=[])
    assert [s.name for s in stages] == ["numerals", "simplified", "particles", "terms", "typos", "confusions", "ba", "variants", "user", "learned", "punctuation"]
    texts = spark.createDataFrame([(1, "这个板本有水份，，k8s，把它切入“好")], "doc_id long, text string")
    row = correcting.proofread(texts, stages).first()
    assert row.corrected == "这个版本有水分，K8s，把它接入“好”"
    assert [(s.start, s.original, s.replacement, s.source) for s in row.suggestions] == [(9, "k", "K", "术语"), (2, "板", "版", "同音字"), (15, "切", "接", "语境混淆"), (6, "份", "分", "异形词"), (8, "，", "", "标点"), (19, "", "”", "标点")]
