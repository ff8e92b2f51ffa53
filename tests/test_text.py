"""Column functions on golden rows, against plain statements of their rules, and their invariants."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T


def column(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.r for r in df.select("i", fn(F.col("t")).alias("r")).orderBy("i").collect()]


def rand_texts(alphabet, n=300, most=30, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, most))) for _ in range(n)] + [None]


def spaced(text):
    """The spacing rule said in plain words of tokens; each CJK character and mark is a token of its own."""
    out, prev, at = [], None, 0
    for m in re.finditer("[A-Za-z0-9]+|[一-鿿，。！？；：…　＀-￯]|[ \t]+", text):
        out.append(text[at : m.start()])
        token, at = m[0], m.end()
        kind = "en" if re.fullmatch("[A-Za-z0-9]+", token) else "cn" if re.fullmatch("[一-鿿]", token) else "sp" if re.fullmatch("[ \t]+", token) else "ot"
        if {kind, prev} == {"en", "cn"} and not "".join(out).endswith(" "):
            out.append(" ")
        out.append(token)
        prev = kind if kind != "ot" else prev
    return "".join([*out, text[at:]])


def test_space_mixed(spark):
    texts = rand_texts("中文，。ab1 \t-。")
    assert column(spark, T.space_mixed, texts) == [None if t is None else spaced(t) for t in texts]
    assert column(spark, T.space_mixed, ["Python编程", "中文abc", "用Python 写", "中，abc", "一" + "，" * 100_000]) == ["Python 编程", "中文 abc", "用 Python 写", "中， abc", "一" + "，" * 100_000]


def collapsed(text):
    def best(m):
        marks = [c for c in m[0] if c in T.MARKS]
        return "？！" if "！" in marks and "？" in marks else min(marks, key=T.MARKS.index)

    return re.sub(f"(?:\\s*[{T.MARKS}])+", best, text)


def test_collapse_punct(spark):
    texts = rand_texts("中！？。；，… \n　a")
    got = column(spark, T.collapse_punct, texts)
    assert got == [None if t is None else collapsed(t) for t in texts]
    assert column(spark, T.collapse_punct, got) == got
    long = ["一" + "。 ！" * 100_000 + "二", "。" * 100_000, " " * 100_000 + "一", "？" + " " * 100_000 + "！ "]
    assert column(spark, T.collapse_punct, long) == ["一！二", "。", " " * 100_000 + "一", "？！ "]


@pytest.mark.parametrize("word, value", [("十", 10), ("二十三", 23), ("十五", 15), ("九", 9), ("两", 2), ("二十", 20), ("百", None), ("", None), ("二百", None)])
def test_cn_to_int(spark, word, value):
    assert column(spark, T.cn_to_int, [word]) == [value]


def test_spoken_digits(spark):
    assert column(spark, T.restore_spoken_digits, ["K八S", "二十点五", "Python8", "两百"]) == ["k8s", "2105", "python8", "2100"]


def chunked(text, most):
    if len(text) <= most:
        return [text]
    out, cur = [], ""
    for part in re.split("([。！？\n]+)", text):
        if cur and len(cur) + len(part) > most:
            out.append(cur)
            cur = part
        else:
            cur += part
    return out + [cur] * bool(cur)


def test_chunks(spark):
    texts = [t for t in rand_texts("中文字。！\n", most=80)]
    got = column(spark, lambda c: T.chunk_text(c, 12), texts)
    assert got == [None if t is None else chunked(t, 12) for t in texts]
    assert ["".join(x) for x in got if x is not None] == [t for t in texts if t is not None]


def test_redundancy(spark):
    got = column(spark, T.redundancy_warnings, ["好的的 ", "了了吧吧", "一", ""])
    assert [[(w.start, w.end, w.doubled) for w in x] for x in got] == [[(1, 3, "的的"), (2, 4, "的的")], [(0, 2, "了了"), (2, 4, "吧吧")], [], []]


def test_guarded(spark):
    assert column(spark, lambda c: T.guarded_replace(c, "到是", "倒是", not_after="[看想]"), ["看到是", "这到是"]) == ["看到是", "这倒是"]


def test_clauses(spark):
    assert column(spark, lambda c: T.apply_by_clause(c, F.reverse), ["一二。三四，，五", "。", ""]) == ["二一。四三，，五", "。", ""]


def test_plain_rules(spark):
    assert column(spark, T.fix_ba_pattern, ["把它们切入系统", "切入正题"]) == ["把它们接入系统", "切入正题"]
    assert column(spark, T.is_mixed_language, ["用Python写", "用P写", "abc"]) == [True, False, False]
    assert column(spark, T.strip_tone, ["nǐ hǎo lǜ"]) == ["ni hao lü"]
    assert column(spark, T.split_sentences, ["一二。三！四五\n六七"]) == [["一二", "四五", "六七"]]
    assert column(spark, T.add_punctuation, ["因为下雨所以不去"]) == ["因为，下雨所以，不去。"]


def test_pre_fix_de(spark):
    cases = {"人们很喜欢得，还有别的": "人们很喜欢的，还有别的", "他高兴得，而且跳了": "他高兴得，而且跳了", "我记得，然后走了": "我记得，然后走了", "他跑得，可快了": "他跑得，可快了", "显示出来得对吗": "显示出来的对吗", "出来得早": "出来得早", "长的真漂亮": "长得真漂亮", "长的绳子": "长的绳子"}
    assert column(spark, T.pre_fix_de, list(cases)) == list(cases.values())
