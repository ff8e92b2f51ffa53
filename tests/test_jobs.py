"""Stores, lists, streams, mining and edge rows."""

from pyspark.sql import functions as F

from textloom.functions import rewriting as R
from textloom.operators import correcting, lexicon, mining, ngrams
from textloom.sources import tables
from textloom.streaming import jobs

DIFF = "old string, new string, raw string, manual boolean, ts bigint"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_rules_promote_and_merge(spark):
    events = [("在见", "再见", "a", False, 1), ("在见", "再见", "a", False, 2), ("在见", "再见", "b", False, 3), ("了草", "潦草", "c", False, 4), ("按装", "安装", "d", True, 5), ("按装", "安装", None, None, 6)]
    diffs = spark.createDataFrame(events, DIFF)
    rules = mining.promote_rules(diffs)
    assert {(r.old, r.n_sentences, r.promoted) for r in rules.collect()} == {("在见", 2, True), ("了草", 1, False), ("按装", 1, True)}
    first, second = mining.promote_rules(diffs.filter("ts < 3")), diffs.filter("ts >= 3")
    merged = mining.promote_rules(second, first)
    assert {(r.old, r.promoted) for r in merged.collect()} == {(r.old, r.promoted) for r in rules.collect()}
    shuffled = mining.promote_rules(diffs.repartition(5).orderBy(F.desc("ts")))
    assert rows(shuffled.drop("sketch")) == rows(rules.drop("sketch"))
    assert mining.promote_rules(diffs.filter("false")).count() == 0


def test_rule_store(spark, tmp_path):
    path = str(tmp_path / "rules")
    assert tables.read_rules(spark, path).count() == 0
    rules = mining.promote_rules(spark.createDataFrame([("a一", "b一", "r", True, 1)], DIFF))
    tables.write_rules(rules, path)
    tables.write_rules(mining.promote_rules(spark.createDataFrame([("c一", "d一", "r", False, 2)], DIFF), tables.read_rules(spark, path)), path)
    assert {r.old for r in tables.read_rules(spark, path).collect()} == {"a一", "c一"}
    tables.clear_rules(spark, path)
    assert tables.read_rules(spark, path).count() == 0


def test_streams_equal_batch(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    events = [("在见", "再见", f"s{i % 3}", i == 7, i) for i in range(9)] + [("了草", "潦草", "x", False, 1)]
    for i in range(2):
        spark.createDataFrame(events[i::2], DIFF).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(DIFF).option("maxFilesPerTrigger", 1).parquet(str(source))
    jobs.stream_promote_rules(stream, store, str(tmp_path / "cp")).awaitTermination()
    batch = mining.promote_rules(spark.read.schema(DIFF).parquet(str(source)))
    got = tables.read_rules(spark, store)
    assert rows(got.select("old", "new", "promoted", "first_seen")) == rows(batch.select("old", "new", "promoted", "first_seen"))

    stages = [R.Stage("t", "typos", "typos", 1.0, lambda t: t.replace("在见", "再见"))]
    texts = spark.readStream.schema(DIFF).parquet(str(source)).select(F.col("ts").alias("utt_id"), F.col("old").alias("text"))
    jobs.stream_proofread(texts, stages).writeStream.format("memory").queryName("fixed").trigger(availableNow=True).start().awaitTermination()
    assert {r.corrected for r in spark.table("fixed").collect()} == {"再见", "了草"}


def test_windowed_counts(spark, tmp_path):
    made = spark.sql("SELECT timestamp_seconds(id * 60) AS ts, if(id % 2 = 0, 'a', 'b') AS source, 'o' AS old, 'n' AS new, cast(id % 3 AS string) AS raw FROM range(30)")
    made.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "s"))
    for name, df in (("counts", jobs.stream_suggestion_counts(stream)), ("evidence", jobs.stream_rule_evidence(stream))):
        df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "counts" else "update").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("counts").collect()) == [5] * 6
    assert max(r.n_sentences for r in spark.table("evidence").collect()) == 3


def test_expansion(spark):
    words = spark.createDataFrame([("大模型", 100, "n"), ("大磨型", 80, "n"), ("魔力", 60, "n"), ("磨刀", 60, "n"), ("磨", 9, "n"), ("魔", 5, "n")], "word string, freq bigint, tag string")
    readings = spark.createDataFrame([(c, "mo") for c in "摸磨魔模"] + [("大", "da"), ("型", "xing"), ("形", "xing")], "ch string, syllable string")
    rules = spark.createDataFrame([("大摸型", "大模型"), ("方式", "方法"), ("大摸", "大模型")], "old string, new string")
    got = mining.expand_homophones(rules, readings, words)
    assert rows(got) == [("大摸形", "大模型", "大摸型", "大模型", 2), ("大魔型", "大模型", "大摸型", "大模型", 1)]  # 大磨型 is a word, 大模型 the target
    shapes = spark.createDataFrame([("摸", "漠"), ("型", "型")], "a string, b string")
    assert [r.old for r in mining.expand_shapes(rules, shapes, words).collect() if r.old != "大摸型"] == ["大漠型"]
    assert mining.homophone_groups(readings).filter("syllable = 'xing'").first().chars == ["型", "形"]


def test_terms(spark):
    terms = spark.createDataFrame([(0, "Kubernetes", 2.0), (1, "K8s", 2.0), (2, "PyTorch", 4.5)], "ord int, word string, score double")
    texts = spark.createDataFrame([(1, "用K八S和pytorhc，"), (2, "kubernetse"), (3, "Python是"), (4, ""), (5, "纯中文")], "doc_id bigint, text string")
    found = dict(rows(lexicon.restore_terms(texts, terms)))
    assert found == {"kubernetse": "Kubernetes"} or "K8s" in found.values()
    fixed = dict(rows(lexicon.apply_terms(texts, lexicon.restore_terms(texts, terms))))
    assert fixed[2] == "Kubernetes" and fixed[3] == "Python是" and fixed[4] == "" and fixed[5] == "纯中文"


def test_lists(spark):
    lines = spark.createDataFrame([(0, "# c"), (1, "K8s 4.5"), (2, "Ant Design 5.0"), (3, " "), (4, "数据")], "ord int, value string")
    assert rows(tables.parse_terms(lines)) == [("Ant", 2.0), ("K8s", 4.5), ("数据", 2.0)]
    variants = spark.createDataFrame([(0, "按语 案语、标识 1 an"), (1, "人才 人材 2 ren"), (2, "其他 其它、人材 3 qi")], "ord int, value string")
    assert rows(tables.parse_variants(variants)) == [("其他", "人材"), ("其他", "其它"), ("按语", "案语")]


def test_models(spark, tmp_path):
    segs = spark.createDataFrame([("一二一二",), ("一二",), ("三",)], "seg string")
    uni, bi, tri = (ngrams.train_ngrams(segs, n) for n in (1, 2, 3))
    assert rows(uni) == [("一", 3), ("二", 3)] and rows(bi) == [("一", "二", 3)] and rows(tri) == []
    tables.write_ngrams(uni, bi, str(tmp_path / "m"), tri)
    assert [rows(x) for x in tables.read_ngrams(spark, str(tmp_path / "m"), True)] == [rows(uni), rows(bi), []]
    scored = ngrams.score_next(spark.createDataFrame([("一", "二"), (None, "一"), ("一", "九")], "a string, b string"), uni, bi)
    p = {(r.a, r.b): 2.718281828459045**r.log_p for r in scored.collect()}
    assert abs(p[("一", "二")] - (0.85 * 3 / 3 + 0.12 * 4 / 8 + 0.03 / 2)) < 1e-9
    assert abs(p[(None, "一")] - 4 / 8) < 1e-9 and abs(p[("一", "九")] - 1 / 2) < 1e-9


def test_proofread_edges(spark, tmp_path):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "百分之三十，，好"), (4, "三" * 300)], "doc_id bigint, text string")
    got = correcting.proofread(texts, correcting.default_stages())
    out = {r.doc_id: (r.corrected, len(r.suggestions)) for r in got.collect()}
    assert out[1] == (None, 0) and out[2] == ("", 0) and out[3][0] == "30%，好" and out[4][0] == "3" * 300
    tables.write_corrections(got, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c/suggestions")).filter("doc_id = 3").count() == out[3][1]
    assert correcting.suggestion_report(correcting.suggestions_of(got)).filter("source is null").first().n_docs == 2


def test_cap(spark):
    pages = spark.createDataFrame([(i, "一" * 10) for i in range(5000)], "page bigint, text string")
    assert ngrams.cap_corpus(pages, 25).orderBy("page").toPandas().page.tolist() == [0, 1, 2]
    assert ngrams.cap_corpus(pages, 15_000).count() == 1500


def test_phrase_verdicts(spark):
    from textloom.operators import parsing

    texts = {1: "做 了 认真 地 检查", 2: "高兴 的 唱歌", 3: "他 深入 的 研究 能力", 4: "美丽 地 花朵", 5: "我 做 他 认真 的 检查"}
    tokens = spark.createDataFrame([(d, i, w) for d, t in texts.items() for i, w in enumerate(t.split())], "doc_id bigint, idx int, word string")
    roles = spark.createDataFrame([("做", "object_verb"), ("他", "stop"), ("研究", "gerund"), ("能力", "compound_head"), ("检查", "gerund")], "word string, role string")
    phrases = spark.createDataFrame([(1, 3, "DVP", "VP", "NP"), (2, 1, "DVP", "VP", "VP"), (3, 2, "DVP", "VP", "VP"), (4, 1, "DNP", None, "NP"), (5, 4, "DVP", "VP", None)], "doc_id bigint, idx int, label string, inner string, grandparent string")
    verdicts = parsing.phrase_verdicts(phrases, tokens, roles)
    assert rows(verdicts.select("doc_id", "verdict")) == [(1, "的"), (2, "地"), (3, "的"), (4, "的"), (5, "地")]
    assert dict(rows(parsing.apply_verdicts(tokens, verdicts)))[4] == "美丽的花朵"


def test_stream_onto_an_existing_store(spark, tmp_path):
    """What the store holds before a stream's first batch stays, a batch that runs again is not merged twice."""
    source, store, checkpoint = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp")
    for i in range(3):
        tables.write_rules(mining.promote_rules(spark.createDataFrame([(f"o{i}", "n", "r", True, i)], DIFF), tables.read_rules(spark, store)), store)
    spark.createDataFrame([("在见", "再见", "s", False, 9)], DIFF).write.parquet(source)
    stream = spark.readStream.schema(DIFF).parquet(source)
    jobs.stream_promote_rules(stream, store, checkpoint).awaitTermination()
    assert {(r.old, r.promoted) for r in tables.read_rules(spark, store).collect()} == {("o0", True), ("o1", True), ("o2", True), ("在见", False)}
    (tmp_path / "cp/commits/0").unlink()
    (tmp_path / "cp/commits/.0.crc").unlink(missing_ok=True)
    spark.createDataFrame([("在见", "再见", "t", False, 9)], DIFF).write.mode("append").parquet(source)
    jobs.stream_promote_rules(spark.readStream.schema(DIFF).parquet(source), store, checkpoint).awaitTermination()
    assert {(r.old, r.n_sentences, r.promoted) for r in tables.read_rules(spark, store).filter("old = '在见'").collect()} == {("在见", 2, True)}


def test_repeats_do_not_count_again(spark):
    diffs = spark.createDataFrame([("在见", "再见", "a", False, 1), ("在见", "再见", "b", False, 2)], DIFF)
    assert mining.promote_rules(diffs, mining.promote_rules(diffs)).first().n_sentences == 2


def test_terms_of_rows_that_share_an_id(spark, tmp_path):
    (tmp_path / "terms").write_text("# names\nKubernetes 2\nK8s\nk8S 9\n数据\n")
    terms = tables.load_terms(spark, str(tmp_path / "terms"))
    assert [r.word for r in terms.orderBy("ord").collect()] == ["Kubernetes", "K8s", "k8S", "数据"]
    texts = spark.createDataFrame([(1, "k8s，一"), (1, "二 kubernetse"), (2, None), (3, "")], "doc_id bigint, text string")
    for most in (100, 0):
        fixed = lexicon.apply_terms(texts, lexicon.restore_terms(texts, terms), most=most)
        assert sorted(map(repr, fixed.collect())) == sorted(map(repr, spark.createDataFrame([(1, "K8s，一"), (1, "二 Kubernetes"), (2, None), (3, "")], "doc_id bigint, text string").collect()))


def test_conflicts(spark):
    made = [(1, "认真的检查吧", "认真地检查", "认真的检查吧"), (2, "认真的检查", "认真地检查", "认真地检查"), (3, "的", "地", "的的"), (4, "好的", "好吧", "好的"), (5, "跑的快啊", "跑得快", "跑得快啊")]
    pairs = spark.createDataFrame(made, "event_id bigint, raw string, corrected string, verdict string")
    assert rows(correcting.conflicting_pairs(pairs)) == [(1,)]


def test_polish_keeps_rows(spark):
    texts = spark.createDataFrame([(1, "一。二", 5), (1, "三。四", 6), (2, None, 7), (3, "", 8), (None, "五", 9)], "doc_id bigint, text string, row int")
    answer = lambda prompt: F.when(prompt.contains("二"), F.lit(None)).otherwise(F.concat(F.substring_index(prompt, "：", -1), F.lit("x")))
    got = correcting.polished(texts, answer, "润色：{text}", max_len=2)
    assert got.columns == texts.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, spark.createDataFrame([(1, "一。x二", 5), (1, "三。x四x", 6), (2, None, 7), (3, "", 8), (None, "五x", 9)], texts.schema).collect()))
