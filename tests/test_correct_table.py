"""A table corrected from end to end, with everything read from files."""

from pyspark.sql import functions as F

from textloom.jobs import correct, golden
from textloom.operators import mining, ngrams
from textloom.sources import tables


def test_table_to_tables(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    texts = [(1, "新华社报导了这件事，水份和成份都要核对"), (2, "这个板本，，有k8s"), (3, None), (4, ""), (5, "旧词新词")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(at("texts"))
    spark.createDataFrame([(w, f, t) for w, (f, t) in golden.lexicon().items()], "word string, freq long, tag string").write.parquet(at("lexicon"))
    spark.createDataFrame([("typo", 1, "报导", "报道"), ("user", 1, "新词", "好词"), ("particle", 1, "好得", "好的")], "rule_set string, ord int, wrong string, right string").write.parquet(at("rules"))
    (tmp_path / "terms.txt").write_text("# terms\nK8s 3.0\n")
    (tmp_path / "variants.txt").write_text("水分 水份\n成分 成份\n")
    diffs = spark.createDataFrame([("旧词", "老词", "a", True, 1), ("没有", "有没", "b", False, 1)], "old string, new string, raw string, manual boolean, ts long")
    tables.write_rules(mining.promote_rules(diffs), at("store"))
    segs = spark.createDataFrame([("大树根很长",)] * 5, "seg string")
    tables.write_ngrams(ngrams.train_ngrams(segs, 1), ngrams.train_ngrams(segs, 2), at("model"))
    correct.main([at("texts"), at("out"), *(x for name in ("lexicon", "rules", "store", "model") for x in (f"--{name}", at(name))), "--terms", at("terms.txt"), "--variants", at("variants.txt")])
    fixed = {r.doc_id: r.corrected for r in spark.read.parquet(at("out/corrected")).collect()}
    assert fixed == {1: "新华社报道了这件事，水分和成分都要核对", 2: "这个版本，有K8s", 3: None, 4: "", 5: "老词好词"}
    report = spark.read.parquet(at("out/report"))
    assert report.filter("source is null").first().n == spark.read.parquet(at("out/suggestions")).count() == 8
    assert {r.source for r in report.filter("reason is null and source is not null").collect()} == {"错别字", "异形词", "同音字", "术语", "标点", "用户替换", "自学习"}


def test_text_files_without_suggestions(spark, tmp_path):
    (tmp_path / "t.txt").write_text("abc\n\nxyz\n")
    got = correct.correct_table(spark, str(tmp_path / "t.txt"), str(tmp_path / "out"), correct.stages_from(spark), "text")
    assert got.filter(F.col("n") > 0).count() == 0
    assert sorted(r.corrected for r in spark.read.parquet(str(tmp_path / "out/corrected")).collect()) == ["", "abc", "xyz"]
