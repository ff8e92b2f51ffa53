"""The rule store with several writers, the corpus cap over any order, and term restoration by remainders."""

import random
from threading import Thread

from pyspark.sql import functions as F

from textloom.functions.rewriting import Terms, distance
from textloom.operators import lexicon, mining, ngrams
from textloom.sources import tables

DIFF = "old string, new string, raw string, manual boolean, ts long"


def test_two_writers_lose_nothing(spark, tmp_path):
    store = str(tmp_path / "store")

    def write(own):
        for i in range(4):
            diffs = spark.createDataFrame([(f"{own}{i}", "n", "r", True, i)], DIFF)
            tables.update_rules(spark, store, lambda held, diffs=diffs: mining.promote_rules(diffs, held), f"{own}-{i}")

    writers = [Thread(target=write, args=(name,)) for name in "ab"]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert {r.old for r in tables.read_rules(spark, store).collect()} == {f"{x}{i}" for x in "ab" for i in range(4)}
    assert tables.has_batch(spark, store, "a-3") and tables.has_batch(spark, store, "b-0") and not tables.has_batch(spark, store, "b")


def test_a_taken_number_is_taken(spark, tmp_path):
    store = str(tmp_path / "store")
    rules = spark.createDataFrame([("o", "n", 1, True, 1, [], None)], tables.RULES_SCHEMA)
    assert tables.write_rules(rules, store) == 0
    assert not tables._published(spark, store, 0, "x", "") and tables.read_rules(spark, store).count() == 1
    calls = []

    def late(held):
        if not calls:  # another writer comes first
            tables.write_rules(rules.withColumn("old", F.lit("p")), store)
        calls.append(1)
        return held.unionByName(rules.withColumn("old", F.lit("q")))

    assert tables.update_rules(spark, store, late) == 2 and len(calls) == 2
    assert {r.old for r in tables.read_rules(spark, store).collect()} == {"p", "q"}


def test_old_versions_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "KEPT_VERSIONS", 3)
    store = str(tmp_path / "store")
    for i in range(6):
        tables.write_rules(spark.createDataFrame([(f"o{i}", "n", 1, True, 1, [], None)], tables.RULES_SCHEMA), store)
    assert tables._versions(spark, store) == [3, 4, 5]
    assert [x.name.rsplit(".", 1)[-1] for x in (tmp_path / "store" / "data").iterdir() if x.is_dir()].__len__() == 3
    assert tables.read_rules(spark, store).first().old == "o5"


def capped(pages, most):
    """Pages of equal place come together; without a place last."""
    total, kept = 0, set()
    for place in sorted({p for p, _ in pages if p is not None}):
        if total >= most:
            return kept
        kept.add(place)
        total += sum(len(t) for p, t in pages if p == place)
    return kept | {p for p, _ in pages if p is None and total < most}


def test_cap_over_any_order(spark):
    rng = random.Random(1)
    sparse = [(rng.randrange(1 << 60), "字" * rng.randint(2, 30)) for _ in range(400)]
    ties = [(rng.randrange(20), "字" * rng.randint(2, 9)) for _ in range(200)] + [(None, "字字字")]
    words = [(rng.choice("abcdef") * rng.randint(1, 3), "字" * 5) for _ in range(60)]
    for pages, kind in ((sparse, "long"), (ties, "long"), (words, "string")):
        df = spark.createDataFrame(pages, f"page {kind}, text string").repartition(4)
        for most in (0, 1, 50, 700, 10**9):
            assert {r.page for r in ngrams.cap_corpus(df, most).collect()} == (capped(pages, most) if most else set()), most
    assert ngrams.cap_corpus(df.filter("false"), 5).count() == 0


def test_terms_by_remainders(spark):
    rng = random.Random(2)

    def word(n):
        return rng.choice("kq") + "".join(rng.choices("abc8", k=n - 1))

    terms = [(i, word(rng.randint(2, 8)), rng.choice([2.0, 5.0])) for i in range(60)]
    said = sorted({word(rng.randint(1, 9)) for _ in range(300)} | {w.upper() for _, w, _ in terms[:5]} | {"k" + "a" * 31, "k"})
    texts = spark.createDataFrame([(i, f"，{w}，") for i, w in enumerate(said)], "doc_id long, text string")
    got = {r.candidate: r.term for r in lexicon.restore_terms(texts, spark.createDataFrame(terms, "ord int, word string, score double")).collect()}
    fix = Terms([(w, s) for _, w, s in terms])
    assert {w: got.get(w, w) for w in said} == {w: fix.restored(w) for w in said}
    assert sum(w != got.get(w, w) for w in said) > 20 and distance("kab", "kb") == 1


def test_evidence_goes_on_after_promotion(spark):
    """Exact up to the promotion, then within a few per cent, whatever the number of merges; the sketch stays small."""
    store = None
    for k in range(6):
        events = spark.range(k * 3000, k * 3000 + 4000).select(F.lit("在见").alias("old"), F.lit("再见").alias("new"), F.col("id").cast("string").alias("raw"), F.lit(False).alias("manual"), F.col("id").alias("ts"))
        few = spark.createDataFrame([("了草", "潦草", f"s{k // 3}", False, k)], DIFF)
        store = tables.settled(mining.promote_rules(events.unionByName(few), store))
    got = {r.old: r for r in store.collect()}
    assert abs(got["在见"].n_sentences - 19_000) < 0.06 * 19_000 and got["在见"].promoted and got["在见"].raws == [] and len(got["在见"].sketch) < 5000
    assert got["了草"].n_sentences == 2 and got["了草"].promoted


def test_stream_with_state(spark, tmp_path):
    """Rules come out once, in the batch that completes their evidence; repeats and late rows count once."""
    from textloom.streaming import jobs

    rows = [("在见", "再见", "a", False, 100), ("在见", "再见", "a", False, 160), ("了草", "潦草", "x", False, 100), ("按装", "安装", "z", True, 5), ("在见", "再见", "b", False, 90), ("在见", "再见", "c", False, 200), ("了草", "潦草", "x", False, 250), (None, "n", "r", True, 1)]
    source = str(tmp_path / "in")
    for n, part in enumerate((rows[:4], rows[4:6], rows[6:])):
        spark.createDataFrame(part, DIFF).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(DIFF.replace("ts long", "ts timestamp")).parquet(source)
        jobs.stream_promotions(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        got = {(r.old, r.new) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert got == ({("按装", "安装")} if n == 0 else {("按装", "安装"), ("在见", "再见")})
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
