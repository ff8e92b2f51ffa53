"""The pipeline's stages on the smallest tables, each against a plain statement of what it does to its own input."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import DATA
from textloom.llm import language, secrets, simhash, tokens


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {"documents": {r.doc_id: r for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.collect() if name == "packing" else {r.doc_id: r for r in docs.collect()}
    out["run"] = corpus_pipeline.run(spark, DATA).collect()
    return out


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = max(1, min(5, len(words)))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def test_language(spark, stages):
    decide = language.decider(language.fit_dictionaries(spark.read.parquet(f"{DATA}/documents.parquet")))
    assert stages["language"] == {i: r for i, r in stages["documents"].items() if decide(r.text)[2]}


def near_groups(rows, similar=0.8):
    """Every pair that is similar, and each document's group, by comparing all with all."""
    sets = {i: shingles(r.text) for i, r in rows.items()}
    ids, least, pairs = sorted(rows), {i: i for i in rows}, []

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= similar * (len(sets[a]) + len(sets[b]) - both):
                pairs.append((a, b))
                p, q = sorted((root(a), root(b)))
                least[q] = p
    return pairs, {i: root(i) for i in ids}


def test_near_duplicates(stages):
    before, after = stages["language"], stages["near_duplicates"]
    pairs, group = near_groups(before)
    assert all(after[i] == before[i] for i in after)
    assert all(group[i] != i for i in before if i not in after)  # only documents with a near copy of less id go
    left = [p for p in pairs if p[0] in after and p[1] in after]
    assert pairs and len(left) <= 0.05 * len(pairs)
    assert {before[i].text for i in before} >= {r.text for r in after.values()} and len({r.text for r in after.values()}) == len(after)


def test_passages(stages):
    before, after = stages["near_duplicates"], stages["passages"]
    seen, repeated, shared = Counter(), 0, 0
    for i in sorted(before):
        words = (before[i].text or "").lower().split()
        runs = {tuple(words[k : k + 50]) for k in range(len(words) - 49)}
        shared += sum(seen[x] > 0 for x in runs)
        seen.update(runs)
    seen.clear()
    for i in sorted(after):
        words = (after[i].text or "").lower().split()
        runs = {tuple(words[k : k + 50]) for k in range(len(words) - 49)}
        repeated += sum(seen[x] > 0 for x in runs)
        seen.update(runs)
        it = iter((before[i].text or "").split())
        assert all(w in it for w in (after[i].text or "").split())  # words go, none comes
        assert after[i].n_chars == len(after[i].text)
    assert shared and repeated <= 0.01 * shared


def test_secrets(stages):
    cost = secrets.cost_model(tokens.tokenizer_path())
    for i, r in stages["passages"].items():
        text, covered = r.text, [False] * len(r.text)
        for _, a, b in secrets.find_spans(text, cost):
            covered[a:b] = [True] * (b - a)
        want = re.sub("\ue000+", "[SECRET]", "".join("\ue000" if x else c for c, x in zip(text, covered, strict=True)))
        assert stages["secrets"][i].text == want and stages["secrets"][i].n_chars == len(want)


def test_packing(stages):
    t = Tokenizer.from_file(tokens.tokenizer_path())
    want = {i: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for i, r in stages["secrets"].items()}
    got = {}
    for r in sorted(stages["packing"], key=lambda r: (r.doc_id, r.start)):
        assert r.length == len(r.ids) and r.length & (r.length - 1) == 0 and r.start == len(got.get(r.doc_id, []))
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == want
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(stages["run"]) == key(stages["packing"])


def test_near_copies_of_odd_rows(spark):
    rows = [(5, None), (3, ""), (4, " \n"), (None, "a b"), (None, "a b"), (7, "a b"), (6, "A  b"), (9, "one"), (9, "two"), (8, "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS th", "'y' AS kept_id")
    got = simhash.drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(map(repr, got.select("doc_id", "text").collect())) == sorted(repr(r) for r in spark.createDataFrame([(3, ""), (None, "a b"), (None, "a b"), (6, "A  b"), (8, "two"), (9, "one")], "doc_id long, text string").collect())
    assert simhash.drop_near_copies(docs.filter("false")).count() == 0


def test_large_group_of_near_copies(spark):
    """A group of near copies, each with another edit, is linked in proportion to its size, and one stays."""
    base = [f"w{i}" for i in range(300)]
    made = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(280)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert [r.doc_id for r in simhash.drop_near_copies(docs).collect()] == [0]


def test_near_copies_that_share_ids(spark):
    """Rows are told by id and text: a text that shares its id with a near copy of another stays."""
    base = [f"w{i}" for i in range(100)]
    edited = " ".join([*base[:-1], "x"])
    far = " ".join(f"v{i}" for i in range(100))
    rows = [(1, " ".join(base)), (2, edited), (2, far), (3, far), (4, edited), (1, "something else"), (5, "one"), (5, "two"), (6, "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, simhash.drop_near_copies(docs).collect()))
    assert got == sorted([(1, " ".join(base)), (2, far), (1, "something else"), (5, "one"), (5, "two")])


def test_near_copies_hidden_by_least_documents(spark):
    """Copies whose segments all have unrelated texts of less id as owners: one-word texts share every segment."""
    docs = spark.createDataFrame([(1, "apple"), (2, "pear"), (3, "Pear"), (4, "plum"), (5, " pear ")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == [1, 2, 4]


def test_near_copies_of_few_word_pairs_by_brute_force(spark):
    """Texts of two words have near segments though their shingles differ, so most links are hidden."""
    rng = random.Random(3)
    rows = {i: " ".join(rng.choice("ab") for _ in range(rng.randrange(8, 20))) for i in range(60)}
    rows |= {60 + i: f"{rows[i]} {rows[i][:1]}" for i in range(0, 60, 3)}
    pairs, group = near_groups({i: Row(text=x) for i, x in rows.items()})
    segments = dict(zip(rows, simhash.wide_fingerprints([x.encode() for x in rows.values()]).tolist(), strict=True))
    near = [p for p in pairs if any((x ^ y).bit_count() <= 1 for x, y in zip(segments[p[0]], segments[p[1]], strict=True))]
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    assert kept >= {i for i in rows if group[i] == i}
    assert near and not [p for p in near if set(p) <= kept]
