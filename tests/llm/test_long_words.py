"""Words of any length keep their own identity: ids, token counts, passages and near copies."""

import random
from hashlib import sha256

import numpy as np
import pytest
from tokenizers import Tokenizer

from textloom.llm import bpe, passages, simhash, tokens

LONG = "a" * 4103
WORDS = [LONG + "acx", LONG + "dax", LONG + "xca", "b" * 9000 + "ab", "b" * 9000 + "ba", "abcdefgh", "abcdefg", "abcdefg\x00", "\x00", "\x00\x00", "x" * 64, "x" * 65, "x" * 63 + "y", "y" + "x" * 63]


def test_ids_of_long_words(spark):
    library = Tokenizer.from_file(tokens.tokenizer_path())
    library.no_truncation()
    library.no_padding()
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(WORDS)], "doc_id long, text string").coalesce(1)
    want = [library.encode(w, add_special_tokens=False).ids for w in WORDS]
    for row in tokens.encoding_digests(docs).collect():
        assert row.n_tokens == len(want[row.doc_id]) and row.ids_sha256 == sha256(" ".join(map(str, want[row.doc_id])).encode()).hexdigest()
    packed = {}
    for p in tokens.pack_documents(docs).orderBy("doc_id", "start").collect():
        packed.setdefault(p.doc_id, []).extend(p.ids)
    assert packed == {i: [*ids, tokens.PACK_END] for i, ids in enumerate(want)}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs).collect()} == {i: len(ids) + 1 for i, ids in enumerate(want)}


def test_keys_differ():
    rng = random.Random(1)
    words = list({"".join(rng.choices("ab", k=rng.choice([1, 3, 7, 8, 9, 15, 16, 17, 64, 65, 200]))) for _ in range(20_000)} | set(WORDS))
    body = " ".join(words).encode()
    at, size = passages.words_of(np.frombuffer(body.replace(b"\x00", b"\x01"), np.uint8))
    key = bpe.word_keys(np.frombuffer(body, np.uint8), at, size)
    assert len(set(key.tolist())) == len(words)
    again = bpe.word_keys(np.frombuffer(b"zz " + body + b" tail", np.uint8), at + 3, size)
    assert (again == key).all()


def test_passages_and_copies(spark):
    def text(end):
        return " ".join(f"{LONG}{i}{end}" for i in range(60))

    docs = spark.createDataFrame([(1, text("acx")), (2, text("dax"))], "doc_id long, text string")
    assert passages.near_passages(docs).count() == 0
    assert simhash.near_copies(docs).count() == 0


@pytest.mark.parametrize("most", [3, 10_000])
def test_cache_forgets(monkeypatch, most):
    monkeypatch.setattr(bpe, "CACHE_WORDS", most)
    coder = bpe.Coder(tokens.tokenizer_path(), keep_text=True)
    library = Tokenizer.from_file(tokens.tokenizer_path())
    for _ in range(3):
        for text in ("one two extraordinary things happened yesterday", "extraordinary happenings two", "", "yesterday's " + LONG):
            ids, count = coder.encode([text, text])
            want = library.encode(text, add_special_tokens=False).ids
            assert ids.tolist() == want * 2 and count.tolist() == [len(want)] * 2
