"""The registered queries on the smallest tables against plain statements of what they return."""

import base64
import re
import struct
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import xxhash
import zstandard
from tokenizers import Tokenizer

from tests.conftest import DATA
from textloom.llm import bpe, digest, language, passages, quality, queries, secrets, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def rows(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op1(spark, docs):
    got = rows(spark, "op1_simhash")
    own = {i: fingerprint(t) for i, t in docs.items()}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in own.items()}
    least = {i: i for i in own}
    changed = True
    while changed:
        changed = False
        for a in own:
            for b in own:
                if (own[a] ^ own[b]).bit_count() <= 3 and least[a] < least[b]:
                    least[b], changed = least[a], True
    assert {r.doc_id: r.component_id for r in got} == least


def test_op2(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op2_digests")}
    ids = sorted(docs)
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        k = len(docs[i]) // 2
        new = docs[i][: len(docs[i]) - k] + docs[after][:k]
        r = got[i]
        assert r.n_chars == len(docs[i]) and r.edited_sha256 == sha256(new.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_text = {}
    for i in ids:
        assert by_text.setdefault(docs[i], got[i].fingerprint) == got[i].fingerprint
    long = [got[i] for i in ids if len(docs[i]) > 300]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97


def test_op2_entropy():
    data = np.frombuffer(bytes(np.random.default_rng(3).integers(97, 103, 500, np.uint8)) + b"a" * 80, np.uint8)
    for i, step in enumerate(digest.entropy_steps(data)):
        total = int(digest._NLOGN[np.bincount(data[i : i + digest.WINDOW])].sum())
        assert step == (digest._MOST - total) * digest.STEPS // digest._MOST


def test_op2_by_brute_force(spark, docs):
    """Entropies, ranks, elections, filters and likeness, each from its plain definition, for the shorter texts."""
    bodies = {i: t.encode() for i, t in docs.items()}
    total = Counter()

    def steps(b):
        out = []
        for i in range(len(b) - 31):
            own = sum(int(digest._NLOGN[n]) for n in Counter(b[i : i + 32]).values())
            out.append((digest._MOST - own) * 1000 // digest._MOST)
        return out

    all_steps = {i: steps(b) for i, b in bodies.items()}
    for x in all_steps.values():
        total.update(x)
    rank = {s: k for k, s in enumerate(sorted(range(1001), key=lambda s: (total[s], s)))}

    def filters(b, st):
        votes = Counter()
        for i in range(max(1, len(st) - 23) if st else 0):
            votes[min(range(i, min(i + 24, len(st))), key=lambda k: (rank[st[k]], k))] += 1
        least = min(6, max(1, len(st) - 23))
        found = [p for p in sorted(votes) if (votes[p] >= least or len(st) <= 24) and st[p] > 0]
        codes = list(dict.fromkeys(xxhash.xxh3_64_intdigest(b[p : p + 32]) for p in found)) or ([xxhash.xxh3_64_intdigest(b)] if b else [])
        return [{(c >> 11 * k) & 2047 for c in codes[a : a + 160] for k in range(5)} for a in range(0, len(codes), 160)]

    def like(x, y):
        if x == y:
            return 1.0
        if not x or not y:
            return 0.0
        x, y = sorted((x, y), key=len)
        best = []
        for a in x:
            best.append(max(max(0.0, (len(a & b) - len(a) * len(b) / 2048) / max(min(len(a), len(b)) - len(a) * len(b) / 2048, 1e-9)) for b in y))
        return min(1.0, sum(best) / len(best))

    got = {r.doc_id: r for r in rows(spark, "op2_digests")}
    ids = sorted(docs)
    short = [(i, j) for i, j in zip(ids, ids[1:], strict=False) if len(bodies[i]) < 4000 and len(bodies[j]) < 4000]
    assert len(short) > 50
    for i, j in short:
        k = len(docs[i]) // 2
        new = (docs[i][: len(docs[i]) - k] + docs[j][:k]).encode()
        own, after, changed = filters(bodies[i], all_steps[i]), filters(bodies[j], all_steps[j]), filters(new, steps(new))
        bits = lambda f: [set(np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8))).tolist()) for x in (base64.b64decode(f)[a : a + 256] for a in range(0, len(base64.b64decode(f)), 256))]
        assert bits(got[i].fingerprint) == own and bits(got[i].edited_fingerprint) == changed
        assert abs(got[i].near_next - like(own, after)) < 1e-9 and abs(got[i].near_edited - like(own, changed)) < 1e-9


@pytest.fixture(scope="module")
def encoded(docs):
    t = Tokenizer.from_file(tokens.tokenizer_path())
    return t, {i: t.encode(x, add_special_tokens=False).ids for i, x in docs.items()}


def test_op3(spark, encoded):
    got = rows(spark, "op3_separator_scan")
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(x) + 1 for i, x in encoded[1].items()}
    at = {}
    for r in sorted(got, key=lambda r: (r.shard, r.start)):
        assert r.start == at.get(r.shard, 0)
        at[r.shard] = r.start + r.n_tokens


def test_op4(spark, docs):
    covered = {}
    for r in rows(spark, "op4_passages"):
        own, other = (docs[i].lower().split() for i in (r.doc_id, r.source_id))
        x, y = own[r.start_word : r.end_word], other[r.source_start : r.source_end]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x, y))
        assert len(x) >= 50 and r.source_id < r.doc_id and len(a & b) / len(a | b) >= 0.8
        covered.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    first, total, found = {}, 0, 0
    for i in sorted(docs):
        words = docs[i].encode().lower().split()
        runs = [tuple(words[k : k + 50]) for k in range(len(words) - 49)]
        for k, run in enumerate(runs):
            if first.setdefault(run, i) < i:
                total += 1
                found += any(s <= k and k + 50 <= e for s, e in covered.get(i, ()))
    assert total and found >= 0.99 * total


def test_op5(spark, docs):
    for r in rows(spark, "op5_quality"):
        words = WORD.findall(docs[r.doc_id])
        count = Counter(zip(words, words[1:], words[2:], strict=False))
        repeat = {k for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in docs[r.doc_id].split("\n") if WORD.search(x)]
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words)) and r.n_repeat_words == len(repeat)
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_symbols == len(re.findall(r"[#*$%&|<>]", docs[r.doc_id]))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeat) > 50 * len(words)) and not (r.base_failed and r.kept)


def test_op5_cutoffs_by_sql(spark):
    """With labels enough for cutoffs in every stratum, all rows against SQL that counts them anew."""
    import duckdb
    import pandas as pd

    rng = np.random.default_rng(4)
    rows_ = []
    for i in range(7000):
        words = [f"{'ab' * int(rng.integers(1, 4))}{k}x{i}" for k in range(60)] + ["##|"] * int(rng.choice([0, 0, 1, 9])) + [f"{'w' * 40}{k}" for k in range(int(rng.choice([0, 0, 0, 30])))]
        lines = ["same line here"] * int(rng.choice([0, 0, 3])) + [" ".join(words)]
        rows_.append((i, "\n".join(lines), ["en", "de", "fr"][i % 3]))
    table = pd.DataFrame(rows_, columns=["doc_id", "text", "lang"])
    noisy = table.text.str.contains("##|wwww", regex=False) | table.text.str.contains("wwww")
    labels = pd.DataFrame({"doc_id": table.doc_id, "quality": (~noisy).astype(int), "toxic": 0})
    got = quality.judge(spark.createDataFrame(table), spark.createDataFrame(labels)).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.register("documents", table)
    con.register("labels", labels)
    want = con.execute(queries.ORACLE_SQL["op5_quality"]).df().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all()
    rejected = got[~got.base_failed & ~got.kept].doc_id % 3
    assert set(rejected) == {0, 1, 2} and (~got.base_failed & ~got.kept & ~noisy).mean() < quality.RISK


def test_op6(spark, docs):
    for r in rows(spark, "op6_secrets"):
        text, spans = docs[r.doc_id], []
        for rank, (kind, pattern, flags, fit) in enumerate((
            ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 8),
            ("access", "AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
            ("hex", "[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
        )):
            spans += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text, flags) if fit(m)]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        assert r.base_sha256 == sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_op6_costs_by_brute_force():
    """The cheapest cut of short values among all cuts, and what the limit does to random and to ordinary values."""
    import random
    import string

    cost = secrets.cost_model(tokens.tokenizer_path())
    rng = random.Random(3)
    plain = ["password", "love", "qwe", "aaa", "123", "2019", "abc", "X", "7", "#", "Summer"]
    for _ in range(150):
        value = "".join(rng.choice(plain) for _ in range(3))[:10]
        spans = cost._spans(value, value.lower())

        def cheapest(end, spans=spans, value=value):
            if not end:
                return 0.0
            return min([cheapest(end - 1) + np.log10(cost._letters(value[end - 1])), *(cheapest(a) + c for a, c in spans.get(end, ()))])

        assert abs(cost(value) - cheapest(len(value))) < 1e-9
    letters = string.ascii_letters + string.digits
    random_values = ["".join(rng.choice(letters) for _ in range(rng.randint(12, 20))) for _ in range(300)]
    words = [w for w in cost.ranks if len(w) > 4][:3000]
    ordinary = [rng.choice(words) + rng.choice(["", "1", "12", "2020", "!"]) for _ in range(300)]
    assert np.mean([cost(x) >= secrets.LEAST_GUESSES for x in random_values]) > 0.99
    assert np.mean([cost(x) >= secrets.LEAST_GUESSES for x in ordinary]) < 0.01


def test_op6_costs():
    cost = secrets.cost_model(tokens.tokenizer_path())
    weak = [cost(x) for x in ("password", "qwertyuiop", "12345678", "aaaaaaaaaa", "20240115", "abcabcabc")]
    assert max(weak) < secrets.LEAST_GUESSES < cost("xK9#mQ2$vL7p")
    assert [s[0] for s in secrets.find_spans("credential: xK9#mQ2$vL7p, password is pwd=password", cost)] == ["guess"]


def test_op7(spark, encoded):
    t, ids = encoded
    for r in rows(spark, "op7_bpe"):
        own = ids[r.doc_id]
        assert r.n_tokens == len(own) and r.ids_sha256 == sha256(" ".join(map(str, own)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(t.decode(own, skip_special_tokens=False).encode()).hexdigest()


def test_words_with_nul(encoded):
    """Words that differ only in NULs are encoded apart, in one batch and out of the cache."""
    import random

    rng = random.Random(1)
    texts = ["!", "!\0", "\0", "\0\0", "a", "a\0", "a" * 9, "a" * 9 + "\0", "\0" * 20, "!"]
    texts += ["".join(rng.choice("ab!\0 \0.\u00e9\x1c1") for _ in range(rng.randint(0, 30))) for _ in range(1000)]
    coder = bpe.Coder(tokens.tokenizer_path())
    for part in (texts, texts[::-1]):
        ids, n = coder.encode(part)
        ends = np.cumsum(n)
        assert [ids[a:b].tolist() for a, b in zip(ends - n, ends, strict=True)] == [encoded[0].encode(x, add_special_tokens=False).ids for x in part]


def test_op8(spark, encoded):
    got = rows(spark, "op8_packing")
    ids = {i: [*x, 1] for i, x in encoded[1].items()}
    ends = Counter()
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *piece))
        ends[r.doc_id] += r.length
    assert ends == {i: len(x) for i, x in ids.items()} and len({r.sequence_id for r in got}) == len(got)
    lengths, tokens_of = {}, Counter()
    for r in tokens.pack_documents(spark.read.parquet(f"{DATA}/documents.parquet"), with_ids=False, batch_tokens=4096).collect():
        lengths.setdefault(r.batch_id, set()).add(r.length)
        tokens_of[r.batch_id] += r.length
    assert all(len(x) == 1 for x in lengths.values()) and max(tokens_of.values()) == 4096
    parts = {b >> 38 for b in tokens_of}
    assert sum(n < 4096 for n in tokens_of.values()) <= 12 * len(parts)


def test_op9(spark, docs):
    got = rows(spark, "op9_language")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    # The same dictionaries in a plain loop.
    learned = language.fit_dictionaries(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert sorted(learned) == sorted({lang[i] for i in lang if lang[i] is not None})
    for r in got:
        body = " ".join(re.findall(r"[^\W\d_]+", docs[r.doc_id].lower())).encode()
        if not body:
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0, False)
            continue
        for level in (language.LEVEL, language.SECOND_LEVEL):
            sizes = []
            for k in sorted(learned):
                d = zstandard.ZstdCompressionDict(learned[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                sizes.append((len(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False).compress(body)), k))
            (low, best), (second, _) = sorted(sizes)[:2]
            if second - low >= language.NARROW * second:
                break
        assert (r.lang_pred, r.accepted) == (best, second - low >= language.NARROW * second) and abs(r.score - (second - low) / second) < 1e-12
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.9 and np.mean([r.accepted for r in got]) > 0.97


def test_op10(spark, docs):
    seen = Counter()
    for t in docs.values():
        b = t.encode()
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    for r in rows(spark, "op10_suffixes"):
        b = docs[r.doc_id].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))))
        assert r.kept_sha256 == sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()


def test_op10_large_buckets(spark, monkeypatch):
    from textloom.llm import suffixes

    core = "the shared passage of bytes " * 12
    made = spark.createDataFrame([(i, f"{i} head {core} tail {i * 7919}") for i in range(30)], "doc_id bigint, text string")
    plain = sorted(map(tuple, suffixes.remove_repeats(made).collect()))
    monkeypatch.setattr(suffixes, "BUCKET_KINDS", 3)
    assert sorted(map(tuple, suffixes.remove_repeats(made).collect())) == plain


def test_op4_verification():
    own = np.arange(200, dtype=np.uint64)
    other = own.copy()
    other[100:105] = 1000 + np.arange(5)
    assert passages.verified(own, other, 46) == [(0, 199, 0, 199, 195 / 205)]
    assert passages.verified(own, other[::-1].copy(), 46) == []
