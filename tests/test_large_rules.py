"""Rules, differences and particle decisions at lengths and numbers at which a plain loop would not end."""

import pickle
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.functions import differences as D
from textloom.functions import particles
from textloom.functions import rewriting as R
from textloom.functions.finding import Finder, Queue

SIDES = st.text("abc", max_size=3)
RULES = st.lists(st.builds(R.Rule, SIDES, st.text("abc", max_size=4), st.lists(st.tuples(st.text("ab", max_size=1), st.text("ab", max_size=1)), max_size=2).map(tuple)), max_size=10)


@given(st.text("abc", max_size=25), RULES)
@settings(max_examples=600, deadline=None)
def test_rewriter_is_rewrite(text, rules):
    assert R.Rewriter(rules)(text) == R.rewrite(text, rules)


def test_feeding_and_order():
    assert R.Rewriter([R.Rule("b", "c"), R.Rule("a", "b"), R.Rule("b", "d")])("ab") == "dc"
    assert R.Rewriter([])("ab") == "ab" and R.Rewriter([R.Rule("", "x"), R.Rule("x", "")])("xx") == "xx"


def test_very_many_rules():
    rng = random.Random(1)
    signs = [chr(0x4E00 + i) for i in range(3000)]
    rules = [R.Rule("".join(rng.choices(signs, k=rng.randint(2, 4))), "".join(rng.choices(signs, k=2))) for _ in range(200_000)]
    fix = pickle.loads(pickle.dumps(R.Rewriter(rules)))
    texts = ["".join(rng.choices(signs, k=2400)) + "".join(rng.choice(rules).wrong for _ in range(25)) for _ in range(20)]
    start = time.process_time()
    done = [fix(t) for t in texts]
    assert (time.process_time() - start) / len(texts) < 0.02
    assert done[:2] == [R.rewrite(t, rules) for t in texts[:2]]


def test_finder():
    found = Finder(["ab", "b", "", "abc", "b"])
    assert found.found("xabx") == {0, 1, 4} and found.found("") == set() and not Finder([]).any("abc")
    assert sorted(found.hits("abc")) == [(2, (0,)), (2, (1, 4)), (3, (3,))]
    queue = Queue(Finder(["q", "a", "b"]), "a")
    assert queue.next() == 1
    queue.changed("qb", [(0, 2)])
    assert queue.next() == 2 and queue.next() is None  # q comes too late


def applied(before, changes, after):
    out, at = [], 0
    for a, b, c, d in changes:
        assert at <= a <= b
        out += [before[at:a], after[c:d]]
        at = b
    return "".join([*out, before[at:]])


@given(st.text("ab。 ", max_size=60), st.text("ab。 ", max_size=60), st.sampled_from([0, 20, 250_000]))
@settings(max_examples=600, deadline=None)
def test_changes_give_the_text(before, after, small):
    kept, D.SMALL = D.SMALL, small
    try:
        assert applied(before, D.changes(before, after), after) == after
    finally:
        D.SMALL = kept


@given(st.text("ab", max_size=25), st.text("ab", max_size=25))
@settings(max_examples=300, deadline=None)
def test_few_edits_are_the_fewest(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
        row = new
    blocks = D._few_edits(a, b)
    assert all(a[x : x + n] == b[y : y + n] for x, y, n in blocks)
    assert len(a) + len(b) - 2 * sum(n for *_, n in blocks) == row[-1]


def test_long_clauses_are_compared_in_linear_time():
    rng = random.Random(2)
    for before in ("".join(rng.choices("abcdefghijklmnopqrst", k=100_000)), "ab" * 50_000, "，".join(rng.choices(["aa", "bb", "cc"], k=33_000))):
        after = list(before)
        for _ in range(200):
            after[rng.randrange(len(after))] = rng.choice("xyab")
        after = "".join(after)
        start = time.process_time()
        found = D.changes(before, after)
        assert time.process_time() - start < 3 and applied(before, found, after) == after and len(found) > 50
    assert D.changes("a" * 50_000, "b" * 60_000) == [(0, 50_000, 0, 60_000)]


def clause(n):
    return [("他", "r", 9999), ("跑", "v", 9999), ("的", "uj", 9999), ("很", "d", 9999), ("快", "a", 9999)] * n


def test_particles_in_linear_time():
    particles.decide(clause(10))
    times = []
    for n in (1000, 4000):
        start = time.process_time()
        assert particles.decide(clause(n)) == "他跑得很快" * n
        times.append(time.process_time() - start)
    assert times[1] < 8 * max(times[0], 0.01)


def test_particles_of_any_word_and_tag():
    """No length of a word and no form of a tag hides a word from the rules; marks of the inner spelling mean nothing in a text."""
    after = [("的", "uj", 999), ("很", "d", 999), ("快", "a", 999)]
    for word in ("跑", "跑" * 60, "跑", "跑/", "跑-"):
        assert particles.decide([(word, "v", 999), *after]) == word + "得很快"
    for tag in ("Vg", "v-n", "unknown-tag", "", ""):
        assert particles.decide([("跑", tag, 999), *after]) in ("跑的很快", "跑得很快")
    assert particles.decide([("跑", "v", 999), ("的", "uj", 999), ("xv", "x", 9), ("快", "a", 999)]).replace("得", "的") == "跑的xv快"
    # Tags are compared whole: vn is no strict verb, though it begins like one.
    assert particles.token(tags=["v"]) != particles.token(tags=["vn"])


def test_numerals_with_marks_in_the_text():
    for text, want in {"3": "3", "0一个二十": "0一个20", "99999三": "999993"}.items():
        assert R.normalize_numerals(text) == want
