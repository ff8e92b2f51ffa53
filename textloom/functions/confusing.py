"""Characters confused with others that sound or look alike, and deprecated spellings: helpers of one string for pandas UDFs.

A confusable character is put to a list of questions, from the most certain to the vaguest; each answers replace, keep or
nothing, and the first answer counts. What sets 在 and 再 apart is a table of patterns of what stands before and after.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from math import log

from textloom.functions import confusion_words as C
from textloom.functions.finding import Finder, Queue
from textloom.functions.rewriting import Rule, replaced
from textloom.functions.segmenting import Segmenter
from textloom.functions.text import CJK

RELIABLE = 50
#: Level 1 replaces from this ratio of word frequencies on, level 2 from this ratio of the neighbourhood's, 2.5 from this
#: difference of log probabilities. Fixed values.
LOCAL_RATIO, NEAR_RATIO, MODEL_DELTA = 10, 1.15, log(1.3)
NEAR, PASSES = 5, 5
#: Characters before a place and from it on that any question looks at.
BEFORE, AFTER = 8, 104
Model = Callable[[str, int, str, str], float | None]

_any = "|".join
_PLACE = f"[{C.PLACE_BEGINNINGS}]"
_LOC = f"[{C.PLACE_CHARACTERS}]"
_ADDING = f"(?:{_any(C.ADDING_VERBS)})"
_MEASURE = f"(?:{_any(C.QUANTITIES)}|[{C.MEASURE_NUMBERS}][{C.MEASURES}])"
_MOTION = f"(?:{_any(C.MOTIONS)})"
_MOTION_NEAR = f"(?!{_LOC})(?:[^{C.PLACE_CHARACTERS}]{{0,2}}|.*地.*){_MOTION}"
_ASPECT = "(?:[了过着]|一下|一遍|一次)"
_tails = lambda words, head: _any(w[1:] for w in words if w[0] == head and len(w) > 1)

#: For 在 and 再: whether to replace it, what has to stand before it and after it, how far the second looks, and what the word
#: after it has to be (``one``: a verb's character; ``word``: a verb of two characters or more that begins there).
ZAI: dict[str, list[tuple[bool, str, str, int, str]]] = {
    "再": [
        (False, "", _ADDING, 99, ""),
        (False, "", f"(?!{_PLACE})[{CJK}]{{2}}了?{_MEASURE}", 99, ""),
        (False, "", _MEASURE, 99, ""),
        (False, "", f"(?!{_PLACE}).{_MEASURE}", 99, "one"),
        (False, "", f"..(?!{_any(C.TIME_FRAMES)}|的时候)", 99, "word"),
        (False, "", f"(?!{_PLACE}).(?:$|[{C.AFTER_ONE_VERB}])", 99, "one"),
        (False, "", f"(?!{_PLACE})[{CJK}](?:[也都]|[{CJK}][也都]|.?不过)", 99, ""),
        (False, "", _MOTION_NEAR, 8, ""),
        (False, "", _tails(C.AGAIN_WORDS, "再"), 99, ""),
        (False, f"[{C.BEFORE_AGAIN}]$", "", 99, ""),
        (True, "", f"[{C.PLACE_SETTLED}]", 99, ""),
        (False, "", f"[{C.AGAIN_VERBS}](?![在这那里上下前后])", 99, ""),
    ],
    "在": [
        (True, "", f"{_ADDING}了?{_MEASURE}", 99, ""),
        (True, "", f"(?!{_LOC}|了).{_MOTION}", 99, ""),
        (True, "", f"(?!{_LOC}).(?!了).{_MOTION}", 99, ""),
        (True, "", _MOTION_NEAR, 8, ""),
        (False, "", f"(?!{_LOC}|了)[{CJK}](?![了过着])", 99, ""),
        (False, "", _tails(C.AT_WORDS, "在"), 99, ""),
        (False, f"(?:{_any(w[:-1] for w in C.AT_WORDS if w.endswith('在'))})$", "", 99, ""),
        (False, "", f"[{C.PLACE_SETTLED}]", 99, ""),
        (True, "", f"[{C.ASPECT_VERBS}]{_ASPECT}", 99, ""),
    ],
}


@lru_cache(maxsize=1)
def _zai() -> dict[str, list[tuple]]:
    return {c: [(verdict, re.compile(before) if before else None, re.compile(after, re.DOTALL) if after else None, far, kind) for verdict, before, after, far, kind in rows] for c, rows in ZAI.items()}


def decide_zai(text: str, i: int, after_tag: str = "", after_word: str = "") -> bool | None:
    """Whether the 在 or 再 at ``i`` should be the other; null if the patterns do not tell. ``after_tag`` is the tag of the word
    at ``i + 1``, ``after_word`` that word if it begins there and is longer than one character."""
    is_kind = {"": True, "one": after_tag == "v", "word": bool(after_word) and after_tag in ("v", "vn")}
    for verdict, before, after, far, kind in _zai()[text[i]]:
        if not is_kind[kind] or (before and not before.search(text[max(0, i - 6) : i])):
            continue
        if kind == "word" and len(after_word) > 2:
            return verdict
        if after is None or after.match(text[i + 1 : i + 1 + far]):
            return verdict
    return None


@lru_cache(maxsize=8)
def _heads(words: tuple[str, ...]) -> frozenset[str]:
    return frozenset(w[0] for w in words)


def proper_nouns(text: str, freq: Callable[[str], int]) -> set[int]:
    """Positions of names: a surname (and given name) before a title; two to four characters before a place's ending, two to
    six before an organisation's; a surname and a given name of one or two characters. Reliable words are no names."""
    found: set[int] = set()
    surname = f"(?:{_any(C.DOUBLE_SURNAMES)}|[{C.SURNAMES}])"
    for m in re.finditer(f"(?<![{CJK}]){surname}(?P<given>[{CJK}]{{0,2}}?)(?={_any(C.TITLES)})", text):
        if m.end() - m.start() <= 3 and (not m["given"] or set(m["given"]) - set(C.NO_GIVEN_NAME)):
            found.update(range(*m.span()))
    for m in re.finditer(f"(?<![{CJK}])[{CJK}]+", text):
        run = m[0]
        for endings, most in ((tuple(C.PLACES), 4), (tuple(C.ORGANISATIONS), 6)):
            heads = _heads(endings)
            for n in range(2, min(most, len(run) - 1) + 1):
                if run[n] not in heads:
                    continue
                after = [x for x in endings if run.startswith(x, n)]
                if freq(run[:n]) < RELIABLE and any(freq(run[:n] + x) < RELIABLE for x in after):
                    found.update(range(m.start(), m.start() + n))
    skip = 0
    for m in re.finditer(f"(?={surname})", text):
        if m.start() < skip:
            continue
        size = 2 if text[m.start() : m.start() + 2] in C.DOUBLE_SURNAMES else 1
        skip = m.start() + size
        for n in (2, 1):
            given, name = text[skip : skip + n], text[m.start() : skip + n]
            plain = len(given) == n and re.fullmatch(f"[{CJK}]+", given) and not set(given) & set(C.NO_GIVEN_NAME)
            if not plain or (text[m.start()] == "周" and set(given) <= set(C.WEEKDAYS)):
                continue
            if max(freq(name), freq(name[:-1]) if n == 2 else 0) < RELIABLE:
                found.update(range(m.start(), skip + n))
                break
    return found


class Confusions:
    """Corrects the confusable characters of a text. ``lexicon`` maps words to frequency and tag; ``model`` gives, for a text,
    a place, the character there and a candidate, the difference of log probabilities, or null without evidence."""

    def __init__(self, lexicon: dict[str, tuple[int, str]], model: Model | None = None, cutter: Segmenter | None = None) -> None:
        self.words, self.model, self.cutter = lexicon, model, cutter or Segmenter(lexicon)
        self.candidates: dict[str, list[str]] = {}
        for pair in C.CONFUSIONS:
            a, b = pair.split(">")
            self.candidates.setdefault(a, []).append(b)
        self.confusable = self.candidates.keys() - set(C.UNTOUCHED)
        self.forced = dict(x.split(">") for x in C.FORCED)
        self.forced_pattern = re.compile(_any(self.forced))
        self.noted = self.confusable | {w[0] for w in self.forced}
        self.phrases = [tuple(x.split(">")) for x in C.TOKEN_PHRASES]
        self.safe = re.compile(_any({*C.SAFE_WORDS, *C.AGAIN_WORDS, *C.AT_WORDS}))

    def freq(self, word: str) -> int:
        known = self.words.get(word)
        return known[0] if known else 0

    def token_phrases(self, text: str) -> str:
        """Wrong phrases, where the words of the text allow it: as one unknown word, or with the wrong character as a word of
        its own, or at the end of an unknown one, before the rest of the phrase (or an unreliable word that begins with it)."""
        if not any(wrong in text for wrong, _ in self.phrases):
            return text
        tokens, out = self.cutter.cut(text), list(text)
        for wrong, right in self.phrases:
            for (word, _, start, end), (after, *_), (third, *_) in zip(tokens, [*tokens[1:], ("",)], [*tokens[2:], ("",), ("",)], strict=True):
                if word == wrong and not self.freq(word):
                    out[start:end] = right
                elif after == wrong[1:] or (after.startswith(wrong[1:]) and self.freq(after) < RELIABLE):
                    if word == wrong[0] and not (wrong == "在见" and third and third not in C.AFTER_GOODBYE):
                        out[start : start + len(right)] = right
                    elif len(word) > 1 and word.endswith(wrong[0]) and not self.freq(word):
                        out[end - 1 : end - 1 + len(right)] = right
        return "".join(out)

    def _questions(self, text: str, i: int, cand: str, token: tuple[str, str, int]) -> Iterator[bool | None]:
        """``token`` is the word that holds the place when the text was cut: itself, and its start. Answers, most certain first."""
        word, start = token
        freq, orig = self.freq, text[i]
        near = text[max(0, i - NEAR) : i + NEAR + 1]
        k = min(i, NEAR)  # the place in it
        swapped = near[:k] + cand + near[k + 1 :]
        around = [(a, b) for a, b in ((k - 1, k + 1), (k, k + 2), (k - 1, k + 2)) if a >= 0 and b <= len(near)]
        yield False if any(freq(near[a:b]) >= RELIABLE for a, b in around if b - a == 2) else None
        if len(word) > 1:
            yield False if freq(word) >= RELIABLE else None
            yield False if freq(word) and not freq(word[: i - start] + cand + word[i - start + 1 :]) else None
        own, other = (max((freq(t[a:b]) for a, b in around), default=0) for t in (near, swapped))
        yield True if other and other >= (LOCAL_RATIO * own or 1) else False if own and not other else None
        own, other = (sum(freq(w) for w, *_ in self.cutter.cut(t)) for t in (near, swapped))
        yield True if other > own * NEAR_RATIO else False if own > other * NEAR_RATIO else None
        delta = self.model(text, i, orig, cand) if self.model else None
        yield None if delta is None or abs(delta) <= MODEL_DELTA else delta > 0

    def __call__(self, text: str, names: Iterable[tuple[int, int]] = ()) -> str:
        """Texts of one character or without CJK stay. Words and names are those of the text before the passes; ``names`` are
        stretches that someone else found to be names (``name_places`` says which of them count). A pass goes from left to
        right: a forced word is put right where it begins, and its places are settled; another confusable character is put to
        the questions, which see what the pass has changed before it."""
        if len(text) < 2 or not re.search(f"[{CJK}]", text):
            return text
        text = self.token_phrases(text)
        if self.confusable.isdisjoint(text) and not self.forced_pattern.search(text):
            return text
        token_at = [("", 0)] * len(text)
        tag_at = [""] * len(text)
        for word, tag, start, end in self.cutter.cut(text):
            token_at[start:end] = [(word, start)] * (end - start)
            tag_at[start:end] = [tag] * (end - start)
        fixed = proper_nouns(text, self.freq) | name_places(text, names, self.freq)
        chars = list(text)
        spans = [(0, len(chars))]
        for _ in range(PASSES):
            changed: list[tuple[int, int]] = []
            i = 0
            for begin, stop in spans:  # elsewhere nothing that a place looks at has changed since it was put to them
                i = max(i, begin)
                while i < stop:
                    at, i = i, i + 1
                    c = chars[at]
                    if c not in self.noted:
                        continue
                    if size := self._changed(chars, at, c, token_at, tag_at, fixed):
                        changed.append((at, at + size))
                        stop = max(stop, min(at + size + BEFORE, len(chars)))
            if not changed:
                break
            spans = [(max(0, a - AFTER), min(b + BEFORE, len(chars))) for a, b in changed]
        return "".join(chars)

    def _changed(self, chars: list[str], i: int, c: str, token_at: list[tuple[str, int]], tag_at: list[str], fixed: set[int]) -> int:
        """How many characters from ``i`` on were changed."""
        low = max(0, i - BEFORE)
        window, k = "".join(chars[low : i + AFTER]), i - low
        if m := self.forced_pattern.match(window, k):
            chars[i : i + len(m[0])] = self.forced[m[0]]
            fixed.update(range(i, i + len(m[0])))
            return len(m[0])
        if c not in self.confusable or i in fixed or self.safe.search(window[max(0, k - 2) : k + 3]):
            return 0
        for cand in self.candidates[c]:
            verdict = None
            if {c, cand} == {"在", "再"}:
                after, at = token_at[i + 1] if i + 1 < len(chars) else ("", 0)
                verdict = decide_zai(window, k, tag_at[i + 1] if i + 1 < len(chars) else "", after if at == i + 1 and len(after) > 1 else "")
            if verdict is None:
                word, start = token_at[i]
                verdict = next((x for x in self._questions(window, k, cand, (word, start - low)) if x is not None), None)
            if verdict:
                chars[i] = cand
                return 1
        return 0


def name_places(text: str, names: Iterable[tuple[int, int]], freq: Callable[[str], int]) -> set[int]:
    """Places inside the stretches of two to four characters that are no reliable word: others are no names, whoever says so."""
    return {i for a, b in names if a is not None and b is not None and 2 <= b - a <= 4 and freq(text[a:b]) < RELIABLE for i in range(a, b)}


class Variants:
    """Deprecated forms of words as the preferred ones. ``forms`` maps deprecated to preferred, in list order; pairs with an empty
    side are left out."""

    def __init__(self, forms: dict[str, str], lexicon: dict[str, tuple[int, str]], cutter: Segmenter | None = None) -> None:
        self.forms, self.words, self.cutter = {a: b for a, b in forms.items() if a and b}, lexicon, cutter or Segmenter(lexicon)
        self.short = [form for form in self.forms if len(form) == 2]
        self.any_form, self.short_forms = Finder(self.forms), Finder(self.short)

    def freq(self, word: str) -> int:
        known = self.words.get(word)
        return known[0] if known else 0

    def __call__(self, text: str) -> str:
        """Whole words first, but in names, after a surname-like first character, and next to characters with which they are
        something else; then forms of two characters that are no reliable word, wherever they stand, if at their first place
        they do not share a character with a word around."""
        if not self.any_form.any(text):
            return text
        names = proper_nouns(text, self.freq)
        out: list[str] = []
        for word, _, start, end in self.cutter.cut(text):
            stays = (
                word not in self.forms
                or not names.isdisjoint(range(start, end))
                or (len(word) == 2 and word[0] in C.SURNAMES)
                or text[max(start - 1, 0) : start] in [*C.VARIANT_NOT_AFTER.get(word, "")]
                or text[end : end + 1] in [*C.VARIANT_NOT_BEFORE.get(word, "")]
            )
            out.append(word if stays else self.forms[word])
        text = "".join(out)
        queue = Queue(self.short_forms, text)
        while (i := queue.next()) is not None:
            form = self.short[i]
            at = text.find(form)
            if at < 0 or self.freq(form) >= RELIABLE or form[0] in C.SURNAMES:
                continue
            shared = at and self.freq(text[at - 1] + form[0]) > 5 * self.freq(form)
            behind = [text[at + 1 : at + n] for n in (3, 4)]
            if not shared and not any(len(w) == n and self.freq(w) for w, n in zip(behind, (2, 3), strict=True)):
                text, spans = replaced(text, Rule(form, self.forms[form]))
                queue.changed(text, spans)
        return text
