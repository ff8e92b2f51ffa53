"""Verdicts on 的, 地 and 得 from words and tags, as an ordered table of patterns over tagged clauses.

A clause is written as one string: before each word a START, after it a SLASH and its tag, and a ``-`` behind the tag of a
rare word. Only this spelling is searched, never put back into a text; words and tags that hold such marks lose them in it. A
rule is some particles, what stands right before and right after them (patterns of such tokens), and a verdict. The first rule
that fits a particle decides it; verdicts do not change what other particles see. The rules are compiled once for each worker
and are tried at particles alone, each on the few words that a rule can span, so the time follows the clause's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import accumulate

from textloom.functions import particle_words as P
from textloom.functions.text import CJK, EMOTIONS, PRE_FIXES

START, SLASH = "\ue010", "\ue011"
PARTICLES = "的地得"
#: A word of a frequency below it is rare: at the end of a clause such a noun is a mistagged complement.
RARE = 300
# The tags of each class.
VERB = "v vg vd vn vq vx".split()
STRICT = "v vg vd vq vx".split()
ADJECTIVE = "a ag ad an al b z".split()
ADVERB = "d dg i".split()
NOUN = "n nr ns nt nz".split()
NOMINAL = [*NOUN, "r", "m", "q"]
STRUCTURAL = ["uj", "uv", "ud"]
# Other words of the rules.
KEPT_BEFORE = "确 话 时候 的 是".split()
COPULAS = "是 乃 即 即为 便是 就是 也就是 等于 属于 属 称为".split()
ASPECTS = "了 着 过".split()
GOING_ON = [*ASPECTS, "起来", "下去"]
SINGLE_VERBS = "写 看 想 做 走 跑 去 来 说 听 学 玩 干 吃 睡 等 找 问 给 买 换 查 改 发 收 读 帮 借 还 送 拿 试 用 搞 聊 修 调 测 编 译 推 拉 开 关 放".split()
INSIDE = "中 里 内".split()

_ATTRIBUTES = [*P.ADJECTIVES_TAGGED_NOUN, *P.ATTRIBUTES]
_STRICT_OBJECT_VERBS = [w for w in P.OBJECT_VERBS if w not in P.PHRASE_VERBS]


_OWN_TAGS = dict(zip(PARTICLES, STRUCTURAL, strict=True))
_NO_MARKS = str.maketrans({START: "\ufffd", SLASH: "\ufffd", "-": "\ufffd"})
#: Words before a particle that a rule can span; more than the longest pattern has.
REACH = 14
_ANY = f"[^{START}{SLASH}]"
_TAG = f"[^{START}{SLASH}-]*"
_END = f"(?={START}|\\Z)"


@lru_cache(maxsize=50_000)
def encoded(word: str, tag: str, freq: int) -> str:
    """One token. Particles have tags of their own, whatever the lexicon says."""
    return f"{START}{word.translate(_NO_MARKS)}{SLASH}{_OWN_TAGS.get(word, tag).translate(_NO_MARKS)}{'-' if freq < RARE else ''}"


def token(words: Iterable[str] | None = None, tags: Iterable[str] | None = None, without: Iterable[str] = (), rare: str = "-?") -> str:
    """A token pattern: one of ``words``, with one of ``tags``, not one of ``without``."""
    some = lambda xs: "(?:" + "|".join(sorted(xs, key=lambda x: (-len(x), x))) + ")"
    bar = f"(?!{some(without)}{SLASH})" if without else ""
    word = some(words) if words is not None else f"{_ANY}+"
    return f"{START}{bar}{word}{SLASH}{some(tags) if tags is not None else _TAG}{rare}{_END}"


def either(*patterns: str) -> str:
    return "(?:" + "|".join(patterns) + ")"


def rule(particles: str, before: str, after: str, verdict: str | None) -> tuple[str, str, str, str | None]:
    """``before`` ends right before the particle, ``after`` begins right after it; verdict None keeps the particle."""
    return particles, before, after, verdict


def _rules() -> list[tuple[str, str, str, str | None]]:
    end = r"\Z"
    content = token(tags=[*NOMINAL, *VERB, *ADJECTIVE, *ADVERB])
    no_content = f"(?!{content})"
    only_marks = f"(?:{START}[^{START}{SLASH}{CJK}]+{SLASH}{_TAG}-?)*\\Z"
    predicate = f"(?:{token(tags=['o', *STRUCTURAL, *NOMINAL])}){{0,3}}{token(tags=[x for x in [*VERB, *ADJECTIVE, *ADVERB] if x != 'b'])}"
    rare_end = f"{token(rare='-')}{only_marks}"
    adverb = token(tags=ADVERB)
    passed = either(adverb, token(ASPECTS))
    verb = token(tags=VERB, without=P.EMBEDDED_DE)
    acting = token(tags=VERB, without=[*P.EMBEDDED_DE, *P.ADVERBIALS])
    stative = token(tags=[*ADJECTIVE, "vn", "an"], without=[*P.EMBEDDED_DE, *EMOTIONS])
    modifier = token(tags=[*ADJECTIVE, *ADVERB, "l"])
    adverbial = token(P.ADVERBIALS)
    manner = either(adverbial, token(tags=[*ADJECTIVE, *ADVERB]))
    any_modifier = either(adverbial, modifier)
    bare = f"^(?:{either(adverb, token([*P.DEGREE_ADVERBS, *P.NEGATED_DEGREES]), token(tags=STRUCTURAL))}){{0,6}}"  # no subject
    # What makes the word after the particle a noun: a determiner, a verb with a measure, a preposition or an object verb to the
    # left of the modifier.
    measure = either(token(tags=["m"]), f"{START}{_ANY}*(?:一遍|一下|一次|一番|一回|一场){SLASH}{_TAG}-?{_END}")
    of_noun = [
        f"{token(P.DETERMINERS)}(?:{adverb}){{0,3}}",
        f"{either(token(tags=STRICT), token(P.VERB_MEASURES))}(?:{token(ASPECTS)}){{0,2}}{measure}(?:{either(passed, measure)}){{0,4}}",
        f"{token(P.OBJECT_PREPOSITIONS)}(?:{passed}){{0,3}}",
    ]
    gerund = token(P.GERUNDS)
    acted = token([w for w in P.GERUNDS if w not in P.NOUNS_TAGGED_VERB], [*STRICT, "vn"])
    # What makes it a verb: an object or an aspect behind it, or a pronoun as subject.
    object_ = either(token([*P.OBJECT_STARTERS, *GOING_ON]), token(tags=NOMINAL))
    neutral = f"(?!{either(object_, token([*P.DEGREE_ADVERBS, *PARTICLES]), token(tags=STRICT))}){token()}"
    verbal_after = f"{gerund}(?:{neutral})?{object_}"
    of_pronoun = token(P.PRONOUNS)
    of_verb = [("", verbal_after), (of_pronoun, f"{gerund}{end}")]
    attribute = token(_ATTRIBUTES)
    plain = [x for x in [*ADJECTIVE, *ADVERB, "l"] if x not in ("b", "z")]
    loose = f"(?={token(tags=plain, without=P.BARE_ADJECTIVES)})"
    of_both = f"{loose}{either(attribute, token(tags=['l', 'i']))}"
    action = either(
        token(tags=STRICT, without=P.NOUNS_TAGGED_VERB),
        token(P.ACTIONS_TAGGED_NOUN),
        token([w for w in P.GERUNDS if w not in P.NOUNS_TAGGED_VERB], ["vn"]),
        f"{token(list('为给向对跟'))}(?:{token(tags=NOMINAL)}){{0,2}}{token(tags=[*STRICT, 'vn'])}",
    )
    idiom = token(tags=["l", "i"])
    denied = f"{token(['不', '没', '没有'])}{token(tags=ADJECTIVE)}"
    nominal_verb = token([*P.GERUNDS, *P.TECHNICAL_VERBS])
    tried = [("", action), (either(adverbial, token(tags=ADJECTIVE)), idiom), (adverbial, denied)]  # 的 before what may be an action

    out = [
        rule("的", "", START + either(*KEPT_BEFORE), None),
        rule("得", stative, end, "的"),
        rule(PARTICLES, "", end, None),
        rule(PARTICLES, "^", "", None),
        rule(PARTICLES, token(tags=VERB), token(P.INNER_FEELINGS) + token(INSIDE), "的"),
        rule(PARTICLES, token(tags=STRICT), token(COPULAS), "的"),
        rule("得", stative, token(tags=["y"]), "的"),
    ]
    # 得 before a bare noun is 的, unless the noun begins or is a complement.
    before_noun = token(tags=[*ADJECTIVE, *NOUN, *VERB], without=[*P.EMBEDDED_DE, "长"])
    noun = token(tags=[*NOMINAL, "vn", "an"])
    for guard in (predicate, rare_end, token([*P.BODY_SUBJECTS, *P.COMPLEMENTS, *P.DEGREE_COMPLEMENTS])):
        out.append(rule("得", before_noun, f"(?={noun}){guard}", None))
    out.append(rule("得", before_noun, noun, "的"))
    # A verb before a noun is its attribute, unless the noun is or begins a complement.
    no_attribute = either(predicate, rare_end, token([*P.COMPLEMENTS]) + no_content, f"{START}{_ANY}{{4,}}{SLASH}", f"{START}{_ANY}不{_ANY}")
    plain_noun = token(tags=[*NOMINAL, "b"], without=[*P.ACTIONS_TAGGED_NOUN, *P.DEGREE_COMPLEMENTS, "这么", "那么", "多么"])
    out += [
        rule(PARTICLES, verb, f"(?!{no_attribute}){plain_noun}", "的"),
        rule("得", token(tags=ADJECTIVE), token(tags=ADJECTIVE) + token(["的"]), "的"),
        rule("的地", verb, token(["比", *P.DEGREE_ADVERBS]), "得"),
        rule("的", token(tags=STRICT), f"{token(tags=ADJECTIVE)}{token(['的'])}{end}", None),
        rule("的地", acting, either(token(tags=ADJECTIVE), token(P.COMPLEMENTS)), "得"),
        rule("的地", acting, f"(?:{either(adverb, token(P.NEGATED_DEGREES))}){{0,3}}{either(token(tags=ADJECTIVE), token(P.ADVERBED_COMPLEMENTS))}", "得"),
        rule("的", acting, f"{adverb}(?:{token(tags=['x'])}|{end})", "得"),
        rule("的地", token(tags=[*VERB, *ADJECTIVE], without=P.EMBEDDED_DE), token(P.DEGREE_COMPLEMENTS) + no_content, "得"),
        rule("的", acting, token(["比较", "较"]) + token(P.DEGREE_SINGLES), "得"),
        rule("的", token(without=P.EMBEDDED_DE), token(["很"]) + no_content, "得"),
        rule("的", acting, idiom, "得"),
    ]
    # 的 between a modifier and an action is 地, unless the action is a noun.
    object_verbs = f"{token(P.OBJECT_VERBS)}(?:{passed}){{0,3}}"
    for left in (*of_noun, object_verbs):
        out.append(rule("的", left + any_modifier, "", None))
    out += [
        rule("的", any_modifier, f"{gerund}{token(P.ABSTRACT_HEADS, NOUN)}", None),
        rule("的", bare + any_modifier, token(P.TECHNICAL_VERBS) + only_marks, None),
        rule("的", bare + f"(?={adverbial}){attribute}", f"{nominal_verb}(?!{either(token(tags=NOMINAL), token(P.DETERMINERS))})", None),
    ]
    out += [rule("的", f"(?={adverbial}){left}" if left else adverbial, after, "地") for left, after in tried]
    out += [rule("的", left + of_both, f"(?={acted}){after}", "地") for left, after in of_verb]
    out += [
        rule("的", of_both, gerund, None),
        *(rule("的", loose + (left or token()), after, "地") for left, after in tried[:2]),
        rule("的", "", "", None),
    ]
    # 地 before a noun phrase is 的.
    out.append(rule("地", manner, f"{START}{_ANY}*{either(*P.VERB_MEASURES)}{SLASH}", None))
    out += [rule("地", left + manner, after, None) for left, after in of_verb]
    out.append(rule("地", manner, token(tags=NOUN, without=[*P.VERB_LIKE_NOUNS, *P.ACTIONS_TAGGED_NOUN]), "的"))
    for left in (*of_noun, f"{token(_STRICT_OBJECT_VERBS)}(?:{passed}){{0,3}}"):
        out.append(rule("地", left + manner, token(), "的"))
    owner = token(tags=["r", *NOUN], without=[*P.ADVERBIALS, "土"])
    out += [
        rule("地", token(P.ADJECTIVES_TAGGED_NOUN, ["n"]), "", None),
        rule("地", owner, either(noun, token(tags=STRICT) + token(P.ABSTRACT_HEADS, [*NOMINAL, "vn", "an"]), token(P.NOUNS_AFTER_PRONOUN, STRICT)), "的"),
        rule("地", owner, either(token(SINGLE_VERBS, STRICT), token(tags=[*ADJECTIVE, *ADVERB])), None),
        rule("地", owner, f"(?!{token(tags=STRICT)}){START}", "的"),
        rule("地", token(P.PRONOUNS, ["r", *NOUN]), "", "的"),
    ]
    return out


@lru_cache(maxsize=1)
def _compiled() -> list[tuple[str, re.Pattern | None, re.Pattern | None, str | None]]:
    return [(own, re.compile(f"(?:{before})\\Z") if before else None, re.compile(after) if after else None, verdict) for own, before, after, verdict in _rules()]


def decide(tokens: list[tuple[str, str, int]]) -> str:
    """The text of a clause, ``word, tag, freq`` of its tokens, with its particles decided; clauses of fewer than three tokens
    as they are."""
    words = [w for w, _, _ in tokens]
    if len(words) < 3 or {*PARTICLES}.isdisjoint(words):
        return "".join(words)
    parts = [encoded(*t) for t in tokens]
    clause, at = "".join(parts), [0, *accumulate(map(len, parts))]
    for i, word in enumerate(list(words)):
        if word not in _OWN_TAGS:
            continue
        low = at[max(0, i - REACH)]  # a pattern's ^ is the clause's begin alone
        for own, before, after, verdict in _compiled():
            if word in own and (after is None or after.match(clause, at[i + 1])) and (before is None or before.search(clause, low, at[i])):
                words[i] = verdict or word
                break
    return "".join(words)


_PRE_FIXES = [(re.compile(pattern), to.replace("$", "\\")) for pattern, to in PRE_FIXES]


def pre_fix(text: str) -> str:
    """What ``pre_fix_de`` does to a column, for one string."""
    for pattern, to in _PRE_FIXES:
        text = pattern.sub(to, text)
    return text
