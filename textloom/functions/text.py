"""Text normalisers and predicates as column functions: no Python runs for a row.

All take a column (or its name) and give null for null unless stated otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CJK = "一-鿿"
KEPT = f"{CJK}0-9a-zA-Z，。？！；：、…“”‘’（）《》·—-"
MARKS = "！？。；：、，…"
BLANK = r"[\s　 ]"
FILLERS = "的了啊嗯哦吧呢"
CONNECTIVES = ("然后", "但是", "而且", "虽然", "因为", "所以", "如果", "当")
QUESTION_WORDS = ("什么", "怎么", "为什么", "怎么样", "哪里", "几时", "谁", "哪些", "哪个", "多少")
BA_OBJECTS = "它们|她们|他们|它|她|他|我们|我|你们|你"
TONES = ("āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜ", "aaaaeeeeiiiioooouuuuüüüü")
NUMERALS = ("零一二三四五六七八九", "0123456789")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_simplified(c: Column | str, pairs: tuple[str, str]) -> Column:
    """One-to-one character map; ``pairs`` holds the traditional and the simplified characters in the same order."""
    return F.translate(_col(c), *pairs)


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "<[^>]*>", "")


def keep_charset(c: Column | str) -> Column:
    """Only CJK, ASCII letters and digits, and listed punctuation; line breaks and spaces go. Most characters are told by the
    short class, as the long one takes several times as long; spaces, which are many, go before."""
    return F.regexp_replace(F.replace(_col(c), F.lit(" "), F.lit("")), f"(?![{CJK}a-zA-Z0-9])[^{KEPT}]", "")


def split_sentences(c: Column | str) -> Column:
    """Segments between sentence ends and line breaks, those of one character dropped."""
    return F.filter(F.split(_col(c), f"(?![{CJK}])[。！？；\n]"), lambda s: F.length(s) >= 2)


def is_mixed_language(c: Column | str) -> Column:
    return _col(c).rlike(f"[{CJK}]") & _col(c).rlike("[A-Za-z]{2,}")


def redundancy_warnings(c: Column | str) -> Column:
    """Array of ``start, end, doubled``: the first place of each doubled filler, and a doubled 的 at the end."""
    text = _col(c)
    found = [F.when(F.instr(text, ch * 2) > 0, F.struct((F.instr(text, ch * 2) - 1).alias("start"), (F.instr(text, ch * 2) + 1).alias("end"), F.lit(ch * 2).alias("doubled"))) for ch in FILLERS]
    tail = F.when(F.regexp_replace(text, f"{BLANK}+$", "").endswith("的的"), F.struct((F.length(text) - 2).alias("start"), F.length(text).alias("end"), F.lit("的的").alias("doubled")))
    return F.filter(F.array(*found, tail), lambda w: w.isNotNull())


def collapse_punct(c: Column | str) -> Column:
    """A run of CJK marks, blanks before and between them included, becomes its most important one, or ？！ if it has both.
    Runs are found by one character class, so their length does not matter; each is looked at by itself."""
    text = _col(c)
    run = f"(?<![{BLANK[1:-1]}{MARKS}])[{BLANK[1:-1]}{MARKS}]*[{MARKS}]"
    best = lambda r: F.when(r.contains("！") & r.contains("？"), "？！").otherwise(F.coalesce(*(F.when(r.contains(m), m) for m in MARKS)))
    done = F.zip_with(F.split(text, run), F.regexp_extract_all(text, F.lit(run), F.lit(0)), lambda between, r: F.concat(between, F.coalesce(best(r), F.lit(""))))
    return F.when(text.rlike(f"[{MARKS}]"), F.array_join(done, "")).otherwise(text)


def fix_ba_pattern(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"(把(?:{BA_OBJECTS}))切入", "$1接入")


def space_mixed(c: Column | str) -> Column:
    """A space where CJK characters and runs of Latin letters or digits meet, unless blanks are there. Other marks between
    the two do not matter: the space comes right before the second one."""
    skip = f"([^{CJK}A-Za-z0-9 \\t]*+)"
    text = F.regexp_replace(_col(c), f"([{CJK}]){skip}(?=[A-Za-z0-9])", "$1$2 ")
    return F.regexp_replace(text, f"([A-Za-z0-9]){skip}(?=[{CJK}])", "$1$2 ")


def add_punctuation(c: Column | str) -> Column:
    """Marks are dropped and set anew: a comma after connectives, a question mark after what follows the first listed
    question word that occurs (and after each of its occurrences' stretch), a full stop at the end."""
    text = F.regexp_replace(_col(c), "[，。！？]", "")
    for word in CONNECTIVES:
        text = F.replace(text, F.lit(word), F.lit(word + "，"))
    asked = text
    for word in reversed(QUESTION_WORDS):
        asked = F.when(text.contains(word), F.regexp_replace(text, f"({word})([^？]*)", "$1$2？")).otherwise(asked)
    ended = F.when((F.length(asked) > 0) & ~asked.rlike("[。！？]$"), F.concat(asked, F.lit("。"))).otherwise(asked)
    return F.regexp_replace(ended, "([。！？，]){2,}", "$1")


def apply_by_clause(c: Column | str, fn: Callable[[Column], Column]) -> Column:
    """``fn`` on the text between runs of clause marks and line breaks; the marks stay."""
    parts = F.regexp_extract_all(_col(c), F.lit("([^。！？；，、\n]*)([。！？；，、\n]*)"), F.lit(0))
    text = lambda p: F.regexp_extract(p, "^([^。！？；，、\n]*)", 1)
    mark = lambda p: F.regexp_extract(p, "([。！？；，、\n]*)$", 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(fn(text(p)), mark(p))), "")


def chunk_text(c: Column | str, max_len: int = 1500) -> Column:
    """Array of chunks: the text itself if it is not longer than ``max_len``; else its parts (runs of sentence ends or line
    breaks, and what lies between) packed greedily. A part that is too long stays whole. An empty text is one empty chunk."""
    text = _col(c)
    parts = F.filter(F.regexp_extract_all(text, F.lit("[^。！？\n]+|[。！？\n]+"), F.lit(0)), lambda p: F.length(p) > 0)
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    full = lambda s, p: (F.length(s["cur"]) > 0) & (F.length(s["cur"]) + F.length(p) > max_len)
    step = lambda s, p: F.struct(F.when(full(s, p), F.array_append(s["done"], s["cur"])).otherwise(s["done"]).alias("done"), F.when(full(s, p), p).otherwise(F.concat(s["cur"], p)).alias("cur"))
    packed = F.aggregate(parts, state, step, lambda s: F.when(F.length(s["cur"]) > 0, F.array_append(s["done"], s["cur"])).otherwise(s["done"]))
    return F.when(F.length(text) <= max_len, F.array(text)).otherwise(packed)


def cn_to_int(c: Column | str) -> Column:
    """The value of a CJK numeral from 0 to 99 (十 alone is 10); null for anything else."""
    word = _col(c)
    digit = lambda x: F.when(x.rlike("^[零一二两三四五六七八九]$"), F.translate(x, "零一二两三四五六七八九", "01223456789").try_cast("int"))
    parts = F.split(word, "十")
    tens, ones = F.get(parts, 0), F.get(parts, 1)
    with_ten = F.when(tens == "", 1).otherwise(F.coalesce(digit(tens), F.lit(1))) * 10 + F.when(ones == "", 0).otherwise(F.coalesce(digit(ones), F.lit(0)))
    return F.when(word.contains("十"), with_ten).otherwise(digit(word))


def restore_spoken_digits(c: Column | str) -> Column:
    """Lower case, CJK numerals as digits (十 is 10, 百 is 100), other CJK and spaces dropped."""
    text = F.translate(F.lower(_col(c)), *NUMERALS)
    text = F.replace(F.replace(F.replace(text, F.lit("两"), F.lit("2")), F.lit("十"), F.lit("10")), F.lit("百"), F.lit("100"))
    return F.regexp_replace(text, f"[{CJK} ]", "")


def strip_tone(c: Column | str) -> Column:
    return F.translate(_col(c), *TONES)


def guarded_replace(c: Column | str, wrong: str, right: str, not_after: str = "", not_before: str = "") -> Column:
    """``wrong`` becomes ``right`` but where what stands before or after it matches a pattern."""
    import re

    pattern = (f"(?<!{not_after})" if not_after else "") + re.escape(wrong) + (f"(?!{not_before})" if not_before else "")
    return F.regexp_replace(_col(c), pattern, right.replace("\\", "\\\\").replace("$", "\\$"))


# Fixed values of the particle pre-fixes.
EMOTIONS = """高兴 开心 快乐 愉快 欣喜 欢喜 甜蜜 舒心 畅快 爽快 欣慰 放心 安心 舒畅 喜悦 欢欣 热情 兴奋 激动 生气 伤心 难过 愤怒 恼火 烦恼
苦恼 着急 焦急 担心 害怕 恐惧 惊讶 震惊 失望 沮丧 难受 委屈 冤枉 后悔 懊悔 愧疚 自责 内疚 惭愧 羞愧 尴尬 窘迫 紧张 害羞""".split()
DE_ENDINGS = "值得 觉得 获得 懂得 赢得 显得 使得 免得 省得 记得 认得 晓得 由得 惹得 赖得 取得 舍得 顾得 懒得 亏得 乐得 巴不得 怨不得 怪不得 了不得 了得 得得 自得 怡得 陶得".split()
NEW_CLAUSE = "还有|然后|而且|并且|但是|可是|所以|因此|接着|后来|接下来|此外|再说|其实|不过"
DIRECTIONS = "出来|起来|上来|下来|出去|进去|回来|回去|过来|过去|开来|上去"
DEGREES = "真|很|太|挺|好|更|最|特别|非常|十分|比较|相当|有点|有些"
LOOKS = "高|矮|胖|瘦|壮|结实|漂亮|好看|帅|美|丑|难看|可爱|精神|年轻|老|成熟|白|黑|红润|清秀|魁梧|苗条|丰满|苍老|憔悴|斯文|秀气|洋气|土气|普通|特别|一样|很像|真像|一模一样"


_KEPT_DE = EMOTIONS + [w[:-1] for w in DE_ENDINGS]
#: Patterns and what they become (groups as $1, $2). Look-behinds go by length, as Python asks for.
PRE_FIXES = [
    ("".join(f"(?<!{'|'.join(w for w in _KEPT_DE if len(w) == n)})" for n in sorted({len(w) for w in _KEPT_DE})) + f"得(?=[，,、](?:{NEW_CLAUSE}))", "的"),
    (f"({DIRECTIONS})得((?:对|是|可|行|不)?)(?=吗|呢|吧|啊|呀|嘛|，|。|？|！|$)", "$1的$2"),
    (f"长的(?=(?:{DEGREES})?(?:{LOOKS}))", "长得"),
]


def pre_fix_de(c: Column | str) -> Column:
    """得 that is 的: before a comma and a connective (but after an emotion or in a word that ends in 得), and after a
    directional complement before a particle or an end; 长的 before a word of looks is 长得."""
    text = _col(c)
    for pattern, to in PRE_FIXES:
        text = F.regexp_replace(text, pattern, to)
    return text
