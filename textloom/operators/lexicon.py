"""Lexicon tables: building, look-ups, usage of characters, new words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import CJK, restore_spoken_digits

#: A word of at least this frequency is reliable.
RELIABLE = 50
POS_FIX_FREQ = 1000
# Characters that a new word must not hold.
PARTICLES = "的地得"
WORD_BREAKS = " \t\n，。！？、；：\"'（）《》【】,.:;!?"


def term_freq(score: Column) -> Column:
    return F.floor(F.least(F.greatest(score, F.lit(0.5)), F.lit(10.0)) * 1000).cast("long")


def build_lexicon(base: DataFrame, terms: DataFrame | None = None, user: DataFrame | None = None, pos_fix: DataFrame | None = None) -> DataFrame:
    """``word, freq, tag`` from a base lexicon, terms (``word, score``: the score sets the frequency), user words
    (``word, tag, freq``) and tag corrections (``word, tag``). For a word in several, the later source wins; inside one
    source the larger frequency, then the smaller tag."""
    parts = [base.select("word", F.col("freq").cast("long").alias("freq"), "tag", F.lit(0).alias("__p"))]
    if terms is not None:
        parts.append(terms.select("word", term_freq(F.col("score")).alias("freq"), F.lit("n").alias("tag"), F.lit(1).alias("__p")))
    if user is not None:
        parts.append(user.select("word", F.col("freq").cast("long").alias("freq"), "tag", F.lit(2).alias("__p")))
    if pos_fix is not None:
        parts.append(pos_fix.select("word", F.lit(POS_FIX_FREQ).cast("long").alias("freq"), "tag", F.lit(3).alias("__p")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    best = every.groupBy("word").agg(F.min(F.struct((-F.col("__p")).alias("p"), (-F.col("freq")).alias("f"), "tag", "freq")).alias("b"))
    return best.select("word", "b.freq", "b.tag")


def lookup_freq(df: DataFrame, lexicon: DataFrame, word_col: str = "word") -> DataFrame:
    """``df`` with ``freq``, 0 for words that the lexicon lacks, and ``reliable``."""
    found = df.join(lexicon.select(F.col("word").alias("__w"), F.col("freq").alias("__f")), F.col(word_col) == F.col("__w"), "left")
    return found.withColumn("freq", F.coalesce("__f", F.lit(0)).cast("long")).withColumn("reliable", F.col("freq") >= RELIABLE).drop("__w", "__f")


def char_word_usage(lexicon: DataFrame) -> DataFrame:
    """``ch, n_words``: how many lexicon words of two characters or more hold each CJK character."""
    chars = lexicon.filter(F.length("word") >= 2).select(F.explode(F.array_distinct(F.split("word", ""))).alias("ch"))
    return chars.filter(F.col("ch").rlike(f"^[{CJK}]$")).groupBy("ch").agg(F.count("*").alias("n_words"))


def new_words(words: DataFrame, lexicon: DataFrame, user_terms: DataFrame | None = None, word_col: str = "word") -> DataFrame:
    """The rows of ``words`` whose word is worth keeping: two characters or more, one of them CJK, no particle or mark, not
    reliable in the lexicon, not among the user's terms."""
    w = F.col(word_col)
    fit = words.filter((F.length(w) >= 2) & w.rlike(f"[{CJK}]") & ~w.rlike(f"[{PARTICLES}]") & (F.translate(w, WORD_BREAKS, "") == w))
    known = lexicon.filter(F.col("freq") >= RELIABLE).select(F.col("word").alias(word_col))
    out = fit.join(known, word_col, "left_anti")
    return out.join(user_terms.select(F.col("word").alias(word_col)), word_col, "left_anti") if user_terms is not None else out


def filter_ner_spans(spans: DataFrame, texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``doc_id, start, end``: the spans of two to four characters whose text is no reliable word; each once. A text meets its
    spans as one array and gives the words under them, so it is read once and not copied."""
    own = spans.filter((F.col("end") - F.col("start")).between(2, 4)).groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("s"))
    both = texts.select("doc_id", "text").join(own, "doc_id")
    word = lambda x: F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"])
    named = both.select("doc_id", F.explode(F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), word(x).alias("word")))).alias("x")).select("doc_id", "x.*")
    return named.join(lexicon.filter(F.col("freq") >= RELIABLE).select("word"), "word", "left_anti").select("doc_id", "start", "end").distinct()


#: What may be a term: a Latin letter and up to 31 more characters.
CANDIDATE = f"[A-Za-z][A-Za-z0-9._+\\-{CJK} ]{{0,31}}"
#: Restored candidates up to this number are looked up in the row; with more, texts are cut up and joined.
MOST_RESTORED = 200_000


def _remainders(s: Column, most: Column) -> Column:
    """What is left of a string after up to ``most`` (2 at most) deletions behind its first letter, each once."""
    without = lambda x, i: F.concat(x.substr(F.lit(1), i - 1), x.substr(i + 1, F.length(x)))
    places = lambda x, low: F.when(F.length(x) >= low, F.sequence(low, F.length(x))).otherwise(F.array().cast("array<int>"))
    one = F.transform(places(s, F.lit(2)), lambda i: without(s, i))
    two = F.flatten(F.transform(places(s, F.lit(2)), lambda i: F.transform(places(without(s, i), i), lambda j: without(without(s, i), j))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(s), F.when(most >= 1, one).otherwise(none), F.when(most >= 2, two).otherwise(none)))


def restore_terms(texts: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``candidate, term`` for the distinct Latin-letter candidates of the texts that a term restores: an exact match in any
    case first; else, for candidates without CJK other than numerals, the first term in list order (``terms``: ``ord, word,
    score``) with the same first letter that equals the candidate's digit form or lies within the term's edit distance.
    Candidates meet terms by equality, by equal digit forms, or by what is left of both after up to two deletions: strings
    within two edits share such a remainder, and remainders are nearly as many as strings, so no join key is a hot one."""
    words = texts.select(F.explode(F.regexp_extract_all(text_col, F.lit(CANDIDATE), F.lit(0))).alias("candidate")).distinct()
    words = words.withColumn("low", F.lower("candidate")).withColumn("open", ~F.translate("candidate", "零一二三四五六七八九两十百", "").rlike(f"[{CJK}]")).withColumn("plain", restore_spoken_digits("candidate"))
    n = F.length("word")
    strict = F.when(n <= 3, 0).when(n == 4, 1).otherwise(2)
    bound = F.when((F.col("score") >= 4.0) & (strict > 0), F.greatest(F.lit(1), strict - 1)).otherwise(strict)
    known = terms.select("ord", "word", F.lower("word").alias("term"), bound.alias("bound"))
    hit = lambda df, exact: df.select("candidate", "word", F.struct(F.lit(not exact).alias("e"), "ord").alias("order"))
    equal = hit(words.join(known, F.col("low") == F.col("term")), True)
    digits = hit(words.filter("open").join(known.filter(F.col("term").rlike("^[a-z0-9]")), (F.col("plain") == F.col("term")) & (F.substring("low", 1, 1) == F.substring("term", 1, 1))), False)
    sized = known.select("ord", "word", "term", "bound", F.substring("term", 1, 1).alias("head"), F.length("term").alias("size")).filter("bound > 0")
    # Only candidates of a first letter and about a length that some term has are taken apart.
    sizes = sized.select("head", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: F.col("size") + d)).alias("n")).distinct()
    asked = words.filter("open").select("candidate", "low", F.substring("low", 1, 1).alias("head"), F.length("low").alias("n")).join(sizes, ["head", "n"], "left_semi")
    rests = asked.select("candidate", "low", "head", F.explode(_remainders(F.col("low"), F.lit(2))).alias("rest"))
    terms_by_rest = sized.select("ord", "word", "term", "bound", "head", F.explode(_remainders(F.col("term"), F.col("bound"))).alias("rest"))
    near = rests.join(terms_by_rest, ["head", "rest"]).filter((F.abs(F.length("low") - F.length("term")) <= F.col("bound")) & (F.levenshtein("low", "term") <= F.col("bound"))).dropDuplicates(["candidate", "ord", "word"])
    return equal.unionByName(digits).unionByName(hit(near, False)).groupBy("candidate").agg(F.min_by("word", "order").alias("term"))


def apply_terms(texts: DataFrame, restored: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_RESTORED) -> DataFrame:
    """``doc_id, text`` with every candidate of ``restored`` replaced, one row for each row of ``texts``; null stays null. Up
    to ``most`` candidates that change something are looked up inside the row; with more, distinct texts are cut at their
    candidates, joined and put together again."""
    own = texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    restored = restored.filter(F.col("candidate") != F.col("term"))
    found = restored.limit(most + 1).collect()
    if len(found) <= most:
        shared = texts.sparkSession.sparkContext.broadcast({r.candidate: r.term for r in found})

        @F.pandas_udf("string")
        def replace(column: pd.Series) -> pd.Series:
            term = shared.value
            return column.map(lambda t: re.sub(CANDIDATE, lambda m: term.get(m[0], m[0]), t), na_action="ignore")

        has = F.col("text").rlike("[A-Za-z]")
        return own.withColumn("text", F.when(has, replace(F.when(has, F.col("text")))).otherwise(F.col("text")))
    parts = own.select("text").distinct().select(F.md5("text").alias("key"), F.posexplode(F.regexp_extract_all("text", F.lit(f"{CANDIDATE}|[^A-Za-z]+"), F.lit(0))).alias("pos", "candidate"))
    fixed = parts.join(restored, "candidate", "left").select("key", "pos", F.coalesce("term", "candidate").alias("part"))
    joined = fixed.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "").alias("new"))
    return own.withColumn("key", F.md5("text")).join(joined, "key", "left").select("doc_id", F.coalesce("new", "text").alias("text"))
