"""Risk-controlled quality rules (operator 5), in DataFrame functions alone.

Measures of a text (mean word length, symbols, repeated lines, repeated words) reject it above cutoffs. A cutoff is chosen
for each stratum and measure on labelled good documents, by fixed-sequence testing: from the mildest candidate on, each
has to show by the exact binomial distribution that it rejects less than a tolerated share of good documents. The level of
the tests is divided by the number of sequences (Bonferroni), so with the stated confidence no stratum loses more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import settled

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
MIN_WORDS, MOST_REPEATED = 50, 0.5
#: Tolerated share of good documents rejected in a stratum by all measures together, and the chance that any stratum's
#: real share is larger.
RISK, FAULT = 0.02, 0.05
#: Candidate cutoffs of each measure: BINS equal steps from 0 to its largest sensible value.
BINS = 64
MEASURES = {"word_length": 32.0, "word_shortness": 1.0, "symbol_share": 1.0, "dup_line_share": 1.0, "repeat_share": 0.5}


def _without(text: Column, letters: str) -> Column:
    for c in letters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def base_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df``'s columns ``doc_id`` and ``stratum`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_lines,
    n_repeat_words``. Null text has no words. All of a row's work stays in the row: windows of three words are hashed, and
    only rows with an equal pair sort them by hash to find the positions that repeat."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    a = df.select(
        "doc_id",
        "stratum",
        F.when(F.length(trimmed) > 0, F.split(trimmed, GAP)).otherwise(F.array().cast("array<string>")).alias("words"),
        F.length(_without(text, SPACES)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    three = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    b = a.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.size("words") > 3, three).alias("h"),
    )
    c = b.withColumn("s", F.when(F.size("h") > F.size(F.array_distinct("h")), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("h")
    # Whether a sorted entry has the hash of the one after it.
    d = c.withColumn("e", F.zip_with("s", F.slice("s", 2, F.size("s")), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))))
    either = F.zip_with(F.zip_with(F.col("s.i"), "e", lambda i, x: F.struct(i.alias("i"), x.alias("x"))), F.concat(F.array(F.lit(False)), "e"), lambda p, y: F.when(p["x"] | y, p["i"]))
    f = d.withColumn("at", F.sort_array(F.filter(either, lambda i: i.isNotNull()))).drop("s", "e")
    steps = F.zip_with("at", F.slice("at", 2, F.size("at")), lambda p, q: F.when(q.isNull(), 3).otherwise(F.least(F.lit(3), q - p)))
    covered = F.aggregate(steps, F.lit(0), lambda total, x: total + x)
    return f.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words"))


def measures() -> dict[str, Column]:
    """Each is larger for worse texts."""
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))
    return {
        "word_length": share("word_chars", "n_words"),
        "word_shortness": F.coalesce(F.try_divide(F.col("n_words"), F.col("word_chars")), F.lit(0.0)),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of X from Binomial(n, p), exactly as a sum of terms; 1 where k is above the mean, as no test passes there."""
    first = F.struct((n * F.log1p(F.lit(-p))).alias("term"), F.lit(0.0).alias("total"))
    step = lambda s, j: F.struct((s["term"] + F.log((n - j).cast("double") / (j + 1)) + F.log(F.lit(p / (1 - p)))).alias("term"), (s["total"] + F.exp(s["term"])).alias("total"))
    return F.when(k > n * p, 1.0).otherwise(F.aggregate(F.sequence(F.lit(0).cast("long"), k), first, step, lambda s: s["total"]))


def select_cutoffs(good: DataFrame, risk: float = RISK, fault: float = FAULT) -> DataFrame:
    """``stratum`` and a column of each measure: its cutoff, null where no candidate passes (too few labels, or too many
    good documents above even the mildest). ``good`` has the base counts and strata of labelled good documents that pass
    the base rules. A document is rejected above the cutoff, not at it."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("measure"), F.least(F.lit(BINS), F.ceil(value * (BINS / MEASURES[name]))).cast("int").alias("bin")) for name, value in measures().items())))
    counted = good.select("stratum", each.alias("m")).groupBy("stratum", "m.measure", "m.bin").agg(F.count("*").alias("n"))
    # A value in bin b is above the candidates 0 to b - 1. All candidates of each sequence, filled up from the bins seen.
    sequences = counted.groupBy("stratum", "measure").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin"))  # BINS + 1 entries at most
    n_sequences = sequences.count()
    candidates = sequences.select("stratum", "measure", "total", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda t: F.aggregate(F.map_entries(F.map_filter("by_bin", lambda b, _: b > t)), F.lit(0).cast("long"), lambda s, e: s + e["value"]))).alias("t", "above"))
    tested = candidates.withColumn("passes", binomial_tail(F.col("above"), F.col("total"), risk / len(MEASURES)) <= fault / max(n_sequences, 1))
    first_failure = tested.groupBy("stratum", "measure").agg(F.max(F.when(~F.col("passes"), F.col("t"))).alias("fails"))
    chosen = first_failure.withColumn("t", F.coalesce(F.col("fails") + 1, F.lit(0))).filter(F.col("t") < BINS)
    value = {name: F.max(F.when(F.col("measure") == name, F.col("t") * (MEASURES[name] / BINS))).alias(name) for name in MEASURES}
    return chosen.groupBy("stratum").agg(*value.values())


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, fault: float = FAULT) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` of every row. ``labels`` is
    ``doc_id, quality``; labelled good documents (quality 1) set the cutoffs. A null stratum is one of its own; a stratum
    without labels, and every stratum of empty labels, rejects by the base rules alone. A row with a null id counts as
    unlabelled; an id labelled more than once counts once, as good if any label says so."""
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("\x00")).alias("stratum"), F.col(text_col).cast("string").alias("text"))
    counts = settled(base_counts(own))
    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    cutoffs = select_cutoffs(counts.filter(~base_failed()).join(good, "doc_id", "left_semi"), risk, fault)
    limits = cutoffs.select("stratum", *(F.col(name).alias(f"max_{name}") for name in MEASURES))
    over = F.lit(False)
    for name, value in measures().items():
        over = over | F.coalesce(value > F.col(f"max_{name}"), F.lit(False))
    joined = counts.join(limits, "stratum", "left")  # a row a stratum: Spark broadcasts what is small
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~(base_failed() | over)).alias("kept"))
