"""Rule mining: from observed corrections to promoted, expanded rewrite rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import CJK
from textloom.operators.lexicon import RELIABLE, char_word_usage, new_words

PROMOTE_AT = 2
MOST_VARIANTS = 6
WORDS_PER_EVENT = 3
WHOLE_PAIR_MOST = 50


def sentence_hash(raw: Column | str) -> Column:
    return F.substring(F.md5(raw), 1, 16)


#: Sketches of a promoted rule's sentences have 2 to this power cells: 4 KB at most, and a standard error of 1.6 %. Up to some
#: hundred sentences they are exact.
SKETCH_CELLS = 12


def promote_rules(diffs: DataFrame, store: DataFrame | None = None, threshold: int = PROMOTE_AT) -> DataFrame:
    """``old, new, n_sentences, promoted, first_seen, raws, sketch`` from events ``old, new, raw, manual, ts``. Repeats of a
    sentence are one piece of evidence: they are dropped before the count, so a rule seen by the million is spread over the
    shuffle. A manual event promotes at once; a promotion never reverts. ``store`` is an earlier result. A rule that waits
    keeps the hashes of its sentences, fewer than the threshold, so whether it is promoted is exact, and so is its count in
    the merge that promotes it; from then on it keeps a sketch, and ``n_sentences`` goes on as an estimate that never falls."""
    seen = diffs.select("old", "new", sentence_hash("raw").alias("h"), F.coalesce("manual", F.lit(False)).alias("manual"), "ts")
    events = seen.groupBy("old", "new", "h").agg(F.max("manual").alias("manual"), F.min("ts").alias("ts")).select("*", F.lit(0).cast("long").alias("base"), F.lit(None).cast("binary").alias("sketch"))
    if store is not None:
        kept = store.select("old", "new", F.explode_outer("raws").alias("h"), F.col("promoted").alias("manual"), F.col("first_seen").alias("ts"), F.when(F.col("promoted"), F.col("n_sentences")).otherwise(0).alias("base"), "sketch")
        events = events.unionByName(kept).groupBy("old", "new", "h").agg(F.max("manual").alias("manual"), F.min("ts").alias("ts"), F.max("base").alias("base"), F.first("sketch", True).alias("sketch"))
    fresh = F.hll_sketch_agg("h", SKETCH_CELLS).alias("fresh")
    rules = events.groupBy("old", "new").agg(F.count("h").alias("n"), F.max("base").alias("base"), F.max("manual").alias("manual"), F.min("ts").alias("first_seen"), F.first("sketch", True).alias("held"), fresh)
    rules = rules.withColumn("all", F.when(F.col("held").isNull(), F.col("fresh")).otherwise(F.hll_union(F.coalesce("held", "fresh"), F.col("fresh"))))
    rules = rules.withColumn("n_sentences", F.when(F.col("base") > 0, F.greatest("base", F.hll_sketch_estimate("all"))).otherwise(F.col("n")))
    rules = rules.withColumn("promoted", F.col("manual") | (F.col("n_sentences") >= threshold)).withColumn("sketch", F.when(F.col("promoted"), F.col("all")))
    waiting = events.join(rules.filter(~F.col("promoted")).select("old", "new"), ["old", "new"], "left_semi").filter("h is not null")
    raws = waiting.groupBy("old", "new").agg(F.sort_array(F.collect_list("h")).alias("raws"))  # fewer than the threshold each
    return rules.join(raws, ["old", "new"], "left").select("old", "new", "n_sentences", "promoted", "first_seen", F.coalesce("raws", F.array().cast("array<string>")).alias("raws"), "sketch")


def register_variants(expanded: DataFrame) -> DataFrame:
    """``old, new, base_old, base_new``: of a variant that several rules expand to, the first registered base wins (by
    ``seq``, then by the base)."""
    first = expanded.groupBy("old", "new").agg(F.min(F.struct("seq", "base_old", "base_new")).alias("f"))
    return first.select("old", "new", "f.base_old", "f.base_new")


def active_rules(rules: DataFrame, variants: DataFrame) -> DataFrame:
    """``old, new, kind``: promoted rules, and variants whose base is promoted."""
    promoted = rules.filter("promoted").select("old", "new")
    bases = promoted.select(F.col("old").alias("base_old"), F.col("new").alias("base_new"))
    of_bases = variants.join(bases, ["base_old", "base_new"], "left_semi").select("old", "new", F.lit("variant").alias("kind"))
    return promoted.withColumn("kind", F.lit("exact")).unionByName(of_bases)


def homophone_groups(pronunciations: DataFrame) -> DataFrame:
    return pronunciations.groupBy("syllable").agg(F.sort_array(F.collect_set("ch")).alias("chars"))


def _expandable(rules: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct rules of equal length, two CJK characters or more, whose new side is a reliable word and old side is not."""
    cjk = lambda c: F.col(c).rlike(f"^[{CJK}]{{2,}}$")
    fit = rules.select("old", "new").distinct().filter((F.length("old") == F.length("new")) & cjk("old") & cjk("new"))
    words = lexicon.filter(F.col("freq") >= RELIABLE).select("word")
    return fit.join(words.withColumnRenamed("word", "new"), "new", "left_semi").join(words.withColumnRenamed("word", "old"), "old", "left_anti")


def _swapped(rules: DataFrame, similar: DataFrame, lexicon: DataFrame, most: int) -> DataFrame:
    """One position of the old side replaced by a similar character (``similar``: ``ch, cand``): the best of each position,
    then the first ``most`` of a rule from left to right."""
    spots = rules.select("old", "new", F.posexplode(F.split("old", "")).alias("pos", "ch")).filter("ch <> ''")
    pairs = spots.join(similar.distinct(), "ch").withColumn("variant", F.concat(F.substring("old", F.lit(1), F.col("pos")), F.col("cand"), F.substring("old", F.col("pos") + 2, F.length("old"))))
    pairs = pairs.filter(F.col("variant") != F.col("new")).join(lexicon.filter(F.col("freq") >= RELIABLE).select(F.col("word").alias("variant")), "variant", "left_anti")
    ranked = pairs.join(char_word_usage(lexicon).withColumnRenamed("ch", "cand"), "cand", "left").join(lexicon.select(F.col("word").alias("cand"), "freq"), "cand", "left")
    order = [F.coalesce("n_words", F.lit(0)).desc(), F.coalesce("freq", F.lit(0)).desc(), F.col("cand")]
    per_position = F.ceil(F.lit(most) / F.length("old"))
    best = ranked.withColumn("nth", F.row_number().over(W.partitionBy("old", "new", "pos").orderBy(*order))).filter(F.col("nth") <= per_position)
    total = best.withColumn("seq", F.row_number().over(W.partitionBy("old", "new").orderBy("pos", "nth"))).filter(F.col("seq") <= most)
    return total.select(F.col("variant").alias("old"), "new", F.col("old").alias("base_old"), F.col("new").alias("base_new"), "seq")


def expand_homophones(rules: DataFrame, pronunciations: DataFrame, lexicon: DataFrame, most: int = MOST_VARIANTS) -> DataFrame:
    """``old, new, base_old, base_new, seq``: rules with one character of the old side swapped for one of the same syllable.
    A rule with a character of unknown reading is not expanded. Rules are made distinct before, not expanded per event."""
    fit = _expandable(rules, lexicon)
    unread = fit.select("old", F.explode(F.split("old", "")).alias("ch")).filter("ch <> ''").join(pronunciations.select("ch"), "ch", "left_anti").select("old").distinct()
    groups = pronunciations.select("syllable", F.col("ch").alias("cand"))
    similar = pronunciations.join(groups, "syllable").filter(F.col("ch") != F.col("cand")).select("ch", "cand")
    return _swapped(fit.join(unread, "old", "left_anti"), similar, lexicon, most)


def expand_shapes(rules: DataFrame, shape_pairs: DataFrame, lexicon: DataFrame, most: int = MOST_VARIANTS) -> DataFrame:
    """The same with characters that look alike (``shape_pairs``: ``a, b``, either way)."""
    similar = shape_pairs.select(F.col("a").alias("ch"), F.col("b").alias("cand")).unionByName(shape_pairs.select(F.col("b").alias("ch"), F.col("a").alias("cand")))
    return _swapped(_expandable(rules, lexicon), similar, lexicon, most)


def harvest_new_words(diffs: DataFrame, lexicon: DataFrame, user_terms: DataFrame, per_event: int = WORDS_PER_EVENT) -> DataFrame:
    """``word, score``: the new sides worth keeping, at most ``per_event`` of an event in order (``event_id, seq, new``).
    Inside one batch a word that two events bring takes a slot in both."""
    fit = new_words(diffs.select("event_id", "seq", F.col("new").alias("word")), lexicon, user_terms)
    first = fit.groupBy("event_id", "word").agg(F.min("seq").alias("seq"))
    kept = first.withColumn("nth", F.row_number().over(W.partitionBy("event_id").orderBy("seq", "word"))).filter(F.col("nth") <= per_event)
    return kept.select("word", F.lit(2.0).alias("score")).distinct()


def whole_pairs(pairs: DataFrame, diffs: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """Of pairs without a learnable diff, those of at most WHOLE_PAIR_MOST characters a side, as rules of their own
    (``event_id, old, new, raw, manual, ts``); pairs in ``conflicts`` (``event_id``) are not learned."""
    rest = pairs.filter((F.col("raw") != F.col("corrected")) & (F.length("raw") <= WHOLE_PAIR_MOST) & (F.length("corrected") <= WHOLE_PAIR_MOST))
    rest = rest.join(diffs.select("event_id").distinct(), "event_id", "left_anti")
    if conflicts is not None:
        rest = rest.join(conflicts.select("event_id").distinct(), "event_id", "left_anti")
    return rest.select("event_id", F.col("raw").alias("old"), F.col("corrected").alias("new"), "raw", "manual", "ts")


def learn_corrections(pairs: DataFrame, lexicon: DataFrame, pronunciations: DataFrame, shape_pairs: DataFrame, user_terms: DataFrame, store: DataFrame | None = None, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """All that correction pairs (``event_id, raw, corrected, manual, ts``, and ``verdict``, the rules' text of ``raw``) teach:
    ``rules``, counted and promoted, on top of ``store``; ``variants`` of theirs by sound and by shape, those by sound first;
    ``active``, what of both applies; ``words`` to add to the terms. Pairs without a learnable change are rules as a whole if
    they are short and the rules do not object. ``settle`` may write what several results share."""
    from textloom.operators.correcting import conflicting_pairs, extract_diffs

    diffs = settle(extract_diffs(pairs, lexicon))
    whole = whole_pairs(pairs, diffs, conflicting_pairs(pairs))
    columns = ["old", "new", "raw", "manual", "ts"]
    rules = settle(promote_rules(diffs.select(*columns).unionByName(whole.select(*columns)), store))
    changed = rules.join(diffs.select("old", "new").distinct(), ["old", "new"], "left_semi")
    by_sound = expand_homophones(changed, pronunciations, lexicon)
    by_shape = expand_shapes(changed, shape_pairs, lexicon).withColumn("seq", F.col("seq") + MOST_VARIANTS)
    variants = settle(register_variants(by_sound.unionByName(by_shape)))
    return {"rules": rules, "variants": variants, "active": active_rules(rules, variants), "words": harvest_new_words(diffs, lexicon, user_terms)}
