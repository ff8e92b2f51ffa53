"""Corrects a table of texts with the tables and lists that lie in given places, and writes what came of it.

``python -m textloom.jobs.correct SOURCE TARGET --lexicon ... --rules ...`` runs it on the session's cluster.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import rewriting as R
from textloom.operators import correcting, ngrams
from textloom.sources import tables

#: Terms up to this number are broadcast; a longer list is refused.
MOST_TERMS = 200_000


def stages_from(spark: SparkSession, lexicon: str | None = None, rules: str | None = None, terms: str | None = None, variants: str | None = None, store: str | None = None, model: str | None = None, trigrams: bool = False, numerals: bool = True) -> list[R.Stage]:
    """The stages with what lies in the given places; a place that is not given changes nothing. ``lexicon`` is a table ``word,
    freq, tag``; ``rules`` one of ``rule_set, ord, wrong, right`` (and ``guards``) with the sets ``typo``, ``particle`` and
    ``user``; ``terms`` and ``variants`` are list files; ``store`` is a learned-rule store, whose promoted rules count, the first
    seen first; ``model`` the folder of an n-gram model."""
    words = correcting.collect_lexicon(spark.read.parquet(lexicon)) if lexicon else None
    table = spark.read.parquet(rules) if rules else None
    of = lambda name: correcting.collect_rules(table, name) if table is not None else []
    listed = tables.load_terms(spark, terms).orderBy("ord").limit(MOST_TERMS + 1).collect() if terms else []
    if len(listed) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    forms = tables.load_variants(spark, variants).limit(correcting.MOST_RULES + 1).collect() if variants else []
    if len(forms) > correcting.MOST_RULES:
        raise ValueError(f"more than {correcting.MOST_RULES} variants")
    learned = []
    if store:
        held = tables.read_rules(spark, store).filter("promoted")
        learned = correcting.collect_rules(held.select(F.col("first_seen").alias("ord"), F.col("old").alias("wrong"), F.col("new").alias("right")))
    phrases = of("particle")
    return correcting.default_stages(
        typos=of("typo"),
        phrases=correcting.phrase_rules([(r.wrong, r.right) for r in phrases], {r.wrong: r.guards for r in phrases}),
        user=of("user"),
        learned=learned,
        variants={r.deprecated: r.preferred for r in sorted(forms, key=lambda r: (-len(r.deprecated), r.deprecated))},
        numerals=numerals,
        lexicon=words,
        terms=[(r.word, r.score) for r in listed],
        model=ngrams.collect_model(*tables.read_ngrams(spark, model, trigrams)) if model else None,
    )


def correct_table(spark: SparkSession, source: str, target: str, stages: list[R.Stage], fmt: str = "parquet", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Reads the texts of ``source``, corrects each once, and writes ``corrected``, ``suggestions`` by source, and ``report`` under
    ``target``; the report is returned. Texts without an id column (text files) get a number each."""
    texts = tables.read_transcripts(spark, source, fmt)
    if id_col not in texts.columns:
        texts = texts.withColumn(id_col, F.monotonically_increasing_id())
    tables.write_corrections(correcting.proofread(texts, stages, id_col, text_col), target)
    found = spark.read.schema(f"doc_id {dict(texts.dtypes)[id_col]}, seq int, start int, end int, original string, replacement string, reason string, confidence double, source string").parquet(f"{target}/suggestions")
    correcting.suggestion_report(found).write.mode("overwrite").parquet(f"{target}/report")
    return spark.read.parquet(f"{target}/report")


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--format", default="parquet", choices=tables.FORMATS)
    parser.add_argument("--id", default="doc_id")
    parser.add_argument("--text", default="text")
    for name in ("lexicon", "rules", "terms", "variants", "store", "model"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--trigrams", action="store_true")
    parser.add_argument("--keep-numerals", action="store_true")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    stages = stages_from(spark, given.lexicon, given.rules, given.terms, given.variants, given.store, given.model, given.trigrams, not given.keep_numerals)
    correct_table(spark, given.source, given.target, stages, given.format, given.id, given.text).orderBy("source", "reason").show(truncate=False)


if __name__ == "__main__":
    main()
