"""Corpus correction: texts in, corrected texts and position-accurate suggestions out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import accumulate
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from textloom.functions import confusing, particles
from textloom.functions import rewriting as R
from textloom.functions.counting import slices
from textloom.functions.segmenting import Segmenter
from textloom.functions.text import BA_OBJECTS, MARKS, chunk_text, is_mixed_language
from textloom.sources.tables import unused

#: Rule tables up to this size are broadcast; they are lists that people write, not data that grows with the corpus.
MOST_RULES = 200_000
#: Bytes of text whose suggestions or tokens are held together, and rows of tokens that a task gives out together.
TEXT_BYTES, OUT_ROWS = 1 << 18, 50_000
SUGGESTION = "array<struct<start: int, end: int, original: string, replacement: string, reason: string, source: string, confidence: double>>"


def collect_rules(rules: DataFrame, rule_set: str | None = None) -> list[R.Rule]:
    """The rows of a rule table (``ord, wrong, right`` and, if present, ``guards array<struct<before, after>>``) in order. A
    table beyond MOST_RULES is refused: it would not fit a broadcast."""
    chosen = rules.filter(F.col("rule_set") == rule_set) if rule_set is not None else rules
    rows = chosen.orderBy("ord", "wrong").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rewrite rules")
    return [R.Rule(r.wrong, r.right, tuple((g.before or "", g.after or "") for g in r.guards or ()) if "guards" in r else ()) for r in rows]


def text_udf(fn: Callable[[str], str]) -> Callable[[Column | str], Column]:
    """A column function from one of strings; null stays null."""

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fn(t))

    return apply


def apply_rules(df: DataFrame, rules: Iterable[R.Rule], text_col: str = "text") -> DataFrame:
    """User replacements, typo tables, particle phrases or learned rules, in order, each on what the one before it left."""
    return df.withColumn(text_col, _shared_udf(df, R.Rewriter(rules))(text_col))


def phrase_rules(pairs: Iterable[tuple[str, str]], guards: dict[str, tuple[tuple[str, str], ...]] | None = None) -> list[R.Rule]:
    """Fixed phrases, the longest first, pairs that change nothing left out."""
    kept = [(w, r) for w, r in pairs if w != r]
    return [R.Rule(w, r, (guards or {}).get(w, ())) for w, r in sorted(kept, key=lambda p: -len(p[0]))]


# --- the stages ---------------------------------------------------------------------------------------------------------


def _collapse(text: str) -> str:
    def best(m: re.Match) -> str:
        marks = [c for c in m[0] if c in MARKS]
        return "？！" if "！" in marks and "？" in marks else min(marks, key=MARKS.index)

    return re.sub(f"(?<![\\s{MARKS}])[\\s{MARKS}]*[{MARKS}]", best, text)


def _ba(text: str) -> str:
    return re.sub(f"(把(?:{BA_OBJECTS}))切入", r"\1接入", text)


#: Lexicons up to this size are broadcast (some 50 MB in a worker); they are dictionaries, not data that grows with the corpus.
MOST_WORDS = 500_000


def collect_lexicon(lexicon: DataFrame, most: int = MOST_WORDS) -> dict[str, tuple[int, str]]:
    """``word, freq, tag`` as a dictionary; a lexicon beyond ``most`` words is refused."""
    rows = lexicon.select("word", "freq", "tag").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} lexicon words")
    return {r.word: (r.freq, r.tag) for r in rows}


class Particles:
    """的, 地 and 得: pre-fixes, fixed phrases, the rules by words and tags in each clause, fixed phrases again."""

    def __init__(self, lexicon: dict[str, tuple[int, str]], phrases: Iterable[R.Rule] = (), cutter: Segmenter | None = None) -> None:
        self.words, self.phrases, self.cutter = lexicon, R.Rewriter(phrases), cutter or Segmenter(lexicon)

    def by_tags(self, text: str) -> str:
        def one(m: re.Match) -> str:
            if {*R.PARTICLES}.isdisjoint(m[0]):
                return m[0]
            return particles.decide([(w, t, self.words[w][0] if w in self.words else 0) for w, t, *_ in self.cutter.cut(m[0])])

        return re.sub("[^。！？；，、\n]+", one, text)

    def __call__(self, text: str) -> str:
        text = self.phrases(particles.pre_fix(text))
        return self.phrases(self.by_tags(text)) if self.words else text


def default_stages(
    simplified: tuple[str, str] = ("", ""), typos: Iterable[R.Rule] = (), phrases: Iterable[R.Rule] = (), user: Iterable[R.Rule] = (), learned: Iterable[R.Rule] = (), variants: dict[str, str] | None = None,
    numerals: bool = True, lexicon: dict[str, tuple[int, str]] | None = None, terms: Iterable[tuple[str, float]] = (), confusions: bool = True, model: confusing.Model | None = None,
) -> list[R.Stage]:
    """The built-in stages in order. Tables that are not given change nothing: without a lexicon, particles are corrected by
    pre-fixes and phrases alone, and confusions and variants not at all. Reasons and sources are fixed values."""
    to_simple = str.maketrans(*simplified)
    words = lexicon or {}
    cutter = Segmenter(words)  # one for all stages
    stages = [
        R.Stage("numerals", "中文数字 → 阿拉伯数字", "数字规范", 0.95, R.normalize_numerals),
        R.Stage("simplified", "繁体 → 简体", "繁简转换", 1.0, lambda t: t.translate(to_simple)),
        R.Stage("particles", "的/地/得 语法修正", "语法", 0.9, Particles(words, phrases, cutter)),
        R.Stage("terms", "术语还原", "术语", 0.95, R.Terms(terms)),
        R.Stage("typos", "错别字/异形词修正", "错别字", 0.95, R.Rewriter(typos)),
        R.Stage("confusions", "同音字纠错", "同音字", 0.85, confusing.Confusions(words, model, cutter)),
        R.Stage("ba", "ASR 声母混淆修正（把X切入→接入）", "语境混淆", 0.95, _ba),
        R.Stage("variants", "异形词规范（GF 1001-2001）", "异形词", 0.9, confusing.Variants(variants or {}, words, cutter)),
        R.Stage("user", "用户自定义替换", "用户替换", 1.0, R.Rewriter(user)),
        R.Stage("learned", "自学习规则", "自学习", 0.9, R.Rewriter(learned)),
        R.Stage("punctuation", "标点归一 / 引号配对", "标点", 0.95, lambda t: R.close_quotes(_collapse(t))),
    ]
    wanted = {"numerals": numerals, "confusions": confusions and words, "variants": variants and words}
    return [x for x in stages if wanted.get(x.name, True)]


def with_polish(df: DataFrame, fn: Callable[[Column], Column], template: str, id_col: str = "doc_id", text_col: str = "corrected", **how) -> DataFrame:
    """The optional last stage: ``text_col`` polished by a caller's function, marks collapsed and quotes closed again."""
    done = polished(df, fn, template, id_col, text_col, **how)
    return done.withColumn(text_col, text_udf(lambda t: R.close_quotes(_collapse(t)))(text_col))


def correct_particles(df: DataFrame, lexicon: DataFrame, phrases: Iterable[R.Rule] = (), text_col: str = "text") -> DataFrame:
    """``df`` with the particles of ``text_col`` corrected; null stays null."""
    return df.withColumn(text_col, _shared_udf(df, Particles(collect_lexicon(lexicon), phrases))(text_col))


def correct_tagged(tokens: DataFrame) -> DataFrame:
    """``doc_id, text``: clauses put together from their words with the particles among them decided by words and tags, for tags
    from any tagger: ``doc_id, idx, word, tag, freq``, one clause for each id. A clause's words come together in one array."""
    own = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "word", F.coalesce("tag", F.lit("x")).alias("tag"), F.coalesce("freq", F.lit(0)).cast("long").alias("freq")))).alias("t"))

    @F.pandas_udf("string")
    def decide(clauses: pd.Series) -> pd.Series:
        return clauses.map(lambda c: particles.decide([(x["word"], x["tag"], x["freq"]) for x in c if x["word"]]))

    return own.select("doc_id", decide("t").alias("text"))


def correct_confusions(df: DataFrame, lexicon: DataFrame, model: confusing.Model | None = None, text_col: str = "text", names: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """``df`` with the confusable characters of ``text_col`` corrected; null stays null. ``model`` decides what the lexicon
    leaves (``ngrams.collect_model`` makes one from n-gram tables). ``names`` (``doc_id, start, end``) are stretches that a
    named-entity model found: those that ``confusing.name_places`` lets count stay as they are, as do the names that rules
    find. They come to a text as one array; a text's spans are bounded by its length."""
    shared = _shared(df, confusing.Confusions(collect_lexicon(lexicon), model))
    if names is None:
        return df.withColumn(text_col, text_udf(lambda t: shared()(t))(text_col))
    of, own = unused(df, "doc", "spans")
    spans = names.groupBy(F.col("doc_id").alias(of)).agg(F.collect_set(F.struct("start", "end")).alias(own))

    @F.pandas_udf("string")
    def fix(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else shared()(t, [(x["start"], x["end"]) for x in s] if s is not None else ()) for t, s in zip(texts, spans, strict=True)], dtype=object)

    joined = df.join(spans, F.col(id_col) == F.col(of), "left")
    return joined.withColumn(text_col, fix(text_col, own)).select(*df.columns)


def standardize_variants(df: DataFrame, variants: DataFrame, lexicon: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with deprecated forms (``preferred, deprecated``) of ``text_col`` replaced where no guard holds; the longest
    form first, equal lengths in order. Null stays null."""
    rows = variants.select("deprecated", "preferred").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} variants")
    forms = {r.deprecated: r.preferred for r in sorted(rows, key=lambda r: (-len(r.deprecated), r.deprecated))}
    return df.withColumn(text_col, _shared_udf(df, confusing.Variants(forms, collect_lexicon(lexicon)))(text_col))


def proper_noun_spans(df: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, end``: the stretches of names in each text; texts without any, and null texts, give no rows."""
    shared = df.sparkSession.sparkContext.broadcast(collect_lexicon(lexicon))

    @F.pandas_udf("array<struct<start: int, end: int>>")
    def spans(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            at = sorted(confusing.proper_nouns(text or "", lambda w: shared.value.get(w, (0,))[0]))
            cuts = [i for i, x in enumerate(at) if not i or x != at[i - 1] + 1]
            return [{"start": at[i], "end": at[j - 1] + 1} for i, j in zip(cuts, [*cuts[1:], len(at)], strict=False)]

        return texts.map(one)

    return df.select(F.col(id_col).alias("doc_id"), F.explode(spans.asNondeterministic()(text_col)).alias("s")).select("doc_id", "s.start", "s.end")


def unite_spans(*tables: DataFrame) -> DataFrame:
    """``doc_id, start, end``: what span tables of the same columns cover together; spans that overlap or touch are one. Empty spans
    and spans with nulls are left out. A text's spans are put in one array, which its length bounds, and united in the row."""
    every = reduce(DataFrame.unionByName, (t.select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")) for t in tables))
    own = every.filter("doc_id is not null and start < end").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
    last = lambda done: F.element_at(done, -1)
    grown = lambda done, x: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], x["end"]).alias("end"))))
    united = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.slice("s", 1, 1), lambda done, x: F.when(x["start"] <= last(done)["end"], grown(done, x)).otherwise(F.concat(done, F.array(x))))
    return own.select("doc_id", F.explode(united).alias("x")).select("doc_id", "x.start", "x.end")


def _shared_udf(df: DataFrame, fn: Callable[[str], str]) -> Callable[[Column | str], Column]:
    """``text_udf`` of a function that is large: it is sent to each executor once."""
    shared = _shared(df, fn)
    return text_udf(lambda t: shared()(t))


def _shared(df: DataFrame, value: Any) -> Callable[[], Any]:
    """A large value, lambdas included, broadcast; a worker unpacks it once, as it keeps the broadcast itself."""
    packed = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))

    def get() -> Any:
        if not hasattr(packed, "unpacked"):
            packed.unpacked = cloudpickle.loads(packed.value)
        return packed.unpacked

    return get


def proofread(df: DataFrame, stages: list[R.Stage], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, corrected, suggestions``. All stages run in one pass, so a row crosses to Python once and rows never
    shuffle; texts go through in small slices, as a suggestion takes more room than what it is about. Null text gives null and no
    suggestions. Callers may add stages of their own to the list."""
    shared = _shared(df, tuple(stages))
    kinds = (pa.int32(), pa.int32(), *[pa.string()] * 4, pa.float64())
    names = ("start", "end", "original", "replacement", "reason", "source", "confidence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1), TEXT_BYTES):
                done = [(None, ()) if t is None else R.staged(t, shared()) for t in texts.to_pylist()]
                found = [x for _, own in done for x in own]
                fields = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]
                ends = pa.array(list(accumulate((len(own) for _, own in done), initial=0)), pa.int32())
                listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, names))
                yield pa.record_batch([batch.column(0).slice(first, len(texts)), texts, pa.array([c for c, _ in done], pa.string()), listed], ["doc_id", "text", "corrected", "suggestions"])

    own = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, StructType([*own.schema.fields, *_parsed(f"corrected string, suggestions {SUGGESTION}")]))


def _parsed(columns: str) -> list[StructField]:
    return StructType.fromDDL(columns).fields


def suggestions_of(corrected: DataFrame) -> DataFrame:
    """One row for each suggestion, numbered in a document."""
    return corrected.select("doc_id", F.posexplode("suggestions").alias("seq", "s")).select("doc_id", "seq", "s.*")


def suggestion_report(suggestions: DataFrame) -> DataFrame:
    """Counts of suggestions, documents and the mean confidence by source and reason, with subtotals (null reason, then null
    source)."""
    return suggestions.rollup("source", "reason").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.avg("confidence").alias("confidence"))


def top_replacements(suggestions: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent replacements of each source."""
    counted = suggestions.groupBy("source", "original", "replacement").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("place", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "original", "replacement")))
    return ranked.filter(F.col("place") <= k)


# --- language-model polish ----------------------------------------------------------------------------------------------

MIXED_NOTE = "这段话夹有英文，拼写和空格也请检查。"
#: What stands before the terms and before the replacements.
LABELS = ("术语：", "替换：")
CHUNK = 600


def polish_prompts(df: DataFrame, template: str, terms: Iterable[str] = (), replacements: Iterable[tuple[str, str]] = (), mixed_note: str = MIXED_NOTE, labels: tuple[str, str] = LABELS, id_col: str = "doc_id", text_col: str = "text", max_len: int = CHUNK) -> DataFrame:
    """``doc_id, pos, chunk, prompt``: the template for each chunk, with the terms and replacements named in front (``labels``
    introduce them); texts that mix languages get a note before it. Null and empty texts give no prompt. The rows of a
    text that shares its id with another are told apart by ``row``, a hash of the whole text."""
    names, swaps = list(terms), [f"{a}→{b}" for a, b in replacements]
    parts = [label + "、".join(x) for label, x in zip(labels, (names, swaps), strict=True) if x]
    head = "\n".join(parts) + "\n\n" if parts else ""
    full = F.concat(F.lit(head), F.when(is_mixed_language(text_col), F.lit(mixed_note)).otherwise(""), F.lit(template))
    chunks = df.filter(F.length(text_col) > 0).select(F.col(id_col).alias("doc_id"), F.md5(text_col).alias("row"), full.alias("full"), F.posexplode(chunk_text(text_col, max_len)).alias("pos", "chunk"))
    return chunks.select("doc_id", "row", "pos", "chunk", F.replace("full", F.lit("{text}"), F.col("chunk")).alias("prompt"))


def apply_polish(prompts: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """``doc_id, row, text``: a caller's column function (a pandas UDF, say) on each distinct prompt; where it gives null or
    nothing, the chunk stays; chunks joined again in order. Rows that repeat whole are one."""
    done = prompts.select("doc_id", "row", "pos", F.coalesce(F.nullif(fn(F.col("prompt")), F.lit("")), "chunk").alias("part"))
    parts = F.array_sort(F.collect_set(F.struct("pos", "part")))  # the chunks of one text
    return done.groupBy("doc_id", "row").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("text"))


def polished(df: DataFrame, fn: Callable[[Column], Column], template: str, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``df`` with ``text_col`` polished: prompts, answers and chunks put together again. Null and empty texts stay."""
    own, row, new = unused(df, "id", "row", "new")
    answers = apply_polish(polish_prompts(df, template, id_col=id_col, text_col=text_col, **how), fn).select("doc_id", "row", "text").toDF(own, row, new)
    joined = df.join(answers, F.col(id_col).eqNullSafe(F.col(own)) & (F.md5(text_col) == F.col(row)), "left")
    return joined.withColumn(text_col, F.coalesce(new, text_col)).select(*df.columns)


# --- tokens, parses, differences ----------------------------------------------------------------------------------------


def tag_tokens(df: DataFrame, lexicon: DataFrame, overrides: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """``doc_id, idx, word, tag, start, end``: texts cut into lexicon words (``word, freq, tag``). The lexicon is broadcast
    and must not hold more than ``most_words``."""
    shared = df.sparkSession.sparkContext.broadcast(Segmenter(collect_lexicon(lexicon, most_words), overrides))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1), TEXT_BYTES):
                cut = [[] if t is None else shared.value.cut(t) for t in texts.to_pylist()]
                sizes = np.array([len(x) for x in cut], np.int64)
                rows = np.repeat(np.arange(first, first + len(cut)), sizes)
                ids = batch.column(0).take(pa.array(rows))
                idx = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                word, tag, start, end = zip(*(x for own in cut for x in own), strict=True) if len(rows) else [()] * 4
                every = [ids, pa.array(idx, pa.int32()), pa.array(word, pa.string()), pa.array(tag, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
                whole = pa.record_batch(every, ["doc_id", "idx", "word", "tag", "start", "end"])
                yield from (whole.slice(k, OUT_ROWS) for k in range(0, len(rows), OUT_ROWS))

    own = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, StructType([own.schema["doc_id"], *_parsed("idx int, word string, tag string, start int, end int")]))


def extract_diffs(pairs: DataFrame, lexicon: DataFrame | None = None, particles_only: bool = False, most_words: int = MOST_WORDS) -> DataFrame:
    """``event_id, seq, old, new, raw, manual, ts`` from ``event_id, raw, corrected, manual, ts``: the learnable changes, or
    those of 的, 地 and 得."""
    known = {r.word: r.freq for r in lexicon.filter(F.col("freq") >= R.RELIABLE).select("word", "freq").limit(most_words + 1).collect()} if lexicon is not None else {}
    if len(known) > most_words:
        raise ValueError(f"more than {most_words} reliable words")
    shared = pairs.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("array<struct<old: string, new: string>>")
    def changes(raw: pd.Series, corrected: pd.Series) -> pd.Series:
        freq = lambda w: shared.value.get(w, 0)
        find = R.particle_diffs if particles_only else lambda a, b: R.learnable_diffs(a, b, freq)
        return pd.Series([[{"old": o, "new": n} for o, n in find(a or "", b or "")] for a, b in zip(raw, corrected, strict=True)])

    changed = pairs.filter(F.col("raw") != F.col("corrected"))
    return changed.select("event_id", F.posexplode(changes.asNondeterministic()("raw", "corrected")).alias("seq", "d"), "raw", "manual", "ts").select("event_id", "seq", "d.old", "d.new", "raw", "manual", "ts")


def conflicting_pairs(pairs: DataFrame) -> DataFrame:
    """``event_id`` of pairs in which a 的, 地 or 得 is swapped for another than the rules' verdict (``verdict``, a text of
    ``raw``'s length, else undecided) has in that place. Places come from the pair's difference, so the correction may be
    of another length."""

    @F.pandas_udf("array<struct<at: int, to: string>>")
    def swaps(raw: pd.Series, corrected: pd.Series) -> pd.Series:
        return pd.Series([[{"at": i, "to": c} for i, c in R.particle_swaps(a, b)] for a, b in zip(raw, corrected, strict=True)])

    may = pairs.filter((F.col("raw") != F.col("corrected")) & (F.length("raw") == F.length("verdict")) & F.col("raw").rlike("[的地得]"))
    (own,) = unused(may, "swaps")
    told = may.withColumn(own, swaps("raw", "corrected"))
    return told.filter(F.exists(own, lambda x: F.substring(F.col("verdict"), x["at"] + 1, F.lit(1)) != x["to"])).select("event_id")


def merge_verdicts(rule: Column | str, parse: Column | str) -> Column:
    """The parse result but where it swaps 的 and 地, which stay as the rules have them; texts of different length: the parse
    result as it is."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    pick = lambda a, b: F.when(((a == "的") & (b == "地")) | ((a == "地") & (b == "的")), a).otherwise(b)
    return F.when(F.length(rule) == F.length(parse), F.array_join(F.zip_with(chars(rule), chars(parse), pick), "")).otherwise(F.col(parse) if isinstance(parse, str) else parse)


def collocations(parses: DataFrame) -> DataFrame:
    """``verb, object, n``: verb-object pairs of dependency parses (``doc_id, idx, word, head, deprel``; heads count from 1)."""
    objects = parses.filter(F.lower("deprel").isin("vob", "dobj")).select("doc_id", (F.col("head") - 1).alias("idx"), F.col("word").alias("object"))
    return objects.join(parses.select("doc_id", "idx", F.col("word").alias("verb")), ["doc_id", "idx"]).groupBy("verb", "object").agg(F.count("*").alias("n"))


# --- evaluation ---------------------------------------------------------------------------------------------------------


def evaluate_cases(got: DataFrame, cases: DataFrame) -> DataFrame:
    """Passed and failed cases of each group: ``cases`` is ``case_group, label, input, expected``, ``got`` is ``input, output``."""
    joined = cases.join(got, "input", "left").withColumn("ok", F.coalesce(F.col("output") == F.col("expected"), F.lit(False)))
    return joined.groupBy("case_group").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


def correction_metrics(df: DataFrame) -> DataFrame:
    """By ``variant``: how many wrong texts came right (``hits`` of ``wrong``) and what share of right texts stayed so
    (``protection``), from ``raw, gold, output``."""
    wrong, right = F.col("raw") != F.col("gold"), F.col("raw") == F.col("gold")
    kept = F.col("output") == F.col("gold")
    return df.groupBy("variant").agg(F.count_if(wrong).alias("wrong"), F.count_if(wrong & kept).alias("hits"), F.count_if(right).alias("right"), F.try_divide(F.count_if(right & kept), F.count_if(right)).alias("protection"))
