"""Language ID by compression (operator 9): the language whose dictionary makes a text smallest.

For each language a zstandard raw-content dictionary is filled with normalised labelled texts. A text is compressed whole
with each; the smallest result names the language, and what it saves against the second is the margin. Texts whose margin
is narrow are compressed again at a higher level before they are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import mapped, settled, small_batches

#: The bound of the sample that the dictionaries are fitted on: texts of each language, characters of each text.
SAMPLE_ROWS, SAMPLE_CHARS = 512, 1500
DICTIONARY_BYTES = 240_000
#: Rows of the sample's hashes up to which they are broadcast.
MOST_BROADCAST = 1 << 19
LEVEL, SECOND_LEVEL = 6, 12
#: Margins below it are narrow: the text is rejected.
NARROW = 0.002
WORDS = re.compile(r"[^\W\d_]+")


def normalised(text: str | None) -> bytes:
    """A text's lower-case words of letters, joined by spaces; empty if it has no letter."""
    joined = " ".join(WORDS.findall((text or "").lower()))
    return joined.encode() if any(c.isalpha() for c in joined) else b""


def is_held_out(id_col: str = "doc_id"):
    """crc32(id as text) mod 5 is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit_dictionaries(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each label, from rows that are not held out and have text and label. The sample is a bounded one: of
    each label and each of ``rows`` hash classes of texts, the text of least hash, cut to ``chars``, up to ``size`` bytes
    in all. Copies of a text count once, so no hot text fills it. What reaches the driver grows with the number of
    languages alone."""
    learn = df.filter(~is_held_out(id_col) & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    hashed = learn.select(F.col(label_col).alias("label"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    least = settled(hashed.groupBy("label", F.pmod("h", F.lit(rows)).alias("part")).agg(F.min("h").alias("h")).select("label", "h"))
    # Its size is checked: with very many labels the texts are shuffled instead.
    chosen = F.broadcast(least) if least.count() <= MOST_BROADCAST else least
    found = hashed.join(chosen, ["label", "h"]).groupBy("label", "h").agg(F.min(F.substring("text", 1, chars)).alias("text")).collect()
    parts: dict[str, list[bytes]] = {}
    for r in sorted(found, key=lambda r: (r.label, r.h)):
        if body := normalised(r.text):
            parts.setdefault(r.label, []).append(body)
    return {label: b" ".join(bodies)[:size] for label, bodies in parts.items()}


def _compressors(dictionaries: dict[str, bytes], level: int) -> list[zstandard.ZstdCompressor]:
    out = []
    for _, body in sorted(dictionaries.items()):
        d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False))
    return out


def decider(dictionaries: dict[str, bytes], narrow: float = NARROW) -> Callable[[str | None], tuple[str, float, bool]]:
    """A function of one text that gives its language, the margin, and whether the language is accepted."""
    labels = sorted(dictionaries)
    first, second = _compressors(dictionaries, LEVEL), []

    def margin(sizes: list[int]) -> tuple[int, float]:
        best = int(np.argmin(sizes))
        rest = min([x for i, x in enumerate(sizes) if i != best], default=sizes[best] or 1)
        return best, (rest - sizes[best]) / max(rest, 1) if len(sizes) > 1 else 1.0

    def one(text: str | None) -> tuple[str, float, bool]:
        body = normalised(text)
        if not body or not labels:
            return "und", 0.0, False
        best, score = margin([len(c.compress(body)) for c in first])
        if score < narrow:
            if not second:
                second.extend(_compressors(dictionaries, SECOND_LEVEL))
            best, score = margin([len(c.compress(body)) for c in second])
        return labels[best], score, score >= narrow

    return one


def identify(df: DataFrame, dictionaries: dict[str, bytes], narrow: float = NARROW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` of every row. ``score`` is the margin (0 to 1). ``lang_pred`` is ``und``, the
    score 0 and the row rejected where the text is null or has no letter, or no dictionary was learned; ties go to the first
    label in order and are rejected as narrow, unless the second level separates them."""
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)

    def make():
        one = decider(shared.value, narrow)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            pred, score, ok = zip(*map(one, batch.column(1).to_pylist()), strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred), pa.array(score, pa.float64()), pa.array(ok)], ["doc_id", "lang_pred", "score", "accepted"])

        return step

    return mapped(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "doc_id long, lang_pred string, score double, accepted boolean")


def predict_languages(df: DataFrame, narrow: float = NARROW, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted``: dictionaries learned from the rows that are not held out, then
    every row identified by its text alone."""
    found = identify(df, fit_dictionaries(df, id_col, text_col, label_col), narrow, id_col, text_col)
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "accepted")


def keep_identified(df: DataFrame, dictionaries: dict[str, bytes], narrow: float = NARROW, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose language is accepted, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)
    small_batches(df)

    @F.pandas_udf("boolean")
    def accepted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = decider(shared.value, narrow)
        for texts in batches:
            yield pd.Series([one(x)[2] for x in texts], dtype=bool)

    return df.filter(accepted(F.col(text_col)))
