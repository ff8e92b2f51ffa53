"""Reading and writing: transcripts, annotated XML, term and variant lists, learned rules, n-gram models, corrections."""

from __future__ import annotations

import os
from collections.abc import Callable
from tempfile import gettempdir
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import CJK, keep_charset, strip_tags

FORMATS = ("parquet", "json", "orc", "text")
RULES_SCHEMA = "old string, new string, n_sentences bigint, promoted boolean, first_seen bigint, raws array<string>, sketch binary"
# Deprecated forms that are words of their own.
VARIANT_EXCEPTIONS = "标识 份子 佳宾 鸿图 弘图 鸿福 利害 约莫 丫鬟 渔汛 视阈 菁华 慢说".split()


def read_transcripts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table of texts; of text files, each line is a row ``text``."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is none of {FORMATS}")
    df = spark.read.format(fmt).load(path)
    return df.withColumnRenamed("value", "text") if fmt == "text" else df


def extract_corrections(df: DataFrame, raw_col: str = "value") -> DataFrame:
    """``text``: the bodies of all CORRECTION elements of whole files, without tags and characters outside the kept set;
    bodies of fewer than two characters go."""
    bodies = df.select(F.explode(F.regexp_extract_all(raw_col, F.lit("(?s)<CORRECTION[^>]*>(.*?)</CORRECTION>"), F.lit(1))).alias("body"))
    return bodies.select(keep_charset(strip_tags("body")).alias("text")).filter(F.length("text") >= 2)


def _listed(lines: DataFrame) -> DataFrame:
    """``line, parts`` of list lines that are neither blank nor comments."""
    trimmed = lines.withColumn("line", F.trim(F.regexp_replace("value", "\\s", " ")))
    return trimmed.filter((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("parts", F.split("line", " +"))


def parse_terms(lines: DataFrame, *kept: str) -> DataFrame:
    """``word, score``, after the ``kept`` columns, of lines ``word score``; the score is 2.0 where it is absent or no
    number."""
    return _listed(lines).select(*kept, F.col("parts")[0].alias("word"), F.coalesce(F.get("parts", F.lit(1)).try_cast("double"), F.lit(2.0)).alias("score"))


def load_terms(spark: SparkSession, path: str, latin_only: bool = False) -> DataFrame:
    """``ord, word, score`` of a term list file, its lines numbered as they stand."""
    terms = parse_terms(spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()), "ord")
    return terms.filter(F.col("word").rlike("[A-Za-z]")) if latin_only else terms


def parse_variants(lines: DataFrame, order_col: str = "ord") -> DataFrame:
    """``preferred, deprecated`` of lines ``preferred deprecated、deprecated ...``; for a deprecated form listed twice the last
    line wins. Exceptions, forms equal to the preferred one and forms that are not all CJK are left out."""
    listed = _listed(lines).filter(F.size("parts") >= 2)
    forms = listed.select(order_col, F.col("parts")[0].alias("preferred"), F.posexplode(F.split(F.col("parts")[1], "、")).alias("pos", "deprecated"))
    fit = forms.filter(F.col("deprecated").rlike(f"^[{CJK}]+$") & (F.col("deprecated") != F.col("preferred")) & ~F.col("deprecated").isin(VARIANT_EXCEPTIONS))
    return fit.groupBy("deprecated").agg(F.max_by("preferred", F.struct(order_col, "pos")).alias("preferred")).select("preferred", "deprecated")


def load_variants(spark: SparkSession, path: str) -> DataFrame:
    """A variant list file, small enough for one split: its lines are numbered as they stand."""
    return parse_variants(spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()))


# --- stores: every write makes a new snapshot, so a table is never overwritten while it is read ------------------------
#
# A snapshot is a folder of its own under ``data``; it exists for readers once a file under ``versions`` names it. Version files
# are numbered, written elsewhere first, and moved to a number that is free or not at all; so of two writers on top of one
# version the second finds the number taken and begins again on top of the first.

#: Versions that stay readable after newer ones: readers and batches that run again may still need them.
KEPT_VERSIONS = 20


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and a maker of its paths."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    return base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _files(spark, path)
    folder = at(f"{path}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def _version(spark: SparkSession, path: str, number: int) -> list[str]:
    """The folder of a version's data and, if it has one, its batch."""
    fs, at = _files(spark, path)
    stream = fs.open(at(f"{path}/versions/{number}"))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
    finally:
        stream.close()


def _published(spark: SparkSession, path: str, number: int, data: str, batch: str) -> bool:
    """Makes version ``number``, unless there is one."""
    jvm, (fs, at) = spark.sparkContext._jvm, _files(spark, path)
    made, target = at(f"{path}/data/{data}.version"), at(f"{path}/versions/{number}")
    stream = fs.create(made)
    stream.write(f"{data} {batch}".encode())
    stream.close()
    fs.mkdirs(target.getParent())
    if fs.getUri().getScheme() == "file":  # here Hadoop looks first and moves then, and two writers may both find the number free
        try:
            os.link(made.toUri().getPath(), target.toUri().getPath())
        except FileExistsError:
            return False
        fs.delete(made, False)
        return True
    kinds = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:  # does not move onto a file that is there
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(made, target, kinds)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.toString():
            return False
        raise
    return True


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot of a learned-rule store; a missing store is empty."""
    versions = _versions(spark, path)
    return spark.read.schema(RULES_SCHEMA).parquet(f"{path}/data/{_version(spark, path, versions[-1])[0]}") if versions else spark.createDataFrame([], RULES_SCHEMA)


def update_rules(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], batch: str = "", most_tries: int = 20) -> int:
    """The newest snapshot, as ``change`` makes it, becomes the next version, whose number is returned. If another writer made
    that version meanwhile, the change is made again on top of theirs, so nothing is lost. ``batch`` names what is merged
    (letters, digits and dashes) for ``has_batch``. Versions before the KEPT_VERSIONS newest go."""
    fs, at = _files(spark, path)
    for _ in range(most_tries):
        versions = _versions(spark, path)
        held = spark.read.schema(RULES_SCHEMA).parquet(f"{path}/data/{_version(spark, path, versions[-1])[0]}") if versions else spark.createDataFrame([], RULES_SCHEMA)
        number, data = versions[-1] + 1 if versions else 0, uuid4().hex
        change(held).write.parquet(f"{path}/data/{data}")
        if _published(spark, path, number, data, batch):
            for old in versions[: -KEPT_VERSIONS + 1]:
                gone = _version(spark, path, old)[0]
                fs.delete(at(f"{path}/versions/{old}"), False)
                fs.delete(at(f"{path}/data/{gone}"), True)
            return number
        fs.delete(at(f"{path}/data/{data}"), True)
        fs.delete(at(f"{path}/data/{data}.version"), False)
    raise RuntimeError(f"{path}: other writers were faster {most_tries} times")


def write_rules(rules: DataFrame, path: str, batch: str = "") -> int:
    """``rules`` as the next version, whatever the store holds."""
    return update_rules(rules.sparkSession, path, lambda _: rules, batch)


def has_batch(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether one of the kept versions was written for ``batch``."""
    return any(_version(spark, path, n)[1:] == [batch] for n in reversed(_versions(spark, path)))


def clear_rules(spark: SparkSession, path: str) -> None:
    write_rules(spark.createDataFrame([], RULES_SCHEMA), path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` with so many underscores in front that ``df`` has no column of such a name (letter case does not count)."""
    taken, front = {c.lower() for c in df.columns}, "__"
    while any((front + x).lower() in taken for x in names):
        front += "_"
    return [front + x for x in names]


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder that spark.checkpoint.dir names, for plans that use it several times. In a
    session that names none, ``df`` as it is."""
    context = df.sparkSession.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not folder:
            return df
        context.setCheckpointDir(folder)
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a session that names none gets one on the local machine, and must be local."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return f"{folder or gettempdir()}/textloom-{uuid4().hex}"


def write_ngrams(unigrams: DataFrame, bigrams: DataFrame, path: str, trigrams: DataFrame | None = None) -> None:
    for name, df in (("unigrams", unigrams), ("bigrams", bigrams), ("trigrams", trigrams)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_ngrams(spark: SparkSession, path: str, trigrams: bool = False) -> tuple[DataFrame, ...]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("unigrams", "bigrams", *["trigrams"] * trigrams))


def write_corrections(corrected: DataFrame, path: str) -> None:
    """``corrected`` and, by source, ``suggestions`` under ``path``. Both are read from one table, which is written first and goes
    afterwards, as the texts are corrected once."""
    spark, both = corrected.sparkSession, f"{path}/both-{uuid4().hex}"
    fs, at = _files(spark, both)
    try:
        corrected.write.parquet(both)
        held = spark.read.schema(corrected.schema).parquet(both)
        held.drop("suggestions").write.mode("overwrite").parquet(f"{path}/corrected")
        rows = held.select("doc_id", F.posexplode("suggestions").alias("seq", "s")).select("doc_id", "seq", "s.*")
        rows.write.mode("overwrite").partitionBy("source").parquet(f"{path}/suggestions")
    finally:
        fs.delete(at(both), True)
