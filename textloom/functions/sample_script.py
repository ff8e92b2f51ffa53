"""The driver's texts hold no CJK. For queries over the given tables their letters are mapped to CJK characters one to one,
so that the rules for Chinese run over whole tables and texts, and DuckDB can make the same input."""

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz,.;!?"
SCRIPT = "一把它得的切入了十他个啊什在二么再地百三分之吧接呢说，。；！？"


def as_script(text: Column | str) -> Column:
    return F.translate(text, LETTERS, SCRIPT)


def as_script_sql(text: str) -> str:
    return f"translate({text}, '{LETTERS}', '{SCRIPT}')"
