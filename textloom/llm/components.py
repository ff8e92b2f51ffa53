"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import settled


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on undirected edges ``a, b`` (a <> b). Minima are pre-aggregated, so a node with most of the edges is no
    hot key; the join back is one that Spark splits."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    joined = both.join(low, "a")
    out = joined.filter(F.col("b") > F.col("a")) if large else joined.filter(F.col("b") != F.col("low"))
    out = out.select(F.col("b").alias("a"), F.col("low").alias("b"))
    if not large:
        out = out.unionByName(low.select("a", F.col("low").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``a, component``: for each node of ``edges`` (``a, b``, any order, repeats allowed) but the components' least nodes
    themselves, the least node that it reaches. No edges give no rows. Ends when a round of both steps changes nothing;
    the number of rounds grows with the logarithm of the longest path."""
    edges = settled(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0)), F.coalesce(F.sum(F.col("a").cast("decimal(20,0)")), F.lit(0))).first()
        if now == before or now[0] == 0:
            return edges.select("a", F.col("b").alias("component"))
        before = now
        edges = settled(_star(_star(edges, large=True), large=False))
