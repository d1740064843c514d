"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandpack.llm import common


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b longs) other than the roots.

    A root is its component's smallest node. Each round is a large-star and a
    small-star step; the smallest neighbours are written before the links are joined to
    them, so that the join of a node with very many links can be split.
    """
    spark = links.sparkSession

    def tidy(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

    def state(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())

    links = common.written(tidy(links), "links")
    was = state(links)
    for _ in range(most_rounds):
        if not was[0]:
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least").withColumnRenamed("a", "u")
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = common.written(tidy(large), "large-star")
        least = common.written(large.groupBy("a").agg(F.min("b").alias("m")), "least").withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u"))
        # both the smaller neighbours and the node itself hang on the smallest
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        links = common.written(tidy(small), "small-star")
        now = state(links)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
