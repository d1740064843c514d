"""Comparison reports: dominance, rankings, summaries and exact-index percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pareto(rows: DataFrame, keys: list[str], good: list[str]) -> DataFrame:
    """Rows that no other row of the same keys beats: as good in all of ``good`` and better in one."""
    other = rows.select(*(F.col(c).alias(f"o_{c}") for c in [*keys, *good]))
    same = [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys]
    no_worse = [F.col(f"o_{g}") >= F.col(g) for g in good]
    better = None
    for g in good:
        better = (F.col(f"o_{g}") > F.col(g)) if better is None else better | (F.col(f"o_{g}") > F.col(g))
    condition = better
    for c in [*same, *no_worse]:
        condition = condition & c
    return rows.join(other, condition, "left_anti")


def top(rows: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    return rows.orderBy(F.col(by).desc(), tie).limit(n)


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Values at the index trunc((n - 1) * q) of each group in ascending order."""
    w = Window.partitionBy(*keys)
    placed = rows.select(*keys, value, F.row_number().over(w.orderBy(value)).alias("_place"), F.count(F.lit(1)).over(w).alias("_size"))
    at = lambda q: F.floor((F.col("_size") - 1) * q) + 1
    return placed.groupBy(*keys).agg(F.max("_size").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), *(F.max(F.when(F.col("_place") == at(q), F.col(value))).alias(f"p{q * 100:g}".replace(".", "_")) for q in shares))


def summary(results: DataFrame) -> DataFrame:
    """By category: counts by status, mean ratio of those that passed, share that did not fail (refused counts as success)."""
    status = lambda s: F.count(F.when(F.col("status") == s, 1))
    return results.groupBy("category").agg(F.count(F.lit(1)).alias("n"), status("PASS").alias("passed"), status("REJECTED").alias("rejected"), status("FAIL").alias("failed"), F.avg(F.when(F.col("status") == "PASS", F.col("ratio"))).alias("mean_ratio"), (F.lit(1.0) - status("FAIL") / F.count(F.lit(1))).alias("success"))


def counters(results: DataFrame) -> DataFrame:
    """Number of results by layer and status."""
    return results.groupBy("layer", "status").agg(F.count(F.lit(1)).alias("n"))


def write_csv(rows: DataFrame, path: str) -> None:
    """Result rows as CSV files with a header, by Spark's own writer, so into any store."""
    rows.write.option("header", True).csv(path)


def read_csv(like: DataFrame, path: str) -> DataFrame:
    """Rows that ``write_csv`` wrote, with the columns of ``like``."""
    return like.sparkSession.read.schema(like.schema).option("header", True).csv(path)
