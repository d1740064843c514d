"""Synthetic streams as expressions over ``spark.range``, and the scenario table.

Only distributions are promised: the draws come from a hash of the seed and the place,
so that any partitioning gives the same stream.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandpack.functions import mavlink


def uniform(seed: int, salt: int = 0) -> Column:
    """[0, 1) from the place ``i``."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("i")), F.lit(1 << 40)) / float(1 << 40)


def between(seed: int, low: int, high: int, salt: int = 0) -> Column:
    return (F.floor(uniform(seed, salt) * (high - low)) + low).cast("bigint")


def normal(seed: int, salt: int = 0) -> Column:
    return F.sqrt(F.lit(-2.0) * F.log(F.greatest(uniform(seed, salt), F.lit(1e-12)))) * F.cos(F.lit(6.283185307179586) * uniform(seed, salt + 1))


def running(step: Column) -> Column:
    from pyspark.sql import Window

    return F.sum(step).over(Window.partitionBy("name").orderBy("i"))


def shapes(seed: int = 42) -> dict[str, Column]:
    """Values by the place ``i`` of named streams (cumulative ones over the stream)."""
    i = F.col("i")
    pattern = F.array(*map(F.lit, (1, 2, 3, 5, 8, 13)))
    return {
        "Sequential": i + 1, "Random": between(seed, -1000, 1000), "Sparse": F.when(uniform(seed) < 0.95, 0).otherwise(between(seed, 10000, 50000, 1)),
        "Dense": between(seed, -10, 10), "SineWave": (F.sin(i * 0.1) * 100).cast("bigint"), "Constant": F.lit(42), "WorstCase": F.when(i % 2 == 0, (1 << 31) - 1).otherwise(-(1 << 31)),
        "MonotonicVariable": running(between(seed, 1, 100)), "Gaussian": (normal(seed) * 100).cast("bigint"), "RepeatingPattern": F.get(pattern, (i % 6).cast("int")),
        "AllPositive": between(seed, 1, 1000), "AllNegative": between(seed, -1000, 0), "AllZeros": F.lit(0), "Zigzag": F.when(i % 2 == 0, 100).otherwise(-100),
    }


def stream(spark: SparkSession, name: str, n: int, seed: int = 42) -> DataFrame:
    """(name, i, v) of one named shape."""
    return spark.range(n).select(F.lit(name).alias("name"), F.col("id").alias("i")).withColumn("v", shapes(seed)[name].cast("bigint"))


def telemetry(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """(name, i, c0..c5): slow walks with jitter, as position, height, speed and two angles would give."""
    base = spark.range(n).select(F.lit("telemetry").alias("name"), F.col("id").alias("i"))
    walk = lambda k, step, start: running(between(seed, -step, step + 1, k)) + start
    return base.select("name", "i", *(walk(k, s, z).cast("bigint").alias(f"c{k}") for k, (s, z) in enumerate([(12, 410_000_000), (12, 290_000_000), (8, 100_000), (5, 1500), (20, 0), (20, 0)])))


#: (name, category, shape, values, expected); shapes that may be refused expect REJECTED too.
SCENARIOS = [(f"{shape}-{n}", category, shape, n) for category, sizes in (("basic", (10, 100)), ("large", (10_000,))) for shape in ("Sequential", "Random", "Sparse", "Dense", "SineWave", "Constant", "WorstCase", "MonotonicVariable", "Gaussian", "RepeatingPattern", "AllPositive", "AllNegative", "AllZeros", "Zigzag") for n in sizes] + [("Single", "edge", "Constant", 1), ("Empty", "edge", "Constant", 0), ("Nine", "edge", "Sequential", 9)]


def scenarios(spark: SparkSession, category: str | None = None) -> DataFrame:
    rows = [s for s in SCENARIOS if category is None or s[1].lower() == category.lower()]
    return spark.createDataFrame(rows, "name string, category string, shape string, n int")


def find(name: str):
    return next((s for s in SCENARIOS if s[0].lower() == name.lower()), None)


def locate(name: str, start: str, levels: int = 8) -> str | None:
    """A data file beside ``start`` or up to ``levels`` folders above it."""
    at = os.path.abspath(start)
    for _ in range(levels):
        if os.path.exists(path := os.path.join(at, name)):
            return path
        at = os.path.dirname(at)
    return None


def messages(spark: SparkSession, profile: str, seconds: float) -> DataFrame:
    """(t, msgid, place, ordinal) of all messages due up to ``seconds``, earliest first, ties in schema order."""
    rates = dict(zip(mavlink.GROUPS, mavlink.PROFILES[profile]))
    rows = [(m.msgid, k, float(rates[m.group])) for k, m in enumerate(mavlink.MESSAGES.values()) if rates[m.group] > 0]
    due = spark.createDataFrame(rows, "msgid int, place int, hz double")
    count = F.floor((F.lit(seconds) - F.col("place") * 0.017) * F.col("hz") + 1e-9)
    each = due.filter(count >= 0).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), count.cast("bigint"))).alias("ordinal"))
    return each.select((F.col("place") * 0.017 + F.col("ordinal") / F.col("hz")).alias("t"), "msgid", "place", "ordinal").orderBy("t", "place")
