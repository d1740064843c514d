"""Sizes of published integer codecs on delta-zigzag channels, as relational plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandpack.functions import ints

TILE, SPRINTZ_RUN, MOST_EXCEPTIONS = 128, 255, 127
FAMILY = ("vbyte", "svb", "bp128", "optpfd", "simple8b")


def zigzagged(samples: DataFrame, unit: list[str]) -> DataFrame:
    """Adds u (delta-zigzag, element 0 against 0) and bw to (unit, ch, i, v)."""
    before = F.lag("v", 1, 0).over(Window.partitionBy(*unit, "ch").orderBy("i"))
    rows = samples.withColumn("u", ints.zigzag(ints.sub32("v", before)))
    return rows.withColumn("bw", ints.bit_width("u"))


def family_sizes(samples: DataFrame, unit: list[str]) -> DataFrame:
    """(unit, ch, n, vbyte, svb, bp128, optpfd) bytes of each channel.

    One aggregate per tile of 128 holds all that the four need: the counts of values
    above each width give every patched width's cost, whose least is taken directly.
    """
    rows = zigzagged(samples, unit)
    above = [F.count(F.when(F.col("bw") > b, 1)).alias(f"e{b}") for b in range(33)]
    tiles = rows.groupBy(*unit, "ch", F.floor(F.col("i") / TILE).alias("tile")).agg(
        F.count(F.lit(1)).alias("n"), F.max("bw").alias("widest"),
        F.sum(F.greatest(F.lit(1), ints.ceil_div("bw", 7))).alias("vb"), F.sum(ints.svb_length("u")).alias("sv"), *above)
    cost = F.least(*(F.when(F.col(f"e{b}") <= MOST_EXCEPTIONS, F.lit(16 + TILE * b) + F.col(f"e{b}") * (40 - b)) for b in range(33)))
    full = F.col("n") == TILE
    per = tiles.groupBy(*unit, "ch").agg(
        F.sum("n").cast("bigint").alias("n"), F.sum("vb").cast("bigint").alias("vbyte"), F.sum("sv").alias("sv"),
        F.sum(F.when(full, F.lit(1) + F.col("widest") * (TILE // 8)).otherwise(F.col("vb"))).cast("bigint").alias("bp128"),
        F.sum(F.when(full, cost).otherwise(0)).alias("patched"), F.sum(F.when(full, 0).otherwise(F.col("vb"))).alias("tail"))
    return per.select(*unit, "ch", "n", "vbyte", (ints.ceil_div("n", 4) + F.col("sv")).cast("bigint").alias("svb"), "bp128", (ints.ceil_div("patched", 8) + F.col("tail")).cast("bigint").alias("optpfd"))


def best_width(samples: DataFrame, unit: list[str]) -> DataFrame:
    """(unit, ch, tile, b, bits): the patched width of least cost (the first of equals) of each full tile."""
    rows = zigzagged(samples, unit).groupBy(*unit, "ch", F.floor(F.col("i") / TILE).alias("tile"))
    tiles = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col("bw") > b, 1)).alias(f"e{b}") for b in range(33))).filter(F.col("n") == TILE)
    offers = F.array(*(F.struct(F.when(F.col(f"e{b}") <= MOST_EXCEPTIONS, F.lit(16 + TILE * b) + F.col(f"e{b}") * (40 - b)).alias("bits"), F.lit(b).alias("b")) for b in range(33)))
    best = F.array_min(F.filter(offers, lambda x: x["bits"].isNotNull()))
    return tiles.select(*unit, "ch", "tile", best.alias("x")).select(*unit, "ch", "tile", F.col("x.b").alias("b"), F.col("x.bits").cast("bigint").alias("bits"))


def width_histogram(samples: DataFrame, unit: list[str]) -> DataFrame:
    return zigzagged(samples, unit).groupBy("ch", "bw").agg(F.count(F.lit(1)).alias("n"))


def sprintz_size(samples: DataFrame, unit: list[str], channels: int) -> DataFrame:
    """(unit, n_rec, sprintz) bytes: records in blocks of eight, zero blocks in runs."""
    before = F.lag("v").over(Window.partitionBy(*unit, "ch").orderBy("i"))
    rows = samples.withColumn("bw", ints.bit_width(ints.zigzag(ints.sub32("v", before)))).withColumn("blk", F.when(F.col("i") > 0, F.floor((F.col("i") - 1) / 8)).otherwise(F.lit(-1)))
    per_ch = rows.groupBy(*unit, "blk", "ch").agg(F.coalesce(F.max("bw"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n"))
    blk = per_ch.groupBy(*unit, "blk").agg(F.sum("b").alias("b"), F.max("n").alias("n"))
    blk = blk.withColumn("zero", (F.col("b") == 0) & (F.col("n") == 8) & (F.col("blk") >= 0))
    order = Window.partitionBy(*unit).orderBy("blk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blk = blk.withColumn("island", F.sum(F.when(F.col("zero"), 0).otherwise(1)).over(order))
    blk = blk.withColumn("pos", F.row_number().over(Window.partitionBy(*unit, "island", "zero").orderBy("blk")) - 1)
    bits = F.when(F.col("blk") < 0, F.lit(32 * channels)).when(F.col("zero"), F.when(F.col("pos") % SPRINTZ_RUN == 0, 9).otherwise(0)).when(F.col("n") == 8, F.lit(1 + 6 * channels) + F.col("b") * 8).otherwise(F.col("n") * (32 * channels))
    return blk.groupBy(*unit).agg(F.sum("n").cast("bigint").alias("n_rec"), ints.ceil_div(F.sum(bits), 8).alias("sprintz"))


def with_header(sizes: DataFrame, unit: list[str], channels: int, codecs: list[str]) -> DataFrame:
    """Family codecs' bytes of a unit: a header of 1 + 4 per channel, then the channels."""
    return sizes.groupBy(*unit).agg(*((F.sum(c) + F.lit(1 + 4 * channels)).cast("bigint").alias(c) for c in codecs))
