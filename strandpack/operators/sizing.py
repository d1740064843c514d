"""Encoded sizes of the block-adaptive patched format as pure relational plans.

A stream's size is closed form: eight deltas make a block, a block's width follows from
its largest inlier, long runs of zero blocks collapse to one escape, two tests refuse
streams that do not compress. One shuffle by stream serves all windows and aggregates of
a core size; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandpack.functions import ints

# Fixed values of the format: (largest inlier, bits) by mode, and limits.
WIDTHS = [(0, 0), (1, 2), (3, 3), (7, 4), (15, 5), (127, 8), (511, 10), (32767, 16)]
BLOCK = 8
OUTLIER = 32767
RUN_LEAST, RUN_MOST, RUN_BITS = 8, 65535, 28
GATE_SAMPLE, GATE_SHARE, GATE_MEAN, GATE_LARGE = 1000, 0.30, 536_870_911, 1_073_741_823
ABORT_AT, ABORT_RATIO = 64, 1.5
ORDER_SAMPLE = 512
FRAME_HEADER = 10

REJECTED = -1


def width(m: Column) -> Column:
    out = F.when(m <= WIDTHS[0][0], F.lit(WIDTHS[0][1]))
    for most, bits in WIDTHS[1:-1]:
        out = out.when(m <= most, F.lit(bits))
    return out.otherwise(F.lit(WIDTHS[-1][1]))


def deltas(streams: DataFrame, keys: list[str]) -> DataFrame:
    """Adds d, the wrapping difference to the value before (null for the first)."""
    return streams.withColumn("d", ints.sub32("v", F.lag("v").over(Window.partitionBy(*keys).orderBy("i"))))


def blocks(streams: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of (keys, i, v): blk, n, n_out, m (largest inlier), zero, and each stream's length n_all.

    The first value is a block -1 of its own, without bits, so that streams of one value stay.
    """
    rows = deltas(streams, keys).withColumn("n_all", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    size, mag = ints.abs64("d"), ints.abs32("d")
    tenth = F.floor(F.col("n_all") / 10)
    sample = F.when(tenth < 10, F.least(F.col("n_all"), F.lit(100))).otherwise(F.least(tenth, F.lit(GATE_SAMPLE)))
    seen = (F.col("i") >= 1) & (F.col("i") < sample)
    return rows.groupBy(*keys, F.when(F.col("i") == 0, F.lit(-1)).otherwise(F.floor((F.col("i") - 1) / BLOCK)).cast("bigint").alias("blk")).agg(
        F.count("d").alias("n"),
        F.count(F.when(size > OUTLIER, 1)).alias("n_out"),
        F.coalesce(F.max(F.when(size <= OUTLIER, size)), F.lit(0)).alias("m"),
        (F.coalesce(F.max(size) == 0, F.lit(False)) & (F.count("d") == BLOCK)).alias("zero"),
        F.max("n_all").alias("n_all"),
        F.max(sample).alias("sample"),
        F.sum(F.when(seen, mag).otherwise(F.lit(0))).alias("gate_sum"),
        F.count(F.when(seen & (mag > OUTLIER), 1)).alias("gate_out"),
        F.coalesce(F.max(F.when(seen, mag)), F.lit(0)).alias("gate_max"),
    )


def runs(blks: DataFrame, keys: list[str]) -> DataFrame:
    """Adds escaped (the block is part of a collapsed run), bits, and bits_so_far."""
    order = Window.partitionBy(*keys).orderBy("blk")
    out = blks.withColumn("island", F.sum(F.when(F.col("zero"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    same = Window.partitionBy(*keys, "island", "zero")
    out = out.withColumn("pos", F.row_number().over(same.orderBy("blk")) - 1).withColumn("run", F.count(F.lit(1)).over(same))
    chunk = F.floor(F.col("pos") / RUN_MOST)
    out = out.withColumn("escaped", F.col("zero") & (F.least(F.lit(RUN_MOST), F.col("run") - chunk * RUN_MOST) >= RUN_LEAST))
    plain = F.lit(4) + F.when(F.col("n_out") > 0, 8).otherwise(0) + (F.col("n") - F.col("n_out")) * width(F.col("m")) + F.lit(32) * F.col("n_out")
    bits = F.when(F.col("blk") < 0, F.lit(0)).when(F.col("escaped"), F.when(F.col("pos") % RUN_MOST == 0, RUN_BITS).otherwise(0)).otherwise(plain).cast("bigint")
    out = out.withColumn("bits", bits)
    return out.withColumn("bits_so_far", F.sum("bits").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def as_float(x: Column) -> Column:
    return x.cast("float")


def decisions(blks: DataFrame, keys: list[str], referenced: Column) -> DataFrame:
    """Per stream: n, bits, gate_ok, aborted."""
    end = F.least(F.lit(1) + (F.col("blk") + 1) * BLOCK, F.col("n_all"))
    first = (F.col("blk") >= 0) & ~F.col("escaped") & (end >= F.least(F.lit(ABORT_AT), F.col("n_all")))
    per = blks.groupBy(*keys).agg(
        F.max("n_all").alias("n"), F.sum("bits").cast("bigint").alias("bits"), F.max("sample").alias("sample"),
        F.sum("gate_sum").alias("gate_sum"), F.sum("gate_out").alias("gate_out"), F.max("gate_max").alias("gate_max"),
        F.min(F.when(first, F.struct("blk", end.alias("at"), "bits_so_far"))).alias("look"),
    )
    share = as_float(F.col("gate_out").cast("double") / F.nullif(F.col("sample") - 1, F.lit(0)))
    limit = F.lit(GATE_SHARE).cast("float")
    third = as_float(limit.cast("double") / 3)
    mean = F.floor(F.abs(F.col("gate_sum")) / F.greatest(F.col("sample") - 1, F.lit(1))) * F.signum("gate_sum")
    refused = (share > limit) | (mean > GATE_MEAN) | ((F.col("gate_max") > GATE_LARGE) & (share > third))
    flushed = F.floor(F.col("look.bits_so_far") / 8) + F.when(referenced, 4).otherwise(0)
    poor = (F.col("look.at") < F.col("n")) & (flushed > 0) & (as_float(F.col("look.at") * 4.0 / F.nullif(flushed, F.lit(0))) < F.lit(ABORT_RATIO).cast("float"))
    return per.select(*keys, "n", "bits", ((F.col("n") < 2) | ~F.coalesce(refused, F.lit(False))).alias("gate_ok"), F.coalesce(poor, F.lit(False)).alias("aborted"))


def core_size(streams: DataFrame, keys: list[str], referenced: Column | None = None) -> DataFrame:
    """(keys, n, bytes): the size of each stream (keys, i, v), -1 if it is refused.

    ``referenced``: whether the first value is part of the stream (a key column or literal).
    """
    referenced = F.lit(True) if referenced is None else referenced
    per = decisions(runs(blocks(streams, keys), keys), keys, referenced)
    size = F.when(referenced, 4).otherwise(0) + ints.ceil_div("bits", 8)
    return per.select(*keys, "n", F.when(F.col("gate_ok") & ~F.col("aborted"), size).otherwise(F.lit(REJECTED)).cast("bigint").alias("bytes"))


def order_choice(channels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m, sum1, sum2, second) of channels (keys, i, v): second if second differences are smaller."""
    w = Window.partitionBy(*keys).orderBy("i")
    rows = deltas(channels, keys).withColumn("dd", ints.sub32("d", F.lag("d").over(w)))
    near = F.col("i") < ORDER_SAMPLE
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.sum(F.when(near, ints.abs64("d"))), F.lit(0)).cast("bigint").alias("sum1"), F.coalesce(F.sum(F.when(near, ints.abs64("dd"))), F.lit(0)).cast("bigint").alias("sum2"))
    return per.withColumn("second", (F.col("m") >= 3) & (F.col("sum2") < F.col("sum1")))


def channel_payloads(samples: DataFrame, unit: list[str], channels: int) -> DataFrame:
    """(unit, ch, second, raw, bytes): what each channel of a unit takes; ch -1 is the reference block.

    ``samples`` has unit, i (record within the unit), ch and v.
    """
    keys = [*unit, "ch"]
    w = Window.partitionBy(*keys)
    rows = deltas(samples, keys).withColumn("dd", ints.sub32("d", F.lag("d").over(w.orderBy("i"))))
    near = F.col("i") < ORDER_SAMPLE
    total = lambda c: F.coalesce(F.sum(F.when(near, ints.abs64(c))).over(w), F.lit(0))
    rows = rows.withColumn("second", (F.count(F.lit(1)).over(w) >= 3) & (total("dd") < total("d")))
    own = rows.filter(~F.col("second") | (F.col("i") > 0)).select(*keys, "second", F.when(F.col("second"), F.col("i") - 1).otherwise(F.col("i")).alias("i"), F.when(F.col("second"), F.col("d")).otherwise(F.col("v")).alias("v"), F.col("second").alias("referenced"))
    first = samples.filter("i = 0").groupBy(*unit).agg(F.map_from_entries(F.collect_list(F.struct("ch", "v"))).alias("by_ch"))
    block = first.select(*unit, F.lit(-1).alias("ch"), F.lit(False).alias("second"), F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("i"), "by_ch")
    block = block.select(*unit, "ch", "second", F.col("i").cast("bigint").alias("i"), F.coalesce(F.try_element_at("by_ch", F.col("i")), F.lit(0)).alias("v"), F.lit(True).alias("referenced"))
    sizes = core_size(own.unionByName(block), [*keys, "second", "referenced"], F.col("referenced"))
    raw = F.when(F.col("ch") < 0, F.lit(4 * channels)).when(F.col("second"), F.col("n") * 4).otherwise((F.col("n") - 1) * 4).cast("bigint")
    fits = (F.col("bytes") > 0) & (F.col("bytes") < raw) & ((F.col("ch") >= 0) | F.lit(channels >= 3))
    return sizes.select(*unit, "ch", "second", raw.alias("raw"), F.when(fits, F.col("bytes")).otherwise(raw).alias("bytes"), (~fits).alias("passed"))


def channel_size(samples: DataFrame, unit: list[str], channels: int) -> DataFrame:
    """(unit, bytes): header, reference block and channels of each unit."""
    header = 2 + 2 * ((channels + 7) // 8)
    return channel_payloads(samples, unit, channels).groupBy(*unit).agg((F.sum("bytes") + F.lit(header)).cast("bigint").alias("bytes"))
