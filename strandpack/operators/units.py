"""Sizes of short units, such as frames, each held in one row as an array of values per channel.

The closed forms are those of ``sizing`` and ``rivals``, which cut long streams by windows
over a row a value. Here a unit's row has all that its size needs, so that after the
records are gathered nothing is sorted, shuffled or kept: memory does not grow with the
number of units. Arrays hold bigints that stand for int32; no Python runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandpack.functions import ints
from strandpack.operators import rivals, sizing


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is worked out once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _long(x) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("bigint")


def _upto(n: Column) -> Column:
    """0 to n - 1, or nothing."""
    return F.when(n > 0, F.sequence(_long(0), _long(n - 1))).otherwise(F.array().cast("array<bigint>"))


def total(xs: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(xs, _long(0), lambda acc, x: _long(acc + F.coalesce(f(x), F.lit(0))))


def piece(xs: Column, at: Column, size) -> Column:
    """``size`` elements from element ``at``, counted from 0."""
    return F.slice(xs, (at + 1).cast("int"), F.lit(size) if isinstance(size, int) else size.cast("int"))


def gather(records: DataFrame, channels: int, per_frame: int) -> DataFrame:
    """(stream, frame, n_rec, vs) of wide records; ``vs`` has an array of values per channel."""
    columns = [f"c{k}" for k in range(channels)]
    cut = records.select("stream", F.floor(F.col("rec") / per_frame).cast("bigint").alias("frame"), "rec", *columns)
    units = cut.groupBy("stream", "frame").agg(F.sort_array(F.collect_list(F.struct("rec", *columns))).alias("xs"))
    return units.select("stream", "frame", F.size("xs").cast("bigint").alias("n_rec"), F.array(*(F.col("xs").getField(c) for c in columns)).alias("vs"))


def differences(v: Column) -> Column:
    """The wrapping differences of neighbours."""
    rest = F.greatest(F.size(v) - 1, F.lit(0))
    return F.zip_with(F.slice(v, F.lit(2), rest), F.slice(v, F.lit(1), rest), ints.sub32)


# -- the native format -----------------------------------------------------------------


def _known(s: Column) -> Column:
    """Elements that are not null. No magnitude is -1, so only a null leaves its search open."""
    return F.when(F.array_contains(s, F.lit(-1).cast("bigint")).isNull(), F.size(F.filter(s, lambda y: y.isNotNull()))).otherwise(F.size(s))


def _plain(s: Column, most: Column) -> Column:
    """Bits of a block of magnitudes that is not part of a collapsed run."""
    out = F.size(F.filter(s, lambda y: y > sizing.OUTLIER))
    inlier = F.coalesce(F.array_max(F.filter(s, lambda y: y <= sizing.OUTLIER)), F.lit(0))
    mixed = F.lit(12) + (_known(s) - out) * sizing.width(inlier) + F.lit(32) * out
    return F.when(most > sizing.OUTLIER, mixed).otherwise(F.lit(4) + _known(s) * sizing.width(F.coalesce(most, F.lit(0))))


def _gate_ok(x: Column, n: Column) -> Column:
    """What ``sizing.decisions`` asks of the first tenth, of differences x of n values."""
    tenth = F.floor(n / 10)
    sample = F.when(tenth < 10, F.least(n, F.lit(100))).otherwise(F.least(tenth, F.lit(sizing.GATE_SAMPLE)))

    def refused(mags: Column) -> Column:
        share = sizing.as_float(F.size(F.filter(mags, lambda m: m > sizing.OUTLIER)).cast("double") / F.nullif(sample - 1, F.lit(0)))
        limit = F.lit(sizing.GATE_SHARE).cast("float")
        third = sizing.as_float(limit.cast("double") / 3)
        added = total(mags, lambda m: m)
        mean = F.floor(F.abs(added) / F.greatest(sample - 1, F.lit(1))) * F.signum(added)
        return (share > limit) | (mean > sizing.GATE_MEAN) | ((F.greatest(F.array_max(mags), F.lit(0)) > sizing.GATE_LARGE) & (share > third))

    seen = F.slice(x, F.lit(1), F.greatest(sample - 1, F.lit(0)).cast("int"))
    return (n < 2) | ~F.coalesce(let(F.transform(seen, ints.abs32), refused), F.lit(False))


def _folded(a: Column, blocks: Column, n: Column, referenced: Column) -> Column:
    """Bits of eight blocks or more, null if the early look refuses them. A run of zero blocks is settled when it ends."""
    blk = lambda b: piece(a, b * sizing.BLOCK, sizing.BLOCK)
    # the first look is at the block that brings the values to ABORT_AT, or at the next that is not collapsed
    first = -(-(sizing.ABORT_AT - 1) // sizing.BLOCK) - 1

    def settled(acc: Column, b: Column) -> Column:
        """``acc`` with the run before block b in its bits."""
        whole, rest = F.floor(acc["run"] / sizing.RUN_MOST), acc["run"] % sizing.RUN_MOST
        before = acc["bits"] + whole * sizing.RUN_BITS
        loose = F.when(rest < sizing.RUN_LEAST, rest).otherwise(F.lit(0))
        at = F.greatest(b - loose, F.lit(first))
        looks = acc["look"].isNull() & (at < b)
        return F.struct(_long(before + F.when(rest < sizing.RUN_LEAST, rest * 4).otherwise(F.lit(sizing.RUN_BITS))).alias("bits"), _long(0).alias("run"), _long(F.when(looks, at).otherwise(acc["look"])).alias("look"), _long(F.when(looks, before + (at - (b - loose) + 1) * 4).otherwise(acc["looked"])).alias("looked"))

    def step(acc: Column, b: Column) -> Column:
        def of(s: Column, most: Column) -> Column:
            zero = F.coalesce(most == 0, F.lit(False)) & (_known(s) == sizing.BLOCK)

            def add(done: Column) -> Column:
                bits = _long(done["bits"] + _plain(s, most))
                looks = done["look"].isNull() & (b >= first)
                return F.struct(bits.alias("bits"), _long(0).alias("run"), _long(F.when(looks, b).otherwise(done["look"])).alias("look"), _long(F.when(looks, bits).otherwise(done["looked"])).alias("looked"))

            more = F.struct(acc["bits"].alias("bits"), _long(acc["run"] + 1).alias("run"), acc["look"].alias("look"), acc["looked"].alias("looked"))
            return F.when(zero, more).otherwise(let(F.when(acc["run"] > 0, settled(acc, b)).otherwise(acc), add))

        return let(blk(b), lambda s: let(F.array_max(s), lambda most: of(s, most)))

    def judged(done: Column) -> Column:
        at = F.least(F.lit(1) + (done["look"] + 1) * sizing.BLOCK, n)
        flushed = F.floor(done["looked"] / 8) + F.when(referenced, 4).otherwise(0)
        poor = (at < n) & (flushed > 0) & (sizing.as_float(at * 4.0 / F.nullif(flushed, F.lit(0))) < F.lit(sizing.ABORT_RATIO).cast("float"))
        return F.when(~F.coalesce(poor, F.lit(False)), done["bits"])

    none = F.lit(None).cast("bigint")
    start = F.struct(_long(0).alias("bits"), _long(0).alias("run"), none.alias("look"), none.alias("looked"))
    return let(F.aggregate(_upto(blocks), start, step), lambda acc: let(F.when(acc["run"] > 0, settled(acc, _long(blocks))).otherwise(acc), judged))


def core_size(x: Column, n: Column, referenced: Column) -> Column:
    """Bytes of a stream of n values with differences x, -1 if it is refused."""

    def of(a: Column) -> Column:
        blocks = ints.ceil_div(F.size(x), sizing.BLOCK)
        # fewer blocks hold no run to collapse and end before the early look
        few = total(_upto(blocks), lambda b: let(piece(a, b * sizing.BLOCK, sizing.BLOCK), lambda s: let(F.array_max(s), lambda most: _plain(s, most))))
        bits = F.when(blocks < sizing.RUN_LEAST, few).otherwise(_folded(a, blocks, n, referenced))
        size = F.when(referenced, 4).otherwise(0) + ints.ceil_div(bits, 8)
        # without an outlier no gate refuses
        refused = F.when(F.array_max(a) > sizing.OUTLIER, ~_gate_ok(x, n)).otherwise(F.lit(False))
        return _long(F.when(refused, sizing.REJECTED).otherwise(F.coalesce(size, F.lit(sizing.REJECTED))))

    return let(F.transform(x, ints.abs64), of)


def payload(v: Column) -> Column:
    """Bytes of a channel of a unit, whichever differences are smaller, raw if it does not compress."""
    n = _long(F.size(v))
    near = lambda x, most: total(F.slice(x, F.lit(1), F.lit(most)), ints.abs64)

    def of(d: Column, dd: Column) -> Column:
        second = (n >= 3) & (near(dd, sizing.ORDER_SAMPLE - 2) < near(d, sizing.ORDER_SAMPLE - 1))
        own = let(second, lambda s: let(F.when(s, dd).otherwise(d), lambda x: core_size(x, n - F.when(s, 1).otherwise(0), s)))
        raw = _long((n - 1) * 4)
        return let(own, lambda size: F.when((size > 0) & (size < raw), size).otherwise(raw))

    return let(differences(v), lambda d: let(differences(d), lambda dd: of(d, dd)))


def channel_size(vs: Column, channels: int) -> Column:
    """Bytes of a unit: header, reference block and channels."""
    header, raw = 2 + 2 * ((channels + 7) // 8), 4 * channels
    block: Column = F.lit(raw)
    if channels >= 3:
        first = F.transform(vs, lambda v: F.coalesce(F.get(v, F.lit(0)), _long(0)))
        own = let(differences(first), lambda x: core_size(x, _long(channels), F.lit(True)))
        block = let(own, lambda size: F.when((size > 0) & (size < raw), size).otherwise(F.lit(raw)))
    return _long(F.lit(header) + block + total(vs, lambda v: F.when(F.size(v) > 0, payload(v))))


def frame_size(units: DataFrame, channels: int) -> DataFrame:
    """(stream, frame, n_rec, bytes) of gathered frames, their headers included."""
    return units.select("stream", "frame", "n_rec", (channel_size(F.col("vs"), channels) + sizing.FRAME_HEADER).alias("bytes"))


def swept(units: DataFrame, channels: int, sizes: tuple[int, ...]) -> DataFrame:
    """(per_frame, frames, bytes, largest, raw) of all frame sizes, from units that hold whole frames of each."""

    def cut(per: Column) -> Column:
        one = lambda k: channel_size(F.transform("vs", lambda v: piece(v, k * per, per)), channels) + sizing.FRAME_HEADER
        return let(F.transform(_upto(ints.ceil_div("n_rec", per)), one), lambda bs: F.struct(per.alias("per_frame"), _long(F.size(bs)).alias("frames"), total(bs, lambda b: b).alias("bytes"), F.array_max(bs).alias("largest")))

    rows = units.select("n_rec", F.explode(F.transform(F.array(*map(F.lit, sizes)), cut)).alias("x")).select("n_rec", "x.*")
    return rows.groupBy("per_frame").agg(F.sum("frames").alias("frames"), F.sum("bytes").alias("bytes"), F.max("largest").alias("largest"), (F.sum("n_rec") * (4 * channels)).alias("raw"))


# -- rivals ----------------------------------------------------------------------------


def _vbyte(u: Column) -> Column:
    return F.when(u < 1 << 7, 1).when(u < 1 << 14, 2).when(u < 1 << 21, 3).when(u < 1 << 28, 4).otherwise(5)


def zigzagged(vs: Column) -> Column:
    """Delta-zigzag channels, element 0 against 0."""
    return F.transform(vs, lambda v: F.transform(differences(F.concat(F.array(_long(0)), v)), ints.zigzag))


def family(us: Column, channels: int) -> dict[str, Column]:
    """Bytes of a unit of delta-zigzag channels in each codec of ``rivals.family_sizes``, their header included."""
    tile = rivals.TILE
    tiles = lambda u: _upto(F.floor(F.size(u) / tile))
    tail = lambda u: F.slice(u, (F.floor(F.size(u) / tile) * tile + 1).cast("int"), F.lit(tile))
    of = lambda u, t: piece(u, t * tile, tile)

    def patched(s: Column) -> Column:
        beyond = lambda b: F.size(F.filter(s, lambda u: u >= F.call_function("shiftleft", _long(1), b.cast("int"))))
        cost = lambda b: let(beyond(b), lambda e: F.when(e <= rivals.MOST_EXCEPTIONS, _long(F.lit(16) + b * tile + e * (F.lit(40) - b))))
        return F.array_min(F.transform(_upto(F.lit(33)), cost))

    sizes = {
        "vbyte": lambda u: total(u, _vbyte),
        "svb": lambda u: ints.ceil_div(F.size(u), 4) + total(u, ints.svb_length),
        "bp128": lambda u: total(tiles(u), lambda t: F.lit(1) + ints.bit_width(F.array_max(of(u, t))) * (tile // 8)) + total(tail(u), _vbyte),
        "optpfd": lambda u: ints.ceil_div(total(tiles(u), lambda t: patched(of(u, t))), 8) + total(tail(u), _vbyte),
    }
    return {name: _long(total(us, f) + F.lit(1 + 4 * channels)) for name, f in sizes.items()}


def sprintz(vs: Column, channels: int) -> Column:
    """Bytes of a unit of whole records: blocks of eight, zero blocks in runs."""

    def of(us: Column, n: Column) -> Column:
        def step(acc: Column, b: Column) -> Column:
            width = total(us, lambda u: ints.bit_width(F.coalesce(F.array_max(piece(u, b * 8, 8)), F.lit(0))))
            count = F.least(_long(8), n - b * 8)

            def add(w: Column) -> Column:
                zero = (w == 0) & (count == 8)
                bits = F.when(zero, F.when(acc["pos"] % rivals.SPRINTZ_RUN == 0, 9).otherwise(0)).when(count == 8, F.lit(1 + 6 * channels) + w * 8).otherwise(count * (32 * channels))
                return F.struct(_long(acc["bits"] + bits).alias("bits"), _long(F.when(zero, acc["pos"] + 1).otherwise(0)).alias("pos"))

            return let(width, add)

        return F.aggregate(_upto(ints.ceil_div(n, 8)), F.struct(_long(32 * channels).alias("bits"), _long(0).alias("pos")), step)["bits"]

    us = F.transform(vs, lambda v: F.transform(differences(v), ints.zigzag))
    return ints.ceil_div(let(us, lambda us: of(us, _long(F.size(vs[0]) - 1))), 8)


def equal_framing(units: DataFrame, channels: int) -> DataFrame:
    """(codec, bytes): every codec cut to the same frames, each with the frame header's bytes."""
    sizes = family(F.col("us"), channels) | {"sprintz": sprintz(F.col("vs"), channels), "native": channel_size(F.col("vs"), channels)}
    rows = units.select("vs", zigzagged(F.col("vs")).alias("us")).select(*(c.alias(name) for name, c in sizes.items()))
    sums = rows.agg(*(F.sum(F.col(c) + F.lit(sizing.FRAME_HEADER)).cast("bigint").alias(c) for c in sizes))
    return sums.unpivot([], list(sizes), "codec", "bytes")
