"""32-bit integer algebra as Catalyst expressions.

Spark has neither unsigned nor wrapping 32-bit integers and raises on overflow, so all
values are bigints that stand for int32 (or uint32, where named so) and are wrapped
explicitly. Nothing here leaves whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MIN, INT_MAX, MOD = -(1 << 31), (1 << 31) - 1, 1 << 32


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def wrap32(x) -> Column:
    """x modulo 2**32, as a signed value."""
    return (_c(x) + F.lit(1 << 31)).bitwiseAND(F.lit(MOD - 1)) - F.lit(1 << 31)


def sub32(a, b) -> Column:
    return wrap32(_c(a) - _c(b))


def add32(a, b) -> Column:
    return wrap32(_c(a) + _c(b))


def abs32(x) -> Column:
    """The 32-bit absolute value: the least integer stays negative."""
    return F.when(_c(x) == INT_MIN, _c(x)).otherwise(F.abs(_c(x)))


def abs64(x) -> Column:
    return F.abs(_c(x))


def zigzag(x) -> Column:
    return F.when(_c(x) < 0, F.lit(-2) * _c(x) - 1).otherwise(F.lit(2) * _c(x))


def unzigzag(u) -> Column:
    return F.when(_c(u) % 2 == 1, -((_c(u) + 1) / 2).cast("bigint")).otherwise((_c(u) / 2).cast("bigint"))


def bit_width(u) -> Column:
    """Bits of an unsigned value; 0 for 0."""
    return F.when(_c(u) == 0, F.lit(0)).otherwise(F.length(F.bin(_c(u))))


def leading_zeros(u) -> Column:
    """Of 32 bits; 32 for 0."""
    return F.lit(32) - bit_width(u)


def trailing_zeros(u) -> Column:
    """Of 32 bits; 32 for 0."""
    return F.when(_c(u) == 0, F.lit(32)).otherwise(F.length(F.bin(_c(u).bitwiseAND(-_c(u)))) - 1)


def low_mask(width) -> Column:
    """The lowest ``width`` bits, held between 0 and 32."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.lit(0), F.least(_c(width), F.lit(32))).cast("int")) - 1


def flag_set(channels) -> Column:
    """An aggregate: bit c for every channel number c."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), _c(channels).cast("int")))


def flag_test(flags, channel) -> Column:
    return F.call_function("getbit", _c(flags), _c(channel).cast("int")) == 1


def ceil_div(a, b) -> Column:
    b = F.lit(b) if isinstance(b, int) else _c(b)
    return F.floor((_c(a) + b - 1) / b).cast("bigint")


def ragged_length(total, channels, channel) -> Column:
    """Elements of a channel when records are cut off at ``total`` elements."""
    return F.when(_c(channel) >= _c(total), F.lit(0)).otherwise(ceil_div(_c(total) - _c(channel), channels)).cast("bigint")


def le_uint(data, start: int, size: int) -> Column:
    """Unsigned little-endian integer of ``size`` bytes from byte ``start`` of a binary column."""
    piece = F.substring(_c(data), start + 1, size)
    return F.conv(F.hex(F.reverse(piece) if size == 1 else F.concat(*(F.substring(piece, k, 1) for k in range(size, 0, -1)))), 16, 10).cast("bigint")


# -- floats -------------------------------------------------------------------------


def quantise(x, scale) -> Column:
    """Round half away from zero to int32; null if the scaled value does not fit or is not finite,
    or the scale is not positive and finite (status goes by null, never by an error)."""
    s = _c(scale).cast("float").cast("double")
    y = _c(x).cast("double") * s
    y = F.when(y >= 0, y + 0.5).otherwise(y - 0.5)
    sound = ~F.isnan(_c(x).cast("double")) & ~F.isnan(s) & (s > 0) & (s < 3e38) & (y >= float(INT_MIN)) & (y <= float(INT_MAX))
    return F.when(sound, y.cast("bigint"))


def quantise_saturating(x, scale) -> Column:
    """As ``quantise`` but held at the ends of int32; NaN gives null."""
    y = _c(x).cast("double") * _c(scale).cast("double")
    y = F.when(y >= 0, y + 0.5).otherwise(y - 0.5)
    return F.when(~F.isnan(_c(x).cast("double")), F.least(F.greatest(y, F.lit(float(INT_MIN))), F.lit(float(INT_MAX))).cast("bigint"))


def dequantise(i, scale) -> Column:
    return (_c(i).cast("double") / _c(scale).cast("float").cast("double")).cast("float")


def channel_status(x, scale) -> Column:
    """Why ``quantise`` refuses a value: ``scale`` or ``value`` not sound, out of ``range``; else ``ok``."""
    s, v = _c(scale).cast("float").cast("double"), _c(x).cast("double")
    bad_scale = s.isNull() | F.isnan(s) | (s <= 0) | (s >= 3e38)
    bad_value = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad_scale, "scale").when(bad_value, "value").when(quantise(x, scale).isNull(), "range").otherwise("ok")


def _scale_at(scales: list[float], i) -> Column:
    return F.element_at(F.array(*(F.lit(float(s)) for s in scales)), (i % len(scales) + 1).cast("int"))


def quantise_channels(values, scales: list[float]) -> Column:
    """(status, values) of an interleaved array, element i at scale i modulo their number.

    The first refused element gives the status and refuses the whole array (values null).
    A null array gives a null status; an empty one is ``ok``.
    """
    values = _c(values)
    bad = F.filter(F.transform(values, lambda x, i: channel_status(x, _scale_at(scales, i))), lambda s: s != "ok")
    status = F.when(values.isNotNull(), F.coalesce(F.get(bad, F.lit(0)), F.lit("ok")))
    return F.struct(status.alias("status"), F.when(status == "ok", F.transform(values, lambda x, i: quantise(x, _scale_at(scales, i)))).alias("values"))


def dequantise_channels(values, scales: list[float]) -> Column:
    return F.transform(_c(values), lambda q, i: dequantise(q, _scale_at(scales, i)))


def suggested_scale(precision) -> Column:
    p = _c(precision).cast("float")
    return F.when(F.isnan(p) | (p <= 0), F.lit(0.0).cast("float")).otherwise((F.lit(1.0) / p.cast("double")).cast("float"))


# -- rates --------------------------------------------------------------------------


def target_batch(hz, delay, most: int = 512) -> Column:
    """Messages that a latency budget of ``delay`` seconds allows at a rate, 1 at least."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.floor(_c(hz) * _c(delay) + 0.5))).cast("bigint")


def ratio(raw, encoded) -> Column:
    return F.when(_c(encoded) > 0, _c(raw).cast("double") / _c(encoded))


def mb_per_s(raw, seconds) -> Column:
    return F.when(_c(seconds) > 0, _c(raw).cast("double") / _c(seconds) / float(1 << 20))


def svb_length(u) -> Column:
    u = _c(u)
    return F.when(u < 1 << 8, 1).when(u < 1 << 16, 2).when(u < 1 << 24, 3).otherwise(4)


def worst_case_bytes(n, channels: int = 1, layer: str = "core") -> Column:
    """An upper bound of the encoded bytes of ``n`` values, for reports."""
    flags = 2 + 2 * ((channels + 7) // 8)
    core = F.lit(4) + ceil_div(_c(n) * 32 + ceil_div(_c(n), 8) * 12, 8)
    own = {"core": core, "channel": core + F.lit(flags + 4 * channels), "frame": core + F.lit(flags + 4 * channels + 10)}
    return own[layer].cast("bigint")
