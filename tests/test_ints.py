import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandpack.functions import ints

EDGES = [0, 1, -1, 7, -8, 32767, -32768, 2**31 - 1, -(2**31), 2**30, -(2**30) - 5, 123456789]


def wrap(x):
    return (x + 2**31) % 2**32 - 2**31


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(a, b) for a in EDGES for b in EDGES], "a long, b long")


def test_wrapping_sums_and_differences(pairs):
    for r in pairs.select("a", "b", ints.sub32("a", "b").alias("s"), ints.add32("a", "b").alias("p")).collect():
        assert (r.s, r.p) == (wrap(r.a - r.b), wrap(r.a + r.b))


def test_zigzag_and_back(pairs):
    z = pairs.select("a", ints.zigzag("a").alias("z"), ints.unzigzag(ints.zigzag("a")).alias("back")).distinct().collect()
    assert all(r.back == r.a and r.z == (2 * r.a if r.a >= 0 else -2 * r.a - 1) for r in z)


def test_absolute_values(pairs):
    for r in pairs.select("a", ints.abs32("a").alias("x"), ints.abs64("a").alias("y")).distinct().collect():
        assert r.y == abs(r.a) and r.x == (r.a if r.a == -(2**31) else abs(r.a))


def test_widths_and_zeros(spark):
    values = [0, 1, 2, 3, 255, 256, 2**31, 2**32 - 1, 40, 2**20]
    df = spark.createDataFrame([(v,) for v in values], "u long")
    for r in df.select("u", ints.bit_width("u").alias("w"), ints.leading_zeros("u").alias("l"), ints.trailing_zeros("u").alias("t"), ints.svb_length("u").alias("s")).collect():
        assert (r.w, r.l) == (r.u.bit_length(), 32 - r.u.bit_length())
        assert r.t == (32 if r.u == 0 else (r.u & -r.u).bit_length() - 1)
        assert r.s == max(1, -(-r.u.bit_length() // 8))


def test_masks_and_flags(spark):
    df = spark.createDataFrame([(w,) for w in (-3, 0, 1, 8, 31, 32, 40)], "w int")
    assert [r.m for r in df.select(ints.low_mask("w").alias("m")).collect()] == [0, 0, 1, 255, 2**31 - 1, 2**32 - 1, 2**32 - 1]
    flags = spark.createDataFrame([(c,) for c in (0, 3, 9)], "c int").agg(ints.flag_set("c").alias("f"))
    assert flags.first().f == 0b1000001001
    assert flags.select(ints.flag_test("f", F.lit(3)).alias("y"), ints.flag_test("f", F.lit(4)).alias("n")).first() == (True, False)


def test_ragged_lengths(spark):
    df = spark.range(12).crossJoin(spark.range(5).withColumnRenamed("id", "c"))
    for r in df.select("id", "c", ints.ragged_length("id", 5, "c").alias("n")).collect():
        assert r.n == len(range(r.c, r.id, 5))


def test_little_endian_fields(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\x02\x03\x04\x05\xff"),)], "b binary")
    assert df.select(ints.le_uint("b", 0, 2).alias("x"), ints.le_uint("b", 1, 4).alias("y"), ints.le_uint("b", 5, 1).alias("z")).first() == (0x0201, 0x05040302, 255)


def test_quantise_rounds_half_away_and_refuses_what_does_not_fit(spark):
    cases = [(0.5, 1.0, 1), (-0.5, 1.0, -1), (1.5, 1.0, 2), (-2.5, 1.0, -3), (0.4, 1.0, 0), (math.nan, 1.0, None), (math.inf, 1.0, None), (3e9, 1.0, None), (1.0, 0.0, None), (1.0, -1.0, None), (1.0, math.nan, None), (1.01, 100.0, 101)]
    df = spark.createDataFrame([(float(np.float32(x)), s) for x, s, _ in cases], "x double, s double")
    assert [r.q for r in df.select(ints.quantise("x", F.col("s")).alias("q")).collect()] == [q for _, _, q in cases]
    held = spark.createDataFrame([(1e12,), (-1e12,), (math.nan,)], "x double").select(ints.quantise_saturating("x", F.lit(1.0)).alias("q"))
    assert [r.q for r in held.collect()] == [2**31 - 1, -(2**31), None]


def test_dequantise_error_stays_within_half_a_step(spark):
    x = np.random.default_rng(3).normal(0, 50, 500).astype(np.float32)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").withColumn("x", F.col("x").cast("float"))
    back = df.select("x", ints.dequantise(ints.quantise("x", F.lit(100.0)), F.lit(100.0)).alias("y")).collect()
    assert max(abs(r.x - r.y) for r in back) <= 0.005 * 1.001 + 1e-5


def test_batch_targets(spark):
    df = spark.createDataFrame([(2.0, 0.25), (25.0, 2.0), (0.1, 0.1), (1000.0, 5.0)], "hz double, d double")
    assert [r.t for r in df.select(ints.target_batch("hz", "d").alias("t")).collect()] == [1, 50, 1, 512]


def test_channels_are_refused_whole_by_their_first_bad_value(spark):
    nan, inf = float("nan"), float("inf")
    cases = [(0, [1.0, 2.0, -1.5]), (1, [1.0, 1e9, nan]), (2, [nan, 1e9]), (3, [1.0, inf]), (4, [None]), (5, []), (6, None)]
    rows = spark.createDataFrame(cases, "k int, x array<float>").select("k", ints.quantise_channels("x", [10.0, 4.0]).alias("q"))
    got = {r["k"]: (r["q"]["status"], r["q"]["values"]) for r in rows.collect()}
    assert got == {0: ("ok", [10, 8, -15]), 1: ("range", None), 2: ("value", None), 3: ("value", None), 4: ("value", None), 5: ("ok", []), 6: (None, None)}
    bad = spark.createDataFrame([(0, [1.0, 1.0])], "k int, x array<float>")
    for scale in (0.0, -1.0, nan, inf):
        assert bad.select(ints.quantise_channels("x", [1.0, scale])["status"]).first()[0] == "scale"
    back = rows.filter("k = 0").select(ints.dequantise_channels("q.values", [10.0, 4.0])).first()[0]
    assert back == [1.0, 2.0, -1.5]
