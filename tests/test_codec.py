import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandpack.functions import codec, rival_codecs
from strandpack.operators import frames, rivals, sizing
from strandpack.sources import vectors

INT = st.integers(-(2**31), 2**31 - 1)
SMALL = st.integers(-40, 40)


def values(draw_from):
    return st.lists(draw_from, max_size=200).map(lambda x: np.array(x, np.int64).astype(np.int32))


def cases(seed=5):
    """Streams of twelve kinds, from constant to adversarial."""
    rng = np.random.default_rng(seed)
    kinds = [
        lambda n: np.zeros(n), lambda n: np.full(n, -7), lambda n: rng.integers(-(2**31), 2**31, n), lambda n: rng.integers(-1, 2, n),
        lambda n: np.cumsum(rng.integers(-300, 300, n)), lambda n: np.cumsum(np.cumsum(rng.integers(-2, 3, n))), lambda n: np.where(np.arange(n) % 2, 2**31 - 1, -(2**31)),
        lambda n: np.where(rng.random(n) < 0.05, rng.integers(-(2**31), 2**31, n), 1500), lambda n: np.repeat(rng.integers(-9, 9, n // 90 + 1), 90)[:n],
        lambda n: rng.integers(-32770, 32770, n), lambda n: np.arange(n) * 32767, lambda n: np.where(np.arange(n) == n // 2, -(2**31), 0),
    ]
    for kind in kinds:
        for n in (0, 1, 2, 3, 7, 8, 9, 10, 17, 64, 65, 99, 100, 101, 300, 1200):
            yield kind(n).astype(np.int64).astype(np.int32)


@settings(max_examples=150, deadline=None)
@given(values(INT) | values(SMALL), st.integers(1, 9), st.integers(0, 200_000))
def test_round_trips(x, k, seq):
    got = codec.core_encode(x)
    if got is not None:
        back, used = codec.core_decode(got, len(x))
        assert (back == x).all() and used == len(got)
    assert (codec.channel_decode(codec.channel_encode(x, k), len(x), k if len(x) else None) == x).all()
    whole = x[: len(x) // k * k]
    number, back = codec.frame_decode(codec.frame_encode(whole, k, seq), k)
    assert number == seq % 65536 and (back == whole).all()
    floats = x.view(np.float32)
    assert (codec.xor_channels_decode(codec.xor_channels_encode(floats, k), len(x)).view(np.int32) == x).all()
    for c in rival_codecs.CODECS.values():
        u = rival_codecs.delta_zigzag(x)
        assert (c.decode(c.encode(u), len(u)) == u).all()
    assert (rival_codecs.sprintz_decode(rival_codecs.sprintz_encode(whole, k), len(whole), k) == whole).all()


def test_all_kinds_round_trip():
    for x in cases():
        for k in (1, 3, 8, 9):
            assert (codec.channel_decode(codec.channel_encode(x, k), len(x)) == x).all()


def test_a_difference_of_2_to_31_survives():
    x = np.array([1, 1 - 2**31, 1], np.int64).astype(np.int32)
    assert (codec.core_decode(codec.core_encode(x), 3)[0] == x).all()


def test_every_single_flipped_bit_of_a_frame_is_caught():
    data = codec.frame_encode(np.arange(120, dtype=np.int32) ** 2, 3, 9)
    for bit in range(8 * len(data)):
        bad = bytearray(data)
        bad[bit // 8] ^= 1 << bit % 8
        with pytest.raises(codec.Corrupt):
            codec.frame_decode(bytes(bad), 3)


def test_decoders_refuse_garbage_without_other_errors():
    rng = np.random.default_rng(11)
    good = codec.channel_encode(np.cumsum(rng.integers(-50, 50, 400)).astype(np.int32), 4)
    for _ in range(3000):
        bad = bytearray(good)
        for _ in range(int(rng.integers(1, 6))):
            bad[int(rng.integers(len(bad)))] ^= int(rng.integers(1, 256))
        bad = bytes(bad[: int(rng.integers(1, len(bad) + 1))])
        try:
            out = codec.channel_decode(bad, 400, 4)
            assert len(out) == 400
        except codec.Corrupt:
            pass


def stream_frame(spark, streams):
    rows = [(s, i, int(v)) for s, x in enumerate(streams) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "stream long, i long, v long")


def test_core_sizes_equal_the_kernels(spark):
    streams = [x for x in cases() if len(x)]
    sizes = {r.stream: r.bytes for r in sizing.core_size(stream_frame(spark, streams), ["stream"]).collect()}
    for s, x in enumerate(streams):
        got = codec.core_encode(x)
        assert sizes[s] == (-1 if got is None else len(got)), (s, len(x))


def test_channel_and_rival_sizes_equal_the_kernels(spark):
    streams = [x[: len(x) // 3 * 3] for x in cases() if len(x) >= 3]
    rows = [(s, i // 3, i % 3, int(v)) for s, x in enumerate(streams) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "stream long, i long, ch int, v long")
    native = {r.stream: r.bytes for r in sizing.channel_size(df, ["stream"], 3).collect()}
    family = rivals.with_header(rivals.family_sizes(df, ["stream"]), ["stream"], 3, ["vbyte", "svb", "bp128", "optpfd"]).collect()
    sprintz = {r.stream: r.sprintz for r in rivals.sprintz_size(df, ["stream"], 3).collect()}
    for s, x in enumerate(streams):
        assert native[s] == len(codec.channel_encode(x, 3)), s
        assert sprintz[s] == len(rival_codecs.sprintz_encode(x, 3)), s
    for r in family:
        for name in ("vbyte", "svb", "bp128", "optpfd"):
            assert r[name] == len(rival_codecs.family_encode(rival_codecs.CODECS[name], streams[r.stream], 3)), (r.stream, name)


def test_fewer_records_than_channels_pad_the_reference_block(spark):
    df = spark.createDataFrame([(0, 0, 0, 5), (0, 0, 1, 6)], "stream long, i long, ch int, v long")
    assert sizing.channel_size(df, ["stream"], 4).first().bytes == len(codec.channel_encode(np.array([5, 6], np.int32), 4))


def test_zero_runs_beyond_one_escape(spark):
    x = np.zeros(8 * 65535 + 8 * 20 + 1, np.int32)
    assert len(codec.core_encode(x)) == 4 + 7
    y = np.zeros(8 * 65535 + 8 * 3 + 1, np.int32)
    assert len(codec.core_encode(y)) == 4 + -(-(28 + 3 * 4) // 8)
    assert (codec.core_decode(codec.core_encode(x), len(x))[0] == 0).all()
    sizes = sizing.core_size(spark.range(len(x)).select(F.lit(0).alias("s"), F.col("id").alias("i"), F.lit(0).cast("long").alias("v")), ["s"])
    assert sizes.first().bytes == 11


def test_corrupt_frames_are_dropped_and_order_does_not_matter(spark):
    rows = spark.range(100).select(F.lit(1).cast("long").alias("stream"), F.col("id").alias("rec"), (F.col("id") * 3).alias("c0"), (F.col("id") - 50).alias("c1"))
    sent = frames.encode(rows, 2, 10).orderBy(F.rand(3))
    damaged = sent.withColumn("payload", F.when(F.col("frame") == 4, F.concat(F.col("payload"), F.unhex(F.lit("00")))).otherwise(F.col("payload")))
    assert damaged.filter(frames.sound(F.col("payload"))).count() == 9
    back = {r.rec: (r.c0, r.c1) for r in frames.decode(damaged, 2, 10).collect()}
    assert back == {i: (3 * i, i - 50) for i in range(100) if i // 10 != 4}


@pytest.mark.skipif("STRANDPACK_VECTORS" not in os.environ, reason="no conformance vectors")
def test_conformance_vectors():
    """Byte equality with published vectors, read where they lie."""
    with open(os.environ["STRANDPACK_VECTORS"], encoding="utf-8") as f:
        records = vectors.parse(f.read())
    encode = {"cekirdek": lambda r: codec.core_encode(np.array(r["input"], np.int64).astype(np.int32)), "kanal": lambda r: codec.channel_encode(np.array(r["input"], np.int64).astype(np.int32), r["channels"]),
              "cerceve": lambda r: codec.frame_encode(np.array(r["input"], np.int64).astype(np.int32), r["channels"], r["seq"]), "float_xor": lambda r: codec.xor_encode(vectors.floats(r["input_bits"])), "float_xor_kanal": lambda r: codec.xor_channels_encode(vectors.floats(r["input_bits"]), r["channels"])}
    assert len(records) > 20
    for r in records:
        if r["layer"] in encode:
            assert encode[r["layer"]](r) == r["output"], r["name"]


@pytest.mark.parametrize("k", [1, 2, 3, 4, 9, 21])
def test_many_frames_are_coded_as_one_by_one(k):
    rng = np.random.default_rng(k)
    xs = [x[: len(x) // k * k][: k * n] for x in cases(k) for n in (1, 2, 3, 8, 50, 400)]
    counts = np.array([len(x) // k for x in xs])
    flat = np.concatenate([x.reshape(-1, k).T.ravel() for x in xs])
    got = [codec.framed(n, 7 + n, b) for n, b in zip(counts.tolist(), codec.bodies(flat, np.cumsum(counts * k) - counts * k, counts, k))]
    assert got == [codec.frame_encode(x, k, 7 + len(x) // k) for x in xs]
    assert all((b == x.reshape(-1, k)).all() for x, b in zip(xs, codec.frames_decode(got, k)))
    damaged = []
    for data in got:
        bad = bytearray(data[codec.HEADER.size :])
        if bad:
            bad[int(rng.integers(len(bad)))] ^= int(rng.integers(1, 256))
            damaged.append(codec.framed(codec.frame_header(data)[1], 0, bytes(bad[: int(rng.integers(1, 2 * len(bad)))])))
    refused = 0
    for data, back in zip(damaged, codec.frames_decode([*damaged, got[0][:-1]], k)):
        try:
            assert (codec.frame_decode(data, k)[1] == back.ravel()).all()
        except codec.Corrupt:
            refused += 1
            assert back is None
    assert refused
    assert codec.frames_decode([], k) == []
