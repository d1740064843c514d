import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_codec import cases

from strandpack.functions import codec, rival_codecs
from strandpack.operators import report, units
from strandpack.plans.queries import QUERIES

NAMES = ("vbyte", "svb", "bp128", "optpfd")


def rows_of(spark, streams):
    """Wide records of interleaved streams of three channels."""
    rows = [(s, i, *map(int, r)) for s, x in enumerate(streams) for i, r in enumerate(x.reshape(-1, 3))]
    return spark.createDataFrame(rows, "stream long, rec long, c0 long, c1 long, c2 long")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def windows(df) -> int:
    return len(re.findall(r"\bWindow \[", plan_of(df)))


def test_unit_sizes_equal_the_kernels(spark):
    streams = [x[: len(x) // 3 * 3] for x in cases() if len(x) >= 3]
    # short runs of zeros, one beyond the longest escape, and refusals at the early look behind a run
    streams += [np.repeat(np.arange(90, dtype=np.int32), n) for n in (10, 60, 75, 90)] + [np.zeros(3 * (8 * 65535 + 8 * k + 1), np.int32) for k in (3, 20)]
    rng = np.random.default_rng(4)
    streams += [np.concatenate([np.full(3 * n, 5), rng.integers(-30000, 30000, 3 * 40)]).astype(np.int32) for n in (1, 9, 55, 60, 64, 66, 73, 120)]
    got = units.gather(rows_of(spark, streams), 3, 1 << 20)
    us = units.family(F.col("us"), 3)
    got = got.withColumn("us", units.zigzagged(F.col("vs"))).select("stream", "n_rec", units.channel_size(F.col("vs"), 3).alias("native"), units.sprintz(F.col("vs"), 3).alias("sprintz"), *(us[c].alias(c) for c in NAMES)).collect()
    assert len(got) == len(streams)
    for r in got:
        x = streams[r.stream]
        assert r.n_rec == len(x) // 3 and r.native == len(codec.channel_encode(x, 3)), r.stream
        assert r.sprintz == len(rival_codecs.sprintz_encode(x, 3)), r.stream
        for name in NAMES:
            assert r[name] == len(rival_codecs.family_encode(rival_codecs.CODECS[name], x, 3)), (r.stream, name)


def test_sweep_sizes_equal_the_kernels(spark):
    streams = [x[: len(x) // 3 * 3] for x in cases(8) if len(x) >= 3]
    got = units.swept(units.gather(rows_of(spark, streams), 3, 20), 3, (4, 10)).collect()
    for r in got:
        frames = [codec.frame_encode(x[at : at + 3 * r.per_frame], 3, 0) for x in streams for at in range(0, len(x), 3 * r.per_frame)]
        assert (r.frames, r.bytes, r.largest, r.raw) == (len(frames), sum(map(len, frames)), max(map(len, frames)), 4 * sum(map(len, streams)))
    assert {r.per_frame for r in got} == {4, 10}


@pytest.mark.parametrize(("name", "passes"), [("q_frame_sweep", 1), ("q_equal_framing", 1), ("q_pareto", 2), ("q_frame_size", 1), ("q_cheaper_of_two", 1), ("q_effective_ratio", 1), ("q_loss_recovery", 1), ("q_mtu_packets", 1)])
def test_frames_are_sized_without_windows_over_values(spark, smallest, name, passes):
    """One window numbers the records; the values of a task's frames are never sorted or kept at once."""
    df = QUERIES[name](spark, smallest)
    assert windows(df) == passes and "Python" not in plan_of(df) and "InArrow" not in plan_of(df)


@pytest.mark.parametrize("name", ["q_frame_roundtrip", "q_frame_bytes", "q_crc_valid"])
def test_frames_are_coded_many_at_once(spark, smallest, name):
    """No call of a Python function per frame: batches of gathered frames are encoded."""
    plan = plan_of(QUERIES[name](spark, smallest))
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_the_csv_rows_are_sized_without_windows_over_values(spark, smallest, monkeypatch):
    written = []
    monkeypatch.setattr(report, "write_csv", lambda rows, path: written.append(rows) or rows.write.option("header", True).csv(path))
    assert QUERIES["q_result_csv"](spark, smallest).count() == 6
    assert [windows(rows) for rows in written] == [1]


def test_the_frames_of_the_bursty_channel_are_sized_without_windows_over_values(spark, smallest):
    """Its chain per stream and round is a Python function; the sizes before it are not."""
    plan = plan_of(QUERIES["q_loss_markov"](spark, smallest))
    assert len(re.findall(r"\bWindow \[", plan)) == 1 and plan.count("FlatMapGroups") == 1 and "MapInArrow" not in plan
