"""Frames over lossy links: packets, survival, loss channels and what is recovered."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandpack.functions import ints

MTU = 250


def packets(frames: DataFrame, mtu: int = MTU) -> DataFrame:
    """Adds packets, the link packets that a frame's bytes take."""
    return frames.withColumn("packets", ints.ceil_div("bytes", mtu))


def survival(packet_count, loss: float) -> Column:
    """The chance that all packets arrive when each is lost on its own."""
    return F.pow(F.lit(1.0 - loss), packet_count)


def hashed_recovery(frames: DataFrame, percent: int, rounds: int) -> DataFrame:
    """(round, recovered, n_rec, sent): packets lost by an integer hash, so that any engine agrees.

    A frame is recovered if all its packets arrive."""
    lost = lambda p: F.pmod(F.col("stream") * 7919 + F.col("frame") * 104729 + p * 1299709 + F.col("round") * 15485863, F.lit(9973)) % 100 < percent
    # a frame's packets are looked at where the frame is: neither they nor the frames are shuffled
    rounds_ = frames.select("stream", "frame", "n_rec", "bytes", "packets", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    whole = rounds_.withColumn("arrived", ~F.exists(F.sequence(F.lit(0).cast("bigint"), F.col("packets") - 1), lost))
    return whole.groupBy("round").agg(F.sum(F.when(F.col("arrived"), F.col("n_rec")).otherwise(0)).cast("bigint").alias("recovered"), F.sum("n_rec").cast("bigint").alias("n_rec"), F.sum("bytes").cast("bigint").alias("sent"))


def effective(recovered: DataFrame, channels: int) -> DataFrame:
    """Share of records recovered and raw bytes recovered per byte sent, over all rounds."""
    sums = recovered.agg(F.sum("recovered").alias("r"), F.sum("n_rec").alias("n"), F.sum("sent").alias("s"))
    return sums.select((F.col("r") / F.col("n")).alias("recovery"), (F.col("r") * (4 * channels) / F.col("s")).alias("effective"))


def gilbert_elliott(loss: float, burst: float) -> tuple[float, float]:
    """(good to bad, bad to good) of the two-state chain with a mean loss and burst length."""
    r = 1.0 / max(1.0, burst)
    return (1.0 if loss >= 1 else loss * r / (1 - loss)), r


def chain(n: int, loss: float, burst: float, rng: np.random.Generator) -> np.ndarray:
    """Which of ``n`` packets are lost: the state is sent, then it moves; the first is good."""
    p, r = gilbert_elliott(loss, burst)
    out, bad = np.zeros(n, bool), False
    for k, u in enumerate(rng.random(n).tolist()):
        out[k] = bad
        bad = (u >= r) if bad else (u < p)
    return out


def markov_recovery(frames: DataFrame, loss: float, burst: float, rounds: int, seed: int = 7) -> DataFrame:
    """(stream, round, recovered, n_rec, sent) over a bursty channel; one seeded chain per stream and round."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.sort_by("frame")
        stream, turn = rows.column("stream")[0].as_py(), rows.column("round")[0].as_py()
        n, packets_ = rows.column("n_rec").to_numpy(), rows.column("packets").to_numpy()
        lost = chain(int(packets_.sum()), loss, burst, np.random.default_rng([seed, stream % (1 << 32), turn]))
        arrived = ~np.logical_or.reduceat(lost, np.concatenate([[0], np.cumsum(packets_)[:-1]]))
        return pa.table({"stream": [stream], "round": pa.array([turn], pa.int32()), "recovered": [int(n[arrived].sum())], "n_rec": [int(n.sum())], "sent": [int(rows.column("bytes").to_numpy().sum())]})

    turns = frames.select("stream", "frame", F.col("n_rec").cast("bigint").alias("n_rec"), "bytes", "packets", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    return turns.groupBy("stream", "round").applyInArrow(run, "stream long, round int, recovered long, n_rec long, sent long")
