"""Frames as rows: encoding by group, decoding row by row, checks in plain expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandpack.functions import codec, ints, rival_codecs
from strandpack.operators import units

FRAMES = "stream long, frame long, seq int, n_rec int, payload binary"


def encode(records: DataFrame, channels: int, per_frame: int) -> DataFrame:
    """(stream, frame, seq, n_rec, payload) of wide records, gathered to a row a frame and encoded many at once."""

    def run(batches):
        for b in batches:
            counts = b.column(2).to_numpy().astype(np.int64)
            vs = b.column(3)
            values = vs.flatten().flatten().fill_null(0).to_numpy().astype(np.int32)
            starts = np.cumsum(counts * channels) - counts * channels
            numbers = b.column(1).to_pylist()
            data = [codec.framed(n, k, body) for n, k, body in zip(counts.tolist(), numbers, codec.bodies(values, starts, counts, channels))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([k % 65536 for k in numbers], pa.int32()), pa.array(counts, pa.int32()), pa.array(data, pa.binary())], ["stream", "frame", "seq", "n_rec", "payload"])

    return units.gather(records, channels, per_frame).mapInArrow(run, FRAMES)


def decode(frames: DataFrame, channels: int, per_frame: int) -> DataFrame:
    """Wide records of sound frames, in any order of rows; corrupt frames give no record."""
    columns = [f"c{k}" for k in range(channels)]

    def run(batches):
        for b in batches:
            got = codec.frames_decode(b.column(2).to_pylist(), channels)
            kept = [k for k, x in enumerate(got) if x is not None]
            counts = np.array([len(got[k]) for k in kept], np.int64)
            of = lambda i: b.column(i).take(pa.array(np.repeat(kept, counts).astype(np.int64)))
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            table = np.concatenate([got[k] for k in kept]).astype(np.int64) if kept else np.zeros((0, channels), np.int64)
            yield pa.RecordBatch.from_arrays([of(0), pa.array(of(1).to_numpy() * per_frame + within), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(channels))], ["stream", "rec", *columns])

    return frames.select("stream", "frame", "payload").mapInArrow(run, "stream long, rec long, " + ", ".join(f"{c} long" for c in columns))


def sound(payload: Column) -> Column:
    """Length, magic, version and checksum of a frame, without Python."""
    head = (F.octet_length(payload) >= codec.HEADER.size) & (F.hex(F.substring(payload, 1, 2)) == f"{codec.MAGIC:02X}{codec.VERSION:02X}")
    return head & (F.crc32(F.substring(payload, 7, 1 << 30)) == ints.le_uint(payload, 2, 4))


def header(payload: Column) -> tuple[Column, Column]:
    """(sequence number, records)."""
    return ints.le_uint(payload, 6, 2), ints.le_uint(payload, 8, 2)


def sequence_gaps(frames: DataFrame) -> DataFrame:
    """(stream, seq, missing): frames missing before each, by 16-bit sequence numbers that wrap."""
    before = F.lag("seq").over(Window.partitionBy("stream").orderBy("frame"))
    return frames.withColumn("missing", F.coalesce(F.pmod(F.col("seq") - before, F.lit(65536)) - 1, F.lit(0)).cast("bigint")).select("stream", "frame", "seq", "missing")


def rival_bytes(records: DataFrame, channels: int, name: str) -> DataFrame:
    """(stream, n_rec, bytes, exact) of a rival codec over whole streams, decoded again."""
    columns = [f"c{k}" for k in range(channels)]

    def run(t: pa.Table) -> pa.Table:
        rows = t.sort_by("rec")
        x = np.stack([rows.column(c).to_numpy() for c in columns], 1).astype(np.int64).astype(np.int32).ravel()
        if name == "sprintz":
            data = rival_codecs.sprintz_encode(x, channels)
            back = rival_codecs.sprintz_decode(data, len(x), channels)
        else:
            data = rival_codecs.family_encode(rival_codecs.CODECS[name], x, channels)
            back = rival_codecs.family_decode(rival_codecs.CODECS[name], data, len(x))
        return pa.table({"stream": pa.array([rows.column("stream")[0].as_py()], pa.int64()), "n_rec": pa.array([rows.num_rows], pa.int64()), "bytes": pa.array([len(data)], pa.int64()), "exact": pa.array([bool((back == x).all())])})

    return records.groupBy("stream").applyInArrow(run, "stream long, n_rec long, bytes long, exact boolean")
