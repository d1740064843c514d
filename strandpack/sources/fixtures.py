"""Interleaved fixture files: int32 channel count, int32 element count, int32 or float32 data.

Reading goes through Spark's own ``binaryFile`` source, so any store will do, a task a
file. Writing gives one file a stream, by a Python data source whose tasks commit by
renaming; Parquet remains the default sink for everything else.
"""

from __future__ import annotations

import os
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def parse(data: bytes, most_records: int | None = None) -> tuple[int, np.ndarray]:
    """(channels, records x channels); raises ValueError where sizes do not fit."""
    if len(data) < 8:
        raise ValueError("too short")
    k, n = struct.unpack_from("<ii", data)
    if not 1 <= k <= 255 or n < 0 or n % k or len(data) < 8 + 4 * n:
        raise ValueError("channel or element count")
    x = np.frombuffer(data, "<i4", n, 8).reshape(-1, k)
    return k, x[:most_records]


def parse_floats(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(scales, records x channels) of a float fixture."""
    if len(data) < 8:
        raise ValueError("too short")
    k, n = struct.unpack_from("<ii", data)
    if not 1 <= k <= 255 or n < 0 or n % k or len(data) < 8 + 4 * (k + n):
        raise ValueError("channel or element count")
    return np.frombuffer(data, "<f4", k, 8), np.frombuffer(data, "<f4", n, 8 + 4 * k).reshape(-1, k)


def build_floats(scales: np.ndarray, x: np.ndarray) -> bytes:
    x, scales = np.ascontiguousarray(x, "<f4"), np.ascontiguousarray(scales, "<f4")
    return struct.pack("<ii", x.shape[1], x.size) + scales.tobytes() + x.tobytes()


def build(x: np.ndarray) -> bytes:
    x = np.ascontiguousarray(x, "<i4")
    return struct.pack("<ii", x.shape[1], x.size) + x.tobytes()


def float_rows(files: DataFrame) -> DataFrame:
    """(path, rec, scales, values) of the float fixtures in (path, content)."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                scales, x = parse_floats(data)
                k = len(scales)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
                own, repeated = pa.ListArray.from_arrays(offsets, pa.array(x.ravel())), pa.ListArray.from_arrays(offsets, pa.array(np.tile(scales, len(x))))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), pa.array(np.arange(len(x), dtype=np.int64)), repeated, own], ["path", "rec", "scales", "values"])

    return files.select("path", "content").mapInArrow(run, "path string, rec long, scales array<float>, values array<float>")


def read_floats(spark: SparkSession, path: str) -> DataFrame:
    """(path, rec, scales, values) of every float fixture under ``path``, a task a file."""
    return float_rows(spark.read.format("binaryFile").load(path))


def read(spark: SparkSession, path: str, channels: int | None = None, most_records: int | None = None) -> DataFrame:
    """(path, rec, values) of every file under ``path``; with ``channels`` others are refused."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k, x = parse(data, most_records)
                if channels is not None and k != channels:
                    raise ValueError(f"{name}: {k} channels, not {channels}")
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.arange(len(x), dtype=np.int64)), pa.ListArray.from_arrays(offsets, pa.array(x.ravel().astype(np.int32)))], ["path", "rec", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, rec long, values array<int>")


class FixtureSink(DataSource):
    """Rows (stream string, rec long, values array<int>), a file a stream; rows of a stream must share a partition, in order."""

    @classmethod
    def name(cls) -> str:
        return "telemetry_fixture"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FixtureWriter(self.options["path"])


class FixtureWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> WriterCommitMessage:
        held: dict[str, list] = {}
        for r in rows:
            held.setdefault(r.stream, []).append(r["values"])
        os.makedirs(self.path, exist_ok=True)
        for stream, values in held.items():
            part = f"{self.path}/.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(build(np.array(values, np.int64).astype("<i4")))
            os.replace(part, f"{self.path}/{stream}.bin")
        return WriterCommitMessage()


def write(records: DataFrame, path: str) -> None:
    records.sparkSession.dataSource.register(FixtureSink)
    records.repartition("stream").sortWithinPartitions("stream", "rec").write.format("telemetry_fixture").option("path", path).mode("append").save()
