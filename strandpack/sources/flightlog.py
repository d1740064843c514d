"""Self-describing autopilot logs as rows.

A log is a run of records behind the sync bytes A3 95 and a type byte; records of type
0x80 describe the others. Files are read by Spark, one task each, as the format can only
be followed from its start; what follows is relational.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandpack.functions import ints

SYNC, FMT_TYPE, FMT_SIZE, MOST_FIELDS = b"\xa3\x95", 0x80, 89, 32
# Bytes and layout by format character.
LAYOUT = {"b": "b", "B": "B", "M": "B", "h": "h", "H": "H", "c": "h", "C": "H", "i": "i", "I": "I", "e": "i", "E": "I", "L": "i", "n": "4s", "f": "f", "d": "d", "q": "q", "Q": "Q", "N": "16s", "Z": "64s", "a": "64s"}
HUNDREDTHS = "cCeE"
# What is extracted by log record: labels, factor, and whether the raw integer is meant.
MRAD, MG = 3.14159265358979 / 180.0 * 1000.0, 1000.0 / 9.80665
EXTRACTS = {
    "ATT": [("Roll", MRAD, False), ("Pitch", MRAD, False), ("Yaw", MRAD, False)],
    "IMU": [("GyrX", 1000.0, False), ("GyrY", 1000.0, False), ("GyrZ", 1000.0, False), ("AccX", MG, False), ("AccY", MG, False), ("AccZ", MG, False)],
    "GPS": [("Lat", 1.0, True), ("Lng", 1.0, True), ("Alt", 1000.0, False)],
    "RCOU": [(f"C{k}", 1.0, True) for k in range(1, 9)],
    "RCIN": [(f"C{k}", 1.0, True) for k in range(1, 9)],
    "BAT": [("Volt", 1000.0, False), ("Curr", 100.0, False), ("CurrTot", 1.0, False)],
    "VIBE": [("VibeX", 1000.0, False), ("VibeY", 1000.0, False), ("VibeZ", 1000.0, False)],
}


@dataclass
class Definition:
    type: int
    length: int
    name: str
    formats: str
    labels: list[str]

    @property
    def layout(self) -> str:
        return "<" + "".join(LAYOUT[c] for c in self.formats)


def text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("latin-1")


def definition(record: bytes) -> Definition | None:
    """The description in a format record; None if its labels and formats do not agree."""
    formats, labels = text(record[9:25]), text(record[25:89]).split(",")
    if len(formats) > MOST_FIELDS or any(c not in LAYOUT for c in formats) or len(labels) != len(formats):
        return None
    return Definition(record[3], record[4], text(record[5:9]), formats, labels)


def scan(data: bytes):
    """(offset, definition, values by label) of each record, then (bytes skipped, None, None)."""
    known: dict[int, Definition] = {}
    at = skipped = 0
    while at + 3 <= len(data):
        kind = data[at + 2]
        if data[at : at + 2] != SYNC or (kind != FMT_TYPE and kind not in known):
            at, skipped = at + 1, skipped + 1
        elif kind == FMT_TYPE:
            if at + FMT_SIZE > len(data):
                break
            if d := definition(data[at : at + FMT_SIZE]):
                known[d.type] = d
            at += FMT_SIZE
        else:
            d = known[kind]
            size = max(d.length, 3)
            if at + size > len(data):
                break
            room = 3 + struct.calcsize(d.layout)
            raw = data[at : at + max(size, room)].ljust(room, b"\0")
            yield at, d, dict(zip(d.labels, struct.unpack_from(d.layout, raw, 3)))
            at += size
    yield skipped, None, None


def read(spark: SparkSession, path: str) -> DataFrame:
    return rows(spark.read.format("binaryFile").load(path).select("path", "content"))


def rows(logs: DataFrame) -> DataFrame:
    """Of logs (path, content): (path, no, offset, type, name, raw, fields): numbers by label, raw and with hundredths applied.

    A row with name null closes each file; its offset counts the bytes that were skipped.
    """
    kinds = pa.map_(pa.string(), pa.float64())

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held = []
                for no, (at, d, values) in enumerate(scan(data)):
                    numbers = {k: float(v) for k, v in (values or {}).items() if not isinstance(v, bytes)}
                    scaled = {k: v / 100 if d.formats[d.labels.index(k)] in HUNDREDTHS else v for k, v in numbers.items()}
                    held.append((name, no, at, d.type if d else None, d.name if d else None, list(numbers.items()), list(scaled.items())))
                    if len(held) == 5000:
                        yield batch(held)
                        held = []
                yield batch(held)

    def batch(held):
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), kinds, kinds]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], ["path", "no", "offset", "type", "name", "raw", "fields"])

    return logs.mapInArrow(run, "path string, no long, offset long, type int, name string, raw map<string,double>, fields map<string,double>")


def inventory(log: DataFrame) -> DataFrame:
    """(path, name, n, labels, skipped) by record type."""
    skipped = log.filter("name IS NULL").select("path", F.col("offset").alias("skipped"))
    kinds = log.filter("name IS NOT NULL").groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.first(F.map_keys("raw"))), ",").alias("labels"))
    return kinds.join(skipped, "path", "left")


def extract(log: DataFrame, name: str) -> DataFrame:
    """(path, rec, values): the fields of one extract, scaled, rounded half away from zero, held in int32.

    Logs without the record or one of its fields give no rows.
    """
    spec = EXTRACTS[name]
    rows = log.filter(F.col("name") == name)
    for label, _, _ in spec:
        rows = rows.filter(F.map_contains_key("raw", F.lit(label)))
    values = F.array(*(ints.quantise_saturating(F.col("raw" if whole else "fields")[label], F.lit(factor)).cast("int") for label, factor, whole in spec))
    return rows.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("no")) - 1).cast("long").alias("rec"), values.alias("values"))


def build(definitions: list[Definition], records: list[tuple[int, tuple]]) -> bytes:
    """A log of these definitions and (type, values) records, for tests and demonstrations."""
    by = {d.type: d for d in definitions}
    out = []
    for d in definitions:
        out.append(SYNC + bytes([FMT_TYPE, d.type, 3 + struct.calcsize(d.layout)]) + d.name.encode().ljust(4, b"\0") + d.formats.encode().ljust(16, b"\0") + ",".join(d.labels).encode().ljust(64, b"\0"))
    for kind, values in records:
        out.append(SYNC + bytes([kind]) + struct.pack(by[kind].layout, *values))
    return b"".join(out)
