"""Conformance vector files: one record between the opening and closing key words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The key words of the file format.
KEYS = {"VEKTOR": "name", "ACIKLAMA": "about", "KATMAN": "layer", "KANAL": "channels", "SIRANO": "seq", "GIRDI": "input", "GIRDIF": "input_bits", "OLCEKLER": "scale_bits", "CIKTI": "output"}
END = "SON"


def parse(text: str) -> list[dict]:
    """Records with their lists and bytes decoded; malformed ones raise."""
    out, now = [], {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, _, value = line.partition(" ")
        if key == END:
            if "name" not in now:
                raise ValueError("a record without a name")
            out.append(now)
            now = {}
        elif KEYS[key] == "about":
            now["about"] = " ".join(filter(None, [now.get("about"), value]))
        else:
            now[KEYS[key]] = value
    for r in out:
        r["channels"], r["seq"] = int(r.get("channels", 1)), int(r.get("seq", 0))
        r["output"] = bytes.fromhex(r["output"])
        if "input" in r:
            r["input"] = [int(x) for x in r["input"].split()]
        for k in ("input_bits", "scale_bits"):
            if k in r:
                r[k] = [int(x, 16) for x in r[k].split()]
    return out


def floats(bits: list[int]) -> np.ndarray:
    return np.array(bits, np.uint32).view(np.float32)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(name, layer, channels, seq, input, output) by split and casts alone."""
    text = spark.read.text(path, wholetext=True)
    record = text.select(F.explode(F.split("value", rf"(?m)^{END}\s*$")).alias("r")).filter(F.col("r").rlike(r"(?m)^VEKTOR "))
    field = lambda key: F.nullif(F.regexp_extract("r", rf"(?m)^{key} (.*?)\s*$", 1), F.lit(""))
    numbers = F.transform(F.split(field("GIRDI"), r"\s+"), lambda x: x.cast("int"))
    return record.select(field("VEKTOR").alias("name"), field("KATMAN").alias("layer"), F.coalesce(field("KANAL").cast("int"), F.lit(1)).alias("channels"), F.coalesce(field("SIRANO").cast("long"), F.lit(0)).alias("seq"), numbers.alias("input"), F.unhex(field("CIKTI")).alias("output"))
