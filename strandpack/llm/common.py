"""What the training-data operators share: table reads, the shared folder, training splits."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Arrow batches are cut at these bounds, so that a batch of long documents stays small.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def runs(texts: list, chars: int = 1 << 21):
    """The list in runs of about ``chars`` characters (a longer text is a run of its own)."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > chars:
            yield texts[start:k]
            start, size = k, 0
        size += len(t or "")
    yield texts[start:]


def release() -> None:
    """Give memory that a batch needed, and that no longer holds anything, back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may be another one
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset (a single machine, as in tests) a folder of our own is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="strandpack-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a
    lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandpack/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_class(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null ids: null)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % mod


def hashed_share(id_col: str, salt: str) -> Column:
    """A number in [0, 1) that depends on the id only: reruns sample the same rows."""
    return (F.xxhash64(F.lit(salt), F.col(id_col)).bitwiseAND(0xFFFFFFFF)) / float(1 << 32)


def chunk_of(text: Column, id_col: str, chars: int) -> Column:
    """A piece of at most ``chars`` characters, from a place that depends on the id."""
    room = F.greatest(F.length(text) - F.lit(chars), F.lit(0)) + 1
    return F.substring(text, (F.pmod(F.xxhash64(F.lit("place"), F.col(id_col)), room) + 1).cast("int"), F.lit(chars))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 40):
    """Weighted ridge logistic regression by Newton's method: (mean, deviation, coefficients)."""
    mean, dev = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / dev])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, z.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, dev, w


def logistic_score(fit, x: np.ndarray) -> np.ndarray:
    mean, dev, w = fit
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / dev])
    return 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
