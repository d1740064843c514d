"""Operator 1, quality classifier by compression.

One raw-content zstandard dictionary is built from good and one from bad labelled text.
A document is cut in pieces of ``piece`` bytes, so that it cannot predict itself, and each
piece is compressed with either; the difference of the two total sizes, divided by the
larger, says which dictionary predicts the whole text better. A logistic model of that one
number, fitted on labelled rows kept out of the dictionaries, calibrates it to a
probability.

Bounds: at most about ``2 * rows_per_class`` labelled rows a class are sampled (by a
hash of the id), and a dictionary takes equal shares of ``dictionary_chars`` characters
from at most ``dictionary_rows`` of them.

Defined cases: a null text counts as empty; empty texts get the calibrated score of no
difference; very long texts are read whole, piece by piece; repeated rows get equal scores;
labels that are null, or that have no document, are not learned from; ids with several
labels or rows are learned from with each; with no usable labels every score is 0.5, with
labels of one class it is that label; extra columns are left out by ``score`` and kept by
``keep_good``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandpack.llm import common

THRESHOLD = 0.7


@dataclass
class QualityModel:
    dictionaries: dict[int, bytes]
    level: int
    piece: int
    fit: Any
    constant: float | None

    def compressors(self):
        import zstandard as zstd

        out = []
        for label in (1, 0):
            d = zstd.ZstdCompressionDict(self.dictionaries[label], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            out.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
        return out

    def differences(self, compressors, texts: list[str | None]) -> np.ndarray:
        """How much larger the texts are with the bad dictionary than with the good one, as a share of the larger size."""
        good, bad = (c.compress for c in compressors)
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            b = (text or "").encode("utf-8", "surrogatepass")
            pieces = [b[k : k + self.piece] for k in range(0, len(b), self.piece)]
            with_good, with_bad = sum(map(len, map(good, pieces))), sum(map(len, map(bad, pieces)))
            out[i] = (with_bad - with_good) / max(with_good, with_bad, 1)
        return out

    def score(self, texts: list[str | None], compressors=None) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        return common.logistic_score(self.fit, self.differences(compressors or self.compressors(), texts)[:, None])


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, rows_per_class: int = 1500, dictionary_rows: int = 1000, dictionary_chars: int = 1 << 20, level: int = 3, piece: int = 64) -> QualityModel:
    """Learn from rows of ``labels`` (doc_id, quality) for which ``where`` holds."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if where is not None:
        known = known.filter(where)
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return QualityModel({}, level, piece, None, float(next(iter(counts), 0.5)))
    share = {q: min(1.0, 2.0 * rows_per_class / n) for q, n in counts.items()}
    mark = common.hashed_share("doc_id", "quality")
    picked = known.filter(F.when(F.col("quality") == 1, mark < share[1]).otherwise(mark < share[0])).dropDuplicates(["doc_id", "quality"])
    # picked has at most about 4 * rows_per_class rows of two numbers, whatever the input: small enough for every task
    sample = common.written(docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text"), "quality-sample")
    order = F.xxhash64(F.lit("order"), F.col("doc_id"))
    texts: dict[int, list[str]] = {}
    for q in (0, 1):
        own = sample.filter((F.col("quality") == q) & (F.pmod(order, F.lit(2)) == 0))
        share = dictionary_chars // max(1, min(dictionary_rows, own.count()))
        rows = own.select("doc_id", common.chunk_of(F.col("text"), "doc_id", share).alias("piece")).orderBy(order, "doc_id", "piece").limit(dictionary_rows).collect()
        texts[q] = [r["piece"] for r in rows]
    model = QualityModel({q: "\n".join(t).encode("utf-8", "surrogatepass") or b"\n" for q, t in texts.items()}, level, piece, None, None)

    def measure(batches):
        compressors = model.compressors()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.differences(compressors, b.column(1).to_pylist()))], ["quality", "difference"])

    rest = sample.filter(F.pmod(order, F.lit(2)) == 1).select("quality", "text").mapInArrow(measure, "quality int, difference double").toPandas()
    if rest["quality"].nunique() < 2:
        return QualityModel({}, level, piece, None, counts.get(1, 0) / sum(counts.values()))
    rest = rest.sort_values(list(rest.columns))
    y = rest["quality"].to_numpy().astype(float)
    weight = np.where(y == 1, counts[1] / max(1, y.sum()), counts[0] / max(1, (1 - y).sum()))
    model.fit = common.logistic(rest[["difference"]].to_numpy(), y, weight * len(y) / weight.sum())
    return model


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, score and predicted (1 from ``threshold`` on) of every row's whole text."""
    common.bound_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        compressors = model.compressors() if model.constant is None else None
        for b in batches:
            s = np.clip(model.score(b.column(1).to_pylist(), compressors), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns unchanged, that score ``threshold`` or more."""
    common.bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        compressors = model.compressors() if model.constant is None else None
        for b in batches:
            yield b.filter(pa.array(model.score(b.column(at).to_pylist(), compressors) >= threshold))

    return docs.mapInArrow(run, docs.schema)
