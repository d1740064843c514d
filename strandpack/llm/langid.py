"""Operator 4, language identification by compression.

A raw-content zstandard dictionary is built for each language from sampled training
text. A text, folded to lower case with all but letters and their marks as single spaces,
is cut in pieces of ``piece`` bytes, so that it cannot predict itself; each piece is
compressed with every dictionary, and the language of the smallest total size is the
text's. Nothing of it is left out, repetitions neither. The margin to the runner-up becomes
a score by a logistic model fitted on training rows kept out of the dictionaries;
``rejected`` marks answers whose margin is under ``min_margin``.

Bounds: the ``most_langs`` most frequent languages are learned (ties: the first in code
point order); about ``2 * rows_per_lang`` rows a language are sampled by a hash of the id,
and ``chunk_chars`` bytes of each of at most ``rows_per_lang`` go into a dictionary.

Defined cases: null texts and texts without a letter get ``und`` and score 0; ties go to
the first language in code point order; very long texts are read whole, piece by piece;
repeated rows are predicted alike; with no language to learn all rows get ``und``; extra
columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandpack.llm import common

UNKNOWN = "und"
NO_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
LETTER, ASCII_LETTER = regex.compile(r"\p{L}"), re.compile("[A-Za-z]")


def fold(text: str) -> bytes:
    return NO_LETTER.sub(" ", text.lower()).strip(" ").encode("utf-8", "surrogatepass")


@dataclass
class LanguageModel:
    dictionaries: dict[str, bytes]
    level: int
    piece: int
    fit: Any = None

    def compressors(self):
        import zstandard as zstd

        out = []
        for lang in sorted(self.dictionaries):
            d = zstd.ZstdCompressionDict(self.dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            out.append((lang, zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)))
        return out

    def measure(self, compressors, text: str | None) -> tuple[str, float, float]:
        """Language, margin (share by which the runner-up is larger) and folded size."""
        if text is None or not compressors or not (ASCII_LETTER.search(text) or LETTER.search(text)):
            return UNKNOWN, 0.0, 0.0
        b = fold(text)
        pieces = [b[k : k + self.piece] for k in range(0, len(b), self.piece)]
        sizes = [sum(map(len, map(c.compress, pieces))) for _, c in compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        return compressors[best][0], (second - sizes[best]) / max(1, second), float(len(b))


def signs(margin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.stack([margin, np.sqrt(margin), np.log1p(size), np.sqrt(margin) * np.log1p(size)], 1)


def train(docs: DataFrame, where: Column | None = None, rows_per_lang: int = 300, chunk_chars: int = 1024, level: int = 3, piece: int = 64, most_langs: int = 200) -> LanguageModel:
    """Learn from text and non-null lang of the rows for which ``where`` holds."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    known = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        known = known.filter(where)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_langs).collect()}
    if not counts:
        return LanguageModel({}, level, piece)
    mark = common.hashed_share("doc_id", "language")
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 2.0 * rows_per_lang / n))))
    sample = common.written(known.filter(mark < share[F.col("lang")]).select("doc_id", "lang", common.chunk_of(F.col("text"), "doc_id", 4 * chunk_chars).alias("text")), "language-sample")
    order = F.xxhash64(F.lit("order"), F.col("doc_id"))
    # the sample has about 2 * rows_per_lang rows a language, so its windows are small
    first = Window.partitionBy("lang").orderBy(order, "doc_id", "text")
    rows = sample.filter(F.pmod(order, F.lit(4)) != 0).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= rows_per_lang).collect()
    model = LanguageModel({}, level, piece)
    for lang in sorted(counts):
        own = sorted((r["place"], r["text"]) for r in rows if r["lang"] == lang)
        model.dictionaries[lang] = b"\n".join(fold(t)[:chunk_chars] for _, t in own) or b"\n"

    def measure(batches):
        compressors = model.compressors()
        for b in batches:
            got = [model.measure(compressors, t) for t in b.column(1).to_pylist()]
            right = [g[0] == lang for g, lang in zip(got, b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(right), pa.array([g[1] for g in got]), pa.array([g[2] for g in got])], ["right", "margin", "size"])

    rest = sample.filter(F.pmod(order, F.lit(4)) == 0).select("lang", "text").mapInArrow(measure, "right boolean, margin double, size double").toPandas()
    if rest["right"].nunique() == 2:
        rest = rest.sort_values(list(rest.columns))
        model.fit = common.logistic(signs(rest["margin"].to_numpy(), rest["size"].to_numpy()), rest["right"].to_numpy().astype(float), np.ones(len(rest)))
    return model


def predict(docs: DataFrame, model: LanguageModel, min_margin: float = 0.005, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and rejected (the margin is narrow) of every row's whole text."""
    common.bound_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches):
        compressors = model.compressors()
        for b in batches:
            got = [model.measure(compressors, t) for t in b.column(1).to_pylist()]
            margin, size = np.array([g[1] for g in got], float), np.array([g[2] for g in got], float)
            known = np.array([g[0] != UNKNOWN for g in got], bool)
            sure = common.logistic_score(model.fit, signs(margin, size)) if model.fit is not None and len(got) else 1 - np.exp(-20 * margin)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array(np.where(known, sure, 0.0)), pa.array(margin < min_margin)], [id_col, "lang_pred", "score", "rejected"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
