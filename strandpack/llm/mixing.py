"""Operator 3, mixing sources to target weights, by DataFrame functions only.

Every source gets a target: its weight's share of ``share`` times all words, stopped at
``cap`` times the source's own words, the excess going to the others by weight. A source
whose target exceeds its size is first taken in complete epochs; the fraction that is
left is filled by Efraimidis-Spirakis sampling: a document's key is u ** (1 / w) for a
uniform u drawn from its id and its quality weight w, documents follow each other by
descending key, and a prefix sum of their sizes stops at the budget.

Sorting and summing within a source are cut into key ranges, whose sums precede them, so
that a source that holds most rows is still dealt over many tasks. The ranges are of equal
width in ln(-ln key) = ln(-ln u) - ln w: whatever the weights are, this mixture of Gumbel
densities is nowhere above 1/e, so a range of width ``rows_per_range`` * e / n holds at most
``rows_per_range`` of a source's n documents on average. Ranges are summed up in two levels,
and the sources' own table has one row a source.

Defined cases: a null text has no words; the null source is a source of its own, after
all others; sources without words have target 0; repeated rows are documents of their
own (equal keys: by id, then size); rows that share an id share a range; very long texts
are sizes like others; extra columns are left out by ``mix`` and kept by ``repeat``,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandpack.llm import common

WEIGHTS = (3.0, 1.0, 2.0)
#: No key has ln(-ln key) below the negative of this: keys are at most 1 - 2 ** -53.
LOWEST = 40.0
#: Signs that are rare in prose; their share lowers a document's quality weight.
JUNK = r"[#$%&*!|~^<>{}=@]"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    junk = F.coalesce(F.regexp_count(text, F.lit(JUNK)), F.lit(0)) * 5.0
    return F.greatest(F.lit(0.1), F.lit(1.0) - junk / F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1)))


def uniform(id_col: Column, seed: str) -> Column:
    """A uniform number in (0, 1) from the id: 52 bits of its md5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets for (source, source_size, n): one row a source, in one small window.

    With sources in order of cap * size / weight those stopped at their cap are a
    prefix, and the level of the others is the largest that its own first source allows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    before = Window.orderBy("stop", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    out = sources.withColumn("source_no", F.row_number().over(by_name)).withColumn("weight", weight)
    out = out.withColumn("stop", F.lit(cap) * F.col("source_size") / F.col("weight"))
    total, weight_sum = F.sum("source_size").over(everything) * F.lit(share), F.sum("weight").over(everything)
    out = out.withColumn("level", (total - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (weight_sum - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    out = out.withColumn("level", F.max(F.when(F.col("level") <= F.col("stop"), F.col("level"))).over(everything))
    full = F.lit(cap) * F.col("source_size")
    out = out.withColumn("target", F.when(F.col("level").isNull(), full).otherwise(F.least(full, F.col("level") * F.col("weight"))))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return out.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")).select("source", "source_no", "source_size", "n", "target", "epochs", "budget")


def sampled(docs: DataFrame, weights, share: float, cap: float, seed: str, rows_per_range: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """The documents' slim rows with their source's numbers and whether they are taken once more; the sources."""
    slim = common.written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), key_of(F.col(id_col), F.col(text_col), seed).alias("key")), "mix-sizes")
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    # a row a source: below the broadcast threshold the joins on it need no shuffle
    sources = common.written(targets(sources, weights, share, cap), "mix-targets").withColumnRenamed("source", "named")
    dealt = slim.join(sources, F.col("source").eqNullSafe(F.col("named"))).withColumn("part", range_of(F.col("key"), F.col("n"), rows_per_range))
    parts = common.written(sums_ahead(common.written(dealt.groupBy("source_no", "part").agg(F.sum("size").alias("part_size")), "mix-range-sums")), "mix-ranges")
    in_part = Window.partitionBy("source_no", "part").orderBy(F.col("key").desc(), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("ahead") + F.sum("size").over(in_part)
    out = dealt.join(parts, ["source_no", "part"]).withColumn("end", end)
    start = F.col("end") - F.col("size")
    # the document on the edge is taken if that ends nearer to the budget
    once_more = (F.col("end") <= F.col("budget")) | ((start < F.col("budget")) & (F.col("end") - F.col("budget") <= F.col("budget") - start))
    return out.withColumn("once_more", once_more), sources


def range_of(key: Column, n: Column, rows_per_range: int) -> Column:
    """The number of the key's range, ascending by descending key."""
    return F.floor((F.ln(-F.ln(key)) + F.lit(LOWEST)) * n / F.lit(rows_per_range * math.e)).cast("long")


def sums_ahead(parts: DataFrame, wide: int = 1024) -> DataFrame:
    """(source_no, part, ahead): the sizes of all ranges before each one of its source; first by groups of ``wide`` ranges."""
    parts = parts.withColumn("group", F.floor(F.col("part") / F.lit(wide)))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    groups = parts.groupBy("source_no", "group").agg(F.sum("part_size").alias("group_size"))
    groups = groups.withColumn("group_ahead", F.coalesce(F.sum("group_size").over(before("source_no").orderBy("group")), F.lit(0))).drop("group_size")
    within = F.coalesce(F.sum("part_size").over(before("source_no", "group").orderBy("part")), F.lit(0))
    return parts.withColumn("within", within).join(groups, ["source_no", "group"]).select("source_no", "part", (F.col("group_ahead") + F.col("within")).alias("ahead"))


def key_of(id_col: Column, text: Column, seed: str) -> Column:
    return F.pow(uniform(id_col, seed), F.lit(1.0) / quality_weight(text))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: str = "mix", rows_per_range: int = 1024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row."""
    out, _ = sampled(docs, weights, share, cap, seed, rows_per_range, id_col, text_col, source_col)
    return out.select("doc_id", "size", "source_size", "target", ((F.col("epochs") + F.col("once_more").cast("long")) * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: str = "mix", rows_per_range: int = 1024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row, all columns unchanged, as often as the mix takes it.

    What is taken once more is a prefix of its source's order, so each source's last
    taken place decides for all rows where they are, and no text is shuffled. Rows that
    are equal in id and size to the last one are taken with it.
    """
    out, sources = sampled(docs, weights, share, cap, seed, rows_per_range, id_col, text_col, source_col)
    last = out.filter("once_more").groupBy("source_no").agg(F.max(F.struct((-F.col("key")).alias("k"), F.col("doc_id"), F.col("size"))).alias("_mix_last"))
    cuts = common.written(sources.join(last, "source_no", "left").select(F.col("named").alias("_mix_source"), F.col("epochs").alias("_mix_epochs"), "_mix_last"), "mix-cuts")
    place = F.struct((-key_of(F.col(id_col), F.col(text_col), seed)).alias("k"), F.col(id_col).alias("doc_id"), size_of(F.col(text_col)).alias("size"))
    copies = F.col("_mix_epochs") + F.coalesce(place <= F.col("_mix_last"), F.lit(False)).cast("long")
    rows = docs.join(cuts, F.col(source_col).eqNullSafe(F.col("_mix_source"))).withColumn("_mix_copies", copies).filter("_mix_copies > 0")
    return rows.withColumn("_mix_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         greatest(0.1, 1.0::DOUBLE - len(regexp_extract_all(coalesce(text, ''), '[#$%&*!|~^<>{}=@]')) * 5.0::DOUBLE / greatest(length(coalesce(text, '')), 1)) AS w,
         (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM d GROUP BY source),
w AS (SELECT *, CASE (source_no - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
o AS (SELECT *, 2.0::DOUBLE * source_size / weight AS stop FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - 2.0::DOUBLE * coalesce(CAST(sum(source_size) OVER b AS DOUBLE), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM o WINDOW b AS (ORDER BY stop, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, max(CASE WHEN level <= stop THEN level END) OVER () AS the_level FROM l),
t AS (SELECT source, source_size, CASE WHEN the_level IS NULL THEN 2.0::DOUBLE * source_size ELSE least(2.0::DOUBLE * source_size, the_level * weight) END AS target FROM m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS budget,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY pow(u, 1.0::DOUBLE / w) DESC, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST((epochs + CASE WHEN fin <= budget OR (fin - size < budget AND fin - budget <= budget - (fin - size)) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""
