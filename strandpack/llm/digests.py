"""Operator 7, document fingerprints, by DataFrame functions only.

A text's canonical form is its NFKC form, folded in case (upper, then lower case) and in
white space. Its fingerprint is a wide digest of that form, two XXH64 hashes of it with
unlike prefixes. Documents in a bucket of equal digests are compared byte by byte, and
edited texts in it by a third hash; should two differ, the digest gets the rank of its text
in the bucket as a suffix, so that equal fingerprints mean equal canonical texts.

The edited text of a document needs the next document, by descending id. Rows are dealt to
ranges between quantiles of a random sample of (id, first characters), in one shuffle of
the texts, which carries their digests along; the first rows of each range go to the range
before it as well, and a window within the range does the rest.

Defined cases: a null text is empty; ids are integers anywhere in the range of a long, null
ids come last; repeated ids follow each other by text, exact repeats in any order; the next
document of the last is the first (its own, if it is the only one); rows that share an id
and the first ``PREFIX`` characters share a range; very long texts are read whole; extra
columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandpack.llm import common

ODD = r"\t-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Runs of white space other than one plain space.
SPACE = rf"[{ODD}][ {ODD}]*| [ {ODD}]+"
#: Characters that tell rows of one id apart when ranges are cut; bounds that one step of the search looks at.
PREFIX, STEP = 32, 32


def canonical(text: Column) -> Column:
    """NFKC, case and white space folded. ICU is among Spark's own libraries."""
    composed = F.when(text.rlike(r"[^\x00-\x7F]"), F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))).otherwise(text)
    # white space is folded between the two, as the optimiser would drop the upper case of lower(upper(x))
    return F.trim(F.lower(F.regexp_replace(F.upper(composed), SPACE, " ")))


def wide(canon: Column) -> Column:
    return F.struct(F.xxhash64(canon).alias("h"), F.xxhash64(F.lit("wide"), canon).alias("g"))


def with_third(digest):
    return lambda canon: digest(canon).withField("k", F.xxhash64(F.lit("third"), canon))


def shown(digest: str, rank: Column) -> Column:
    out = F.concat(F.lower(F.lpad(F.hex(f"{digest}.h"), 16, "0")), F.lower(F.lpad(F.hex(f"{digest}.g"), 16, "0")))
    return F.when(F.coalesce(rank, F.lit(0)) > 0, F.concat(out, F.lit("-"), rank.cast("string"))).otherwise(out)


# -- neighbours ---------------------------------------------------------------------


def place(id_col: Column, text: Column) -> Column:
    """A key in the order of the documents: descending ids, null last, then by text."""
    return F.struct(id_col.isNull().alias("nameless"), F.coalesce(F.bitwise_not(id_col), F.lit(0)).cast("long").alias("id"), F.substring(text, 1, PREFIX).alias("prefix"))


def bounds(base: DataFrame, n: int, rows_per_range: int, per_range: int = 16) -> list:
    """Keys that cut the rows in ranges of about ``rows_per_range``, or as many ranges as
    the cluster's shuffle partitions warrant: quantiles of a sample of ``per_range`` a range."""
    count = max(1, min(-(-n // rows_per_range), max(1024, 8 * common.shuffle_partitions(base.sparkSession))))
    sample = base.filter(F.rand(7) < min(1.0, count * per_range / n)).select(place(F.col("doc_id"), F.col("text")).alias("at"))
    keys = sorted((r["at"]["nameless"], r["at"]["id"], r["at"]["prefix"]) for r in sample.collect())
    return sorted({keys[len(keys) * k // count] for k in range(1, count)} if keys else [])


def range_of(key: Column, cuts: list) -> Column:
    """How many of the ``cuts`` are at or before the key: first by every ``STEP``-th, then among those between."""
    if not cuts:
        return F.lit(0)
    keys = lambda some: F.array(*(F.struct(F.lit(a).alias("nameless"), F.lit(b).cast("long").alias("id"), F.lit(c).alias("prefix")) for a, b, c in some))
    reached = lambda some: F.size(F.filter(some, lambda c: c <= key))
    coarse = F.greatest(reached(keys(cuts[::STEP])) - 1, F.lit(0)) * STEP
    return (coarse + reached(F.slice(keys(cuts), coarse + 1, STEP))).cast("int")


def with_next(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int = 512, digest=wide) -> DataFrame:
    """(doc_id, text, d, next_text, next_d): by descending id, the first follows the last; d is the digest of the canonical text."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = base.count()
    key = place(F.col("doc_id"), F.col("text"))
    cuts = bounds(base, n, rows_per_range) if n else []
    base = base.withColumn("part", range_of(key, cuts))
    # the ranges' number is bounded by the cluster's shuffle partitions, so their heads are a small table
    heads = base.groupBy("part").agg(F.min(key).alias("head"))
    order = Window.orderBy("part")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("head", F.coalesce(F.lag("part").over(order), F.last("part").over(everything)).alias("before"))
    heads = common.written(heads, "range-heads")
    # every row goes to its range, the first ones also (as guests, behind all others) to the range before
    own = F.struct(F.col("part"), F.lit(0).alias("guest"))
    visit = F.struct(F.col("before").alias("part"), F.lit(1).alias("guest"))
    # a column of its own, as an expression with a Java call in it is never shared
    base = base.withColumn("canon", canonical(F.col("text"))).withColumn("d", with_third(digest)(F.col("canon"))).drop("canon")
    placed = base.join(F.broadcast(heads), key == F.col("head"), "left")
    at = F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, visit))).alias("at")
    # plain columns, as a window over fields of a structure would shuffle again for each of its expressions
    placed = placed.select("doc_id", "text", "d", at).select("doc_id", "text", "d", "at.part", "at.guest")
    window = Window.partitionBy("part").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    placed = placed.withColumns({"next_text": F.lead("text").over(window), "next_d": F.lead("d").over(window)})
    return placed.filter("guest = 0").select("doc_id", "text", "d", "next_text", "next_d")


def edited_text() -> Column:
    half = F.floor(F.length("text") / 2).cast("int")
    return F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))


# -- buckets ------------------------------------------------------------------------


def raw(text: Column) -> Column:
    return F.xxhash64(F.lit("raw"), text)


def unlike_buckets(docs: DataFrame, rows: DataFrame, text_col: str, digest) -> DataFrame:
    """(h, g) of the digests that texts of unlike bytes share.

    Only the documents in buckets of several are folded again; they are found by the hashes
    of their texts, which copies share. The least and greatest text of a bucket tell
    whether all are equal, and are found in parts however large it is.
    """
    of = lambda name: rows.select("raw", F.col(f"{name}.h").alias("h"), F.col(f"{name}.g").alias("g"), F.col(f"{name}.k").alias("k"))
    third = of("d").unionByName(of("e")).groupBy("h", "g").agg(F.min("k").alias("low"), F.max("k").alias("high")).filter("low <> high").select("h", "g")
    several = of("d").groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "g")
    members = common.written(of("d").select("raw", "h", "g").distinct().join(several, ["h", "g"], "left_semi").select("raw").distinct(), "equal-digests")
    canon = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("raw", raw(F.col("text"))).join(members, "raw", "left_semi")
    canon = canon.select(canonical(F.col("text")).alias("canon")).select("canon", digest(F.col("canon")).alias("d"))
    bytes_ = canon.groupBy("d.h", "d.g").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).filter("low <> high").select("h", "g")
    return common.written(bytes_.unionByName(third).distinct(), "unlike-digests")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=wide) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    An exact digest knows two likenesses only: 1 for equal fingerprints, 0 for all others.
    """
    text = with_next(docs, id_col, text_col, digest=digest).withColumn("edited", edited_text())
    text = text.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "d", canonical(F.col("edited")).alias("canon"), "next_d", raw(F.col("text")).alias("raw"), "text", "edited", "next_text")
    text = text.withColumn("e", with_third(digest)(F.col("canon"))).drop("canon")
    rows = common.written(text.drop("text", "edited", "next_text"), "digests")
    unlike = unlike_buckets(docs, rows, text_col, digest)
    names = {"d": "text", "e": "edited", "next_d": "next_text"}
    if unlike.isEmpty():
        rows = rows.withColumns({f"{d}_rank": F.lit(0) for d in names}).drop("raw")
    else:  # ranks of the texts in these buckets
        canon = common.written(text.select("doc_id", "n_chars", "edited_sha256", *names, *(canonical(F.col(t)).alias(t) for t in names.values())), "canonical-texts")
        some = None
        for d, t in names.items():
            one = canon.select(F.col(f"{d}.h").alias("h"), F.col(f"{d}.g").alias("g"), F.col(t).alias("canon")).join(unlike, ["h", "g"], "left_semi")
            some = one if some is None else some.unionByName(one)
        ranks = some.distinct().withColumn("rank", F.dense_rank().over(Window.partitionBy("h", "g").orderBy("canon")) - 1)
        ranks = common.written(ranks, "ranks")
        rows = canon
        for d, t in names.items():
            side = ranks.select(F.col("h").alias("_h"), F.col("g").alias("_g"), F.col("canon").alias("_canon"), F.col("rank").alias(f"{d}_rank"))
            rows = rows.join(side, (F.col(f"{d}.h") == F.col("_h")) & (F.col(f"{d}.g") == F.col("_g")) & (F.col(t) == F.col("_canon")), "left").drop("_h", "_g", "_canon")
    name = lambda d: shown(d, F.col(f"{d}_rank"))
    near = lambda d: F.when(name("d") == name(d), F.lit(1.0)).otherwise(F.lit(0.0))
    return rows.select("doc_id", "n_chars", "edited_sha256", name("d").alias("fingerprint"), name("e").alias("edited_fingerprint"), near("e").alias("near_edited"), near("next_d").alias("near_next"))
