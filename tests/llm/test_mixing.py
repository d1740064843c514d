"""Operator 3: targets and takings, by SQL and by hand."""

from collections import Counter, defaultdict

import pytest
from oracle import connect, same

from conftest import DATA
from strandpack.llm import mixing, queries


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mix_agrees_with_sql(spark, sf):
    if not (DATA / sf).exists():
        pytest.skip("no test tables")
    same(queries.op3_mixing(spark, str(DATA / sf)), connect(str(DATA / sf)), mixing.ORACLE)


def docs(spark):
    rows = [(i, "w " * (1 + i * 7 % 40) + ("### " if i % 9 == 0 else ""), ["hot", "hot", "b", None, "ü"][i % 5], 1.0, 1) for i in range(600)]
    rows += [(700, None, "b", 1.0, 1), (701, "", "empty", 0.0, 1), (702, "long " * 5000, "hot", 0.0, 1), (703, "x y", "b", 0.0, 1), (703, "x y", "b", 0.0, 1), (None, "no id", "b", 0.0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target double, epochs long")


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, free, budget = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return target


def test_targets_and_takings(spark):
    df = docs(spark)
    got = mixing.mix(df, rows_per_range=16).collect()
    source = defaultdict(list)
    for r in df.collect():
        source[r.doc_id].append(r.source)
    sizes, taken, targets, biggest = Counter(), Counter(), {}, Counter()
    for r in got:
        s = source[r.doc_id][0]
        sizes[s] += r.size
        taken[s] += r.taken
        targets[s] = r.target
        biggest[s] = max(biggest[s], r.size)
        assert r.taken <= 2 * r.size
        assert r.size == len((next(x.text for x in [r0 for r0 in df_rows(df) if r0.doc_id == r.doc_id]) or "").split())
    want = slow_targets(sizes)
    for s in sizes:
        assert abs(targets[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= biggest[s]
    again = mixing.mix(df.repartition(5), rows_per_range=64).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)


_rows = {}


def df_rows(df):
    if id(df) not in _rows:
        _rows[id(df)] = df.collect()
    return _rows[id(df)]


def test_repeat_gives_the_copies_that_mix_counts(spark):
    df = docs(spark)
    counts = Counter(r.doc_id for r in mixing.repeat(df).collect())
    assert mixing.repeat(df).columns == df.columns
    for r in mixing.mix(df).collect():
        if r.size and r.doc_id != 703:
            assert counts[r.doc_id] == r.taken // r.size, r


def test_empty_table(spark):
    empty = docs(spark).limit(0)
    assert mixing.mix(empty).count() == 0 and mixing.repeat(empty).count() == 0


def test_ranges_are_even_whatever_the_weights(spark):
    from pyspark.sql import functions as F

    rows = 60000
    for weight in (0.1, 1.0, None):
        w = F.lit(weight) if weight else F.when(F.col("id") % 3 == 0, 0.1).otherwise(1.0)
        keys = spark.range(rows).select(F.pow(mixing.uniform(F.col("id"), "mix"), 1 / w).alias("key"))
        parts = keys.select("key", mixing.range_of(F.col("key"), F.lit(rows), 512).alias("part"))
        sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("part").collect()
        assert max(r.n for r in sizes) < 2 * 512 and sizes[0].part >= 0
        assert all(a.low > b.high for a, b in zip(sizes, sizes[1:]))


def test_sums_ahead_in_two_levels(spark):
    parts = [(s, p, (p * 7 + s) % 11) for s in (1, 2) for p in range(0, 300, 1 + s)]
    got = {(r.source_no, r.part): r.ahead for r in mixing.sums_ahead(spark.createDataFrame(parts, "source_no int, part long, part_size long"), 16).collect()}
    assert got == {(s, p): sum(n for t, q, n in parts if t == s and q < p) for s, p, _ in parts}
