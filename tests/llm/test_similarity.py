"""Operators 5, 7 and 8 against brute force."""

import hashlib
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from oracle import connect, same
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import DATA
from strandpack.llm import digests, graph, queries, simhash, topk


# -- 5 ---------------------------------------------------------------------------------


def slow_fingerprint(text, width=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints, bits):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(set(prints))
    for a in range(len(distinct)):
        for b in range(a):
            if (distinct[a] ^ distinct[b]).bit_count() <= bits:
                root[find(distinct[a])] = find(distinct[b])
    least = {}
    for i, p in zip(ids, prints):
        least[find(p)] = min(least.get(find(p), i), i)
    return [least[find(p)] for p in prints]


def near_docs(spark):
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(60):
        base = list(rng.choice(words, int(rng.integers(3, 120))))
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 6))):
            copy = list(base)
            copy[int(rng.integers(len(copy)))] = str(rng.choice(words))
            texts.append(" ".join(copy))
    texts += ["", None, " \t\n", "one", "ONE", "one two", "É X", "é x", "a\x0bb c d e", "a b c d e f"] + [texts[0]] * 5
    rows = [(i, t, f"c{i}", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, fp long"), texts


@pytest.mark.parametrize("limit", [1024, 3])
def test_components_by_brute_force(spark, limit):
    df, texts = near_docs(spark)
    got = {r.doc_id: r for r in simhash.near_duplicates(df, group_limit=limit).collect()}
    prints = [slow_fingerprint(t) for t in texts]
    want = slow_components(range(len(texts)), prints, 4)
    for i in range(len(texts)):
        assert got[i].fingerprint == f"{prints[i]:016x}"
        assert got[i].component_id == want[i]


def test_fingerprints_of_random_bits_by_brute_force(spark):
    """Chains of near fingerprints, many of them in one group."""
    rng = np.random.default_rng(1)
    fps = set()
    for _ in range(40):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(i, simhash.signed(x)) for i, x in enumerate(fps)], "doc_id long, fp long")
    names = {r.fp: r.component_id for r in simhash.classes(df, 4, group_limit=5).collect()}
    assert [names[simhash.signed(x)] for x in fps] == slow_components(range(len(fps)), fps, 4)


def test_keep_first_keeps_one_of_a_group_and_all_columns(spark):
    text = " ".join(f"t{k}" for k in range(200))
    rows = [(5, text, 1), (3, text + " more", 2), (9, text, 3), (7, "another text that is unlike the others", 4), (7, "another text that is unlike the others", 5), (None, "x", 6), (None, "x", 7), (11, None, 8), (12, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.keep_first(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 3), (False, 7), (False, 11), (True, 0)]
    assert simhash.keep_first(df.limit(0)).count() == 0


def test_keep_first_tells_rows_of_one_id_and_of_none_apart(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(200)) for x in "abcd")
    rows = [(7, a), (7, b), (7, b), (3, a + " more"), (None, b + " more"), (None, c), (None, c + " more"), (None, d), (9, "long " * 300000 + d), (10, "long " * 200000 + d)]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or -1, r.text[:1]) for r in got) == [(-1, "c"), (3, "a"), (7, "b"), (9, "l")]


def slow_kept(texts, width=5, least=0.8):
    """The smallest id of each group that pairs of ``least`` or more connect, ids being positions."""
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    find = lambda k: k if root[k] == k else find(root[k])
    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9:
                hi, lo = max(find(a), find(b)), min(find(a), find(b))
                root[hi] = lo
    return {k for k in range(len(sets)) if find(k) == k}


def kept_ids(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in simhash.keep_first(df, **kw).collect()}


@pytest.mark.parametrize("limit", [simhash.SET_LIMIT if hasattr(simhash, "SET_LIMIT") else None, 900])
def test_near_copies_at_the_threshold_by_brute_force(spark, limit):
    """Pairs from 0.70 to 0.90, most of them about 0.8; a small limit cuts groups in chunks."""
    rng = np.random.default_rng(5)
    texts = []
    for k in range(150):
        base, other = ([f"{x}{k}_{i}" for i in range(204)] for x in "ab")
        cut = int(rng.integers(10, 36))
        texts += [" ".join(base), " ".join(base[: 204 - cut] + other[:cut])]
    texts += [" ".join(f"c{i}" for i in range(n, n + 120)) for n in range(0, 130, 13)]
    want = slow_kept(texts)
    assert kept_ids(spark, texts, **({"set_limit": limit} if limit else {})) == want
    assert 30 < len(texts) - len(want) < 150


def test_a_repeated_line_alone_links_nothing(spark):
    """Shingles that repeat count once: these texts have a similarity of 0.1 or less."""
    line = " ".join(f"s{i}" for i in range(24))
    texts = [" ".join([line] * 20 + [f"w{k}_{i}" for i in range(n)]) for k, n in enumerate([100, 200] * 10)]
    assert kept_ids(spark, texts) == set(range(20)) == slow_kept(texts)


def test_equal_fingerprints_are_compared_and_keep_their_links(spark):
    """One fingerprint for all texts, which are near copies only two by two."""
    line = " ".join(f"s{i}" for i in range(25))
    texts = []
    for k in range(12):
        own = [f"w{k}_{i}" for i in range(100)]
        texts += [" ".join([line] * 400 + own), " ".join([line] * 400 + own + ["more"] * 4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.fingerprints(df, 5).select("fp").distinct().count() == 1
    assert kept_ids(spark, texts) == set(range(0, 24, 2)) == slow_kept(texts)


def slow_wide(shingles):
    factors = simhash.wide_factors().tolist()
    sums = np.zeros((2, 4 * len(factors)), int)
    for h in shingles:
        for k, f in enumerate(factors):
            z = h * f % 2**64
            z = (z ^ z >> 32) * 0xD6E8FEB86659FD93 % 2**64
            z ^= z >> 32
            for byte in range(8):
                sums[byte % 2, 4 * k + byte // 2] += 2 * (z >> 8 * byte & 255) - 255
    return np.packbits(sums.ravel() > 0).tobytes()


def test_wide_fingerprints_by_brute_force():
    rng = np.random.default_rng(6)
    for n in (1, 2, 7, 300):
        shingles = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        assert simhash.wide_fingerprint(shingles, simhash.wide_factors()) == slow_wide(shingles.tolist())


def test_wide_fingerprints_find_near_sets_of_any_size():
    """At a similarity of 0.8 a block agrees and the check passes, for small sets too."""
    rng, factors = np.random.default_rng(7), simhash.wide_factors()
    for a, b, both in ((4, 5, 4), (9, 9, 8), (18, 18, 16), (80, 100, 80), (180, 180, 160)):
        found = 0
        for _ in range(300):
            x = rng.integers(0, 1 << 64, a + b - both, dtype=np.uint64)
            members = np.zeros((simhash.BLOCKS, 2), simhash.MEMBER)
            for k, part in enumerate((x[:a], x[a - both :])):
                bits = np.frombuffer(simhash.wide_fingerprint(part, factors), np.uint8)
                members["check"][:, k] = bits[: simhash.CHECK_BITS // 8].view("<u8")
                members["key"][:, k] = bits[simhash.CHECK_BITS // 8 :].view("<u2")
                members["size"][:, k], members["name"][:, k] = len(part), k
            found += any(len(simhash.block_links(m, 0.8)[0]) for m in members)
        assert found >= 299


@pytest.mark.parametrize("limit, most", [(512, 1 << 20), (4, 1 << 20), (512, 7)])
def test_links_of_a_block_by_brute_force(limit, most):
    rng = np.random.default_rng(8)
    members = np.zeros(150, simhash.MEMBER)
    members["key"], members["size"], members["name"] = rng.integers(0, 5, 150), rng.integers(80, 125, 150), rng.permutation(150)
    near = rng.integers(0, 1 << 64, (12, 2), dtype=np.uint64)[rng.integers(0, 12, 150)]
    members["check"] = near ^ (np.uint64(1) << rng.integers(0, 64, (150, 2), dtype=np.uint64)) ^ rng.integers(0, 1 << 18, (150, 2), dtype=np.uint64)

    def may_be_near(x, y):
        bits = sum(int(p ^ q).bit_count() for p, q in zip(x["check"], y["check"]))
        return x["key"] == y["key"] and min(x["size"], y["size"]) >= 0.8 * max(x["size"], y["size"]) and bits <= simhash.CHECK_LIMIT

    want = {(int(x["name"]), int(y["name"])) for x in members for y in members if x["name"] < y["name"] and may_be_near(x, y)}
    i, j = np.array(sorted(want)).T
    root = simhash.forest(150, i, j).tolist()
    got = dict(zip(*(x.tolist() for x in simhash.block_links(members, 0.8, limit, most))))
    assert len(want) > 50 and got == {k: r for k, r in enumerate(root) if k != r}
    members["name"] = 7  # one group already
    assert not len(simhash.block_links(members, 0.8, limit, most)[0])


def test_the_stage_finds_its_candidates_by_fingerprints_and_pivots(spark, monkeypatch):
    """No other sketch takes part, and no pair of near fingerprints is lost before the exact check."""
    seen, links = [], simhash.links

    def spy(distinct, *args):
        seen.append({r.fp: list(r.distances) for r in distinct.collect()})
        return links(distinct, *args)

    monkeypatch.setattr(simhash, "links", spy)
    df, texts = near_docs(spark)
    kept = {r.doc_id for r in corpus_pipeline.dedup_stage(spark, df, "").collect()}
    sets = {i: simhash.distinct_shingles(t, 5) for i, t in enumerate(texts)}
    prints = {i: simhash.majority(x) for i, x in sets.items() if len(x)}
    table = {fp: [((fp & (1 << 64) - 1) ^ p).bit_count() for p in simhash.pivots().tolist()] for fp in prints.values()}
    assert seen == [table] and kept < set(range(len(texts)))

    rows = simhash.shingle_sets(df, 5, "doc_id", "text").dropDuplicates(["node"])
    root = {r.node: r.root for r in simhash.candidates(rows, 0.8).collect()}
    node = {i: simhash.set_name(x) for i, x in sets.items()}
    near = [(i, j) for i in prints for j in prints if node[i] < node[j] and ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= simhash.MAX_BITS]
    assert near and all(root[node[i]] == root[node[j]] for i, j in near)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(300, 300)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 160)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 7 ---------------------------------------------------------------------------------


def slow_canonical(text):
    folded = unicodedata.normalize("NFKC", text or "").upper().lower()
    return re.sub(r"[\s\x85\xa0  -     　]+", " ", folded).strip(" ")


def fold_docs(spark):
    texts = ["Hello  World", "hello\tworld ", "ﬁne ①", "fine 1", "Straße", "STRASSE", "é", "É", "", None, " ", "　x y", "X Y", "日本", "😀 ok", "long " * 20000, "abc", "abc", "ΟΔΟΣ", "οδοσ", "a" * 7]
    rows = [(3 * k + 1, t, "clash", 1.0) for k, t in enumerate(texts)] + [(400, "again", "c", 1.0), (400, "again", "c", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, part double")


def check_digests(rows, got):
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    want = defaultdict(list)
    for k, (i, t) in enumerate(order):
        text, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want[i].append((len(text), hashlib.sha256(edited.encode()).hexdigest(), float(slow_canonical(edited) == slow_canonical(text)), float(slow_canonical(after) == slow_canonical(text))))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.n_chars, r.edited_sha256, r.near_edited, r.near_next))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_digests_by_brute_force(spark):
    df = fold_docs(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = digests.fingerprints(df).collect()
    check_digests(rows, got)
    canon = {i: slow_canonical(t) for i, t in rows}
    by = defaultdict(set)
    for r in got:
        by[r.fingerprint].add(canon[r.doc_id])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(canon.values()))
    assert all((r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0) for r in got)


def test_many_ranges_and_sparse_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), f"text {k} " * int(rng.integers(1, 9))) for k, i in enumerate(rng.choice(10**12, 150, replace=False))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = digests.with_next(df, "doc_id", "text", rows_per_range=4).collect()
    order = sorted(rows, reverse=True)
    assert {r.doc_id: r.next_text for r in got} == {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}


def test_ids_anywhere_in_the_range_of_a_long(spark):
    """Far ids, one far from all others, many null ids and many rows of one id."""
    rng = np.random.default_rng(4)
    ids = [-(2**63), 2**63 - 1, -1, 0, 5, *map(int, rng.integers(-(2**62), 2**62, 60)), *range(100, 160), 2**60]
    rows = [(i, f"text {k}") for k, i in enumerate(ids)] + [(None, f"{k:03d} nameless") for k in range(150)] + [(7, f"{k:03d} again") for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {r: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
    for n in (4, 512):
        got = digests.with_next(df, "doc_id", "text", rows_per_range=n)
        assert {(r.doc_id, r.text): r.next_text for r in got.collect()} == want
    cuts = digests.bounds(df, len(rows), 16)
    sizes = df.groupBy(digests.range_of(digests.place(F.col("doc_id"), F.col("text")), cuts).alias("part")).count().collect()
    assert len(cuts) > 20 and max(r["count"] for r in sizes) < 16 * 6 and {r.part for r in sizes} <= set(range(len(cuts) + 1))


def test_colliding_digests_are_told_apart_by_bytes(spark):
    """With a digest of the length alone, the ranks keep unlike texts apart."""
    weak = lambda c: F.struct(F.length(c).cast("long").alias("h"), F.lit(0).cast("long").alias("g"))
    df = fold_docs(spark)
    got = digests.fingerprints(df, digest=weak).collect()
    rows = [(r.doc_id, r.text) for r in df.collect()]
    check_digests(rows, got)
    canon = {i: slow_canonical(t) for i, t in rows}
    by = defaultdict(set)
    for r in got:
        by[r.fingerprint].add(canon[r.doc_id])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(canon.values()))


def test_digests_of_few_rows(spark):
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    r = digests.fingerprints(one).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert digests.fingerprints(one.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "b"), (None, "a"), (2, "c")], "doc_id long, text string")
    assert {(r.doc_id, r.text): r.next_text for r in digests.with_next(nameless, "doc_id", "text").collect()} == {(2, "c"): "a", (None, "a"): "b", (None, "b"): "c"}


# -- 8 ---------------------------------------------------------------------------------


def slow_topk(rows, k=5, every=50):
    sound = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in sound:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_topk_by_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.3, 16).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 460)] + [(i, [0.0] * 16) for i in range(460, 505)]
    rows += [(600, None), (650, [None] * 16), (700, [float("nan")] * 16), (750, [float("inf")] + [0.0] * 15), (800, [1.0, 2.0]), (None, [0.1] * 16)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    for shard_rows, block_rows in ((8192, 4096), (37, 3)):
        got = topk.search(df, F.col("vec_id") % 50 == 0, shard_rows=shard_rows, block_rows=block_rows)
        assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == slow_topk(rows)


def test_topk_with_few_or_huge_vectors(spark):
    huge = [(0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [-1e30, 5.0])]
    df = spark.createDataFrame(huge, "vec_id long, embedding array<float>")
    got = topk.search(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (2, -(2**63))]
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    alone = df.filter("vec_id = 0")
    assert topk.search(alone, F.col("vec_id") % 50 == 0).count() == 0


def test_large_components_by_brute_force():
    rng = np.random.default_rng(2)
    for width, high in ((3, 2.0**30), (8, 1e30), (5, 1e300)):
        x = np.floor(rng.normal(0, 1, (300, width)) * high)
        x[100:140] = x[:40]
        x[200:220] = 0
        ids, q = np.arange(300), np.arange(0, 300, 7)
        limit = 2**63 - 1
        want = set()
        for i in q.tolist():
            scored = sorted((-sum(int(a) * int(b) for a, b in zip(x[i].tolist(), x[j].tolist())), j) for j in range(300) if j != i)
            want |= {(i, j, max(-limit - 1, min(limit, -v))) for v, j in scored[:5]}
        assert set(topk.by_bounds(x[q], q, x, ids, 5)) == want


def test_trees_of_ill_placed_points_stay_shallow():
    depth = lambda n: 1 + max(map(depth, n.children), default=0)
    for x in (np.eye(1600) * 256, np.zeros((2000, 4)), np.arange(3000.0)[:, None], np.repeat(np.eye(8) * 99, 300, axis=0)):
        tree = topk.build(x, np.arange(len(x)), topk.LEAF)
        assert depth(tree) < 20
        s = topk.Search(x[::100], np.arange(0, len(x), 100), x, np.arange(len(x)), 5)
        s.run()
        want = x[::100] @ x.T
        want[np.arange(len(want)), np.arange(0, len(x), 100)] = -np.inf
        assert (s.scores == -np.sort(-want, axis=1)[:, :5]).all()


def test_the_trees_prune(spark):
    """Clustered data: most leaves are never scored, and nothing is lost."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 300, (40, 24))
    x = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(0, 6, (4000, 24)))
    s = topk.Search(x[::50], np.arange(0, 4000, 50), x, np.arange(4000), 5)
    s.run()
    want = x[::50] @ x.T
    want[np.arange(80), np.arange(0, 4000, 50)] = -np.inf
    assert (s.scores == -np.sort(-want, axis=1)[:, :5]).all()
    count = lambda n: sum(map(count, n.children)) if n.children else 1
    every = count(topk.build(s.q, np.arange(80), 4, loose=32)) * count(topk.build(x, np.arange(4000), topk.LEAF))
    assert s.leaves < 0.2 * every


def test_topk_agrees_with_sql(spark):
    if not (DATA / "sf0.01").exists():
        pytest.skip("no test tables")
    same(queries.op8_topk(spark, str(DATA / "sf0.01")), connect(str(DATA / "sf0.01")), topk.ORACLE)
