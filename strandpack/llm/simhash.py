"""Operator 5, SimHash near-duplicates with pivot distance tables.

Every text gets a 64-bit fingerprint: each bit is the majority over the XXH64 hashes of
its word shingles. Distinct fingerprints are dealt to groups that agree on a block of
bits: of five blocks at least one is free of differences when at most four bits differ,
so no link is lost. The Hamming distances of each distinct fingerprint to many reference
fingerprints (pivots) are tabulated beforehand; by the triangle inequality a pair of a group
whose coordinates differ by more than the limit anywhere is discarded, and the survivors
are verified. Groups above
``group_limit`` are split again: the bits that are not agreed on yet are cut in five
blocks once more, which again loses no link. What is above the limit even then is a
crowd of near fingerprints; it is cut in chunks, and every two chunks meet in a task of
their own. A group gives a spanning forest of its links, never all pairs.

``keep_first`` finds its candidates by the same fingerprints, taken of the distinct
shingles: those of ``MAX_BITS`` differing bits or fewer by block groups, pivot distances
and verification, as above. At a Jaccard similarity of 0.8 about ten bits of 64 differ,
where no pivot discards anything any more, so each set also has a wide fingerprint, whose
votes are signed bytes. Sets that agree on one of its 128 blocks of 16 bits are candidates
if their sizes (the distances to the empty set) and 128 further bits allow it. The groups
that candidates connect are gathered, and in each all pairs are compared by their exact
similarity. Groups above ``set_limit`` shingles are cut in chunks, and every two chunks
meet in a task of their own, so that a pair is lost only if no chain of candidates connects it.

Defined cases: a text without words (null and empty too) has fingerprint 0 and is linked
like any other; with fewer words than a shingle the whole sequence is the only shingle;
repeated rows share their fingerprint and component; null ids never name a component
unless it has no other; very long texts are hashed whole; ties do not arise, as groups are
named by their smallest id; extra columns are left out by ``near_duplicates`` and kept by
``keep_first``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandpack.llm import common, graph

SEED, MAX_BITS, PIVOTS = 42, 4, 24
#: Blocks of a wide fingerprint, and bits in a block: a pair of similarity 0.8 agrees on no block with a probability of 0.00007.
BLOCKS, BLOCK_BITS = 128, 16
#: Bits that check a pair, and how many of them may differ: 19 are expected to at similarity 0.8, and 64 of unlike sets.
CHECK_BITS, CHECK_LIMIT = 128, 40
#: A set as it is dealt to a block, with the name of the group that it is in already.
MEMBER = np.dtype([("key", "<u2"), ("size", "<u4"), ("name", "<i8"), ("check", "<u8", CHECK_BITS // 64)])
#: Distinct shingles that are compared in one task.
SET_LIMIT = 1 << 19


def shingle_hashes(text: str | None, width: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    return [xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts, ends[width - 1 :])]


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed 64-bit integer."""
    n = len(hashes)
    if not n:
        return 0
    rows = hashes.byteswap().view(np.uint8).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    for s in range(0, n, 255 * 256):
        bits = np.unpackbits(rows[s : s + 255 * 256], axis=1)
        whole = len(bits) // 255 * 255
        if whole:  # sums of 255 bits fit in a byte
            counts += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        counts += bits[whole:].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row's whole text; fp is signed."""
    common.bound_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            prints = [majority(np.array(shingle_hashes(t, width), np.uint64)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: zero, and pseudo-random ones."""
    from xxhash import xxh64_intdigest

    return np.array([0, *(xxh64_intdigest(b"pivot%d" % i, SEED) for i in range(1, n))], np.uint64)


def distances(fp: Column) -> Column:
    """The Hamming distances to all pivots."""
    return F.array(*(F.bit_count(fp.bitwiseXOR(F.lit(signed(p)))) for p in pivots().tolist())).cast("array<tinyint>")


def near_pairs(fps: np.ndarray, table: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) at a distance of ``max_bits`` or less; ``table`` has the distances to the pivots."""
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    # by the first coordinate, sorted, each row has its partners in a run behind it
    stop = np.searchsorted(table[:, 0], table[:, 0] + max_bits, side="right")
    runs = stop - np.arange(len(fps)) - 1
    i = np.repeat(np.arange(len(fps)), runs)
    j = np.arange(len(i)) - np.repeat(np.cumsum(runs) - runs, runs) + i + 1
    for p in range(1, table.shape[1]):
        keep = np.abs(table[i, p] - table[j, p]) <= max_bits
        i, j = i[keep], j[keep]
    keep = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
    return order[i[keep]], order[j[keep]]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches by the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def split_masks(mask: int, parts: int) -> list[int]:
    """``mask`` with each of ``parts`` blocks of the bits that it leaves open."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[s:e]) for s, e in zip(cuts, cuts[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, max_bits: int = MAX_BITS, group_limit: int = 1024) -> DataFrame:
    """(a, b): links that connect the fingerprints (fp, distances) at ``max_bits`` or less as all such links would."""
    spark = distinct.sparkSession
    common.bound_batches(spark)

    def run(batches):
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for group in batch.column(0):
                fps, table = group.values.flatten()
                fps, table = fps.to_numpy(), table.flatten().to_numpy().reshape(len(fps), -1)
                order = np.argsort(fps, kind="stable")
                fps, table = fps[order], table[order]
                root = forest(len(fps), *near_pairs(fps.view(np.uint64), table, max_bits))
                own = np.flatnonzero(root != np.arange(len(fps)))
                a.append(fps[own])
                b.append(fps[root[own]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def grouped(keyed: DataFrame, keys: list[str]) -> DataFrame:
        gathered = keyed.groupBy(*keys).agg(F.collect_list(F.struct("fp", "distances")).alias("members")).filter(F.size("members") > 1)
        return gathered.select("members").mapInArrow(run, "a long, b long")

    row, keys = ["fp", "distances"], ["mask", "bits"]
    masks = split_masks(0, max_bits + 1)
    keyed = distinct.select(*row, F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask")).withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
    found: DataFrame | None = None
    for last in (False, True):
        large = common.written(keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_limit), "large-groups")
        if large.isEmpty():
            pairs = grouped(keyed, keys)
            return pairs if found is None else found.unionByName(pairs)
        pairs = grouped(keyed.join(large, keys, "left_anti"), keys)
        found = pairs if found is None else found.unionByName(pairs)
        members = common.written(keyed.join(large, keys), "large-group-members")
        if not last:
            finer = F.create_map(*(F.lit(x) for m in masks for x in (signed(m), F.array(*(F.lit(signed(f)) for f in split_masks(m, max_bits + 1))))))
            keyed = members.select(*row, F.explode(finer[F.col("mask")]).alias("mask")).withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
    # what is large even so is one crowd of near fingerprints: its chunks meet pairwise, each pair in a task of its own
    count = F.ceil(F.col("n") * 2 / group_limit).cast("int")
    chunk = F.pmod(F.xxhash64("fp"), count).cast("int")
    met = members.select(*row, *keys, chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), count - 1)).alias("other"))
    met = met.select(*row, *keys, F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    return found.unionByName(grouped(met, [*keys, "low", "high"]))


def classes(prints: DataFrame, max_bits: int = MAX_BITS, group_limit: int = 1024) -> DataFrame:
    """(fp, component_id) for every distinct fp of (doc_id, fp)."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).withColumn("distances", distances(F.col("fp")))
    distinct = common.written(distinct, "fingerprints")
    roots = graph.components(links(distinct, max_bits, group_limit))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "doc_id")
    rooted = common.written(rooted, "roots")
    names = common.written(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "components")
    return common.written(rooted.select("fp", "root").join(names, "root").select("fp", "component_id"), "classes")


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text", group_limit: int = 1024) -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest doc_id reachable) of every row."""
    prints = common.written(fingerprints(docs, width, id_col, text_col), "prints")
    found = classes(prints, max_bits, group_limit)
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def distinct_shingles(text: str | None, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def set_name(shingles: np.ndarray) -> int:
    """A signed 64-bit digest of a set of shingles."""
    from xxhash import xxh64_intdigest

    return signed(xxh64_intdigest(shingles.tobytes(), SEED))


def wide_factors() -> np.ndarray:
    """Odd factors that mix a shingle into eight votes each."""
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(b"wide%d" % i, SEED) | 1 for i in range((CHECK_BITS + BLOCKS * BLOCK_BITS) // 8)], np.uint64)


def wide_fingerprint(shingles: np.ndarray, factors: np.ndarray) -> bytes:
    """The check and all blocks: each bit tells whether its votes, one signed byte of a shingle's hash, are positive in sum.

    Votes of unlike weights have hardly any ties, so that small sets are as near as large ones.
    """
    low = np.uint64(0x00FF00FF00FF00FF)
    sums = np.zeros((2, 4 * len(factors)), np.int64)
    for s in range(0, len(shingles), 256):  # sums of 256 bytes fit in 16 bits
        z = shingles[s : s + 256, None] * factors
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xD6E8FEB86659FD93)
        z ^= z >> np.uint64(32)
        sums[0] += (z & low).sum(0, dtype=np.uint64).view("<u2")
        z >>= np.uint64(8)
        sums[1] += (z & low).sum(0, dtype=np.uint64).view("<u2")
    return np.packbits(2 * sums.ravel() > 255 * len(shingles)).tobytes()


def block_links(members: np.ndarray, similarity: float, run_limit: int = 512, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): links from names to the smallest one that a member reaches by pairs of equal keys that may be near."""
    members = members[np.lexsort((members["name"], members["key"]))]
    key, name = (np.ascontiguousarray(members[x]) for x in ("key", "name"))
    size, check = members["size"].astype(np.int64), np.ascontiguousarray(members["check"])

    def near(i, j):
        fits = np.minimum(size[i], size[j]) + 1e-9 >= similarity * np.maximum(size[i], size[j])
        i, j = (x[fits] if np.ndim(x) else x for x in (i, j))
        fits[fits] = np.bitwise_count(check[i] ^ check[j]).sum(1, dtype=np.int64) <= CHECK_LIMIT
        return fits

    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    first, stop = np.searchsorted(key, key), np.searchsorted(key, key, side="right")
    short = np.flatnonzero(stop - first <= run_limit)
    runs = stop[short] - short - 1
    ends = np.cumsum(runs)
    cuts = np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + most, most))
    for s, e in zip(cuts, [*cuts[1:], len(short)]):
        i = np.repeat(short[s:e], runs[s:e])
        j = np.arange(len(i)) - np.repeat(np.cumsum(runs[s:e]) - runs[s:e], runs[s:e]) + i + 1
        keep = near(i, j)
        a.append(i[keep])
        b.append(j[keep])
    for s in np.unique(first[stop - first > run_limit]):
        # each member of a crowd is compared with all that are not reached yet
        left = np.arange(s, stop[s])
        while len(left):
            reached, left = [left[0]], left[1:]
            while reached and len(left):
                x = reached.pop()
                keep = near(x, left)
                reached += left[keep].tolist()
                a.append(left[keep])
                b.append(np.full(keep.sum(), x))
                left = left[~keep]
    root = forest(len(name), np.concatenate(a), np.concatenate(b))
    found = np.unique(np.stack([name, name[root]])[:, name != name[root]], axis=1)
    return found[0], found[1]


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The smallest index that each set reaches by pairs of ``similarity`` or more; all pairs count."""
    root, sizes = np.arange(len(sets)), np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = [flat[e - n : e] for e, n in zip(ends, sizes)]
    mark = np.zeros(len(values), bool)
    left = np.arange(len(sets))
    while len(left):
        first, left = left[0], left[1:]
        flat, reached = flat[sizes[first] :], [first]
        while reached and len(left):
            x = reached.pop()
            mark[own[x]] = True
            shared = np.add.reduceat(mark[flat], np.cumsum(sizes[left]) - sizes[left], dtype=np.int64)
            mark[own[x]] = False
            near = shared + 1e-9 >= similarity * (sizes[x] + sizes[left] - shared)
            if near.any():
                root[left[near]] = first
                reached += left[near].tolist()
                flat = flat[np.repeat(~near, sizes[left])]
                left = left[~near]
    return root


def shingle_sets(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, size, fp, wide) of every row: the name of its set of shingles, their number, and its fingerprints."""
    common.bound_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("node", T.LongType()), T.StructField("size", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("wide", T.BinaryType())])

    def run(batches):
        factors = wide_factors()
        for b in batches:
            sets = [distinct_shingles(t, width) for t in b.column(1).to_pylist()]
            columns = [pa.array(map(f, sets), pa.int64()) for f in (set_name, len, majority)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array([wide_fingerprint(x, factors) for x in sets], pa.binary())], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def wide_links(distinct: DataFrame, similarity: float, part_rows: int = 1 << 15) -> DataFrame:
    """(a, b): links that connect the groups of the sets (name, size, wide) as all pairs that agree on a block and may be near do."""
    common.bound_batches(distinct.sparkSession)
    shift = BLOCK_BITS - min(BLOCK_BITS, max(0, (distinct.count() // part_rows).bit_length()))

    def deal(batches):
        """The members of each block, by ranges of their keys, packed."""
        for b in held(batches):
            prints = np.frombuffer(b"".join(b.column("wide").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            keys = prints[:, CHECK_BITS // 8 :].copy().view("<u2")
            members = np.zeros(b.num_rows, MEMBER)
            members["size"], members["name"] = b.column("size").to_numpy(), b.column("name").to_numpy()
            members["check"] = prints[:, : CHECK_BITS // 8].copy().view("<u8")
            for block in range(BLOCKS):
                members["key"] = keys[:, block]
                part = keys[:, block] >> shift
                order = np.argsort(part, kind="stable")
                parts, at = np.unique(part[order], return_index=True)
                packed = pa.array([x.tobytes() for x in np.split(members[order], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), block, np.int32)), pa.array(parts.astype(np.int32)), packed], ["block", "part", "packed"])

    def held(batches, most: int = 1 << 14):
        rows, n = [], 0
        for b in batches:
            rows.append(b)
            n += b.num_rows
            if n >= most:
                yield pa.Table.from_batches(rows)
                rows, n = [], 0
        if n:
            yield pa.Table.from_batches(rows)

    def run(group: pa.Table) -> pa.Table:
        members = np.frombuffer(b"".join(group.column("packed").to_pylist()), MEMBER)
        return pa.table(dict(zip("ab", block_links(members, similarity))))

    dealt = distinct.select("name", "size", "wide").mapInArrow(deal, "block int, part int, packed binary")
    return dealt.groupBy("block", "part").applyInArrow(run, "a long, b long")


def candidates(distinct: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of all sets (node, size, fp, wide) that are near another one by a fingerprint, in the groups that these connect."""
    distinct = distinct.filter("size > 0")
    prints = common.written(distinct.groupBy("fp").agg(F.min("node").alias("node")).withColumn("distances", distances(F.col("fp"))), "fingerprints")
    same = distinct.select(F.col("node").alias("a"), "fp").join(prints.select("fp", F.col("node").alias("b")), "fp").filter("a <> b").select("a", "b")
    left, right = (prints.select(F.col("fp").alias(end), F.col("node").alias(f"{end}_node")) for end in "ab")
    near = links(prints).join(left, "a").join(right, "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    # a crowd of near fingerprints is one group from here on, so that wide fingerprints link it as one
    close = common.written(graph.components(same.unionByName(near)), "close-sets").withColumnsRenamed({"node": "a", "root": "b"})
    named = distinct.join(close, F.col("node") == F.col("a"), "left").select(F.coalesce("b", "node").alias("name"), "size", "wide")
    found = graph.components(close.unionByName(wide_links(common.written(named, "named-sets"), similarity)))
    return common.written(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "candidates")


def alike_links(docs: DataFrame, distinct: DataFrame, width: int, similarity: float, id_col: str, text_col: str, set_limit: int) -> DataFrame:
    """(a, b): links that connect the sets of ``distinct`` as all pairs of ``similarity`` or more do in each candidate group.

    Each candidate set is read from one document that has it: only these documents meet
    the second computation of shingles. The texts are shuffled to them at every size.
    """
    common.bound_batches(docs.sparkSession)
    more = "node long, root long, meets array<struct<low: int, high: int>>"

    def read(batches):
        for b in batches:
            names, sets = b.column(1).to_pylist(), [distinct_shingles(t, width) for t in b.column(0).to_pylist()]
            same = pa.array([set_name(x) == n for x, n in zip(sets, names)], pa.bool_())  # of rows that repeat an id, those with the set
            shingles = pa.array([x.tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], shingles], ["node", "root", "meets", "shingles"]).filter(same)

    def read_nameless(batches):
        for b in batches:
            sets = [distinct_shingles(t, width) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_name, sets), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])

    def run(batches):
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for group in batch.column(0):
                names, sets = group.values.flatten()
                nodes, at = np.unique(names.to_numpy(), return_index=True)
                root = alike([np.frombuffer(sets[int(k)].as_buffer(), np.uint64) for k in at], similarity)
                own = np.flatnonzero(root != np.arange(len(nodes)))
                a.append(nodes[own])
                b.append(nodes[root[own]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    groups = common.written(candidates(distinct, similarity).join(distinct.select("node", "size", "doc_id"), "node"), "candidate-sizes")
    chunks = groups.groupBy("root").agg(F.sum("size").alias("total"))
    chunks = chunks.select("root", F.when(F.col("total") > set_limit, F.ceil(F.col("total") * 2 / set_limit)).otherwise(1).cast("int").alias("count"))
    chunk = F.pmod(F.xxhash64("node"), F.col("count")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda o: F.struct(F.least(chunk, o).alias("low"), F.greatest(chunk, o).alias("high")))
    met = common.written(groups.join(chunks, "root").select(F.col("doc_id").alias("_read"), "node", "root", meets.alias("meets")), "meetings")
    named = met.filter(F.col("_read").isNotNull()).hint("shuffle_hash")
    gathered = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(named, F.col("_id") == F.col("_read")).select("_text", "node", "root", "meets").mapInArrow(read, f"{more}, shingles binary")
    nameless = met.filter(F.col("_read").isNull()).drop("_read")
    if not nameless.isEmpty():
        rows = docs.filter(F.col(id_col).isNull()).select(text_col).mapInArrow(read_nameless, "node long, shingles binary")
        gathered = gathered.unionByName(rows.join(nameless, "node"))
    gathered = gathered.select("node", "root", "shingles", F.explode("meets").alias("at"))
    gathered = gathered.groupBy("root", "at").agg(F.collect_list(F.struct("node", "shingles")).alias("members"))
    return gathered.select("members").mapInArrow(run, "a long, b long")


def with_set(rows: DataFrame, width: int, text_col: str) -> DataFrame:
    """The rows with the name of their set of shingles as ``_node``."""
    common.bound_batches(rows.sparkSession)
    at, schema = rows.columns.index(text_col), T.StructType([*rows.schema.fields, T.StructField("_node", T.LongType())])

    def run(batches):
        for b in batches:
            names = pa.array([set_name(distinct_shingles(t, width)) for t in b.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, names], schema.names)

    return rows.mapInArrow(run, schema)


def keep_first(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", set_limit: int = SET_LIMIT) -> DataFrame:
    """The documents, all columns unchanged, but for those with a near-duplicate of a smaller id.

    Near-duplicates are connected by pairs of ``similarity`` or more: the Jaccard
    similarity of their distinct shingles of ``width`` words. Only ids to drop are joined
    to the texts. Rows that repeat an id, and rows without one, are told apart by their
    sets of shingles: of rows alike in both one stays; rows without an id come last in
    their group. An empty table gives an empty result.
    """
    prints = common.written(shingle_sets(docs, width, id_col, text_col), "prints")
    distinct = common.written(prints.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *(F.first(x).alias(x) for x in ("size", "fp", "wide"))), "sets")
    roots = graph.components(alike_links(docs, distinct, width, similarity, id_col, text_col, set_limit)).withColumnRenamed("node", "a")
    rooted = common.written(distinct.join(roots, F.col("node") == F.col("a"), "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")), "roots")
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "node")).alias("first"))
    stays = common.written(first.select(F.col("first.doc_id").alias("_id"), F.col("first.node").alias("_stays")), "first-of-groups")
    found = prints.select("doc_id", "node").join(stays, (F.col("node") == F.col("_stays")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    each = common.written(found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("_stays").isNotNull()).alias("stay")), "decisions")
    again = common.written(each.filter("n > 1").select(F.col("doc_id").alias("_again")), "repeated-ids")
    go = common.written(each.filter("n > 1 OR NOT stay").select(F.col("doc_id").alias("_go")), "dropped-ids")
    kept = docs.join(go, F.col(id_col) == F.col("_go"), "left_anti")
    special = []
    if not again.isEmpty():
        special.append(docs.join(again, F.col(id_col) == F.col("_again"), "left_semi"))
    if not (nameless := docs.filter(F.col(id_col).isNull())).isEmpty():
        kept = kept.filter(F.col(id_col).isNotNull())
        special.append(nameless)
    for rows in special:
        rows = with_set(rows, width, text_col)
        rows = rows.join(stays, (F.col("_node") == F.col("_stays")) & F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
        kept = kept.unionByName(rows.dropDuplicates([id_col, "_node"]).drop("_node"))
    return kept
