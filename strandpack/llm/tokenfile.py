"""Operator 6, token-id output in fixed-width bit packing.

A pack is a self-contained block of documents in ascending order: a header, for each
document the number of ids before it, and the ids at the least number of bits that the
vocabulary needs, least significant bit first. An id's place follows from its index, so
any document can be cut out of a block and unpacked by numpy at once. A pack file set is
a Parquet folder of such blocks: written by Spark's own committers, it survives lost
executors and can live in any store that Spark reaches; part and block numbers, document
ids and offsets stand beside the payload, so readers can prune to the blocks they need.

Documents are dealt to ascending id ranges, tokenised and packed where they are sorted,
so that the parts, one after the other, are the whole stream in order.

Tokenising: the vocabulary's words do not depend on each other, so the library's model
turns each distinct part of a batch's words into ids once, and Arrow puts them in the
words' places. A worker keeps parts of earlier batches as flat arrays of at most ``KEPT_BYTES``,
besides the library's model. Texts with characters beyond Latin script and general
punctuation, or with special tokens, go to the library whole, since there case folding or
matching looks across words.

Defined cases: null and empty texts have the end id only; repeated ids follow each other
by text, ties of both are alike in every column; null ids come first; ids of any type
that casts to a long keep their order as longs, others are refused; a very long text is a
block of its own; extra columns are left out, whatever their names; an empty table writes
no block and reads back as an empty result.
"""

from __future__ import annotations

import itertools
import re
import string
import struct
import sys
import types
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandpack.llm import common

MAGIC, VERSION = b"TPK1", 1
HEADER = struct.Struct("<4sHHIQ")  # magic, version, bits, documents, ids
END_ID = 1
#: Outside these, texts are encoded whole.
UNCOMMON = re.compile("[^\x00-\x1b\x20-\u024f\u2010-\u2027\u2030-\u205e\u20ac]|\u0130|<\\|(?:start|end)oftext\\|>")
#: Of the parts that a worker keeps.
KEPT_BYTES = 24 << 20
SEPARATORS = "\x1c\x1d\x1e\x1f"


# -- bits ---------------------------------------------------------------------------


def bits_for(vocabulary: int) -> int:
    """The least number of bits for ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, np.uint32)
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.astype("<u4").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.reshape(-1), bitorder="little").tobytes()


def unpack_ids(payload, bits: int, start: int, stop: int) -> np.ndarray:
    """The ids from index ``start`` to ``stop``, reading only the bytes that hold them."""
    if bits in (16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", stop - start, start * bits // 8).astype(np.uint32)
    first, last = start * bits // 8, -(-stop * bits // 8)
    each = np.unpackbits(np.frombuffer(payload, np.uint8, last - first, first), bitorder="little")
    each = each[start * bits - first * 8 :][: (stop - start) * bits].reshape(-1, bits)
    return np.packbits(np.pad(each, ((0, 0), (0, 32 - bits))), axis=1, bitorder="little").view("<u4").reshape(-1)


def pack_block(documents: list[np.ndarray], bits: int) -> bytes:
    lengths = np.fromiter(map(len, documents), np.int64, len(documents))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    return HEADER.pack(MAGIC, VERSION, bits, len(documents), len(ids)) + offsets.tobytes() + pack_ids(ids, bits)


class Block:
    """Random access to the documents of a block."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.n_docs, self.n_ids = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a block of this format")
        self.offsets = np.frombuffer(data, "<u8", self.n_docs + 1, HEADER.size).astype(np.int64)
        self.payload = memoryview(data)[HEADER.size + 8 * (self.n_docs + 1) :]

    def document(self, k: int) -> np.ndarray:
        return unpack_ids(self.payload, self.bits, int(self.offsets[k]), int(self.offsets[k + 1]))

    def ids(self) -> np.ndarray:
        return unpack_ids(self.payload, self.bits, 0, self.n_ids)


# -- tokens -------------------------------------------------------------------------


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def kept(name: str, make):
    """Something that a Python worker keeps from task to task."""
    home = sys.modules.setdefault("_strandpack_kept", types.ModuleType("_strandpack_kept"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes
    for themselves, the others, in order, for the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    return [hidden.get(b, chr(b)) for b in range(256)]


def plain(text: str) -> bool:
    """Whether the words of the text are independent, and folded alike here and in the library."""
    if text.isascii():
        return "<|" not in text and not any(c in text for c in SEPARATORS)
    return not UNCOMMON.search(text)


def put_together(offsets: np.ndarray, flat: np.ndarray, which: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lists (``offsets`` into ``flat``) at the places ``which``, end to end: (offsets, flat)."""
    taken = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(flat)).take(which)
    return taken.offsets.to_numpy(), taken.flatten().to_numpy()


class Known:
    """Lists of ids by name, in flat arrays of at most about ``most_bytes``: ``make`` gives
    those of new names as (offsets, flat); beyond the bound the table starts anew."""

    def __init__(self, make, most_bytes: int):
        self.make, self.most_bytes = make, most_bytes
        self.clear()

    def clear(self) -> None:
        self.names, self.ends, self.flat = pa.array([], pa.large_string()), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def ids(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct names: (offsets, flat ids)."""
        at = pc.index_in(names, value_set=self.names)
        is_new = pc.is_null(at)
        new, where = names.filter(is_new), pc.fill_null(at, 0).to_numpy().astype(np.int64)
        ends, flat = self.make(new)
        if not len(self.names):
            found = ends, flat
        else:
            where[is_new.to_numpy(zero_copy_only=False)] = len(self.names) + np.arange(len(new))
            ends, flat, new = np.concatenate([self.ends, self.ends[-1] + ends[1:]]), np.concatenate([self.flat, flat]), pa.concat_arrays([self.names, new])
            found = put_together(ends, flat, pa.array(where))
        if new.nbytes + ends.nbytes + flat.nbytes > self.most_bytes:
            self.clear()
        else:
            self.names, self.ends, self.flat = new, ends, flat
        return found


class WordEncoder:
    """Encodes as ``Tokenizer.encode(text, add_special_tokens=False)`` does, word by word.

    Of the library's chain, the folding and the cuts between words are done here (for
    the characters where both agree), and its model turns each distinct part into ids.
    """

    # Fixed value: the vocabulary's own pattern of words.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    LETTERS = "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "L")
    SIGNS = string.punctuation

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.letters = self.library.model, byte_letters()
        self.cut = regex.compile(self.PATTERN).findall
        self.known = Known(self.tokenized, KEPT_BYTES)

    def part(self, part: str) -> list[int]:
        raw = part if part.isascii() and part.isprintable() else "".join(map(self.letters.__getitem__, part.encode()))
        return [t.id for t in self.model.tokenize(raw)]

    def tokenized(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.part(p) for p in parts.to_pylist()]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        return ends, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(ends[-1]))

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct words: (offsets, flat ids)."""
        low = pc.utf8_lower(words)
        # letters with signs behind them, the common case, are two parts; the pattern cuts the others
        stem, rest = pc.utf8_rtrim(low, self.SIGNS), pc.utf8_ltrim(low, self.LETTERS)
        simple = pc.equal(pc.add(pc.binary_length(stem), pc.binary_length(rest)), pc.binary_length(low))
        simple = pc.and_(simple, pc.equal(pc.utf8_rtrim(rest, self.SIGNS), ""))
        others = [self.cut(w) for w in low.filter(pc.invert(simple)).to_pylist()]
        pairs = [stem.filter(simple), rest.filter(simple)]
        n = len(pairs[0])
        parts = pa.concat_arrays([*pairs, pa.array(itertools.chain.from_iterable(others), pa.large_string())]).dictionary_encode()
        places = parts.indices.to_numpy()
        places = np.concatenate([np.stack([places[:n], places[n : 2 * n]], 1).reshape(-1), places[2 * n :]])
        ends = np.concatenate([np.arange(0, 2 * n + 1, 2), 2 * n + np.cumsum(np.fromiter(map(len, others), np.int64, len(others)))])
        part_ends, flat = put_together(*self.known.ids(parts.dictionary), pa.array(places))
        # back to the words' order: the simple ones came first
        order = np.argsort(~simple.to_numpy(zero_copy_only=False), kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return put_together(part_ends[ends], flat, pa.array(back))

    def encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of plain texts: distinct words, of these distinct parts, of these ids; and back."""
        split = pc.utf8_split_whitespace(pa.array([unicodedata.normalize("NFC", t) for t in texts], pa.large_string()))
        words = split.flatten().dictionary_encode()
        ends, flat = put_together(*self.words(words.dictionary), words.indices)
        cuts = ends[split.offsets.to_numpy()]
        return [flat[s:e] for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def encode(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        return [ids for run in common.runs(texts) for ids in self.encode_run(run, end_id)]

    def encode_run(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        easy = [k for k, t in enumerate(texts) if plain(t)]
        out: list[np.ndarray | None] = [None] * len(texts)
        for k, ids in zip(easy, self.encode_plain([texts[k] for k in easy])):
            out[k] = np.append(ids, np.uint32(end_id))
        return [np.array([*self.library.encode(t, add_special_tokens=False).ids, end_id], np.uint32) if ids is None else ids for t, ids in zip(texts, out)]


# -- files --------------------------------------------------------------------------

BLOCKS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("part_start", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("pack", T.BinaryType())])


def blocks(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed blocks of all documents in ascending id order (to be written as they are)."""
    common.bound_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        path = tokenizer or default_tokenizer()
        encoder = kept(f"words:{path}", lambda: WordEncoder(path))
        bits = bits_for(encoder.library.get_vocab_size())
        part, count, written, held, doc_ids, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def full():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([count], pa.int32()), pa.array([written], pa.int64()), pa.array([size], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([pack_block(held, bits)], pa.binary())], BLOCKS.names)

        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist(), end_id)):
                held.append(ids)
                doc_ids.append(k)
                size += len(ids)
                if size >= block_ids:
                    yield full()
                    count, written, held, doc_ids, size = count + 1, written + size, [], [], 0
            common.release()
        if held:
            yield full()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, BLOCKS)


def write(docs: DataFrame, path: str, **options) -> None:
    blocks(docs, **options).write.option("compression", "none").parquet(path)


def read(files: DataFrame) -> DataFrame:
    """Per document of the written blocks, in parallel: doc_id, start, n_tokens, ids_crc32."""
    spark = files.sparkSession
    common.bound_batches(spark)
    # parts are ascending id ranges; one row each, so this window stays as small as the number of tasks that wrote
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    ahead = F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = common.written(parts.select("part", F.coalesce(ahead, F.lit(0)).alias("ahead")), "token-parts")

    def run(batches):
        for b in batches:
            for start, doc_ids, data in zip(*(b.column(i).to_pylist() for i in (0, 1, 2))):
                block = Block(data)
                ids, off = block.ids().astype("<u4"), block.offsets
                crcs = [zlib.crc32(ids[s:e]) for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(off[:-1] + start), pa.array(np.diff(off)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = files.join(ahead, "part").select((F.col("part_start") + F.col("ahead")).alias("start"), "doc_ids", "pack")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write all documents as packed blocks to the shared folder and read them back."""
    import uuid

    spark = docs.sparkSession
    path = f"{common.shared_dir(spark)}/strandpack/tokens-{uuid.uuid4().hex}"
    write(docs, path, **options)
    return read(spark.read.schema(BLOCKS).parquet(path))
