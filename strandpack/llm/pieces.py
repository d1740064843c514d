"""Operator 10, SentencePiece encoding and decoding by a batched numpy Viterbi pass.

Words (a run of word-start marks with what follows it) do not depend on each other, and
neither do the parts of a word on either side of a boundary that no piece spans. The
distinct parts of a batch advance together, end position by end position, those of equal
length for the same number of steps. Prefix hashes give the hash of every substring, which
probes the sorted keys of the pieces; the hits for an end position compete, and the winner
and its start are stored as backpointers.

* Unigram models: the best total score wins.
* BPE models: their merge order is not the order of best total scores. What holds instead
  is that a sequence of pieces is the model's if every two neighbours are, so each prefix
  has just one last piece that goes with the last piece before it. The probe of a pair
  takes the place of the score: it undoes the merges of both pieces at their boundary,
  latest first, and asks whether the model would have merged across it in that state.

A worker keeps words of earlier batches as flat arrays of bounded size.
Parts of over ``LONG`` characters go through the same recurrence one by one, in time
linear in their length. Decoding joins the pieces' bytes and takes the word-start marks
back to spaces.

Defined cases: null and empty texts have no ids and decode to the empty text; characters
that no piece covers become byte pieces where the model has them, else the unknown id;
the mark U+2581 in a text is a space to the model, and decodes as one; pieces of equal
score merge leftmost first, unigram cuts of equal score prefer the longer last piece;
very long texts and words take time in proportion; repeated rows are encoded alike;
extra columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandpack.llm import common
from strandpack.llm.tokenfile import KEPT_BYTES, Known, kept, put_together

MARK = "▁"
UNIGRAM, BPE = 1, 2
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Characters of a part from which on it is encoded by itself.
LONG = 64
#: Characters of parts that advance together.
SLICE = 1 << 17
#: Pairs of pieces whose probe is remembered while long parts are encoded.
PAIRS = 1 << 16
NEVER = np.int64(1) << 40  # a rank beyond all others


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def message(data: bytes):
    """The (number, value) fields of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if tag & 7 == 2 else ({5: 4, 1: 8}[tag & 7], i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


def mix(keys: np.ndarray) -> np.ndarray:
    """Keys whose leading bits depend on all bits."""
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return keys ^ (keys >> np.uint64(29)) ^ (keys << np.uint64(35))


class Keys:
    """Sorted 64-bit keys with values; their leading bits index them."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = mix(keys.astype(np.uint64))
        order = np.argsort(keys, kind="stable")
        self.values = values[order]
        bits = max(1, (2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys[order] >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.keys = np.append(keys[order], np.uint64(0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for others."""
        keys = mix(keys)
        bucket = (keys >> self.shift).astype(np.int64)
        at, stop = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(keys), -1, np.int64)
        where = np.flatnonzero(at < stop)
        while len(where):
            place = at[where]
            hit = self.keys[place] == keys[where]
            out[where[hit]] = self.values[place[hit]]
            at[where] += 1
            where = where[~hit & (place + 1 < stop[where])]
        return out


def content(array: pa.Array) -> memoryview:
    """The bytes of a large string or binary array, end to end."""
    ends = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    return memoryview(array.buffers()[2] or b"")[ends[0] : ends[-1]]


class PieceModel:
    """A model's pieces, and its encoder and decoder.

    Symbols are piece ids, then characters that only longer pieces have, then one for
    all other characters.
    """

    def __init__(self, pieces: list[str], scores, kind: int, dummy_prefix: bool = True, byte_ids: dict[int, int] | None = None, special: set[int] = frozenset(), unknown: int = 0):
        self.pieces, self.kind, self.dummy_prefix, self.unknown = pieces, kind, dummy_prefix, unknown
        self.byte_ids = {v: i for i, v in (byte_ids or {}).items()}  # byte -> id
        normal = [i for i in range(len(pieces)) if i not in special and i not in (byte_ids or {})]
        self.index = {pieces[i]: i for i in normal}
        self.scores = np.asarray(scores, np.float64)
        self.whole = any(MARK in p.lstrip(MARK) for p in self.index)
        self.longest = max(map(len, self.index), default=1)
        self.bytes = pa.array([bytes([byte_ids[i]]) if byte_ids and i in byte_ids else b"" if i in special else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)], pa.large_binary())
        inner = sorted({c for p in self.index if len(p) > 1 for c in p} - self.index.keys())
        self.singles = {c: i for c, i in self.index.items() if len(c) == 1} | {c: len(pieces) + k for k, c in enumerate(inner)}
        self.other = len(pieces) + len(inner)
        self.symbol_of = np.full(0x110000, self.other, np.int32)
        for c, i in self.singles.items():
            self.symbol_of[ord(c)] = i
        self.spanned = Keys(*self._unique(np.array([ord(a) << 21 | ord(b) for p in self.index for a, b in zip(p, p[1:])], np.uint64)))
        self.powers = np.cumprod(np.full(self.longest + 2, BASE)) * pow(int(BASE), -1, 1 << 64)
        names = [p for p in self.index if len(p) > 1]
        if kind == BPE:
            self._merges(names)
            names = [p for p in names if self.left[self.index[p]] >= 0]
        self.by_hash = Keys(np.array([self._hash(n) for n in names], np.uint64), np.array([self.index[n] for n in names], np.int64))
        self.multi = {n: self.index[n] for n in names}
        self.unknown_score = float(self.scores.min(initial=0.0)) - 10.0
        self.known = Known(self.encode_words, KEPT_BYTES)

    @staticmethod
    def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(keys)
        return keys, np.zeros(len(keys), np.int64)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        with open(path, "rb") as f:
            fields = list(message(f.read()))
        trainer, normalizer = (dict(message(next((v for n, v in fields if n == k), b""))) for k in (2, 3))
        if normalizer.get(2) or normalizer.get(4, 1):
            raise ValueError("only models without text normalisation are supported")
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(p.piece_size())
        special = {i for i in n if p.is_control(i) or p.is_unknown(i) or p.is_unused(i)}
        names = [p.id_to_piece(i) for i in n]
        return cls(names, [p.get_score(i) for i in n], trainer.get(3, UNIGRAM), bool(normalizer.get(3, 1)), {i: int(names[i][1:-1], 16) for i in n if p.is_byte(i)}, special, p.unk_id())

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) % (1 << 64)
        return h

    # -- merges of a BPE model ------------------------------------------------------

    def _merges(self, names: list[str]) -> None:
        """Tables of the pairs that merge, and of each piece's last merge (-1: none makes it)."""
        symbol = lambda s: self.index.get(s, self.singles.get(s))
        made = {(a, b): i for p in names for i in (self.index[p],) for cut in range(1, len(p)) if (a := symbol(p[:cut])) is not None and (b := symbol(p[cut:])) is not None}
        self.pairs = made
        self.by_pair = Keys(np.array([a << 32 | b for a, b in made], np.uint64), np.array([*made.values()], np.int64))
        n = self.other + 1
        self.rank = np.full(n, -1, np.int64)
        ids = np.array([self.index[p] for p in names], np.int64)
        self.rank[ids] = np.unique(-self.scores[ids], return_inverse=True)[1]
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.uneven = np.zeros(n, bool)
        for size, group in itertools.groupby(sorted(names, key=len), key=len):
            group = list(group)
            own = np.array([self.index[p] for p in group])
            block = self.symbol_of[np.array([[*map(ord, p)] for p in group])].astype(np.int64)
            rows, before, uneven = np.arange(len(group)), np.full(len(group), -1, np.int64), np.zeros(len(group), bool)
            for n in range(size, 1, -1):
                rank, result = self._ranks(block[:, :-1].reshape(-1), block[:, 1:].reshape(-1))
                rank, result = rank.reshape(-1, n - 1), result.reshape(-1, n - 1)
                where, line = rank.argmin(1), np.arange(len(rows))
                best = rank[line, where]
                go = best < NEVER
                uneven[rows] |= go & (best < before[rows])
                before[rows] = np.maximum(before[rows], np.where(go, best, -1))
                rows, block, where, result = rows[go], block[go], where[go], result[go]
                line = np.arange(len(rows))
                if n == 2:
                    sound = result[:, 0] == own[rows]
                    self.left[own[rows[sound]]], self.right[own[rows[sound]]] = block[sound, 0], block[sound, 1]
                    break
                columns = np.arange(n - 1)[None, :]
                merged = block[line[:, None], columns + (columns > where[:, None])]
                merged[line, where] = result[line, where]
                block = merged
            self.uneven[own] = uneven
        if (self.uneven & (self.left >= 0)).any():
            raise ValueError("a piece merges in an order other than that of the scores")
        self.memory: dict[int, bool] = {}

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the piece that each pair merges to (``NEVER``: none), and the piece."""
        made = self.by_pair.find(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
        return np.where(made >= 0, self.rank[made], NEVER), made

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the model cuts the text of each two pieces into just these.

        In every state of the boundary its two symbols must not merge before the next
        merge of either; of equal ranks the left one comes first.
        """
        out = np.ones(len(a), bool)
        which, until = np.arange(len(a)), np.full(len(a), NEVER)
        while len(which):
            across = self._ranks(a, b)[0] < until
            out[which[across]] = False
            later = self.rank[a] > self.rank[b]  # else b was made later (equal ranks: the right one)
            until = np.where(later, self.rank[a], self.rank[b] + 1)
            more = ~across & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            a, b = np.where(later, self.right[a], a)[more], np.where(later, b, self.left[b])[more]
            which, until = which[more], until[more]
        return out

    def _goes_with(self, a: int, b: int) -> bool:
        got = self.memory.get(key := a << 32 | b)
        if got is None:
            if len(self.memory) >= PAIRS:
                self.memory.clear()
            self.memory[key] = got = bool(self.compatible(np.array([a]), np.array([b]))[0])
        return got

    # -- parts ----------------------------------------------------------------------

    def _advance(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, used): at each character of the parts the piece that ends there, and whether it is one of the cut's.

        Parts must come by descending size, end to end.
        """
        base = starts + np.arange(len(starts))  # a part has a place before its first character
        active = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0)) + 1), side="right")
        symbols = self.symbol_of[points].astype(np.int64)
        places = len(points) + len(starts)
        prefix, last, back = np.zeros(places, np.uint64), np.zeros(places, np.int64), np.zeros(places, np.int32)
        best = np.full(places, -np.inf) if self.kind != BPE else None
        if best is not None:
            best[base] = 0.0
        for end in range(1, len(active)):
            rows = np.arange(active[end])
            at = base[: len(rows)] + end
            prefix[at] = prefix[at - 1] * BASE + points[starts[: len(rows)] + end - 1].astype(np.uint64) + np.uint64(1)
            left = rows
            for start in range(max(0, end - self.longest), end - 1):
                piece = self.by_hash.find(prefix[at[left]] - prefix[base[left] + start] * self.powers[end - start])
                hit = np.flatnonzero(piece >= 0)
                if not len(hit):
                    continue
                r, p = left[hit], piece[hit]
                if best is None:
                    if start:
                        sound = self.compatible(last[base[r] + start], p)
                        hit, r, p = hit[sound], r[sound], p[sound]
                    left = np.delete(left, hit)
                else:
                    total = best[base[r] + start] + self.scores[p]
                    sound = total > best[at[r]]
                    r, p = r[sound], p[sound]
                    best[at[r]] = total[sound]
                last[at[r]], back[at[r]] = p, start
                if not len(left):
                    break
            single = symbols[starts[left] + end - 1]
            if best is not None:
                total = best[at[left] - 1] + np.where(single < len(self.pieces), self.scores[np.minimum(single, len(self.pieces) - 1)], self.unknown_score)
                sound = total > best[at[left]]
                left, single = left[sound], single[sound]
                best[at[left]] = total[sound]
            last[at[left]], back[at[left]] = single, end - 1
        used, at, end = np.zeros(places, bool), base, sizes.astype(np.int64)
        while len(at):
            used[at + end] = True
            end = back[at + end].astype(np.int64)
            at, end = at[end > 0], end[end > 0]
        inside = np.ones(places, bool)
        inside[base] = False
        return last[inside], used[inside]

    def _alone(self, text: str) -> tuple[list[int], list[bool]]:
        """As ``_advance`` for one part."""
        n, get = len(text), self.multi.get
        single = self.symbol_of[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].tolist()
        last, back, best = [0] * (n + 1), [0] * (n + 1), [0.0] * (n + 1)
        for end in range(1, n + 1):
            low = max(0, end - self.longest)
            if self.kind == BPE:
                for start in range(low, end - 1):
                    p = get(text[start:end])
                    if p is not None and (not start or self._goes_with(last[start], p)):
                        break
                else:
                    start, p = end - 1, single[end - 1]
                last[end], back[end] = p, start
            else:
                c = single[end - 1]
                found = [(best[s] + self.scores[p], -s, p) for s in range(low, end - 1) if (p := get(text[s:end])) is not None]
                found.append((best[end - 1] + (self.scores[c] if c < len(self.pieces) else self.unknown_score), 1 - end, c))
                best[end], start, last[end] = max(found)
                back[end] = -start
        used, end = [False] * (n + 1), n
        while end:
            used[end], end = True, back[end]
        return last[1:], used[1:]

    def _parts(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct parts (utf-32 points end to end, with offsets): (offsets, flat ids)."""
        sizes = np.diff(ends)
        order = np.argsort(-sizes, kind="stable")
        long = int((sizes > LONG).sum())
        _, points = put_together(ends, points, pa.array(order))
        sizes = sizes[order]
        starts = np.cumsum(sizes) - sizes
        cut = int(sizes[:long].sum())
        symbols, used = np.zeros(len(points), np.int64), np.zeros(len(points), bool)
        for s, n in zip(starts[:long].tolist(), sizes[:long].tolist()):
            symbols[s : s + n], used[s : s + n] = self._alone(points[s : s + n].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"))
        # slices of parts keep the working arrays small
        for rows in np.split(np.arange(long, len(sizes)), np.flatnonzero(np.diff((starts[long:] - cut) // SLICE)) + 1):
            if len(rows):
                s, e = int(starts[rows[0]]), int(starts[rows[-1]] + sizes[rows[-1]])
                symbols[s:e], used[s:e] = self._advance(points[s:e], starts[rows] - s, sizes[rows])
        row = np.repeat(np.arange(len(sizes)), sizes)[used]
        symbols, points = symbols[used], points[used]
        rare = np.flatnonzero(symbols >= len(self.pieces))
        if len(rare):  # characters that are no piece
            spelled = [self._spell(c) for c in points[rare].tolist()]
            times = np.ones(len(symbols), np.int64)
            times[rare] = [len(x) for x in spelled]
            at = np.repeat(np.isin(np.arange(len(symbols)), rare), times)
            symbols, row = np.repeat(symbols, times), np.repeat(row, times)
            symbols[at] = list(itertools.chain.from_iterable(spelled))
        counts = np.bincount(row, minlength=len(sizes))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return put_together(np.concatenate([[0], np.cumsum(counts)]), symbols.astype(np.uint32), pa.array(back))

    def _spell(self, point: int) -> list[int]:
        return [self.byte_ids[b] for b in chr(point).encode("utf-8", "surrogatepass")] if len(self.byte_ids) == 256 else [self.unknown]

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct words, marks included: (offsets, flat ids)."""
        points = np.frombuffer(str(content(words), "utf-8").encode("utf-32-le"), "<u4")
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        # a boundary that no piece spans parts a word
        bounds = np.zeros(len(points) + 1, bool)
        bounds[ends] = True
        if len(points) > 1:
            for s in range(0, len(points) - 1, SLICE):
                wide = points[s : s + SLICE + 1].astype(np.uint64)
                bounds[s + 1 : s + len(wide)] |= self.spanned.find(wide[:-1] << np.uint64(21) | wide[1:]) < 0
        cuts = np.flatnonzero(bounds)
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(4 * cuts.astype(np.int64)), pa.py_buffer(points)])
        parts = raw.dictionary_encode()
        distinct = parts.dictionary
        flat = np.frombuffer(content(distinct), "<u4")
        part_ends = np.concatenate([[0], np.cumsum(pc.binary_length(distinct).to_numpy() // 4)])
        ids_ends, ids = put_together(*self._parts(flat, part_ends), parts.indices)
        return ids_ends[np.searchsorted(cuts, ends)], ids

    # -- texts ----------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        """The words of a text, marks included (whole texts, if pieces cross words)."""
        if not text:
            return []
        text = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        return [text] if self.whole else re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [ids for run in common.runs(texts) for ids in self.encode_run(run)]

    def encode_run(self, texts: list[str | None]) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        simple = self.dummy_prefix and not self.whole
        easy = [simple and t != "" and MARK not in t and "  " not in t and t[0] != " " and t[-1] != " " for t in texts]
        # texts whose words are cut at single spaces only are split by Arrow, the others by the pattern
        spaced = pc.split_pattern(pa.array([t for t, e in zip(texts, easy) if e], pa.large_string()), " ")
        words = spaced.flatten().dictionary_encode()
        named = [self.split(t) for t, e in zip(texts, easy) if not e]
        others = pa.array(itertools.chain.from_iterable(named), pa.large_string()).dictionary_encode()
        known = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), words.dictionary, pa.scalar("", pa.large_string())), others.dictionary])
        ends, flat = self.known.ids(known)
        first, second = (put_together(ends, flat, x) for x in (words.indices, pc.add(others.indices.cast(pa.int64()), len(words.dictionary))))
        cuts = first[0][spaced.offsets.to_numpy()]
        other_cuts = second[0][np.concatenate([[0], np.cumsum([len(w) for w in named])]).astype(np.int64)]
        first = iter([first[1][s:e] for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist())])
        second = iter([second[1][s:e] for s, e in zip(other_cuts[:-1].tolist(), other_cuts[1:].tolist())])
        return [next(first if e else second) for e in easy]

    def decode_all(self, rows: list[np.ndarray]) -> list[str]:
        raw = self.bytes.take(pa.array(np.concatenate([*rows, np.zeros(0, np.uint32)]).astype(np.int64)))
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(raw).to_numpy())]).astype(np.int64)
        data = content(raw)
        cuts = ends[np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)].tolist()
        texts = (str(data[s:e], "utf-8", "replace") for s, e in zip(cuts, cuts[1:]))
        return [t[1:] if self.dummy_prefix and t.startswith(" ") else t for t in texts]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all([ids])[0]


def model(path: str | None) -> PieceModel:
    path = path or default_model()
    return kept(f"pieces:{path}", lambda: PieceModel.load(path))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every row's whole text."""
    common.bound_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), lists(model(path).encode(b.column(1).to_pylist()))], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)))


def decode(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row's ids (null ids: the empty text)."""
    common.bound_batches(rows.sparkSession)
    schema = T.StructType([rows.schema[id_col], T.StructField("text", T.StringType())])

    def run(batches):
        for b in batches:
            texts = model(path).decode_all([x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32) for x in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], schema.names)

    return rows.select(id_col, ids_col).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every row's whole text: doc_id, n_tokens, ids_crc32, exact (and ids)."""
    common.bound_batches(docs.sparkSession)
    more = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("exact", T.BooleanType()), *more])

    def run(batches):
        m = model(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = m.encode(texts)
            same = [x == (t or "") for x, t in zip(m.decode_all(ids), texts)]
            columns = [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*columns, *([lists(ids)] if keep_ids else [])], schema.names)
            del texts, ids, columns
            common.release()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
