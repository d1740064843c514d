"""Operator 2, secret scans with a token-efficiency test.

Base patterns find assignments, access keys and long hexadecimal runs. Beyond these,
runs of key-like characters are tokenised with a byte-level BPE vocabulary: ordinary
words take few tokens, random strings many, so a low number of characters per token
marks a secret. Known digests (hexadecimal of a digest's length, UUIDs) are set aside first.
Of runs shaped as identifiers (pieces in one case or capitalised, numbers, and signs that
join them) only the letters count, so that joined words and dates are none; numbers with
fewer letters than digits are set aside.

Defined cases: a null text is empty; a text without findings has empty spans; positions
are code points with an exclusive end; spans of equal start are ordered by kind as listed,
then by end; very long texts take time in proportion, very long runs one test; repeated
rows are scanned each for itself; extra columns are left out by ``scan`` and kept by
``redact``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandpack.llm import common

# The base patterns with their least lengths, in the order in which kinds are listed.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

KEYLIKE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\Z", re.I)
#: Words in one case or capitalised, and numbers, joined by the signs that names and paths use.
IDENTIFIER = re.compile(r"(?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]+)(?:[-_/+=]+(?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]+))*[-_/+=]*\Z|[-_/+=]+\Z")
LETTERS, DIGITS = re.compile(r"[A-Za-z]+"), re.compile(r"[0-9]")
CHARS_PER_TOKEN = 2.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def inefficient(run: str, enc, chars_per_token: float) -> bool:
    """Whether the run has too few characters per token for words, names or numbers."""
    pieces = [run]
    if IDENTIFIER.match(run):
        pieces = LETTERS.findall(run)
        if sum(map(len, pieces)) < len(DIGITS.findall(run)):
            return False
    return sum(map(len, pieces)) < chars_per_token * sum(len(enc.encode_ordinary(x)) for x in pieces)


def random_spans(text: str, taken: list[tuple[int, int, str]], enc, chars_per_token: float) -> list[tuple[int, int, str]]:
    """Inefficient runs, but for what ``taken`` covers of them: one pass over both, as both are in order."""
    covers: list[list[int]] = []
    for s, e, _ in sorted(taken):
        if covers and s <= covers[-1][1]:
            covers[-1][1] = max(covers[-1][1], e)
        else:
            covers.append([s, e])
    out, k = [], 0
    for m in KEYLIKE.finditer(text):
        if DIGEST.match(m.group()):
            continue
        s, stop = m.span()
        while s < stop:
            while k < len(covers) and covers[k][1] <= s:
                k += 1
            e, after = (min(stop, covers[k][0]), covers[k][1]) if k < len(covers) else (stop, stop)
            if s < e:
                run = text[s:e]
                if KEYLIKE.match(run) and not DIGEST.match(run) and inefficient(run, enc, chars_per_token):
                    out.append((s, e, "random"))
            s = max(e, after) if e < stop else stop
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def in_order(spans):
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find(text: str | None, enc, chars_per_token: float = CHARS_PER_TOKEN):
    """(base spans, all spans), each in order."""
    text = text or ""
    base = base_spans(text)
    return in_order(base), in_order(base + random_spans(text, base, enc, chars_per_token))


def scan(docs: DataFrame, vocabulary: str | None = None, chars_per_token: float = CHARS_PER_TOKEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans of every row's whole text."""
    common.bound_batches(docs.sparkSession)
    names = ["n_assign", "n_access", "n_hex", "n_random"]
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, T.LongType()) for n in names), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches):
        enc = encoding(vocabulary or default_vocabulary())
        for b in batches:
            counts, digests, spans = ([], [], [], []), [], []
            for text in b.column(1).to_pylist():
                base, every = find(text, enc, chars_per_token)
                for n, kind in zip(counts, KINDS):
                    n.append(sum(x[2] == kind for x in every))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def masked(text: str, spans) -> str:
    """The text with every found span (overlaps merged) replaced by ``[SECRET]``."""
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, vocabulary: str | None = None, chars_per_token: float = CHARS_PER_TOKEN, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with secrets masked in the text and ``length_col`` following it."""
    common.bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        enc = encoding(vocabulary or default_vocabulary())
        for b in batches:
            columns, texts = list(b.columns), b.column(at).to_pylist()
            changed = {i: masked(t, spans) for i, t in enumerate(texts) if t and (spans := find(t, enc, chars_per_token)[1])}
            if changed:
                columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], b.column(at).type)
                if length_at is not None:
                    sizes = b.column(length_at).to_pylist()
                    columns[length_at] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(sizes)], b.column(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
