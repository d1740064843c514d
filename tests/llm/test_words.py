"""Operators 6 and 10: words against the libraries, greedy merges and bounds."""

import numpy as np
import pyarrow as pa
import pytest

from conftest import DATA
from strandpack.llm import pieces, tokenfile


def texts_of(sf):
    import pyarrow.parquet as pq

    if not (DATA / sf).exists():
        pytest.skip("no test tables")
    return [t or "" for t in pq.read_table(f"{DATA}/{sf}/documents.parquet", columns=["text"]).column(0).to_pylist()]


LONG = ["ab" * 3000, "a" * 5000, "0f" * 4000, "日本語" * 2000, "qZx/+" * 2000, " " * 3000, "x" * 63, "x" * 64, "x" * 65, "the" * 40]


def test_pieces_of_whole_texts_equal_the_library():
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    m = pieces.PieceModel.load(pieces.default_model())
    texts = texts_of("sf0.01") + LONG + ["", " ", "a  b", " a b ", "a\nb\n\nc", "▁a ▁ b", "é\U0001f600ÿ", "a\u0000b"]
    got = m.encode(texts)
    assert [x.tolist() for x in got] == p.encode(texts)
    assert m.decode_all(got) == [t.replace("▁", " ") for t in texts]


def test_a_word_of_a_million_letters():
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    m = pieces.PieceModel.load(pieces.default_model())
    rng = np.random.default_rng(1)
    word = "".join(rng.choice(list("abcdefgh"), 1_000_000))
    assert m.encode([word])[0].tolist() == p.encode(word)


def greedy(word, scores):
    """The best-scored neighbours merge, leftmost first, until none do."""
    parts = list(word)
    while True:
        best = max(((scores[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores), default=None)
        if best is None:
            return parts
        k = -best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


@pytest.mark.parametrize("seed", range(12))
def test_merges_by_brute_force(seed):
    """Random models: some characters are no pieces, some scores are equal."""
    rng = np.random.default_rng(seed)
    symbols, scores = list("abcd"), {}
    while len(scores) < 40:
        a, b = rng.choice(symbols, 2)
        if a + b not in scores and len(a + b) < 9:
            scores[a + b] = -float(len(scores) // (1 + seed % 3))
            symbols.append(a + b)
    own = {"a": -90.0, "b": -90.0, "c": -91.0, "▁": -92.0, **scores}
    try:
        m = pieces.PieceModel(["<unk>", *own], [0.0, *own.values()], pieces.BPE, special={0})
    except ValueError:
        pytest.skip("merges of this model do not follow its scores")
    words = ["".join(rng.choice(list("abcdx"), int(rng.integers(1, 90)), p=[0.4, 0.3, 0.15, 0.1, 0.05])) for _ in range(300)]
    for w, ids in zip(words, m.encode(words)):
        want = greedy("▁" + w, scores)
        assert ids.tolist() == [m.index.get(x, 0) for x in want], w


def test_keys_are_found_and_others_are_not():
    rng = np.random.default_rng(4)
    keys = np.unique(np.concatenate([np.arange(3000), rng.integers(0, 1 << 63, 3000)]).astype(np.uint64))
    k = pieces.Keys(keys[::2], np.arange(len(keys[::2])))
    assert (k.find(keys[::2]) == np.arange(len(keys[::2]))).all() and (k.find(keys[1::2]) == -1).all()
    none = pieces.Keys(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    assert (none.find(keys) == -1).all() and len(k.find(keys[:0])) == 0


def test_known_words_stay_within_their_bytes():
    made = []

    def make(names):
        made.append(len(names))
        sizes = [len(x) for x in names.to_pylist()]
        return np.concatenate([[0], np.cumsum(sizes)]), np.repeat(np.array(sizes, np.uint32), sizes)

    known = tokenfile.Known(make, 2000)
    for start in (0, 10, 0, 500, 0):
        names = pa.array([f"n{k}" for k in range(start, start + 40)], pa.large_string())
        ends, flat = known.ids(names)
        assert (np.diff(ends) == [len(x) for x in names.to_pylist()]).all() and (flat == np.repeat(np.diff(ends), np.diff(ends))).all()
        assert known.names.nbytes + known.ends.nbytes + known.flat.nbytes <= 2000
    assert made[:3] == [40, 10, 0]
    assert len(known.ids(pa.array([], pa.large_string()))[1]) == 0


def test_words_of_a_vocabulary_equal_the_library():
    e = tokenfile.WordEncoder(tokenfile.default_tokenizer())
    chars = [chr(i) for i in range(0x2100) if not tokenfile.UNCOMMON.search(chr(i))]
    texts = texts_of("sf0.01") + LONG + [f"a{c}b {c} {c}t x'{c} '{c}s {c}" for c in chars] + ["'tis (it's) don't!! ''s a.b, x_y-z 12.5% ÀÉ’s"]
    want = [[*x.ids, 1] for x in e.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(texts, 1)] == want
    assert e.encode([], 1) == []
