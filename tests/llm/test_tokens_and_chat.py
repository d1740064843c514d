"""Operators 6, 9 and 10 against the libraries and brute force."""

import re
import zlib
from itertools import product

import numpy as np
import pytest

from conftest import DATA
from strandpack.llm import chat, common, pieces, queries, tokenfile


# -- 6 ---------------------------------------------------------------------------------


def test_packing_of_every_width():
    rng = np.random.default_rng(5)
    for bits in range(1, 33):
        ids = rng.integers(0, 1 << bits, 301, dtype=np.uint64).astype(np.uint32)
        data = tokenfile.pack_ids(ids, bits)
        assert len(data) == -(-301 * bits // 8)
        assert (tokenfile.unpack_ids(data, bits, 0, 301) == ids).all()
        for a, b in ((0, 0), (5, 6), (7, 300), (300, 301)):
            assert (tokenfile.unpack_ids(data, bits, a, b) == ids[a:b]).all()
    assert [tokenfile.bits_for(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_blocks_give_any_document():
    docs = [np.array(x, np.uint32) for x in ([5, 1], [1], [], [9, 9, 9, 2000])]
    b = tokenfile.Block(tokenfile.pack_block(docs, 11))
    assert [b.document(k).tolist() for k in range(4)] == [d.tolist() for d in docs] and b.ids().tolist() == [5, 1, 1, 9, 9, 9, 2000]
    with pytest.raises(ValueError):
        tokenfile.Block(b"XXXX" + bytes(40))


ODD = [None, "", " ", "Don't DO'S 'll", "x<|endoftext|>y <|startoftext|>", "İstanbul ΟΔΟΣ", "é é", "日本 語", "a\x1cb\x85c d", "\U0001f600", "½²٣ 12", "same", "same", "word " * 30000]


def test_token_files_hold_what_the_library_gives(spark):
    library = tokenfile.WordEncoder(tokenfile.default_tokenizer()).library
    rows = [(100 - 3 * k, t, 1) for k, t in enumerate(ODD)] + [(7, "twice", 1), (7, "twice", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = sorted(map(tuple, tokenfile.round_trip(df, block_ids=50).collect()))
    want, at = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)
    assert tokenfile.round_trip(df.limit(0)).count() == 0


def test_token_files_of_a_table(spark, smallest):
    library = tokenfile.WordEncoder(tokenfile.default_tokenizer()).library
    docs = common.table(spark, smallest, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    encoded = library.encode_batch([r.text or "" for r in docs], add_special_tokens=False)
    got = {r.doc_id: r for r in queries.op6_tokens(spark, smallest).collect()}
    at = 0
    for r, e in zip(docs, encoded):
        ids = np.array([*e.ids, 1], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


# -- 10 --------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark, smallest):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    docs = common.table(spark, smallest, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate([*ODD, "  two  spaces ", "\n\n\tx", "▁mark", "a▁ b"])], "doc_id long, text string")
    df = docs.unionByName(extra)
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in pieces.round_trip(df, keep_ids=True).collect():
        text = texts[r.doc_id] or ""
        assert r.ids == p.encode(text), text[:60]
        assert r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.exact == ("▁" not in text)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(df)).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in texts.items())
    assert pieces.round_trip(df.limit(0)).count() == 0


PIECES = {"▁": -3.0, "a": -2.0, "b": -2.5, "c": -4.0, "ab": -3.1, "ba": -4.0, "▁a": -3.5, "abc": -6.0, "bc": -4.2, "▁ab": -5.5, "▁abc": -7.0, "▁▁": -4.0, "cab": -5.0}


def unigram():
    names = ["<unk>", *PIECES]
    return pieces.PieceModel(names, [0.0, *PIECES.values()], pieces.UNIGRAM, special={0})


def slow_best(word):
    """The best score of all cuts of a word."""
    best = -np.inf
    for cuts in product((0, 1), repeat=len(word) - 1):
        parts, start = [], 0
        for k, c in enumerate(cuts, 1):
            if c:
                parts.append(word[start:k])
                start = k
        parts.append(word[start:])
        if all(p in PIECES for p in parts):
            best = max(best, sum(PIECES[p] for p in parts))
    return best


def test_viterbi_by_brute_force():
    m = unigram()
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc "), int(rng.integers(1, 12)), p=[0.35, 0.3, 0.25, 0.1])) for _ in range(300)]
    for text, ids in zip(texts, m.encode(texts)):
        parts = [m.pieces[i] for i in ids.tolist()]
        full = "▁" + text.replace(" ", "▁")
        assert "".join(parts) == full and m.decode(ids) == text
        assert abs(sum(PIECES[p] for p in parts) - slow_best(full)) < 1e-9, text


def test_viterbi_with_characters_beyond_the_pieces():
    m = unigram()
    ids = m.encode(["axb"])[0].tolist()
    assert ids == [m.index["▁a"], 0, m.index["b"]]


# -- 9 ---------------------------------------------------------------------------------

TALK = [
    (1, 0, "user", "How does it work?\nTell me  please."),
    (1, 1, "assistant", "It works like this.\nFirst one thing.\nThen another."),
    (1, 2, "user", "On Monday, the assistant wrote:\n> First one thing.\n> Then   ANOTHER.\n\nWhy that order?"),
    (1, 3, "assistant", "> Why that order?\n>> it works like this.\nBecause."),
    (1, 4, "user", "A new topic"),
    (1, 5, "assistant", "> nobody ever said this\nHm"),
    (2, 0, "user", "> A new topic\nquoting another conversation"),
    (2, 1, "user", None), (2, 1, "user", None), (2, 2, None, ""), (None, 3, "user", "lost"), (3, None, "user", "> lost\nx"),
]


def test_quotes_are_linked_and_leave_the_text(spark):
    df = spark.createDataFrame([(*r, 1) for r in TALK], "conv_id long, turn long, role string, text string, thread int")
    rows = chat.format_chat(df).collect()
    assert [(r.conv_id, r.turn) for r in rows if r.conv_id == 1] == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (1, 5)]
    by = {(r.conv_id, r.turn): r for r in rows}
    assert (by[1, 2].reply_to, by[1, 2].thread, by[1, 2].content) == (1, 1, "Why that order?")
    assert (by[1, 3].reply_to, by[1, 3].thread, by[1, 3].n_quotes, by[1, 3].n_linked, by[1, 3].content) == (2, 1, 2, 2, "Because.")
    assert (by[1, 5].reply_to, by[1, 5].n_quotes, by[1, 5].content) == (None, 1, "Hm")
    assert by[2, 0].reply_to is None and by[2, 1].content == ""
    assert by[1, 0].formatted == "<|im_start|>user\nHow does it work?\nTell me  please.<|im_end|>\n"
    assert len(rows) == len(TALK)
    assert chat.format_chat(df.limit(0)).count() == 0


def test_replies_stand_behind_the_thread_that_they_continue(spark):
    talk = [(1, 0, "a", "alpha"), (1, 1, "b", "beta"), (1, 2, "c", "> alpha\ngamma"), (1, 3, "d", "> gamma\ndelta"), (1, 4, "e", "> beta\nend")]
    rows = chat.format_chat(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).collect()
    assert [r.turn for r in rows] == [0, 2, 3, 1, 4] and [r.thread for r in rows] == [0, 0, 0, 1, 1]


def chat_rows(spark, talk):
    return chat.format_chat(spark.createDataFrame([(1, t, "u", x) for t, x in enumerate(talk)], "conv_id long, turn long, role string, text string")).collect()


def test_one_shared_line_links_nothing(spark):
    by = {r.turn: r.reply_to for r in chat_rows(spark, ["Thanks\nAlpha plan is ready", "Hello", "> Beta plan is somewhat late, not exactly\n> Thanks\nWhat?", "> Thanks\nYes", "Thanks", "> thanks\nAgain"])}
    assert by == {0: None, 1: None, 2: None, 3: 0, 4: None, 5: 4}


def test_a_passage_that_is_wrapped_anew_is_linked(spark):
    text = "One two three four five\nsix seven eight\nnine ten " + "word " * 30000
    by = {r.turn: r.reply_to for r in chat_rows(spark, [text, "four five six", "> Four five six\n> seven\n> eight NINE\nYes", "> four five six\nNo", "> four five seven six eight\nNo"])}
    assert by == {0: None, 1: None, 2: 0, 3: 1, 4: None}


def test_replies_to_replies_stand_behind_their_parent(spark):
    got = chat_rows(spark, ["start of it", "> start of it\nfirst", "> start of it\nsecond", "> first\nto the first", "> second\nto the second", "> to the first\ndeep"])
    assert [r.turn for r in got] == [0, 1, 3, 5, 2, 4] and {r.thread for r in got} == {0}


def test_a_long_chain_and_a_wide_fan_of_replies(spark):
    chain = ["m0"] + [f"> m{k}\nm{k + 1}" for k in range(40)]
    assert [r.turn for r in chat_rows(spark, chain)] == list(range(41))
    rows = [(1, 1000 * t, "u", "start" if not t else "> start\nr" + str(t)) for t in range(30)]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [r.turn for r in got] == [1000 * t for t in range(30)] and all(r.reply_to == 0 for r in got[1:])


def slow_parse(text):
    own, passages = [], []
    lines = re.split(r"\r?\n", text or "")
    level = [len(re.sub("[^>]", "", m.group())) if (m := re.match(r"^\s*(?:>\s?)+", x)) else 0 for x in lines]
    body = [re.sub(r"^\s*(?:>\s?)+", "", x) for x in lines]
    for k, (lv, b) in enumerate(zip(level, body)):
        if lv and k and level[k - 1] == lv:
            passages[-1] = (lv, passages[-1][1] + "\n" + b)
        elif lv:
            passages.append((lv, b))
        elif not (re.match(chat.ANNOUNCE, b) and k + 1 < len(lines) and level[k + 1]):
            own.append(b)
    return "\n".join(own).strip() if any(level) else text or "", passages


def fold(x):
    return re.sub(r"\s+", " ", x.lower()).strip(" ")


def test_links_by_brute_force(spark):
    rng = np.random.default_rng(12)
    said, rows = [], []
    for turn in range(80):
        lines = [f"line {int(rng.integers(60))}" + " of many words in a row" * int(rng.integers(2)) for _ in range(int(rng.integers(1, 4)))]
        if said and rng.random() < 0.6:
            q = said[int(rng.integers(len(said)))].split("\n")
            q = q[: int(rng.integers(1, len(q) + 1))]
            lines = [">" * int(rng.integers(1, 3)) + " " + x.upper() for x in q] + lines
        text = "\n".join(lines)
        said.append(slow_parse(text)[0])
        rows.append((1, turn, "u", text))
    got = {r.turn: r for r in chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    reply = {}
    own = {turn: slow_parse(text)[0] for _, turn, _, text in rows}
    for _, turn, _, text in rows:
        content, passages = slow_parse(text)
        linked = []
        for lv, p in passages:
            n, origins = len(fold(p).split(" ")), []
            for t in range(turn):
                units = [fold(x) for x in [own[t], *own[t].split("\n")]]
                if fold(p) in units if n < 5 else f" {fold(p)} " in f" {fold(own[t])} ":
                    origins.append(t)
            if origins:
                linked.append((lv, max(origins)))
        want = max((o for lv, o in linked if lv == min(x for x, _ in linked)), default=None)
        reply[turn] = want
        assert (got[turn].content, got[turn].n_quotes, got[turn].n_linked, got[turn].reply_to) == (content, len(passages), len(linked), want), text
    children = {}
    for turn, to in reply.items():
        children.setdefault(to, []).append(turn)

    def walk(turn):
        return [turn, *(x for c in children.get(turn, []) for x in walk(c))]

    assert list(got) == [x for r in children[None] for x in walk(r)]
    for turn in reply:
        root = turn
        while reply[root] is not None:
            root = reply[root]
        assert got[turn].thread == root


def test_chat_over_a_table(spark, smallest):
    got = queries.op9_chat(spark, smallest)
    assert got.count() == common.table(spark, smallest, "conversations").count()
