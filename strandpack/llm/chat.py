r"""Operator 9, chat formatting with quotation linking, by DataFrame functions only.

Lines that start with ``>`` marks are quotes; as many marks, so deep the level. Runs of
quoted lines of one level are passages, folded in case and white space, so that new line
breaks do not matter. A passage is linked to the latest earlier message of its conversation
that has all its words one after the other; a passage of fewer than ``ANCHOR`` words must be
a whole message or line of it. Hashes find these: that of a passage's first ``ANCHOR`` words
is joined to those of all windows of as many words, and where they meet, the hash of the
whole passage is compared with that of the words there. A message replies to the latest
message that its outermost passages quote. Quotes, and the lines that announce them, leave
the text. Messages of a thread stand in reply order: each behind the message that it
replies to and that message's earlier replies with all that follows from them.

Only conversations that quote are indexed. What is latest, and what is next, is found in
blocks of ``BLOCK`` turns and then among blocks, so no key's rows meet in one task; the
threads and their order are followed by doubling pointers; and the result is a range sort,
so that one huge conversation is dealt over many tasks. It has one row a message, in order,
with its formatted turn.

Defined cases: repeated messages stay, and share their replies, as all messages of one
turn do, ordered by role, then text; null texts are empty; null conversations or turns link
to nothing; quotes without an original stay unlinked; very long texts are indexed whole;
extra columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandpack.llm import common

MARKS = r"^\s*(?:>\s?)+"
#: Lines that announce a quote, in the languages of the corpus.
ANNOUNCE = r"^\s*(?:On|Am|Le|El)\b.*\b(?:wrote|schrieb|écrit|escribió)\b.*:\s*$"
#: Words whose hash finds a passage; turns that one window step looks at.
ANCHOR, BLOCK = 5, 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def fold(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, content (own text) and passages (level, text, lines)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = messages.select("conv_id", "turn", "role", text.alias("text"))
    quoting = F.col("text").rlike(r"(?m)^\s*>")
    lines = F.transform(F.split("text", "\r?\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("line")))
    rows = base.withColumn("lines", F.when(quoting, lines))
    cuts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (F.get("lines", i)["level"] != F.get("lines", i - 1)["level"]))
    rows = rows.withColumn("cuts", F.when(quoting, F.concat(cuts, F.array(F.size("lines")))))
    runs = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda k: F.slice("lines", F.get("cuts", k) + 1, F.get("cuts", k + 1) - F.get("cuts", k)))
    passages = F.transform(F.filter(runs, lambda r: F.get(r, F.lit(0))["level"] > 0), lambda r: F.struct(F.get(r, F.lit(0))["level"].alias("level"), F.array_join(F.transform(r, lambda x: x["line"]), "\n").alias("text")))
    rows = rows.withColumn("passages", F.when(quoting, passages))
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~(F.rlike(x["line"], F.lit(ANNOUNCE)) & (F.coalesce(F.get("lines", i + 1)["level"], F.lit(0)) > 0)))
    content = F.when(quoting, F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "role", content.alias("content"), "passages")


def unit(folded: Column) -> Column:
    return F.xxhash64(F.lit("unit"), folded)


def window_hashes(words: Column) -> Column:
    """Hashes of all windows of ``ANCHOR`` words, by place."""
    places = F.when(F.size(words) >= ANCHOR, F.sequence(F.lit(1), F.size(words) - (ANCHOR - 1)))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit("words"), F.array_join(F.slice(words, i, ANCHOR), " ")).alias("anchor")))


def latest_before(points: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv_id, whole, turn, origin): for (conv_id, whole, turn) ``asked`` the latest turn of ``points`` that is earlier."""
    rows = points.select("conv_id", "whole", "turn", F.col("turn").alias("origin")).unionByName(asked.select("conv_id", "whole", "turn", F.lit(None).cast("long").alias("origin"))).distinct()
    rows = common.written(rows.withColumn("block", F.floor(F.col("turn") / F.lit(BLOCK))), "turns")
    blocks = rows.groupBy("conv_id", "whole", "block").agg(F.max("origin").alias("most"))
    before = Window.partitionBy("conv_id", "whole").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "whole", "block", F.max("most").over(before).alias("most"))
    within = Window.partitionBy("conv_id", "whole", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.max("origin").over(within)).filter("origin IS NULL").join(blocks, ["conv_id", "whole", "block"])
    return rows.select("conv_id", "whole", "turn", F.coalesce("near", "most").alias("origin")).filter("origin IS NOT NULL")


def replies(rows: DataFrame) -> DataFrame | None:
    """(conv_id, turn, reply_to, n_linked) of messages with linked quotes; None if nothing is quoted."""
    quoting = rows.filter(F.col("passages").isNotNull() & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", F.posexplode("passages").alias("place", "p"))
    quotes = quoting.select("conv_id", F.col("turn").cast("long").alias("turn"), "place", F.col("p.level").alias("level"), fold(F.col("p.text")).alias("folded")).filter("folded <> ''")
    words = F.split("folded", " ")
    anchor = F.when(F.size(words) >= ANCHOR, F.xxhash64(F.lit("words"), F.array_join(F.slice(words, 1, ANCHOR), " "))).otherwise(unit(F.col("folded")))
    quotes = common.written(quotes.select("conv_id", "turn", "place", "level", F.size(words).alias("n"), unit(F.col("folded")).alias("whole"), anchor.alias("anchor")).distinct(), "quotes")
    if quotes.isEmpty():
        return None
    # only conversations that quote need an index of their texts
    own = rows.filter(F.col("turn").isNotNull()).join(quotes.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", F.col("turn").cast("long").alias("turn"), "content", F.split(fold(F.col("content")), " ").alias("words"))
    wanted = quotes.select("conv_id", "n", "whole", "anchor").distinct()
    units = F.transform(F.concat(F.array("content"), F.split("content", "\n")), lambda x: unit(fold(x)))
    short = own.select("conv_id", "turn", F.explode(F.array_distinct(units)).alias("whole")).join(wanted.filter(F.col("n") < ANCHOR).select("conv_id", "whole"), ["conv_id", "whole"])
    name = F.xxhash64("content")
    found = own.select("conv_id", "turn", name.alias("text"), F.explode(window_hashes(F.col("words"))).alias("w")).select("conv_id", "turn", "text", "w.at", F.col("w.anchor").alias("anchor"))
    found = found.join(wanted.filter(F.col("n") >= ANCHOR), ["conv_id", "anchor"]).groupBy("conv_id", "turn", "text", "n", "whole").agg(F.collect_set("at").alias("places"))
    found = found.join(own.select("conv_id", "turn", name.alias("text"), "words").dropDuplicates(["conv_id", "turn", "text"]), ["conv_id", "turn", "text"])
    long = found.filter(F.exists("places", lambda i: unit(F.array_join(F.slice("words", i, F.col("n")), " ")) == F.col("whole")))
    points = short.select("conv_id", "whole", "turn").unionByName(long.select("conv_id", "whole", "turn"))
    linked = quotes.join(latest_before(points, quotes), ["conv_id", "whole", "turn"])
    passages = linked.groupBy("conv_id", "turn", "place", "level").agg(F.max("origin").alias("origin"))
    per = passages.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_linked"), F.max_by("origin", F.struct(-F.col("level"), F.col("origin"))).alias("reply_to"))
    return common.written(per, "replies")


def jump(now: DataFrame, step, tag: str, moving: str) -> DataFrame:
    """Join ``now`` (conv_id, turn, to, ...) to itself at ``to`` until no row is ``moving``; ``step`` names the new columns, those of the target have a trailing ``_``."""
    while not now.filter(moving).isEmpty():
        ahead = now.select(*(F.col(c).alias(f"{c}_") for c in now.columns))
        now = common.written(now.join(ahead, (F.col("conv_id") == F.col("conv_id_")) & (F.col("to") == F.col("turn_")), "left").select("conv_id", "turn", *step), tag)
    return now


def reply_order(links: DataFrame) -> DataFrame:
    """(conv_id, turn, left): how many messages follow each one in its thread, where a
    message is followed by its replies and what follows from them."""
    links = links.select("conv_id", "turn", F.col("reply_to").alias("parent")).withColumn("block", F.floor(F.col("turn") / F.lit(BLOCK)))
    blocks = links.groupBy("conv_id", "parent", "block").agg(F.min("turn").alias("first"))
    after = F.lead("first").over(Window.partitionBy("conv_id", "parent").orderBy("block"))
    within = F.lead("turn").over(Window.partitionBy("conv_id", "parent", "block").orderBy("turn"))
    children = links.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    sibling = links.withColumn("within", within).join(blocks.select("conv_id", "parent", "block", after.alias("after")), ["conv_id", "parent", "block"])
    sibling = sibling.select("conv_id", "turn", "parent", F.coalesce("within", "after").alias("next"))
    # a last reply goes on where its parent does; the first message of a thread ends it
    roots = links.select("conv_id", F.col("parent").alias("turn")).distinct().join(links.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
    on = sibling.select("conv_id", "turn", F.coalesce("next", "parent").alias("to"), F.col("next").isNotNull().alias("known")).unionByName(roots.select("conv_id", "turn", F.lit(None).cast("long").alias("to"), F.lit(True).alias("known")))
    on = jump(common.written(on, "next-turns"), [F.when(F.col("known"), F.col("to")).otherwise(F.col("to_")).alias("to"), (F.col("known") | F.col("known_")).alias("known")], "next-turns", "NOT known")
    on = on.join(children, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("child", "to").alias("to"))
    on = common.written(on.withColumn("left", F.col("to").isNotNull().cast("long")), "followers")
    return jump(on, [F.col("to_").alias("to"), (F.col("left") + F.coalesce("left_", F.lit(0))).alias("left")], "followers", "to IS NOT NULL").select("conv_id", "turn", "left")


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread): the first message that each reply leads back to."""
    now = links.select("conv_id", "turn", F.col("reply_to").alias("thread"))
    while True:
        ahead = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("further"))
        step = common.written(now.join(ahead, (F.col("conv_id") == F.col("c")) & (F.col("thread") == F.col("t")), "left").select("conv_id", "turn", F.coalesce("further", "thread").alias("thread"), F.col("further").isNotNull().alias("moved")), "threads")
        if step.filter("moved").isEmpty():
            return step.select("conv_id", "turn", "thread")
        now = step.drop("moved")


def format_chat(messages: DataFrame) -> DataFrame:
    """conv_id, thread, turn, role, reply_to, n_quotes, n_linked, content, formatted; in reply order."""
    rows = parsed(messages)
    links = replies(rows)
    out = rows.select("conv_id", "turn", "role", "content", F.greatest(F.coalesce(F.size("passages"), F.lit(0)), F.lit(0)).cast("long").alias("n_quotes"))
    if links is None:
        out = out.withColumns({c: F.lit(None).cast("long") for c in ("reply_to", "n_linked", "thread", "left")})
    else:
        placed = reply_order(links).join(threads(links), ["conv_id", "turn"], "left").join(links, ["conv_id", "turn"], "left")
        out = out.join(common.written(placed, "placed"), ["conv_id", "turn"], "left")
    role = F.coalesce("role", F.lit("user"))
    formatted = F.concat(F.lit(OPEN), role, F.lit("\n"), F.col("content"), F.lit(CLOSE + "\n"))
    out = out.withColumn("thread", F.coalesce("thread", "turn")).orderBy("conv_id", "thread", F.col("left").desc(), "turn", "role", "content")
    return out.select("conv_id", "thread", "turn", "role", "reply_to", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "content", formatted.alias("formatted"))
