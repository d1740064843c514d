"""Relational operators on message streams: schemas, rates, routing, batches, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandpack.functions import ints, mavlink


def schema_table(spark: SparkSession) -> DataFrame:
    """A row a message; a fixed, small table."""
    rows = [(m.msgid, m.name, m.payload, m.channels, m.tier, m.live_every, m.group, m.crc_extra, m.valid) for m in mavlink.MESSAGES.values()]
    return spark.createDataFrame(rows, "msgid int, name string, payload int, channels int, tier string, live_every int, grp string, crc_extra int, valid boolean")


def rate_table(spark: SparkSession) -> DataFrame:
    rows = [(p, g, float(hz)) for p, rates in mavlink.PROFILES.items() for g, hz in zip(mavlink.GROUPS, rates)]
    return spark.createDataFrame(rows, "profile string, grp string, hz double")


def message_rates(spark: SparkSession) -> DataFrame:
    return schema_table(spark).join(F.broadcast(rate_table(spark)), "grp")


def from_events(events: DataFrame, spark: SparkSession) -> DataFrame:
    """Events as messages: a fixed message id for each event type, user ids as senders.

    (msgid, sysid, t, event_id, value); the map is a literal of a few types."""
    ids = sorted(mavlink.MESSAGES)
    kind = F.pmod(F.ascii("event_type") * 31 + F.length("event_type"), F.lit(len(ids))).cast("int")
    return events.select(F.element_at(F.array(*map(F.lit, ids)), kind + 1).alias("msgid"), F.col("user_id").alias("sysid"), F.col("ts").alias("t"), "event_id", "value")


def routed(messages: DataFrame, schema: DataFrame) -> DataFrame:
    """Adds name, tier and live_every; unknown messages pass through live."""
    known = schema.select("msgid", "name", "tier", "live_every")
    return messages.join(F.broadcast(known), "msgid", "left").withColumn("tier", F.coalesce("tier", F.lit(mavlink.LIVE)))


def ordinals(messages: DataFrame) -> DataFrame:
    """Adds ordinal, counting a sender's messages of one kind from 0.

    A counter per sender and message: one counter over all senders could not be dealt out.
    """
    w = Window.partitionBy("sysid", "msgid").orderBy("t", "event_id")
    return messages.withColumn("ordinal", (F.row_number().over(w) - 1).cast("bigint"))


def decimated(numbered: DataFrame) -> DataFrame:
    """The live copies of bulk messages: every N-th, the first included."""
    return numbered.filter((F.col("tier") == mavlink.BULK) & (F.col("live_every") > 0)).filter(F.col("ordinal") % F.nullif(F.col("live_every"), F.lit(0)) == 0)


def batches(numbered: DataFrame, rates: DataFrame, delay: float) -> DataFrame:
    """(sysid, msgid, batch, n, target): bulk messages gathered to the count that a delay allows."""
    aims = rates.select("msgid", ints.target_batch("hz", F.lit(delay)).alias("target"))
    rows = numbered.filter(F.col("tier") == mavlink.BULK).join(F.broadcast(aims), "msgid")
    return rows.groupBy("sysid", "msgid", F.floor(F.col("ordinal") / F.col("target")).cast("bigint").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.max("target").alias("target"))


def mix(messages: DataFrame, schema: DataFrame, seconds: float) -> DataFrame:
    """(msgid, name, n, bytes, share) of a stream in untrimmed frames, and its rate."""
    size = F.col("payload") + mavlink.OVERHEAD
    per = messages.join(F.broadcast(schema), "msgid").groupBy("msgid", "name").agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("bigint").alias("bytes"))
    total = per.agg(F.sum("bytes").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("msgid", "name", "n", "bytes", (F.col("bytes") / F.lit(seconds)).alias("bytes_per_s"), (F.col("bytes") / F.col("total")).alias("share"))


def verified(sent: DataFrame, received: DataFrame) -> DataFrame:
    """(msgid, n_sent, n_same, n_other, n_lost) by position in each sender's stream of a message."""
    a = ordinals(sent).select("sysid", "msgid", "ordinal", F.col("value").alias("a"), F.lit(1).alias("is_sent"))
    b = ordinals(received).select("sysid", "msgid", "ordinal", F.col("value").alias("b"), F.lit(1).alias("is_got"))
    both = a.join(b, ["sysid", "msgid", "ordinal"], "full_outer")
    here, there = F.col("is_sent").isNotNull(), F.col("is_got").isNotNull()
    return both.groupBy("msgid").agg(F.count("is_sent").alias("n_sent"), F.count(F.when(here & there & F.col("a").eqNullSafe(F.col("b")), 1)).alias("n_same"), F.count(F.when(here & there & ~F.col("a").eqNullSafe(F.col("b")), 1)).alias("n_other"), F.count(F.when(here & ~there, 1)).alias("n_lost"))
