"""Driver tables as multi-channel integer streams.

``samples(stream, rec, ch, v)`` is the long form that all sizing plans read: one row a
value, ``rec`` counting records of a stream from 0. ``records(stream, rec, c0..)`` is the
wide form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scaled(column: str, factor: int) -> Column:
    return F.floor(F.col(column).cast("double") * float(factor) + 0.5).cast("bigint")


def records(df: DataFrame, stream: Column, order: list[str], channels: list[Column]) -> DataFrame:
    """Wide form: records of each stream numbered in ``order``."""
    named = [c.alias(f"c{k}") for k, c in enumerate(channels)]
    place = F.row_number().over(Window.partitionBy("stream").orderBy(*order)) - 1
    rows = df.select(stream.cast("bigint").alias("stream"), *order, *named)
    return rows.withColumn("rec", place.cast("bigint")).select("stream", "rec", *(f"c{k}" for k in range(len(channels))))


def unpivot(wide: DataFrame, channels: int) -> DataFrame:
    """Wide to long: (stream, rec, ch, v)."""
    cells = F.array(*(F.col(f"c{k}") for k in range(channels)))
    return wide.select("stream", "rec", F.posexplode(cells).alias("ch", "v"))


def pivot(samples: DataFrame, channels: int) -> DataFrame:
    """Long to wide."""
    return samples.groupBy("stream", "rec").agg(*(F.max(F.when(F.col("ch") == k, F.col("v"))).alias(f"c{k}") for k in range(channels)))


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(table(spark, sf_dir, "events"), F.col("user_id"), ["ts", "event_id"], [scaled("value", 100)])


LINEITEM_CHANNELS, ORDER_CHANNELS = 4, 3
LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def lineitem_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams by supplier; ties in the order have equal channels, so they cannot matter."""
    return records(table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), LINEITEM_ORDER, [scaled("l_quantity", 1), scaled("l_extendedprice", 100), scaled("l_discount", 100), scaled("l_tax", 100)])


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long streams: orders dealt to 64 streams by customer; key, price and day as channels."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return records(table(spark, sf_dir, "orders"), F.pmod(F.col("o_custkey"), F.lit(64)), ["o_orderkey"], [F.col("o_orderkey").cast("bigint"), scaled("o_totalprice", 100), day])


# The same streams in DuckDB's SQL, as common table expressions.
EVENTS_SQL = """
ev AS (SELECT CAST(user_id AS BIGINT) AS stream, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS rec, CAST(floor(CAST(value AS DOUBLE) * 100 + 0.5) AS BIGINT) AS c0 FROM events),
samples AS (SELECT stream, rec, 0 AS ch, c0 AS v FROM ev)"""

LINEITEM_SQL = """
li AS (SELECT CAST(l_suppkey AS BIGINT) AS stream, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS BIGINT) AS rec,
       CAST(floor(CAST(l_quantity AS DOUBLE) + 0.5) AS BIGINT) AS c0, CAST(floor(CAST(l_extendedprice AS DOUBLE) * 100 + 0.5) AS BIGINT) AS c1,
       CAST(floor(CAST(l_discount AS DOUBLE) * 100 + 0.5) AS BIGINT) AS c2, CAST(floor(CAST(l_tax AS DOUBLE) * 100 + 0.5) AS BIGINT) AS c3 FROM lineitem),
samples AS (SELECT stream, rec, 0 AS ch, c0 AS v FROM li UNION ALL SELECT stream, rec, 1, c1 FROM li UNION ALL SELECT stream, rec, 2, c2 FROM li UNION ALL SELECT stream, rec, 3, c3 FROM li)"""

ORDERS_SQL = """
od AS (SELECT CAST(o_custkey % 64 AS BIGINT) AS stream, CAST(row_number() OVER (PARTITION BY o_custkey % 64 ORDER BY o_orderkey) - 1 AS BIGINT) AS rec,
       CAST(o_orderkey AS BIGINT) AS c0, CAST(floor(CAST(o_totalprice AS DOUBLE) * 100 + 0.5) AS BIGINT) AS c1, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS c2 FROM orders),
samples AS (SELECT stream, rec, 0 AS ch, c0 AS v FROM od UNION ALL SELECT stream, rec, 1, c1 FROM od UNION ALL SELECT stream, rec, 2, c2 FROM od)"""
