"""The registered queries on streams and messages, each with its DuckDB SQL."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandpack.functions import ints, mavlink
from strandpack.operators import frames, loss, messages, report, rivals, sizing, units
from strandpack.plans import samples, sql
from strandpack.sources import fixtures, flightlog, generators
from strandpack.streaming import accumulator, proxy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return put


def events(spark, sf_dir) -> DataFrame:
    return samples.unpivot(samples.event_records(spark, sf_dir), 1)


def lineitem(spark, sf_dir) -> DataFrame:
    return samples.unpivot(samples.lineitem_records(spark, sf_dir), samples.LINEITEM_CHANNELS)


def orders(spark, sf_dir) -> DataFrame:
    return samples.unpivot(samples.order_records(spark, sf_dir), samples.ORDER_CHANNELS)


def lineitem_frames(spark, sf_dir) -> DataFrame:
    """Sizes of frames of 50 records."""
    return units.frame_size(units.gather(samples.lineitem_records(spark, sf_dir), samples.LINEITEM_CHANNELS, 50), samples.LINEITEM_CHANNELS)


def whole(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("rec", "i")


# -- channels and integer algebra ------------------------------------------------------


@query(sql.query(sql.LINEITEM, select="SELECT ch, CAST(count(*) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS least, max(v) AS most FROM samples GROUP BY ch"))
def q_unpivot_channels(spark, sf_dir):
    return lineitem(spark, sf_dir).groupBy("ch").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"))


@query(sql.query(sql.LINEITEM, select="SELECT stream, rec, c0, c1, c2, c3 FROM li"))
def q_pivot_back(spark, sf_dir):
    return samples.pivot(lineitem(spark, sf_dir), samples.LINEITEM_CHANNELS)


@query(sql.query(sql.EVENTS, select=f"SELECT stream, rec, {sql.wrap('v - ' + sql.lag('v', 'stream', 'rec'))} AS d FROM samples"))
def q_wrap_delta(spark, sf_dir):
    return sizing.deltas(whole(events(spark, sf_dir)), ["stream"]).select("stream", F.col("i").alias("rec"), "d")


@query(sql.query(sql.EVENTS, sql.WHOLE, sql.order("whole", "stream"), select="SELECT stream, i AS rec, dd FROM choice_r WHERE dd IS NOT NULL"))
def q_second_delta(spark, sf_dir):
    rows = sizing.deltas(whole(events(spark, sf_dir)), ["stream"])
    w = Window.partitionBy("stream").orderBy("i")
    return rows.withColumn("dd", ints.sub32("d", F.lag("d").over(w))).filter("dd IS NOT NULL").select("stream", F.col("i").alias("rec"), "dd")


@query(sql.query(sql.ORDERS, select="SELECT stream, ch, rec, v FROM samples"))
def q_prefix_decode(spark, sf_dir):
    """Differences, then their prefix sums: wrapped once, as sums modulo 2**32 are additive."""
    w = Window.partitionBy("stream", "ch").orderBy("i")
    d = whole(orders(spark, sf_dir)).withColumn("d", ints.sub32("v", F.lag("v", 1, 0).over(w)))
    total = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return d.select("stream", "ch", F.col("i").alias("rec"), ints.wrap32(total).alias("v"))


@query(sql.query(sql.EVENTS, "whole AS (SELECT stream, ch, rec AS i, v FROM samples)", sql.zigzagged("whole", "stream"), select="SELECT stream, i AS rec, u, CAST(bw AS INTEGER) AS bw, CAST(32 - bw AS INTEGER) AS clz, CASE WHEN u % 2 = 1 THEN -((u + 1) // 2) ELSE u // 2 END AS back FROM zz"))
def q_zigzag_width(spark, sf_dir):
    rows = rivals.zigzagged(whole(events(spark, sf_dir)), ["stream"])
    return rows.select("stream", F.col("i").alias("rec"), "u", "bw", ints.leading_zeros("u").alias("clz"), ints.unzigzag("u").alias("back"))


# -- native sizes ----------------------------------------------------------------------


@query(sql.query(sql.EVENTS, sql.WHOLE, sql.core("whole", "stream"), select="SELECT stream, n, bits, CAST(4 + (bits + 7) // 8 AS BIGINT) AS bytes, CAST(n * 4 AS DOUBLE) / (4 + (bits + 7) // 8) AS ratio FROM core_g"))
def q_block_size(spark, sf_dir):
    """Per-user encoded size and ratio of event values under block-adaptive packing."""
    rows = sizing.runs(sizing.blocks(whole(events(spark, sf_dir)), ["stream"]), ["stream"])
    per = sizing.decisions(rows, ["stream"], F.lit(True)).withColumn("bytes", F.lit(4) + ints.ceil_div("bits", 8))
    return per.select("stream", "n", "bits", F.col("bytes").cast("bigint").alias("bytes"), ints.ratio(F.col("n") * 4, "bytes").alias("ratio"))


@query(sql.query(sql.LINEITEM, sql.WHOLE, sql.order("whole", "stream, ch"), select="SELECT stream, ch, m, sum1, sum2, second FROM choice"))
def q_order_choice(spark, sf_dir):
    return sizing.order_choice(whole(lineitem(spark, sf_dir)), ["stream", "ch"])


@query(sql.query(sql.EVENTS, "whole AS (SELECT stream, rec AS i, CASE WHEN rec < 20 THEN v ELSE 7 END AS v FROM samples)", sql.core("whole", "stream"),
                 select="SELECT stream, CAST(count(CASE WHEN zero THEN 1 END) AS BIGINT) AS zero_blocks, CAST(count(CASE WHEN escaped THEN 1 END) AS BIGINT) AS escaped_blocks, CAST(count(CASE WHEN escaped AND pos % 65535 = 0 THEN 1 END) AS BIGINT) AS escapes, CAST(sum(bits) AS BIGINT) AS bits FROM core_c GROUP BY stream"))
def q_zero_runs(spark, sf_dir):
    """Runs of constant blocks: event values held constant after the 20th record."""
    rows = whole(events(spark, sf_dir)).withColumn("v", F.when(F.col("i") < 20, F.col("v")).otherwise(F.lit(7)))
    blks = sizing.runs(sizing.blocks(rows, ["stream"]), ["stream"])
    return blks.groupBy("stream").agg(F.count(F.when(F.col("zero"), 1)).alias("zero_blocks"), F.count(F.when(F.col("escaped"), 1)).alias("escaped_blocks"), F.count(F.when(F.col("escaped") & (F.col("pos") % sizing.RUN_MOST == 0), 1)).alias("escapes"), F.sum("bits").cast("bigint").alias("bits"))


@query(sql.query(sql.LINEITEM, sql.WHOLE, sql.core("whole", "stream, ch"), select="SELECT stream, ch, CAST(n AS BIGINT) AS n, gate_ok FROM core_v"))
def q_gate(spark, sf_dir):
    keys = ["stream", "ch"]
    return sizing.decisions(sizing.runs(sizing.blocks(whole(lineitem(spark, sf_dir)), keys), keys), keys, F.lit(True)).select(*keys, "n", "gate_ok")


@query(sql.query(sql.LINEITEM, sql.WHOLE, sql.core("whole", "stream, ch", "FALSE"), select="SELECT stream, ch, CAST(n AS BIGINT) AS n, aborted FROM core_v"))
def q_early_abort(spark, sf_dir):
    keys = ["stream", "ch"]
    return sizing.decisions(sizing.runs(sizing.blocks(whole(lineitem(spark, sf_dir)), keys), keys), keys, F.lit(False)).select(*keys, "n", "aborted")


@query(sql.query(sql.LINEITEM, sql.WHOLE, sql.core("whole", "stream, ch"), select="SELECT stream, ch, n, bytes FROM core"))
def q_core_size(spark, sf_dir):
    return sizing.core_size(whole(lineitem(spark, sf_dir)), ["stream", "ch"])


@query(sql.query(sql.LINEITEM, sql.WHOLE, sql.payloads("whole", "stream", 4), select="SELECT stream, CAST(ch AS INTEGER) AS ch, second, raw, bytes, passed FROM payload"))
def q_channel_payloads(spark, sf_dir):
    return sizing.channel_payloads(whole(lineitem(spark, sf_dir)), ["stream"], 4)


@query(sql.query(sql.LINEITEM, sql.WHOLE, sql.units("whole", "stream", 4), select="SELECT stream, bytes FROM unit_size"))
def q_channel_size(spark, sf_dir):
    return sizing.channel_size(whole(lineitem(spark, sf_dir)), ["stream"], 4)


@query(sql.query(sql.LINEITEM, sql.frames(4, 50), select="SELECT stream, frame, CAST(frame % 65536 AS BIGINT) AS seq, CAST(n_rec AS BIGINT) AS n_rec, bytes FROM frame"))
def q_frame_size(spark, sf_dir):
    return lineitem_frames(spark, sf_dir).withColumn("seq", F.pmod("frame", F.lit(65536)).cast("bigint"))


# -- rivals ----------------------------------------------------------------------------

for _codec in ("vbyte", "svb", "bp128", "optpfd"):

    def _family(spark, sf_dir, codec=_codec):
        return rivals.family_sizes(whole(orders(spark, sf_dir)), ["stream"]).select("stream", "ch", "n", F.col(codec).alias("bytes"))

    _family.__name__ = f"q_{_codec}_size"
    query(sql.query(sql.ORDERS, sql.WHOLE, sql.family("whole", "stream"), select=f"SELECT stream, ch, n, {_codec} AS bytes FROM family"))(_family)


@query(sql.query(sql.ORDERS, sql.WHOLE, sql.sprintz("whole", "stream", 3), select="SELECT stream, n_rec, sprintz AS bytes FROM sprintz"))
def q_sprintz_size(spark, sf_dir):
    return rivals.sprintz_size(whole(orders(spark, sf_dir)), ["stream"], 3).select("stream", "n_rec", F.col("sprintz").alias("bytes"))


@query(sql.query(sql.ORDERS, sql.WHOLE, sql.zigzagged("whole", "stream"), select="SELECT ch, CAST(bw AS INTEGER) AS bw, CAST(count(*) AS BIGINT) AS n FROM zz GROUP BY ch, 2"))
def q_width_histogram(spark, sf_dir):
    return rivals.width_histogram(whole(orders(spark, sf_dir)), ["stream"])


@query(sql.query(sql.ORDERS, sql.WHOLE, sql.family("whole", "stream"), "offer AS (" + " UNION ALL ".join(f"SELECT stream, ch, tile, {b} AS b, {16 + 128 * b} + e{b} * {40 - b} AS bits FROM tile WHERE n = 128 AND e{b} <= 127" for b in range(33)) + ")",
                 select="SELECT stream, ch, CAST(tile AS BIGINT) AS tile, CAST(b AS INTEGER) AS b, CAST(bits AS BIGINT) AS bits FROM offer QUALIFY row_number() OVER (PARTITION BY stream, ch, tile ORDER BY bits, b) = 1"))
def q_best_base_width(spark, sf_dir):
    return rivals.best_width(whole(orders(spark, sf_dir)), ["stream"])


# -- comparisons -----------------------------------------------------------------------

SWEEP = (5, 10, 25, 50, 100)
SWEPT = "swept AS (SELECT p.per_frame, stream, rec // p.per_frame AS frame, rec % p.per_frame AS i, ch, v FROM samples CROSS JOIN (VALUES " + ", ".join(f"({k})" for k in SWEEP) + ") p(per_frame))"
_SWEEP_UNIT = "per_frame, stream, frame"


@query(sql.query(sql.ORDERS, SWEPT, sql.units("swept", _SWEEP_UNIT, 3),
                 select="SELECT CAST(per_frame AS INTEGER) AS per_frame, CAST(count(*) AS BIGINT) AS frames, CAST(sum(bytes + 10) AS BIGINT) AS bytes, CAST(max(bytes + 10) AS BIGINT) AS largest, (SELECT CAST(count(*) * 4 AS DOUBLE) FROM samples) / sum(bytes + 10) AS ratio FROM unit_size GROUP BY per_frame"))
def q_frame_sweep(spark, sf_dir):
    """Every frame size from one pass over units that hold whole frames of each."""
    rows = units.gather(samples.order_records(spark, sf_dir), samples.ORDER_CHANNELS, math.lcm(*SWEEP))
    return units.swept(rows, samples.ORDER_CHANNELS, SWEEP).select("per_frame", "frames", "bytes", "largest", ints.ratio("raw", "bytes").alias("ratio"))


EQUAL = ["vbyte", "svb", "bp128", "optpfd", "sprintz", "native"]
_EQUAL_SQL = sql.query(sql.ORDERS, sql.framed(100), sql.family("framed", "stream, frame"), sql.sprintz("framed", "stream, frame", 3), sql.units("framed", "stream, frame", 3),
    "per AS (SELECT stream, frame, 13 + sum(vbyte) AS vbyte, 13 + sum(svb) AS svb, 13 + sum(bp128) AS bp128, 13 + sum(optpfd) AS optpfd FROM family GROUP BY ALL)",
    "total AS (SELECT " + ", ".join(f"CAST(sum({'p.' + c if c in ('vbyte', 'svb', 'bp128', 'optpfd') else 's.sprintz' if c == 'sprintz' else 'u.bytes'} + 10) AS BIGINT) AS {c}" for c in EQUAL) + " FROM per p JOIN sprintz s ON p.stream = s.stream AND p.frame = s.frame JOIN unit_size u ON p.stream = u.stream AND p.frame = u.frame)",
    "equal AS (" + " UNION ALL ".join(f"SELECT '{c}' AS codec, {c} AS bytes FROM total" for c in EQUAL) + ")", select="{}")


def equal(spark, sf_dir) -> DataFrame:
    return units.equal_framing(units.gather(samples.order_records(spark, sf_dir), samples.ORDER_CHANNELS, 100), samples.ORDER_CHANNELS)


@query(_EQUAL_SQL.format("SELECT codec, bytes FROM equal"))
def q_equal_framing(spark, sf_dir):
    return equal(spark, sf_dir)


@query(_EQUAL_SQL.format("SELECT codec, bytes FROM equal"))
def q_result_csv(spark, sf_dir):
    """Result rows written as CSV and read again."""
    path, rows = shared(spark), equal(spark, sf_dir)
    report.write_csv(rows, path)
    return report.read_csv(rows, path)


#: A reproducible stand-in for measured speed: higher is faster.
SPEED = {"vbyte": 6, "svb": 5, "bp128": 4, "optpfd": 1, "sprintz": 2, "native": 3}


def speeds(spark) -> DataFrame:
    return spark.createDataFrame(sorted(SPEED.items()), "codec string, speed int")


@query(_EQUAL_SQL.format("SELECT a.codec, a.bytes, a.speed FROM (SELECT e.*, s.speed FROM equal e JOIN (VALUES " + ", ".join(f"('{c}', {v})" for c, v in SPEED.items()) + ") s(codec, speed) ON e.codec = s.codec) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT e.*, s.speed FROM equal e JOIN (VALUES " + ", ".join(f"('{c}', {v})" for c, v in SPEED.items()) + ") s(codec, speed) ON e.codec = s.codec) b WHERE b.bytes <= a.bytes AND b.speed >= a.speed AND (b.bytes < a.bytes OR b.speed > a.speed))"))
def q_pareto(spark, sf_dir):
    rows = equal(spark, sf_dir).join(F.broadcast(speeds(spark)), "codec").withColumn("saving", -F.col("bytes"))
    return report.pareto(rows, [], ["saving", "speed"]).select("codec", "bytes", "speed")


@query(sql.query(sql.LINEITEM, sql.WHOLE, sql.units("whole", "stream", 4), select="SELECT u.stream, u.bytes, CAST(c.n * 4 AS DOUBLE) / u.bytes AS ratio FROM unit_size u JOIN (SELECT stream, count(*) AS n FROM samples GROUP BY stream) c ON u.stream = c.stream ORDER BY ratio DESC, u.stream LIMIT 3"))
def q_topk_ratio(spark, sf_dir):
    rows = lineitem(spark, sf_dir)
    raw = rows.groupBy("stream").agg((F.count(F.lit(1)) * 4).alias("raw"))
    sizes = sizing.channel_size(whole(rows), ["stream"], 4).join(raw, "stream").select("stream", "bytes", ints.ratio("raw", "bytes").alias("ratio"))
    return report.top(sizes, "ratio", 3, "stream")


@query(sql.query(sql.LINEITEM, sql.WHOLE, sql.core("whole", "stream, ch"), select="SELECT 'channel ' || ch AS category, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN bytes >= 0 THEN 1 END) AS BIGINT) AS passed, CAST(count(CASE WHEN bytes < 0 THEN 1 END) AS BIGINT) AS rejected, CAST(0 AS BIGINT) AS failed, round(avg(CASE WHEN bytes > 0 THEN CAST(n * 4 AS DOUBLE) / bytes END), 6) AS mean_ratio, 1.0::DOUBLE AS success FROM core GROUP BY ch"))
def q_summary(spark, sf_dir):
    sizes = sizing.core_size(whole(lineitem(spark, sf_dir)), ["stream", "ch"])
    results = sizes.select(F.concat(F.lit("channel "), F.col("ch")).alias("category"), F.when(F.col("bytes") < 0, "REJECTED").otherwise("PASS").alias("status"), ints.ratio(F.col("n") * 4, "bytes").alias("ratio"))
    return report.summary(results).withColumn("mean_ratio", F.round("mean_ratio", 6))


# -- loss ------------------------------------------------------------------------------

_FRAMES = (sql.LINEITEM, sql.frames(4, 50), "sent AS (SELECT stream, frame, n_rec, bytes, (bytes + 249) // 250 AS packets FROM frame)")


def sent(spark, sf_dir) -> DataFrame:
    return loss.packets(lineitem_frames(spark, sf_dir))


@query(sql.query(*_FRAMES, select="SELECT stream, frame, CAST(packets AS BIGINT) AS packets FROM sent"))
def q_mtu_packets(spark, sf_dir):
    return sent(spark, sf_dir).select("stream", "frame", "packets")


@query(sql.query(sql.LINEITEM, sql.WHOLE, sql.units("whole", "stream", 4), select="SELECT stream, CAST((bytes + 249) // 250 AS BIGINT) AS packets, round(pow(0.99::DOUBLE, (bytes + 249) // 250), 9) AS survives FROM unit_size"))
def q_survival(spark, sf_dir):
    """The chance that an unframed stream survives a loss of one packet in a hundred."""
    rows = loss.packets(sizing.channel_size(whole(lineitem(spark, sf_dir)), ["stream"], 4))
    return rows.select("stream", "packets", F.round(loss.survival("packets", 0.01), 9).alias("survives"))


_RECOVERY = (*_FRAMES, """
lost AS (SELECT t.round, s.stream, s.frame, s.n_rec, s.bytes, ((s.stream * 7919 + s.frame * 104729 + p.p * 1299709 + t.round * 15485863) % 9973) % 100 < 5 AS lost
         FROM sent s CROSS JOIN (SELECT unnest(range(4)) AS round) t, LATERAL (SELECT unnest(range(s.packets)) AS p) p),
whole_frames AS (SELECT round, stream, frame, max(n_rec) AS n_rec, max(bytes) AS bytes, NOT bool_or(lost) AS arrived FROM lost GROUP BY 1, 2, 3),
recovery AS (SELECT round, CAST(sum(CASE WHEN arrived THEN n_rec ELSE 0 END) AS BIGINT) AS recovered, CAST(sum(n_rec) AS BIGINT) AS n_rec, CAST(sum(bytes) AS BIGINT) AS sent FROM whole_frames GROUP BY round)""")


@query(sql.query(*_RECOVERY, select="SELECT CAST(round AS INTEGER) AS round, recovered, n_rec, sent FROM recovery"))
def q_loss_recovery(spark, sf_dir):
    return loss.hashed_recovery(sent(spark, sf_dir), 5, 4)


@query(sql.query(*_RECOVERY, select="SELECT CAST(sum(recovered) AS DOUBLE) / sum(n_rec) AS recovery, CAST(sum(recovered) * 16 AS DOUBLE) / sum(sent) AS effective FROM recovery"))
def q_effective_ratio(spark, sf_dir):
    return loss.effective(loss.hashed_recovery(sent(spark, sf_dir), 5, 4), 4)


@query()
def q_loss_markov(spark, sf_dir):
    """Recovery over bursty channels; a seeded chain per stream and round, so reruns agree."""
    rows = loss.markov_recovery(sent(spark, sf_dir), 0.05, 3.0, 4)
    return rows.groupBy("round").agg(F.sum("recovered").alias("recovered"), F.sum("n_rec").alias("n_rec"), F.sum("sent").alias("sent"))


@query(sql.query(sql.LINEITEM, "kept AS (SELECT DISTINCT stream, rec // 50 AS frame FROM samples WHERE (rec // 50) % 7 <> 3)", select="SELECT stream, CAST(frame AS BIGINT) AS frame, CAST(frame % 65536 AS INTEGER) AS seq, CAST(coalesce((((frame % 65536) - lag(frame % 65536) OVER (PARTITION BY stream ORDER BY frame)) % 65536 + 65536) % 65536 - 1, 0) AS BIGINT) AS missing FROM kept"))
def q_seq_gaps(spark, sf_dir):
    rows = lineitem(spark, sf_dir).select("stream", F.floor(F.col("rec") / 50).cast("bigint").alias("frame")).distinct().filter(F.col("frame") % 7 != 3)
    return frames.sequence_gaps(rows.withColumn("seq", F.pmod("frame", F.lit(65536)).cast("int")))


# -- floats ----------------------------------------------------------------------------


def floats(spark, sf_dir) -> DataFrame:
    return samples.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))


_FLOATS = "fl AS (SELECT vec_id, i - 1 AS pos, embedding[i] AS x FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) r)"
_QUANT = "qu AS (SELECT *, CAST(trunc(CASE WHEN CAST(x AS DOUBLE) * 1000 >= 0 THEN CAST(x AS DOUBLE) * 1000 + 0.5 ELSE CAST(x AS DOUBLE) * 1000 - 0.5 END) AS BIGINT) AS q FROM fl)"


@query(sql.query(_FLOATS, _QUANT, select="SELECT vec_id, CAST(pos AS INTEGER) AS pos, q FROM qu"))
def q_quantise(spark, sf_dir):
    return floats(spark, sf_dir).select("vec_id", "pos", ints.quantise("x", F.lit(1000.0)).alias("q"))


@query(sql.query(_FLOATS, _QUANT, select="SELECT vec_id, CAST(max(abs(x - CAST(CAST(q AS DOUBLE) / 1000 AS FLOAT))) AS DOUBLE) AS worst, max(abs(x - CAST(CAST(q AS DOUBLE) / 1000 AS FLOAT))) <= 0.0005005 AS within FROM qu GROUP BY vec_id"))
def q_dequantise_error(spark, sf_dir):
    rows = floats(spark, sf_dir).withColumn("back", ints.dequantise(ints.quantise("x", F.lit(1000.0)), F.lit(1000.0)))
    worst = F.max(F.abs(F.col("x") - F.col("back")))
    return rows.groupBy("vec_id").agg(worst.cast("double").alias("worst"), (worst <= 0.0005005).alias("within"))


#: Scales of four interleaved channels; the third is beyond int32 for some values.
CHANNEL_SCALES = (1000.0, 250.5, 8e9, 64.0)
_CHANNELS = (_FLOATS, "sc(c, s) AS (VALUES " + ", ".join(f"({k}, {v!r}::FLOAT::DOUBLE)" for k, v in enumerate(CHANNEL_SCALES)) + ")",
             "sx AS (SELECT vec_id, pos, x, s, CAST(x AS DOUBLE) * s + CASE WHEN CAST(x AS DOUBLE) * s >= 0 THEN 0.5 ELSE -0.5 END AS y FROM fl JOIN sc ON c = pos % 4)",
             "cq AS (SELECT vec_id, count(*) AS n, bool_and(y >= -2147483648 AND y <= 2147483647) AS fits, sum(CASE WHEN abs(y) < 1e18 THEN CAST(trunc(y) AS BIGINT) END) AS total, max(CASE WHEN abs(y) < 1e18 THEN abs(x - CAST(trunc(y) / s AS FLOAT)) END) AS worst FROM sx GROUP BY vec_id)")
_CHANNEL_ROWS = sql.query(*_CHANNELS, select="SELECT vec_id, CASE WHEN fits THEN 'ok' ELSE 'range' END AS status, CAST(n AS INTEGER) AS n, CAST(CASE WHEN fits THEN total END AS BIGINT) AS total, CAST(CASE WHEN fits THEN worst END AS DOUBLE) AS worst FROM cq")


def channel_quantised(spark, sf_dir) -> DataFrame:
    rows = samples.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", ints.quantise_channels("embedding", list(CHANNEL_SCALES)).alias("q"))
    return rows.select("vec_id", "embedding", "q.status", F.col("q.values").alias("values"))


@query(_CHANNEL_ROWS)
def q_quantise_channels(spark, sf_dir):
    """Vectors as interleaved channels of a scale each; one refused value refuses its vector."""
    rows = channel_quantised(spark, sf_dir)
    total = F.aggregate("values", F.lit(0).cast("bigint"), lambda a, v: a + v)
    back = ints.dequantise_channels("values", list(CHANNEL_SCALES))
    worst = F.array_max(F.zip_with("embedding", back, lambda x, b: F.abs(x - b)))
    return rows.select("vec_id", "status", F.size("embedding").alias("n"), total.alias("total"), worst.cast("double").alias("worst"))


@query("SELECT layer, status, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'core' AS layer, CASE WHEN bytes < 0 THEN 'refused' ELSE 'accepted' END AS status FROM ("
       + sql.query(sql.LINEITEM, sql.WHOLE, sql.core("whole", "stream, ch"), select="SELECT bytes FROM core")
       + ") UNION ALL SELECT 'channel', CASE WHEN passed THEN 'passed through' ELSE 'coded' END FROM (" + sql.query(sql.LINEITEM, sql.WHOLE, sql.payloads("whole", "stream", 4), select="SELECT passed FROM payload")
       + ") UNION ALL SELECT 'quantise', status FROM (" + _CHANNEL_ROWS + ")) GROUP BY layer, status")
def q_status_counters(spark, sf_dir):
    """Results by layer and status."""
    rows = whole(lineitem(spark, sf_dir))
    core = sizing.core_size(rows, ["stream", "ch"]).select(F.lit("core").alias("layer"), F.when(F.col("bytes") < 0, "refused").otherwise("accepted").alias("status"))
    channel = sizing.channel_payloads(rows, ["stream"], 4).select(F.lit("channel").alias("layer"), F.when(F.col("passed"), "passed through").otherwise("coded").alias("status"))
    floats_ = channel_quantised(spark, sf_dir).select(F.lit("quantise").alias("layer"), "status")
    return report.counters(core.unionByName(channel).unionByName(floats_))


@query("SELECT CAST(vec_id AS VARCHAR) AS path, CAST((i - 1) // 4 AS BIGINT) AS rec, CAST((i - 1) % 4 AS INTEGER) AS ch, CAST(embedding[i] AS FLOAT)::DOUBLE AS x, CAST([1000.0, 250.5, 8e9, 64.0][(i - 1) % 4 + 1] AS FLOAT)::DOUBLE AS scale FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) r")
def q_float_fixtures(spark, sf_dir):
    """Vectors as float fixtures of four channels, scanned again."""
    import numpy as np
    import pyarrow as pa

    def build(batches):
        scales = np.array(CHANNEL_SCALES, np.float32)
        for b in batches:
            data = [fixtures.build_floats(scales, np.array(v, np.float32).reshape(-1, 4)) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(data, pa.binary())], ["path", "content"])

    files = samples.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(build, "path string, content binary")
    rows = fixtures.float_rows(files).select("path", "rec", F.posexplode(F.arrays_zip("values", "scales")).alias("ch", "z"))
    return rows.select("path", "rec", "ch", F.col("z")["values"].cast("double").alias("x"), F.col("z")["scales"].cast("double").alias("scale"))


_XOR = (_FLOATS, "bt AS (SELECT vec_id, pos, CAST(CAST(CAST(x AS FLOAT) AS BIT) AS INTEGER) AS b FROM fl)", "xr AS (SELECT *, (b::BIGINT & 4294967295) AS u, xor(b::BIGINT & 4294967295, lag(b::BIGINT & 4294967295) OVER (PARTITION BY vec_id ORDER BY pos)) AS x FROM bt)")


def patterns(rows: DataFrame) -> DataFrame:
    """Adds u, the unsigned bit pattern of x (Spark has no such cast; one Arrow batch function)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            x = b.column(2).cast(pa.float32()).to_numpy(zero_copy_only=False).astype("<f4")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x.view("<u4").astype("int64"))], ["vec_id", "pos", "u"])

    return rows.mapInArrow(run, "vec_id long, pos int, u long")


@query(sql.query(*_XOR, select="SELECT vec_id, CAST(pos AS INTEGER) AS pos, x AS bits, CAST(CASE WHEN x = 0 THEN 32 ELSE 32 - length(bin(x)) END AS INTEGER) AS clz, CAST(CASE WHEN x = 0 THEN 32 ELSE length(bin(x & -x)) - 1 END AS INTEGER) AS ctz FROM xr WHERE x IS NOT NULL"))
def q_xor_bits(spark, sf_dir):
    w = Window.partitionBy("vec_id").orderBy("pos")
    rows = patterns(floats(spark, sf_dir)).withColumn("bits", F.col("u").bitwiseXOR(F.lag("u").over(w))).filter("bits IS NOT NULL")
    return rows.select("vec_id", "pos", "bits", ints.leading_zeros("bits").alias("clz"), ints.trailing_zeros("bits").alias("ctz"))


@query("WITH RECURSIVE " + sql.query(*_XOR, """
z AS (SELECT vec_id, pos, x, CASE WHEN x = 0 THEN 32 ELSE 32 - length(bin(x)) END AS l, CASE WHEN x = 0 THEN 32 ELSE length(bin(x & -x)) - 1 END AS t FROM xr WHERE x IS NOT NULL),
st AS (SELECT DISTINCT vec_id, CAST(0 AS BIGINT) AS pos, CAST(32 AS BIGINT) AS pl, CAST(32 AS BIGINT) AS pt, CAST(32 AS BIGINT) AS bits FROM fl
  UNION ALL SELECT s.vec_id, z.pos, CASE WHEN z.x = 0 OR (z.l >= s.pl AND z.t >= s.pt) THEN s.pl ELSE z.l END, CASE WHEN z.x = 0 OR (z.l >= s.pl AND z.t >= s.pt) THEN s.pt ELSE z.t END,
    s.bits + CASE WHEN z.x = 0 THEN 1 WHEN z.l >= s.pl AND z.t >= s.pt THEN 2 + 32 - s.pl - s.pt ELSE 12 + 32 - z.l - z.t END
  FROM st s JOIN z ON s.vec_id = z.vec_id AND z.pos = s.pos + 1)""", select="SELECT vec_id, CAST((max(bits) + 7) // 8 AS BIGINT) AS bytes FROM st GROUP BY vec_id").removeprefix("WITH "))
def q_xor_size(spark, sf_dir):
    """Sizes of lossless float streams: a fold that carries the window of significant bits."""
    rows = patterns(floats(spark, sf_dir)).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("pos", "u"))).alias("xs"))
    zero = F.struct(F.lit(32).alias("lead"), F.lit(32).alias("trail"), F.lit(32).cast("bigint").alias("bits"), F.lit(None).cast("bigint").alias("last"))

    def step(acc, item):
        x = item["u"].bitwiseXOR(acc["last"])
        lead, trail = ints.leading_zeros(x), ints.trailing_zeros(x)
        fits = (lead >= acc["lead"]) & (trail >= acc["trail"])
        keep = acc["last"].isNull() | (x == 0) | fits
        bits = F.when(acc["last"].isNull(), 0).when(x == 0, 1).when(fits, F.lit(34) - acc["lead"] - acc["trail"]).otherwise(F.lit(44) - lead - trail)
        return F.struct(F.when(keep, acc["lead"]).otherwise(lead).alias("lead"), F.when(keep, acc["trail"]).otherwise(trail).alias("trail"), (acc["bits"] + bits).alias("bits"), item["u"].alias("last"))

    return rows.select("vec_id", ints.ceil_div(F.aggregate("xs", zero, step)["bits"], 8).alias("bytes"))


# -- messages --------------------------------------------------------------------------

# Id, payload bytes, channels, checksum byte, tier, live-every and group of the public messages.
_SCHEMA_ROWS = [(0, 9, 6, 50, "live", 0, "fixed"), (1, 31, 13, 124, "live", 0, "EXT_STAT"), (24, 30, 11, 24, "bulk", 0, "EXT_STAT"), (26, 22, 10, 170, "bulk", 0, "RAW_SENS"), (30, 28, 7, 39, "bulk", 0, "EXTRA1"), (33, 28, 9, 104, "bulk", 5, "POSITION"), (36, 21, 10, 222, "bulk", 0, "RC_CHAN"), (65, 42, 21, 118, "bulk", 0, "RC_CHAN"), (74, 20, 6, 20, "bulk", 4, "EXTRA2"), (147, 36, 18, 154, "bulk", 0, "EXTRA3"), (241, 32, 8, 90, "bulk", 0, "EXTRA3")]
_SCHEMA = "sch(msgid, payload, channels, crc_extra, tier, live_every, grp) AS (VALUES " + ", ".join(map(str, _SCHEMA_ROWS)) + ")"
_RATES = "rt(profile, grp, hz) AS (VALUES " + ", ".join(f"('{p}', '{g}', {hz}::DOUBLE)" for p, hzs in (("SR1", (1, 2, 2, 2, 2, 4, 4, 2)), ("SR0", (1, 10, 25, 10, 10, 10, 10, 10))) for g, hz in zip(("fixed", "RAW_SENS", "EXT_STAT", "POSITION", "RC_CHAN", "EXTRA1", "EXTRA2", "EXTRA3"), hzs)) + ")"
_MESSAGES = "ids AS (SELECT msgid, row_number() OVER (ORDER BY msgid) - 1 AS k FROM sch), msg AS (SELECT i.msgid, e.user_id AS sysid, e.ts AS t, e.event_id, e.value FROM events e JOIN ids i ON i.k = (ascii(e.event_type) * 31 + length(e.event_type)) % 11)"
_ORDINAL = "num AS (SELECT m.*, s.tier, s.live_every, s.grp, row_number() OVER (PARTITION BY sysid, m.msgid ORDER BY t, event_id) - 1 AS ordinal FROM msg m JOIN sch s ON m.msgid = s.msgid)"


def numbered(spark, sf_dir) -> DataFrame:
    rows = messages.from_events(samples.table(spark, sf_dir, "events"), spark)
    return messages.ordinals(messages.routed(rows, messages.schema_table(spark)))


@query(sql.query(_SCHEMA, select="SELECT msgid, payload, channels, crc_extra, tier, TRUE AS valid FROM sch"))
def q_message_schema(spark, sf_dir):
    return messages.schema_table(spark).select("msgid", "payload", "channels", "crc_extra", "tier", "valid")


@query(sql.query(_SCHEMA, _RATES, select="SELECT s.msgid, r.profile, r.hz, d.delay, CAST(greatest(1, least(512, floor(r.hz * d.delay + 0.5))) AS BIGINT) AS target FROM sch s JOIN rt r ON s.grp = r.grp CROSS JOIN (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE), (5.0::DOUBLE)) d(delay)"))
def q_batch_targets(spark, sf_dir):
    rates = messages.message_rates(spark)
    return rates.withColumn("delay", F.explode(F.array(*map(F.lit, (0.25, 0.5, 1.0, 2.0, 5.0))))).select("msgid", "profile", "hz", "delay", ints.target_batch("hz", "delay").alias("target"))


@query(sql.query(_SCHEMA, _MESSAGES, _ORDINAL, select="SELECT tier, msgid, CAST(count(*) AS BIGINT) AS n FROM num GROUP BY tier, msgid"))
def q_route_tiers(spark, sf_dir):
    return numbered(spark, sf_dir).groupBy("tier", "msgid").agg(F.count(F.lit(1)).alias("n"))


@query(sql.query(_SCHEMA, _MESSAGES, _ORDINAL, select="SELECT msgid, sysid, event_id, CAST(ordinal AS BIGINT) AS ordinal FROM num WHERE tier = 'bulk' AND live_every > 0 AND ordinal % greatest(live_every, 1) = 0"))
def q_decimate(spark, sf_dir):
    return messages.decimated(numbered(spark, sf_dir)).select("msgid", "sysid", "event_id", "ordinal")


@query(sql.query(_SCHEMA, _RATES, _MESSAGES, _ORDINAL, select="SELECT n.sysid, n.msgid, CAST(n.ordinal // CAST(greatest(1, least(512, floor(r.hz * 2.0 + 0.5))) AS BIGINT) AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n, CAST(max(greatest(1, least(512, floor(r.hz * 2.0 + 0.5)))) AS BIGINT) AS target FROM num n JOIN rt r ON n.grp = r.grp AND r.profile = 'SR1' WHERE n.tier = 'bulk' GROUP BY 1, 2, 3"))
def q_batches(spark, sf_dir):
    return messages.batches(numbered(spark, sf_dir), messages.message_rates(spark).filter("profile = 'SR1'"), 2.0)


@query(sql.query(_SCHEMA, _MESSAGES, "per AS (SELECT m.msgid, count(*) AS n, sum(s.payload + 12) AS bytes FROM msg m JOIN sch s ON m.msgid = s.msgid GROUP BY m.msgid)", select="SELECT CAST(msgid AS INTEGER) AS msgid, CAST(n AS BIGINT) AS n, CAST(bytes AS BIGINT) AS bytes, CAST(bytes AS DOUBLE) / 300.0::DOUBLE AS bytes_per_s, CAST(bytes AS DOUBLE) / (SELECT sum(bytes) FROM per) AS share FROM per"))
def q_mix(spark, sf_dir):
    rows = messages.from_events(samples.table(spark, sf_dir, "events"), spark)
    return messages.mix(rows, messages.schema_table(spark), 300.0).drop("name")


@query(sql.query(_SCHEMA, _MESSAGES, "got AS (SELECT * FROM msg WHERE event_id % 11 <> 4)", "a AS (SELECT *, row_number() OVER (PARTITION BY sysid, msgid ORDER BY t, event_id) AS o FROM msg)", "b AS (SELECT *, row_number() OVER (PARTITION BY sysid, msgid ORDER BY t, event_id) AS o FROM got)",
                 select="SELECT coalesce(a.msgid, b.msgid) AS msgid, CAST(count(a.o) AS BIGINT) AS n_sent, CAST(count(CASE WHEN a.o IS NOT NULL AND b.o IS NOT NULL AND a.value IS NOT DISTINCT FROM b.value THEN 1 END) AS BIGINT) AS n_same, CAST(count(CASE WHEN a.o IS NOT NULL AND b.o IS NOT NULL AND a.value IS DISTINCT FROM b.value THEN 1 END) AS BIGINT) AS n_other, CAST(count(CASE WHEN b.o IS NULL THEN 1 END) AS BIGINT) AS n_lost FROM a FULL JOIN b ON a.sysid = b.sysid AND a.msgid = b.msgid AND a.o = b.o GROUP BY 1"))
def q_positional_verify(spark, sf_dir):
    rows = messages.from_events(samples.table(spark, sf_dir, "events"), spark)
    return messages.verified(rows, rows.filter(F.col("event_id") % 11 != 4))


@query(sql.query(sql.EVENTS, sql.frames(1, 16), select="SELECT stream, frame, CAST(bytes + 9 AS BIGINT) AS packed, CAST(n_rec * 17 AS BIGINT) AS plain, CAST(least(bytes + 9, n_rec * 17) AS BIGINT) AS sent FROM frame"))
def q_cheaper_of_two(spark, sf_dir):
    """A batch goes as one packed frame behind a 9-byte header, or as plain 17-byte messages."""
    rows = units.frame_size(units.gather(samples.event_records(spark, sf_dir), 1, 16), 1)
    packed, plain = F.col("bytes") + 9, (F.col("n_rec") * 17).cast("bigint")
    return rows.select("stream", "frame", packed.alias("packed"), plain.alias("plain"), F.least(packed, plain).alias("sent"))


# -- latency ---------------------------------------------------------------------------


@query("WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, CAST(max(n) AS BIGINT) AS n, min(value) AS least, max(value) AS most, " + ", ".join(f"max(CASE WHEN k = floor((n - 1) * {q}::DOUBLE) + 1 THEN value END) AS {c}" for q, c in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"), (0.999, "p99_9"))) + " FROM p GROUP BY event_type")
def q_percentile_index(spark, sf_dir):
    return report.percentiles(samples.table(spark, sf_dir, "events"), ["event_type"], "value", [0.5, 0.95, 0.99, 0.999])


@query("WITH p AS (SELECT event_type, CAST(floor(value * 100 + 0.5) AS BIGINT) + 1 AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events), q AS (SELECT event_type, sum(v) AS total, count(*) AS n, max(CASE WHEN k = floor((n - 1) * 0.5::DOUBLE) + 1 THEN v END) AS p50, max(CASE WHEN k = floor((n - 1) * 0.99::DOUBLE) + 1 THEN v END) AS p99 FROM p GROUP BY event_type) SELECT event_type, CAST(p99 AS DOUBLE) / p50 AS jitter, CAST(total AS DOUBLE) / n AS mean FROM q")
def q_jitter(spark, sf_dir):
    rows = samples.table(spark, sf_dir, "events").withColumn("v", samples.scaled("value", 100) + 1)
    per = report.percentiles(rows, ["event_type"], "v", [0.5, 0.99])
    mean = rows.groupBy("event_type").agg((F.sum("v") / F.count(F.lit(1))).alias("mean"))
    return per.join(mean, "event_type").select("event_type", (F.col("p99") / F.col("p50")).alias("jitter"), "mean")


# -- bytes -----------------------------------------------------------------------------


@query(sql.query(sql.LINEITEM, sql.frames(4, 50), select="SELECT stream, frame, CAST(n_rec AS INTEGER) AS n_rec, CAST(bytes AS INTEGER) AS n_bytes, TRUE AS sound, CAST(frame % 65536 AS BIGINT) AS seq FROM frame"))
def q_frame_bytes(spark, sf_dir):
    """Emitted frames: their lengths equal the closed-form sizes, their headers and checksums hold."""
    rows = frames.encode(samples.lineitem_records(spark, sf_dir), 4, 50)
    return rows.select("stream", "frame", "n_rec", F.octet_length("payload").alias("n_bytes"), frames.sound(F.col("payload")).alias("sound"), frames.header(F.col("payload"))[0].alias("seq"))


@query(sql.query(sql.LINEITEM, select="SELECT stream, rec, c0, c1, c2, c3 FROM li"))
def q_frame_roundtrip(spark, sf_dir):
    return frames.decode(frames.encode(samples.lineitem_records(spark, sf_dir), 4, 50), 4, 50)


@query(sql.query(sql.LINEITEM, "fr AS (SELECT DISTINCT stream, rec // 50 AS frame FROM samples)", select="SELECT stream, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS sound, CAST(0 AS BIGINT) AS sound_when_damaged FROM fr GROUP BY stream"))
def q_crc_valid(spark, sf_dir):
    """One changed byte in each frame is caught."""
    rows = frames.encode(samples.lineitem_records(spark, sf_dir), 4, 50)
    at = F.pmod(F.col("frame") * 31, F.octet_length("payload") - 6) + 7
    flipped = F.concat(F.substring("payload", F.lit(1), at - 1), F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring("payload", at, F.lit(1))), 16, 10).cast("int").bitwiseXOR(F.lit(1))), 2, "0")), F.substring("payload", at + 1, F.lit(1 << 20)))
    return rows.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.count_if(frames.sound(F.col("payload"))).alias("sound"), F.count_if(frames.sound(flipped)).alias("sound_when_damaged"))


@query(sql.query(sql.ORDERS, sql.WHOLE, sql.family("whole", "stream"), sql.sprintz("whole", "stream", 3), select=" UNION ALL ".join(f"SELECT '{c}' AS codec, stream, CAST(max(n) AS BIGINT) AS n_rec, CAST(13 + sum({c}) AS BIGINT) AS bytes, TRUE AS exact FROM family GROUP BY stream" for c in ("vbyte", "svb", "bp128", "optpfd")) + " UNION ALL SELECT 'sprintz', stream, n_rec, sprintz, TRUE FROM sprintz"))
def q_rival_bytes(spark, sf_dir):
    """Emitted bytes of the rivals, decoded again; lengths equal the closed-form sizes."""
    rows, out = samples.order_records(spark, sf_dir), None
    for name in ("vbyte", "svb", "bp128", "optpfd", "sprintz"):
        one = frames.rival_bytes(rows, 3, name).select(F.lit(name).alias("codec"), "stream", "n_rec", "bytes", "exact")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def q_simple8b_size(spark, sf_dir):
    return frames.rival_bytes(samples.order_records(spark, sf_dir), 3, "simple8b")


# -- sources, scenarios, streams -------------------------------------------------------


def shared(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="strandpack-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/strandpack/{uuid.uuid4().hex}"


@query(sql.query(sql.EVENTS, select="SELECT CAST(stream AS BIGINT) AS stream, rec, c0 FROM ev"))
def q_fixture_roundtrip(spark, sf_dir):
    """Streams written as fixture files, a file each, and scanned again."""
    path = shared(spark)
    rows = samples.event_records(spark, sf_dir).select(F.col("stream").cast("string").alias("stream"), "rec", F.array(F.col("c0").cast("int")).alias("values"))
    fixtures.write(rows, path.removeprefix("file://"))
    back = fixtures.read(spark, path, 1)
    return back.select(F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("bigint").alias("stream"), "rec", F.col("values")[0].cast("bigint").alias("c0"))


_LOG = [flightlog.Definition(7, 0, "GPS", "LLe", ["Lat", "Lng", "Alt"])]


@query(sql.query(sql.EVENTS, select="SELECT stream, rec, c0 AS lat, rec AS lng, CAST(trunc(CASE WHEN c0 / 100.0::DOUBLE * 1000 >= 0 THEN c0 / 100.0::DOUBLE * 1000 + 0.5 ELSE c0 / 100.0::DOUBLE * 1000 - 0.5 END) AS BIGINT) AS alt FROM ev"))
def q_flight_log(spark, sf_dir):
    """Self-describing logs built of each event stream, scanned, and extracted by label."""
    import pyarrow as pa

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("rec")
        data = flightlog.build(_LOG, [(7, (v, r, v)) for v, r in zip(t.column("c0").to_pylist(), t.column("rec").to_pylist())])
        return pa.table({"path": pa.array([str(t.column("stream")[0].as_py())]), "content": pa.array([data], pa.binary())})

    logs = samples.event_records(spark, sf_dir).groupBy("stream").applyInArrow(build, "path string, content binary")
    got = flightlog.extract(flightlog.rows(logs), "GPS")
    return got.select(F.col("path").cast("bigint").alias("stream"), "rec", *(F.col("values")[k].cast("bigint").alias(c) for k, c in enumerate(("lat", "lng", "alt"))))


@query()
def q_scenarios(spark, sf_dir):
    """The synthetic scenarios, sized and judged: refused streams are not failures."""
    shapes = generators.shapes()
    base = spark.range(10_000).select(F.lit("all").alias("name"), F.col("id").alias("i"))
    wide = base.select("i", *(c.cast("bigint").alias(s) for s, c in shapes.items()))
    long = wide.unpivot(["i"], list(shapes), "shape", "v")
    rows = long.join(F.broadcast(generators.scenarios(spark)), "shape").filter("i < n").select("name", "category", "i", "v")
    sizes = sizing.core_size(rows, ["category", "name"])
    results = sizes.select("category", "name", "n", "bytes", F.when(F.col("bytes") < 0, "REJECTED").otherwise("PASS").alias("status"), ints.ratio(F.col("n") * 4, "bytes").alias("ratio"))
    return results


@query(sql.query(sql.EVENTS, sql.frames(1, 16), select="SELECT stream AS key, CAST(frame AS BIGINT) AS seq, CAST(n_rec AS INTEGER) AS n, CAST(bytes AS INTEGER) AS n_bytes FROM frame WHERE n_rec = 16"))
def q_stream_accumulate(spark, sf_dir):
    """Event values gathered by a stateful stream to frames of 16 per user; what is left stays in state."""
    out = shared(spark)
    schema = samples.table(spark, sf_dir, "events").schema
    # a pattern, as streaming sources take folders and patterns but no single file
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    keyed = stream.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ord"), F.col("event_id").alias("tie"), samples.scaled("value", 100).alias("v"))
    sink = accumulator.accumulate(keyed, 16).writeStream.format("parquet").option("path", f"{out}/frames").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    sink.awaitTermination()
    return spark.read.schema(accumulator.OUTPUT).parquet(f"{out}/frames").select("key", "seq", "n", "n_bytes")


@query()
def q_proxy(spark, sf_dir):
    """Events as messages over the two-tier link: packets, bytes and what the receiver reads, by message."""
    rows = messages.from_events(samples.table(spark, sf_dir, "events"), spark)
    sizes = {m.msgid: m.payload for m in mavlink.MESSAGES.values()}
    size = F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv))
    body = F.rpad(F.concat(F.hex(F.unix_millis(F.col("t").cast("timestamp"))), F.hex(samples.scaled("value", 100))), 2 * 60, "0")
    built = rows.select("sysid", "msgid", F.pmod("event_id", F.lit(256)).cast("int").alias("seq"), F.unix_micros(F.col("t").cast("timestamp")).alias("t"), F.unhex(F.substring(body, F.lit(1), size[F.col("msgid")] * 2)).alias("payload"))
    packets = proxy.send(built, "SR1", 2.0)
    return packets.groupBy("msgid", "kind").agg(F.count(F.lit(1)).alias("packets"), F.sum("n_bytes").alias("bytes"), F.max("n_bytes").alias("largest"))


@query("SELECT msgid, CAST(n AS BIGINT) AS n FROM (VALUES (0, 11), (1, 20), (24, 20), (26, 20), (30, 40), (33, 20), (36, 20), (65, 20), (74, 40), (147, 20), (241, 20)) v(msgid, n)")
def q_message_source(spark, sf_dir):
    """Messages due in ten seconds at the radio profile's rates."""
    return generators.messages(spark, "SR1", 10.0).groupBy("msgid").agg(F.count(F.lit(1)).alias("n"))
