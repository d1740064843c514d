import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandpack.functions import mavlink
from strandpack.operators import report
from strandpack.sources import fixtures, flightlog, generators, vectors
from strandpack.streaming import accumulator, proxy


def test_fixture_files(spark, tmp_path):
    x = np.arange(24, dtype=np.int32).reshape(-1, 3) - 5
    (tmp_path / "a.bin").write_bytes(fixtures.build(x))
    rows = fixtures.read(spark, f"file://{tmp_path}", 3, 6).orderBy("rec").collect()
    assert [r["values"] for r in rows] == x[:6].tolist()
    with pytest.raises(Exception, match="3 channels, not 4"):
        fixtures.read(spark, f"file://{tmp_path}", 4).collect()
    with pytest.raises(ValueError):
        fixtures.parse(fixtures.build(x)[:-1])


def test_log_scan_skips_damage_and_unknown_types():
    d = [flightlog.Definition(1, 0, "ATT", "fff", ["Roll", "Pitch", "Yaw"]), flightlog.Definition(2, 0, "BAT", "CcZ", ["Volt", "Curr", "Note"])]
    log = flightlog.build(d, [(1, (1.0, -2.0, 0.5)), (2, (1234, -50, b"x"))])
    log = log[:178] + b"\x00\xa3junk" + log[178:] + b"\xa3\x95\x63zzz"
    rows = list(flightlog.scan(log))
    assert [r[1].name for r in rows[:-1]] == ["ATT", "BAT"]
    assert rows[0][2] == {"Roll": 1.0, "Pitch": -2.0, "Yaw": 0.5}
    assert rows[-1][0] == 6 + 4


def test_log_definitions_with_unlike_labels_are_dropped():
    bad = flightlog.Definition(1, 0, "ATT", "ff", ["Roll", "Pitch", "Yaw"])
    assert [r for r in flightlog.scan(flightlog.build([bad], [(1, (1.0, 2.0))])) if r[1]] == []


def test_log_extract_and_inventory(spark, tmp_path):
    d = [flightlog.Definition(1, 0, "ATT", "ccC", ["Roll", "Pitch", "Yaw"])]
    (tmp_path / "a.log").write_bytes(flightlog.build(d, [(1, (100 * k, -50, 9000)) for k in range(5)]))
    log = flightlog.read(spark, f"file://{tmp_path}")
    got = [r["values"] for r in flightlog.extract(log, "ATT").orderBy("rec").collect()]
    half_away = lambda x: int(x + math.copysign(0.5, x)) if x else 0
    assert got == [[half_away(k * flightlog.MRAD), half_away(-0.5 * flightlog.MRAD), half_away(90 * flightlog.MRAD)] for k in range(5)]
    assert flightlog.extract(log, "GPS").count() == 0
    r = flightlog.inventory(log).first()
    assert (r.name, r.n, r.labels, r.skipped) == ("ATT", 5, "Pitch,Roll,Yaw", 0)


def test_vector_text(spark, tmp_path):
    text = "# note\nVEKTOR a\nACIKLAMA x\nKATMAN kanal\nKANAL 2\nGIRDI 1 2 -3 4\nCIKTI 0aff\nSON\n\nVEKTOR b\nKATMAN float_xor\nGIRDIF 3f800000\nCIKTI 00\nSON\n"
    a, b = vectors.parse(text)
    assert a["input"] == [1, 2, -3, 4] and a["output"] == b"\x0a\xff" and vectors.floats(b["input_bits"])[0] == 1.0
    (tmp_path / "v.txt").write_text(text)
    rows = {r.name: r for r in vectors.read(spark, f"file://{tmp_path}/v.txt").collect()}
    assert rows["a"].input == [1, 2, -3, 4] and rows["a"].channels == 2 and rows["b"].channels == 1 and bytes(rows["a"].output) == b"\x0a\xff"


def test_generators(spark):
    for name in generators.shapes():
        a = [r.v for r in generators.stream(spark, name, 50).orderBy("i").collect()]
        assert len(a) == 50 and a == [r.v for r in generators.stream(spark, name, 50).orderBy("i").collect()]
    assert generators.telemetry(spark, 20).count() == 20
    assert generators.find("EMPTY")[3] == 0 and generators.scenarios(spark, "EDGE").count() == 3
    assert generators.locate("pyproject-nowhere", "/tmp") is None
    t = [(r.t, r.place) for r in generators.messages(spark, "SR1", 2.0).collect()]
    assert t == sorted(t)


def test_checksums_and_frames():
    assert mavlink.crc16(b"123456789") == 0x6F91
    for m in mavlink.MESSAGES.values():
        payload = bytes(range(1, m.payload)) + b"\0"
        data = mavlink.frame(m.msgid, payload, 300)
        got, size = mavlink.read_frame(data)
        assert size == len(data) == m.payload - 1 + mavlink.OVERHEAD and got["payload"] == payload and got["seq"] == 300 & 255
        assert mavlink.read_frame(data[:-1] + bytes([data[-1] ^ 1])) is None
        channels = mavlink.to_channels(m, payload, False)
        assert len(channels) == m.channels and mavlink.from_channels(m, channels, False) == payload


def sent_rows(spark, n=120):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(n):
        for msgid in (0, 26, 33, 147):
            m = mavlink.MESSAGES[msgid]
            rows.append((k % 2, msgid, k % 256, k, bytearray(int(v) & 255 for v in 20 + rng.integers(0, 3, m.payload))))
    return spark.createDataFrame(rows, "sysid long, msgid int, seq int, t long, payload binary"), rows


def test_proxy_keeps_every_payload(spark):
    df, rows = sent_rows(spark)
    packets = proxy.send(df, "SR0", 2.0, quantise=False)
    assert packets.filter(f"kind = {mavlink.KIND_BULK}").agg(F.max("n_bytes")).first()[0] <= 250
    got = proxy.receive(packets.orderBy(F.rand(1)), quantise=False)
    bulk = got.filter((F.col("kind") != mavlink.KIND_LIVE) | (F.col("msgid") == 0)).groupBy("sysid", "msgid").agg(F.sort_array(F.collect_list(F.hex("payload"))).alias("p")).collect()
    want = {}
    for s, msgid, _, _, p in rows:
        want.setdefault((s, msgid), []).append(bytes(p).hex().upper())
    assert {(r.sysid, r.msgid): r.p for r in bulk} == {k: sorted(v) for k, v in want.items()}
    live = got.filter(f"kind = {mavlink.KIND_LIVE} AND msgid = 33").count()
    assert live == 2 * 12


def test_stream_gathers_as_the_batch_does(spark, tmp_path):
    rows = spark.range(500).select(F.pmod("id", F.lit(7)).alias("key"), F.col("id").alias("ord"), F.lit(0).alias("tie"), (F.col("id") * 5).alias("v"))
    rows.filter("ord < 250").write.parquet(f"{tmp_path}/in/a")
    rows.filter("ord >= 250").write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = accumulator.accumulate(stream, 16).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(accumulator.OUTPUT).parquet(f"{tmp_path}/out").groupBy("key").agg(F.sum("n").alias("n"), F.max("seq").alias("seq"))
    want = accumulator.batch_twin(rows, 16).groupBy("key").agg(F.sum("n").alias("n"), F.max("seq").alias("seq"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_percentiles_take_the_truncated_index(spark):
    df = spark.createDataFrame([("a", v) for v in (4, 1, 3, 2)], "k string, v int")
    r = report.percentiles(df, ["k"], "v", [0.5, 0.95]).first()
    assert (r.p50, r.p95, r.least, r.most) == (2, 3, 1, 4)


def test_pareto_drops_what_is_beaten(spark):
    df = spark.createDataFrame([("a", 1, 9), ("b", 5, 5), ("c", 4, 5), ("d", 5, 5), ("e", 9, 1)], "n string, x int, y int")
    assert sorted(r.n for r in report.pareto(df, [], ["x", "y"]).collect()) == ["a", "b", "d", "e"]


def test_float_fixtures_are_read_from_files(spark, tmp_path):
    scales = np.array([10, 0.5], np.float32)
    x = np.arange(6, dtype=np.float32).reshape(3, 2) / 8
    (tmp_path / "a.bin").write_bytes(fixtures.build_floats(scales, x))
    (tmp_path / "b.bin").write_bytes(fixtures.build_floats(scales, x[:0]))
    got = sorted((r["rec"], r["scales"], r["values"]) for r in fixtures.read_floats(spark, str(tmp_path)).collect())
    assert got == [(i, [10.0, 0.5], x[i].tolist()) for i in range(3)]
    with pytest.raises(ValueError):
        fixtures.parse_floats(fixtures.build_floats(scales, x)[:-1])
