import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_units import plan_of

from strandpack.functions import mavlink
from strandpack.plans.queries import QUERIES
from strandpack.streaming import proxy


def payloads(m, kind, n, rng):
    if kind == "text":
        return [(b"18C2F00A" + b"%X" % int(v)).ljust(m.payload, b"\0")[: m.payload] for v in rng.integers(0, 9000, n)]
    if kind == "steady":
        return [bytes([7] * (m.payload - 3)) + bytes(3)] * n
    if kind == "floats":
        return [np.concatenate([rng.choice([np.nan, np.inf, -1e30, 1.5, -0.0], 20)]).astype("<f4").tobytes()[: m.payload].ljust(m.payload, b"\0") for _ in range(n)]
    return [rng.integers(0, 256, m.payload).astype(np.uint8).tobytes() for _ in range(n)]


def one_by_one(rows, rates, delay, mtu, quantise):
    """Packets of one sender's messages of one kind, by the functions of single messages and batches."""
    (sysid, msgid), out = rows[0][:2], []
    m = mavlink.MESSAGES.get(msgid)
    plain = lambda r: bytes([mavlink.KIND_LIVE]) + mavlink.frame(msgid, r[4], r[2], sysid & 255, 1)
    if m is None or m.tier == mavlink.LIVE:
        return [plain(r) for r in rows]
    target, seq = int(max(1, min(512, rates[m.group] * delay + 0.5))), 0
    for s in range(0, len(rows), target):
        some = rows[s : s + target]
        out += [plain(r) for k, r in enumerate(some, s) if m.live_every and k % m.live_every == 0]
        packets, seq = mavlink.bulk_packets(m, [{"payload": r[4], "seq": r[2], "sysid": sysid & 255, "compid": 1} for r in some], seq, mtu, quantise)
        out += packets
    return out


@pytest.mark.parametrize(("delay", "mtu", "quantise"), [(2.0, 250, True), (0.1, 250, False), (9.0, 60, True), (5.0, 30, False)])
def test_packets_equal_those_of_single_batches(spark, delay, mtu, quantise):
    rng = np.random.default_rng(3)
    rows = []
    for sysid, kind in ((1, "text"), (300, "any"), (5, "steady"), (6, "floats")):
        for msgid in (*mavlink.MESSAGES, 999):
            m = mavlink.MESSAGES.get(msgid) or mavlink.MESSAGES[0]
            n = int(rng.integers(1, 30))
            rows += [(sysid, msgid, k % 256, k, p) for k, p in enumerate(payloads(m, kind, n, rng))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = proxy.send(spark.createDataFrame(rows, "sysid long, msgid int, seq int, t long, payload binary").orderBy(F.rand(5)), "SR0", delay, mtu, quantise).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rates = dict(zip(mavlink.GROUPS, mavlink.PROFILES["SR0"]))
    have = {}
    for r in sorted(got, key=lambda r: (r.sysid, r.msgid, r.no)):
        have.setdefault((r.sysid, r.msgid), []).append((r.no, r.kind, r.n_bytes, bytes(r.packet)))
    for key in {r[:2] for r in rows}:
        want = one_by_one([r for r in rows if r[:2] == key], rates, delay, mtu, quantise)
        assert have.pop(key) == [(k, p[0], len(p), p) for k, p in enumerate(want)], key
    assert not have


def test_a_payload_shorter_than_its_message_is_refused():
    with pytest.raises(struct.error):
        mavlink.to_channels_many(mavlink.MESSAGES[26], [bytes(5)], True)


def test_checksum_by_its_bits():
    def crc(data, x=0xFFFF):
        for byte in data:
            x ^= byte
            for _ in range(8):
                x = x >> 1 ^ (0x8408 if x & 1 else 0)
        return x

    rng = np.random.default_rng(6)
    for n in range(40):
        data = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        start = int(rng.integers(1 << 16))
        assert mavlink.crc16(data) == crc(data) and mavlink.crc16(data, start) == crc(data, start)


def test_messages_are_sent_many_at_once(spark, smallest):
    """No call of a Python function per sender and message."""
    plan = plan_of(QUERIES["q_proxy"](spark, smallest))
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
