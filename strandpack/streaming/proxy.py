"""Link packets of whole message streams, and the receiver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandpack.functions import codec, mavlink

PACKETS = "sysid long, msgid int, no long, kind int, n_bytes int, packet binary"
MESSAGE_ROWS = "sysid long, kind int, msgid int, seq int, payload binary"


def send(messages: DataFrame, profile: str, delay: float, mtu: int = 250, quantise: bool = True) -> DataFrame:
    """Packets of (sysid, msgid, seq, t, payload): live tiers as they come, bulk in batches for the delay.

    Batches, and live copies of every N-th, are per sender and message kind. These lie in order in
    their partition and pass in Arrow batches: what is kept of a sender is the batch begun.
    """
    rates = dict(zip(mavlink.GROUPS, mavlink.PROFILES[profile]))

    def run(batches):
        link = _Link(rates, delay, mtu, quantise)
        for b in batches:
            yield link.packets(link.batches(b))
        yield link.packets(link.rest())

    rows = messages.select(F.col("sysid").cast("bigint").alias("sysid"), F.col("msgid").cast("int").alias("msgid"), "seq", "payload", "t").repartition("sysid", "msgid")
    return rows.sortWithinPartitions("sysid", "msgid", "t", "seq", "payload").drop("t").mapInArrow(run, PACKETS)


class _Link:
    """The sender's state while messages pass by (sysid, msgid)."""

    def __init__(self, rates: dict[str, int], delay: float, mtu: int, quantise: bool):
        self.rates, self.delay, self.mtu, self.quantise = rates, delay, mtu, quantise
        self.key, self.held = None, []
        self.taken = self.number = self.sent = 0

    def target(self, msgid: int) -> int:
        """Messages that a batch gathers; 0 for live ones, known or not."""
        m = mavlink.MESSAGES.get(msgid)
        return 0 if m is None or m.tier == mavlink.LIVE else int(max(1, min(512, self.rates[m.group] * self.delay + 0.5)))

    def batches(self, b: pa.RecordBatch) -> list:
        """(key, messages) of what these rows complete; a live message is on its own."""
        out, columns = [], [b.column(i).to_pylist() for i in range(4)]
        # what was held belongs to the first key, or is complete
        key, some = self.held or (None, [])
        target = self.target(key[1]) if key else 0
        for sysid, msgid, seq, payload in zip(*columns):
            if key != (sysid, msgid):
                if some:
                    out.append((key, some))
                key, some, target = (sysid, msgid), [], self.target(msgid)
            some.append((seq, payload))
            if len(some) == target or not target:
                out.append((key, some))
                some = []
        self.held = (key, some) if some else []
        return out

    def rest(self) -> list:
        held, self.held = self.held, []
        return [held] if held else []

    def packets(self, batches: list) -> pa.RecordBatch:
        cut = self._cut(batches)
        rows: list[tuple] = []
        for k, (key, some) in enumerate(batches):
            if key != self.key:
                self.key, self.taken, self.number, self.sent = key, 0, 0, 0
            packets = self._plain(key, some) if k not in cut else self._bulk(key, some, *cut[k])
            rows += [(*key, self.sent + n, p[0], len(p), p) for n, p in enumerate(packets)]
            self.taken += len(some)
            self.sent += len(packets)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["sysid", "msgid", "no", "kind", "n_bytes", "packet"])

    def _cut(self, batches: list) -> dict:
        """By place, for bulk: the pieces of the batch, and its messages' payloads and lengths when sent on their own."""
        out, by_id = {}, {}
        for k, (key, _) in enumerate(batches):
            if self.target(key[1]):
                by_id.setdefault(key[1], []).append(k)
        for msgid, places in by_id.items():
            m = mavlink.MESSAGES[msgid]
            table = mavlink.to_channels_many(m, [p for k in places for _, p in batches[k][1]], self.quantise)
            counts = [len(batches[k][1]) for k in places]
            starts = (np.cumsum(counts) - counts).tolist()
            back = mavlink.from_channels_many(m, table, self.quantise)
            # trailing zeros of a payload are trimmed
            size = back.shape[1]
            lengths = (1 + mavlink.OVERHEAD + (np.where(back != 0, np.arange(1, size + 1), 0)).max(1)).tolist()
            data = back.tobytes()
            for k, start, n, pieces in zip(places, starts, counts, mavlink.pieces_many(m, table, starts, counts, self.mtu)):
                out[k] = pieces, lengths[start : start + n], data[start * size : (start + n) * size]
        return out

    def _plain(self, key: tuple, some: list) -> list[bytes]:
        return [bytes([mavlink.KIND_LIVE]) + mavlink.frame(key[1], payload, seq, key[0] & 255, 1) for seq, payload in some]

    def _bulk(self, key: tuple, some: list, pieces: list, lengths: list[int], data: bytes) -> list[bytes]:
        every, size = mavlink.MESSAGES[key[1]].live_every, len(data) // len(some)
        out = self._plain(key, [r for k, r in enumerate(some, self.taken) if k % every == 0]) if every else []
        for start, n, body in pieces:
            if body is not None and mavlink.BULK_HEADER.size + codec.HEADER.size + len(body) <= sum(lengths[start : start + n]):
                out.append(mavlink.BULK_HEADER.pack(mavlink.KIND_BULK, key[1], n, codec.HEADER.size + len(body)) + codec.framed(n, self.number, body))
                self.number += 1
            else:
                out += [bytes([mavlink.KIND_RAW]) + mavlink.frame(key[1], data[k * size : (k + 1) * size], some[k][0], key[0] & 255, 1) for k in range(start, start + n)]
        return out


def receive(packets: DataFrame, quantise: bool = True) -> DataFrame:
    """Messages of packets, in whatever order these come: every packet stands for itself."""

    def run(batches):
        for b in batches:
            rows = [(s, kind, m["msgid"], m["seq"], m["payload"]) for s, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for kind, m in mavlink.read_link(p, quantise)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()])], ["sysid", "kind", "msgid", "seq", "payload"])

    return packets.select("sysid", "packet").mapInArrow(run, MESSAGE_ROWS)
