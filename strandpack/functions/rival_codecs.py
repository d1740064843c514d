"""Byte kernels of published codecs on unsigned 32-bit values, and Sprintz on records."""

from __future__ import annotations

from typing import Protocol

import numpy as np

from strandpack.functions.codec import Bits, Corrupt, pack_fields, wrapped


class Codec(Protocol):
    """What the registry holds."""

    def encode(self, u: np.ndarray) -> bytes: ...
    def decode(self, data: bytes, n: int) -> np.ndarray: ...


def zigzag(d: np.ndarray) -> np.ndarray:
    d = d.astype(np.int64)
    return np.where(d < 0, -2 * d - 1, 2 * d).astype(np.uint32)


def unzigzag(u: np.ndarray) -> np.ndarray:
    u = u.astype(np.int64)
    return wrapped((u >> 1) ^ -(u & 1))


def delta_zigzag(v: np.ndarray) -> np.ndarray:
    return zigzag(wrapped(np.diff(np.concatenate([[0], np.asarray(v, np.int64)]))))


def undo_delta_zigzag(u: np.ndarray) -> np.ndarray:
    return wrapped(np.cumsum(unzigzag(u).astype(np.int64)))


def bit_widths(u: np.ndarray) -> np.ndarray:
    return np.frexp(u.astype(np.float64))[1].astype(np.int64)


class VByte:
    """Seven bits a byte, low groups first; the top bit says that more follow."""

    def encode(self, u):
        out = bytearray()
        for x in u.tolist():
            while x > 127:
                out.append(x & 127 | 128)
                x >>= 7
            out.append(x)
        return bytes(out)

    def read(self, data: bytes, n: int) -> tuple[np.ndarray, int]:
        out, at = [], 0
        for _ in range(n):
            x = shift = 0
            while True:
                if at >= len(data) or shift > 28:
                    raise Corrupt("truncated")
                x |= (data[at] & 127) << shift
                at, shift = at + 1, shift + 7
                if data[at - 1] < 128:
                    break
            out.append(x)
        return np.array(out, np.uint32), at

    def decode(self, data, n):
        return self.read(data, n)[0]


class StreamVByte:
    """Two bits a value tell its bytes; the lengths stand before all data."""

    def encode(self, u):
        sizes = np.maximum(1, -(-bit_widths(u) // 8))
        grid = u.astype("<u4").view(np.uint8).reshape(-1, 4)
        return pack_fields(sizes - 1, np.full(len(u), 2)) + grid[np.arange(4) < sizes[:, None]].tobytes()

    def decode(self, data, n):
        head = (n + 3) // 4
        sizes = np.array([(data[k >> 2] >> 2 * (k & 3) & 3) + 1 for k in range(n)] if len(data) >= head else [9], np.int64)
        if sizes.sum() + head > len(data):
            raise Corrupt("truncated")
        grid = np.zeros((n, 4), np.uint8)
        grid[np.arange(4) < sizes[:, None]] = np.frombuffer(data, np.uint8, int(sizes.sum()), head)
        return grid.view("<u4").reshape(-1).astype(np.uint32)


class Simple8b:
    """A selector and as many values as fit in 60 bits; the last word may be short."""

    # Fixed values: (values, bits) by selector.
    SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]

    def words(self, widths: list[int]):
        """(selector, start, values) of each word, greedily."""
        at, n = 0, len(widths)
        while at < n:
            for s, (count, bits) in enumerate(self.SELECTORS):
                if bits == 0 and n - at < count:
                    continue
                if max(widths[at : at + count]) <= bits:
                    break
            took = min(count, n - at)
            yield s, at, took
            at += took

    def size(self, u) -> int:
        return 8 * sum(1 for _ in self.words(bit_widths(u).tolist()))

    def encode(self, u):
        values, out = u.tolist(), []
        for s, at, took in self.words(bit_widths(u).tolist()):
            bits = self.SELECTORS[s][1]
            out.append(s << 60 | sum(x << k * bits for k, x in enumerate(values[at : at + took]) if bits))
        return np.array(out, "<u8").tobytes()

    def decode(self, data, n):
        out: list[int] = []
        if len(data) % 8:
            raise Corrupt("length")
        for word in np.frombuffer(data, "<u8").tolist():
            count, bits = self.SELECTORS[word >> 60]
            out += [word >> k * bits & (1 << bits) - 1 for k in range(min(count, n - len(out)))]
        if len(out) < n:
            raise Corrupt("truncated")
        return np.array(out, np.uint32)


class Tiled:
    """Tiles of 128 values in bits, the tail as VByte."""

    TILE = 128

    def encode(self, u):
        whole = len(u) // self.TILE * self.TILE
        fields = [self.tile(u[s : s + self.TILE]) for s in range(0, whole, self.TILE)]
        values, widths = (np.concatenate([np.asarray(f[k], np.int64) for f in fields]) if fields else np.zeros(0, np.int64) for k in (0, 1))
        return pack_fields(values, widths) + VByte().encode(u[whole:])

    def decode(self, data, n):
        bits, out = Bits(data), []
        for _ in range(n // self.TILE):
            out += self.read(bits)
        tail = VByte().decode(data[bits.bytes_read() :], n % self.TILE)
        return np.concatenate([np.array(out, np.uint32), tail])


class BP128(Tiled):
    def tile(self, u):
        b = int(bit_widths(u).max())
        return np.concatenate([[b], u]), np.concatenate([[8], np.full(len(u), b)])

    def read(self, bits):
        b = bits.take(8)
        if b > 32:
            raise Corrupt("width")
        return bits.many(self.TILE, b)


class OptPFD(Tiled):
    MOST = 127

    def tile(self, u):
        bw = bit_widths(u)
        costs = [(16 + self.TILE * b + e * (40 - b), b) for b in range(33) if (e := int((bw > b).sum())) <= self.MOST]
        b = min(costs)[1]
        odd = np.flatnonzero(bw > b)
        low = u.astype(np.int64) & ((1 << b) - 1)
        values = np.concatenate([[b, len(odd)], low, odd, u[odd].astype(np.int64) >> b])
        return values, np.concatenate([[8, 8], np.full(len(u), b), np.full(len(odd), 8), np.full(len(odd), 32 - b)])

    def read(self, bits):
        b, e = bits.take(8), bits.take(8)
        if b > 32:
            raise Corrupt("width")
        out = bits.many(self.TILE, b)
        places = bits.many(e, 8)
        for k, high in zip(places, bits.many(e, 32 - b)):
            if k >= self.TILE:
                raise Corrupt("place")
            out[k] |= high << b
        return out


#: The registry: family codecs by name.
CODECS: dict[str, Codec] = {"vbyte": VByte(), "svb": StreamVByte(), "simple8b": Simple8b(), "bp128": BP128(), "optpfd": OptPFD()}


def family_encode(codec: Codec, x: np.ndarray, channels: int) -> bytes:
    """Channels one by one behind a header of their sizes."""
    parts = [codec.encode(delta_zigzag(x[c::channels])) for c in range(channels)]
    return bytes([channels]) + np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def family_decode(codec: Codec, data: bytes, n: int) -> np.ndarray:
    k, out = data[0], np.zeros(n, np.int32)
    sizes, at = np.frombuffer(data, "<u4", k, 1).tolist(), 1 + 4 * k
    for c, size in enumerate(sizes):
        m = max(0, (n - c + k - 1) // k)
        out[c::k] = undo_delta_zigzag(codec.decode(data[at : at + size], m))
        at += size
    return out


RUN_MOST = 255


def sprintz_encode(x: np.ndarray, channels: int) -> bytes:
    """Blocks of eight records, a width for each channel; zero blocks in runs; the tail raw."""
    rec = np.asarray(x, np.int32).reshape(-1, channels)
    if not len(rec):
        return b""
    blocks = (len(rec) - 1) // 8
    u = zigzag(wrapped(np.diff(rec[: 1 + 8 * blocks].astype(np.int64), axis=0))).reshape(blocks, 8, channels)
    b = bit_widths(u.max(1)) if blocks else np.zeros((0, channels), np.int64)
    unsigned = lambda r: (r.astype(np.int64) & 0xFFFFFFFF).ravel().tolist()
    values, widths = unsigned(rec[0]), [32] * channels
    k = 0
    while k < blocks:
        run = 0
        while run < RUN_MOST and k + run < blocks and not b[k + run].any():
            run += 1
        if run:
            values += [1, run]
            widths += [1, 8]
            k += run
            continue
        values += [0, *b[k].tolist(), *u[k].T.ravel().tolist()]
        widths += [1, *[6] * channels, *np.repeat(b[k], 8).tolist()]
        k += 1
    tail = unsigned(rec[1 + 8 * blocks :])
    return pack_fields(np.array(values + tail, np.int64), np.array(widths + [32] * len(tail)))


def sprintz_decode(data: bytes, n: int, channels: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int32)
    bits, count = Bits(data), n // channels
    first = wrapped(np.array(bits.many(channels, 32), np.int64))
    rows, at = [first[None, :].astype(np.int64)], 1
    while at + 8 <= count:
        if bits.take(1):
            run = bits.take(8)
            if not run or at + 8 * run > count:
                raise Corrupt("run")
            rows.append(np.zeros((8 * run, channels), np.int64))
            at += 8 * run
            continue
        b = bits.many(channels, 6)
        rows.append(np.stack([unzigzag(np.array(bits.many(8, w), np.int64)) for w in b], 1).astype(np.int64))
        at += 8
    body = wrapped(np.cumsum(np.concatenate(rows), axis=0))
    tail = wrapped(np.array(bits.many((count - at) * channels, 32), np.int64)).reshape(-1, channels)
    return np.concatenate([body, tail]).ravel()
