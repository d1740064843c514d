"""Byte kernels: the native core, channel and frame layers, and lossless float streams.

An encoder lays its whole output out as (value, width) fields in numpy, block by block in
one array, and packs them to bits once; decoders walk the blocks. They run inside Arrow
functions on one frame or channel at a time and agree byte for byte with the sizes that
``operators.sizing`` computes relationally.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from strandpack.operators import sizing

MAGIC, VERSION, HEADER = 0xEB, 4, struct.Struct("<BBIHH")
MAX_CHANNELS, MAX_RECORDS = 255, 65535


class Corrupt(ValueError):
    """Bytes that no encoder wrote."""


# -- bits -----------------------------------------------------------------------------


def pack_fields(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Fields of 32 bits at most, one after the other, least significant bit first; width 0 takes no place."""
    values, widths = np.asarray(values, np.uint64).ravel(), np.asarray(widths, np.int64).ravel()
    used = widths > 0
    values, widths = values[used], widths[used]
    ends = np.cumsum(widths)
    total = int(ends[-1]) if len(ends) else 0
    start = ends - widths
    placed = (values & ((np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1))) << (start & 31).astype(np.uint64)
    # a field lies in two words of 32 bits; the sums have no carry and are exact in doubles
    word, most = start >> 5, (total >> 5) + 2
    words = np.bincount(word, placed & np.uint64(0xFFFFFFFF), most) + np.bincount(word + 1, placed >> np.uint64(32), most)
    return words.astype("<u4").tobytes()[: (total + 7) // 8]


class Bits:
    """Reads fields; what is beyond the data is corrupt."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def take(self, width: int) -> int:
        if width == 0:
            return 0
        stop = self.at + width
        if stop > self.end:
            raise Corrupt("truncated")
        raw = int.from_bytes(self.data[self.at >> 3 : (stop + 7) >> 3], "little") >> (self.at & 7)
        self.at = stop
        return raw & ((1 << width) - 1)

    def many(self, count: int, width: int) -> list[int]:
        raw, mask = self.take(count * width), (1 << width) - 1
        return [raw >> (k * width) & mask for k in range(count)]

    def bytes_read(self) -> int:
        return (self.at + 7) // 8


def wrapped(x) -> np.ndarray:
    return np.asarray(x, np.int64).astype(np.uint32).view(np.int32) if not isinstance(x, np.ndarray) else (x.astype(np.int64) & 0xFFFFFFFF).astype(np.uint32).view(np.int32)


def differences(v: np.ndarray) -> np.ndarray:
    return wrapped(np.diff(v.astype(np.int64)))


# -- core -----------------------------------------------------------------------------


def compressible(v: np.ndarray) -> bool:
    """The gate: a look at the first tenth for outliers, mean and largest difference."""
    n = len(v)
    if n < 2:
        return True
    sample = min(n // 10, sizing.GATE_SAMPLE)
    if sample < 10:
        sample = min(n, 100)
    d = differences(v[:sample])
    mag = np.abs(d)  # the least integer stays negative here
    share = np.float32(int((mag > sizing.OUTLIER).sum())) / np.float32(sample - 1)
    total = int(mag.sum(dtype=np.int64))
    mean = abs(total) // max(1, sample - 1) * (1 if total >= 0 else -1)
    limit = np.float32(sizing.GATE_SHARE)
    return not (share > limit or mean > sizing.GATE_MEAN or (int(mag.max(initial=0)) > sizing.GATE_LARGE and share > limit / np.float32(3)))


MODES = np.array([most for most, _ in sizing.WIDTHS[:-1]], np.int64)
MODE_BITS = np.array([bits for _, bits in sizing.WIDTHS], np.int64)


def core_encode(v: np.ndarray, referenced: bool = True) -> bytes | None:
    """Bytes of a stream; None if it is refused. Without ``referenced`` the first value is left out."""
    v = np.asarray(v, np.int32)
    n = len(v)
    if not compressible(v):
        return None
    head = v[:1].astype("<i4").tobytes() if referenced else b""
    if n < 2:
        return head
    d = differences(v)
    blocks = -(-len(d) // sizing.BLOCK)
    grid = np.zeros((blocks, sizing.BLOCK), np.int64)
    grid.ravel()[: len(d)] = d
    filled = np.zeros((blocks, sizing.BLOCK), bool)
    filled.ravel()[: len(d)] = True
    size = np.abs(grid)
    outlier = (size > sizing.OUTLIER) & filled
    inlier = filled & ~outlier
    mode = np.searchsorted(MODES, np.where(inlier, size, 0).max(1))
    width = MODE_BITS[mode]
    some = outlier.any(1)
    # slots of a block: tag, mask, inliers, outliers
    values = np.zeros((blocks, 2 + 2 * sizing.BLOCK), np.uint64)
    widths = np.zeros(values.shape, np.int64)
    values[:, 0], widths[:, 0] = mode << 1 | some, 4
    values[:, 1], widths[:, 1] = (outlier << np.arange(sizing.BLOCK)).sum(1), np.where(some, 8, 0)
    unsigned = (grid & 0xFFFFFFFF).astype(np.uint64)
    values[:, 2:10], widths[:, 2:10] = unsigned & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))[:, None], np.where(inlier, width[:, None], 0)
    values[:, 10:], widths[:, 10:] = unsigned, np.where(outlier, 32, 0)
    escaped = collapse(values, widths, filled.all(1) & (size.max(1) == 0))
    upto = np.minimum(1 + (np.arange(blocks) + 1) * sizing.BLOCK, n)
    look = np.flatnonzero(~escaped & (upto >= min(sizing.ABORT_AT, n)))
    if len(look) and upto[look[0]] < n:
        flushed = int(widths[: look[0] + 1].sum()) // 8 + len(head)
        if flushed and np.float32(int(upto[look[0]]) * 4) / np.float32(flushed) < np.float32(sizing.ABORT_RATIO):
            return None
    return head + pack_fields(values, widths)


def collapse(values: np.ndarray, widths: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Puts one escape in place of each long run of zero blocks; tells which blocks are in one."""
    escaped = np.zeros(len(zero), bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], zero.astype(np.int8), [0]])))
    for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
        for at in range(start, stop, sizing.RUN_MOST):
            run = min(sizing.RUN_MOST, stop - at)
            if run >= sizing.RUN_LEAST:
                escaped[at : at + run] = True
                widths[at : at + run] = 0
                values[at, :3], widths[at, :3] = (1, 0, run), (4, 8, 16)
    return escaped


def core_decode(data: bytes, n: int, first: int | None = None) -> tuple[np.ndarray, int]:
    """(values, bytes read); ``first`` is the value that an unreferenced stream starts from."""
    at = 0
    if first is None:
        if n and len(data) < 4:
            raise Corrupt("truncated")
        first, at = (struct.unpack_from("<i", data)[0], 4) if n else (0, 0)
    bits, out = Bits(data[at:]), []
    left = max(0, n - 1)
    while left:
        count = min(sizing.BLOCK, left)
        tag = bits.take(4)
        mask = bits.take(8) if tag & 1 else 0
        if tag == 1 and mask == 0:
            run = bits.take(16)
            if not run or run * sizing.BLOCK > left:
                raise Corrupt("a zero run of no or too many blocks")
            out.append(np.zeros(run * sizing.BLOCK, np.int64))
            left -= run * sizing.BLOCK
            continue
        if mask >> count:
            raise Corrupt("an outlier beyond the block")
        width = int(MODE_BITS[tag >> 1])
        block = np.zeros(count, np.int64)
        inside = [k for k in range(count) if not mask >> k & 1]
        if width:
            got = np.array(bits.many(len(inside), width), np.int64)
            block[inside] = got - ((got >> (width - 1)) << width)
        for k in range(count):
            if mask >> k & 1:
                block[k] = bits.take(32)
        out.append(block)
        left -= count
    d = np.concatenate([np.array([first] if n else [], np.int64), *out])
    return wrapped(np.cumsum(d)), at + bits.bytes_read()


# -- channels -------------------------------------------------------------------------


def second_is_better(v: np.ndarray) -> bool:
    if len(v) < 3:
        return False
    near = v[: sizing.ORDER_SAMPLE]
    d = differences(near)
    total = lambda x: int(np.abs(x.astype(np.int64)).sum())
    return total(differences(d)) < total(d)


def flags(channels: int, those: list[int]) -> bytes:
    return sum(1 << c for c in those).to_bytes((channels + 7) // 8, "little")


def channel_encode(x: np.ndarray, channels: int) -> bytes:
    """Interleaved values (ragged tails allowed) by channel: header, reference block, payloads."""
    x = np.asarray(x, np.int32)
    if not 1 <= channels <= MAX_CHANNELS:
        raise ValueError("1 to 255 channels")
    if not len(x):
        return b""
    first = np.zeros(channels, np.int32)
    first[: min(channels, len(x))] = x[:channels]
    block = core_encode(first) if channels >= 3 else None
    packed = block is not None and 0 < len(block) < 4 * channels
    body, second, raw = [block if packed else first.astype("<i4").tobytes()], [], []
    for c in range(min(channels, len(x))):
        v = x[c::channels]
        if second_is_better(v):
            second.append(c)
            rest = differences(v)
            got = core_encode(rest)
        else:
            rest = v[1:]
            got = core_encode(v, referenced=False)
        if got and len(got) < 4 * len(rest):
            body.append(got)
        else:
            raw.append(c)
            body.append(rest.astype("<i4").tobytes())
    return bytes([channels]) + flags(channels, second) + flags(channels, raw) + bytes([packed]) + b"".join(body)


def channel_decode(data: bytes, n: int, channels: int | None = None) -> np.ndarray:
    if not n:
        if data:
            raise Corrupt("bytes without values")
        return np.zeros(0, np.int32)
    if not data or not data[0] or (channels is not None and data[0] != channels):
        raise Corrupt("channel count")
    k, size = data[0], (data[0] + 7) // 8
    at = 2 + 2 * size
    if len(data) < at or data[at - 1] > 1:
        raise Corrupt("header")
    second, raw = (int.from_bytes(data[1 + s * size : 1 + (s + 1) * size], "little") for s in (0, 1))

    def plain(count: int) -> np.ndarray:
        nonlocal at
        if at + 4 * count > len(data):
            raise Corrupt("truncated")
        at += 4 * count
        return np.frombuffer(data, "<i4", count, at - 4 * count).astype(np.int32)

    if data[at - 1]:
        first, used = core_decode(data[at:], k)
        at += used
    else:
        first = plain(k)
    out = np.zeros(n, np.int32)
    for c in range(min(k, n)):
        m = (n - c + k - 1) // k
        if raw >> c & 1:
            rest = plain(m - 1)
            v = np.concatenate([first[c : c + 1].astype(np.int64), rest])
            out[c::k] = wrapped(np.cumsum(v)) if second >> c & 1 else wrapped(v)
        elif second >> c & 1:
            d, used = core_decode(data[at:], m - 1)
            at += used
            out[c::k] = wrapped(np.cumsum(np.concatenate([first[c : c + 1].astype(np.int64), d])))
        else:
            out[c::k], used = core_decode(data[at:], m, int(first[c]))
            at += used
    if at != len(data):
        raise Corrupt("bytes left over")
    return out


# -- frames ---------------------------------------------------------------------------


def frame_encode(x: np.ndarray, channels: int, seq: int) -> bytes:
    """One independently decodable frame of whole records."""
    count, rest = divmod(len(x), channels)
    if rest or count > MAX_RECORDS:
        raise ValueError("whole records, 65535 at most")
    return framed(count, seq, channel_encode(x, channels))


def frame_header(data: bytes) -> tuple[int, int]:
    """(sequence number, records) of a sound frame."""
    if len(data) < HEADER.size:
        raise Corrupt("too short")
    magic, version, crc, seq, count = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION or crc != zlib.crc32(data[6:]):
        raise Corrupt("not a sound frame")
    return seq, count


def frame_decode(data: bytes, channels: int) -> tuple[int, np.ndarray]:
    seq, count = frame_header(data)
    try:
        return seq, channel_decode(data[HEADER.size :], count * channels, channels)
    except (IndexError, struct.error) as e:
        raise Corrupt(str(e)) from e


# -- many frames at once --------------------------------------------------------------

#: Blocks laid out at once; fewer frames of one length than this are coded one by one.
BLOCKS_AT_ONCE, FEW = 1 << 15, 3


def core_encode_many(v: np.ndarray, referenced: bool) -> list[bytes | None]:
    """``core_encode`` of each row of ``v``."""
    rows, n = v.shape
    if n < 2:
        return [r.astype("<i4").tobytes() if referenced else b"" for r in v]
    blocks = -(-(n - 1) // sizing.BLOCK)
    step = max(1, BLOCKS_AT_ONCE // blocks)
    if rows > step:
        return [x for s in range(0, rows, step) for x in core_encode_many(v[s : s + step], referenced)]
    d = wrapped(np.diff(v.astype(np.int64), axis=1)).astype(np.int64)
    sample = min(n // 10, sizing.GATE_SAMPLE)
    if sample < 10:
        sample = min(n, 100)
    mag = np.abs(d[:, : sample - 1].astype(np.int32))
    share = (mag > sizing.OUTLIER).sum(1).astype(np.float32) / np.float32(sample - 1)
    added = mag.sum(1, dtype=np.int64)
    mean = np.abs(added) // max(1, sample - 1) * np.where(added >= 0, 1, -1)
    limit = np.float32(sizing.GATE_SHARE)
    refused = (share > limit) | (mean > sizing.GATE_MEAN) | ((mag.max(1) > sizing.GATE_LARGE) & (share > limit / np.float32(3)))
    grid = np.zeros((rows, blocks * sizing.BLOCK), np.int64)
    grid[:, : n - 1] = d
    grid = grid.reshape(rows, blocks, sizing.BLOCK)
    filled = (np.arange(blocks * sizing.BLOCK) < n - 1).reshape(blocks, sizing.BLOCK)
    size = np.abs(grid)
    outlier = size > sizing.OUTLIER
    mode = np.searchsorted(MODES, np.where(outlier, 0, size).max(2))
    width = MODE_BITS[mode]
    some = outlier.any(2)
    unsigned = (grid & 0xFFFFFFFF).astype(np.uint64)
    # a field for the first value, slots of each block as in core_encode, then bits to the next byte
    values = np.zeros((rows, 2 + blocks * 18), np.uint64)
    widths = np.zeros(values.shape, np.int64)
    slots = np.empty((rows, blocks, 18), np.uint64)
    wide = np.empty((rows, blocks, 18), np.int64)
    slots[:, :, 0], wide[:, :, 0] = mode << 1 | some, 4
    slots[:, :, 1], wide[:, :, 1] = (outlier << np.arange(sizing.BLOCK)).sum(2), np.where(some, 8, 0)
    slots[:, :, 2:10], wide[:, :, 2:10] = unsigned, np.where(filled & ~outlier, width[:, :, None], 0)
    slots[:, :, 10:], wide[:, :, 10:] = unsigned, np.where(outlier, 32, 0)
    values[:, 1:-1], widths[:, 1:-1] = slots.reshape(rows, -1), wide.reshape(rows, -1)
    if referenced:
        values[:, 0], widths[:, 0] = v[:, 0].astype(np.int64) & 0xFFFFFFFF, 32
    # a run of zero blocks long enough to be collapsed is left to the encoder of one row
    alone = ((size.max(2) == 0) & filled.all(1)).sum(1) >= sizing.RUN_LEAST
    upto = np.minimum(1 + (np.arange(blocks) + 1) * sizing.BLOCK, n)
    look = int(np.flatnonzero(upto >= min(sizing.ABORT_AT, n))[0])
    if upto[look] < n:
        flushed = wide[:, : look + 1].sum((1, 2)) // 8 + (4 if referenced else 0)
        refused |= np.float32(int(upto[look]) * 4) / np.maximum(flushed, 1).astype(np.float32) < np.float32(sizing.ABORT_RATIO)
    widths[refused | alone] = 0
    widths[:, -1] = -widths.sum(1) % 8
    data, ends = pack_fields(values, widths), np.cumsum(widths.sum(1) // 8).tolist()
    out: list[bytes | None] = [data[a:b] for a, b in zip([0, *ends], ends)]
    for r in np.flatnonzero(refused | alone).tolist():
        out[r] = core_encode(v[r], referenced) if alone[r] else None
    return out


def channel_encode_many(x: np.ndarray) -> list[bytes]:
    """``channel_encode`` of each of the frames of one length in ``x`` (frame, channel, record)."""
    x = np.ascontiguousarray(x, np.int32)
    frames, channels, n = x.shape
    if not 1 <= channels <= MAX_CHANNELS:
        raise ValueError("1 to 255 channels")
    if not n:
        return [b""] * frames
    first = np.ascontiguousarray(x[:, :, 0])
    packed = core_encode_many(first, True) if channels >= 3 else [None] * frames
    v = x.reshape(frames * channels, n)
    d = wrapped(np.diff(v.astype(np.int64), axis=1))
    near = np.abs(d[:, : sizing.ORDER_SAMPLE - 1].astype(np.int64))
    second = np.zeros(len(v), bool)
    if n >= 3:
        second = np.abs(wrapped(np.diff(d[:, : sizing.ORDER_SAMPLE - 1].astype(np.int64), axis=1)).astype(np.int64)).sum(1) < near.sum(1)
    body: list[bytes | None] = [None] * len(v)
    for which, rows in ((second, d), (~second, v)):
        at = np.flatnonzero(which)
        if len(at):
            for r, got in zip(at.tolist(), core_encode_many(rows[at], rows is d)):
                body[r] = got if got and len(got) < 4 * (n - 1) else None
    raw = [b is None for b in body]
    for r in np.flatnonzero(raw).tolist():
        body[r] = (d[r] if second[r] else v[r, 1:]).astype("<i4").tobytes()
    of = (channels + 7) // 8
    bits = lambda m: np.packbits(np.asarray(m, bool).reshape(frames, channels), axis=1, bitorder="little").tobytes()
    seconds, raws, plain, out = bits(second), bits(raw), first.astype("<i4").tobytes(), []
    for f in range(frames):
        block = packed[f]
        short = block is not None and 0 < len(block) < 4 * channels
        out.append(b"".join([bytes([channels]), seconds[f * of : (f + 1) * of], raws[f * of : (f + 1) * of], b"\1" if short else b"\0", block if short else plain[4 * channels * f : 4 * channels * (f + 1)], *body[f * channels : (f + 1) * channels]]))
    return out


def framed(count: int, seq: int, body: bytes) -> bytes:
    tail = struct.pack("<HH", seq & 0xFFFF, count) + body
    return struct.pack("<BBI", MAGIC, VERSION, zlib.crc32(tail)) + tail


def by_length(counts: np.ndarray):
    """(length, places) of each length that occurs."""
    order = np.argsort(counts, kind="stable")
    cuts = np.flatnonzero(np.diff(counts[order])) + 1
    return ((int(counts[p[0]]), p) for p in np.split(order, cuts) if len(p))


def bodies_of(cut, counts: np.ndarray, channels: int) -> list[bytes]:
    """The channel layer of frames of ``counts`` records; ``cut(places, n)`` gives those of n records as (frame, channel, record)."""
    if len(counts) and counts.max() > MAX_RECORDS:
        raise ValueError("whole records, 65535 at most")
    out: list[bytes] = [b""] * len(counts)
    for n, at in by_length(counts):
        step = max(1, (1 << 19) // max(1, n * channels))
        for s in range(0, len(at), step):
            some = at[s : s + step]
            for r, data in zip(some.tolist(), channel_encode_many(cut(some, n))):
                out[r] = data
    return out


def bodies(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, channels: int) -> list[bytes]:
    """As ``bodies_of``, of frames whose values, channel after channel, begin at ``starts``."""
    return bodies_of(lambda some, n: flat[starts[some][:, None] + np.arange(n * channels)].reshape(len(some), channels, n), counts, channels)


class _Lockstep:
    """Frames of one length decoded side by side; ``sound`` tells those that took the plain course so far."""

    def __init__(self, datas: list[bytes]):
        joined = b"".join(datas) + bytes(16)
        self.last = len(joined) - 8
        self.words = np.ndarray((self.last + 1,), "<u8", joined, 0, (1,))
        sizes = np.fromiter(map(len, datas), np.int64, len(datas))
        self.end = np.cumsum(sizes)
        self.at = self.end - sizes
        self.sound = np.ones(len(datas), bool)

    def take(self, bit: np.ndarray, width: np.ndarray) -> np.ndarray:
        raw = self.words[np.minimum(bit >> 3, self.last)] >> (bit & 7).astype(np.uint64)
        return (raw & ((np.uint64(1) << np.asarray(width).astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    def plain(self, rows: np.ndarray, count: int) -> np.ndarray:
        got = self.take(8 * self.at[rows][:, None] + 32 * np.arange(count), np.int64(32))
        self.at[rows] += 4 * count
        return got

    def core(self, rows: np.ndarray, count: int) -> np.ndarray:
        """``count`` differences of each of ``rows``."""
        out, bit = np.zeros((len(rows), count), np.int64), 8 * self.at[rows]
        for s in range(0, count, sizing.BLOCK):
            size = min(sizing.BLOCK, count - s)
            tag = self.take(bit, np.int64(4))
            mask = np.where(tag & 1, self.take(bit + 4, np.int64(8)), 0)
            # escapes and masks beyond the block are left to the decoder of one frame
            self.sound[rows] &= ~(((tag & 1) == 1) & (mask == 0)) & (mask >> size == 0)
            bit = bit + np.where(tag & 1, 12, 4)
            width = MODE_BITS[tag >> 1][:, None]
            far = (mask[:, None] >> np.arange(size) & 1) == 1
            outs = np.cumsum(far, 1)
            ins = np.arange(1, size + 1) - outs
            inside = ins[:, -1:] * width
            got = self.take(bit[:, None] + np.where(far, inside + 32 * (outs - 1), (ins - 1) * width), np.where(far, 32, width))
            sign = np.where(far | (width == 0), 0, got >> np.maximum(width - 1, 0))
            out[:, s : s + size] = got - (sign << width)
            bit = np.minimum(bit + inside[:, 0] + 32 * outs[:, -1], 8 * self.last)
        self.at[rows] = (bit + 7) >> 3
        return out


def frames_decode(datas: list[bytes], channels: int) -> list[np.ndarray | None]:
    """Values (records by channels) of each frame, as ``frame_decode`` gives them; None for corrupt frames."""
    out: list[np.ndarray | None] = [None] * len(datas)

    def alone(i: int) -> None:
        try:
            out[i] = frame_decode(datas[i], channels)[1].reshape(-1, channels)
        except Corrupt:
            pass

    counts, size = np.full(len(datas), -1), (channels + 7) // 8
    for i, data in enumerate(datas):
        try:
            counts[i] = frame_header(data)[1]
        except Corrupt:
            continue
    for n, at in by_length(counts):
        if n < 0:
            continue
        # what is not of the plain form, and lengths of few frames, is decoded one by one
        usual = [i for i in at.tolist() if n and len(datas[i]) >= HEADER.size + 2 + 2 * size and datas[i][HEADER.size] == channels and datas[i][HEADER.size + 1 + 2 * size] <= 1] if len(at) > FEW else []
        for i in set(at.tolist()) - set(usual):
            alone(i)
        step = max(1, (1 << 19) // max(1, n * channels))
        for s in range(0, len(usual), step):
            some = usual[s : s + step]
            got, sound = _channels_decode([datas[i][HEADER.size :] for i in some], n, channels)
            for k, i in enumerate(some):
                if sound[k]:
                    out[i] = got[k]
                else:
                    alone(i)
    return out


def _channels_decode(datas: list[bytes], n: int, channels: int) -> tuple[np.ndarray, np.ndarray]:
    """(frame, record, channel) and whether each frame was of the plain form to its end."""
    size, steps, every = (channels + 7) // 8, _Lockstep(datas), np.arange(len(datas))
    heads = np.frombuffer(b"".join(d[: 2 + 2 * size] for d in datas), np.uint8).reshape(len(datas), -1)
    flag = lambda s: np.unpackbits(heads[:, 1 + s * size : 1 + (s + 1) * size], axis=1, bitorder="little")[:, :channels] == 1
    second, raw, packed = flag(0), flag(1), heads[:, -1] == 1
    steps.at += 2 + 2 * size
    first = np.zeros((len(datas), channels), np.int64)
    rows = every[packed]
    if len(rows):
        first[rows, :1] = steps.plain(rows, 1)
        first[rows, 1:] = steps.core(rows, channels - 1)
        first[rows] = np.cumsum(first[rows], 1)
    rows = every[~packed]
    first[rows] = steps.plain(rows, channels)
    out = np.zeros((len(datas), n, channels), np.int32)
    for c in range(channels):
        start = first[:, c : c + 1]
        for kind, twice in ((raw[:, c] & ~second[:, c], 0), (raw[:, c] & second[:, c], 1), (~raw[:, c] & ~second[:, c], 1), (~raw[:, c] & second[:, c], 2)):
            rows = every[kind]
            if not len(rows):
                continue
            if raw[rows[0], c]:
                rest = steps.plain(rows, n - 1)
            elif twice == 1:
                rest = steps.core(rows, n - 1)
            elif n < 2:
                rest = np.zeros((len(rows), 0), np.int64)
            else:
                rest = np.cumsum(np.concatenate([steps.plain(rows, 1), steps.core(rows, n - 2)], 1), 1)
            got = np.concatenate([start[rows], rest], 1)
            out[rows, :, c] = wrapped(np.cumsum(got, 1) if twice else got)
    return out, steps.sound & (steps.at == steps.end)


# -- lossless floats ------------------------------------------------------------------


def xor_fields(patterns: list[int]) -> tuple[list[int], list[int]]:
    """Each value against the one before; the window of significant bits is carried on while it suffices."""
    values, widths = [patterns[0]], [32]
    lead = trail = 32
    for before, now in zip(patterns, patterns[1:]):
        x = before ^ now
        if not x:
            values.append(0)
            widths.append(1)
            continue
        own_lead, own_trail = 32 - x.bit_length(), (x & -x).bit_length() - 1
        if own_lead >= lead and own_trail >= trail:
            values += [1, x >> trail]
            widths += [2, 32 - lead - trail]
        else:
            lead, trail = own_lead, own_trail
            values += [3, lead, 31 - lead - trail, x >> trail]
            widths += [2, 5, 5, 32 - lead - trail]
    return values, widths


def xor_encode(x: np.ndarray) -> bytes:
    patterns = np.asarray(x, np.float32).view(np.uint32).tolist()
    return pack_fields(*map(np.array, xor_fields(patterns))) if patterns else b""


def xor_decode(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.float32)
    bits = Bits(data)
    out = [bits.take(32)]
    lead = trail = 32
    for _ in range(n - 1):
        x = 0
        if bits.take(1):
            if bits.take(1):
                lead, length = bits.take(5), bits.take(5) + 1
                trail = 32 - lead - length
            if trail < 0 or lead + trail >= 32:
                raise Corrupt("window")
            x = bits.take(32 - lead - trail) << trail
        out.append(out[-1] ^ x)
    return np.array(out, np.uint32).view(np.float32)


def xor_channels_encode(x: np.ndarray, channels: int) -> bytes:
    x = np.asarray(x, np.float32)
    if not len(x):
        return b""
    sizes, raw, body = np.zeros(channels, "<i4"), [], []
    for c in range(min(channels, len(x))):
        v = x[c::channels]
        got = xor_encode(v)
        if len(got) >= 4 * len(v):
            raw.append(c)
            got = v.astype("<f4").tobytes()
        sizes[c] = len(got)
        body.append(got)
    return bytes([channels, (channels + 7) // 8]) + flags(channels, raw) + sizes.tobytes() + b"".join(body)


def xor_channels_decode(data: bytes, n: int) -> np.ndarray:
    out = np.zeros(n, np.float32)
    if not n:
        return out
    if len(data) < 2 or not data[0] or data[1] != (data[0] + 7) // 8 or len(data) < 2 + data[1] + 4 * data[0]:
        raise Corrupt("header")
    k, at = data[0], 2 + data[1] + 4 * data[0]
    raw, sizes = int.from_bytes(data[2 : 2 + data[1]], "little"), np.frombuffer(data, "<i4", k, 2 + data[1])
    for c in range(min(k, n)):
        m, piece = (n - c + k - 1) // k, data[at : at + int(sizes[c])]
        if sizes[c] < 0 or len(piece) != sizes[c] or (raw >> c & 1 and len(piece) != 4 * m):
            raise Corrupt("size")
        out[c::k] = np.frombuffer(piece, "<f4") if raw >> c & 1 else xor_decode(piece, m)
        at += len(piece)
    return out
