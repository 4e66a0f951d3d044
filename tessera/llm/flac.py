"""Media columns: a FLAC codec in numpy, and DataFrame operators on FLAC columns.

Encoding and decoding run on all frames of a batch at once: a numpy lane is one
frame, and a step of the loop is one sample (Rice codes depend on each other
within a frame only). Every frame has a seek point, so frames are found without
decoding their predecessors, and any sample can be reached by its offset.

``encode_batch`` writes constant, verbatim, fixed and linear predictors, whichever
is shortest. ``decode_batch`` is the fast path: one channel of 8 bits, frames of 192
samples with a seek point each, fixed predictors and linear ones of any order, one
Rice partition. ``decode_stream`` reads any FLAC stream of up to 8 channels one
frame after the other: both Rice codings with partitions and escapes, wasted bits
and the three stereo modes; ``pcm_blocks`` takes it for what the fast path does not read.

Null and empty payloads are encoded as their padding, whole texts of any length;
equal payloads give equal streams, so repeated rows give equal values, each for
itself. Columns other than the named ones are not read, whatever their names. An
empty table gives no rows. A damaged stream raises ``FlacError``; nothing is skipped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, utf8

BLOCK = 192  # samples a frame; the format's block size code 1
RATE = 8000
PAD = 32
HEAD = 8 + 34  # "fLaC", block header, STREAMINFO
LANES = 4096  # frames that are coded together
ORDER = 4  # of the linear predictors that are written
PRECISION = 8  # bits of their coefficients


class FlacError(ValueError):
    """The stored bytes are not the stream they claim to be."""


def _crc_table(poly: int, bits: int, width: int) -> np.ndarray:
    """CRC of every width-bit message, for a CRC of the given bits."""
    reg = np.arange(1 << width, dtype=np.uint32) << max(0, bits - width)
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    for _ in range(width):
        reg = np.where(reg & top, (reg << 1) ^ poly, reg << 1) & mask
    return reg


CRC8 = _crc_table(0x07, 8, 8).astype(np.uint8)
CRC16 = _crc_table(0x8005, 16, 16).astype(np.uint16)  # two bytes a step


def crc8(rows: np.ndarray) -> np.ndarray:
    """CRC-8 of each row; zeros in front change nothing."""
    crc = np.zeros(len(rows), np.uint8)
    for j in range(rows.shape[1]):
        crc = CRC8[crc ^ rows[:, j]]
    return crc


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of an even number of bytes; zeros in front change nothing."""
    words = np.ascontiguousarray(rows).view(">u2").astype(np.uint16)
    crc = np.zeros(len(rows), np.uint16)
    for column in np.ascontiguousarray(words.T):
        crc = CRC16[crc ^ column]
    return crc


def _right_aligned(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows buf[start:start+length], with zeros in front to an even common length."""
    width = int(length.max()) + 1 & ~1
    at = (start + length)[:, None] - np.arange(width, 0, -1)[None, :]
    rows = buf[np.maximum(at, 0)]
    rows[at < start[:, None]] = 0
    return rows


def _frame_number(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's extended UTF-8: rows of 6 bytes, and their lengths."""
    n = number.astype(np.int64)
    size = 1 + (n >= 1 << 7).astype(int) + (n >= 1 << 11) + (n >= 1 << 16) + (n >= 1 << 21) + (n >= 1 << 26)
    out = np.zeros((len(n), 6), np.uint8)
    for s in range(1, 7):
        rows = np.flatnonzero(size == s)
        if not len(rows):
            continue
        if s == 1:
            out[rows, 0] = n[rows]
            continue
        lead = (0xFF << (7 - s)) & 0xFF
        out[rows, 0] = lead | (n[rows] >> (6 * (s - 1)))
        for j in range(1, s):
            out[rows, j] = 0x80 | ((n[rows] >> (6 * (s - 1 - j))) & 0x3F)
    return out, size


def _linear_predictors(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (n, ORDER) and shifts of each row's linear predictor: autocorrelation of the windowed row, Levinson-Durbin on all rows at once."""
    window = 1 - ((2 * np.arange(BLOCK) - (BLOCK - 1)) / (BLOCK + 1)) ** 2
    x = samples * window
    lag = np.stack([(x[:, : BLOCK - i] * x[:, i:]).sum(axis=1) for i in range(ORDER + 1)], axis=1)
    error = lag[:, 0] * (1 + 1e-9) + 1e-9
    a = np.zeros((len(x), ORDER))
    for i in range(ORDER):
        reflect = (lag[:, i + 1] - (a[:, :i] * lag[:, i:0:-1]).sum(axis=1)) / error
        new = a.copy()
        new[:, i] = reflect
        new[:, :i] = a[:, :i] - reflect[:, None] * a[:, :i][:, ::-1]
        a, error = new, np.maximum(error * (1 - reflect**2), 1e-9)
    top = np.maximum(np.abs(a).max(axis=1), 1e-9)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(top)), 0, 14).astype(np.int64)
    limit = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit - 1).astype(np.int64), shift


def _zigzag(r: np.ndarray) -> np.ndarray:
    return np.where(r >= 0, 2 * r, -2 * r - 1)


def _rice(code: np.ndarray, coded: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A Rice parameter for each row by the mean of its codes, and the bits of each code."""
    k = np.clip(np.floor(np.log2(np.maximum(mean, 1) * 0.6931) + 0.5), 0, 14).astype(np.int64)
    return k, np.where(coded, (code >> k[:, None]) + 1 + k[:, None], 0)


def _encode_frames(samples: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of int16 rows of BLOCK samples: all bytes on end, and each frame's length. Of fixed and linear predictors the shorter is taken."""
    n = len(samples)
    residuals = [samples, np.diff(samples, axis=1), np.diff(samples, 2, axis=1)]
    cost = np.stack([np.abs(r).sum(axis=1, dtype=np.int64) for r in residuals], axis=1)
    order = cost.argmin(axis=1)
    constant = (samples == samples[:, :1]).all(axis=1)
    order[constant] = 0
    mean = cost[np.arange(n), order] * 2 / (BLOCK - order)
    code = np.zeros((n, BLOCK), np.int64)  # zigzag residuals; the warm-up samples' columns stay unused
    for o, r in enumerate(residuals):
        rows = np.flatnonzero(order == o)
        code[rows, o:] = _zigzag(r[rows].astype(np.int64))
    column = np.arange(BLOCK)[None, :]
    coded = column >= order[:, None]
    k, bits = _rice(code, coded, mean)
    bits[constant] = 0
    total = bits.sum(axis=1)
    extra = np.zeros(n, np.int64)  # bits of a linear predictor's description
    coefficient, shift = _linear_predictors(samples)
    wide = samples.astype(np.int64)
    guess = sum(coefficient[:, i : i + 1] * wide[:, ORDER - 1 - i : BLOCK - 1 - i] for i in range(ORDER)) >> shift[:, None]
    own = np.zeros((n, BLOCK), np.int64)
    own[:, ORDER:] = _zigzag(wide[:, ORDER:] - guess)
    own_k, own_bits = _rice(own, np.broadcast_to(column >= ORDER, own.shape), own.sum(axis=1) / (BLOCK - ORDER))
    described = 9 + ORDER * PRECISION
    linear = ~constant & (own_bits.sum(axis=1) + described + 8 * ORDER < total + 8 * order)
    code[linear], k[linear], bits[linear], order[linear], extra[linear] = own[linear], own_k[linear], own_bits[linear], ORDER, described
    coded = column >= order[:, None]
    quotient = code >> k[:, None]
    total = bits.sum(axis=1) + extra
    verbatim = ~constant & (total + 10 + 8 * order > 8 * BLOCK)
    digits, width = _frame_number(number)
    head = 5 + width
    body = 1 + np.where(constant, 1, np.where(verbatim, BLOCK, order + (10 + total + 7) // 8))
    length = head + body + 2
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    buf = np.zeros(int(length.sum()), np.uint8)
    for j, value in enumerate((0xFF, 0xF8, 0x14, 0x02)):  # sync and fixed blocks; 192 samples at 8 kHz; mono, 8 bits
        buf[start + j] = value
    for j in range(6):
        rows = np.flatnonzero(width > j)
        buf[start[rows] + 4 + j] = digits[rows, j]
    buf[start + head - 1] = crc8(_right_aligned(buf, start, head - 1))
    at = start + head
    buf[at] = np.where(constant, 0, np.where(verbatim, 2, np.where(linear, (32 | ORDER - 1) << 1, (8 | order) << 1)))
    unsigned = samples.astype(np.int8).view(np.uint8)
    buf[at[constant] + 1] = unsigned[constant, 0]
    rows = np.flatnonzero(verbatim)
    buf[at[rows, None] + 1 + np.arange(BLOCK)] = unsigned[rows]
    rice = np.flatnonzero(~constant & ~verbatim)
    for j in range(max(2, ORDER)):
        rows = rice[order[rice] > j]
        buf[at[rows] + 1 + j] = unsigned[rows, j]
    if len(rice):
        # fields of at most 16 bits, by place, width and value: a predictor's description, the Rice parameter (method and partition order are zero bits), the codes
        base = (at + 1 + order)[rice] * 8
        mine = linear[rice]
        lpc, place = rice[mine], base[mine]
        fields = [(place, 4, np.full(len(lpc), PRECISION - 1)), (place + 4, 5, shift[lpc])]
        fields += [(place + 9 + i * PRECISION, PRECISION, coefficient[lpc, i] & (1 << PRECISION) - 1) for i in range(ORDER)]
        base = base + extra[rice]
        fields.append((base + 6, 4, k[rice]))
        b, q, c, u = bits[rice], quotient[rice], code[rice], coded[rice]
        pos = base[:, None] + 10 + np.cumsum(b, axis=1) - b + q
        kk = np.broadcast_to(k[rice][:, None], pos.shape)
        low = (c & ((1 << kk) - 1)) | (1 << kk)
        pos = np.concatenate([pos[u], *(f[0] for f in fields)])
        bit_count = np.concatenate([kk[u] + 1, *(np.full(len(f[0]), f[1]) for f in fields)])
        low = np.concatenate([low[u], *(f[2] for f in fields)])
        value = low << (24 - (pos & 7) - bit_count)
        origin = int(pos.min() >> 3)
        byte = (pos >> 3) - origin
        size = len(buf) - origin + 3
        part = np.bincount(byte, value >> 16, size)
        part += np.bincount(byte + 1, (value >> 8) & 255, size)
        part += np.bincount(byte + 2, value & 255, size)
        buf[origin:] |= part[: len(buf) - origin].astype(np.uint8)
    crc = crc16(_right_aligned(buf, start, length - 2))
    buf[start + length - 2] = crc >> 8
    buf[start + length - 1] = crc & 255
    return buf, length


def padded(raw: bytes, multiple: int = BLOCK) -> bytes:
    """raw with bytes 32 appended up to a positive multiple."""
    return raw + bytes([PAD]) * ((-len(raw)) % multiple if raw else multiple)


def encode_batch(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose length is a positive multiple of BLOCK; byte b is sample b - 128."""
    if not payloads:
        return []
    counts = np.array([len(p) // BLOCK for p in payloads])
    pcm = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8)
    samples = pcm.reshape(-1, BLOCK)
    ends = np.cumsum(counts)
    number = np.arange(len(samples)) - np.repeat(ends - counts, counts)
    parts, sizes = [], []
    for i in range(0, len(samples), LANES):
        buf, length = _encode_frames(samples[i : i + LANES].astype(np.int16), number[i : i + LANES])
        parts.append(buf)
        sizes.append(length)
    data, length = np.concatenate(parts).tobytes(), np.concatenate(sizes)
    offset = np.concatenate([[0], np.cumsum(length)])
    out = []
    for i, end in enumerate(ends):
        a, b = int(end - counts[i]), int(end)
        frames = int(counts[i])
        packed = (RATE << 44) | (0 << 41) | (7 << 36) | (frames * BLOCK)
        info = BLOCK.to_bytes(2, "big") * 2 + int(length[a:b].min()).to_bytes(3, "big") + int(length[a:b].max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(pcm[a * BLOCK : b * BLOCK].tobytes()).digest()
        points = np.zeros(frames, [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
        points["sample"] = np.arange(frames) * BLOCK
        points["offset"] = offset[a:b] - offset[a]
        points["count"] = BLOCK
        seek = points.tobytes()
        # a block length has 24 bits: longer tables stand in several blocks
        blocks, room = [], (1 << 24) // 18 * 18 - 18
        for s in range(0, len(seek), room):
            piece = seek[s : s + room]
            last = 0x80 if s + room >= len(seek) else 0
            blocks.append(bytes([last | 3]) + len(piece).to_bytes(3, "big") + piece)
        out.append(b"fLaC\0\0\0\x22" + info + b"".join(blocks) + data[int(offset[a]) : int(offset[b])])
    return out


def _metadata(stream: bytes) -> tuple[dict, int]:
    """STREAMINFO and seek points of a stream, and the offset of its first frame."""
    if stream[:4] != b"fLaC":
        raise FlacError("no fLaC marker")
    at, last, info, seek = 4, False, None, []
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if len(body) < size:
            raise FlacError("a metadata block is cut off")
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"block": int.from_bytes(body[:2], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "total": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            seek.append(np.frombuffer(body, [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
        at += 4 + size
    if info is None:
        raise FlacError("no STREAMINFO")
    info["seek"] = np.concatenate(seek) if seek else np.zeros(0, [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
    return info, at


def _words(buf: np.ndarray) -> np.ndarray:
    """The big-endian 64-bit word that starts at each byte."""
    n = len(buf)
    padded_buf = np.concatenate([buf, np.zeros(16, np.uint8)])
    out = np.zeros(n + 8, np.uint64)
    for j in range(8):
        out |= padded_buf[j : j + n + 8].astype(np.uint64) << np.uint64(56 - 8 * j)
    return out


def _decode_frames(buf: np.ndarray, start: np.ndarray, length: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Samples (int8 rows) of frames at known places; checks sync, number, CRC-8 and CRC-16."""
    stored = buf[start + length - 2].astype(np.uint16) << 8 | buf[start + length - 1]
    if (crc16(_right_aligned(buf, start, length - 2)) != stored).any():
        raise FlacError("a frame's CRC-16 does not match")
    digits, width = _frame_number(number)
    head = 5 + width
    good = (buf[start] == 0xFF) & (buf[start + 1] == 0xF8) & (buf[start + 2] == 0x14) & (buf[start + 3] == 0x02)
    for j in range(6):
        rows = np.flatnonzero(width > j)
        good[rows] &= buf[start[rows] + 4 + j] == digits[rows, j]
    if not good.all():
        raise FlacError("a frame header is not the expected one")
    if (crc8(_right_aligned(buf, start, head - 1)) != buf[start + head - 1]).any():
        raise FlacError("a frame header's CRC-8 does not match")
    at = start + head
    kind = buf[at] >> 1
    out = np.zeros((len(start), BLOCK), np.int8)
    signed = buf.view(np.int8)
    rows = np.flatnonzero(kind == 0)
    out[rows] = signed[at[rows] + 1][:, None]
    rows = np.flatnonzero(kind == 1)
    out[rows] = signed[at[rows, None] + 1 + np.arange(BLOCK)]
    rice = np.flatnonzero((kind & 0x38) == 8)
    linear = np.flatnonzero((kind & 0x20) == 0x20)
    if len(rice) + len(linear) + (kind < 2).sum() != len(kind) or (kind[rice] & 7 > 4).any():
        raise FlacError("a subframe kind that this path does not read")
    if len(rice) + len(linear):
        lpc = np.concatenate([np.zeros(len(rice), bool), np.ones(len(linear), bool)])
        rice = np.concatenate([rice, linear])
        order = np.where(lpc, (kind[rice] & 31) + 1, kind[rice] & 7).astype(np.int64)
        words = _words(buf)

        def field(place: np.ndarray, count) -> np.ndarray:
            """Bits at places, at most 32."""
            place = np.minimum(place, 8 * len(words) - 8)
            return ((words[place >> 3] << (place & 7).astype(np.uint64)) >> (64 - np.asarray(count)).astype(np.uint64)).astype(np.int64)

        p = (at[rice] + 1 + order) * 8
        described = np.flatnonzero(lpc)
        coefficient, shift = np.zeros((len(described), 32), np.int64), np.zeros(len(described), np.int64)
        if len(described):
            precision = field(p[described], 4) + 1
            shift = field(p[described] + 4, 5)
            if (precision == 16).any() or (shift >= 16).any():
                raise FlacError("a predictor that this path does not read")
            for i in range(int(order[described].max())):
                c = field(p[described] + 9 + i * precision, precision)
                c = c - ((c >> precision - 1) << precision)
                coefficient[:, i] = np.where(i < order[described], c, 0)
            p[described] += 9 + order[described] * precision
        first = field(p, 10)
        if (first >> 4).any():
            raise FlacError("a residual coding that this path does not read")
        k = first & 15
        if (k == 15).any():
            raise FlacError("an escaped partition")
        p = p + 10
        residual = np.zeros((BLOCK, len(rice)), np.int32)
        cut = np.where(k > 0, 64 - k, 63).astype(np.uint64)
        some = k > 0
        for j in range(int(order.min()), BLOCK):
            q = np.zeros(len(rice), np.int64)
            top = (words[p >> 3] << (p & 7).astype(np.uint64)) >> np.uint64(32)
            while True:
                _, e = np.frexp(top.astype(np.float64))
                run = 32 - e  # 32 where all bits are zero
                q += run
                if (run < 32).all():
                    break
                more = run == 32
                ahead = p + q
                if (ahead[more] >> 3 >= len(words)).any():
                    raise FlacError("a Rice code runs past the end")
                ahead = np.minimum(ahead, 8 * len(words) - 8)
                top = np.where(more, (words[ahead >> 3] << (ahead & 7).astype(np.uint64)) >> np.uint64(32), np.uint64(1 << 31))
            after = np.minimum(p + q + 1, 8 * len(words) - 8)
            low = np.where(some, (words[after >> 3] << (after & 7).astype(np.uint64)) >> cut, np.uint64(0)).astype(np.int64)
            u = (q << k) | low
            value = (u >> 1) ^ -(u & 1)
            if j < int(order.max()):
                live = j >= order
                residual[j] = np.where(live, value, 0)
                p = np.where(live, after + k, p)
            else:
                residual[j] = value
                p = after + k
        if len(described):
            mine, most = described, int(order[described].max())
            x = np.zeros((BLOCK, len(mine)), np.int64)
            for j in range(BLOCK):
                guess = sum(coefficient[:, i] * x[j - 1 - i] for i in range(min(j, most))) >> shift if j else 0
                value = residual[j, mine] + guess
                if j < most:
                    value = np.where(j < order[mine], signed[np.minimum(at[rice[mine]] + 1 + j, len(signed) - 1)], value)
                x[j] = value
            out[rice[mine]] = x.T.astype(np.int8)
        for o in range(5):
            mine = np.flatnonzero((order == o) & ~lpc)
            if not len(mine):
                continue
            warm = signed[at[rice[mine]][:, None] + 1 + np.arange(o)].T.astype(np.int32)
            full = residual[o:, mine]
            for level in range(o, 0, -1):  # sums undo differences, from the warm-up samples' own
                full = np.cumsum(np.concatenate([np.diff(warm[:level], level - 1, axis=0), full]), axis=0)
            out[rice[mine]] = full.T.astype(np.int8)
    return out


def decode_batch(streams: list[bytes]) -> list[bytes]:
    """The payload bytes of each stream that encode_batch made, with all checksums and the MD5 verified."""
    if not streams:
        return []
    starts, lengths, numbers, base, infos = [], [], [], 0, []
    for stream in streams:
        info, at = _metadata(stream)
        if (info["channels"], info["bits"], info["block"]) != (1, 8, BLOCK) or len(info["seek"]) * BLOCK != info["total"]:
            raise FlacError("not a stream of one channel of 8 bits with a seek point for each frame")
        offset = info["seek"]["offset"].astype(np.int64)
        starts.append(base + at + offset)
        lengths.append(np.diff(np.append(offset, len(stream) - at)))
        numbers.append(np.arange(len(offset)))
        base += len(stream)
        infos.append(info)
    buf = np.frombuffer(b"".join(streams), np.uint8)
    start, length, number = map(np.concatenate, (starts, lengths, numbers))
    rows = []
    for i in range(0, len(start), LANES):
        s = slice(i, i + LANES)
        lo, hi = int(start[s][0]), int(start[s][-1] + length[s][-1])
        rows.append(_decode_frames(buf[lo:hi], start[s] - lo, length[s], number[s]))
    pcm = np.concatenate(rows)
    payload = (pcm.view(np.uint8) ^ 0x80).tobytes()
    raw = pcm.tobytes()
    out, at = [], 0
    for info in infos:
        end = at + info["total"]
        if hashlib.md5(raw[at:end]).digest() != info["md5"]:
            raise FlacError("the MD5 of the samples does not match")
        out.append(payload[at:end])
        at = end
    return out


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.p = data, at * 8

    def read(self, n: int) -> int:
        if n == 0:
            return 0
        a, b = self.p >> 3, (self.p + n + 7) >> 3
        if b > len(self.data):
            raise FlacError("the stream ends inside a frame")
        v = int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.p - n)
        self.p += n
        return v & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.read(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        q = 0
        while not self.read(1):
            q += 1
        return q


FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _subframe(bits: _Bits, depth: int, n: int) -> list[int]:
    bits.read(1)
    kind, wasted = bits.read(6), 0
    if bits.read(1):
        wasted = bits.unary() + 1
        depth -= wasted
    if kind == 0:
        x = [bits.signed(depth)] * n
    elif kind == 1:
        x = [bits.signed(depth) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        x = [bits.signed(depth) for _ in range(order)]
        shift, coef = 0, FIXED[order] if kind < 32 else ()
        if kind >= 32:
            precision = bits.read(4) + 1
            shift = bits.signed(5)
            coef = [bits.signed(precision) for _ in range(order)]
        wide = bits.read(2)
        if wide > 1:
            raise FlacError("an unknown residual coding")
        parts = bits.read(4)
        for part in range(1 << parts):
            k = bits.read(5 if wide else 4)
            count = (n >> parts) - (order if part == 0 else 0)
            if k == (31 if wide else 15):
                size = bits.read(5)
                rest = [bits.signed(size) for _ in range(count)]
            else:
                rest = []
                for _ in range(count):
                    u = bits.unary() << k | bits.read(k)
                    rest.append(u >> 1 ^ -(u & 1))
            for r in rest:
                x.append(r + (sum(c * x[-1 - j] for j, c in enumerate(coef)) >> shift))
    else:
        raise FlacError("a reserved subframe kind")
    return [v << wasted for v in x] if wasted else x


BLOCK_SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def decode_stream(stream: bytes) -> Iterator[tuple[int, list[list[int]]]]:
    """(sample offset, samples of each channel) of every frame of any FLAC stream, checksums verified."""
    info, at = _metadata(stream)
    offset = 0
    while at < len(stream):
        bits = _Bits(stream, at)
        if bits.read(15) != 0x7FFC:
            raise FlacError("no frame where one must start")
        bits.read(1)
        size, rate, channel, sample = bits.read(4), bits.read(4), bits.read(4), bits.read(3)
        bits.read(1)
        lead = bits.read(8)
        while lead & 0xC0 == 0xC0:
            bits.read(8)
            lead = lead << 1 & 0xFF | 0x80 if lead << 1 & 0x40 else 0
        n = bits.read(8) + 1 if size == 6 else bits.read(16) + 1 if size == 7 else BLOCK_SIZES[size]
        bits.read({12: 8, 13: 16, 14: 16}.get(rate, 0))
        end = bits.p >> 3
        head = np.frombuffer(stream[at:end], np.uint8)[None, :]
        if int(crc8(head)[0]) != bits.read(8):
            raise FlacError("a frame header's CRC-8 does not match")
        depth = SAMPLE_BITS.get(sample, info["bits"])
        if channel < 8:
            x = [_subframe(bits, depth, n) for _ in range(channel + 1)]
        else:
            a = _subframe(bits, depth + (channel == 9), n)
            b = _subframe(bits, depth + (channel != 9), n)
            if channel == 8:
                x = [a, [l - s for l, s in zip(a, b, strict=True)]]
            elif channel == 9:
                x = [[s + r for s, r in zip(a, b, strict=True)], b]
            else:
                mid = [m << 1 | s & 1 for m, s in zip(a, b, strict=True)]
                x = [[m + s >> 1 for m, s in zip(mid, b, strict=True)], [m - s >> 1 for m, s in zip(mid, b, strict=True)]]
        end = (bits.p + 7) >> 3
        body = np.frombuffer((b"\0" if (end - at) & 1 else b"") + stream[at:end], np.uint8)[None, :]
        if int(crc16(body)[0]) != int.from_bytes(stream[end : end + 2], "big"):
            raise FlacError("a frame's CRC-16 does not match")
        yield offset, x
        offset += n
        at = end + 2


def seek(stream: bytes, sample: int) -> tuple[int, bytes]:
    """The sample offset and payload bytes of the frame that holds a sample, read alone by its seek point."""
    info, at = _metadata(stream)
    if not 0 <= sample < info["total"]:
        raise FlacError("no such sample")
    i = int(np.searchsorted(info["seek"]["sample"].astype(np.int64), sample, "right")) - 1
    offset = np.append(info["seek"]["offset"].astype(np.int64), len(stream) - at)
    a, b = at + int(offset[i]), at + int(offset[i + 1])
    pcm = _decode_frames(np.frombuffer(stream[a:b], np.uint8), np.array([0]), np.array([b - a]), np.array([i]))
    return i * BLOCK, (pcm.view(np.uint8) ^ 0x80).tobytes()


def encode_media(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_bytes, media): every text stored as a FLAC stream; null counts as empty."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = [utf8(t) for t in batch.column(1).to_pylist()]
        media = encode_batch([padded(r) for r in raw])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def pcm_of(stream: bytes) -> bytes:
    """All samples of any stream, channels in turn: unsigned bytes for 8 bits, else little-endian signed numbers of whole bytes."""
    info, _ = _metadata(stream)
    if info["channels"] == 1 and info["bits"] == 8:
        try:
            return decode_batch([stream])[0]
        except FlacError:
            pass  # it may be one that the fast path does not read: the slow one reads or raises
    size = (info["bits"] + 7) // 8
    out = []
    for _, channels in decode_stream(stream):
        x = np.array(channels, np.int64).T.ravel()
        out.append((x + 128).astype(np.uint8).tobytes() if info["bits"] == 8 else x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes())
    return b"".join(out)


def pcm_blocks(media: DataFrame, id_col: str, per_block: int = 4096 // BLOCK * BLOCK) -> DataFrame:
    """(id, block, sample_offset, n_samples, pcm): the decoded blocks of each stream of any kind, by their sample offsets; no row for a null stream."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]
        for key, stream in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if stream is None:
                continue
            info, _ = _metadata(stream)
            width, payload = info["channels"] * ((info["bits"] + 7) // 8), pcm_of(stream)
            for i, at in enumerate(range(0, len(payload), per_block * width)):
                piece = payload[at : at + per_block * width]
                for column, value in zip(out, (key, i, at // width, len(piece) // width, piece), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], ["id", "block", "sample_offset", "n_samples", "pcm"])

    return map_batches(media.select(F.col(id_col).alias("id"), "media"), run, f"id {kind}, block long, sample_offset long, n_samples long, pcm binary").withColumnRenamed("id", id_col)


def _feature(payloads: list[bytes]) -> list[str]:
    """Sample count, mean level, energy and sign changes of the difference signal, in whole numbers."""
    x = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int64) - 128
    size = np.array([len(p) for p in payloads])
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    step = np.diff(x, prepend=x[:1])
    step[at] = 0
    turn = np.zeros(len(x), np.int64)
    turn[1:] = (step[1:] ^ step[:-1]) < 0
    turn[at] = 0
    level, energy, turns, move = (np.add.reduceat(v, at) for v in (x, x * x, turn, np.abs(step)))
    return [f"n={n};level={a};energy={b};turns={c};move={d}" for n, a, b, c, d in zip(size.tolist(), level.tolist(), energy.tolist(), turns.tolist(), move.tolist(), strict=True)]


def media_digest(media: DataFrame, id_col: str) -> DataFrame:
    """Decode each stored stream and describe what was read back."""
    kind = media.schema[id_col].dataType.simpleString()
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        streams = batch.column(2).to_pylist()
        back = decode_batch(streams)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array([len(p) for p in back], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in back]), pa.array([zlib.crc32(p[-16:]) for p in back], pa.int64()),
                pa.array([len(s) for s in streams], pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in streams]), pa.array(_feature(back)),
            ], names,
        )

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(media.select(F.col(id_col).alias("id"), "n_bytes", "media"), run, schema).withColumnRenamed("id", id_col)
