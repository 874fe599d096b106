"""Audio to 16-bit PCM WAV: WAV and FLAC are read here, Vorbis beside; MP3 is an explicit error."""

from __future__ import annotations

import struct

import numpy as np

from fileloom.operators import vorbis
from fileloom.operators.errors import ConversionError, UnsupportedCodec


def encode_wav(samples: np.ndarray, channels: int, rate: int) -> bytes:
    """Interleaved floats, clamped to one, times 32,767 in single precision, cut towards zero."""
    pcm = (np.clip(samples.astype(np.float32), np.float32(-1), np.float32(1)) * np.float32(32767)).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(pcm))
    return head + pcm


def decode_wav(data: bytes) -> tuple[np.ndarray, int, int]:
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, at)
        if kind == b"fmt ":
            form = data[at + 8 : at + 8 + n]
        elif kind == b"data":
            body = data[at + 8 : at + 8 + n]
            break
        at += 8 + n + n % 2
    if form is None or len(form) < 16 or body is None:
        raise ConversionError("Unsupported audio format: no format or data in WAV")
    code, channels, rate, _, _, depth = struct.unpack_from("<HHIIHH", form)
    if code == 0xFFFE and len(form) >= 26:
        code = struct.unpack_from("<H", form, 24)[0]
    if not channels:
        raise ConversionError("No audio track found in file")
    size = (depth + 7) // 8
    n = len(body) // (size * channels or 1) * channels
    if code == 3 and depth in (32, 64):
        out = np.frombuffer(body, f"<f{size}", n).astype(np.float32)
    elif code == 1 and depth == 8:
        out = (np.frombuffer(body, np.uint8, n).astype(np.float32) - 128) / np.float32(128)
    elif code == 1 and depth in (16, 32):
        out = np.frombuffer(body, f"<i{size}", n).astype(np.float64) / float(1 << (depth - 1))
    elif code == 1 and depth == 24:
        b = np.frombuffer(body, np.uint8, 3 * n).reshape(-1, 3).astype(np.int32)
        out = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float64) / float(1 << 23)
    elif code in (6, 7) and depth == 8:
        out = _companded(np.frombuffer(body, np.uint8, n).astype(np.int64), code) / 32768.0
    else:
        raise UnsupportedCodec(f"reading wav with codec {code} at {depth} bits")
    return out.astype(np.float32), channels, rate


def _companded(v: np.ndarray, code: int) -> np.ndarray:
    """A-law (6) or mu-law (7) bytes as 16-bit integers."""
    if code == 7:
        v = ~v & 255
        size = (((v & 15) << 3) + 132) << (v >> 4 & 7)
        return np.where(v & 128, 132 - size, size - 132)
    v = v ^ 0x55
    step, low = v >> 4 & 7, (v & 15) << 4
    size = np.where(step == 0, low + 8, (low + 264) << np.maximum(step - 1, 0))
    return np.where(v & 128, size, -size)


class Bits:
    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at, self.bits, self.have = data, at, 0, 0

    def _fill(self, n: int) -> None:
        while self.have < n:
            part = self.data[self.at : self.at + 64]
            if not part:
                raise EOFError
            self.bits = self.bits << 8 * len(part) | int.from_bytes(part, "big")
            self.at += len(part)
            self.have += 8 * len(part)

    def take(self, n: int) -> int:
        if not n:
            return 0
        self._fill(n)
        self.have -= n
        out = self.bits >> self.have
        self.bits &= (1 << self.have) - 1
        return out

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        zeros = 0
        while True:
            self._fill(1)
            if self.bits:
                n = self.have - self.bits.bit_length()
                self.take(n + 1)
                return zeros + n
            zeros += self.have
            self.have = 0

    def align(self) -> None:
        self.take(self.have % 8)

    def place(self) -> int:
        return self.at - self.have // 8


def _residual(b: Bits, size: int, order: int) -> list[int]:
    wide = b.take(2)
    if wide > 1:
        raise ValueError("reserved residual coding")
    parts = b.take(4)
    out: list[int] = []
    for k in range(1 << parts):
        n = (size >> parts) - (order if k == 0 else 0)
        width = b.take(5 if wide else 4)
        if width == (31 if wide else 15):
            raw = b.take(5)
            out += [b.signed(raw) for _ in range(n)]
            continue
        for _ in range(n):
            v = b.unary() << width | b.take(width)
            out.append(-(v + 1 >> 1) if v & 1 else v >> 1)
    return out


# Coefficients of the fixed predictors.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _subframe(b: Bits, size: int, depth: int) -> list[int]:
    b.take(1)
    kind = b.take(6)
    wasted = b.unary() + 1 if b.take(1) else 0
    depth -= wasted
    if kind == 0:
        out = [b.signed(depth)] * size
    elif kind == 1:
        out = [b.signed(depth) for _ in range(size)]
    else:
        if 8 <= kind <= 12:
            order, shift, weights = kind - 8, 0, None
        elif kind >= 32:
            order = kind - 31
        else:
            raise ValueError("reserved subframe")
        out = [b.signed(depth) for _ in range(order)]
        if kind >= 32:
            precision = b.take(4) + 1
            shift = b.signed(5)
            weights = [b.signed(precision) for _ in range(order)]
        else:
            weights = FIXED[order]
        for r in _residual(b, size, order):
            out.append(r + (sum(w * out[-1 - k] for k, w in enumerate(weights)) >> shift))
    return [v << wasted for v in out] if wasted else out


def decode_flac(data: bytes) -> tuple[np.ndarray, int, int]:
    at, rate, channels, depth = 4, None, 0, 0
    while True:
        if at + 4 > len(data):
            raise ConversionError("Unsupported audio format: unexpected end of FLAC metadata")
        head, n = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if head & 127 == 0:
            v = int.from_bytes(data[at + 14 : at + 22], "big")
            rate, channels, depth = v >> 44, (v >> 41 & 7) + 1, (v >> 36 & 31) + 1
        at += 4 + n
        if head & 128:
            break
    if rate is None:
        raise ConversionError("No audio track found in file")
    out: list[np.ndarray] = []
    while (at := data.find(b"\xff", at)) >= 0 and at + 5 < len(data):
        if data[at + 1] & 0xFE != 0xF8:
            at += 1
            continue
        try:
            frame, at = _flac_frame(data, at, channels, depth)
        except (ValueError, IndexError, KeyError):
            at += 1  # a damaged frame is skipped
            continue
        except EOFError:
            break
        out.append(frame)
    samples = np.concatenate(out) if out else np.zeros((0, channels))
    return (samples / float(1 << (depth - 1))).astype(np.float32).reshape(-1), channels, rate


def _flac_frame(data: bytes, at: int, channels: int, depth: int) -> tuple[np.ndarray, int]:
    b = Bits(data, at)
    b.take(16)
    size_code, rate_code, mode, depth_code, _ = b.take(4), b.take(4), b.take(4), b.take(3), b.take(1)
    first = b.take(8)
    more = 0
    while first & (0x80 >> more):
        more += 1
    b.take(8 * max(0, more - 1))
    if size_code == 0:
        raise ValueError("reserved block size")
    size = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else b.take(8) + 1 if size_code == 6 else b.take(16) + 1 if size_code == 7 else 256 << (size_code - 8)
    b.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
    head_end = b.place()
    if _crc8(data[at:head_end]) != b.take(8):
        raise ValueError("damaged frame header")
    depth = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}.get(depth_code, depth)
    n = mode + 1 if mode < 8 else 2
    if n != channels or mode > 10:
        raise ValueError("other channels than the stream's")
    parts = [np.array(_subframe(b, size, depth + (mode in (8, 10) and k == 1 or mode == 9 and k == 0)), np.int64) for k in range(n)]
    b.align()
    b.take(16)
    if mode == 8:
        parts = [parts[0], parts[0] - parts[1]]
    elif mode == 9:
        parts = [parts[0] + parts[1], parts[1]]
    elif mode == 10:
        middle = parts[0] << 1 | (parts[1] & 1)
        parts = [middle + parts[1] >> 1, middle - parts[1] >> 1]
    return np.stack(parts, axis=1), b.place()


def _crc8(data: bytes) -> int:
    crc = 0
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc << 1 ^ 0x07) & 255 if crc & 128 else crc << 1
    return crc


def decode(data: bytes) -> tuple[np.ndarray, int, int]:
    """(interleaved samples, channels, rate), by what the content looks like."""
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        return decode_wav(data)
    if data[:4] == b"fLaC":
        return decode_flac(data)
    if data[:4] == b"OggS":
        return vorbis.decode(data)
    if data[:3] == b"ID3" or (len(data) > 3 and data[0] == 0xFF and data[1] & 0xE0 == 0xE0):
        raise UnsupportedCodec("reading mp3")
    raise ConversionError("Unsupported audio format: unknown content")


def to_wav(data: bytes) -> bytes:
    return encode_wav(*decode(data))
