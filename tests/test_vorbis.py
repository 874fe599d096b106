"""A stream made by a small writer, against the sum that defines the inverse transform."""

import struct

import numpy as np
import pytest

from fileloom.operators import audio, vorbis


class Writer:
    def __init__(self):
        self.value = self.n = 0

    def put(self, value, n):
        self.value |= value << self.n
        self.n += n
        return self

    def done(self):
        return self.value.to_bytes((self.n + 7) // 8, "little")


def book(w, dimensions, lengths, lookup=None):
    w.put(0x564342, 24).put(dimensions, 16).put(len(lengths), 24).put(0, 1)
    sparse = 0 in lengths
    w.put(int(sparse), 1)
    for n in lengths:
        if sparse:
            w.put(int(n > 0), 1)
        if n:
            w.put(n - 1, 5)
    if not lookup:
        w.put(0, 4)
    else:
        low, step, bits, values = lookup
        w.put(1, 4).put(as_float(low), 32).put(as_float(step), 32).put(bits - 1, 4).put(0, 1)
        for v in values:
            w.put(v, bits)


def as_float(x):
    return (1 << 31 if x < 0 else 0) | (788 << 21) | abs(x)


def page(body, serial=7, kind=0):
    lacing = bytes([255] * (len(body) // 255) + [len(body) % 255])
    return b"OggS\0" + struct.pack("<BqIIIB", kind, 0, serial, 0, 0, len(lacing)) + lacing + body


LONG, SHORT = 64, 32


def headers(channels, kind):
    identification = b"\x01vorbis" + struct.pack("<IBIiiiB", 0, channels, 8000, 0, 0, 0, 5 | 6 << 4) + b"\1"
    w = Writer().put(2, 8)
    book(w, 1, [1, 2, 2])  # classes of residue
    book(w, 1, [8] * 256, (-128, 1, 8, range(256)))  # values
    book(w, 2, [4] * 16, (-2, 1, 2, range(4)))  # pairs of small values
    w.put(0, 6).put(0, 16)
    w.put(0, 6).put(1, 16).put(0, 5).put(0, 2).put(5, 4)  # a floor of two points, multiplier 1, at 0 and 32
    w.put(0, 6).put(kind, 16).put(0, 24).put(LONG // 2 * (channels if kind == 2 else 1), 24).put(7, 24).put(2, 6).put(0, 8)
    for cascade in (0, 1, 2):  # nothing; values in the first turn; pairs in the second
        w.put(cascade, 3).put(0, 1)
    w.put(1, 8).put(2, 8)
    w.put(0, 6).put(0, 16).put(0, 1)
    if channels == 2:
        w.put(1, 1).put(0, 8).put(0, 1).put(1, 1)
    else:
        w.put(0, 1)
    w.put(0, 2).put(0, 8).put(0, 8).put(0, 8)
    w.put(1, 6).put(0, 1).put(0, 32).put(0, 8).put(1, 1).put(0, 32).put(0, 8).put(1, 1)
    return page(identification, kind=2) + page(b"\x03vorbis" + bytes(9)) + page(b"\x05vorbis" + w.done())


def window(n, left, right):
    slope = lambda m: np.sin(np.pi / 2 * np.sin((np.arange(m) + 0.5) / m * np.pi / 2) ** 2)
    out = np.zeros(n)
    out[n // 4 - left // 4 : n // 4 + left // 4] = slope(left // 2)
    out[n // 4 + left // 4 : 3 * n // 4 - right // 4] = 1
    out[3 * n // 4 - right // 4 : 3 * n // 4 + right // 4] = slope(right // 2)[::-1]
    return out


@pytest.mark.parametrize(("channels", "kind"), [(1, 0), (1, 1), (2, 1), (2, 2)])
def test_stream(channels, kind):
    rng = np.random.default_rng(channels * 10 + kind)
    flags = [0, 1, 1, 0, 0, 1, 1]
    data, waves = headers(channels, kind), []
    for k, flag in enumerate(flags):
        n = (SHORT, LONG)[flag]
        left, right = (flags[k - 1] if k else 1), (flags[k + 1] if k + 1 < len(flags) else 1)
        w = Writer().put(0, 1).put(flag, 1)
        if flag:
            w.put(left, 1).put(right, 1)
        level = [int(rng.integers(150, 230)) for _ in range(channels)]
        silent = channels == 2 and k == 4
        for c in range(channels):
            w.put(1, 1).put(level[c], 8).put(level[c], 8) if not (silent and c == 0) else w.put(0, 1)
        rows, length = (1, n // 2 * channels) if kind == 2 else (channels, n // 2)
        classes = rng.integers(0, 3, (rows, length // 8))
        values = np.zeros((rows, length))
        codes = {0: (0, 1), 1: (0b01, 2), 2: (0b11, 2)}  # first bit lowest: 0, 10, 11
        for turn in (0, 1):
            for i in range(length // 8):
                if turn == 0:
                    for j in range(rows):
                        w.put(*codes[int(classes[j, i])])
                for j in range(rows):
                    if classes[j, i] == 1 and turn == 0:
                        v = rng.integers(-128, 128, 8)
                        values[j, 8 * i : 8 * i + 8] = v
                        for x in v:
                            w.put(int(f"{x + 128:08b}"[::-1], 2), 8)
                    if classes[j, i] == 2 and turn == 1:
                        v = rng.integers(-2, 2, (4, 2))
                        values[j, 8 * i : 8 * i + 8] = v.T.reshape(-1) if kind == 0 else v.reshape(-1)
                        for x, y in v:
                            w.put(int(f"{(x + 2) + 4 * (y + 2):04b}"[::-1], 2), 4)
        data += page(w.done())
        s = values.reshape(-1, channels).T.copy() if kind == 2 else values
        if channels == 2:
            for i in range(n // 2):
                m, a = s[0, i], s[1, i]
                s[:, i] = ((m, m - a) if a > 0 else (m + a, m)) if m > 0 else ((m, m + a) if a > 0 else (m - a, m))
        for c in range(channels):
            s[c] *= 0 if silent and c == 0 else 10 ** (0.05 * 140 / 256 * (level[c] - 255))
        wave = np.array([[sum(s[c, i] * np.cos(2 * np.pi / n * (t + 0.5 + n / 4) * (i + 0.5)) for i in range(n // 2)) for t in range(n)] for c in range(channels)])
        waves.append(wave * window(n, n if not flag or left else SHORT, n if not flag or right else SHORT))
    # place each block's middle and add
    want = np.zeros((channels, 2000))
    for k, wave in enumerate(waves):
        n = wave.shape[1]
        middle = 500 if k == 0 else middle + waves[k - 1].shape[1] // 4 + n // 4
        want[:, middle - n // 2 : middle + n // 2] += wave
    samples, got_channels, rate = audio.decode(data + page(b"junk", serial=9))
    assert (got_channels, rate) == (channels, 8000)
    assert np.allclose(samples.reshape(-1, channels).T, want[:, 500:middle], atol=1e-4)


def test_code_words():
    assert vorbis.code_words([2, 4, 4, 4, 4, 2, 3, 3]) == {(2, 0): 0, (4, 4): 1, (4, 5): 2, (4, 6): 3, (4, 7): 4, (2, 2): 5, (3, 6): 6, (3, 7): 7}


def test_floor_curve():
    """Points off the line between their neighbours, by both rules for their distance."""
    w = Writer().put(1, 16).put(1, 5).put(0, 4).put(1, 3).put(0, 2).put(1, 8).put(1, 2).put(4, 4).put(8, 4).put(4, 4)
    floor = vorbis.Floor(vorbis.Bits(w.done() + b"\0"))
    assert floor.x == [0, 16, 8, 4] and floor.multiplier == 2
    curve = floor.curve([10, 30, 5, 0], 16)
    # at 8 the line has 20, five is odd: 20 - 3 = 17; at 4 nothing is told: the line from 10 to 17
    level = np.rint(255 + 20 * np.log10(curve) * 256 / 140).astype(int)
    assert level[0] == 20 and level[8] == 34 and level[4] == 20 + (34 - 20) * 4 // 8
