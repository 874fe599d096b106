"""Ogg Vorbis I to samples: pages to packets, headers, floors of type 1, residues, coupling, inverse transform, overlap."""

from __future__ import annotations

import struct
from functools import lru_cache
from itertools import islice

import numpy as np

from fileloom.operators.errors import ConversionError, UnsupportedCodec

#: Greatest floor value by multiplier.
FLOOR_RANGE = (256, 128, 86, 64)
#: Amplitudes of floor values: steps of 140 / 256 decibels below one.
AMPLITUDE = 10 ** (0.05 * 140 / 256 * (np.arange(256) - 255.0))


class Bits:
    """Bits, lowest first; an end of packet raises EOFError."""

    def __init__(self, data: bytes) -> None:
        self.value, self.left = int.from_bytes(data, "little"), 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            raise EOFError
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.left -= n
        return out


class Packet(Bits):
    """The same over a byte string in windows, as shifting a long integer for each bit would be slow."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.value, self.left = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.left < n:
            part = self.data[self.at : self.at + 32]
            if not part:
                raise EOFError
            self.value |= int.from_bytes(part, "little") << self.left
            self.at += len(part)
            self.left += 8 * len(part)
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.left -= n
        return out


def packets(data: bytes):
    """Packets of the first logical stream; damaged or foreign pages are passed over."""
    at, serial, held = 0, None, b""
    while (at := data.find(b"OggS", at)) >= 0 and at + 27 <= len(data):
        kind, _, own, _, _, n = struct.unpack_from("<BqIIIB", data, at + 5)
        lacing = data[at + 27 : at + 27 + n]
        body = at + 27 + n
        at = body + sum(lacing)
        if serial is None:
            serial = own
        if own != serial:
            continue
        if not kind & 1:
            held = b""
        for size in lacing:
            held += data[body : body + size]
            body += size
            if size < 255:
                yield held
                held = b""


def code_words(lengths: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) to entry: each entry in turn gets the leftmost free place of its depth in the tree."""
    used = [k for k, n in enumerate(lengths) if n]
    if len(used) == 1:
        return {(lengths[used[0]], 0): used[0]}
    free, out = [(0, 0)], {}  # (code, depth) from left to right
    for k in used:
        n = lengths[k]
        i = next((i for i, (_, depth) in enumerate(free) if depth <= n), None)
        if i is None:
            raise ValueError("overfull codebook")
        code, depth = free.pop(i)
        out[n, code << (n - depth)] = k
        # the right halves on the way down stay free, the deepest is the leftmost
        free[i:i] = [((code << (d - depth)) | 1, d) for d in range(n, depth, -1)]
    return out


def _float(v: int) -> float:
    mantissa = v & 0x1FFFFF
    return (-mantissa if v >> 31 else mantissa) * 2.0 ** ((v >> 21 & 0x3FF) - 788)


class Codebook:
    def __init__(self, b: Bits) -> None:
        if b.take(24) != 0x564342:
            raise ValueError("codebook not found")
        self.dimensions, entries = b.take(16), b.take(24)
        lengths: list[int] = []
        if b.take(1):
            n = b.take(5) + 1
            while len(lengths) < entries:
                run = b.take((entries - len(lengths)).bit_length())
                lengths += [n] * run
                n += 1
        else:
            sparse = b.take(1)
            lengths = [b.take(5) + 1 if not sparse or b.take(1) else 0 for _ in range(entries)]
        self.words = code_words(lengths[:entries])
        kind = b.take(4)
        self.vectors = None
        if kind in (1, 2):
            low, step, bits, running = _float(b.take(32)), _float(b.take(32)), b.take(4) + 1, b.take(1)
            size = entries * self.dimensions
            if kind == 1:
                size = int(entries ** (1 / self.dimensions)) + 2
                while size**self.dimensions > entries:
                    size -= 1
            values = np.array([b.take(bits) for _ in range(size)]) * step + low
            if kind == 1:
                place = np.arange(entries)[:, None] // size ** np.arange(self.dimensions)[None, :] % size
                vectors = values[place]
            else:
                vectors = values.reshape(entries, self.dimensions)
            self.vectors = np.cumsum(vectors, axis=1) if running else vectors
        elif kind:
            raise ValueError("reserved codebook")

    def entry(self, b: Packet) -> int:
        code = 0
        for n in range(1, 33):
            code = code << 1 | b.take(1)
            found = self.words.get((n, code))
            if found is not None:
                return found
        raise ValueError("invalid code word")


class Floor:
    def __init__(self, b: Bits) -> None:
        if b.take(16) != 1:
            raise UnsupportedCodec("reading ogg with floors of type 0")
        classes = [b.take(4) for _ in range(b.take(5))]
        self.classes = []
        for _ in range(max(classes, default=-1) + 1):
            dimensions, bits = b.take(3) + 1, b.take(2)
            master = b.take(8) if bits else 0
            self.classes.append((dimensions, bits, master, [b.take(8) - 1 for _ in range(1 << bits)]))
        self.partitions = classes
        self.multiplier, bits = b.take(2) + 1, b.take(4)
        self.x = [0, 1 << bits]
        for c in classes:
            self.x += [b.take(bits) for _ in range(self.classes[c][0])]
        self.order = np.argsort(self.x, kind="stable")
        self.near = []
        for k in range(2, len(self.x)):
            before = [j for j in range(k)]
            self.near.append((max((j for j in before if self.x[j] < self.x[k]), key=lambda j: self.x[j]), min((j for j in before if self.x[j] > self.x[k]), key=lambda j: self.x[j])))

    def read(self, b: Packet, books: list[Codebook]) -> list[int] | None:
        if not b.take(1):
            return None
        width = (FLOOR_RANGE[self.multiplier - 1] - 1).bit_length()
        y = [b.take(width), b.take(width)]
        for c in self.partitions:
            dimensions, bits, master, own = self.classes[c]
            value = books[master].entry(b) if bits else 0
            for _ in range(dimensions):
                book = own[value & ((1 << bits) - 1)]
                value >>= bits
                y.append(books[book].entry(b) if book >= 0 else 0)
        return y

    def curve(self, y: list[int], n: int) -> np.ndarray:
        """Amplitudes at n places: lines between the points that are set, each point told by its distance from such a line."""
        most = FLOOR_RANGE[self.multiplier - 1]
        final, shown = y[:2], [True, True] + [False] * (len(y) - 2)
        for k, (low, high) in enumerate(self.near, 2):
            x0, x1, y0, y1 = self.x[low], self.x[high], final[low], final[high]
            off = abs(y1 - y0) * (self.x[k] - x0) // (x1 - x0)
            guess = y0 - off if y1 < y0 else y0 + off
            above, below, value = most - guess, guess, y[k]
            if not value:
                final.append(guess)
                continue
            shown[low] = shown[high] = shown[k] = True
            if value >= 2 * min(above, below):
                final.append(value - below + guess if above > below else guess - value + above - 1)
            else:
                final.append(guess - (value + 1) // 2 if value & 1 else guess + value // 2)
        points = [(self.x[k], min(max(final[k] * self.multiplier, 0), 255)) for k in self.order if shown[k]]
        out = np.empty(n, np.int64)
        for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
            step = np.arange(min(x1, n) - min(x0, n))
            out[min(x0, n) : min(x1, n)] = y0 + np.sign(y1 - y0) * (abs(y1 - y0) * step // (x1 - x0))
        out[min(points[-1][0], n) :] = points[-1][1]
        return AMPLITUDE[out]


class Residue:
    def __init__(self, b: Bits) -> None:
        self.kind = b.take(16)
        self.begin, self.end, self.size, self.classes, self.book = b.take(24), b.take(24), b.take(24) + 1, b.take(6) + 1, b.take(8)
        cascade = []
        for _ in range(self.classes):
            low = b.take(3)
            cascade.append((b.take(5) << 3 if b.take(1) else 0) | low)
        self.books = [[b.take(8) if c >> k & 1 else None for k in range(8)] for c in cascade]

    def read(self, b: Packet, books: list[Codebook], n: int, wanted: list[bool]) -> np.ndarray:
        """A row for each channel; an early end of the packet leaves the rest zero."""
        if self.kind == 2:
            whole = np.zeros((1, n * len(wanted)))
            if any(wanted):
                self._read(b, books, whole, [True], n * len(wanted))
            return whole.reshape(n, len(wanted)).T
        out = np.zeros((len(wanted), n))
        self._read(b, books, out, wanted, n)
        return out

    def _read(self, b: Packet, books: list[Codebook], out: np.ndarray, wanted: list[bool], n: int) -> None:
        begin, end = min(self.begin, n), min(self.end, n)
        parts = (end - begin) // self.size
        master = books[self.book]
        kinds = np.zeros((len(out), parts + master.dimensions), np.int64)
        try:
            for turn in range(8):
                for k in range(0, parts, master.dimensions):
                    if turn == 0:
                        for j in range(len(out)):
                            if wanted[j]:
                                v = master.entry(b)
                                for i in range(master.dimensions - 1, -1, -1):
                                    v, kinds[j, k + i] = divmod(v, self.classes)
                    for i in range(k, min(k + master.dimensions, parts)):
                        for j in range(len(out)):
                            book = self.books[kinds[j, i]][turn] if wanted[j] else None
                            if book is not None:
                                self._part(b, books[book], out[j, begin + i * self.size : begin + (i + 1) * self.size])
        except EOFError:
            return

    def _part(self, b: Packet, book: Codebook, place: np.ndarray) -> None:
        d = book.dimensions
        if self.kind == 0:
            step = len(place) // d
            for i in range(step):
                place[i::step][:d] += book.vectors[book.entry(b)]
        else:
            for i in range(0, len(place), d):
                v = book.vectors[book.entry(b)]
                place[i : i + d] += v[: len(place) - i]


@lru_cache(maxsize=4)
def _cosines(n: int) -> np.ndarray:
    return np.cos(2 * np.pi / n * np.outer(np.arange(n) + 0.5 + n / 4, np.arange(n // 2) + 0.5))


def _slope(n: int) -> np.ndarray:
    return np.sin(np.pi / 2 * np.sin((np.arange(n) + 0.5) / n * np.pi / 2) ** 2)


class Decoder:
    def __init__(self, identification: bytes, setup: bytes) -> None:
        version, self.channels, self.rate, _, _, _, sizes = struct.unpack_from("<IBIiiiB", identification, 7)
        if version or not self.channels or not self.rate:
            raise ValueError("invalid identification header")
        self.sizes = (1 << (sizes & 15), 1 << (sizes >> 4))
        b = Bits(setup[7:])
        self.books = [Codebook(b) for _ in range(b.take(8) + 1)]
        for _ in range(b.take(6) + 1):
            b.take(16)
        self.floors = [Floor(b) for _ in range(b.take(6) + 1)]
        self.residues = [Residue(b) for _ in range(b.take(6) + 1)]
        self.mappings = [self._mapping(b) for _ in range(b.take(6) + 1)]
        self.modes = [(b.take(1), b.take(16), b.take(16), b.take(8)) for _ in range(b.take(6) + 1)]
        self.tail: np.ndarray | None = None

    def _mapping(self, b: Bits):
        b.take(16)
        submaps = b.take(4) + 1 if b.take(1) else 1
        width = (self.channels - 1).bit_length()
        coupling = [(b.take(width), b.take(width)) for _ in range(b.take(8) + 1)] if b.take(1) else []
        b.take(2)
        of = [b.take(4) for _ in range(self.channels)] if submaps > 1 else [0] * self.channels
        return coupling, of, [(b.take(8), b.take(8), b.take(8))[1:] for _ in range(submaps)]

    def block(self, data: bytes) -> np.ndarray:
        """Samples (n x channels) that the packet completes; none for the first."""
        b = Packet(data)
        if b.take(1):
            return np.zeros((0, self.channels))
        flag, _, _, mapping = self.modes[b.take((len(self.modes) - 1).bit_length())]
        n = self.sizes[flag]
        before, after = (b.take(1), b.take(1)) if flag else (1, 1)
        coupling, of, submaps = self.mappings[mapping]
        curves = [None] * self.channels
        for c in range(self.channels):
            floor = self.floors[submaps[of[c]][0]]
            try:
                y = floor.read(b, self.books)
            except EOFError:
                y = None
            curves[c] = floor.curve(y, n // 2) if y is not None else None
        wanted = [c is not None for c in curves]
        for m, a in coupling:
            wanted[m] = wanted[a] = wanted[m] or wanted[a]
        spectrum = np.zeros((self.channels, n // 2))
        for k, (_, residue) in enumerate(submaps):
            own = [c for c in range(self.channels) if of[c] == k]
            spectrum[own] = self.residues[residue].read(b, self.books, n // 2, [wanted[c] for c in own])
        for m, a in reversed(coupling):
            x, y = spectrum[m].copy(), spectrum[a].copy()
            up, right = x > 0, y > 0
            spectrum[m] = np.where(right, x, np.where(up, x + y, x - y))
            spectrum[a] = np.where(right, np.where(up, x - y, x + y), x)
        for c, curve in enumerate(curves):
            spectrum[c] *= 0 if curve is None else curve
        wave = spectrum @ _cosines(n).T * self._window(n, flag, before, after)
        return self._overlap(wave.T)

    def _window(self, n: int, flag: int, before: int, after: int) -> np.ndarray:
        short = self.sizes[0]
        out = np.ones(n)
        for side, full in ((0, before), (1, after)):
            m = n // 2 if full or not flag else short // 2
            half = np.concatenate([np.zeros(n // 4 - m // 2), _slope(m), np.ones(n // 4 - m // 2)])
            out[n // 2 * side : n // 2 * (side + 1)] = half[::-1] if side else half
        return out

    def _overlap(self, wave: np.ndarray) -> np.ndarray:
        """From the middle of the block before to the middle of this one."""
        n = len(wave)
        last, self.tail = self.tail, wave[n // 2 :]
        if last is None:
            return wave[:0]
        size = len(last) // 2 + n // 4
        out = np.zeros((size, self.channels))
        keep = last[:size]
        out[: len(keep)] += keep
        own = wave[: n // 2][-size:]
        out[size - len(own) :] += own
        return out


def decode(data: bytes) -> tuple[np.ndarray, int, int]:
    """(interleaved samples, channels, rate); damaged packets are skipped."""
    stream = packets(data)
    heads = list(islice(stream, 3))
    if not heads or heads[0][:7] != b"\x01vorbis":
        raise UnsupportedCodec("reading ogg without vorbis")
    if len(heads) < 3 or heads[2][:7] != b"\x05vorbis":
        raise ConversionError("Unsupported audio format: incomplete Vorbis headers")
    try:
        decoder = Decoder(heads[0], heads[2])
    except (ValueError, EOFError, IndexError, struct.error) as e:
        raise ConversionError(f"Failed to create audio decoder: {e or 'unexpected end of headers'}") from None
    out = []
    for p in stream:
        try:
            out.append(decoder.block(p))
        except (ValueError, EOFError, IndexError, TypeError):
            continue
    samples = np.concatenate(out) if out else np.zeros((0, decoder.channels))
    return samples.astype(np.float32).reshape(-1), decoder.channels, decoder.rate
