"""Raster images: decoders to RGBA arrays (height, width, 4) of bytes, and encoders from them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

from fileloom.operators.errors import ConversionError, UnsupportedCodec

#: Pixels of an image that is decoded at most; more is an error, not a lost executor.
MOST_PIXELS = 1 << 28


def checked(width: int, height: int) -> None:
    if width < 1 or height < 1 or width * height > MOST_PIXELS:
        raise ValueError(f"bad dimensions {width} x {height}")


def rgba(a: np.ndarray) -> np.ndarray:
    """Grey, grey and alpha, RGB or RGBA bytes as RGBA."""
    a = a[..., None] if a.ndim == 2 else a
    out = np.full((*a.shape[:2], 4), 255, np.uint8)
    n = a.shape[2]
    out[..., :3] = a[..., :3] if n > 2 else a[..., :1]
    if n in (2, 4):
        out[..., 3] = a[..., -1]
    return out


def opaque(a: np.ndarray) -> bool:
    return bool((a[..., 3] == 255).all())


# --- PNG ---------------------------------------------------------------------------------------------------------

PNG_MARK = b"\x89PNG\r\n\x1a\n"
#: First column, first row, steps between columns and rows of the passes of an interlaced image.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def unfilter(data: bytes, row: int, width: int) -> bytes:
    """Undoes the filters of rows of that many bytes, each after its filter's number; width: bytes of a pixel."""
    n = len(data) // (row + 1)
    raw = np.frombuffer(data, np.uint8, n * (row + 1)).reshape(n, row + 1)
    out = np.zeros((n + 1, row), np.uint8)
    pad = -row % width
    for y in range(n):
        kind, line, up = int(raw[y, 0]), raw[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            cells = np.concatenate([line, np.zeros(pad, np.uint8)]).reshape(-1, width)
            out[y + 1] = np.cumsum(cells, axis=0, dtype=np.uint8).reshape(-1)[:row]
        elif kind == 2:
            out[y + 1] = line + up
        elif kind in (3, 4):
            own, above, got = line.tolist(), up.tolist(), [0] * row
            for k in range(row):
                a = got[k - width] if k >= width else 0
                b = above[k]
                if kind == 3:
                    got[k] = (own[k] + (a + b) // 2) & 255
                else:
                    c = above[k - width] if k >= width else 0
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    got[k] = (own[k] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
            out[y + 1] = got
        else:
            raise ValueError(f"unknown filter {kind}")
    return out[1:].tobytes()


def _samples(raw: bytes, width: int, height: int, channels: int, depth: int) -> np.ndarray:
    row = (width * channels * depth + 7) // 8
    a = np.frombuffer(raw, np.uint8, height * row).reshape(height, row)
    if depth == 16:
        return a.reshape(height, width, channels, 2)[..., 0].astype(np.uint16) * 256 + a.reshape(height, width, channels, 2)[..., 1]
    if depth < 8:
        bits = np.unpackbits(a, axis=1).reshape(height, -1, depth)
        a = bits @ (1 << np.arange(depth - 1, -1, -1))
        return a[:, : width * channels].reshape(height, width, channels).astype(np.uint16)
    return a.reshape(height, width, channels).astype(np.uint16)


def decode_png(data: bytes) -> np.ndarray:
    if data[:8] != PNG_MARK:
        raise ValueError("invalid PNG signature")
    at, body, palette, clear, head = 8, [], None, None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if len(chunk) < n:
            raise ValueError("unexpected end of file")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = chunk
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None:
        raise ValueError("no header")
    width, height, depth, color, _, _, interlaced = head
    checked(width, height)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = zlib.decompressobj().decompress(b"".join(body))
    step = max(1, channels * depth // 8)
    pixels = np.zeros((height, width, channels), np.uint16)
    pos = 0
    for x, y, dx, dy in ADAM7 if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x) // dx), -(-(height - y) // dy)
        if w < 1 or h < 1:
            continue
        row = (w * channels * depth + 7) // 8
        part = raw[pos : pos + h * (row + 1)]
        if len(part) < h * (row + 1):
            raise ValueError("unexpected end of image data")
        pos += h * (row + 1)
        pixels[y::dy, x::dx] = _samples(unfilter(part, row, step), w, h, channels, depth)
    if color == 3:
        if palette is None:
            raise ValueError("no palette")
        full = np.full((256, 4), 255, np.uint8)
        full[: len(palette), :3] = palette
        if clear:
            full[: len(clear), 3] = np.frombuffer(clear, np.uint8)
        return full[pixels[..., 0]]
    key = None
    if clear and color in (0, 2):
        key = (pixels == np.frombuffer(clear, ">u2")[:channels]).all(axis=2)
    out = pixels >> 8 if depth == 16 else pixels * (255 // ((1 << depth) - 1))
    out = rgba(out.astype(np.uint8))
    if key is not None:
        out[key, 3] = 0
    return out


def encode_png(a: np.ndarray) -> bytes:
    height, width = a.shape[:2]
    own = a[..., :3] if opaque(a) else a
    channels = own.shape[2]
    rows = own.reshape(height, width * channels)
    up = rows.copy()
    up[1:] -= rows[:-1]
    filtered = np.concatenate([np.full((height, 1), 2, np.uint8), up], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 6, 0, 0, 0)
    return PNG_MARK + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(filtered.tobytes(), 6)) + chunk(b"IEND", b"")


# --- BMP ---------------------------------------------------------------------------------------------------------


def _masked(v: np.ndarray, mask: int) -> np.ndarray:
    if not mask:
        return np.full(v.shape, 255, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    top = mask >> shift
    return (((v & mask) >> shift).astype(np.uint64) * 255 // top).astype(np.uint8)


def decode_bmp(data: bytes, icon: bool = False) -> np.ndarray:
    """icon: without a file header and with twice the height, the lower half being a mask."""
    base = 0 if icon else 14
    if not icon and data[:2] != b"BM":
        raise ValueError("invalid BMP signature")
    size, width, height, _, depth, packing = struct.unpack_from("<IiiHHI", data, base)
    down, height = height < 0, abs(height) // (2 if icon else 1)
    checked(width, height)
    used = struct.unpack_from("<I", data, base + 32)[0]
    table = base + size + (12 if packing == 3 and size == 40 else 0)
    n = (used or 1 << depth) if depth <= 8 else 0
    at = table + 4 * n if icon else struct.unpack_from("<I", data, 10)[0]
    row = (width * depth + 31) // 32 * 4
    if packing in (1, 2):
        index = _bmp_runs(data[at:], width, height, packing)
    else:
        if len(data) < at + row * height:
            raise ValueError("unexpected end of image data")
        lines = np.frombuffer(data, np.uint8, row * height, at).reshape(height, row)
        index = _samples(lines.tobytes(), row * 8 // depth, height, 1, depth)[:, :width, 0] if depth <= 8 else None
    if index is not None:
        colors = np.zeros((256, 4), np.uint8)
        colors[:n] = np.frombuffer(data, np.uint8, 4 * n, table).reshape(n, 4)
        out = rgba(colors[index][..., 2::-1])
    elif depth == 24:
        out = rgba(lines[:, : 3 * width].reshape(height, width, 3)[..., ::-1])
    elif depth in (16, 32):
        v = lines[:, : width * depth // 8].copy().view(f"<u{depth // 8}").astype(np.uint32)
        masks = (0x7C00, 0x3E0, 0x1F, 0) if depth == 16 else (0xFF0000, 0xFF00, 0xFF, 0xFF000000 if icon else 0)
        if packing in (3, 6):
            masks = struct.unpack_from("<IIII" if size >= 56 or packing == 6 else "<III", data, base + 40)
            masks = (*masks, 0)[:4]
        out = np.stack([_masked(v, m) for m in masks], axis=2)
    else:
        raise ValueError(f"{depth} bits a pixel")
    if icon and (depth < 32 or not out[..., 3].any()):
        step = (width + 31) // 32 * 4
        start = at + row * height
        if len(data) >= start + step * height:
            mask = np.unpackbits(np.frombuffer(data, np.uint8, step * height, start).reshape(height, step), axis=1)[:, :width]
            out[..., 3] = np.where(mask, 0, 255)
    return np.ascontiguousarray(out if down else out[::-1])


def _bmp_runs(data: bytes, width: int, height: int, packing: int) -> np.ndarray:
    out = np.zeros((height, width), np.uint16)
    x = y = i = 0
    while i + 1 < len(data) and y < height:
        n, v = data[i], data[i + 1]
        i += 2
        if n:
            run = [v] * n if packing == 1 else [(v >> 4, v & 15)[k % 2] for k in range(n)]
        elif v == 0:
            x, y = 0, y + 1
            continue
        elif v == 1:
            break
        elif v == 2:
            x, y = x + data[i], y + data[i + 1]
            i += 2
            continue
        else:
            size = v if packing == 1 else (v + 1) // 2
            raw = data[i : i + size]
            run = list(raw) if packing == 1 else [h for b in raw for h in (b >> 4, b & 15)][:v]
            i += size + size % 2
        keep = run[: max(0, width - x)]
        out[y, x : x + len(keep)] = keep
        x += len(run)
    return out


def encode_bmp(a: np.ndarray) -> bytes:
    height, width = a.shape[:2]
    if opaque(a):
        row = (width * 3 + 3) // 4 * 4
        lines = np.zeros((height, row), np.uint8)
        lines[:, : 3 * width] = a[::-1, :, 2::-1].reshape(height, 3 * width)
        info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, lines.size, 2835, 2835, 0, 0)
    else:
        lines = a[::-1, :, [2, 1, 0, 3]]
        info = struct.pack("<IiiHHIIiiII", 108, width, height, 1, 32, 3, lines.size, 2835, 2835, 0, 0)
        info += struct.pack("<IIII4s", 0xFF0000, 0xFF00, 0xFF, 0xFF000000, b"BGRs") + bytes(48)
    body = lines.tobytes()
    return struct.pack("<2sIHHI", b"BM", 14 + len(info) + len(body), 0, 0, 14 + len(info)) + info + body


# --- QOI ---------------------------------------------------------------------------------------------------------


def decode_qoi(data: bytes) -> np.ndarray:
    magic, width, height, _, _ = struct.unpack_from(">4sIIBB", data)
    if magic != b"qoif":
        raise ValueError("invalid QOI signature")
    checked(width, height)
    n = width * height
    out, seen = bytearray(4 * n), [(0, 0, 0, 0)] * 64
    r, g, b, a = 0, 0, 0, 255
    at, k = 14, 0
    while k < n:
        c = data[at]
        at += 1
        run = 1
        if c == 0xFE:
            r, g, b = data[at : at + 3]
            at += 3
        elif c == 0xFF:
            r, g, b, a = data[at : at + 4]
            at += 4
        elif c < 0x40:
            r, g, b, a = seen[c]
        elif c < 0x80:
            r, g, b = (r + (c >> 4 & 3) - 2) & 255, (g + (c >> 2 & 3) - 2) & 255, (b + (c & 3) - 2) & 255
        elif c < 0xC0:
            d, e = (c & 63) - 32, data[at]
            at += 1
            r, g, b = (r + d + (e >> 4) - 8) & 255, (g + d) & 255, (b + d + (e & 15) - 8) & 255
        else:
            run = min((c & 63) + 1, n - k)
        seen[(r * 3 + g * 5 + b * 7 + a * 11) % 64] = (r, g, b, a)
        out[4 * k : 4 * (k + run)] = bytes((r, g, b, a)) * run
        k += run
    return np.frombuffer(bytes(out), np.uint8).reshape(height, width, 4)


def encode_qoi(image: np.ndarray) -> bytes:
    height, width = image.shape[:2]
    out = bytearray(struct.pack(">4sIIBB", b"qoif", width, height, 3 if opaque(image) else 4, 0))
    seen: list = [(0, 0, 0, 0)] * 64
    last, run = (0, 0, 0, 255), 0
    for pixel in map(tuple, image.reshape(-1, 4).tolist()):
        if pixel == last:
            run += 1
            if run == 62:
                out.append(0xC0 | 61)
                run = 0
            continue
        if run:
            out.append(0xC0 | (run - 1))
            run = 0
        r, g, b, a = pixel
        slot = (r * 3 + g * 5 + b * 7 + a * 11) % 64
        if seen[slot] == pixel:
            out.append(slot)
        else:
            seen[slot] = pixel
            dr, dg, db = ((x - y + 128) % 256 - 128 for x, y in zip(pixel[:3], last[:3], strict=True))
            if a != last[3]:
                out += bytes((0xFF, *pixel))
            elif -2 <= dr < 2 and -2 <= dg < 2 and -2 <= db < 2:
                out.append(0x40 | (dr + 2) << 4 | (dg + 2) << 2 | (db + 2))
            elif -32 <= dg < 32 and -8 <= dr - dg < 8 and -8 <= db - dg < 8:
                out += bytes((0x80 | (dg + 32), (dr - dg + 8) << 4 | (db - dg + 8)))
            else:
                out += bytes((0xFE, r, g, b))
        last = pixel
    if run:
        out.append(0xC0 | (run - 1))
    return bytes(out) + bytes(7) + b"\x01"


# --- TGA ---------------------------------------------------------------------------------------------------------


def decode_tga(data: bytes) -> np.ndarray:
    skip, mapped, kind, first, length, map_depth, _, _, width, height, depth, flags = struct.unpack_from("<BBBHHBHHHHBB", data)
    checked(width, height)
    if kind not in (1, 2, 3, 9, 10, 11) or depth not in (8, 15, 16, 24, 32):
        raise ValueError("unsupported kind of TGA")
    at = 18 + skip
    table = None
    if mapped:
        size = (map_depth + 7) // 8
        table = np.frombuffer(data, np.uint8, length * size, at).reshape(length, size)
        at += length * size
    size, n = (depth + 7) // 8, width * height
    if kind > 8:
        out, have = bytearray(), 0
        while have < n:
            c = data[at]
            count = (c & 127) + 1
            if c & 128:
                out += data[at + 1 : at + 1 + size] * count
                at += 1 + size
            else:
                out += data[at + 1 : at + 1 + size * count]
                at += 1 + size * count
            have += count
        raw = bytes(out[: n * size])
    else:
        raw = data[at : at + n * size]
    pixels = np.frombuffer(raw, np.uint8, n * size).reshape(height, width, size)
    if table is not None:
        pixels = table[pixels[..., 0].astype(int) - first]
        size = pixels.shape[2]
    if size == 2 and kind % 8 != 3:
        v = pixels[..., 0].astype(np.uint32) | pixels[..., 1].astype(np.uint32) << 8
        out = np.stack([_masked(v, m) for m in (0x7C00, 0x3E0, 0x1F, 0)], axis=2)
    elif size >= 3:
        out = rgba(pixels[..., [2, 1, 0, 3][:size]])
    else:
        out = rgba(pixels)
    out = out if flags & 0x20 else out[::-1]
    return np.ascontiguousarray(out[:, ::-1] if flags & 0x10 else out)


def encode_tga(a: np.ndarray) -> bytes:
    height, width = a.shape[:2]
    if max(height, width) > 65535:
        raise ValueError("too large for TGA")
    alpha = not opaque(a)
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, width, height, 32 if alpha else 24, 0x28 if alpha else 0x20)
    return head + np.ascontiguousarray(a[..., [2, 1, 0, 3] if alpha else [2, 1, 0]]).tobytes()


# --- ICO ---------------------------------------------------------------------------------------------------------


def decode_ico(data: bytes) -> np.ndarray:
    """The entry with the most pixels; of equals the last."""
    if data[:4] not in (b"\0\0\1\0", b"\0\0\2\0"):
        raise ConversionError("Failed to read ICO: invalid signature")
    try:
        entries = [struct.unpack_from("<BBBBHHII", data, 6 + 16 * k) for k in range(struct.unpack_from("<H", data, 4)[0])]
    except struct.error:
        raise ConversionError("Failed to read ICO: unexpected end of file") from None
    if not entries:
        raise ConversionError("ICO file contains no images")
    best = None
    for w, h, *_, size, at in entries:
        body = data[at : at + size]
        area = int.from_bytes(body[16:20], "big") * int.from_bytes(body[20:24], "big") if body[:8] == PNG_MARK else (w or 256) * (h or 256)
        if best is None or area >= best[0]:
            best = (area, body)
    try:
        return decode_png(best[1]) if best[1][:8] == PNG_MARK else decode_bmp(best[1], icon=True)
    except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
        raise ConversionError(f"Failed to decode ICO entry: {e}") from None


def encode_ico(a: np.ndarray) -> bytes:
    height, width = a.shape[:2]
    if not (width and height):
        raise ConversionError("Cannot encode zero-dimension image as ICO")
    if max(width, height) > 256:
        raise ConversionError("Failed to encode ICO entry: larger than 256 pixels")
    body = encode_png(a)
    return struct.pack("<HHHBBBBHHII", 0, 1, 1, width % 256, height % 256, 0, 0, 1, 32, len(body), 22) + body


# --- GIF ---------------------------------------------------------------------------------------------------------


def _lzw_codes(data: bytes, smallest: int) -> bytes:
    clear, end = 1 << smallest, (1 << smallest) + 1
    table = [bytes([k]) for k in range(clear)] + [b"", b""]
    width, bits, have, last = smallest + 1, 0, 0, b""
    out = bytearray()
    for byte in data:
        bits |= byte << have
        have += 8
        while have >= width:
            code = bits & ((1 << width) - 1)
            bits >>= width
            have -= width
            if code == clear:
                del table[end + 1 :]
                width, last = smallest + 1, b""
                continue
            if code == end:
                return bytes(out)
            if code < len(table):
                own = table[code]
            elif code == len(table) and last:
                own = last + last[:1]
            else:
                raise ValueError("invalid LZW code")
            out += own
            if last and len(table) < 4096:
                table.append(last + own[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = own
    return bytes(out)


def decode_gif(data: bytes) -> np.ndarray:
    """The first frame on its canvas."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("invalid GIF signature")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    checked(width, height)
    at, table, clear = 13, None, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        table = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        out = bytearray()
        while data[at]:
            out += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        return bytes(out), at + 1

    while True:
        mark = data[at]
        if mark == 0x21:
            body, end = blocks(at + 2)
            if data[at + 1] == 0xF9 and body[0] & 1:
                clear = body[3]
            at = end
        elif mark == 0x2C:
            x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            if flags & 0x80:
                n = 2 << (flags & 7)
                table = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
                at += 3 * n
            if table is None:
                raise ValueError("no color table")
            body, _ = blocks(at + 1)
            index = np.frombuffer(_lzw_codes(body, data[at]).ljust(w * h, b"\0")[: w * h], np.uint8).reshape(h, w)
            if flags & 0x40:
                order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
                straight = np.empty_like(index)
                straight[order] = index
                index = straight
            full = np.full((256, 4), 255, np.uint8)
            full[: len(table), :3] = table
            if clear is not None:
                full[clear, 3] = 0
            canvas = np.zeros((max(height, y + h), max(width, x + w), 4), np.uint8)
            canvas[y : y + h, x : x + w] = full[index]
            return canvas[:height, :width].copy()
        else:
            raise ValueError("no image in file")


def palette_of(a: np.ndarray, most: int = 255) -> tuple[np.ndarray, np.ndarray]:
    """(colors, index) of opaque pixels: the colors themselves if they are few, else by median cut."""
    flat = a.reshape(-1, 3)
    colors, index, counts = np.unique(flat, axis=0, return_inverse=True, return_counts=True)
    if len(colors) <= most:
        return colors, index.reshape(a.shape[:2])
    boxes = [np.arange(len(colors))]
    while len(boxes) < most:
        spread = [np.ptp(colors[b].astype(int), axis=0).max() * counts[b].sum() if len(b) > 1 else -1 for b in boxes]
        k = int(np.argmax(spread))
        if spread[k] <= 0:
            break
        box = boxes.pop(k)
        axis = int(np.argmax(np.ptp(colors[box].astype(int), axis=0)))
        box = box[np.argsort(colors[box, axis], kind="stable")]
        cut = int(np.clip(np.searchsorted(np.cumsum(counts[box]), counts[box].sum() / 2) + 1, 1, len(box) - 1))
        boxes += [box[:cut], box[cut:]]
    of = np.empty(len(colors), np.int64)
    means = np.empty((len(boxes), 3), np.uint8)
    for k, b in enumerate(boxes):
        of[b] = k
        means[k] = np.rint(np.average(colors[b], axis=0, weights=counts[b]))
    return means, of[index].reshape(a.shape[:2])


def _lzw_bytes(index: bytes, smallest: int) -> bytes:
    clear, end = 1 << smallest, (1 << smallest) + 1
    table = {bytes([k]): k for k in range(clear)}
    width, bits, have, free = smallest + 1, clear, smallest + 1, end + 1
    out, own = bytearray(), b""

    def put(code: int) -> None:
        nonlocal bits, have
        bits |= code << have
        have += width
        while have >= 8:
            out.append(bits & 255)
            bits >>= 8
            have -= 8

    for k in range(len(index)):
        c = index[k : k + 1]
        if own + c in table:
            own += c
            continue
        put(table[own])
        if free < 4096:
            table[own + c] = free
            if free == 1 << width and width < 12:
                width += 1
            free += 1
        else:
            put(clear)
            table = {bytes([k]): k for k in range(clear)}
            width, free = smallest + 1, end + 1
        own = c
    if own:
        put(table[own])
        if free == 1 << width and width < 12:
            width += 1
    put(end)
    if have:
        out.append(bits & 255)
    return bytes(out)


def encode_gif(a: np.ndarray) -> bytes:
    """One frame; pixels that are more clear than not become the clear color."""
    height, width = a.shape[:2]
    if max(height, width) > 65535:
        raise ValueError("too large for GIF")
    clear = a[..., 3] < 128
    colors, index = palette_of(np.where(clear[..., None], 0, a[..., :3]))
    slot = len(colors)
    if clear.any():
        index = np.where(clear, slot, index)
        colors = np.concatenate([colors, np.zeros((1, 3), np.uint8)])
    bits = max(2, (len(colors) - 1).bit_length())
    table = np.zeros((1 << bits, 3), np.uint8)
    table[: len(colors)] = colors
    body = _lzw_bytes(index.astype(np.uint8).tobytes(), bits)
    head = struct.pack("<6sHHBBB", b"GIF89a", width, height, 0x80 | (bits - 1), 0, 0) + table.tobytes()
    control = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, int(clear.any()), 0, slot if clear.any() else 0, 0)
    cells = b"".join(bytes([len(body[k : k + 255])]) + body[k : k + 255] for k in range(0, len(body), 255))
    return head + control + struct.pack("<BHHHHBB", 0x2C, 0, 0, width, height, 0, bits) + cells + b"\0;"


# --- TIFF --------------------------------------------------------------------------------------------------------


def _tiff_lzw(data: bytes) -> bytes:
    table: list[bytes] = []
    out, bits, have, width, last = bytearray(), 0, 0, 9, b""
    for byte in data:
        bits = (bits << 8 | byte) & 0xFFFFFF
        have += 8
        if have < width:
            continue
        have -= width
        code = bits >> have & ((1 << width) - 1)
        if code == 256:
            table = [bytes([k]) for k in range(256)] + [b"", b""]
            width, last = 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            own = table[code]
        elif last:
            own = last + last[:1]
        else:
            raise ValueError("invalid LZW code")
        out += own
        if last:
            table.append(last + own[:1])
        last = own
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def decode_tiff(data: bytes) -> np.ndarray:
    """The first image: strips or tiles; plain, PackBits, LZW or Deflate; 1 to 16 bits."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise ValueError("invalid TIFF signature")
    at = struct.unpack_from(f"{order}I", data, 4)[0]
    tags: dict[int, list[int]] = {}
    kinds = {1: "B", 3: "H", 4: "I"}
    for k in range(struct.unpack_from(f"{order}H", data, at)[0]):
        tag, kind, n = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        if kind in kinds:
            size = struct.calcsize(kinds[kind]) * n
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(f"{order}I", data, at + 10 + 12 * k)[0]
            tags[tag] = list(struct.unpack_from(f"{order}{n}{kinds[kind]}", data, place))
    one = lambda tag, default=None: tags.get(tag, [default])[0]
    width, height, packing, photometric = one(256), one(257), one(259, 1), one(262, 1)
    checked(width, height)
    depth, samples, planar = one(258, 1), one(277, 1), one(284, 1)
    if planar != 1 or depth not in (1, 2, 4, 8, 16):
        raise ValueError("unsupported layout")
    tiled = 324 in tags
    w, h = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    places, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across = -(-width // w)
    out = np.zeros((-(-height // h) * h, across * w, samples), np.uint16)
    for k, (p, n) in enumerate(zip(places, sizes, strict=True)):
        raw = data[p : p + n]
        if packing == 5:
            raw = _tiff_lzw(raw)
        elif packing in (8, 32946):
            raw = zlib.decompressobj().decompress(raw)
        elif packing == 32773:
            raw = _packbits(raw)
        elif packing != 1:
            raise ValueError(f"unsupported compression {packing}")
        row = (w * samples * depth + 7) // 8
        rows = min(h, len(raw) // row)
        if depth == 16 and order == "<":
            part = np.frombuffer(raw, "<u2", rows * row // 2).reshape(rows, w, samples).astype(np.uint16)
        else:
            part = _samples(raw, w, rows, samples, depth)
        if one(317, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint16)
            part = part & 255 if depth == 8 else part
        y, x = k // across * h, k % across * w
        out[y : y + rows, x : x + w] = part
    out = out[:height, :width]
    if photometric == 3:
        table = (np.array(tags[320]).reshape(3, -1).T >> 8).astype(np.uint8)
        return rgba(table[out[..., 0]])
    scaled = (out >> 8 if depth == 16 else out * (255 // ((1 << depth) - 1))).astype(np.uint8)
    if photometric == 0:
        scaled[..., 0] = 255 - scaled[..., 0]
    if photometric not in (0, 1, 2):
        raise ValueError(f"unsupported color space {photometric}")
    colors = 3 if photometric == 2 else 1
    return rgba(scaled[..., : min(samples, colors + 1)])


def encode_tiff(a: np.ndarray) -> bytes:
    height, width = a.shape[:2]
    own = np.ascontiguousarray(a[..., :3] if opaque(a) else a)
    n = own.shape[2]
    body = own.tobytes()
    start = 8 + len(body) + len(body) % 2
    tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, n, None), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, 8), (277, 3, 1, n), (278, 4, 1, height), (279, 4, 1, len(body))]
    if n == 4:
        tags.append((338, 3, 1, 2))
    after = start + 2 + 12 * len(tags) + 4
    directory = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, c, after if v is None else v) for t, k, c, v in tags) + bytes(4)
    return struct.pack("<2sHI", b"II", 42, start) + body + bytes(len(body) % 2) + directory + struct.pack(f"<{n}H", *[8] * n)


# --- HDR, DDS ----------------------------------------------------------------------------------------------------


def from_linear(a: np.ndarray) -> np.ndarray:
    """Floats as bytes: clamped to one and scaled."""
    return np.rint(np.clip(np.nan_to_num(a.astype(np.float32), nan=0.0, posinf=1.0, neginf=0.0), 0, 1) * 255).astype(np.uint8)


def decode_hdr(data: bytes) -> np.ndarray:
    head, _, rest = data.partition(b"\n\n")
    if not head.startswith((b"#?RADIANCE", b"#?RGBE")):
        raise ValueError("invalid HDR signature")
    line, _, body = rest.partition(b"\n")
    parts = line.split()
    if len(parts) != 4 or parts[0] != b"-Y" or parts[2] != b"+X":
        raise ValueError("unsupported orientation")
    height, width = int(parts[1]), int(parts[3])
    checked(width, height)
    out = np.zeros((height, width, 4), np.uint8)
    at = 0
    for y in range(height):
        if body[at : at + 2] == b"\2\2" and body[at + 2] << 8 | body[at + 3] == width:
            at += 4
            for c in range(4):
                x = 0
                while x < width:
                    n = body[at]
                    if n > 128:
                        out[y, x : x + n - 128, c] = body[at + 1]
                        x, at = x + n - 128, at + 2
                    else:
                        if not n:
                            raise ValueError("empty run")
                        out[y, x : x + n, c] = np.frombuffer(body, np.uint8, n, at + 1)[: width - x]
                        x, at = x + n, at + 1 + n
        else:
            out[y] = np.frombuffer(body, np.uint8, 4 * width, at).reshape(width, 4)
            at += 4 * width
    scale = np.where(out[..., 3] > 0, np.ldexp(1.0, out[..., 3].astype(int) - 136), 0)
    return rgba(from_linear(out[..., :3] * scale[..., None]))


def decode_dds(data: bytes) -> np.ndarray:
    if data[:4] != b"DDS ":
        raise ValueError("invalid DDS signature")
    height, width = struct.unpack_from("<II", data, 12)
    kind = data[84:88]
    if kind not in (b"DXT1", b"DXT3", b"DXT5"):
        raise ValueError("unsupported DDS encoding")
    checked(width, height)
    bw, bh = -(-width // 4), -(-height // 4)
    size = 8 if kind == b"DXT1" else 16
    raw = np.frombuffer(data, np.uint8, bw * bh * size, 128).reshape(-1, size)
    color = raw[:, -8:].copy()
    ends = color[:, :4].copy().view("<u2").astype(int)
    rgb = np.stack([(ends >> 11) * 255 // 31, (ends >> 5 & 63) * 255 // 63, (ends & 31) * 255 // 31], axis=2)
    four = (ends[:, 0] > ends[:, 1]) | (kind != b"DXT1")
    a, b = rgb[:, 0], rgb[:, 1]
    third = np.where(four[:, None], (2 * a + b) // 3, (a + b) // 2)
    fourth = np.where(four[:, None], (a + 2 * b) // 3, 0)
    table = np.stack([a, b, third, fourth], axis=1)
    pick = (color[:, 4:].copy().view("<u4") >> (2 * np.arange(16, dtype=np.uint32))) & 3
    out = np.full((len(raw), 16, 4), 255, np.uint8)
    out[..., :3] = np.take_along_axis(table, pick[..., None].astype(int), axis=1)
    if kind == b"DXT1":
        out[..., 3] = np.where(~four[:, None] & (pick == 3), 0, 255)
    elif kind == b"DXT3":
        nibbles = np.stack([raw[:, :8] & 15, raw[:, :8] >> 4], axis=2).reshape(-1, 16)
        out[..., 3] = nibbles * 17
    else:
        a0, a1 = raw[:, :1].astype(int), raw[:, 1:2].astype(int)
        steps = np.where(a0 > a1, np.concatenate([a0, a1, *[((7 - k) * a0 + k * a1) // 7 for k in range(1, 7)]], 1), np.concatenate([a0, a1, *[((5 - k) * a0 + k * a1) // 5 for k in range(1, 5)], 0 * a0, 0 * a0 + 255], 1))
        bits = np.zeros(len(raw), np.uint64)
        for k in range(6):
            bits |= raw[:, 2 + k].astype(np.uint64) << np.uint64(8 * k)
        index = (bits[:, None] >> (np.uint64(3) * np.arange(16, dtype=np.uint64))) & np.uint64(7)
        out[..., 3] = np.take_along_axis(steps, index.astype(int), axis=1)
    grid = out.reshape(bh, bw, 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(bh * 4, bw * 4, 4)
    return np.ascontiguousarray(grid[:height, :width])


# --- dispatch ----------------------------------------------------------------------------------------------------


def _decoders() -> dict[str, Callable[[bytes], np.ndarray]]:
    from fileloom.operators import exr, jpeg, webp

    return {
        "png": decode_png, "jpg": jpeg.decode, "gif": decode_gif, "bmp": decode_bmp, "webp": webp.decode, "tiff": decode_tiff, "qoi": decode_qoi,
        "tga": decode_tga, "hdr": decode_hdr, "dds": decode_dds, "exr": exr.decode,
    }


def _encoders() -> dict[str, Callable[[np.ndarray], bytes]]:
    from fileloom.operators import webp

    return {"png": encode_png, "gif": encode_gif, "bmp": encode_bmp, "webp": webp.encode, "tiff": encode_tiff, "qoi": encode_qoi, "tga": encode_tga}


ALIASES = {"jpeg": "jpg", "tif": "tiff"}
DEFAULT_QUALITY = 85


def decode(data: bytes, fmt: str) -> np.ndarray:
    """By the declared format, whatever the content looks like."""
    if fmt == "ico":
        return decode_ico(data)
    try:
        return _decoders()[ALIASES.get(fmt, fmt)](data)
    except ConversionError:
        raise
    except (ValueError, KeyError, IndexError, TypeError, OverflowError, MemoryError, struct.error, zlib.error) as e:
        raise ConversionError(f"Failed to decode {fmt} image: {e}") from None


def encode(a: np.ndarray, fmt: str, quality: int | None = None) -> bytes:
    """quality is for JPEG only."""
    if fmt == "ico":
        return encode_ico(a)
    if fmt == "avif":
        raise UnsupportedCodec("writing avif")
    name = ALIASES.get(fmt, fmt)
    if name in ("hdr", "dds", "exr"):
        raise ConversionError(f"Failed to encode {fmt}: the encoder does not take 8-bit color")
    try:
        if name == "jpg":
            from fileloom.operators import jpeg

            return jpeg.encode(a, DEFAULT_QUALITY if quality is None else quality)
        return _encoders()[name](a)
    except ValueError as e:
        raise ConversionError(f"Failed to encode {fmt}: {e}") from None


def convert_image(data: bytes, from_fmt: str, to_fmt: str, quality: int | None = None) -> bytes:
    return encode(decode(data, from_fmt), to_fmt, quality)
