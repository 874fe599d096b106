"""Archives of (name, data) entries: ZIP, tar.gz, tar.xz and 7z, the same bytes for the same entries."""

from __future__ import annotations

import gzip
import io
import lzma
import struct
import tarfile
import zipfile
import zlib

Entries = list[tuple[str, bytes]]
FORMATS = {"zip": "application/zip", "tar.gz": "application/gzip", "tar.xz": "application/x-xz", "7z": "application/x-7z-compressed"}


def unique_name(name: str, seen: set[str], tried: dict[str, int]) -> str:
    """The name, or with the first (n) before its extension that is not in seen; tried: up to which n names were in it."""
    stem, dot, ext = name.rpartition(".")
    new, n = name, tried.get(name, 0)
    while new in seen:
        n += 1
        new = f"{stem} ({n}).{ext}" if dot else f"{name} ({n})"
    seen.add(new)
    tried[name] = n
    return new


def unique_names(entries: Entries) -> Entries:
    """A name that was there before gets (n) before its extension."""
    seen: set[str] = set()
    tried: dict[str, int] = {}
    return [(unique_name(name, seen, tried), data) for name, data in entries]


def create_zip(entries: Entries) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            info.external_attr = 0o644 << 16
            z.writestr(info, data)
    return out.getvalue()


def create_tar(entries: Entries) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as t:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size, info.mode, info.mtime = len(data), 0o644, 0
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def create_tar_gz(entries: Entries) -> bytes:
    return gzip.compress(create_tar(entries), 6, mtime=0)


def create_tar_xz(entries: Entries) -> bytes:
    return lzma.compress(create_tar(entries), lzma.FORMAT_XZ)


def _number(n: int) -> bytes:
    """7z's variable-length integer: leading ones of the first byte tell how many bytes follow."""
    for more in range(8):
        if n < 1 << (7 * (more + 1)):
            first = (0xFF00 >> more) & 0xFF
            return bytes([first | n >> (8 * more)]) + (n & ((1 << (8 * more)) - 1)).to_bytes(more, "little")
    return b"\xff" + n.to_bytes(8, "little")


def create_7z(entries: Entries) -> bytes:
    """One LZMA2 stream for each entry that has data; names and empty entries in the header."""
    dictionary = 1 << 20
    coder = [{"id": lzma.FILTER_LZMA2, "dict_size": dictionary}]
    full = [(n, d) for n, d in entries if d]
    packed = [lzma.compress(d, lzma.FORMAT_RAW, filters=coder) for _, d in full]
    header = bytearray(b"\x01")
    if full:
        header += b"\x04\x06" + _number(0) + _number(len(full)) + b"\x09" + b"".join(_number(len(p)) for p in packed) + b"\x00"
        header += b"\x07\x0b" + _number(len(full)) + b"\x00"
        header += b"".join(b"\x01\x21\x21\x01\x10" for _ in full)  # one coder, LZMA2, one property byte: 1 MiB
        header += b"\x0c" + b"".join(_number(len(d)) for _, d in full) + b"\x00"
        header += b"\x08\x0a\x01" + b"".join(struct.pack("<I", zlib.crc32(d)) for _, d in full) + b"\x00\x00"
    if entries:
        names = b"\x00" + b"".join(n.encode("utf-16-le") + b"\x00\x00" for n, _ in entries)
        header += b"\x05" + _number(len(entries))
        bits = lambda flags: bytes(sum(f << (7 - k) for k, f in enumerate(flags[i : i + 8])) for i in range(0, len(flags), 8))
        empty = [not d for _, d in entries]
        if any(empty):
            header += b"\x0e" + _number(len(bits(empty))) + bits(empty)
            files = bits([True] * sum(empty))
            header += b"\x0f" + _number(len(files)) + files
        header += b"\x11" + _number(len(names)) + names + b"\x00"
    header += b"\x00"
    body = b"".join(packed)
    start = struct.pack("<QQI", len(body), len(header) if entries else 0, zlib.crc32(bytes(header)) if entries else 0)
    return b"7z\xbc\xaf\x27\x1c\x00\x04" + struct.pack("<I", zlib.crc32(start)) + start + body + (bytes(header) if entries else b"")


def read_7z(data: bytes) -> Entries:
    """Reads what create_7z writes."""
    if data[:6] != b"7z\xbc\xaf\x27\x1c":
        raise ValueError("not a 7z archive")
    offset, size, crc = struct.unpack("<QQI", data[12:32])
    if not size:
        return []
    header = data[32 + offset : 32 + offset + size]
    if zlib.crc32(header) != crc:
        raise ValueError("damaged 7z header")
    at = 1

    def number() -> int:
        nonlocal at
        first, at = header[at], at + 1
        more = next((k for k in range(8) if not first & (0x80 >> k)), 8)
        n = int.from_bytes(header[at : at + more], "little")
        at += more
        return n if more == 8 else n | (first & ((0x80 >> more) - 1)) << (8 * more)

    datas: list[bytes] = []
    if header[at] == 4:
        at += 2
        pos, n = 32 + number(), number()
        at += 1
        sizes = [number() for _ in range(n)]
        at += 3
        n = number()
        at += 1 + 5 * n + 1
        lengths = [number() for _ in range(n)]
        at += 4
        crcs = struct.unpack_from(f"<{n}I", header, at)
        at += 4 * n + 2
        for s, length, c in zip(sizes, lengths, crcs, strict=True):
            d = lzma.decompress(data[pos : pos + s], lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}])
            if len(d) != length or zlib.crc32(d) != c:
                raise ValueError("damaged 7z stream")
            datas.append(d)
            pos += s
    at += 1
    n = number()
    empty = [False] * n
    names: list[str] = []
    while header[at]:
        kind, at = header[at], at + 1
        length = number()
        if kind == 0x0E:
            empty = [bool(header[at + k // 8] & 0x80 >> k % 8) for k in range(n)]
        elif kind == 0x11:
            names = header[at + 1 : at + length].decode("utf-16-le").split("\x00")[:n]
        at += length
    left = iter(datas)
    return [(name, b"" if e else next(left)) for name, e in zip(names, empty, strict=True)]


def create(fmt: str, entries: Entries) -> bytes | None:
    """The archive; None for a format that is none of FORMATS."""
    make = {"zip": create_zip, "tar.gz": create_tar_gz, "tar.xz": create_tar_xz, "7z": create_7z}.get(fmt)
    return make(unique_names(entries)) if make else None


def manifest(fmt: str, data: bytes) -> Entries:
    """The entries read back."""
    if fmt == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [(i.filename, z.read(i)) for i in z.infolist()]
    if fmt == "7z":
        return read_7z(data)
    with tarfile.open(fileobj=io.BytesIO(data), mode=f"r:{fmt[4:]}") as t:
        return [(m.name, t.extractfile(m).read()) for m in t.getmembers()]
