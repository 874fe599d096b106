"""Files by other writers: the JVM's image writers, and formats laid out by hand."""

import struct
import zlib

import numpy as np
import pytest

from fileloom.operators import images

SMOOTH = np.stack([*np.mgrid[0:30, 0:44] * 5 % 256, np.full((30, 44), 60), np.full((30, 44), 255)], 2).astype(np.uint8)


def java_image(jvm, a, kind=1):
    out = jvm.java.awt.image.BufferedImage(a.shape[1], a.shape[0], kind)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            r, g, b, t = (int(v) for v in a[y, x])
            v = t << 24 | r << 16 | g << 8 | b
            out.setRGB(x, y, v - (1 << 32) if v >> 31 else v)
    return out


def java_write(jvm, image, fmt, compression=None, quality=None, progressive=False):
    io = jvm.javax.imageio
    out = jvm.java.io.ByteArrayOutputStream()
    writer = io.ImageIO.getImageWritersByFormatName(fmt).next()
    param = writer.getDefaultWriteParam()
    if compression or quality is not None:
        param.setCompressionMode(2)
        if compression:
            param.setCompressionType(compression)
        if quality is not None:
            param.setCompressionQuality(quality)
    if progressive:
        param.setProgressiveMode(1)
    stream = io.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, io.IIOImage(image, None, None), param)
    stream.flush()
    stream.close()
    return bytes(out.toByteArray())


@pytest.fixture(scope="module")
def jvm(spark):
    return spark._jvm


def test_jvm_jpeg(jvm):
    """Baseline and progressive, with subsampled color."""
    image = java_image(jvm, SMOOTH)
    for progressive in (False, True):
        a = images.decode(java_write(jvm, image, "jpeg", quality=0.95, progressive=progressive), "jpg")
        assert np.abs(a.astype(int) - SMOOTH).mean() < 4


def test_jvm_png_and_gif(jvm):
    a = SMOOTH.copy()
    a[:, ::3, 3] = 0
    for progressive in (False, True):
        assert np.array_equal(images.decode(java_write(jvm, java_image(jvm, SMOOTH), "png", progressive=progressive), "png"), SMOOTH)
        assert np.array_equal(images.decode(java_write(jvm, java_image(jvm, a, 2), "png", progressive=progressive), "png"), a)
        few = (SMOOTH // 64 * 64).astype(np.uint8)
        few[..., 3] = 255
        assert np.array_equal(images.decode(java_write(jvm, java_image(jvm, few), "gif", progressive=progressive), "gif"), few)


@pytest.mark.parametrize("compression", [None, "LZW", "ZLib", "Deflate", "PackBits"])
def test_jvm_tiff(jvm, compression):
    data = java_write(jvm, java_image(jvm, SMOOTH), "tiff", compression)
    assert np.array_equal(images.decode(data, "tiff"), SMOOTH)


def test_jvm_bmp(jvm):
    assert np.array_equal(images.decode(java_write(jvm, java_image(jvm, SMOOTH), "bmp"), "bmp"), SMOOTH)
    two = np.where((np.indices((9, 13)).sum(0) % 2)[..., None], 255, 0).repeat(4, 2).astype(np.uint8)
    two[..., 3] = 255
    assert np.array_equal(images.decode(java_write(jvm, java_image(jvm, two, 12), "bmp"), "bmp"), two)  # one bit a pixel
    web = (SMOOTH // 51 * 51).astype(np.uint8)  # the JVM's default palette has these colors
    web[..., 3] = 255
    assert np.array_equal(images.decode(java_write(jvm, java_image(jvm, web, 13), "bmp", "BI_RLE8"), "bmp"), web)


def test_jvm_reads_ours(jvm):
    """TIFF and WebP have no other reader here; the JVM reads TIFF."""
    data = images.encode(SMOOTH, "tiff")
    seen = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    got = [[seen.getRGB(x, y) & 0xFFFFFF for x in range(0, 44, 7)] for y in range(0, 30, 7)]
    want = [[int(r) << 16 | int(g) << 8 | int(b) for r, g, b, _ in SMOOTH[y, ::7]] for y in range(0, 30, 7)]
    assert got == want


def test_png_by_hand():
    def png(head, rows, *more):
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        return images.PNG_MARK + chunk(b"IHDR", head) + b"".join(chunk(*m) for m in more) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    palette = png(struct.pack(">IIBBBBB", 3, 1, 2, 3, 0, 0, 0), b"\0\x18", (b"PLTE", bytes([1, 2, 3, 4, 5, 6, 7, 8, 9])), (b"tRNS", bytes([255, 9])))
    assert images.decode(palette, "png").tolist() == [[[1, 2, 3, 255], [4, 5, 6, 9], [7, 8, 9, 255]]]
    wide = png(struct.pack(">IIBBBBB", 2, 1, 16, 0, 0, 0, 0), b"\1" + struct.pack(">HH", 0x1234, 0x1111), (b"tRNS", struct.pack(">H", 0x2345)))
    assert images.decode(wide, "png").tolist() == [[[0x12, 0x12, 0x12, 255], [0x23, 0x23, 0x23, 0]]]
    grey = png(struct.pack(">IIBBBBB", 2, 2, 8, 4, 0, 0, 0), b"\0\1\2\3\4" + b"\4\1\1\1\1")
    assert images.decode(grey, "png").tolist() == [[[1, 1, 1, 2], [3, 3, 3, 4]], [[2, 2, 2, 3], [4, 4, 4, 5]]]


def test_tga_runs_and_icon_of_bmp():
    tga = struct.pack("<BBBHHBHHHHBB", 0, 0, 10, 0, 0, 0, 0, 0, 3, 2, 24, 0) + b"\x82\1\2\3" + b"\0\4\5\6" + b"\1\7\x08\x09\x0a\x0b\x0c"
    assert images.decode(tga, "tga")[..., :3].tolist() == [[[6, 5, 4], [9, 8, 7], [12, 11, 10]], [[3, 2, 1]] * 3]
    bmp = struct.pack("<IiiHHIIiiII", 40, 2, 4, 1, 24, 0, 0, 0, 0, 0, 0) + b"\1\2\3\4\5\6\0\0\7\x08\x09\x0a\x0b\x0c\0\0" + b"\x40\0\0\0\0\0\0\0"
    small = images.encode_png(np.zeros((1, 1, 4), np.uint8))
    ico = struct.pack("<HHH", 0, 1, 2) + b"".join(struct.pack("<BBBBHHII", w, h, 0, 0, 1, 24, len(d), at) for w, h, d, at in ((2, 2, bmp, 38), (1, 1, small, 38 + len(bmp)))) + bmp + small
    assert images.decode(ico, "ico").tolist() == [[[9, 8, 7, 255], [12, 11, 10, 255]], [[3, 2, 1, 255], [6, 5, 4, 0]]]


def test_hdr():
    head = b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y 1 +X 8\n"
    flat = bytes([128, 64, 0, 128]) * 8
    runs = b"\2\2\0\x08" + b"\x88\x80" + b"\x04\x40\x40\x40\x40\x84\x40" + b"\x88\0" + b"\x88\x80"
    for body in (flat, runs):
        assert images.decode(head + body, "hdr").tolist() == [[[128, 64, 0, 255]] * 8]


def test_dds():
    def dds(kind, block):
        return b"DDS " + struct.pack("<7I", 124, 0, 4, 4, 0, 0, 0) + bytes(44) + struct.pack("<II", 32, 4) + kind + bytes(40) + block

    color = struct.pack("<HHI", 0xF800, 0x001F, 0b11_10_01_00)
    a = images.decode(dds(b"DXT1", color), "dds")
    assert a.shape == (4, 4, 4) and a[0].tolist() == [[255, 0, 0, 255], [0, 0, 255, 255], [170, 0, 85, 255], [85, 0, 170, 255]]
    clear = images.decode(dds(b"DXT1", struct.pack("<HHI", 0x001F, 0xF800, 0b11_10)), "dds")
    assert clear[0, :2].tolist() == [[127, 0, 127, 255], [0, 0, 0, 0]]
    assert images.decode(dds(b"DXT3", b"\x0f\x8c" + bytes(6) + color), "dds")[0, :, 3].tolist() == [255, 0, 204, 136]
    assert images.decode(dds(b"DXT5", b"\xff\0" + (0 | 1 << 3 | 2 << 6 | 7 << 9).to_bytes(6, "little") + color), "dds")[0, :, 3].tolist() == [255, 0, 218, 36]


@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("packing", [0, 1, 2, 3])
def test_exr(packing, tiled):
    width, height = 5, 18
    rgb = {c: np.linspace(0, 1.2, width * height).reshape(height, width).astype(np.float32) * s for c, s in (("B", 0.5), ("G", 0.25), ("R", 1))}

    def packed(raw):
        if not packing:
            return raw
        a = np.frombuffer(raw, np.uint8)
        a = np.concatenate([a[::2], a[1::2]]).astype(int)
        a[1:] = (a[1:] - a[:-1] + 128) % 256
        b = a.astype(np.uint8).tobytes()
        out = zlib.compress(b) if packing > 1 else b"".join(struct.pack("b", -len(b[k : k + 100])) + b[k : k + 100] for k in range(0, len(b), 100))
        return out if len(out) < len(raw) else raw

    tag = lambda n, k, v: n.encode() + b"\0" + k.encode() + b"\0" + struct.pack("<I", len(v)) + v
    channels = b"".join(n.encode() + b"\0" + struct.pack("<iB3xii", kind, 0, 1, 1) for n, kind in (("B", 1), ("G", 2), ("R", 1))) + b"\0"
    tiles = tag("tiles", "tiledesc", struct.pack("<IIB", 4, 7, 1)) if tiled else b""
    head = b"\x76\x2f\x31\x01\2" + bytes([2 * tiled]) + b"\0\0" + tiles + tag("channels", "chlist", channels) + tag("compression", "compression", bytes([packing])) + tag("dataWindow", "box2i", struct.pack("<4i", 2, 3, 2 + width - 1, 3 + height - 1)) + b"\0"
    step = 16 if packing == 3 else 1
    blocks = []
    for j, i in [(j, i) for j in range(3) for i in range(2)] * tiled:
        raw = b"".join(rgb[c][k, 4 * i : 4 * i + 4].astype("<f4" if c == "G" else "<f2").tobytes() for k in range(7 * j, min(7 * j + 7, height)) for c in "BGR")
        body = packed(raw)
        blocks.append(struct.pack("<4iI", i, j, 0, 0, len(body)) + body)
    if tiled:
        blocks.append(struct.pack("<4iI", 0, 0, 1, 1, 0))  # a level that is not read
    for y in range(0, 0 if tiled else height, step):
        raw = b"".join(rgb[c][k].astype("<f4" if c == "G" else "<f2").tobytes() for k in range(y, min(y + step, height)) for c in "BGR")
        body = packed(raw)
        blocks.append(struct.pack("<iI", y + 3, len(body)) + body)
    at = len(head) + 8 * len(blocks)
    table = []
    for b in blocks:
        table.append(at)
        at += len(b)
    a = images.decode(head + struct.pack(f"<{len(table)}Q", *table) + b"".join(blocks), "exr")
    want = np.stack([np.rint(np.clip(rgb[c], 0, 1) * 255) for c in "RGB"], 2)
    assert np.abs(a[..., :3] - want).max() <= 1 and (a[..., 3] == 255).all()
