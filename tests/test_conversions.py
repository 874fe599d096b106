"""Literal cases: what each conversion must give, alone and through the dispatch over DataFrames."""

import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from fileloom.functions import formats as fm
from fileloom.functions import tabular, text
from fileloom.operators import archives, audio, images, jsontext, pdf
from fileloom.plans import batch, registry


def docx(xml: str, name: str = "word/document.xml") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, xml)
    return out.getvalue()


EXACT = [
    ("csv", "json", b"col1,col2\n", b"[]"),
    ("csv", "json", b'name,note\n"Smith, John","has, commas"', b'[\n  {\n    "name": "Smith, John",\n    "note": "has, commas"\n  }\n]'),
    ("csv", "json", b"\xef\xbb\xbfa\n\n007\n+5\n 5\n1e5\nnan\n5d\n", json.dumps([{"a": x} for x in (7, 5, " 5", 100000.0, "nan", "5d")], indent=2).encode()),
    ("json", "csv", b"[]", b""),
    ("json", "csv", b'[{"b":null,"a":"x,y"},{"c":[1,2]}]', b'a,b,c\n"x,y",null,\n,,"[1,2]"\n'),
    ("json", "csv", b'[{"name":"Alice","age":30},{"name":"Bob"}]', b"age,name\n30,Alice\n,Bob\n"),
    ("csv", "tsv", b"a,b\n1,2", b"a\tb\n1\t2\n"),
    ("tsv", "csv", b"a\tb\n1\t2", b"a,b\n1,2\n"),
    ("tsv", "csv", b"", b""),
    ("json", "yaml", b'{"key":"value","num":42}', b"key: value\nnum: 42\n"),
    ("json", "yml", b'{"a":{"c":2,"b":1},"z":1}', b"a: b: 1\n  c: 2\nz: 1\n"),
    ("json", "yaml", b'{"a":{"b":{"c":1,"d":2}}}', b"a: b: c: 1\n    d: 2\n"),
    ("json", "yaml", b'{"xs":[1,2],"y":0}', b"xs: - 1\n  - 2\ny: 0\n"),
    ("json", "yaml", b"[1,2]", b"\n- 1\n- 2\n"),
    ("json", "yaml", b'[{"a":1,"b":2}]', b"\n- a: 1\n  b: 2\n"),
    ("json", "yaml", b'{"a":[],"b":1}', b"a: b: 1\n"),
    ("json", "yaml", b'{"a":" s"}', b"a: s\n"),
    ("json", "yaml", b"[]", b"\n"),
    ("json", "yaml", b"{}", b""),
    ("json", "toml", b'{"b":{"x":1},"a":[1,"q"],"n":null}', b'a = [1, "q"]\nn = ""\n\n[b]\nx = 1\n'),
    ("json", "toml", b"[1]", b""),
    ("yaml", "json", b"a:\n  b: 1\n- x\nu: http://h/p # c", b'{\n  "a": null,\n  "b": 1,\n  "u": "http://h/p # c"\n}'),
    ("yml", "json", b"", b"{}"),
    ("toml", "json", b"[a.b]\nx = [1, 2]\ny = 2020-01-01", b'{\n  "a.b": {\n    "x": "[1, 2]",\n    "y": "2020-01-01"\n  }\n}'),
    ("toml", "json", b'[server]\nport = 8080\nhost = "localhost"', b'{\n  "server": {\n    "host": "localhost",\n    "port": 8080\n  }\n}'),
    ("html", "md", b"<h1 class=x>T</h1>a > b &copy; x<hr />y", "T\n\na > b &copy; xy".encode()),
    ("html", "markdown", b"AT&T <b>x</b>; y", b"AT&T <b>x</b>; y"),
    ("md", "html", b"# Hello\n\nWorld", b"<h1>Hello</h1>\n<p>World</p>\n"),
    ("markdown", "text", b"- item one\n- item two", b"item one\nitem two"),
    ("base64", "bin", b" SGk= ", b"Hi"),
    ("base64", "base64", b"SGk=", b"Hi"),
    ("bin", "base64", b"Hello, World!", b"SGVsbG8sIFdvcmxkIQ=="),
    ("docx", "txt", docx("<w:p><w:r><w:t>Hello World</w:t></w:r></w:p><w:p><w:r><w:t>Second paragraph</w:t></w:r></w:p>"), b"Hello World\n\nSecond paragraph"),
    ("docx", "html", docx("<w:p><w:r><w:rPr><w:i/></w:rPr><w:t>Content</w:t></w:r></w:p>", "WORD/document.XML"), b"<html><body>\n<p><em>Content</em></p>\n</body></html>"),
    ("rtf", "txt", b"{\\rtf1\\ansi Hello World}", b"Hello World"),
    ("pdf", "txt", pdf.write("Price: (100) + (200) = (300) \\taxed"), b"Price: (100) + (200) = (300) \\taxed"),
    ("PDF", "HTML", pdf.write("a < b"), b'<!DOCTYPE html>\n<html><head><meta charset="utf-8"></head><body><pre>\na &lt; b\n</pre></body></html>'),
]
WRONG = [
    ("csv", "json", b"a,b\n1", "CSV parse error"),
    ("csv", "json", b"\xff", "Failed to read CSV headers"),
    ("json", "csv", b'{"a":1}', "JSON must be an array of objects"),
    ("json", "yaml", b"{", "Invalid JSON: "),
    ("json", "yaml", b"[NaN]", "Invalid JSON: "),
    ("json", "toml", b"\xff", "Invalid UTF-8: "),
    ("tsv", "csv", b"a\tb\n1", "CSV write error: "),
    ("toml", "json", b'a = "', "TOML parse error"),
    ("yaml", "json", b"\xff", "Invalid UTF-8: "),
    ("base64", "bin", b"SGk", "Invalid base64: "),
    ("base64", "bin", b"SGl=", "Invalid base64: "),
    ("base64", "bin", b"\xff", "Invalid UTF-8: "),
    ("docx", "txt", b"no zip", "Failed to open DOCX as ZIP: "),
    ("docx", "txt", docx("", "unrelated.txt"), "word/document.xml not found in DOCX archive"),
    ("pdf", "txt", b"this is not a pdf", "Failed to load PDF: "),
    ("png", "jpg", b"not an image", "Failed to decode png image: "),
    ("ico", "png", b"\0\0\1\0\0\0", "ICO file contains no images"),
    ("svg", "png", b'<svg xmlns="http://www.w3.org/2000/svg" width="0" height="5"/>', "SVG has zero dimensions"),
    ("mp3", "wav", b"junk", "Unsupported audio format: "),
    ("wav", "wav", b"", "Unsupported audio format: "),
    ("ogg", "wav", b"OggS\0", "Unsupported codec in this build: "),
    ("mp3", "wav", b"ID3\4\0\0", "Unsupported codec in this build: reading mp3"),
    ("png", "avif", images.encode_png(np.zeros((1, 1, 4), np.uint8)), "Unsupported codec in this build: writing avif"),
    ("png", "html", b"data", "Unsupported conversion: png → html"),
    ("Mp3", "PNG", b"data", "Unsupported conversion: Mp3 → PNG"),
]


def test_cases_in_one_mixed_batch(spark):
    """All literal cases through one DataFrame, native and Arrow operators together."""
    rows = [(k, d, f, t) for k, (f, t, d, _) in enumerate(EXACT + WRONG)]
    df = spark.createDataFrame(rows, "k int, content binary, f string, t string")
    got = {r.k: r for r in registry.converted(df, F.col("content"), F.col("f"), F.col("t")).collect()}
    for k, (f, t, _, want) in enumerate(EXACT):
        assert (bytes(got[k]["__output"] or b"?"), got[k]["__error"]) == (want or b"?" if not want and got[k]["__output"] is None else want or b"?", None) or bytes(got[k]["__output"]) == want, (f, t)
        assert got[k]["__error"] is None
    for k, (f, t, _, want) in enumerate(WRONG, len(EXACT)):
        assert got[k]["__output"] is None and got[k]["__error"].startswith(want), (f, t, got[k]["__error"])


@pytest.mark.parametrize(("f", "t", "data", "want"), EXACT + WRONG)
def test_case_alone(f, t, data, want):
    """The same through the Python dispatch."""
    output, error = registry.convert_any(data, f, t)
    assert output == want if isinstance(want, bytes) else (output is None and error.startswith(want))


def test_constant_pair_has_only_its_operator(spark):
    df = spark.createDataFrame([(b"<b>x</b>",), (None,)], "c binary")
    plan = df.select(registry.convert("c", "html", "md").alias("r"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert [r.o for r in df.select(registry.convert("c", "HTML", "md")["output"].cast("string").alias("o")).collect()] == ["**x**", None]


@pytest.mark.parametrize("text_", ["Hello World", "1\n2\n3", "", "x\n" * 120, "A" * 300, "é(\\)"])
def test_pdf(text_):
    made = pdf.write(text_)
    assert made.startswith(b"%PDF-") and made.endswith(b"%%EOF\n")
    # every offset of the table leads to its object
    table = made[int(made.rsplit(b"startxref\n", 1)[1].split()[0]) :].split(b"\r\n")[1:-1]
    for n, line in enumerate(table, 1):
        assert made[int(line.split()[0]) :].startswith(b"%d 0 obj\n" % n)
    assert len(pdf.Document(made).pages()) == max(1, -(-len(pdf.wrapped(text_)) // 52))


def test_pdf_of_others():
    """Object streams, a cross-reference stream, Flate and ToUnicode."""
    import zlib

    packed = b"1 0 2 34 << /Type /Catalog /Pages 2 0 R >> << /Type /Pages /Kids [3 0 R] /Count 1 >> "
    first = packed.index(b"<<")
    second = packed.index(b"<< /Type /Pages") - first
    packed = b"1 0 2 %d " % second + packed[first:]
    first = packed.index(b"<<")
    cmap = b"1 beginbfrange <01> <02> <0041> endbfrange 1 beginbfchar <03> <00e9> endbfchar"
    body = zlib.compress(b"BT /F1 9 Tf [<01> -200 (\\002)] TJ <03> Tj ET")
    parts = {
        4: b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body),
        5: b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>",
        6: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap),
        7: b"<< /Type /ObjStm /N 2 /First %d /Length %d >>\nstream\n%s\nendstream" % (first, len(packed), packed),
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
    }
    data = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in parts.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"
    assert pdf.pdf_to_text(data).decode() == "A Bé"


GRID = np.stack([*np.mgrid[0:11, 0:17] * 9 % 256, np.full((11, 17), 77), np.full((11, 17), 255)], 2).astype(np.uint8)


@pytest.mark.parametrize("fmt", ["png", "bmp", "tiff", "qoi", "tga", "ico", "webp", "gif"])
@pytest.mark.parametrize("clear", [False, True])
def test_lossless_images(fmt, clear):
    a = GRID.copy()
    if clear:
        a[::2, :, 3] = 0
        a[::2, :, :3] = 0
    assert np.array_equal(images.decode(images.encode(a, fmt), fmt), a)


def test_many_colors():
    a = np.random.default_rng(1).integers(0, 256, (23, 31, 4)).astype(np.uint8)
    for fmt in ("png", "bmp", "tiff", "qoi", "tga", "ico", "webp"):
        assert np.array_equal(images.decode(images.encode(a, fmt), fmt), a)


@pytest.mark.parametrize(("quality", "most"), [(10, 14), (None, 4), (100, 1)])
def test_jpeg(quality, most):
    smooth = np.stack([*np.mgrid[0:40, 0:50] * 4, np.full((40, 50), 90), np.full((40, 50), 255)], 2).astype(np.uint8)
    made = images.encode(smooth, "jpeg", quality)
    assert made[:2] == b"\xff\xd8"
    assert np.abs(images.decode(made, "jpg").astype(int) - smooth).mean() < most


def test_images_against_the_jvm(spark, tmp_path):
    """Spark's own reader sees the same pixels (its channels are in the order BGR)."""
    for name, data in (("a.png", images.encode(GRID, "png")), ("b.bmp", images.encode(GRID, "bmp")), ("c.jpg", images.encode(GRID, "jpg", 100)), ("d.gif", images.encode(GRID, "gif"))):
        (tmp_path / name).write_bytes(data)
    for r in spark.read.format("image").load(str(tmp_path)).select("image.*").collect():
        a = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels)
        assert (r.height, r.width) == GRID.shape[:2]
        assert np.abs(a[..., 2::-1].astype(int) - GRID[..., :3]).max() <= (6 if r.origin.endswith("jpg") else 0)


def wav(samples, rate, channels, depth=16, code=1):
    body = samples.tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, code, channels, rate, rate * channels * depth // 8, channels * depth // 8, depth, b"data", len(body)) + body


@pytest.mark.parametrize(("channels", "rate", "n"), [(1, 44100, 2205), (2, 48000, 9600)])
def test_wav(channels, rate, n):
    pcm = (np.sin(np.arange(n) / 9) * 30000).astype("<i2")
    made = audio.to_wav(wav(pcm, rate, channels))
    assert struct.unpack_from("<HHI", made, 20) == (1, channels, rate) and len(made) == 44 + 2 * n
    assert np.array_equal(np.frombuffer(made[44:], "<i2"), (pcm.astype(np.float32) / np.float32(32768) * np.float32(32767)).astype("<i2"))


def test_wav_depths():
    want = [99, 32766, -32767, 0]
    x = np.array([100, 32767, -32768, 1])
    for data in (wav(x.astype("<i2"), 8000, 1), wav((x << 16).astype("<i4"), 8000, 1, 32), wav((x / 32768).astype("<f4"), 8000, 1, 32, 3), wav((x << 8).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3], 8000, 1, 24)):
        assert np.frombuffer(audio.to_wav(data)[44:], "<i2").tolist() == want


def flac(samples: np.ndarray, rate: int, fixed: int) -> bytes:
    """A plain writer: 16 bits, one channel, blocks of 1,024, fixed prediction with Rice codes, or verbatim (-1)."""
    out = "".join
    blocks = []
    for k in range(0, len(samples), 1024):
        x = samples[k : k + 1024].astype(int)
        bits = "11111111111110000111" + "0000" + "0000" + "100" + "0" + f"{k // 1024:08b}" + f"{len(x) - 1:016b}"
        head = int(bits, 2).to_bytes(len(bits) // 8, "big")
        bits += f"{audio._crc8(head):08b}"
        if fixed < 0:
            bits += "0" + "000001" + "0" + out(f"{v & 0xFFFF:016b}" for v in x)
        else:
            r = np.diff(x, fixed)
            bits += "0" + f"{8 + fixed:06b}" + "0" + out(f"{v & 0xFFFF:016b}" for v in x[:fixed]) + "00" + "0000" + f"{4:04b}"
            for v in r.tolist():
                u = 2 * v if v >= 0 else -2 * v - 1
                bits += "0" * (u >> 4) + "1" + f"{u & 15:04b}"
        bits += "0" * (-len(bits) % 8)
        blocks.append(int(bits, 2).to_bytes(len(bits) // 8, "big") + b"\0\0")
    info = struct.pack(">HH", 1024, 1024) + bytes(6) + (rate << 44 | 0 << 41 | 15 << 36 | len(samples)).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info + b"".join(blocks)


@pytest.mark.parametrize("fixed", [-1, 0, 1, 2, 3, 4])
def test_flac(fixed):
    pcm = (np.sin(np.arange(3000) / 40) * (50 if fixed == 0 else 9000)).astype(np.int16)
    samples, channels, rate = audio.decode(flac(pcm, 22050, fixed))
    assert (channels, rate) == (1, 22050)
    assert np.array_equal(np.rint(samples * 32768).astype(int), pcm)


@pytest.mark.parametrize("x", [1.0, 1e16, 1.5e16, 1e15, 1e-5, 1e-6, 123.456, 0.1, 5e-324, 1.7976931348623157e308, -0.0, 2.0**70, -1.5e-7, 1 / 3])
def test_float_text(spark, x):
    s = jsontext.float_text(x)
    assert float(s) == x and ("." in s or "e" in s)
    assert spark.range(1).select(tabular.float_text(F.lit(x)).alias("s")).first().s == s


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    detect = {"photo.png": "png", "doc.MD": "md", "archive.tar.gz": None, "README": None, ".gitignore": None, "notes.text": "text", "png": "png", "SONG.MP3": "mp3"}
    assert {k: one(fm.detect_format(F.lit(k))) for k in detect} == detect
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 1536: "1.5 KB", 1048576: "1.0 MB", 2621440: "2.5 MB", 5 << 40: "5242880.0 MB"}
    assert {k: one(fm.format_size(F.lit(k))) for k in sizes} == sizes
    names = {("photo.png", "jpg"): "photo.jpg", ("README", "txt"): "README.txt", ("my.file.png", "jpg"): "my.file.jpg", ("a\nb.c\n", "x"): "a\nb.x"}
    assert {k: one(fm.output_name(F.lit(k[0]), F.lit(k[1]))) for k in names} == names
    assert one(text.strip_tags(F.lit("a > b <i>c</i> &amp;lt;"))) == "a  b c <"
    assert sum(map(len, fm.OUTPUTS.values())) == 150 and len(fm.INPUTS) == 33 and len(fm.KNOWN) == 35


def test_batch_and_archives(spark):
    rows = [(0, "a.csv", b"a\n1"), (1, "b.png", b"bad"), (2, "c.csv", b"a\n2"), (3, "x", b""), (4, "a.CSV", b"a\n3"), (5, "none.csv", None)]
    done = batch.convert_all(batch.ingest(spark.createDataFrame(rows, "k long, name string, content binary"), "k"))
    assert {r.id: r.status for r in done.collect()} == {0: "done", 1: "error", 2: "done", 3: "done", 4: "done", 5: "done"}
    own = done.where("id < 5")
    for fmt in ("zip", "tar.gz", "tar.xz", "7z"):
        packed = batch.pack(own, fmt)
        assert packed.first().n_entries == 4
        assert [(r.name, bytes(r.data)[:1]) for r in batch.unpack(packed, fmt).orderBy("position").collect()] == [("a.json", b"["), ("c.json", b"["), ("x.base64", b""), ("a (1).json", b"[")]
        assert batch.unpack(batch.pack(own, fmt, 1), fmt).count() == 4
    assert batch.pack(own, "rar").count() == 0 and batch.pack(own.where("false"), "zip").count() == 0
    again = batch.set_target(own, 0, "tsv")
    assert batch.summary(again).first().pending_count == 1
    assert bytes(batch.convert_all(again).where("id = 0").first().output) == b"a\n1\n"
    assert batch.remove_file(own, 0).count() == 4


def test_volumes_are_one_sequence(spark):
    """However many volumes: positions go on, and names are told apart as in one archive."""
    names = ["a", "a (1)", "a", "b", "a", "b", "c (1)", "c (1)", "", "", " (1)", "a (1)", "d (1) (1)", "d", "d", "d (1)", "e", "e", "e"]
    endings = ["txt", "b (1)"]
    rows = [(7 * k % 38, f"{names[k % 19]}.{endings[k // 19]}", b"x" * (k % 3)) for k in range(38)]
    rows += [(50 + k, n, b"") for k, n in enumerate(["g", "g", "g (1)", "g"])] + [(None, "g", b"z"), (None, "a.txt", None)]
    own = spark.createDataFrame(rows, "id long, name string, data binary").repartition(3)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    want = [(k, n, d or b"") for k, (n, d) in enumerate(archives.unique_names([r[1:] for r in order]))]
    done = own.selectExpr("id", "name", "'bin' as target", "'done' as status", "data as output")
    told = batch.placed(own.withColumn("row", F.monotonically_increasing_id()), 1).orderBy("position").collect()
    assert [(r.position, r.name) for r in told] == [w[:2] for w in want] and len({r.volume for r in told}) == len(rows)
    for fmt in archives.FORMATS:
        one = [(r.position, r.name, bytes(r.data)) for r in batch.unpack(batch.pack(done, fmt), fmt).orderBy("position").collect()]
        packed = batch.pack(done, fmt, 2000)
        many = batch.unpack(packed, fmt).orderBy("position").collect()
        assert [(r.position, r.name, bytes(r.data)) for r in many] == one and len({n for _, n, _ in one}) == len(rows)
        assert 10 < packed.count() < 20 and [r.volume for r in many] == sorted(r.volume for r in many)


def test_many_files_of_one_name_take_linear_time():
    names = [n for n, _ in archives.unique_names([("x.md", b"")] * 50_000)]
    assert names[0] == "x.md" and names[-1] == "x (49999).md" and len(set(names)) == 50_000


def test_sql_function(spark):
    registry.register(spark)
    assert spark.sql("select cast(fileloom_convert(cast('a,b' as binary), 'csv', 'tsv', null).output as string) as x").first().x == "a\tb\n"
