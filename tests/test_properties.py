"""Random inputs: round trips, and column expressions against the scanners that say the same in Python."""

import random
import struct

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fileloom.functions import paged, tabular, text, tree
from fileloom.operators import archives, images, jsontext, markdown, markup, office, pdf
from fileloom.operators import tabular as csv_files
from fileloom.operators import tree as tree_files
from fileloom.operators.errors import ConversionError

PLAIN = st.text(st.characters(exclude_categories=("Cs",)), max_size=20)
VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False, allow_infinity=False) | PLAIN, lambda x: st.lists(x, max_size=4) | st.dictionaries(PLAIN, x, max_size=4), max_leaves=12)


@given(VALUES)
def test_json_reads_back(value):
    for printed in (jsontext.pretty(value), jsontext.compact(value)):
        back = jsontext.parse(printed)
        assert back == value and jsontext.compact(back) == jsontext.compact(value)


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_floats_read_back(x):
    s = jsontext.float_text(x)
    assert struct.pack("d", float(s)) == struct.pack("d", x)


@given(st.lists(st.lists(PLAIN, min_size=2, max_size=2), min_size=1, max_size=6))
def test_csv_reads_back(rows):
    rows = [[c.lstrip("﻿") for c in r] for r in rows]
    header, body = csv_files.records("".join(map(csv_files.record, rows)).encode())
    assert [header, *body] == rows


@given(st.lists(st.tuples(st.text("ab./é ", min_size=1, max_size=8).filter(lambda s: s.strip("./ ")), st.binary(max_size=300)), max_size=5))
@settings(max_examples=40)
def test_archives_read_back(entries):
    entries = archives.unique_names([(n.strip("/").replace("//", "/"), d) for n, d in entries])
    for fmt in archives.FORMATS:
        assert archives.manifest(fmt, archives.create(fmt, entries)) == entries


@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32), st.sampled_from([2, 30, 256]))
@settings(max_examples=60, deadline=None)
def test_images_read_back(width, height, seed, colors):
    a = np.random.default_rng(seed).integers(0, colors, (height, width, 4)).astype(np.uint8)
    for fmt in ("png", "bmp", "qoi", "tga", "tiff", "ico", "webp"):
        if fmt == "bmp" and not a[..., 3].any():
            continue
        assert np.array_equal(images.decode(images.encode(a, fmt), fmt), a), fmt


@given(st.binary(max_size=200))
def test_junk_is_an_error(data):
    for fmt in (*images._decoders(), "ico"):
        try:
            images.decode(data, fmt)
        except ConversionError:
            pass
    for read in (pdf.pdf_to_text, office.docx_to_text, office.rtf_to_text, csv_files.csv_to_json, tree_files.json_to_yaml):
        try:
            read(data)
        except ConversionError:
            pass


@given(st.text("ab (\\)\n", max_size=400))
def test_pdf_reads_back(s):
    assert pdf.pdf_to_text(pdf.write(s)).decode() == "\n".join("".join(pdf.wrapped(s)[k : k + 52]) for k in range(0, len(pdf.wrapped(s)), 52)).strip()


@given(st.text("ab*_`[]()<>!#-+>\\&;1. \t\n'\"", max_size=120))
@settings(max_examples=300, deadline=None)
def test_markdown_never_fails(s):
    out = markdown.render(s)
    assert markdown.render(s) == out and "<script" not in out


def random_texts(pieces, n=400, most=14, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(pieces, k=rng.randint(0, most))) for _ in range(n)]


def compare(spark, texts, expression, plain):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", expression(F.col("t")).alias("x")).collect()
    got = {r.k: r.x for r in rows}
    for k, t in enumerate(texts):
        try:
            want = plain(t)
        except ConversionError:
            want = None
        assert got[k] == want, repr(t)


def test_markup_expressions(spark):
    texts = random_texts(["<h1>", "</H1>", "<p", ">", "<", "<br />", "< b >", "</b>", "&amp;", "&lt", ";", "&", "&#39;", "x", " ", "\n", " ", "é", "<a href='x'>", "&amp;lt;", "hr/>"])
    compare(spark, texts, text.html_to_markdown, markup.html_to_markdown)
    compare(spark, texts, text.strip_tags, markup.strip_tags)
    compare(spark, texts, text.decode_xml, office.decode_xml)
    compare(spark, texts, text.html_escape, pdf.html_escape)
    compare(spark, texts, text.pdf_string, pdf.escaped)


def test_wordml_expression(spark):
    texts = random_texts(["<w:p>", "<w:p w:x='1'>", "<w:p/>", "</w:p>", "<w:t>", "<w:t xml:space='preserve'>", "</w:t>", "<w:tbl>", "<w:tab/>", "<w:br/>", "<w:br w:type='page'/>", "<w:r>", "a", " b ", "&amp;lt;", "\n", "<w:pPr>"], 800)
    compare(spark, texts, paged.wordml_text, office.xml_to_text)


def test_tree_expressions(spark):
    lines = ["a: 1", "b:x", " - c: d", "a:", "# n", "---", "", "k: \"q\"", "k: 'q'", "x: 1.50", "y: 1e400", "z: -inf", "é: ~", "u: http://h:1", "t: true", "n: +007", "f: .5", "s: \"a\\b\"", ":", " : v"]
    texts = [t for n in ("\n", "\r\n") for t in (n.join(random.Random(k).choices(lines, k=k % 9)) + n * (k % 2) for k in range(200))]
    compare(spark, texts, tree.yaml_to_json, lambda t: tree_files.yaml_to_json(t.encode()).decode())
    lines = ["a = 1", "b=x", "[s]", "[ s ]", "[t.u]", "[[v]]", "# n", "", "k = \"q\"", "k = 'q'", "x = 1.50", "y = 1e400", "z = [1, 2]", "s = 1", "t = true", "n = +007", "q = \"", "= v", "[]", "["]
    texts = ["\n".join(random.Random(k).choices(lines, k=k % 9)) for k in range(400)]
    compare(spark, texts, lambda c: tree.toml_to_json(c)["output"], lambda t: tree_files.toml_to_json(t.encode()).decode())


def test_flat_objects(spark):
    """Values of all kinds, strings that look like others included, as the full operators write them."""
    values = ["1", "-7", "0.5", "1e5", "1.50", "123456789012345678", "\"5\"", "\"true\"", "\"\"", "\"1e5\"", "\"null\"", "\"a b\"", "\"é\"", "true", "false", "null"]
    texts = ["{" + ", ".join(f'"{k}": {v}' for k, v in zip("zyxab", random.Random(n).choices(values, k=n % 6), strict=False)) + "}" for n in range(300)]
    compare(spark, texts, tree.flat_json_to_yaml, lambda t: tree_files.json_to_yaml(t.encode()).decode())
    compare(spark, texts, tree.flat_json_to_toml, lambda t: tree_files.json_to_toml(t.encode()).decode())


def test_large_toml(spark):
    """20,000 members in 5,000 sections: no member looks through the others."""
    import time

    body = "\n".join(f"[s{k}]\n" + "\n".join(f"k{j} = {j}" for j in range(4)) for k in range(5000))
    began = time.time()
    compare(spark, [body], lambda c: tree.toml_to_json(c)["output"], lambda t: tree_files.toml_to_json(t.encode()).decode())
    assert time.time() - began < 30


def test_table_expressions(spark):
    texts = random_texts(["a", "\t", "\n", "\r\n", '"', ",", " ", "é"], 600)
    compare(spark, texts, lambda c: tabular.tsv_to_csv(c)["output"], lambda t: csv_files.tsv_to_csv(t.encode()).decode())
    compare(spark, texts, tabular.lines, csv_files.rust_lines)
    compare(spark, texts, paged.wrapped, pdf.wrapped)
    cells = random_texts(["1", "0", "-", "+", ".", "e", "5", " ", "x", "inf", "9999999999"], 800, 5) + [repr(random.Random(k).uniform(-1, 1) * 10 ** random.Random(k + 1).randint(-320, 308)) for k in range(300)]
    compare(spark, cells, tabular.cell_json, lambda t: jsontext.quote(t) if jsontext.number(t) is None else jsontext.compact(jsontext.number(t)))
    compare(spark, random_texts([chr(c) for c in range(128)] + ["é", "\U0001f600"], 200), tabular.json_quote, jsontext.quote)
