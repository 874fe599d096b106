"""Dispatch of conversions: which operator a pair of formats has, and its expression.

An operator is a column expression where Catalyst can say it, else one Arrow UDF for all of them. In a batch of mixed
pairs the UDF is handed the contents of its own rows only, in one pass over the files.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fileloom.functions import formats as fm
from fileloom.functions import tabular, text, tree
from fileloom.operators import audio, images, markdown, markup, office, pdf, svg
from fileloom.operators import tabular as csv_files
from fileloom.operators import tree as tree_files
from fileloom.operators.errors import ConversionError

RESULT = "struct<output: binary, error: string>"
_RESULT = pa.struct([("output", pa.binary()), ("error", pa.string())])

#: Pairs of formats in the order in which they are looked up: (from, to, operator); None stands for any format.
MD, TXT, YAML = ("md", "markdown"), ("txt", "text"), ("yaml", "yml")
PAIRS: tuple[tuple[tuple[str, ...] | None, tuple[str, ...] | None, str], ...] = (
    (fm.IMAGE_INPUTS, fm.IMAGE_OUTPUTS, "image"),
    (("svg",), ("png",), "svg_to_png"),
    (MD, ("html",), "markdown_to_html"),
    (MD, TXT, "markdown_to_text"),
    (MD, ("pdf",), "markdown_to_pdf"),
    (("html",), MD, "html_to_markdown"),
    (("html",), ("pdf",), "html_to_pdf"),
    (("docx",), TXT, "docx_to_text"),
    (("docx",), ("html",), "docx_to_html"),
    (("rtf",), TXT, "rtf_to_text"),
    (("pdf",), TXT, "pdf_to_text"),
    (("pdf",), ("html",), "pdf_to_html"),
    (TXT, ("pdf",), "text_to_pdf"),
    (("csv",), ("json",), "csv_to_json"),
    (("json",), ("csv",), "json_to_csv"),
    (("csv",), ("tsv",), "csv_to_tsv"),
    (("tsv",), ("csv",), "tsv_to_csv"),
    (fm.AUDIO_INPUTS, ("wav",), "audio_to_wav"),
    (("base64",), None, "base64_decode"),
    (None, ("base64",), "base64_encode"),
    (("json",), YAML, "json_to_yaml"),
    (YAML, ("json",), "yaml_to_json"),
    (("toml",), ("json",), "toml_to_json"),
    (("json",), ("toml",), "json_to_toml"),
)

FILES: dict[str, Callable[[bytes], bytes]] = {
    "svg_to_png": svg.svg_to_png, "markdown_to_html": markdown.markdown_to_html, "markdown_to_text": markup.markdown_to_text, "markdown_to_pdf": markup.markdown_to_pdf,
    "html_to_pdf": markup.html_to_pdf, "docx_to_text": office.docx_to_text, "docx_to_html": office.docx_to_html, "rtf_to_text": office.rtf_to_text,
    "pdf_to_text": pdf.pdf_to_text, "pdf_to_html": pdf.pdf_to_html, "text_to_pdf": pdf.text_to_pdf, "csv_to_json": csv_files.csv_to_json,
    "json_to_csv": csv_files.json_to_csv, "csv_to_tsv": csv_files.csv_to_tsv, "audio_to_wav": audio.to_wav, "json_to_yaml": tree_files.json_to_yaml,
    "json_to_toml": tree_files.json_to_toml,
}


def operator_of(from_fmt: Column, to_fmt: Column) -> Column:
    """The operator's name; null for a pair that has none. Both formats in lower case."""
    out = F
    for source, target, name in PAIRS:
        fits = F.lit(True)
        fits = fits & from_fmt.isin(*source) if source else fits
        fits = fits & to_fmt.isin(*target) if target else fits
        out = out.when(fits, name)
    return out.otherwise(F.lit(None).cast("string"))


def _ok(output: Column) -> Column:
    return F.struct(output.cast("binary").alias("output"), F.lit(None).cast("string").alias("error"))


def _of_text(content: Column, convert: Callable[[Column], Column]) -> Column:
    """convert on the text of valid UTF-8; its result is a string or a struct(output, error)."""
    valid = text.utf8(content)
    done = convert(valid)
    return F.when(valid.isNull(), F.struct(F.lit(None).cast("binary").alias("output"), F.lit("Invalid UTF-8: not a valid byte sequence").alias("error"))).otherwise(done)


def _paired(result: Column) -> Column:
    return F.struct(result["output"].cast("binary").alias("output"), result["error"].alias("error"))


NATIVE: dict[str, Callable[[Column], Column]] = {
    "html_to_markdown": lambda c: _of_text(c, lambda t: _ok(F.encode(text.html_to_markdown(t), "UTF-8"))),
    "tsv_to_csv": lambda c: _of_text(c, lambda t: _paired(tabular.tsv_to_csv(t))),
    "base64_encode": lambda c: _ok(F.encode(text.base64_encode(c), "UTF-8")),
    "base64_decode": lambda c: _paired(text.base64_decode(c)),
    "yaml_to_json": lambda c: _of_text(c, lambda t: _ok(F.encode(tree.yaml_to_json(t), "UTF-8"))),
    "toml_to_json": lambda c: _of_text(c, lambda t: _paired(tree.toml_to_json(t))),
}


def convert_bytes(data: bytes, operator: str, from_fmt: str, to_fmt: str, quality: int | None) -> tuple[bytes | None, str | None]:
    """(output, error) of one file; nothing is raised."""
    try:
        if operator == "image":
            return images.convert_image(data, from_fmt, to_fmt, quality), None
        return FILES[operator](data), None
    except ConversionError as e:
        return None, str(e)
    except Exception as e:  # noqa: BLE001  a file that a codec did not foresee must not cost the job
        return None, f"Conversion failed: {type(e).__name__}: {e}"


def _files_udf():
    @F.arrow_udf(RESULT)
    def convert(content: pa.Array, operator: pa.Array, from_fmt: pa.Array, to_fmt: pa.Array, quality: pa.Array) -> pa.Array:
        out = []
        for data, op, f, t, q in zip(content, operator, from_fmt, to_fmt, quality, strict=True):
            if not data.is_valid or not op.is_valid:
                out.append(None)
                continue
            output, error = convert_bytes(data.as_py(), op.as_py(), f.as_py(), t.as_py(), q.as_py())
            out.append({"output": output, "error": error})
        return pa.array(out, _RESULT)

    return convert


def convert(content: Column | str, from_fmt: Column | str, to_fmt: Column | str, quality: Column | None = None) -> Column:
    """struct(output, error) of each file; from_fmt and to_fmt are columns, or format names that are the same for all.

    A null content gives nulls. With names, only the one operator's expression is in the plan. To hand results of mixed
    formats to another UDF use ``converted``: Spark does not plan a UDF whose argument holds lambdas.
    """
    c = F.col(content) if isinstance(content, str) else content
    q = (quality if quality is not None else F.lit(None)).cast("int")
    if isinstance(from_fmt, str) and isinstance(to_fmt, str):
        f, t = from_fmt.lower(), to_fmt.lower()
        name = next((n for s, d, n in PAIRS if (s is None or f in s) and (d is None or t in d)), None)
        if name is None:
            return F.when(c.isNotNull(), _unsupported(F.lit(from_fmt), F.lit(to_fmt)))
        done = NATIVE[name](c) if name in NATIVE else _files_udf()(c, F.lit(name), F.lit(f), F.lit(t), q)
        return F.when(c.isNotNull(), done)
    source, target = (F.lit(x) if isinstance(x, str) else x for x in (from_fmt, to_fmt))
    f, t = F.lower(source), F.lower(target)
    op = operator_of(f, t)
    native = op.isin(*NATIVE)
    out = F.when(c.isNull(), F.lit(None)).when(op.isNull(), _unsupported(source, target))
    for name, expression in NATIVE.items():
        out = out.when(op == name, expression(c))
    return out.otherwise(_files_udf()(F.when(~native, c), op, f, t, q))


def converted(df: DataFrame, content: Column, from_fmt: Column, to_fmt: Column, quality: Column | None = None) -> DataFrame:
    """df with __output and __error. A generator computes them once a row, however often they are used or filtered by later."""
    nothing = F.struct(F.lit(None).cast("binary").alias("output"), F.lit(None).cast("string").alias("error"))
    return df.select("*", F.inline(F.array(F.coalesce(convert(content, from_fmt, to_fmt, quality), nothing))).alias("__output", "__error"))


def _unsupported(source: Column, target: Column) -> Column:
    return F.struct(F.lit(None).cast("binary").alias("output"), F.concat(F.lit("Unsupported conversion: "), source, F.lit(" → "), target).alias("error"))


def parse_config(config: Column | str) -> Column:
    """struct(from, to, quality, error) of a JSON request: two strings, and a quality of 0 to 255 or none; other keys are ignored."""
    c = F.col(config) if isinstance(config, str) else config
    v = F.try_parse_json(c)
    field = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    quality = F.when(kind("quality") == "BIGINT", field("quality", "int"))
    no_quality = field("quality", "variant").isNull() | (kind("quality") == "VOID")
    problem = (
        F.when(v.isNull(), "not a JSON object")
        .when(F.coalesce(kind("from"), F.lit("")) != "STRING", "missing field `from`")
        .when(F.coalesce(kind("to"), F.lit("")) != "STRING", "missing field `to`")
        .when(~no_quality & ~F.coalesce(quality.between(0, 255), F.lit(False)), "quality is no number from 0 to 255")
    )
    bad = problem.isNotNull()
    return F.struct(
        F.when(~bad, field("from", "string")).alias("from"), F.when(~bad, field("to", "string")).alias("to"), F.when(~bad, quality.cast("smallint")).alias("quality"),
        F.concat(F.lit("Invalid config: "), problem).alias("error"),
    )


def convert_with_config(df: DataFrame, content: str = "content", config: str = "config") -> DataFrame:
    """df with output and error: each row's file converted as its JSON request says."""
    asked = df.select("*", F.inline(F.array(parse_config(config))).alias("__from", "__to", "__quality", "__problem"))
    done = converted(asked, F.when(F.col("__problem").isNull(), F.col(content)), F.col("__from"), F.col("__to"), F.col("__quality"))
    return done.withColumn("output", F.col("__output")).withColumn("error", F.coalesce("__problem", "__error")).drop("__from", "__to", "__quality", "__problem", "__output", "__error")


def register(spark: SparkSession) -> None:
    """SQL functions of the Arrow tier: fileloom_convert(content, from, to, quality) as struct(output, error)."""

    @F.arrow_udf(RESULT)
    def fileloom_convert(content: pa.Array, from_fmt: pa.Array, to_fmt: pa.Array, quality: pa.Array) -> pa.Array:
        out = []
        for row in zip(content, from_fmt, to_fmt, quality, strict=True):
            data, f, t, q = (x.as_py() for x in row)
            out.append(None if data is None else dict(zip(("output", "error"), convert_any(data, f or "", t or "", q), strict=True)))
        return pa.array(out, _RESULT)

    spark.udf.register("fileloom_convert", fileloom_convert)


def convert_any(data: bytes, from_fmt: str, to_fmt: str, quality: int | None = None) -> tuple[bytes | None, str | None]:
    """One file through the whole dispatch in Python, the native operators included."""
    import base64
    import binascii
    import re

    f, t = from_fmt.lower(), to_fmt.lower()
    name = next((n for s, d, n in PAIRS if (s is None or f in s) and (d is None or t in d)), None)
    if name is None:
        return None, f"Unsupported conversion: {from_fmt} → {to_fmt}"
    if name in FILES or name == "image":
        return convert_bytes(data, name, f, t, quality)
    try:
        if name == "base64_encode":
            return base64.b64encode(data), None
        body = data.decode("utf-8")
        if name == "base64_decode":
            body = body.strip(tree_files.WHITE)
            return (base64.b64decode(body), None) if re.match(text.STRICT_BASE64[:-1] + r"\Z", body) else (None, "Invalid base64: not canonical padded Base64")
        if name == "html_to_markdown":
            return markup.html_to_markdown(body).encode(), None
        return {"tsv_to_csv": csv_files.tsv_to_csv, "yaml_to_json": tree_files.yaml_to_json, "toml_to_json": tree_files.toml_to_json}[name](data), None
    except UnicodeDecodeError as e:
        return None, f"Invalid UTF-8: invalid byte at position {e.start}"
    except (ConversionError, binascii.Error) as e:
        return None, str(e)
