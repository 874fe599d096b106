"""The catalogue of formats: what is known, readable, writable and offered, as data and as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The extensions, and for each the outputs in the order in which they are offered (the first is the default).
RASTER = ("png", "jpg", "webp", "avif", "gif", "bmp", "tiff", "qoi", "tga", "ico")
IMAGE_INPUTS = ("png", "jpg", "jpeg", "webp", "gif", "bmp", "tiff", "tif", "ico", "qoi", "tga", "hdr", "dds", "exr")
IMAGE_OUTPUTS = (*IMAGE_INPUTS, "avif")
AUDIO_INPUTS = ("mp3", "flac", "ogg", "wav")
DOCUMENT_INPUTS = ("md", "markdown", "html", "txt", "docx", "rtf", "pdf")
DATA_INPUTS = ("csv", "tsv", "json", "yaml", "yml", "toml")
INPUTS = (*IMAGE_INPUTS, "svg", *AUDIO_INPUTS, *DOCUMENT_INPUTS, *DATA_INPUTS, "base64")
KNOWN = (*INPUTS, "avif", "text")
FALLBACK = ("base64",)

#: An alias and the name that images are decoded and encoded by.
CANONICAL_IMAGE = {"jpeg": "jpg", "tif": "tiff"}

OUTPUTS: dict[str, tuple[str, ...]] = {e: tuple(t for t in RASTER if t != CANONICAL_IMAGE.get(e, e)) for e in IMAGE_INPUTS if e not in ("hdr", "dds", "exr")}
OUTPUTS |= dict.fromkeys(("hdr", "dds", "exr"), ("png", "jpg", "webp", "avif", "bmp", "tiff", "tga"))
OUTPUTS |= {"svg": ("png",)}
OUTPUTS |= dict.fromkeys(AUDIO_INPUTS, ("wav",))
OUTPUTS |= dict.fromkeys(("md", "markdown"), ("html", "txt", "pdf"))
OUTPUTS |= {"html": ("md", "pdf"), "docx": ("txt", "html"), "rtf": ("txt",), "pdf": ("txt", "html")}
OUTPUTS |= dict.fromkeys(("txt", "text"), ("pdf",))
OUTPUTS |= {"csv": ("json", "tsv"), "tsv": ("csv",), "json": ("csv", "yaml", "toml")}
OUTPUTS |= dict.fromkeys(("yaml", "yml"), ("json",))
OUTPUTS |= {"toml": ("json",), "base64": ("bin",)}

ICONS = {
    "🖼️": (*IMAGE_INPUTS, "svg", "avif"),
    "📝": ("md", "markdown", "html", "txt", "text"),
    "📄": ("docx", "rtf", "pdf"),
    "📊": ("csv", "tsv", "json"),
    "⚙️": ("yaml", "yml", "toml"),
    "🔐": ("base64",),
}
DEFAULT_ICON = "📄"

MIME = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp",
    "tiff": "image/tiff", "tif": "image/tiff", "avif": "image/avif", "ico": "image/x-icon", "qoi": "image/qoi", "tga": "image/x-tga",
    "hdr": "image/vnd.radiance", "dds": "image/vnd.ms-dds", "exr": "image/x-exr", "html": "text/html", "md": "text/markdown",
    "markdown": "text/markdown", "txt": "text/plain", "text": "text/plain", "rtf": "application/rtf", "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "csv": "text/csv", "tsv": "text/tab-separated-values",
    "json": "application/json", "yaml": "application/x-yaml", "yml": "application/x-yaml", "toml": "application/toml",
}
DEFAULT_MIME = "application/octet-stream"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(key: Column, table: dict, default) -> Column:
    """The value of key in a small constant table, as one CASE that Catalyst folds for constant keys."""
    by_value: dict = {}
    for k, v in table.items():
        by_value.setdefault(v, []).append(k)
    out = F
    for v, keys in by_value.items():
        value = F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)
        out = out.when(key.isin(keys), value)
    return out.otherwise(F.array(*map(F.lit, default)) if isinstance(default, tuple) else F.lit(default))


def detect_format(name: Column | str) -> Column:
    """The lower-case text after the last dot (the whole name, if there is none), if it is known; else null."""
    ext = F.lower(F.substring_index(_c(name), ".", -1))
    return F.when(ext.isin(*KNOWN), ext)


def output_formats(ext: Column | str) -> Column:
    """The outputs that are offered for an extension in any case; for unknown ones base64."""
    return lookup(F.lower(_c(ext)), OUTPUTS, FALLBACK)


def default_target(ext: Column | str) -> Column:
    return F.element_at(output_formats(ext), 1)


def is_image_input(fmt: Column | str) -> Column:
    return _c(fmt).isin(*IMAGE_INPUTS)


def is_image_output(fmt: Column | str) -> Column:
    return _c(fmt).isin(*IMAGE_OUTPUTS)


def is_audio(fmt: Column | str) -> Column:
    return _c(fmt).isin(*AUDIO_INPUTS)


def is_known(fmt: Column | str) -> Column:
    return _c(fmt).isin(*KNOWN)


def image_decoder(fmt: Column | str) -> Column:
    """The decoder's name; null if an image of this format cannot be read."""
    return lookup(_c(fmt), {f: CANONICAL_IMAGE.get(f, f) for f in IMAGE_INPUTS}, None)


def image_encoder(fmt: Column | str) -> Column:
    """The encoder's name; null if an image of this format cannot be written."""
    return lookup(_c(fmt), {f: CANONICAL_IMAGE.get(f, f) for f in IMAGE_OUTPUTS}, None)


def format_icon(ext: Column | str) -> Column:
    return lookup(_c(ext), {e: icon for icon, exts in ICONS.items() for e in exts}, DEFAULT_ICON)


def mime_type(ext: Column | str) -> Column:
    return lookup(_c(ext), MIME, DEFAULT_MIME)


def format_size(size: Column | str) -> Column:
    """B, KB or MB with one decimal; exact ties go to the even digit."""
    n = _c(size).cast("long")

    def scaled(unit: int, name: str) -> Column:
        # in tenths, as integers: bround on a double would first round the quotient
        tenths, rest = F.floor(n * 10 / unit), (n * 10) % unit
        up = (rest * 2 > unit) | ((rest * 2 == unit) & (tenths % 2 == 1))
        t = tenths + up.cast("long")
        return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(f" {name}"))

    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, scaled(1 << 10, "KB")).otherwise(scaled(1 << 20, "MB"))


def output_name(name: Column | str, target: Column | str) -> Column:
    """The name with the text after its last dot replaced, or with the target added."""
    n = _c(name)
    stem = F.when(F.instr(n, ".") > 0, F.substring(n, F.lit(1), F.length(n) - F.length(F.substring_index(n, ".", -1)) - 1)).otherwise(n)
    return F.concat(stem, F.lit("."), _c(target))


def accept_list() -> str:
    return ",".join(f".{e}" for e in INPUTS)


def catalogue(spark: SparkSession) -> DataFrame:
    """ext, position among the inputs (null: known only), outputs."""
    rows = [(e, INPUTS.index(e) if e in INPUTS else None, list(OUTPUTS.get(e, FALLBACK))) for e in KNOWN]
    return spark.createDataFrame(rows, "ext string, position int, outputs array<string>")
