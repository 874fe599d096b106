"""String conversions as column expressions: markup, entities, trimming, Base64, PDF strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a class of both Java's and RE2's regular expressions.
SPACE = r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: A tag (to the end of the text, if it is not closed), a reference (to the end, likewise), or a run of text.
TOKEN = r"(?s)<[^>]*>?|&[^;]*;?|[^<&]+"

# What a tag of Markdown's subset becomes.
TAGS = {
    "# ": ("h1",), "## ": ("h2",), "### ": ("h3",), "\n\n": ("/h1", "/h2", "/h3", "/h4", "/h5", "/h6", "/p"), "\n": ("br", "br/", "br /", "/li"),
    "**": ("strong", "b", "/strong", "/b"), "*": ("em", "i", "/em", "/i"), "`": ("code", "/code"), "- ": ("li",), "\n---\n": ("hr", "hr/"),
}
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
XML_ENTITIES = (*ENTITIES[:4], ("&apos;", "'"))

#: Standard alphabet, padded, no line breaks, no bits left over in the last group.
STRICT_BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(text: Column | str) -> Column:
    """Without Unicode white space at both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(F.regexp_replace(_c(text), f"^{SPACE}+", ""), rf"{SPACE}+\z", "")


def trim_start(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), f"^{SPACE}+", "")


def replace_all(text: Column, pairs) -> Column:
    """Replacements one after another, so that what one makes the next may replace."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def decode_xml(text: Column | str) -> Column:
    return replace_all(_c(text), XML_ENTITIES)


def html_escape(text: Column | str) -> Column:
    return replace_all(_c(text), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")))


def strip_tags(html: Column | str) -> Column:
    """Without tags and without any >; five references decoded in turn; trimmed."""
    bare = F.replace(F.regexp_replace(_c(html), r"<[^>]*>?", ""), F.lit(">"), F.lit(""))
    return trim(replace_all(bare, ENTITIES))


def html_to_markdown(html: Column | str) -> Column:
    """One pass over tags, references and text; tags count by their whole text, so those with attributes vanish."""

    marks = F.create_map(*[F.lit(x) for out, tags in TAGS.items() for t in tags for x in (t, out)])
    plain = F.create_map(*[F.lit(x) for pair in ENTITIES for x in pair])

    def said(token: Column) -> Column:
        # a < within a tag begins it anew, so the tag is what follows the last one
        tag = F.lower(trim(F.regexp_replace(F.regexp_replace(token, r"(?s)^.*<", ""), r">\z", "")))
        mark = F.when(F.endswith(token, F.lit(">")), F.coalesce(F.element_at(marks, tag), F.lit(""))).otherwise("")
        return F.when(F.startswith(token, F.lit("<")), mark).when(F.startswith(token, F.lit("&")), F.coalesce(F.element_at(plain, token), token)).otherwise(token)

    return trim(F.array_join(F.transform(F.regexp_extract_all(_c(html), F.lit(TOKEN), F.lit(0)), said), ""))


def attribute(tag: Column | str, name: str) -> Column:
    """The value of the first name= in a tag, in either kind of quotes; null without one."""
    at = F.instr(_c(tag), f"{name}=")
    rest = F.substring(_c(tag), at + len(name) + 1, F.length(_c(tag)))
    quote = F.substring(rest, 1, 1)
    inner = F.substring(rest, F.lit(2), F.length(rest))
    end = F.when(quote == '"', F.instr(inner, '"')).when(quote == "'", F.instr(inner, "'"))
    return F.when((at > 0) & (end > 0), F.substring(inner, F.lit(1), end - 1))


def pdf_string(text: Column | str) -> Column:
    """Escaped for a literal string of a PDF; other control characters and those beyond Latin-1 are left out."""
    out = F.regexp_replace(_c(text), r"[\x{00}-\x{09}\x{0B}\x{0C}\x{0E}-\x{1F}\x{100}-\x{10FFFF}]", "")
    out = F.regexp_replace(out, r"([()\\])", r"\\$1")
    return replace_all(out, (("\r", "\\r"), ("\n", "\\n")))


def base64_encode(content: Column | str) -> Column:
    """Without line breaks, whatever spark.sql.chunkBase64String.enabled says."""
    return F.translate(F.base64(_c(content)), "\r\n", "")


def utf8(content: Column | str) -> Column:
    """The text of valid UTF-8; else null."""
    return F.when(F.is_valid_utf8(_c(content).cast("string")), _c(content).cast("string"))


def base64_decode(content: Column | str) -> Column:
    """struct(output, error): strict decoding of the trimmed text.

    Spark's decoder is lax; a text is canonical exactly if its bytes are encoded to the same text again.
    """
    clean = trim(utf8(content))
    data = F.try_to_binary(clean, F.lit("base64"))
    good = F.coalesce(base64_encode(data) == clean, F.lit(False))
    problem = F.when(_c(content).isNull(), F.lit(None).cast("string")).when(clean.isNull(), "Invalid UTF-8: not a valid byte sequence").when(~good, "Invalid base64: not canonical padded Base64")
    return F.struct(F.when(good, data).alias("output"), problem.alias("error"))
