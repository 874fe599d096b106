"""Pages of fixed-width lines, WordprocessingML text and PCM samples, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileloom.functions.tabular import let, lines
from fileloom.functions.text import decode_xml, trim

LINE_CHARS = 90
#: A4 less two margins of 50 points, at 14 points a line.
PAGE_LINES = 52


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def wrapped(text: Column | str) -> Column:
    """The lines of a text, cut every 90 characters; blank ones stay, an empty text is one blank line."""
    segments = lambda x: F.when(x == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / LINE_CHARS).cast("int")), lambda k: F.substring(x, k * LINE_CHARS + 1, F.lit(LINE_CHARS))))
    return let(F.flatten(F.transform(lines(text), segments)), lambda out: F.when(F.size(out) == 0, F.array(F.lit(""))).otherwise(out))


def page_count(text: Column | str) -> Column:
    return F.ceil(F.size(wrapped(text)) / PAGE_LINES)


def pages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, page and line_on_page from 1, and txt of each line; positions come with the lines, so nothing is shuffled."""
    rows = df.select(F.col(id_col), F.posexplode(wrapped(F.coalesce(text_col, F.lit("")))).alias("at", "txt"))
    return rows.select(id_col, (F.floor(F.col("at") / PAGE_LINES) + 1).cast("int").alias("page"), (F.col("at") % PAGE_LINES + 1).alias("line_on_page"), "txt")


def wordml_text(xml: Column | str) -> Column:
    """Text of WordprocessingML: what a tag that begins with <w:t opens, to </w:t> or the next paragraph; breaks; paragraphs."""
    paragraph = r"<w:p>|<w:p [^>]*>"
    token = rf"(?s){paragraph}|<w:br[^>]*>|<w:t[^>]*>.*?(?=</w:t>|{paragraph}|\z)"
    is_paragraph = lambda x: x.rlike(f"^(?:{paragraph})")
    first_of = lambda found: F.array_position(F.transform(found, is_paragraph), F.lit(True))

    def said(x: Column, i: Column, first: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(x, r"(?s)<w:br[^>]*>", "\n"), r"<[^>]*>?", "")
        return F.when(is_paragraph(x), F.when(i + 1 == first, "").otherwise("\n\n")).otherwise(decode_xml(inner))

    joined = lambda found: let(first_of(found), lambda first: F.array_join(F.transform(found, lambda x, i: said(x, i, first)), ""))
    return trim(let(F.regexp_extract_all(_c(xml), F.lit(token), F.lit(0)), joined))


def pcm16(samples: Column | str) -> Column:
    """Float samples as 16-bit integers: clamped to one, times 32,767 in single precision, cut towards zero."""
    one = F.lit(1).cast("float")
    return F.transform(_c(samples), lambda s: (F.greatest(-one, F.least(one, s)) * F.lit(32767).cast("float")).cast("smallint"))
