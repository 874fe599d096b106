"""Cells, rows and tables of CSV and TSV, and JSON scalars, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Control characters without a short escape.
_PLAIN_CONTROLS = [c for c in range(32) if c not in (8, 9, 10, 12, 13)]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: a bound variable, where a plain expression would be copied at each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def json_quote(text: Column | str) -> Column:
    """A JSON string: short escapes, \\u00xx in lower case for other controls, everything else as it is."""
    return let(_c(text), _json_quote)


def _json_quote(out: Column) -> Column:
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(old), F.lit(new))

    def controls(own: Column) -> Column:
        rest = own
        for c in _PLAIN_CONTROLS:
            rest = F.replace(rest, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
        return F.when(own.rlike(r"[\x{00}-\x{1F}]"), rest).otherwise(own)

    return F.concat(F.lit('"'), let(out, controls), F.lit('"'))


def int_text(text: Column) -> Column:
    """The canonical text of a 64-bit integer; null if it is none."""
    return F.when(text.rlike(INT), text.try_cast("bigint").cast("string"))


def float_text(value: Column) -> Column:
    """The shortest text of a finite double: decimals from 1e-5 to below 1e16, else an exponent; always a point or an exponent.

    Built from the digits and exponent of Java's own text.
    """

    def shortest(x: Column) -> Column:
        # Java's text may have a digit too many; then the fewest digits that read back are looked for
        s = x.cast("string")
        fewest = F.get(F.filter(F.array(*[F.format_string(f"%.{p}e", x) for p in range(17)]), lambda t: t.cast("double") == x), F.lit(0))
        doubtful = (F.length(F.regexp_replace(s, "E.*|[^0-9]", "")) >= 16) | ((F.abs(x) < 1e-300) & (x != 0))
        return F.when(doubtful, F.coalesce(F.upper(fewest), s)).otherwise(s)

    return let(let(value, shortest), _float_text)


def _float_text(s: Column) -> Column:
    sign = F.when(F.startswith(s, F.lit("-")), "-").otherwise("")
    parts = F.split(F.regexp_replace(s, "^-", ""), "E")  # mantissa and exponent

    def laid_out(p: Column) -> Column:
        """p: digits without zeros at either end, and how many of them stand before the point."""
        digits, point = p["digits"], p["point"]
        n = F.length(digits)
        decimal = (
            F.when(point >= n, F.concat(F.rpad(digits, point, "0"), F.lit(".0")))
            .when(point > 0, F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
            .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        )
        scientific = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.lit("e"), (point - 1).cast("string"))
        return F.when(digits == "", "0.0").when((point > -5) & (point <= 16), decimal).otherwise(scientific)

    def counted(m: Column) -> Column:
        """m: digits before and after the point, and the exponent."""
        return let(F.concat(m["whole"], m["part"]), lambda d: let(F.struct(F.regexp_replace(d, "^0+|0+$", "").alias("digits"), (F.length(m["whole"]) + m["exponent"] - F.length(F.regexp_extract(d, "^(0*)", 1))).alias("point")), laid_out))

    text = let(
        parts,
        lambda x: let(
            F.struct(F.substring_index(F.get(x, F.lit(0)), ".", 1).alias("whole"), F.regexp_extract(F.get(x, F.lit(0)), r"\.(.*)$", 1).alias("part"), F.coalesce(F.get(x, F.lit(1)).cast("int"), F.lit(0)).alias("exponent")), counted
        ),
    )
    return F.concat(sign, text)


def number_text(text: Column) -> Column:
    """The JSON text of what reads as an integer or a finite float; null if it does neither."""
    finite = lambda t: let(F.when(t.rlike(FLOAT), t.try_cast("double")), lambda x: F.when(F.abs(x) < float("inf"), float_text(x)))
    return let(text, lambda t: F.coalesce(int_text(t), finite(t)))


def cell_json(cell: Column | str) -> Column:
    """A CSV cell as JSON: integer, else finite float, else string."""
    return let(_c(cell), lambda c: F.coalesce(number_text(c), json_quote(c)))


def cell_kind(cell: Column | str) -> Column:
    return let(_c(cell), lambda c: F.when(int_text(c).isNotNull(), "int").when(number_text(c).isNotNull(), "float").otherwise("string"))


def csv_field(field: Column | str) -> Column:
    """Quoted only where it must be."""
    return let(_c(field), lambda f: F.when(f.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(f))


def csv_row(fields: Column) -> Column:
    """An array of strings as a record without its line end; a single empty field is written as two quotes."""
    return let(fields, lambda f: F.when((F.size(f) <= 1) & (F.array_join(f, "") == ""), '""').otherwise(F.array_join(F.transform(f, csv_field), ",")))


def lines(text: Column | str) -> Column:
    """Split at \\n; a \\r before it goes; nothing after the last \\n is no line."""

    def cut(t: Column) -> Column:
        rows = let(F.split(F.regexp_replace(t, r"\n\z", ""), "\n", -1), lambda r: F.transform(r, lambda x, i: F.when((i < F.size(r) - 1) | F.endswith(t, F.lit("\n")), F.regexp_replace(x, r"\r\z", "")).otherwise(x)))
        return F.when(t == "", F.array().cast("array<string>")).otherwise(rows)

    return let(_c(text), cut)


def tsv_to_csv(text: Column | str) -> Column:
    """struct(output, error): fields are split at tabs, without quotes; all lines must be of one width."""

    def written(rows: Column) -> Column:
        good = F.size(F.array_distinct(F.transform(rows, lambda r: F.size(r)))) <= 1
        body = F.array_join(F.transform(rows, lambda r: F.concat(csv_row(r), F.lit("\n"))), "")
        return F.struct(F.when(good, body).alias("output"), F.when(~good, "CSV write error: records of different lengths").alias("error"))

    return let(F.transform(lines(text), lambda x: F.split(x, "\t", -1)), written)


def table_to_csv(df: DataFrame, order: str, columns: list[str] | None = None) -> Column:
    """For a grouped aggregate: header and rows of a table in the order of a column, as one CSV text."""
    columns = columns or df.columns
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("cells"))))
    header = csv_row(F.array(*[F.lit(c) for c in columns]))
    return F.concat(header, F.lit("\n"), F.array_join(F.transform(rows, lambda r: F.concat(csv_row(r["cells"]), F.lit("\n"))), ""))


def json_objects_to_csv(text: Column | str) -> Column:
    """A JSON array of flat objects as CSV text: the header is the union of keys, each object's in byte order, first seen first.

    Values are read as text: null as null, missing as empty.
    """

    def written(rows: Column, header: Column) -> Column:
        cells = lambda m: F.transform(header, lambda k: F.when(F.map_contains_key(m, k), F.coalesce(F.element_at(m, k), F.lit("null"))).otherwise(""))
        body = F.transform(rows, lambda m: F.concat(csv_row(cells(m)), F.lit("\n")))
        return F.when(F.size(rows) == 0, "").otherwise(F.concat(csv_row(header), F.lit("\n"), F.array_join(body, "")))

    header = lambda rows: F.array_distinct(F.flatten(F.transform(rows, lambda m: F.array_sort(F.map_keys(m)))))
    return let(F.from_json(_c(text), "array<map<string,string>>"), lambda rows: let(header(rows), lambda h: written(rows, h)))
