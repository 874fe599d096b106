"""CSV and TSV files to and from JSON, exactly and whole."""

from __future__ import annotations

import csv
import io

from fileloom.operators import jsontext
from fileloom.operators.errors import ConversionError, utf8

csv.field_size_limit(2**31 - 1)
_QUOTED = frozenset('",\r\n')


def rust_lines(text: str) -> list[str]:
    """Split at \\n; a \\r before it goes; nothing after the last \\n is no line."""
    rows = text.split("\n")
    last = rows.pop()
    return [r.removesuffix("\r") for r in rows] + ([last] if last else [])


def records(data: bytes) -> tuple[list[str], list[list[str]]]:
    """Header and rows. Blank lines are skipped, a byte order mark too; rows must be as wide as the header."""
    try:
        text = data.removeprefix(b"\xef\xbb\xbf").decode("utf-8")
    except UnicodeDecodeError as e:
        where = "Failed to read CSV headers" if b"\n" not in data[: e.start].lstrip(b"\r\n") else "CSV parse error"
        raise ConversionError(f"{where}: invalid UTF-8 at position {e.start}") from None
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    header, body = (rows[0], rows[1:]) if rows else ([], [])
    for i, r in enumerate(body):
        if len(r) != len(header):
            raise ConversionError(f"CSV parse error: record {i + 1} has {len(r)} fields, but the previous record has {len(header)} fields")
    return header, body


def record(fields: list[str]) -> str:
    """One line; a record without any character is written as two quotes."""
    if not any(fields) and len(fields) <= 1:
        return '""\n'
    return ",".join('"' + f.replace('"', '""') + '"' if _QUOTED & set(f) else f for f in fields) + "\n"


def csv_to_json(data: bytes) -> bytes:
    header, body = records(data)

    def cell(text: str):
        n = jsontext.number(text)
        return text if n is None else n

    return jsontext.pretty([dict(zip(header, map(cell, r), strict=True)) for r in body]).encode()


def csv_to_tsv(data: bytes) -> bytes:
    """Fields are joined by tabs as they are."""
    header, body = records(data)
    return "".join("\t".join(r) + "\n" for r in [header, *body]).encode()


def tsv_to_csv(data: bytes) -> bytes:
    out, width = [], None
    for line in rust_lines(utf8(data)):
        fields = line.split("\t")
        width = width or len(fields)
        if len(fields) != width:
            raise ConversionError("CSV write error: records of different lengths")
        out.append(record(fields))
    return "".join(out).encode()


def json_to_csv(data: bytes) -> bytes:
    """The header is the union of the objects' keys, first seen first; what is no object is skipped."""
    value = jsontext.parse(utf8(data))
    if not isinstance(value, list):
        raise ConversionError("JSON must be an array of objects")
    if not value:
        return b""
    objects = [v for v in value if isinstance(v, dict)]
    header = list(dict.fromkeys(k for o in objects for k, _ in jsontext.members(o)))

    def cell(o: dict, k: str) -> str:
        v = o.get(k, "")
        return v if isinstance(v, str) else jsontext.compact(v)

    return "".join(record(r) for r in [header, *([cell(o, k) for k in header] for o in objects)]).encode()
