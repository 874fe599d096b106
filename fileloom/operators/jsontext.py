"""Strict JSON reading, and printing with sorted keys and shortest floats."""

from __future__ import annotations

import json
import math
import re

from fileloom.operators.errors import ConversionError

#: Objects are printed with their keys in byte order.
SORT_KEYS = True
MOST_NESTED = 127
_ESCAPE = re.compile(r'["\\\x00-\x1f]')
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_SURROGATE = re.compile("[\ud800-\udfff]")
INT = re.compile(r"[+-]?[0-9]+\Z")
FLOAT = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")


def float_text(x: float) -> str:
    """Shortest text that reads back: decimals from 1e-5 to below 1e16, else an exponent; never without either mark."""
    if x == 0:
        return "-0.0" if math.copysign(1, x) < 0 else "0.0"
    mantissa, _, exponent = repr(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits = (whole + part).lstrip("0")
    point = len(digits) - len(part) + int(exponent or 0)
    digits = digits.rstrip("0")
    sign = "-" if x < 0 else ""
    if not -5 < point <= 16:
        return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{point - 1}"
    if point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    return f"{sign}{digits[:point].ljust(point, '0')}.{digits[point:] or '0'}"


def number(text: str) -> int | float | None:
    """A 64-bit integer or a finite float; else None."""
    if INT.match(text) and -(1 << 63) <= (n := int(text)) < 1 << 63:
        return n
    if FLOAT.match(text) and math.isfinite(x := float(text)):
        return x
    return None


def quote(s: str) -> str:
    return '"' + _ESCAPE.sub(lambda m: _SHORT.get(m.group()) or f"\\u{ord(m.group()):04x}", s) + '"'


def _int(text: str) -> int | float:
    n = int(text)
    if text == "-0":
        return -0.0
    return n if -(1 << 63) <= n < 1 << 64 else _float(text)


def _float(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError("number out of range")
    return x


def _constant(name: str):
    raise ValueError(f"unexpected {name}")


def _check(value, depth: int) -> None:
    if depth > MOST_NESTED:
        raise ValueError("recursion limit exceeded")
    if isinstance(value, str):
        if _SURROGATE.search(value):
            raise ValueError("lone surrogate in a string")
    elif isinstance(value, dict):
        for k, v in value.items():
            _check(k, depth)
            _check(v, depth + 1)
    elif isinstance(value, list):
        for v in value:
            _check(v, depth + 1)


def parse(text: str):
    try:
        value = json.loads(text, parse_int=_int, parse_float=_float, parse_constant=_constant)
        _check(value, 0)
    except (ValueError, RecursionError) as e:
        raise ConversionError(f"Invalid JSON: {e}") from None
    return value


def members(obj: dict) -> list[tuple[str, object]]:
    return sorted(obj.items(), key=lambda m: m[0].encode("utf-8", "surrogatepass")) if SORT_KEYS else list(obj.items())


def scalar(value) -> str:
    """The JSON text of anything but a string, array or object."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    return float_text(value) if isinstance(value, float) else str(value)


def compact(value) -> str:
    if isinstance(value, str):
        return quote(value)
    if isinstance(value, list):
        return "[" + ",".join(map(compact, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{quote(k)}:{compact(v)}" for k, v in members(value)) + "}"
    return scalar(value)


def pretty(value, indent: int = 0) -> str:
    """Two spaces a level, no line end at the end."""
    pad, inner = "  " * indent, "  " * (indent + 1)
    if isinstance(value, list) and value:
        return "[\n" + ",\n".join(inner + pretty(v, indent + 1) for v in value) + f"\n{pad}]"
    if isinstance(value, dict) and value:
        return "{\n" + ",\n".join(f"{inner}{quote(k)}: {pretty(v, indent + 1)}" for k, v in members(value)) + f"\n{pad}}}"
    return compact(value)
