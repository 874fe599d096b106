"""JSON to and from the YAML and TOML subsets, nested objects included."""

from __future__ import annotations

from fileloom.operators import jsontext
from fileloom.operators.errors import ConversionError, utf8
from fileloom.operators.tabular import rust_lines

#: Unicode white space (Python's str.strip also takes the separators U+001C to U+001F).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _yaml(value, indent: int) -> str:
    """What is written after a key or dash. The caller takes white space off its left, so nested values begin on its line."""
    pad = "  " * indent
    if isinstance(value, list):
        return "\n" + "".join(f"{pad}- {_yaml(v, indent + 1).lstrip(WHITE)}" for v in value)
    if isinstance(value, dict):
        return ("\n" if indent else "") + "".join(f"{pad}{k}: {_yaml(v, indent + 1).lstrip(WHITE)}" for k, v in jsontext.members(value))
    return (value if isinstance(value, str) else jsontext.scalar(value)) + "\n"


def json_to_yaml(data: bytes) -> bytes:
    return _yaml(jsontext.parse(utf8(data)), 0).encode()


def _toml_scalar(value) -> str:
    if isinstance(value, str):
        return f'"{value}"'
    if value is None:
        return '""'
    return f'"{jsontext.compact(value)}"' if isinstance(value, list | dict) else jsontext.scalar(value)


def _toml(value, prefix: str) -> str:
    if not isinstance(value, dict):
        return ""
    own, below = [], []
    for k, v in jsontext.members(value):
        if isinstance(v, dict):
            section = f"{prefix}.{k}" if prefix else k
            below.append(f"\n[{section}]\n{_toml(v, section)}")
        elif isinstance(v, list):
            own.append(f"{k} = [{', '.join(map(_toml_scalar, v))}]\n")
        else:
            own.append(f"{k} = {_toml_scalar(v)}\n")
    return "".join(own + below)


def json_to_toml(data: bytes) -> bytes:
    return _toml(jsontext.parse(utf8(data)), "").encode()


def _yaml_value(s: str):
    if s in ("", "null", "~"):
        return None
    if s in ("true", "false"):
        return s == "true"
    n = jsontext.number(s)
    if n is not None:
        return n
    if jsontext.FLOAT.match(s) or s.lstrip("+-").lower() in ("inf", "infinity", "nan"):
        return s  # reads as a float, but none that JSON has
    return s.strip('"').strip("'")


def yaml_to_json(data: bytes) -> bytes:
    out = {}
    for line in rust_lines(utf8(data)):
        line = line.strip(WHITE)
        if line and not line.startswith("#") and line != "---" and ":" in line:
            k, _, v = line.partition(":")
            out[k.strip(WHITE)] = _yaml_value(v.strip(WHITE))
    return jsontext.pretty(out).encode()


def _toml_value(s: str):
    if s[:1] in ("'", '"') and s.endswith(s[0]):
        if len(s) == 1:
            raise ConversionError("TOML parse error: a value is a single quote character")
        return s[1:-1]
    if s in ("true", "false"):
        return s == "true"
    n = jsontext.number(s)
    return s if n is None else n


def toml_to_json(data: bytes) -> bytes:
    root: dict = {}
    table: dict | None = root
    for line in rust_lines(utf8(data)):
        line = line.strip(WHITE)
        if not line or line.startswith("#"):
            continue
        if line.startswith("[") and line.endswith("]") and len(line) > 1:
            table, name = None, line[1:-1].strip(WHITE)
        elif "=" in line:
            k, _, v = line.partition("=")
            value = _toml_value(v.strip(WHITE))
            if table is None:  # a section is there once it has a key; one that is named like a root scalar keeps none
                table = root.setdefault(name, {})
            if isinstance(table, dict):
                table[k.strip(WHITE)] = value
    return jsontext.pretty(root).encode()
