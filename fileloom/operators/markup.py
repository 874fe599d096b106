"""Compositions of markup and paged documents."""

from __future__ import annotations

import re

from fileloom.operators import markdown, pdf
from fileloom.operators.errors import utf8
from fileloom.operators.tree import WHITE

_TAG = re.compile(r"<[^>]*>?")


def strip_tags(html: str) -> str:
    """Without tags and without any >; five references decoded in turn; trimmed."""
    text = _TAG.sub("", html).replace(">", "")
    for old, new in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = text.replace(old, new)
    return text.strip(WHITE)


def markdown_to_text(data: bytes) -> bytes:
    return strip_tags(markdown.render(utf8(data))).encode()


def markdown_to_pdf(data: bytes) -> bytes:
    return pdf.write(markdown_to_text(data).decode())


def html_to_pdf(data: bytes) -> bytes:
    return pdf.write(strip_tags(utf8(data)))


_TOKEN = re.compile(r"<[^>]*>?|&[^;]*;?|[^<&]+")


def html_to_markdown(html: str) -> str:
    """The same single pass as the column expression's."""
    from fileloom.functions.text import ENTITIES, TAGS

    marks = {t: out for out, tags in TAGS.items() for t in tags}
    plain = dict(ENTITIES)

    def said(token: str) -> str:
        if token[0] != "<":
            return plain.get(token, token)
        return marks.get(token.rpartition("<")[2][:-1].strip(WHITE).lower(), "") if token.endswith(">") else ""

    return "".join(map(said, _TOKEN.findall(html))).strip(WHITE)
