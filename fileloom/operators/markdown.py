"""CommonMark to HTML: blocks first, then inlines. Raw HTML is left out and links to scripts are emptied."""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import quote

from fileloom.operators.errors import utf8

OMITTED = "<!-- raw HTML omitted -->"
_PUNCTUATION = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"
_REFERENCE = r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});"
_TAG = r"<(?:[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][A-Za-z0-9_.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|/[A-Za-z][A-Za-z0-9-]*\s*|!--(?:>|->|.*?--)|\?.*?\?|![A-Z][^>]*|!\[CDATA\[.*?\]\])>"
_HTML_TAG = re.compile(_TAG, re.S)
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9.+-]{1,31}:[^\s<>\x00-\x20]*)>")
_EMAIL = re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*)>")
_ENTITY = re.compile(_REFERENCE)
_ESCAPED = re.compile(rf"\\([{_PUNCTUATION}])|({_REFERENCE})")
_UNSAFE = re.compile(r"(?:javascript|vbscript|file|data):", re.I)
_SAFE_DATA = re.compile(r"data:image/(?:png|gif|jpeg|webp)", re.I)

# The elements whose tags begin a block of raw HTML.
HTML_BLOCKS = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|"
    "frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|"
    "summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
)
_HTML_STARTS = (
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{HTML_BLOCKS})(?:\s|/?>|$)", re.I), None),
    (re.compile(rf"(?:{_TAG})\s*$"), None),
)
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*?)[ \t]*$")
_ITEM = re.compile(r"( {0,3})(?:([-+*])|([0-9]{1,9})([.)]))(?=[ \t]|$)")
_QUOTE = re.compile(r" {0,3}>[ ]?")
_LABEL = r"\[((?:[^\[\]\\]|\\.){1,999}?)\]"
_TITLE = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)"
_DEFINITION = re.compile(rf" {{0,3}}{_LABEL}:[ \t]*\n?[ \t]*(<(?:[^<>\n\\]|\\.)*>|[^\s<][^\s]*)(?:(?:[ \t]+|[ \t]*\n[ \t]*)({_TITLE}))?[ \t]*(?:\n|$)", re.S)
_DEFINITION_BARE = re.compile(rf" {{0,3}}{_LABEL}:[ \t]*\n?[ \t]*(<(?:[^<>\n\\]|\\.)*>|[^\s<][^\s]*)[ \t]*(?:\n|$)", re.S)


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _plain(text: str) -> str:
    """Backslash escapes and references decoded."""
    return _ESCAPED.sub(lambda m: m.group(1) or unescape(m.group(2)), text)


def _url(raw: str) -> str:
    url = _plain(raw)
    if _UNSAFE.match(url) and not _SAFE_DATA.match(url):
        return ""
    return escape(quote(url, safe=";/?:@&=+$,-_.!~*'()#%[]")).replace("[", "%5B").replace("]", "%5D").replace("'", "&#x27;")


def _key(label: str) -> str:
    return " ".join(label.split()).casefold()


def _expand(line: str) -> str:
    """Tabs in the indentation as spaces to the next multiple of four."""
    if "\t" not in line:
        return line
    out = []
    for i, c in enumerate(line):
        if c == "\t":
            out.append(" " * (4 - len("".join(out)) % 4))
        elif c == " ":
            out.append(c)
        else:
            return "".join(out) + line[i:]
    return "".join(out)


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


class Blocks:
    """Block structure of a list of lines, as HTML; definitions are gathered for the whole document."""

    def __init__(self) -> None:
        self.links: dict[str, tuple[str, str]] = {}

    def parse(self, lines: list[str]) -> list:
        """Nodes: ("html", text), ("p", text), ("h", level, text), ("code", info, text), ("quote", nodes), ("list", ...)."""
        out: list = []
        i, n = 0, len(lines)
        while i < n:
            line = _expand(lines[i])
            if not line.strip():
                i += 1
                continue
            if _indent(line) >= 4:
                j, body = i, []
                while j < n and (not lines[j].strip() or _indent(_expand(lines[j])) >= 4):
                    body.append(_expand(lines[j])[4:])
                    j += 1
                while body and not body[-1].strip():
                    body.pop()
                    j -= 1
                out.append(("code", "", "\n".join(body) + "\n"))
                i = j
                continue
            if m := _FENCE.match(line):
                i = self._fenced(out, lines, i, m)
            elif m := _ATX.match(line):
                text = m.group(2) or ""
                out.append(("h", len(m.group(1)), "" if re.fullmatch("#+", text) else text.strip()))
                i += 1
            elif _RULE.match(line):
                out.append(("hr",))
                i += 1
            elif _QUOTE.match(line):
                i = self._quoted(out, lines, i)
            elif m := _ITEM.match(line):
                i = self._list(out, lines, i, m)
            elif (kind := self._html_start(line)) is not None:
                i = self._html(out, lines, i, kind)
            else:
                i = self._paragraph(out, lines, i)
        return out

    def _fenced(self, out: list, lines: list[str], i: int, m: re.Match) -> int:
        indent, fence, info = len(m.group(1)), m.group(2), _plain(m.group(3))
        end = re.compile(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$")
        body = []
        i += 1
        while i < len(lines) and not end.match(lines[i]):
            own = _expand(lines[i])
            body.append(own[min(indent, _indent(own)) :] if indent else lines[i])
            i += 1
        out.append(("code", info, "".join(b + "\n" for b in body)))
        return i + 1

    def _interrupts(self, line: str) -> bool:
        """Whether a line ends a paragraph that goes on before it."""
        line = _expand(line)
        if _indent(line) >= 4:
            return False
        m = _ITEM.match(line)
        listed = m and line[m.end() :].strip() and (m.group(2) or m.group(3) == "1")
        kind = self._html_start(line)
        return bool(not line.strip() or _FENCE.match(line) or _ATX.match(line) or _RULE.match(line) or _QUOTE.match(line) or listed or (kind is not None and kind < 6))

    def _lazy(self, nodes_before: list[str], line: str) -> bool:
        """Whether a line without its container's mark goes on with the paragraph that the container ends with."""
        if not nodes_before or not nodes_before[-1].strip() or _ITEM.match(_expand(line)) or self._interrupts(line):
            return False
        saved = dict(self.links)
        last = self.parse(nodes_before)
        self.links = saved
        while last and last[-1][0] in ("quote", "list"):
            last = last[-1][1] if last[-1][0] == "quote" else last[-1][3][-1]
        return bool(last) and last[-1][0] == "p"

    def _quoted(self, out: list, lines: list[str], i: int) -> int:
        body: list[str] = []
        while i < len(lines):
            line = _expand(lines[i])
            if m := _QUOTE.match(line):
                body.append(line[m.end() :])
            elif line.strip() and self._lazy(body, line):
                body.append(line)
            else:
                break
            i += 1
        out.append(("quote", self.parse(body)))
        return i

    def _list(self, out: list, lines: list[str], i: int, m: re.Match) -> int:
        mark, start = m.group(2) or m.group(4), int(m.group(3)) if m.group(3) else None
        items: list[list] = []
        loose = blank_before = False
        while i < len(lines):
            line = _expand(lines[i])
            m = _ITEM.match(line)
            if not m or (m.group(2) or m.group(4)) != mark or _RULE.match(line):
                break
            loose |= blank_before
            rest = line[m.end() :]
            gap = _indent(_expand(rest)) if rest.strip() else 1
            width = m.end() + (gap if 1 <= gap <= 4 else 1)
            body = [_expand(rest)[width - m.end() :] if rest.strip() else ""]
            i += 1
            blank = False
            while i < len(lines):
                line = _expand(lines[i])
                if not line.strip():
                    if len(body) == 1 and not body[0].strip():
                        break  # an item may begin with one blank line at most
                    body.append("")
                    blank = True
                elif _indent(line) >= width:
                    body.append(line[width:])
                    blank = False
                elif not blank and self._lazy(body, line):
                    body.append(line)
                else:
                    break
                i += 1
            blank_before = False
            while body and not body[-1].strip() and len(body) > 1:
                body.pop()
                blank_before = True
            while i < len(lines) and not lines[i].strip():
                blank_before = True
                i += 1
            nodes = self.parse(body)
            loose |= self._has_gap(body, nodes)
            items.append(nodes)
        out.append(("list", start, loose, items))
        return i

    def _has_gap(self, body: list[str], nodes: list) -> bool:
        """Whether two of an item's own blocks have a blank line between them."""
        if len(nodes) < 2 or "" not in [b.strip() for b in body]:
            return False
        for k, line in enumerate(body):
            if not line.strip():
                saved = dict(self.links)
                ahead = len(self.parse(body[:k]))
                whole = len(self.parse(body[:k])) + len(self.parse(body[k:]))
                self.links = saved
                if ahead and whole == len(nodes):
                    return True
        return False

    @staticmethod
    def _html_start(line: str) -> int | None:
        own = line.lstrip(" ")
        if not own.startswith("<"):
            return None
        return next((k for k, (start, _) in enumerate(_HTML_STARTS) if start.match(own)), None)

    @staticmethod
    def _html(out: list, lines: list[str], i: int, kind: int) -> int:
        end = _HTML_STARTS[kind][1]
        while i < len(lines):
            if end is None and not lines[i].strip():
                break
            i += 1
            if end is not None and end.search(lines[i - 1]):
                break
        out.append(("html",))
        return i

    def _paragraph(self, out: list, lines: list[str], i: int) -> int:
        body = [lines[i].strip(" \t") + ("  " if lines[i].endswith("  ") else "")]
        i += 1
        while i < len(lines):
            line = _expand(lines[i])
            m = _SETEXT.match(line)
            if m:
                text = self._definitions("\n".join(body))
                if text:
                    out.append(("h", 1 if m.group(1)[0] == "=" else 2, text.strip()))
                    return i + 1
            if self._interrupts(lines[i]):
                break
            body.append(line.lstrip(" \t").rstrip(" \t") + ("  " if line.endswith("  ") else ""))
            i += 1
        text = self._definitions("\n".join(body))
        if text.strip():
            out.append(("p", text.strip()))
        return i

    def _definitions(self, text: str) -> str:
        while text.lstrip(" ").startswith("["):
            m = _DEFINITION.match(text) or _DEFINITION_BARE.match(text)
            if not m or not m.group(1).strip():
                break
            title = m.group(3) if m.re is _DEFINITION and m.group(3) else ""
            target = m.group(2)
            target = target[1:-1] if target.startswith("<") else target
            self.links.setdefault(_key(m.group(1)), (target, title[1:-1]))
            text = text[m.end() :]
        return text


class Inlines:
    def __init__(self, links: dict[str, tuple[str, str]]) -> None:
        self.links = links

    def html(self, text: str) -> str:
        return self._render(self._parse(text))

    def _parse(self, text: str) -> list:
        """Pieces: strings of HTML, or [mark, count, can open, can close] of emphasis, or ["[", ...] of links."""
        out: list = []
        brackets: list[int] = []
        i, n = 0, len(text)
        while i < n:
            c = text[i]
            if c == "\\" and i + 1 < n:
                if text[i + 1] == "\n":
                    out.append("<br />\n")
                    i += 2
                    while i < n and text[i] == " ":
                        i += 1
                elif re.match(f"[{_PUNCTUATION}]", text[i + 1]):
                    out.append(escape(text[i + 1]))
                    i += 2
                else:
                    out.append("\\")
                    i += 1
            elif c == "`":
                run = len(text[i:]) - len(text[i:].lstrip("`"))
                m = re.compile(rf"(?<!`)`{{{run}}}(?!`)").search(text, i + run)
                if m:
                    code = text[i + run : m.start()].replace("\n", " ")
                    if code.startswith(" ") and code.endswith(" ") and code.strip(" "):
                        code = code[1:-1]
                    out.append(f"<code>{escape(code)}</code>")
                    i = m.end()
                else:
                    out.append("`" * run)
                    i += run
            elif c == "<":
                if m := _AUTOLINK.match(text, i):
                    out.append(f'<a href="{_url(m.group(1).replace(chr(92), "%5C").replace("&", "&amp;"))}">{escape(m.group(1))}</a>')
                    i = m.end()
                elif m := _EMAIL.match(text, i):
                    out.append(f'<a href="mailto:{m.group(1)}">{escape(m.group(1))}</a>')
                    i = m.end()
                elif m := _HTML_TAG.match(text, i):
                    out.append(OMITTED)
                    i = m.end()
                else:
                    out.append("&lt;")
                    i += 1
            elif c == "&":
                if (m := _ENTITY.match(text, i)) and unescape(m.group()) != m.group():
                    out.append(escape(unescape(m.group())))
                    i = m.end()
                else:
                    out.append("&amp;")
                    i += 1
            elif c in "*_":
                run = len(text[i:]) - len(text[i:].lstrip(c))
                before, after = text[i - 1] if i else "\n", text[i + run] if i + run < n else "\n"
                space = lambda x: x.isspace()
                mark = lambda x: bool(re.match(f"[{_PUNCTUATION}]", x)) or (not x.isalnum() and not x.isspace() and not x == "_")
                left = not space(after) and (not mark(after) or space(before) or mark(before))
                right = not space(before) and (not mark(before) or space(after) or mark(after))
                opens = left and (c == "*" or not right or mark(before))
                closes = right and (c == "*" or not left or mark(after))
                out.append([c, run, opens, closes, run])
                i += run
            elif c == "!" and text[i + 1 : i + 2] == "[":
                brackets.append(len(out))
                out.append(["![", i + 2, True])
                i += 2
            elif c == "[":
                brackets.append(len(out))
                out.append(["[", i + 1, True])
                i += 1
            elif c == "]":
                i = self._closes(text, i, out, brackets)
            elif c == "\n":
                if out and isinstance(out[-1], str):
                    hard = out[-1].endswith("  ")
                    out[-1] = out[-1].rstrip(" ")
                    out.append("<br />\n" if hard else "\n")
                else:
                    out.append("\n")
                i += 1
                while i < n and text[i] == " ":
                    i += 1
            else:
                m = re.compile(r"[^\\`<&*_!\[\]\n]+|!|\\").match(text, i)
                out.append(escape(m.group()))
                i = m.end()
        return out

    def _closes(self, text: str, i: int, out: list, brackets: list[int]) -> int:
        if not brackets:
            out.append("]")
            return i + 1
        at = brackets.pop()
        kind, begin, active = out[at]
        if not active:
            out[at] = kind
            out.append("]")
            return i + 1
        found = self._target(text, i + 1, text[begin:i])
        if found is None:
            out[at] = kind
            out.append("]")
            return i + 1
        target, title, end = found
        inner = self._render(out[at + 1 :])
        del out[at:]
        shown = f' title="{escape(_plain(title))}"' if title else ""
        if kind == "![":
            alt = re.sub(r"<img [^>]*alt=\"([^\"]*)\"[^>]*>", r"\1", inner)
            out.append(f'<img src="{_url(target)}" alt="{re.sub("<[^>]*>", "", alt)}"{shown} />')
        else:
            out.append(f'<a href="{_url(target)}"{shown}>{inner}</a>')
            for b in brackets:  # no links in links
                if out[b][0] == "[":
                    out[b][2] = False
        return end

    def _target(self, text: str, i: int, label: str):
        """(target, title, end) of an inline or reference link whose text ends before i."""
        if text[i : i + 1] == "(":
            m = re.compile(rf"\(\s*(?:(<(?:[^<>\n\\]|\\.)*>)|((?:[^\s()\\<]|\\.|\()(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))?(?:\s+({_TITLE}))?\s*\)", re.S).match(text, i)
            if m:
                target = m.group(1)[1:-1] if m.group(1) else m.group(2) or ""
                return target, (m.group(3) or "  ")[1:-1].strip() if m.group(3) else "", m.end()
        m = re.compile(_LABEL).match(text, i)
        if m and _key(m.group(1)) in self.links:
            return *self.links[_key(m.group(1))], m.end()
        if _key(label) in self.links and not m:
            end = i + 2 if text[i : i + 2] == "[]" else i
            return *self.links[_key(label)], end
        return None

    @staticmethod
    def _render(parts: list) -> str:
        """Emphasis by the delimiter rules; what is left of marks stays."""
        parts = [p if isinstance(p, str) else list(p) if p[0] in "*_" else p[0] for p in parts]
        k = 0
        while k < len(parts):
            closer = parts[k]
            if isinstance(closer, str) or not closer[3] or not closer[1]:
                k += 1
                continue
            for j in range(k - 1, -1, -1):
                opener = parts[j]
                if isinstance(opener, str) or opener[0] != closer[0] or not opener[2] or not opener[1]:
                    continue
                if (opener[3] or closer[2]) and (opener[4] + closer[4]) % 3 == 0 and (opener[4] % 3 or closer[4] % 3):
                    continue
                break
            else:
                k += 1
                continue
            size = 2 if opener[1] >= 2 and closer[1] >= 2 else 1
            name = "strong" if size == 2 else "em"
            inner = "".join(p if isinstance(p, str) else p[0] * p[1] for p in parts[j + 1 : k])
            opener[1] -= size
            closer[1] -= size
            parts[j + 1 : k] = [f"<{name}>{inner}</{name}>"]
            k = j + 2
        return "".join(p if isinstance(p, str) else p[0] * p[1] for p in parts)


def _html(nodes: list, inlines: Inlines, tight: bool = False) -> str:
    out = []
    for node in nodes:
        kind = node[0]
        if kind == "p":
            text = inlines.html(node[1])
            out.append(text + "\n" if tight else f"<p>{text}</p>\n")
        elif kind == "h":
            out.append(f"<h{node[1]}>{inlines.html(node[2])}</h{node[1]}>\n")
        elif kind == "code":
            language = node[1].split()[0] if node[1].split() else ""
            shown = f' class="language-{escape(language)}"' if language else ""
            out.append(f"<pre><code{shown}>{escape(node[2])}</code></pre>\n")
        elif kind == "hr":
            out.append("<hr />\n")
        elif kind == "html":
            out.append(OMITTED + "\n")
        elif kind == "quote":
            out.append(f"<blockquote>\n{_html(node[1], inlines)}</blockquote>\n")
        else:
            _, start, loose, items = node
            tag = "ul" if start is None else "ol"
            first = f' start="{start}"' if start not in (None, 1) else ""
            body = []
            for item in items:
                text = _html(item, inlines, not loose)
                if not loose and item and item[-1][0] == "p":
                    text = text.removesuffix("\n")
                head = "" if not item or (not loose and item[0][0] == "p") else "\n"
                body.append(f"<li>{head}{text}</li>\n")
            out.append(f"<{tag}{first}>\n{''.join(body)}</{tag}>\n")
    return "".join(out)


def render(text: str) -> str:
    blocks = Blocks()
    nodes = blocks.parse(re.split(r"\r\n|\n|\r", text.replace("\0", "\ufffd")))
    return _html(nodes, Inlines(blocks.links))


def markdown_to_html(data: bytes) -> bytes:
    return render(utf8(data)).encode()
