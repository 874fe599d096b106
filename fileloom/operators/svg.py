"""SVG to PNG at its natural size: shapes, paths, groups, reused elements, fills, strokes, gradients, clip paths, masks and
embedded pictures; text is not drawn, as without fonts. Filters are an error.

Coverage is counted on a grid of ``FINE`` x ``FINE`` points a pixel, by even-odd or winding crossings of each row.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
import xml.etree.ElementTree as ET

import numpy as np

from fileloom.operators.errors import ConversionError, UnsupportedCodec, utf8
from fileloom.operators.images import MOST_PIXELS, decode, encode_png

FINE = 4
STEPS = 24  # segments of a curve
# Pixels of a unit, and the colors that have a short name.
UNITS = {"": 1, "px": 1, "pt": 4 / 3, "pc": 16, "mm": 96 / 25.4, "cm": 96 / 2.54, "in": 96}
COLORS = {
    "black": "#000000", "silver": "#c0c0c0", "gray": "#808080", "grey": "#808080", "white": "#ffffff", "maroon": "#800000", "red": "#ff0000", "purple": "#800080",
    "fuchsia": "#ff00ff", "magenta": "#ff00ff", "green": "#008000", "lime": "#00ff00", "olive": "#808000", "yellow": "#ffff00", "navy": "#000080", "blue": "#0000ff",
    "teal": "#008080", "aqua": "#00ffff", "cyan": "#00ffff", "orange": "#ffa500", "pink": "#ffc0cb", "brown": "#a52a2a", "gold": "#ffd700", "indigo": "#4b0082",
}
INHERITED = {"fill": "black", "fill-opacity": "1", "fill-rule": "nonzero", "stroke": "none", "stroke-width": "1", "stroke-opacity": "1", "color": "black", "visibility": "visible"}
UNDRAWN = frozenset("defs clipPath mask marker pattern symbol title desc metadata style script text linearGradient radialGradient filter".split())
#: Elements that refer to each other are followed so deep.
DEEPEST = 24
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_PATH = re.compile(rf"([MmZzLlHhVvCcSsQqTtAa])|({_NUMBER.pattern})")


def length(text: str | None, default: float, whole: float = 100.0) -> float:
    if text is None:
        return default
    m = re.match(rf"\s*({_NUMBER.pattern})\s*(px|pt|pc|mm|cm|in|%)?\s*$", text)
    if not m:
        return default
    return float(m.group(1)) * (whole / 100 if m.group(2) == "%" else UNITS[m.group(2) or ""])


def color(text: str, current: str = "black") -> tuple[float, float, float, float] | None:
    text = text.strip().lower()
    if text in ("none", "transparent", ""):
        return None
    if text == "currentcolor":
        return color(current)
    text = COLORS.get(text, text)
    if m := re.fullmatch(r"#([0-9a-f]{3,8})", text):
        h = m.group(1)
        h = "".join(c * 2 for c in h) if len(h) < 6 else h
        v = [int(h[k : k + 2], 16) / 255 for k in range(0, len(h) - 1, 2)]
        return (*v[:3], v[3] if len(v) > 3 else 1.0)
    if m := re.fullmatch(r"rgba?\(([^)]*)\)", text):
        parts = re.split(r"[\s,/]+", m.group(1).strip())
        v = [float(p[:-1]) / 100 if p.endswith("%") else float(p) / (255 if k < 3 else 1) for k, p in enumerate(parts)]
        return (*v[:3], v[3] if len(v) > 3 else 1.0)
    return (0.0, 0.0, 0.0, 1.0)


def transform(text: str | None) -> np.ndarray:
    out = np.eye(3)
    for name, body in re.findall(r"(\w+)\s*\(([^)]*)\)", text or ""):
        v = [float(x) for x in _NUMBER.findall(body)]
        m = np.eye(3)
        if name == "matrix" and len(v) == 6:
            m[:2] = np.array(v).reshape(3, 2).T
        elif name == "translate" and v:
            m[:2, 2] = v[0], v[1] if len(v) > 1 else 0
        elif name == "scale" and v:
            m[0, 0], m[1, 1] = v[0], v[-1]
        elif name == "rotate" and v:
            c, s = math.cos(math.radians(v[0])), math.sin(math.radians(v[0]))
            m[:2, :2] = [[c, -s], [s, c]]
            if len(v) == 3:
                there, back = np.eye(3), np.eye(3)
                there[:2, 2], back[:2, 2] = v[1:], [-v[1], -v[2]]
                m = there @ m @ back
        elif name in ("skewX", "skewY") and v:
            m[(0, 1) if name == "skewX" else (1, 0)] = math.tan(math.radians(v[0]))
        out = out @ m
    return out


def _arc(p, rx, ry, turn, large, sweep, q):
    """Points of an elliptical arc from p to q."""
    if p == q:
        return []
    rx, ry = abs(rx), abs(ry)
    if not (rx and ry):
        return [q]
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    dx, dy = (p[0] - q[0]) / 2, (p[1] - q[1]) / 2
    x, y = c * dx + s * dy, -s * dx + c * dy
    grow = (x / rx) ** 2 + (y / ry) ** 2
    if grow > 1:
        rx, ry = rx * math.sqrt(grow), ry * math.sqrt(grow)
    below = (rx * y) ** 2 + (ry * x) ** 2
    k = math.sqrt(max(0.0, ((rx * ry) ** 2 - below) / below)) * (-1 if large == sweep else 1)
    cx, cy = k * rx * y / ry, -k * ry * x / rx
    a = math.atan2((y - cy) / ry, (x - cx) / rx)
    d = math.atan2((-y - cy) / ry, (-x - cx) / rx) - a
    d += 2 * math.pi * ((sweep and d < 0) - (not sweep and d > 0))
    mx, my = (p[0] + q[0]) / 2, (p[1] + q[1]) / 2
    out = []
    for i in range(1, 2 * STEPS + 1):
        t = a + d * i / (2 * STEPS)
        u, v = rx * math.cos(t) + cx, ry * math.sin(t) + cy
        out.append((c * u - s * v + mx, s * u + c * v + my))
    return out


def _bezier(points) -> list[tuple[float, float]]:
    t = np.linspace(0, 1, STEPS + 1)[1:, None]
    p = [np.array(x) for x in points]
    while len(p) > 1:
        p = [(1 - t) * a + t * b for a, b in zip(p, p[1:], strict=False)]
    return list(map(tuple, p[0]))


def path(d: str) -> list[tuple[list[tuple[float, float]], bool]]:
    """(points, closed) of each part; what follows a mistake is left out."""
    tokens = [(m.group(1), m.group(2)) for m in _PATH.finditer(d)]
    out: list = []
    now, begin, last, i, op = (0.0, 0.0), (0.0, 0.0), None, 0, None
    points: list[tuple[float, float]] = []
    need = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
    while i < len(tokens):
        if tokens[i][0]:
            op = tokens[i][0]
            i += 1
        elif op is None or op in "Zz":
            break
        up, n = op.upper(), need[op.upper()]
        v = [float(t[1]) for t in tokens[i : i + n] if t[1]]
        if len(v) < n:
            break
        i += n
        ox, oy = now if op.islower() else (0.0, 0.0)
        pair = lambda k: (v[k] + ox, v[k + 1] + oy)  # noqa: B023, E731
        if up == "Z":
            if points:
                out.append((points, True))
            now, points, last = begin, [], None
            continue
        if up == "M":
            if len(points) > 1:
                out.append((points, False))
            now = begin = pair(0)
            points, op, last = [now], "l" if op == "m" else "L", None
            continue
        points = points or [now]
        if up == "L":
            points.append(pair(0))
            last = None
        elif up == "H":
            points.append((v[0] + ox, now[1]))
            last = None
        elif up == "V":
            points.append((now[0], v[0] + oy))
            last = None
        elif up in "CS":
            c1 = pair(0) if up == "C" else (2 * now[0] - last[1][0], 2 * now[1] - last[1][1]) if last and last[0] == "C" else now
            c2, q = (pair(2), pair(4)) if up == "C" else (pair(0), pair(2))
            points += _bezier([now, c1, c2, q])
            last = ("C", c2)
        elif up in "QT":
            c1 = pair(0) if up == "Q" else (2 * now[0] - last[1][0], 2 * now[1] - last[1][1]) if last and last[0] == "Q" else now
            points += _bezier([now, c1, pair(2) if up == "Q" else pair(0)])
            last = ("Q", c1)
        else:
            points += _arc(now, v[0], v[1], v[2], bool(v[3]), bool(v[4]), pair(5))
            last = None
        now = points[-1]
    if len(points) > 1:
        out.append((points, False))
    return out


def _ellipse(cx, cy, rx, ry):
    t = np.linspace(0, 2 * math.pi, 4 * STEPS, endpoint=False)
    return [(list(zip(cx + rx * np.cos(t), cy + ry * np.sin(t), strict=True)), True)]


def shape(tag: str, at: dict[str, str], size: tuple[float, float]) -> list:
    w, h = size
    get = lambda k, whole=w, default=0.0: length(at.get(k), default, whole)
    if tag == "path":
        return path(at.get("d", ""))
    if tag == "rect":
        x, y, rw, rh = get("x"), get("y", h), get("width"), get("height", h)
        if rw <= 0 or rh <= 0:
            return []
        rx, ry = get("rx", w, -1.0), get("ry", h, -1.0)
        rx, ry = (max(ry, 0) if rx < 0 else rx), (max(rx, 0) if ry < 0 else ry)
        rx, ry = min(rx, rw / 2), min(ry, rh / 2)
        if rx and ry:
            return path(f"M{x + rx} {y}H{x + rw - rx}A{rx} {ry} 0 0 1 {x + rw} {y + ry}V{y + rh - ry}A{rx} {ry} 0 0 1 {x + rw - rx} {y + rh}H{x + rx}A{rx} {ry} 0 0 1 {x} {y + rh - ry}V{y + ry}A{rx} {ry} 0 0 1 {x + rx} {y}Z")
        return [([(x, y), (x + rw, y), (x + rw, y + rh), (x, y + rh)], True)]
    if tag == "circle":
        r = get("r")
        return _ellipse(get("cx"), get("cy", h), r, r) if r > 0 else []
    if tag == "ellipse":
        rx, ry = get("rx"), get("ry", h)
        return _ellipse(get("cx"), get("cy", h), rx, ry) if rx > 0 and ry > 0 else []
    if tag == "line":
        return [([(get("x1"), get("y1", h)), (get("x2"), get("y2", h))], False)]
    if tag in ("polyline", "polygon"):
        v = [float(x) for x in _NUMBER.findall(at.get("points", ""))]
        return [(list(zip(v[::2], v[1::2], strict=False)), tag == "polygon")] if len(v) >= 4 else []
    return []


def _turned(polygon: list) -> tuple[list, bool]:
    """All polygons of a stroke turn one way, so that their windings add up."""
    p = np.array(polygon)
    area = (p[:, 0] * np.roll(p[:, 1], -1) - p[:, 1] * np.roll(p[:, 0], -1)).sum()
    return (polygon if area >= 0 else polygon[::-1]), True


def outline(parts: list, width: float, miter_limit: float = 4.0) -> list:
    """Each segment as a rectangle and each corner as a miter (a bevel beyond the limit): their union is the stroke."""
    out = []
    for points, closed in parts:
        p = [np.array(x, float) for x in points]
        p = [x for k, x in enumerate(p) if k == 0 or np.hypot(*(x - p[k - 1])) > 1e-9]
        if closed and len(p) > 1 and np.hypot(*(p[0] - p[-1])) < 1e-9:
            p.pop()
        ends = list(zip(p, p[1:] + p[:1] if closed else p[1:], strict=False))
        ways = [(b - a) / np.hypot(*(b - a)) for a, b in ends if np.hypot(*(b - a)) > 1e-9]
        for (a, b), d in zip(ends, ways, strict=False):
            side = np.array([-d[1], d[0]]) * width / 2
            out.append(_turned([tuple(a + side), tuple(b + side), tuple(b - side), tuple(a - side)]))
        for k in range(0 if closed else 1, len(ways)):
            c, d1, d2 = ends[k][0], ways[k - 1], ways[k]
            cross, dot = d1[0] * d2[1] - d1[1] * d2[0], float(d1 @ d2)
            if abs(cross) < 1e-9:
                continue
            way = -math.copysign(1, cross) * width / 2
            s1, s2 = np.array([-d1[1], d1[0]]) * way, np.array([-d2[1], d2[0]]) * way
            corner = [tuple(c), tuple(c + s1), tuple(c + s2)]
            if 2 / (1 + dot) <= miter_limit**2:  # one over the squared sine of half the angle
                corner.insert(2, tuple(c + (s1 + s2) / (1 + dot)))
            out.append(_turned(corner))
    return out


def coverage(parts: list, m: np.ndarray, width: int, height: int, even_odd: bool) -> np.ndarray:
    """Share of each pixel that the parts cover."""
    edges = []
    for points, _ in parts:
        p = np.array(points, float) @ m[:2, :2].T + m[:2, 2]
        edges.append(np.hstack([p, np.roll(p, -1, axis=0)]))
    total = np.zeros((height, width))
    if not edges:
        return total
    e = np.vstack(edges) * FINE
    direction = np.sign(e[:, 3] - e[:, 1])
    e = np.where((e[:, 1] > e[:, 3])[:, None], e[:, [2, 3, 0, 1]], e)
    for row in range(max(0, int(e[:, 1].min())), min(height * FINE, int(e[:, 3].max()) + 1)):
        y = row + 0.5
        cross = (e[:, 1] <= y) & (e[:, 3] > y)
        if not cross.any():
            continue
        o = e[cross]
        x = o[:, 0] + (y - o[:, 1]) * (o[:, 2] - o[:, 0]) / (o[:, 3] - o[:, 1])
        place = np.clip(np.ceil(x - 0.5), 0, width * FINE).astype(int)
        wind = np.zeros(width * FINE + 1, np.int64)
        np.add.at(wind, place, direction[cross].astype(np.int64))
        if even_odd:
            wind[:] = 0
            np.add.at(wind, place, 1)
        wind = np.cumsum(wind)[:-1]
        inside = wind % 2 != 0 if even_odd else wind != 0
        total[row // FINE] += inside.reshape(width, FINE).sum(axis=1)
    return total / (FINE * FINE)


def _fitted(box: list[float], width: float, height: float, aspect: str) -> np.ndarray:
    """A view box in the middle of a width and height, stretched only if the aspect says so."""
    x, y, w, h = box
    sx, sy = width / w, height / h
    if aspect.strip() != "none":
        sx = sy = min(sx, sy)
    return np.array([[sx, 0, (width - sx * w) / 2 - sx * x], [0, sy, (height - sy * h) / 2 - sy * y], [0, 0, 1]])


def _over(canvas: np.ndarray, layer: np.ndarray) -> None:
    """Puts a layer of premultiplied colors on the canvas."""
    canvas *= 1 - layer[..., 3:]
    canvas += layer


class Drawing:
    def __init__(self, text: str) -> None:
        try:
            self.root = ET.fromstring(text)
        except (ET.ParseError, ValueError) as e:
            raise ConversionError(f"Failed to parse SVG: {e}") from None
        if self.root.tag.rpartition("}")[2] != "svg":
            raise ConversionError("Failed to parse SVG: no svg element")
        box = [float(x) for x in _NUMBER.findall(self.root.get("viewBox", ""))]
        self.box = box if len(box) == 4 and box[2] > 0 and box[3] > 0 else None
        own = (self.box[2], self.box[3]) if self.box else (100.0, 100.0)
        self.width, self.height = length(self.root.get("width"), own[0], own[0]), length(self.root.get("height"), own[1], own[1])
        if self.width <= 0 or self.height <= 0:
            raise ConversionError("SVG has zero dimensions")
        self.size = math.ceil(self.width), math.ceil(self.height)
        self.ids = {n.get("id"): n for n in self.root.iter() if n.get("id")}
        if self.size[0] * self.size[1] > MOST_PIXELS >> 4:
            raise ConversionError("Failed to create pixmap")

    def png(self) -> bytes:
        m = _fitted(self.box, self.width, self.height, self.root.get("preserveAspectRatio", "")) if self.box else np.eye(3)
        canvas = np.zeros((self.size[1], self.size[0], 4))
        for child in self.root:
            self._draw(child, canvas, m, self._style(self.root, INHERITED)[0])
        alpha = canvas[..., 3:]
        rgb = np.divide(canvas[..., :3], alpha, out=np.zeros_like(canvas[..., :3]), where=alpha > 0)
        return encode_png(np.rint(np.concatenate([rgb, alpha], axis=2).clip(0, 1) * 255).astype(np.uint8))

    @staticmethod
    def _own(node: ET.Element) -> dict[str, str]:
        """Attributes, with what the style attribute says."""
        return dict(node.attrib) | {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in node.get("style", "").split(";")) if v}

    def _style(self, node: ET.Element, inherited: dict[str, str]) -> tuple[dict[str, str], float, bool]:
        own = self._own(node)
        style = inherited | {k: own[k] for k in INHERITED if k in own and own[k] != "inherit"}
        return style, min(max(length(own.get("opacity"), 1.0), 0.0), 1.0), own.get("display") != "none"

    def _referred(self, text: str | None) -> ET.Element | None:
        found = re.match(r"\s*(?:url\(\s*['\"]?)?#([^'\")\s]+)", text or "")
        return self.ids.get(found.group(1)) if found else None

    def _whole(self) -> tuple[float, float]:
        return (self.box[2], self.box[3]) if self.box else (self.width, self.height)

    def _draw(self, node: ET.Element, canvas: np.ndarray, m: np.ndarray, inherited: dict[str, str], deep: int = 0) -> None:
        tag = node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""
        if tag == "foreignObject":
            raise UnsupportedCodec(f"SVG element {tag}")
        style, opacity, shown = self._style(node, inherited)
        if not tag or tag in UNDRAWN or not shown or not opacity or deep > DEEPEST:
            return
        own = self._own(node)
        if own.get("filter", "none") != "none":
            raise UnsupportedCodec("SVG filters")
        m = m @ transform(node.get("transform"))
        clip, mask = self._referred(own.get("clip-path")), self._referred(own.get("mask"))
        apart = opacity < 1 or clip is not None or mask is not None
        target = np.zeros_like(canvas) if apart else canvas
        parts = []
        if tag in ("g", "svg", "a", "switch"):
            if tag == "svg":
                m = m @ transform(f"translate({length(node.get('x'), 0)} {length(node.get('y'), 0)})")
            for child in node:
                self._draw(child, target, m, style, deep + 1)
        elif tag == "use":
            self._use(node, target, m, style, deep)
        elif tag == "image":
            if style["visibility"] == "visible":
                self._image(node, target, m)
        elif style["visibility"] == "visible":
            parts = shape(tag, node.attrib, self._whole())
            fill = self._color(style["fill"], style["color"], parts, m)
            if fill is not None and tag != "line":
                self._paint(target, parts, m, fill, float(style["fill-opacity"]), style["fill-rule"] == "evenodd")
            stroke, width = self._color(style["stroke"], style["color"], parts, m), length(style["stroke-width"], 1.0)
            if stroke is not None and width > 0:
                self._paint(target, outline(parts, width), m, stroke, float(style["stroke-opacity"]), False)
        if apart:
            held = np.full((*canvas.shape[:2], 1), opacity)
            if clip is not None:
                held *= self._clip(clip, parts, m)[..., None]
            if mask is not None:
                held *= self._mask(mask, parts, m, deep)[..., None]
            _over(canvas, target * held)

    def _href(self, node: ET.Element) -> str:
        return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == "href"), "").strip()

    def _use(self, node: ET.Element, canvas: np.ndarray, m: np.ndarray, style: dict[str, str], deep: int) -> None:
        """Draws another element at x, y; a symbol's view box fills the width and height that are asked for."""
        other = self._referred(self._href(node))
        if other is None:
            return
        w, h = self._whole()
        m = m @ transform(f"translate({length(node.get('x'), 0, w)} {length(node.get('y'), 0, h)})")
        if other.tag.rpartition("}")[2] != "symbol":
            self._draw(other, canvas, m, style, deep + 1)
            return
        box = [float(x) for x in _NUMBER.findall(other.get("viewBox", ""))]
        if len(box) == 4 and box[2] > 0 and box[3] > 0:
            wide, high = length(node.get("width"), w, w), length(node.get("height"), h, h)
            m = m @ _fitted(box, wide, high, other.get("preserveAspectRatio", ""))
        own = self._style(other, style)[0]
        for child in other:
            self._draw(child, canvas, m, own, deep + 1)

    def _image(self, node: ET.Element, canvas: np.ndarray, m: np.ndarray) -> None:
        """A picture in a data URI, sampled at FINE x FINE points a pixel."""
        found = re.match(r"data:image/(png|jpeg|jpg|gif|webp|bmp);base64,(.*)", self._href(node), re.S)
        if not found:
            raise UnsupportedCodec("SVG images other than data URIs")
        try:
            raw = base64.b64decode(re.sub(r"\s", "", found.group(2)), validate=True)
        except binascii.Error:
            raise ConversionError("Failed to parse SVG: broken data URI") from None
        picture = decode(raw, found.group(1)).astype(float) / 255
        high, wide = picture.shape[:2]
        whole = self._whole()
        w, h = length(node.get("width"), wide, whole[0]), length(node.get("height"), high, whole[1])
        if w <= 0 or h <= 0:
            return
        place = transform(f"translate({length(node.get('x'), 0, whole[0])} {length(node.get('y'), 0, whole[1])})") @ _fitted([0, 0, wide, high], w, h, node.get("preserveAspectRatio", ""))
        back = np.linalg.pinv(m @ place)
        layer = np.zeros_like(canvas)
        for dy in range(FINE):
            for dx in range(FINE):
                yy, xx = np.mgrid[0 : self.size[1], 0 : self.size[0]]
                px, py = xx + (dx + 0.5) / FINE, yy + (dy + 0.5) / FINE
                u, v = (back[k, 0] * px + back[k, 1] * py + back[k, 2] for k in (0, 1))
                inside = (u >= 0) & (u < wide) & (v >= 0) & (v < high)
                seen = picture[v[inside].astype(int), u[inside].astype(int)]
                layer[inside] += np.concatenate([seen[:, :3] * seen[:, 3:], seen[:, 3:]], axis=1)
        _over(canvas, layer / FINE**2)

    def _boxed(self, units: str, parts: list, m: np.ndarray) -> np.ndarray:
        """The space of a clip path or mask: the element's, or that of its bounding box."""
        if units != "objectBoundingBox":
            return m
        points = np.array([p for own, _ in parts for p in own], float)
        if not len(points):
            raise UnsupportedCodec("SVG clip paths and masks by the bounding box of a group")
        low, size = points.min(0), np.ptp(points, axis=0)
        return m @ np.array([[size[0], 0, low[0]], [0, size[1], low[1]], [0, 0, 1]])

    def _clip(self, clip: ET.Element, parts: list, m: np.ndarray) -> np.ndarray:
        space = self._boxed(clip.get("clipPathUnits", ""), parts, m) @ transform(clip.get("transform"))
        out = np.zeros((self.size[1], self.size[0]))
        for child in clip:
            own, at = child, space @ transform(child.get("transform"))
            if isinstance(child.tag, str) and child.tag.rpartition("}")[2] == "use":
                own = self._referred(self._href(child))
                if own is None:
                    continue
                at = at @ transform(f"translate({length(child.get('x'), 0)} {length(child.get('y'), 0)})") @ transform(own.get("transform"))
            tag = own.tag.rpartition("}")[2] if isinstance(own.tag, str) else ""
            if tag and tag not in UNDRAWN:
                even_odd = self._own(own).get("clip-rule", self._own(clip).get("clip-rule")) == "evenodd"
                out = np.maximum(out, coverage(shape(tag, own.attrib, self._whole()), at, self.size[0], self.size[1], even_odd))
        return out

    def _mask(self, mask: ET.Element, parts: list, m: np.ndarray, deep: int) -> np.ndarray:
        """Luminance times alpha of what the mask draws (alpha alone, if it says so)."""
        layer = np.zeros((self.size[1], self.size[0], 4))
        space = self._boxed(mask.get("maskContentUnits", ""), parts, m)
        for child in mask:
            self._draw(child, layer, space, self._style(mask, INHERITED)[0], deep + 1)
        return layer[..., 3] if self._own(mask).get("mask-type") == "alpha" else layer[..., :3] @ np.array([0.2125, 0.7154, 0.0721])

    def _color(self, text: str, current: str, parts: list, m: np.ndarray) -> np.ndarray | None:
        """One color, or one for each pixel."""
        found = re.match(r"url\(\s*['\"]?#([^'\")]+)['\"]?\s*\)\s*(.*)", text)
        if found and found.group(1) in self.ids:
            return self._gradient(self.ids[found.group(1)], parts, m)
        out = color(found.group(2) if found else text, current)
        return None if out is None else np.array(out)

    def _gradient(self, node: ET.Element, parts: list, m: np.ndarray) -> np.ndarray | None:
        chain = [node]
        while (href := next((v for k, v in chain[-1].attrib.items() if k.rpartition("}")[2] == "href"), "")) and len(chain) < 16 and href[1:] in self.ids:
            chain.append(self.ids[href[1:]])
        kind = node.tag.rpartition("}")[2]
        if kind not in ("linearGradient", "radialGradient"):
            raise UnsupportedCodec(f"SVG paint server {kind}")
        at = lambda name, default=None: next((n.get(name) for n in chain if n.get(name) is not None), default)
        stops = next((own for n in chain if (own := [s for s in n if isinstance(s.tag, str) and s.tag.rpartition("}")[2] == "stop"])), [])
        points = np.array([p for own, _ in parts for p in own], float)
        if not stops or not len(points):
            return None
        offsets, colors = [], []
        for s in stops:
            own = dict(s.attrib) | {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in s.get("style", "").split(";")) if v}
            rgb = color(own.get("stop-color", "black")) or (0.0, 0.0, 0.0, 0.0)
            offsets.append(max([length(own.get("offset"), 0.0, 1.0), *offsets[-1:]]))
            colors.append((*rgb[:3], rgb[3] * length(own.get("stop-opacity"), 1.0, 1.0)))
        low, size = points.min(0), np.ptp(points, axis=0)
        boxed = at("gradientUnits", "objectBoundingBox") != "userSpaceOnUse"
        if boxed and not size.all():
            return np.array(colors[-1])
        w, h = (1.0, 1.0) if boxed else (self.box[2:] if self.box else (self.width, self.height))
        space = m @ np.array([[size[0], 0, low[0]], [0, size[1], low[1]], [0, 0, 1]]) if boxed else m
        back = np.linalg.pinv(space @ transform(at("gradientTransform")))
        yy, xx = np.mgrid[0 : self.size[1], 0 : self.size[0]] + 0.5
        x, y = (back[k, 0] * xx + back[k, 1] * yy + back[k, 2] for k in (0, 1))
        get = lambda name, default, whole: length(at(name, default), 0.0, whole)
        if kind == "linearGradient":
            x1, y1, x2, y2 = get("x1", "0%", w), get("y1", "0%", h), get("x2", "100%", w), get("y2", "0%", h)
            span = (x2 - x1) ** 2 + (y2 - y1) ** 2
            if not span:
                return np.array(colors[-1])
            t = ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / span
        else:
            cx, cy, r = get("cx", "50%", w), get("cy", "50%", h), get("r", "50%", math.hypot(w, h) / math.sqrt(2))
            if r <= 0:
                return np.array(colors[-1])
            fx, fy = length(at("fx"), cx, w), length(at("fy"), cy, h)
            ex, ey, qx, qy = cx - fx, cy - fy, x - fx, y - fy
            a, b = min(ex * ex + ey * ey - r * r, -1e-9), qx * ex + qy * ey
            t = (b - np.sqrt(np.maximum(b * b - a * (qx * qx + qy * qy), 0))) / a
        spread = at("spreadMethod", "pad")
        if spread == "repeat":
            t = t % 1
        elif spread == "reflect":
            t = 1 - np.abs(t % 2 - 1)
        return np.stack([np.interp(t, offsets, [c[k] for c in colors]) for k in range(4)], axis=2)

    def _paint(self, canvas: np.ndarray, parts: list, m: np.ndarray, paint: np.ndarray, opacity: float, even_odd: bool) -> None:
        alpha = coverage(parts, m, self.size[0], self.size[1], even_odd)[..., None] * paint[..., 3:] * min(max(opacity, 0.0), 1.0)
        _over(canvas, np.concatenate([alpha * paint[..., :3], alpha], axis=2))


def svg_to_png(data: bytes) -> bytes:
    return Drawing(utf8(data, "Invalid UTF-8 in SVG")).png()
