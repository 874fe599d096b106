import numpy as np
import pytest

from fileloom.operators import images, svg
from fileloom.operators.errors import ConversionError

HEAD = '<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink" '


def draw(body, size='width="20" height="10"'):
    return images.decode_png(svg.svg_to_png(f"{HEAD}{size}>{body}</svg>".encode()))


def test_shapes():
    a = draw('<rect width="8" height="10" fill="red"/><circle cx="14" cy="5" r="4" fill="#00f" fill-opacity=".5"/><line x1="0" y1="9.5" x2="20" y2="9.5" stroke="lime"/>')
    assert a.shape == (10, 20, 4)
    assert a[4, 3].tolist() == [255, 0, 0, 255] and a[5, 14].tolist() == [0, 0, 255, 128] and a[9, 10].tolist() == [0, 255, 0, 255] and a[0, 10, 3] == 0
    assert abs(int((draw('<circle cx="10" cy="5" r="4"/>')[..., 3] / 255).sum()) - np.pi * 16) < 1


def test_paths_transforms_styles():
    same = [
        '<path d="M2 2h6v6h-6z" fill="green"/>',
        '<path style="fill:#008000" d="m2,2 l6,0 0,6 -6 0 Z"/>',
        '<g transform="translate(2 2) scale(2)" fill="rgb(0,128,0)"><polygon points="0,0 3,0 3,3 0,3"/></g>',
        '<rect x="-8" y="2" width="6" height="6" transform="rotate(180 0 5)" fill="green"/>',
        '<svg x="1" y="1" fill="green"><rect x="1" y="1" width="6" height="6"/></svg>',
        '<path fill="green" stroke="none" d="M2 2 H8 V8 H2 V2 M100 100 L101 101"/>',
    ]
    assert all(np.array_equal(draw(x), draw(same[0])) for x in same)
    assert draw('<path fill-rule="evenodd" d="M0 0h10v10h-10zM2 2h6v6h-6z"/>')[5, 5, 3] == 0
    assert draw('<path d="M0 0h10v10h-10zM2 2h6v6h-6z"/>')[5, 5, 3] == 255
    ring = draw('<rect x="3" y="3" width="6" height="4" fill="none" stroke="black" stroke-width="2"/>')
    assert ring[2, 2, 3] == 255 and ring[5, 6, 3] == 0
    half = draw('<g opacity=".5"><rect width="5" height="5"/><rect width="5" height="5"/></g>')
    assert half[2, 2, 3] == 128
    arc = draw('<path d="M6 5A4 4 0 1 1 14 5A4 4 0 1 1 6 5"/>')
    assert np.abs(arc.astype(int) - draw('<circle cx="10" cy="5" r="4"/>')).max() <= 16


def test_gradients():
    stops = '<stop offset="0" stop-color="black"/><stop offset="100%" style="stop-color:#fff"/>'
    a = draw(f'<linearGradient id="s">{stops}</linearGradient><linearGradient id="g" xlink:href="#s"/><rect width="20" height="10" fill="url(#g)"/>')
    assert np.abs(a[5, :, 0] - (np.arange(20) + 0.5) / 20 * 255).max() < 1
    b = draw(f'<linearGradient id="g" gradientUnits="userSpaceOnUse" x1="0" x2="10" spreadMethod="reflect">{stops}</linearGradient><rect width="20" height="10" fill="url(#g)"/>')
    assert np.array_equal(b[5, :10], b[5, :9:-1])
    c = draw(f'<radialGradient id="g" gradientUnits="userSpaceOnUse" cx="10" cy="5" r="5">{stops}</radialGradient><rect width="20" height="10" fill="url(#g)"/>')
    assert c[5, 0, 0] == 255 and abs(int(c[5, 12, 0]) - 2.55 / 5 * 255) < 2
    assert draw('<rect width="9" height="9" fill="url(#none) red"/>')[1, 1].tolist() == [255, 0, 0, 255]


def test_reused_elements():
    want = draw('<rect x="3" y="2" width="4" height="4" fill="red"/>')
    same = [
        '<defs><rect id="r" width="4" height="4"/></defs><use href="#r" x="3" y="2" fill="red"/>',
        '<defs><g id="r" transform="translate(1 1)"><rect width="4" height="4"/></g></defs><use xlink:href="#r" transform="translate(2 1)" fill="red"/>',
        '<symbol id="r" viewBox="0 0 8 8"><rect width="8" height="8" fill="red"/></symbol><use href="#r" x="3" y="2" width="4" height="4"/>',
        '<defs><use id="a" href="#r" x="1"/><rect id="r" width="4" height="4"/></defs><use href="#a" x="2" y="2" fill="red"/>',
    ]
    assert all(np.array_equal(draw(x), want) for x in same)
    assert draw('<use href="#none"/><g id="g"><use href="#g"/><rect width="2" height="2"/></g>')[1, 1, 3] == 255


def test_clip_paths_and_masks():
    want = draw('<rect x="2" y="1" width="4" height="6" fill="blue"/>')
    same = [
        '<clipPath id="c"><rect x="2" y="1" width="4" height="6"/></clipPath><rect width="20" height="10" fill="blue" clip-path="url(#c)"/>',
        '<clipPath id="c"><rect x="2" y="1" width="2" height="6"/><path d="M4 1h2v6h-2z"/></clipPath><g style="clip-path:url(#c)"><rect width="20" height="10" fill="blue"/></g>',
        '<clipPath id="c" clipPathUnits="objectBoundingBox"><rect x="0.1" y="0.1" width="0.2" height="0.6"/></clipPath><rect width="20" height="10" fill="blue" clip-path="url(#c)"/>',
        '<defs><rect id="r" width="4" height="6"/></defs><clipPath id="c"><use href="#r" x="2" y="1"/></clipPath><rect width="20" height="10" fill="blue" clip-path="url(#c)"/>',
        '<mask id="c"><rect x="2" y="1" width="4" height="6" fill="white"/></mask><rect width="20" height="10" fill="blue" mask="url(#c)"/>',
        '<mask id="c" style="mask-type:alpha"><rect x="2" y="1" width="4" height="6"/></mask><rect width="20" height="10" fill="blue" mask="url(#c)"/>',
    ]
    assert all(np.array_equal(draw(x), want) for x in same)
    half = draw('<mask id="c"><rect width="9" height="9" fill="#00ff00" fill-opacity=".5"/></mask><rect width="9" height="9" mask="url(#c)"/>')
    assert abs(int(half[4, 4, 3]) - 0.7154 * 0.5 * 255) < 2
    assert draw('<rect width="9" height="9" clip-path="url(#none)"/>')[4, 4, 3] == 255


def test_embedded_pictures():
    import base64

    own = np.arange(24, dtype=np.uint8).reshape(2, 3, 4) * 10
    own[..., 3] = 255
    uri = "data:image/png;base64," + base64.b64encode(images.encode_png(own)).decode()
    a = draw(f'<image href="{uri}" x="4" y="3"/>')
    assert np.array_equal(a[3:5, 4:7], own) and a[..., 3].sum() == 6 * 255
    b = draw(f'<image xlink:href="{uri}" width="6" height="8"/>')  # in the middle, twice as large
    assert np.array_equal(b[2:6, :6], own.repeat(2, 0).repeat(2, 1)) and b[..., 3].sum() == 24 * 255
    c = draw(f'<image href="{uri}" width="6" height="8" preserveAspectRatio="none"/>')
    assert np.array_equal(c[:8, :6], own.repeat(4, 0).repeat(2, 1))


def test_sizes():
    assert draw("", 'viewBox="0 0 7 3"').shape[:2] == (3, 7)
    assert draw("", 'width="1in" height="2.2"').shape[:2] == (3, 96)
    assert draw("", "").shape[:2] == (100, 100)
    assert draw('<text>no fonts</text><rect display="none" width="9" height="9"/>')[..., 3].max() == 0
    for bad in ("", "<x/>", "<svg", f'{HEAD} width="-1"/>', f"{HEAD}><image/></svg>", f"{HEAD}><foreignObject/></svg>", f'{HEAD}><rect width="1" height="1" filter="url(#f)"/></svg>'):
        with pytest.raises(ConversionError):
            svg.svg_to_png(bad.encode())
