import pytest

from fileloom.operators.markdown import OMITTED, render

CASES = {
    "**bold** _em_ `c <d>` \\*": "<p><strong>bold</strong> <em>em</em> <code>c &lt;d&gt;</code> *</p>\n",
    "*a **b** c* snake_case_x": "<p><em>a <strong>b</strong> c</em> snake_case_x</p>\n",
    "***x***": "<p><em><strong>x</strong></em></p>\n",
    "**a* b": "<p>*<em>a</em> b</p>\n",
    "*a `*` b*": "<p><em>a <code>*</code> b</em></p>\n",
    "T\n===\n\nS\n---\n\n***": "<h1>T</h1>\n<h2>S</h2>\n<hr />\n",
    "# A #\n###### f\n#no": "<h1>A</h1>\n<h6>f</h6>\n<p>#no</p>\n",
    "```rust\nfn main() {}\n```": '<pre><code class="language-rust">fn main() {}\n</code></pre>\n',
    "~~~\n```\n~~~": "<pre><code>```\n</code></pre>\n",
    "    a\n\n      b\nc": "<pre><code>a\n\n  b\n</code></pre>\n<p>c</p>\n",
    "> q\nlazy\n\n1. x\n   - y\n2. z": "<blockquote>\n<p>q\nlazy</p>\n</blockquote>\n<ol>\n<li>x\n<ul>\n<li>y</li>\n</ul>\n</li>\n<li>z</li>\n</ol>\n",
    "- a\n- b\n\n- c": "<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n<li>\n<p>c</p>\n</li>\n</ul>\n",
    "- a\n* b\n3) c": '<ul>\n<li>a</li>\n</ul>\n<ul>\n<li>b</li>\n</ul>\n<ol start="3">\n<li>c</li>\n</ol>\n',
    "a\n2. b": "<p>a\n2. b</p>\n",
    "a  \nb\\\nc\nd": "<p>a<br />\nb<br />\nc\nd</p>\n",
    '[l](/u "t") ![i *x*](a.png) <http://x.y?a=b&c> <a@b.c>': '<p><a href="/u" title="t">l</a> <img src="a.png" alt="i x" /> <a href="http://x.y?a=b&amp;c">http://x.y?a=b&amp;c</a> <a href="mailto:a@b.c">a@b.c</a></p>\n',
    "[f][r] [r] [R][] [n]\n\n[r]: /url 'ti'": '<p><a href="/url" title="ti">f</a> <a href="/url" title="ti">r</a> <a href="/url" title="ti">R</a> [n]</p>\n',
    "[a](javascript:x)": '<p><a href="">a</a></p>\n',
    "<div>\nraw\n</div>\n\nx <b>y</b>": f"{OMITTED}\n<p>x {OMITTED}y{OMITTED}</p>\n",
    "&copy; &amp; & &#65; &nosuch; a<b": "<p>© &amp; &amp; A &amp;nosuch; a&lt;b</p>\n",
    "": "",
    "-": "<ul>\n<li></li>\n</ul>\n",
    "\ta": "<pre><code>a\n</code></pre>\n",
}


@pytest.mark.parametrize("source", CASES)
def test_case(source):
    assert render(source) == CASES[source]


@pytest.mark.parametrize("source", ["[" * 2000, "*a" * 3000, "`" * 999 + "x", "> " * 60 + "x", "- " * 40 + "x", "<" * 3000, "![" * 500 + "a](b)"])
def test_deep_input_ends(source):
    assert isinstance(render(source), str)
