import random

import numpy as np
import pytest

from fileloom.llm import suffix_dedup as sd


def plain(rows, n=50):
    """(doc_id, removed spans, kept) of (doc_id, text) rows."""
    last = 2**63
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            s = b[k : k + n]
            least[s] = min(least.get(s, last), last if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - n + 1):
            if least[b[k : k + n]] < (last if i is None else i):
                gone[k + 1 : k + 1 + n] = True
        edge = np.flatnonzero(np.diff(gone))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        out.append((i, len(b), spans, bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])))
    return out


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in sd.dedup(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows)))


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_tables(request, name):
    check(request.getfixturevalue(name))


def test_largest_id_is_no_null(spark):
    rows = [(2**63 - 1, "x" * 60), (None, "y" * 60), (1, "x" * 50)]
    got = {r.doc_id: bytes(r.kept) for r in sd.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2**63 - 1: b"", None: b"y" * 60, 1: b"x" * 50}


@pytest.mark.parametrize("hot", [sd.HOT, 2])
def test_planted(spark, monkeypatch, hot):
    """hot = 2: nearly all groups count as too large for one task."""
    monkeypatch.setattr(sd, "HOT", hot)
    rng = random.Random(11)
    letters = "ab "
    shared = ["".join(rng.choices("abcdefgh ", k=k)) for k in (49, 50, 51, 60, 90, 200, 700)]
    shared += ["a" * 130, "ab" * 80, "é" * 40, "x\x00" * 30]
    rows = []
    for i in range(300):
        text = "".join("".join(rng.choices(letters + "cdefghijklm", k=rng.randint(0, 80))) + rng.choice(shared) for _ in range(rng.randint(0, 3)))
        rows.append((rng.choice([None, i, i, i]), text or None))
    rows += rows[:20] + [(1000 + i, rows[5][1]) for i in range(50)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(2)
    common = "".join(rng.choices("abcdefghijklmnop ", k=400))
    long = "".join("".join(rng.choices("abcdefghijklmnop ", k=2000)) + common[rng.randint(0, 300) :] for _ in range(60))
    monkeypatch.setattr(sd, "PIECE_BYTES", 1 << 12)  # the module travels to the workers by value
    check(spark.createDataFrame([(1, common), (2, long), (3, long[5000:70000])], "doc_id long, text string"))


def test_suffix_array():
    rng = random.Random(9)
    for _ in range(30):
        parts = ["".join(rng.choices("ab", k=rng.randint(1, 90))).encode() for _ in range(rng.randint(1, 12))]
        length = np.array([len(p) for p in parts])
        end = np.cumsum(length + 1)
        rest = np.repeat(end - 1, length + 1) - np.arange(end[-1])
        x = np.zeros(end[-1], np.uint8)
        x[rest > 0] = np.frombuffer(b"".join(parts), np.uint8) + 1
        got = sd.suffix_array(x, sd._words(x, rest), rest, np.ones(len(x), bool))
        raw = x.tobytes()
        want = sorted(range(len(x)), key=lambda i: (raw[i : i + rest[i]], i + rest[i]))
        assert got.tolist() == want
