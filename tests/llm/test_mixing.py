import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fileloom.llm import mixing


def fill(sizes, weights=(5, 2, 1), most=3):
    """The targets as told: share by weight, stop at three times the size, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(target.values())
        w = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / w > most * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / w for s in open_}
        target |= {s: most * sizes[s] for s in above}
        open_ -= above
    return target


def check(docs, near=0.02):
    import re

    rows = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    want = fill(sizes)
    got = mixing.mix(docs).collect()
    assert sorted((repr(r.doc_id), r.size) for r in got) == sorted((repr(r.doc_id), size(r.text)) for r in rows)
    source = {r.doc_id: r.source for r in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        largest = max(size(r.text) for r in rows if r.source == s)
        assert abs(taken[s] - want[s]) <= max(near * want[s], largest)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(5)).collect()))


def test_documents(documents, monkeypatch):
    check(documents)
    few = sorted(mixing.mix(documents).collect())
    monkeypatch.setattr(mixing, "TASK_SOURCES", 0)
    assert sorted(mixing.mix(documents).collect()) == few


@pytest.mark.parametrize("few", [True, False])
def test_numbered(spark, few):
    rng = random.Random(4)
    rows = [(k, rng.randint(0, 9)) for k in rng.sample(range(10**6), 500)]
    got = mixing.numbered(spark.createDataFrame(rows, "k long, v long"), ["k"], {"below": "v"}, few).collect()
    below = 0
    for rank, (k, v) in enumerate(sorted(rows), 1):
        assert (k, v, rank, below) in got
        below += v
    assert len(got) == 500


def test_expand(spark, documents, odd, empty):
    """Each row as often as its copies say; without an id, rows are told apart by their texts."""
    for docs in (documents, odd, empty, odd.withColumns({"copies": F.lit(1.5), "_copies": F.lit(2), "id": F.lit(3)})):
        got = mixing.expand(docs)
        assert got.columns == docs.columns
        want = Counter()
        for r in mixing.mix(docs).collect():
            want[r.doc_id] = max(want[r.doc_id], r.copies)
        seen = Counter(r.doc_id for r in got.collect())
        times = Counter(r.doc_id for r in docs.select("doc_id").collect())
        assert all(seen[i] <= want[i] * times[i] for i in seen) and set(seen) == {i for i, n in want.items() if n}


def test_odd(odd, empty):
    check(odd)
    assert mixing.mix(empty).count() == 0


def test_fixed_point_with_full_sources(spark):
    rows = [(i, "w " * (5 + i % 7), "a" if i < 30 else "b" if i < 600 else None if i < 700 else "é") for i in range(1500)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))
