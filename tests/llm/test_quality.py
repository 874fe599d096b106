import re
from collections import Counter

import pytest

from fileloom.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n)


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_counts(request, name):
    docs = request.getfixturevalue(name)
    got = quality.judge(docs, None).collect()
    want = [(r.doc_id, *counts(r.text)) for r in docs.collect()]
    assert sorted(map(repr, [tuple(r)[:7] for r in got])) == sorted(map(repr, want))
    assert all(r.kept == (not r.base_failed) and r.probability is None for r in got)


def test_lines_and_windows_that_polynomials_confuse(spark):
    """A Thue-Morse string and its complement, as lines and as words."""
    s = "ab"
    while len(s) < 4096:
        s += s.translate({97: 98, 98: 97})
    t = s.translate({97: 98, 98: 97})
    docs = spark.createDataFrame([(1, f"{s}\n{t}\n"), (2, f"{s} x y {t} x y {s}"), (3, f"{s} x y {s} x y"), (4, f"{s[:255]}\n{s[:256]}\n{s[:257]}\n{s[:256]}")], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:7] for r in quality.judge(docs, None).collect()}
    assert got == {r.doc_id: counts(r.text) for r in docs.collect()}
    assert got[1][3] == 0 and got[4][3] == 1


def test_training_is_bounded_by_bytes(spark, documents, sf_dir, monkeypatch):
    """The task that fits gets rows up to the bound; a bound that no row meets leaves no model."""
    labels = queries.table(spark, sf_dir, "labels")
    monkeypatch.setattr(quality, "MAX_TRAIN_BYTES", 0)
    assert quality.train(documents, labels) is None
    monkeypatch.setattr(quality, "MAX_TRAIN_BYTES", 400_000)
    seen = spark.sparkContext.accumulator(0)
    real = quality.fit

    def spy(rows):
        seen.add(sum(len(r[2]) + len(r[3]) for r in rows))
        return real(rows)

    monkeypatch.setattr(quality, "fit", spy)
    quality.train(documents, labels)
    assert 0 < seen.value <= 400_000


def test_held_out_accuracy(spark, sf_dir):
    """Trained on the even ids' labels, judged on the odd ones."""
    big = sf_dir.replace("0.001", "0.01")
    docs, labels = queries.table(spark, big, "documents"), queries.table(spark, big, "labels")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    got = quality.judge(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    right = {q: [r.kept == bool(q) for r in got if r.quality == q] for q in (0, 1)}
    assert sum(right[1]) / len(right[1]) > 0.97
    assert sum(right[0]) / len(right[0]) > 0.9


def test_keep_carries_rows(spark, odd, documents, sf_dir):
    labels = queries.table(spark, sf_dir, "labels")
    model = quality.train(documents, labels)
    kept = quality.keep(documents, model)
    assert kept.schema == documents.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.judge(documents, model).collect() if r.kept}
    assert quality.train(documents, labels.where("quality = 1")) is None
    assert {r.doc_id for r in quality.keep(odd, model).collect()} <= {6}
