import math
import random
import re
from collections import Counter

import pytest

from fileloom.llm import decontam, queries


def words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def held(part, passage):
    """Share of a part's pairs of words (of under four words, of its words) that are found in a passage."""
    n = 1 if len(part) < 4 else 2
    own = {" ".join(part[i : i + n]) for i in range(len(part) - n + 1)}
    found = {" ".join(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    return len(own & found) / len(own) if own else None


def plain(docs, items):
    """(doc_id, item_id, score) by scoring every passage against every item."""
    items = [(i, words(t), *map(words, decontam.split_item(t or ""))) for i, t in items]
    items = [x for x in items if x[1]]
    n, mean = len(items), sum(len(x[1]) for x in items) / max(len(items), 1)
    df = Counter(w for x in items for w in set(x[1]))
    idf = {w: math.log1p((n - c + 0.5) / (c + 0.5)) for w, c in df.items()}

    def weight(x):
        return {w: idf[w] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w, tf in Counter(x).items()}

    impacts = [weight(x[1]) for x in items]
    stride = max([64, *(len(x[1]) for x in items)])
    out = []
    for d, text in docs:
        w, best = words(text), {}
        for j in range(max(-(-len(w) // stride) - 1, 1)):
            passage = w[j * stride : (j + 2) * stride]
            have = set(passage)
            for (i, whole, q, a), impact in zip(items, impacts, strict=True):
                score = sum(v for t, v in impact.items() if t in have) / sum(impact.values())
                if score < 0.5:
                    continue

                question, answer = held(q, passage), held(a, passage)
                if (question is None or question >= 0.7) and (answer is None or answer >= 0.5):
                    best[i, tuple(whole)] = max(best.get((i, tuple(whole)), 0), score)
        out += [(d, i, round(s, 6)) for (i, _), s in best.items()]
    return out


def check(docs, items):
    got = decontam.contaminated(docs, items).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = plain(rows, [(r.item_id, r.text) for r in items.select("item_id", "text").collect()])
    assert sorted(map(repr, [(r.doc_id, r.item_id, round(r.score, 6)) for r in got])) == sorted(map(repr, want))
    return got


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_tables(request, spark, sf_dir, name):
    docs, items = request.getfixturevalue(name), queries.table(spark, sf_dir, "benchmark")
    check(docs, items)
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
    assert decontam.clean(docs, items.limit(0)).count() == docs.count()


def test_planted(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of"] * 60
    sentence = lambda n: " ".join(rng.choices(vocabulary, k=n)) + "."
    items = [(i, " ".join(sentence(rng.randint(2, 30)) for _ in range(rng.randint(1, 3)))) for i in range(150)]
    items += [(None, items[0][1]), (151, None), (152, ""), (153, "Who?"), (154, "ÉTÉ one two. Yes")]
    docs = []
    for i in range(120):
        text = " ".join(sentence(rng.randint(1, 150)) for _ in range(3))
        for _ in range(rng.randint(0, 2)):
            t = rng.choice(items[:150])[1].split()
            if rng.random() < 0.5:
                t[rng.randrange(len(t))] = "changed"
            k = rng.randint(0, len(text))
            text = text[:k] + " " + " ".join(t).upper() + "*** " + text[k:]
        docs.append((i, text))
    docs += [(None, items[3][1]), (500, "x été one; two yes"), (501, None), (502, "")] + docs[:3]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = check(df, it)
    assert len(got) > 50
    kept = decontam.clean(df, it)
    assert sorted(map(repr, [r.doc_id for r in kept.collect()])) == sorted(repr(d) for d, t in docs if d not in {r.doc_id for r in got})
    monkeypatch.setattr(decontam, "MAX_ITEMS", 40)
    several = [x.value for x in decontam.indexes(it)]
    assert len(several) > 3 and max(len(x["ids"]) for x in several if x) <= 40
    assert decontam.contaminated(df, it).count() > 50
    monkeypatch.setattr(decontam, "MAX_WORDS", 300)
    assert max(sum(map(len, x["vocabulary"][None])) for x in (y.value for y in decontam.indexes(it)) if x and len(x["ids"]) > 1) <= 300


def test_question_and_answer_by_hand(spark):
    """What counts is stated here, not computed: both parts, or nearly all of both, or else nothing."""
    question = "which of the seven rivers that cross the old town of marten was first bridged with stone by the guild of masons"
    items = spark.createDataFrame([(1, question + "? It was the river Oder near the mill."), (2, "Alone in one sentence the heron stands where reeds and water meet at dusk")], "item_id long, text string")
    edited = question.replace("seven", "nine")
    docs = [
        (1, f"Some words. {question}? It was the river Oder near the mill. More."),
        (2, f"Some words. {question}? Nobody knows that."),
        (3, f"Some words. {edited}? It was the river Oder near the mill."),
        (4, "It was the river Oder near the mill."),
        (5, f"{question}? It was the river Oder near a mill."),
        (6, "alone in one sentence the heron stands where reeds and waters meet at dusk"),
        (7, "alone stands the heron"),
        (8, None),
    ]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (3, 1), (5, 1), (6, 2)]


def wand(postings, maxima, threshold):
    """Items that reach the threshold, by moving a cursor a word from pivot to pivot. postings: word -> [(item, impact)], by item."""
    cursors = [[p, 0, maxima[w]] for w, p in postings.items() if p]
    found = {}
    while True:
        cursors = sorted((c for c in cursors if c[1] < len(c[0])), key=lambda c: c[0][c[1]][0])
        bound, pivot = 0.0, None
        for c in cursors:
            bound += c[2]
            if bound >= threshold - 1e-9:
                pivot = c[0][c[1]][0]
                break
        if pivot is None:
            return found
        if cursors[0][0][cursors[0][1]][0] == pivot:
            score = 0.0
            for c in cursors:
                if c[1] < len(c[0]) and c[0][c[1]][0] == pivot:
                    score += c[0][c[1]][1]
                    c[1] += 1
            if score >= threshold - 1e-9:
                found[pivot] = score
        else:
            for c in cursors:
                while c[1] < len(c[0]) and c[0][c[1]][0] < pivot:
                    c[1] += 1


def test_blocks_retrieve_what_pivots_retrieve(documents, spark, sf_dir):
    """Bounds over blocks find the passages and items that WAND with a cursor a word finds."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from fileloom.llm.common import chunks, slice_hashes

    own = decontam.index([(r.item_id, r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()])
    blocks = own["maxima"].shape[1]
    postings = [[] for _ in own["vocabulary"]]
    for key, item, impact in zip(own["key"].tolist(), own["item"].tolist(), own["impact"].tolist(), strict=True):
        postings[key // blocks].append((item, impact))
    most = [max(x for _, x in p) for p in postings]
    rng = random.Random(3)
    texts = [r.text for r in documents.limit(60).collect()] + [" ".join(rng.sample(r.text.split(), len(r.text.split()))) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    column = pc.utf8_lower(pa.array(texts, pa.large_string()))
    seen = 0
    for _, _, data, offsets in chunks(column):
        starts, ends, first = decontam.word_spans(data, offsets)
        words = slice_hashes(data, starts, ends)
        got = {(r, b, i): s for r, b, _, i, s in decontam.retrieve(own, words, first)}
        want = {}
        for r in range(len(first) - 1):
            n = int(first[r + 1] - first[r])
            for j in range(max(-(-n // own["stride"]) - 1, 1)):
                begin = int(first[r]) + j * own["stride"]
                at = np.searchsorted(own["vocabulary"], known := np.unique(words[begin : min(begin + 2 * own["stride"], int(first[r + 1]))]))
                at = [int(k) for k, w in zip(at, known, strict=True) if k < len(own["vocabulary"]) and own["vocabulary"][k] == w]
                for item, score in wand({k: sorted(postings[k]) for k in at}, most, decontam.THRESHOLD).items():
                    want[r, begin, item] = score
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        seen += len(want)
    assert seen > 20
