import zlib
from collections import defaultdict

import numpy as np
import pytest

from fileloom.llm import sharding


def check(rows, docs, shards):
    want = sorted((repr(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs)
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(0 <= k < shards and sorted(v) == list(range(len(v))) for k, v in slots.items())


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_slots(request, name):
    docs = request.getfixturevalue(name)
    check(sharding.assign(docs).collect(), docs.collect(), 40)


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_equal_texts_share_a_shard(spark, sf_dir, sf):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', sf)}/documents.parquet").select("doc_id", "text")
    text = dict(map(tuple, docs.collect()))
    got, of, size = sharding.assign(docs).collect(), defaultdict(set), np.zeros(40)
    for r in got:
        of[text[r.doc_id]].add(r.shard)
        size[r.shard] += r.size
    share, bytes_of = size.sum() / 40, defaultdict(int)
    for r in got:
        bytes_of[text[r.doc_id]] += r.size
    assert all(len(s) == 1 for t, s in of.items() if bytes_of[t] <= share)
    if sf != "0.001":  # 200 documents, of which some are larger than a share
        assert 0.99 * share < size.min() and size.max() < 1.01 * share


def test_balance_and_hot_group(spark):
    """A group that is larger than a share is cut into as many pieces as it fills shares; another one stays whole."""
    rows = [(i, "same text of a hot group" if i % 3 == 0 else "warm" if i % 50 == 1 else f"text {i} " * (1 + i % 17)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign(docs, 8).collect()
    check(got, docs.collect(), 8)
    size, n, of = np.zeros(8), np.zeros(8), defaultdict(set)
    text = dict(rows)
    for r in got:
        size[r.shard] += r.size
        n[r.shard] += 1
        of[text[r.doc_id]].add(r.shard)
    assert size.max() / size.mean() < 1.01 and size.min() / size.mean() > 0.99
    hot = 2000 * (len("same text of a hot group") + 16) / (size.sum() / 8)
    assert 1 < hot <= 2 and all(len(s) == (2 if t.startswith("same") else 1) for t, s in of.items())
    assert sorted(got) == sorted(sharding.assign(docs.repartition(7), 8).collect())


def test_many_short_copies_stay_together(spark):
    """A group of a third of the rows but few bytes lies in one shard."""
    docs = spark.createDataFrame([(i, None if i % 3 == 0 else f"{i} " * 200) for i in range(3000)], "doc_id long, text string")
    got = sharding.assign(docs, 8).collect()
    assert len({r.shard for r in got if r.tokens == 0}) == 1
    check(got, docs.collect(), 8)


def test_pack_is_by_dot_product():
    v = np.array([[4.0, 1, 1], [3, 1, 1], [3, 1, 1], [2, 1, 1]])
    assert sharding.pack(v, 2).tolist() == [0, 1, 1, 0]
    assert sharding.settle(np.array([5.0, 3, 4, 1]), np.array([0, 0, 1, 1]), 2).tolist() in ([0, 1, 1, 0], [1, 0, 0, 1])
    assert sharding.pack(np.zeros((0, 3)), 2).tolist() == []
