import random

import numpy as np
import pytest
import xxhash

from fileloom.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def connected(values, radius=3):
    """Smallest index that links lead to, by brute force."""
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i in range(len(values)):
            for j in range(i):
                if (values[i] ^ values[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_against_brute_force(request, name):
    docs = request.getfixturevalue(name)
    rows = docs.select("doc_id", "text").collect()
    got = simhash.near_duplicates(docs).collect()
    fp = {r.text: plain(r.text) for r in rows}
    values = sorted(set(fp.values()))
    label = dict(zip(values, connected(values), strict=True))
    least = {}
    for r in rows:
        if r.doc_id is not None:
            k = label[fp[r.text]]
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = [(r.doc_id, f"{fp[r.text]:016x}", least.get(label[fp[r.text]])) for r in rows]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


@pytest.mark.parametrize("most", [simhash.MOST_SHARD, 0, 5])
def test_large_shards_are_dealt_on(spark, monkeypatch, most):
    """Values that share blocks and differ in few bits, against brute force."""
    monkeypatch.setattr(simhash, "MOST_SHARD", most)
    rng = random.Random(13)
    values = {rng.choice([0, 0xFFFF << 48, rng.getrandbits(64)]) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 9))) & (2**64 - 1) for _ in range(300)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = connected([v % (1 << 64) for v in values])
    roots = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()}
    assert [roots.get(v, v) for v in values] == [values[k] for k in want]


def test_trees_find_every_link():
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(8):
            values.add(v ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 3))) & (2**64 - 1))
    values = np.array(sorted(values), np.uint64)
    trees = simhash.Forest(np.zeros(len(values), int), values)
    assert all(trees.edge[i] == int(values[i] ^ values[trees.parent[i]]).bit_count() for i in range(len(values)) if trees.parent[i] >= 0)
    pairs = {(int(a), int(b)) for x, y in trees.search(np.arange(len(values))) for a, b in zip(x, y, strict=True)}
    assert pairs == {(i, j) for i in range(len(values)) for j in range(len(values)) if i != j and int(values[i] ^ values[j]).bit_count() <= 3}
    assert simhash.forest_labels(np.zeros(len(values), int), values).tolist() == connected([int(v) for v in values])


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_similar_odd(request, name):
    docs = request.getfixturevalue(name)
    got = simhash.similar(docs)
    assert got.count() == docs.count()
    assert all(r.component_id is None or r.doc_id is None or r.component_id <= r.doc_id for r in got.collect())


def test_path_into_the_tree():
    """nearest is the closest of an item's ancestors."""
    rng = np.random.default_rng(8)
    value = np.unique(rng.integers(0, 1 << 20, 300).astype(np.uint64))
    trees = simhash.Forest(np.arange(len(value)) // 100, value)
    for i in range(len(value)):
        k, best = trees.parent[i], simhash.FURTHEST
        while k >= 0:
            best = min(best, int(value[i] ^ value[k]).bit_count())
            k = trees.parent[k]
        assert trees.nearest_distance[i] == best
        if best < simhash.FURTHEST:
            assert int(value[i] ^ value[trees.nearest[i]]).bit_count() == best


@pytest.mark.parametrize("most", [simhash.TASK_EDGES, 0, 60])
def test_components(spark, monkeypatch, most):
    """In one task, by rounds, and by rounds until few are left."""
    monkeypatch.setattr(simhash, "TASK_EDGES", most)
    rng = random.Random(most)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(500 + i, 501 + i) for i in range(60)] + [(700, 700), (-5, 900), (900, 10**12)]
    least = {x: x for e in edges for x in e}
    for _ in range(500):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k != v} == {k: v for k, v in least.items() if k != v}
    assert all(got.get(k, k) == v for k, v in least.items())


def test_chain_over_shards(spark):
    rng = random.Random(4)
    at, chain = 0, []
    for i in range(40):
        chain.append(at - (1 << 64) if at >> 63 else at)
        for b in rng.sample(range(64), 3):
            at ^= 1 << b
    edges = simhash.links(spark.createDataFrame([(x,) for x in sorted(set(chain))], "fp long"))
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    low = min(chain)
    assert {roots.get(x, x) for x in chain} == {low}
    assert simhash.components(edges.limit(0)).count() == 0


def exact_components(texts):
    """Smallest index that links of a similarity of 0.8 lead to, by brute force over all pairs."""
    label = list(range(len(texts)))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in texts)]
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def borderline(rng, groups=40):
    """Texts and edited copies of them on both sides of 0.8, with lines that all texts repeat."""
    vocabulary = [f"word{i}" for i in range(2000)]
    line = rng.choices(vocabulary, k=12)
    texts = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(6, 300)) + line * (g % 2)
        texts.append(" ".join(base))
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(own) // 35)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own[: len(own) - rng.choice([0, 0, len(own) // 8])]))
    return texts


def similar_labels(spark, texts):
    return {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_similar_is_exact(spark):
    texts = borderline(random.Random(21)) + ["", None, "one two", "two one"]
    want = exact_components(texts)
    assert len(set(want)) > 60 and similar_labels(spark, texts) == dict(enumerate(want))


@pytest.mark.parametrize("radius", [0, 64])
def test_trees_do_not_decide(spark, monkeypatch, radius):
    """However near proposals of the trees must be, the same documents are linked."""
    monkeypatch.setattr(simhash, "TREE_RADIUS", radius)
    texts = borderline(random.Random(24), 10)
    assert similar_labels(spark, texts) == dict(enumerate(exact_components(texts)))


def test_pairs_of_rows():
    import pyarrow as pa

    rows = [(1, 2, 1, "a"), (1, 2, 1, "a"), (1, 2, 2, "b"), (1, 2, 2, "b"), (1, 3, 1, "a"), (2, 3, 2, "b"), (2, 3, 3, "c")]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 3], strict=True)], ["a", "b", "fp", "x"]) for i in (0, 3, 6)]
    assert [(a, b, x[0].as_py(), y[0].as_py()) for a, b, x, y in simhash._of_pairs(batches)] == [(1, 2, "a", "b"), (2, 3, "b", "c")]


@pytest.mark.parametrize("most", [1, 3])
def test_hot_shards_are_cut(spark, monkeypatch, most):
    """Nearly all shards count as hot; the same links are found, and a block holds two parts at most."""
    monkeypatch.setattr(simhash, "HOT_SHARD", most)
    rng = random.Random(27)
    line = " ".join(rng.choices([f"word{i}" for i in range(2000)], k=9))
    texts = borderline(rng, 8) + [f"{line} {i}" for i in range(12)] + [line] * 3
    assert similar_labels(spark, texts) == dict(enumerate(exact_components(texts)))
    more = spark.createDataFrame([(7, i, 0, i, b"") for i in range(40)] + [(8, 1, 0, 1, b"")], "shard long, fp long, place long, sim long, sketch binary")
    trees, blocks = simhash.split_hot(more)
    assert trees.count() == 41
    held = {}
    for r in blocks.collect():
        held.setdefault(r.shard, set()).add(r.fp)
    assert all(any({i, j} <= own for own in held.values()) for i in range(40) for j in range(i))
    assert len(held) > 40 / most


def test_joins_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 0)
    texts = borderline(random.Random(26), 10) + ["", None, "one"]
    assert similar_labels(spark, texts) == dict(enumerate(exact_components(texts)))


def test_large_group_of_near_copies(spark):
    """Copies that differ from a base and from each other become one group, with few pairs compared."""
    rng = random.Random(25)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(600):
        own = list(base)
        own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    assert set(similar_labels(spark, texts).values()) == {0}


def test_similar_is_alike_at_every_size(spark):
    """Links do not depend on how many other documents there are, nor on what a sample finds repeated."""
    texts = borderline(random.Random(22), 12)
    rng = random.Random(23)
    others = [" ".join(f"other{rng.randrange(5000)}" for _ in range(8)) for _ in range(18_000)]
    want = dict(enumerate(exact_components(texts)))
    assert similar_labels(spark, texts) == want
    got = similar_labels(spark, texts + others)
    assert {k: got[k] for k in want} == want
