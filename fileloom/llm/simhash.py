"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, and components of the links.

Two fingerprints of 64 bits that differ in at most ``RADIUS`` = 3 bits agree on at least one of four blocks of 16
bits. Each block and its value names a shard, so every link lies inside some shard. A shard's fingerprints form a
BK-tree (children keyed by their integer Hamming distance to the parent), and a search follows only edges within the
radius of its distance. A shard with too many fingerprints is dealt on by parts of the bits that are left. Trees are built for all shards of an Arrow batch at once, level by level, and searched by
frontiers in numpy. They are not broadcast: that would bring the fingerprints of all documents to the driver; each
shard goes to the task that owns it instead.

Equal fingerprints are merged before anything is compared, and a shard emits a spanning forest of its links (at most
one row for each of its members) rather than all pairs. Components come from alternating large-star and small-star
rounds over those edges, each written to the shared folder.

``similar`` links documents of which the sets of five-word shingles are 0.8 alike, exactly and at every size; it is what
the pipeline takes. Shingles have one order for all documents; of two sets that are 0.8 alike, the first shingles (one
more than a fifth of them) have one in common, so these name the shards and no link lies outside all shards. In a shard
the SimHash values of the sets form a BK-tree, and a document is proposed the nearest node on the path by which it
enters the tree. ``PROPOSED`` of these are confirmed on the full sets and joined, so a group of copies costs no more than
its size. Then all that the trees left apart is compared, by bounds that hold for sure (lengths, places in the order,
parity sketches), and confirmed likewise, so that no link is lost. Shards of a shingle that very many documents have are
cut into parts, and compared part by part.

Edge cases: null and empty texts have no words and the fingerprint zero, which is linked like any other; repeated rows
each get a row; a document without an id is linked, but names no component (component_id is the smallest id that is
not null, or null if all are). Extra columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileloom.llm.common import dropped, materialize, mix64

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Four blocks of 16 bits: one more than the radius.
BLOCKS = RADIUS + 1
#: Shingles hashed, and pairs compared, at a time.
STEP = 1 << 16
#: Fingerprints that one shard has at most before it is dealt on.
MOST_SHARD = 1 << 16
#: Edges that one task unites, 16 bytes each.
TASK_EDGES = 1 << 20
#: Rows of up to three numbers that are broadcast for a join.
FEW = 1 << 18
#: More than any distance.
FURTHEST = 1024

#: ``similar``: words of a shingle; sets of a and b shingles are 0.8 alike if 9 times those in common are 4 * (a + b) or more.
WIDE_SHINGLE = 5
#: Documents of the sample that orders shingles, and most shingles of it that count as repeated.
SAMPLE, REPEATED = 8192, 1 << 16
#: Rows of a shard that one task gets whole; of larger ones, which the sample points out, all pairs are some 10^7 and more.
HOT_SHARD = 1 << 12
#: Fewest bits of a sketch, and most of the filter of documents to be compared in full.
LEAST_SKETCH, MOST_FILTER = 512, 1 << 23

#: ``similar``: the most bits between a document and a node that a tree proposes, and how many nodes it is proposed, the
#: nearest ones. Both decide how much is left to compare after the trees, not what is found.
TREE_RADIUS, PROPOSED = 14, 12


def fingerprint(text: str | None) -> int:
    """64 bits; bit i is 1 if it is set in over half the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    k = min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :] - 1
    total, digest, seed = np.zeros(64, np.int64), xxhash.xxh64_digest, SEED
    for i in range(0, len(starts), STEP):
        hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[i : i + STEP].tolist(), ends[i : i + STEP].tolist(), strict=True)])
        total += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles of five words, ascending; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    k = min(WIDE_SHINGLE, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :] - 1
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.unique(np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)))


def set_fingerprint(own: np.ndarray) -> int:
    """SimHash of a set of shingles: bit i is 1 if it is set in over half of them."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(own), STEP):
        total += np.unpackbits(own[i : i + STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(own)).tobytes(), "big")


def _shingle_rows(batches):
    for batch in batches:
        for text in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()).view(np.int64))], ["shingle"])


def repeated(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample have, the most frequent last, and those that may name hot shards (ascending)."""
    part = max(1, docs.count() // SAMPLE)
    texts = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0)
    counts = texts.mapInArrow(_shingle_rows, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    found = counts.orderBy(F.desc("n"), "shingle").limit(REPEATED).toArrow()
    order, n = (c.to_numpy()[::-1] for c in found.columns)
    return order.view(np.uint64), np.sort(order[n * part > HOT_SHARD].view(np.uint64))


def first_shingles(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first of a set in the order: not in common (ascending) by value, then common by rank. Sets 0.8 alike share one of them."""
    n = len(own)
    if not n:
        return own
    some = n - (4 * n + 4) // 5 + 1
    at = np.minimum(np.searchsorted(common, own), max(len(common) - 1, 0))
    late = np.where(common[at] == own, rank[at] + 1, 0) if len(common) else np.zeros(n, np.int64)
    return own[np.argsort(late, kind="stable")[:some]]


def sketch(own: np.ndarray) -> np.ndarray:
    """Bytes of 0 and 1: parities of the shingles of each remainder, at least as many as shingles, by a power of two."""
    bits = max(LEAST_SKETCH, 1 << (len(own) - 1).bit_length() if len(own) else 0)
    return np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1


def least_difference(a: bytes, b: bytes) -> int:
    """A number of shingles that two sets differ in at least, by their sketches; the longer is folded to the shorter."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _shingled(order: np.ndarray):
    rank = np.argsort(order)
    common = order[rank]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                ids, rows = batch.column(0).slice(i, 256).cast(pa.int64()), []
                for text in batch.column(1).slice(i, 256):
                    own = shingles(text.as_py())
                    node = xxhash.xxh64_intdigest(own.tobytes())
                    rows.append((node, len(own), set_fingerprint(own), np.packbits(sketch(own), bitorder="little").tobytes(), first_shingles(own, common, rank).tobytes()))
                nodes, sizes, sims, sketches, firsts = zip(*rows, strict=True)
                cols = [ids, pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.array(sims, np.uint64).view(np.int64)), pa.array(sketches, pa.binary()), pa.array(firsts, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "n", "sim", "sketch", "firsts"])

    return run


def _dealt_firsts(hot: np.ndarray, whether: bool):
    """(shard, fp, place) of first shingles that are hot, or that are not."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                cols = [batch.column(k).slice(i, 256) for k in range(3)]
                node, n = (c.to_numpy(zero_copy_only=False) for c in cols[:2])
                firsts = [np.frombuffer(x.as_py(), np.uint64) for x in cols[2]]
                each = [len(x) for x in firsts]
                if sum(each):
                    place = np.repeat(n, each) << 32 | np.concatenate([np.arange(k) for k in each])
                    shard = np.concatenate(firsts)
                    own = np.isin(shard, hot) == whether
                    yield pa.RecordBatch.from_arrays([pa.array(shard.view(np.int64)[own]), pa.array(np.repeat(node, each)[own]), pa.array(place[own])], ["shard", "fp", "place"])

    return run


def _columns(parts) -> list[np.ndarray]:
    return [np.concatenate([p[0] for p in parts]), *(np.concatenate([p[k].to_numpy(zero_copy_only=False) for p in parts]) for k in range(1, len(parts[0])))]


def _shared(batches):
    """Rows of which the lengths and places in the order leave some other row of the shard possible (see _possible)."""
    for parts in _by_shard(batches):
        shard, node, place = _columns(parts)
        order = np.lexsort((place >> 32, shard))
        shard, node, place = shard[order], node[order], place[order]
        n = place >> 32
        most = (9 * (n - (place & ((1 << 32) - 1))) - 4 * n) // 4  # length that another may have at most
        same = shard[1:] == shard[:-1]
        more = np.zeros(len(shard), bool)
        more[:-1] = same & (n[1:] <= most[:-1])  # the next is the shortest that is as long
        part = np.append(0, np.cumsum(~same)) << 33
        more[1:] |= same & (part[1:] + n[1:] <= np.maximum.accumulate(part + np.maximum(most, 0))[:-1])
        if more.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[more]) for c in (shard, node, place)], ["shard", "fp", "place"])


def _folded(sketches) -> np.ndarray:
    """Sketches of LEAST_SKETCH bits, a row each."""
    width, out = LEAST_SKETCH // 64, []
    for x in sketches:
        out.append(np.bitwise_xor.reduce(np.frombuffer(x.as_py(), np.uint64).reshape(-1, width)))
    return np.array(out, np.uint64).reshape(-1, width)


def _possible(place: np.ndarray, short: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows x and y may be 0.8 alike if their shard is the first shingle in common: what follows it suffices."""
    n, at = place >> 32, place & ((1 << 32) - 1)
    rest = n - at
    own = 9 * np.minimum(rest[x], rest[y]) >= 4 * (n[x] + n[y])
    for i in range(0, len(x), STEP):
        k = i + np.flatnonzero(own[i : i + STEP])
        own[k] = 9 * np.bitwise_count(short[x[k]] ^ short[y[k]]).sum(axis=1, dtype=np.int64) <= n[x[k]] + n[y[k]]
    return own


def _pair_batch(node: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _tree_pairs(batches):
    """(a, b, d): for each row of a shard the nearest node that it passes on its way into the BK-tree, and the bits between."""
    for parts in _by_shard(batches):
        shard, node, sim = _columns(parts)
        sim = sim.view(np.uint64)
        # several orders of chance, so that a node meets several of its group on its ways into the trees of its shards
        chance = mix64(node.view(np.uint64) + mix64(shard.view(np.uint64) & np.uint64(15)))
        order = np.lexsort((chance, sim, shard))
        shard, node, sim, chance = (c[order] for c in (shard, node, sim, chance))
        new = np.ones(len(shard), bool)
        new[1:] = (shard[1:] != shard[:-1]) | (sim[1:] != sim[:-1])
        again = np.flatnonzero(~new)  # of equal value: the one before
        tops = np.flatnonzero(new)
        tops = tops[np.lexsort((chance[tops], shard[tops]))]
        trees = Forest(shard[tops], sim[tops])
        met = np.flatnonzero(trees.nearest_distance <= TREE_RADIUS)
        a = np.concatenate([again, tops[met]])
        b = np.concatenate([again - 1, tops[trees.nearest[met]]])
        d = np.concatenate([np.zeros(len(again), np.int64), trees.nearest_distance[met]])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(d)], ["a", "b", "d"])


def _pairs_apart(batches):
    """Of each shard all pairs that may be 0.8 alike and have different labels."""
    for parts in _by_shard(batches):
        shard, node, place, label = _columns([p[:4] for p in parts])
        order = np.lexsort((node, label, shard))
        shard, node, place, label = shard[order], node[order], place[order], label[order]
        short = _folded(x for p in parts for x in p[4])[order]
        cut = shard[1:] != shard[:-1]
        end = np.append(np.flatnonzero(cut) + 1, len(shard))[np.append(0, np.cumsum(cut))]
        run = np.append(np.flatnonzero(cut | (label[1:] != label[:-1])) + 1, len(shard))[np.append(0, np.cumsum(cut | (label[1:] != label[:-1])))]
        many = end - run  # rows after those of the same label
        ends, begin = np.cumsum(many), 0
        while begin < len(shard):  # a row has fewer pairs than its shard has rows; else runs of STEP
            stop = max(int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + STEP, "right")), begin + 1)
            k = many[begin:stop]
            x = np.repeat(np.arange(begin, stop), k)
            y = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(run[begin:stop], k)
            own = _possible(place, short, x, y)
            if own.any():
                yield _pair_batch(node, x[own], y[own])
            begin = stop


def _of_pairs(batches):
    """(a, b, first node's cells, second node's) of each pair of which two nodes are known; rows (a, b, fp, ...) sorted by pair and node."""
    pair = node = held = None
    for batch in batches:
        a, b, fp = (batch.column(k).to_pylist() for k in range(3))
        for k in range(batch.num_rows):
            if pair != (a[k], b[k]):
                pair, node, held = (a[k], b[k]), fp[k], [c[k] for c in batch.columns[3:]]
            elif held is not None and node != fp[k]:
                yield *pair, held, [c[k] for c in batch.columns[3:]]
                held = None  # nodes that are met again say nothing new


def _filtered(batches, holds):
    found = [(a, b) for a, b, x, y in _of_pairs(batches) if holds(x, y)]
    for i in range(0, len(found), STEP):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[i : i + STEP], strict=True)], ["a", "b"])


def _not_unlike(batches):
    """Pairs that sketches do not rule out; cells: n, sketch."""
    return _filtered(batches, lambda x, y: 9 * least_difference(x[1].as_py(), y[1].as_py()) <= x[0].as_py() + y[0].as_py())


def _alike(batches):
    """Pairs that are 0.8 alike; cells: all shingles."""

    def holds(x, y) -> bool:
        own, other = (np.frombuffer(v[0].as_buffer(), np.uint64) for v in (x, y))
        return 9 * len(np.intersect1d(own, other, assume_unique=True)) >= 4 * (len(own) + len(other))

    return _filtered(batches, holds)


def _sets(bits: int, words: np.ndarray):
    """(fp, all shingles) of documents whose number is in a filter of so many bits, or that have none."""

    def run(batches):
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            asked = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            for k in np.flatnonzero(asked).tolist():
                own = shingles(batch.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.array([xxhash.xxh64_intdigest(own.tobytes())], np.uint64).view(np.int64)), pa.array([own.tobytes()], pa.binary())], ["fp", "own"])

    return run


def _few(df: DataFrame, n: int) -> DataFrame:
    """df for a join, broadcast if its n rows (of two numbers or three) are at most FEW."""
    return F.broadcast(df) if n <= FEW else df


def _kept(pairs: DataFrame, n: int, cells: DataFrame, kind) -> DataFrame:
    """Those of n pairs (a, b) that hold by what cells (fp, ...) say of their two nodes."""
    both = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("fp"))
    met = cells.join(_few(both, 2 * n), "fp").select("a", "b", *cells.columns)
    return met.repartition("a", "b").sortWithinPartitions("a", "b", "fp").mapInArrow(kind, "a long, b long")


def _confirmed(docs: DataFrame, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that are 0.8 alike. Of no pair both (a, b) and (b, a) are needed."""
    pairs = materialize(pairs, "proposed")
    left = materialize(_kept(pairs, pairs.count(), groups.select("fp", "n", "sketch"), _not_unlike), "pairs")
    n = left.count()
    nodes = left.select(F.explode(F.array("a", "b")).alias("fp"))
    # texts are not dealt: a filter of bounded size, which lets some others through, tells tasks of which the shingles are asked for
    bits = min(MOST_FILTER, max(64, 1 << (32 * n).bit_length()))

    def number(col):  # documents without an id share one
        return F.pmod(F.xxhash64(F.col(col)), F.lit(bits))

    at = groups.select("fp", "least").join(_few(nodes, 2 * n), "fp", "left_semi").select(number("least").alias("at"))
    set_bits = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("own")).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[set_bits.column(0).to_numpy()] = set_bits.column(1).to_numpy().view(np.uint64)
    sets = docs.select(number("doc_id").alias("at"), "text").mapInArrow(_sets(bits, words), "fp long, own binary")
    sets = materialize(sets.join(_few(nodes, 2 * n), "fp", "left_semi").groupBy("fp").agg(F.first("own").alias("own")), "sets")
    found = materialize(_kept(left, n, sets, _alike), "links")
    dropped(pairs, left, sets)
    return found


def _fingerprints(batches):
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


class Forest:
    """BK-trees of all shards of a batch. Item i is node i of its shard's tree; the first of a shard is the root.

    nearest: the closest node on the item's way from the root to its place.
    """

    def __init__(self, shard: np.ndarray, value: np.ndarray) -> None:
        """Both sorted by shard; value is uint64 (a row of them for each item), distinct within a shard."""
        n = len(value)
        self.value = value.reshape(n, -1)
        self.nearest = np.full(n, -1, np.int64)
        self.nearest_distance = np.full(n, FURTHEST, np.int64)
        self.parent = np.full(n, -1, np.int64)
        self.edge = np.full(n, -1, np.int64)
        first = np.ones(n, bool)
        first[1:] = shard[1:] != shard[:-1]
        root = np.flatnonzero(first)
        self.root = root[np.cumsum(first) - 1]
        # level by level: items below a node are dealt by their distance to it; the first of each hand is the child
        item = np.flatnonzero(~first)
        node = self.root[item]
        while len(item):
            d = self.distance(item, node)
            closer = d < self.nearest_distance[item]
            self.nearest[item[closer]], self.nearest_distance[item[closer]] = node[closer], d[closer]
            order = np.lexsort((item, d, node))
            item, node, d = item[order], node[order], d[order]
            lead = np.ones(len(item), bool)
            lead[1:] = (node[1:] != node[:-1]) | (d[1:] != d[:-1])
            self.parent[item[lead]], self.edge[item[lead]] = node[lead], d[lead]
            child = item[lead][np.cumsum(lead) - 1]
            item, node = item[~lead], child[~lead]
        # children of a node, sorted by edge
        kid = np.flatnonzero(self.parent >= 0)
        order = np.lexsort((self.edge[kid], self.parent[kid]))
        self.kid = kid[order]
        self.key = self.parent[self.kid] * FURTHEST + self.edge[self.kid]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.value[a] ^ self.value[b]).sum(axis=1, dtype=np.int64)

    def search(self, queries: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs within the radius, in runs of bounded length; each query searches its own tree."""
        waiting = [(queries[i : i + STEP], self.root[queries[i : i + STEP]]) for i in range(0, len(queries), STEP)]
        while waiting:
            q, node = waiting.pop()
            d = self.distance(q, node)
            hit = (d <= radius) & (q != node)
            if hit.any():
                yield q[hit], node[hit]
            low = np.searchsorted(self.key, node * FURTHEST + np.maximum(d - radius, 0))
            high = np.searchsorted(self.key, node * FURTHEST + d + radius, "right")
            n = high - low
            some = n > 0
            q, low, n = q[some], low[some], n[some]
            ends = np.cumsum(n)
            begin = 0
            while begin < len(q):  # no run of over STEP pairs, unless one node alone has more children (as many as there are distances)
                base = ends[begin - 1] if begin else 0
                end = max(int(np.searchsorted(ends, base + STEP, "right")), begin + 1)
                k = n[begin:end]
                at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                waiting.append((np.repeat(q[begin:end], k), self.kid[np.repeat(low[begin:end], k) + at]))
                begin = end


def forest_labels(shard: np.ndarray, value: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each item the smallest item that links lead to; items sorted by shard and distinct."""
    label = np.arange(len(value))
    trees = Forest(shard, value)
    for a, b in trees.search(np.arange(len(value)), radius):
        while True:
            x, y = label[a], label[b]
            if not (differ := x != y).any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (nearer := label[label] < label).any():
                label[nearer] = label[label[nearer]]
    return label


def _by_shard(batches):
    """(shard, other columns) of whole shards, from batches sorted by shard; a shard may run over several batches."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [batch.column(0).to_numpy(zero_copy_only=False), *batch.columns[1:]]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last shard may go on in the next batch
        done = held + ([[c[:last] for c in cols]] if last else [])
        if done and (last or held[-1][0][-1] != cols[0][0]):
            yield done
            held = []
        held.append([c[last:] for c in cols])
    if held:
        yield held


def _forest_links(shard: np.ndarray, node: np.ndarray, value: np.ndarray, radius: int) -> pa.RecordBatch:
    """(a, b): each node that is linked, and the least one of its shard that links lead to."""
    label = forest_labels(shard, value, radius)
    own = np.flatnonzero(label != np.arange(len(node)))
    return pa.RecordBatch.from_arrays([pa.array(node[own].view(np.int64)), pa.array(node[label[own]].view(np.int64))], ["a", "b"])


def _shard_links(batches):
    for parts in _by_shard(batches):
        shard = np.concatenate([p[0] for p in parts])
        value = np.concatenate([p[1].to_numpy(zero_copy_only=False) for p in parts]).view(np.uint64)
        order = np.lexsort((value, shard))
        yield _forest_links(shard[order], value[order], value[order], RADIUS)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints that connect exactly what links of at most RADIUS bits connect.

    A shard of over MOST_SHARD fingerprints is dealt on: those of its links that agree on a block of 16 bits differ in at most
    RADIUS of the other 48, so they agree on one of four parts of 12 of these as well.
    """
    width, part = 64 // BLOCKS, (64 - 64 // BLOCKS) // BLOCKS
    blocks = []
    for k in range(BLOCKS):
        shard = F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(k << width)
        above = F.shiftleft(F.shiftrightunsigned("fp", width * (k + 1)), width * k) if k < BLOCKS - 1 else F.lit(0).cast("long")
        blocks.append(F.struct(shard.alias("shard"), above.bitwiseOR(F.col("fp").bitwiseAND(F.lit((1 << width * k) - 1))).alias("rest")))
    dealt = distinct.select("fp", F.explode(F.array(*blocks)).alias("s")).select("fp", "s.shard", "s.rest")
    hot = dealt.groupBy("shard").agg(F.count("*").alias("held")).where(F.col("held") > MOST_SHARD)  # BLOCKS << width rows at most
    parts = [F.shiftleft(F.col("shard") + F.lit((j + 1) << 20), part) + F.shiftrightunsigned("rest", part * j).bitwiseAND(F.lit((1 << part) - 1)) for j in range(BLOCKS)]
    keys = F.when(F.col("held").isNotNull(), F.array(*parts)).otherwise(F.array("shard"))
    dealt = dealt.join(F.broadcast(hot), "shard", "left").select(F.explode(keys).alias("shard"), "fp")
    alone = dealt.repartition("shard").sortWithinPartitions("shard")
    return alone.mapInArrow(_shard_links, "a long, b long")


def _united(batches):
    """(node, root) of all nodes in edges (a, b), by union-find."""
    edges = [np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) for batch in batches]
    if not edges:
        return
    node, at = np.unique(np.concatenate(edges, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(node))
    while True:
        x, y = root[a], root[b]
        if not (differ := x != y).any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (nearer := root[root] < root).any():
            root[nearer] = root[root[nearer]]
    for i in range(0, len(node), STEP):
        yield pa.RecordBatch.from_arrays([pa.array(node[i : i + STEP]), pa.array(node[root[i : i + STEP]])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node it is connected with, of each node in edges (a, b).

    Up to TASK_EDGES edges are united in one task. More take rounds of large-star and small-star, each of which links the
    neighbours of a node to the smallest of them, until they are few or settled. A node with many neighbours is only ever
    aggregated (min) and joined, never gathered.
    """
    n, state = edges.count(), None
    if n <= TASK_EDGES:
        return materialize(edges.repartition(1).mapInArrow(_united, "node long, root long"), "roots")
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while n > TASK_EDGES:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(near, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, materialize(small, "edges")
        dropped(before)
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (found.n, found.h) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))
        n, state = found.n, (found.n, found.h)
    return materialize(now.repartition(1).mapInArrow(_united, "node long, root long"), "roots")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row of docs."""
    rows = materialize(fingerprints(docs), "fingerprints")
    groups = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = _named(rows, groups, links(groups.select("fp")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def split_hot(more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hot shards cut into parts of about HOT_SHARD rows: as shards of their own for trees, and for comparing all pairs as
    blocks of two parts each, so that every pair meets in a block and no task gets a whole hot shard."""
    held = more.groupBy("shard").agg(F.count("*").alias("n")).collect()  # REPEATED rows at most
    parts = more.sparkSession.createDataFrame([(r.shard, -(-r.n // HOT_SHARD)) for r in held], "shard long, parts long")
    cut = more.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    trees = cut.select(F.xxhash64("shard", "part").alias("shard"), "fp", "sim")
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    blocks = met.select(F.xxhash64("shard", F.least("part", "other"), F.greatest("part", "other")).alias("shard"), "fp", "place", "sim", "sketch")
    return trees, blocks


def similar(docs: DataFrame) -> DataFrame:
    """doc_id and component_id of each row of docs, by links between sets of five-word shingles that are 0.8 alike.

    Equal sets are merged. Trees propose a pair for each document at first, which joins large groups; then all pairs
    that are not joined yet are compared, so no link is missed and a group of copies does not make as many pairs as its
    square.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order, hot = repeated(docs)
    kind = "doc_id long, fp long, n long, sim long, sketch binary, firsts binary"
    rows = materialize(docs.mapInArrow(_shingled(order), kind), "shingled")
    own = [F.first(c).alias(c) for c in ("n", "sim", "sketch", "firsts")]
    groups = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), *own), "groups")
    place = "shard long, fp long, place long"
    firsts = groups.select("fp", "n", "firsts")
    dealt = firsts.mapInArrow(_dealt_firsts(hot, False), place)
    shared = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shared, place)
    looks = groups.select("fp", "sim", "sketch")
    shared = materialize(shared.join(looks, "fp").select("shard", "fp", "place", "sim", "sketch"), "shared")
    compared, in_trees = shared, shared.select("shard", "fp", "sim")
    if len(hot):
        more = materialize(firsts.mapInArrow(_dealt_firsts(hot, True), place).join(looks, "fp").select("shard", "fp", "place", "sim", "sketch"), "hot")
        trees, blocks = split_hot(more)
        in_trees, compared = in_trees.unionByName(trees), compared.unionByName(blocks)

    met = in_trees.repartition("shard").sortWithinPartitions("shard").mapInArrow(_tree_pairs, "a long, b long, d long")
    nearest = F.slice(F.array_sort(F.collect_set(F.struct("d", "b"))), 1, PROPOSED)  # of one document's shards
    pairs = met.groupBy("a").agg(nearest.alias("near")).select("a", F.explode("near").alias("near")).select("a", "near.b")
    edges = _confirmed(docs, groups, pairs)
    joined = components(edges).toDF("fp", "root")
    apart = compared.join(_few(joined, 2 * edges.count()), "fp", "left").select("shard", "fp", "place", F.coalesce("root", "fp").alias("label"), "sketch")
    pairs = apart.repartition("shard").sortWithinPartitions("shard").mapInArrow(_pairs_apart, "a long, b long").distinct()
    edges = edges.unionByName(_confirmed(docs, groups, pairs))
    out = _named(rows.select("doc_id", "fp"), groups.select("fp", "least"), edges).select("doc_id", "component_id")
    dropped(shared)
    return out


def _named(rows: DataFrame, groups: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (doc_id, fp) with component_id, the least doc_id of what edges between fps connect; groups: fp, least."""
    linked = components(edges).withColumnRenamed("node", "fp")
    n = 2 * edges.count()
    # written, so that the join on root has plain shuffles on both sides, which Spark can split where a component is large
    roots = groups.join(_few(linked, n), "fp").groupBy("root").agg(F.min("least").alias("name"))
    roots = materialize(linked.join(_few(materialize(roots, "roots"), n), "root").select("fp", "name"), "names")
    of = groups.join(_few(roots, n), "fp", "left").select("fp", F.when(F.col("name").isNull(), F.col("least")).otherwise(F.col("name")).alias("component_id"))
    return rows.join(of, "fp")
