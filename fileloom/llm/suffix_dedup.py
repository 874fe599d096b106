"""Suffix-array dedup: removes every byte covered by a string of 50 bytes that also starts in a smaller document.

A string of 50 bytes owns an anchor: the leftmost of its grams of ``GRAM`` bytes with the smallest hash. Equal strings
have the same anchor at the same place, so only neighbourhoods (the ``REACH`` bytes that strings around an anchor may
cover) whose anchor is found in two documents need sorting. There are four passes:

1. Each document's anchors, with the hash of their neighbourhood, go to the partition of the anchor's hash. Within a
   run of documents, equal neighbourhoods are merged first: all but the smallest document's are repeats already.
2. That partition merges equal neighbourhoods again. Those of an anchor with one neighbourhood are settled. Where an
   anchor has several, each one's first document sends its text.
3. These texts meet by anchor (of an anchor with over ``HOT`` of them, by the hash of each window of 50 bytes, equal
   ones merged first) and are sorted by two-stage suffix sorting: suffixes smaller than their successors are
   sorted directly, the others are induced by a scan over the buckets. Neighbours in the array with 50 bytes or more in
   common form groups, and all but the smallest document of a group repeat it.
4. What was found meets the texts again, and the covered bytes go.

Passes exchange rows of packed arrays (a blob for each partition and run of about ``RUN_BYTES`` of text), which keeps
shuffles small; texts travel compressed. A task holds its partition's anchors (a share of 1/16 of the bytes), never its
texts: those come one blob at a time.

Edge cases: a null text is empty; a null doc_id is larger than any other (but for 2^63 - 1, which counts as large) and not
smaller than another null; rows with
the same doc_id do not repeat each other; texts under 50 bytes stay whole; an empty table gives an empty result; extra
columns are not looked at. Texts over ``PIECE_BYTES`` are read in overlapping pieces.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileloom.llm.common import Hasher, chunks, materialize, mix64

LENGTH = 50
GRAM = 20
#: Bytes before and from the start of an anchor that strings of LENGTH with this anchor may cover.
BEFORE, REACH = LENGTH - GRAM, LENGTH
#: Documents are gathered to runs of about this size before their blobs are sent.
RUN_BYTES = 1 << 23
#: Longer texts are read in overlapping pieces of this size.
PIECE_BYTES = 1 << 21
#: Bytes of text for a partition, and fewest partitions.
PART_BYTES, LEAST_PARTS = 1 << 22, 12
#: Bytes of neighbourhoods that are sorted at a time; groups of an anchor are never cut.
SORT_BYTES = 1 << 20
#: Neighbourhoods of one anchor that are sorted in one task; those of larger groups go window by window.
HOT = 1 << 16
NULL_ID = np.int64(2**63 - 1)

INFO, TEXT = 0, 1
ROWS = "part int, kind int, blob binary"
RESULT = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.num, len(a)))], np.int64)
    return zstandard.compress(b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for num, length in head.tolist():
        kind = np.dtype(_BY_NUM[num])
        out.append(np.frombuffer(data, kind, length, at))
        at += length * kind.itemsize
    return out


_BY_NUM = {np.dtype(t).num: t for t in ("uint8", "uint32", "uint64", "int32", "int64", "bool")}


def rows_of(parts, kind: int, labels: list[int]) -> pa.RecordBatch:
    parts = list(parts)
    return pa.RecordBatch.from_arrays([pa.array([labels[p] for p, _ in parts], pa.int32()), pa.array([kind] * len(parts), pa.int32()), pa.array([b for _, b in parts], pa.binary())], ["part", "kind", "blob"])


def by_part(part: np.ndarray, *arrays: np.ndarray):
    """(part, the arrays' own entries, in their order) for each part that has any."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    arrays = [a[order] for a in arrays]
    cut = np.flatnonzero(np.diff(part)) + 1
    for b, e in zip([0, *cut], [*cut, len(part)], strict=True):
        if e > b:
            yield int(part[b]), [a[b:e] for a in arrays]


def anchors(hasher: Hasher, data: np.ndarray, offsets: np.ndarray, low: int = 0, high: int | None = None):
    """(hash, neighbourhood's hash, row, position in data) of the anchors of strings that start in [low, high)."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, width = len(data), LENGTH - GRAM + 1
    if n < LENGTH:
        return none
    prefix = hasher.prefix(data)
    gram = hasher.slices(prefix, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    least, held = gram, 1
    while held < width:
        step = min(held, width - held)
        least = np.minimum(least[: len(least) - step], least[step:])
        held += step
    inside = np.zeros(len(least), bool)
    for b, e in zip(np.maximum(offsets[:-1], low), np.minimum(offsets[1:] - LENGTH + 1, n if high is None else high), strict=True):
        inside[b : max(b, e)] = True
    start = np.flatnonzero(inside)
    if not len(start):
        return none
    value = least[start]
    # the leftmost smallest gram: either where a string starts, or, in a run of strings with the same smallest hash,
    # the first place from the start of the last of them on
    own = start[value == gram[start]]
    last = np.ones(len(start), bool)
    last[:-1] = (value[1:] != value[:-1]) | (start[1:] != start[:-1] + 1)
    start, value = start[last], value[last]
    at = np.full(len(start), -1)
    todo = np.arange(len(start))
    for k in range(width):
        hit = gram[start[todo] + k] == value[todo]
        at[todo[hit]] = start[todo[hit]] + k
        todo = todo[~hit]
    at = np.union1d(own, at)
    row = np.searchsorted(offsets, at, "right") - 1
    begin, end = np.maximum(at - BEFORE, offsets[row]), np.minimum(at + REACH, offsets[row + 1])
    return gram[at], hasher.slices(prefix, begin, end), row, at


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """(bytes, offsets, where they begin in data, low, high): the run itself, or overlapping pieces of a long text."""
    if len(data) <= PIECE_BYTES or len(offsets) > 2:
        yield data, offsets, 0, 0, len(data)
        return
    step, margin = PIECE_BYTES, 2 * LENGTH
    for b in range(0, len(data), step):
        low, high = max(0, b - margin), min(len(data), b + step + margin)
        own = data[low:high]
        yield own, np.array([0, len(own)]), low, b - low, b + step - low


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)


def _runs(batches):
    """(hasher, ids, whether they are null, data, offsets, hash of each text) of runs of rows."""
    hasher = Hasher()
    for batch in batches:
        ids, nulls = _ids(batch.column(0)), batch.column(0).is_null().to_numpy(zero_copy_only=False)
        for i, j, data, offsets in chunks(batch.column(1)):
            texts = [xxhash.xxh64_intdigest(data[b:e].tobytes()) for b, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield hasher, ids[i:j], nulls[i:j], data, offsets, np.array(texts, np.uint64)


def home(ids: np.ndarray, texts: np.ndarray, parts: int) -> np.ndarray:
    """The partition where a document's text and what is found about it meet; copies are spread by their ids."""
    return (mix64(texts ^ mix64(ids.astype(np.uint64))) % np.uint64(parts)).astype(np.int64)


def _send_anchors(labels: list[int]):
    parts = len(labels)

    def flush(docs, held):
        """docs: (ids, texts) of the run's documents; held: arrays of anchors, with the document's number in the run."""
        ids, texts = (np.concatenate(x) for x in zip(*docs, strict=True))
        h, e, doc, at, before, after = (np.concatenate(x) for x in zip(*held, strict=True))
        # equal neighbourhoods of an anchor: the smallest document's goes on, the others repeat it
        order = np.lexsort((ids[doc], e, h))
        new = np.ones(len(order), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (e[order[1:]] != e[order[:-1]])
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        repeat = np.zeros(len(order), bool)
        repeat[order] = ids[doc[order]] > ids[doc[lead]]
        del order, new, lead
        if repeat.any():
            d, begin, end = doc[repeat], at[repeat] - before[repeat], at[repeat] + after[repeat]
            yield rows_of(((p, pack(*a)) for p, a in by_part(home(ids[d], texts[d], parts), ids[d], texts[d], begin, end, np.zeros(len(d), np.uint64))), INFO, labels)
        rest = ~repeat
        h, e, doc, at, before, after = (a[rest] for a in (h, e, doc, at, before, after))
        part = ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)

        def packed(own):
            doc, h, e, at, before, after = own
            runs = np.flatnonzero(np.diff(doc, prepend=-1))
            return pack(ids[doc[runs]], texts[doc[runs]], np.diff(np.append(runs, len(doc))).astype(np.uint32), h, e, np.diff(at, prepend=0), before, after)

        yield rows_of(((p, packed(a)) for p, a in by_part(part, doc, h.astype(np.uint32), e, at, before, after)), TEXT, labels)

    def run(batches):
        docs, held, size, n = [], [], 0, 0
        for hasher, ids, _, data, offsets, texts in _runs(batches):
            for own, bounds, base, low, high in _pieces(data, offsets):
                h, e, row, at = anchors(hasher, own, bounds, low, high)
                before = np.minimum(at - bounds[row], BEFORE).astype(np.uint8)
                after = np.minimum(bounds[row + 1] - at, REACH).astype(np.uint8)
                held.append((h, e, (row + n).astype(np.int32), at + base - offsets[row], before, after))
            docs.append((ids, texts))
            n += len(ids)
            size += len(data)
            if size >= RUN_BYTES:
                yield from flush(docs, held)
                docs, held, size, n = [], [], 0, 0
        if held:
            yield from flush(docs, held)

    return run


def _settle(labels: list[int]):
    """A partition's anchors -> what repeats (group 0), and neighbourhoods that must be sorted (their group).

    What is known to repeat already passes through.
    """
    parts = len(labels)

    def run(batches):
        held = []
        for batch in batches:
            yield batch.filter(pc.equal(batch.column(1), INFO))
            for blob in batch.filter(pc.equal(batch.column(1), TEXT)).column(2):
                ids, texts, n, h, e, at, before, after = unpack(blob.as_py())
                at = np.cumsum(at)
                held.append((np.repeat(ids, n), np.repeat(texts, n), h, e, at - before, at + after))
        if not held:
            return
        ids, texts, h, e, begin, end = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((ids, e, h))
        h, e, ids = h[order], e[order], ids[order]
        new_h = np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_e = new_h.copy()
        new_e[1:] |= e[1:] != e[:-1]
        at_h, at_e = np.flatnonzero(new_h), np.flatnonzero(new_e)
        g, k = np.cumsum(new_h) - 1, np.cumsum(new_e) - 1
        several = (np.add.reduceat(new_e.astype(np.int64), at_h) > 1) & (np.minimum.reduceat(ids, at_h) != np.maximum.reduceat(ids, at_h))
        repeat = ids > ids[at_e][k]
        sort = several[g] & ~repeat
        # an anchor that is found in one document only once its repeats are gone has nothing to be sorted against
        # a group's number is odd; of a group too large for one task it is 2
        hot = np.add.reduceat(sort.astype(np.int64), at_h) > HOT
        group = np.where(sort, np.where(hot[g], np.uint64(2), (h.astype(np.uint64) << np.uint64(24)) ^ e[at_h][g] | np.uint64(1)), np.uint64(0))
        pick = repeat | sort
        order, ids, group = order[pick], ids[pick], group[pick]
        texts, begin, end = texts[order], begin[order], end[order]
        found = list(by_part(home(ids, texts, parts), ids, texts, begin, end, group))
        if found:
            yield rows_of(((p, pack(*a)) for p, a in found), INFO, labels)

    return run


def _send_texts(labels: list[int]):
    """Whole texts to where what is found about them goes."""
    parts = len(labels)

    def flush(held):
        ids, nulls, texts, data = (np.concatenate([x[k] for x in held]) for k in range(4))
        length = np.concatenate([np.diff(x[4]) for x in held])
        end = np.cumsum(length)
        for p, (i, z, t, b, n) in by_part(home(ids, texts, parts), ids, nulls, texts, end - length, length):
            yield p, pack(i, z, t, n, np.concatenate([data[x : x + y] for x, y in zip(b.tolist(), n.tolist(), strict=True)]))

    def run(batches):
        held, size = [], 0
        for _, ids, nulls, data, offsets, texts in _runs(batches):
            held.append((ids, nulls, texts, data, offsets))
            size += len(data)
            if size >= RUN_BYTES:
                yield rows_of(flush(held), TEXT, labels)
                held, size = [], 0
        if held:
            yield rows_of(flush(held), TEXT, labels)

    return run


def _meet(batches):
    """Rows of a partition, what was found first: (ids, texts, begin, end, group) sorted by text, then each text blob."""
    found, table = [], None
    for batch in batches:
        for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            if kind == INFO:
                found.append(unpack(blob.as_py()))
                continue
            if table is None:
                table = _sorted(found)
            yield table, unpack(blob.as_py())


def _sorted(found):
    if not found:
        return [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    cols = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.lexsort((cols[2], cols[0], cols[1]))
    return [c[order] for c in cols]


def _about(table, ids, texts):
    """For each document the range of its entries in table."""
    low, high = np.searchsorted(table[1], texts), np.searchsorted(table[1], texts, "right")
    for k in np.flatnonzero(high > low):
        own = table[0][low[k] : high[k]]
        b, e = np.searchsorted(own, ids[k]), np.searchsorted(own, ids[k], "right")
        if e > b:
            yield int(k), int(low[k] + b), int(low[k] + e)


def _send_neighbourhoods(labels: list[int]):
    parts = len(labels)

    def sent(ids, texts, begin, end, group, where, data):
        rows = []
        for p, (i, t, b, e, g, w) in by_part((group % np.uint64(parts)).astype(np.int64), ids, texts, begin, end, group, where):
            n = e - b
            rows.append((p, pack(i, t, b, e, g, data[np.repeat(w - (np.cumsum(n) - n), n) + np.arange(n.sum())])))
        return rows_of(rows, TEXT, labels)

    def windows(hasher, ids, texts, begin, end, where, data):
        """Neighbourhoods of large groups, cut to their windows. Of equal windows here only the smallest document's goes
        on, to the task of the window's hash; the others repeat it already. So no window gathers in one task."""
        n = end - begin - LENGTH + 1
        of = np.repeat(np.arange(len(n)), n)
        shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ids, texts, begin, where = ids[of], texts[of], begin[of] + shift, where[of] + shift
        h = hasher.slices(hasher.prefix(data), where, where + LENGTH) | np.uint64(1)
        order = np.lexsort((ids, h))
        ids, texts, begin, where, h = (a[order] for a in (ids, texts, begin, where, h))
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        repeat = ids > ids[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
        if repeat.any():
            found = ids[repeat], texts[repeat], begin[repeat], begin[repeat] + LENGTH, np.zeros(repeat.sum(), np.uint64)
            yield rows_of(((p, pack(*a)) for p, a in by_part(home(found[0], found[1], parts), *found)), INFO, labels)
        yield sent(ids[~repeat], texts[~repeat], begin[~repeat], begin[~repeat] + LENGTH, h[~repeat], where[~repeat], data)

    def run(batches):
        hasher = Hasher()
        for table, (ids, _, texts, length, data) in _meet(batches):
            at = np.cumsum(length) - length
            out = []
            for k, b, e in _about(table, ids, texts):
                pick = np.arange(b, e)[table[4][b:e] > 0]
                out.append([c[pick] for c in table] + [table[2][pick] + at[k]])
            if not out:
                continue
            i, t, b, e, g, where = (np.concatenate(x) for x in zip(*out, strict=True))
            hot = g == 2
            if (~hot).any():
                yield sent(*(a[~hot] for a in (i, t, b, e, g, where)), data)
            if hot.any():
                yield from windows(hasher, *(a[hot] for a in (i, t, b, e, where)), data)

    return run


# --- two-stage suffix sorting ------------------------------------------------------------------------------------


def _words(x: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The 8 symbols from each place on as one number; those after the end of their string are 0."""
    wide = np.concatenate([x, np.zeros(8, np.uint8)])
    out = np.zeros(len(x), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | wide[k : k + len(x)]
    short = rest < 8
    out[short] &= ~((np.uint64(1) << ((8 - rest[short]) * 8).astype(np.uint64)) - np.uint64(1))
    return out


def suffix_array(x: np.ndarray, words: np.ndarray, rest: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The places in use, sorted by the strings that begin there.

    x: symbols, 0 at the end of each string and nowhere else; rest: symbols before that end; use: with each place that
    is larger than its successor, the successor is in use as well.
    """
    # smaller: the suffix is smaller than its successor; a run of a symbol is what the symbol after it makes it
    change = np.flatnonzero(np.diff(x.astype(np.int16))) if len(x) else np.zeros(0, np.int64)
    last = np.append(change, len(x) - 1)
    up = np.append(x[change] < x[change + 1], True)
    smaller = np.repeat(up, np.diff(last, prepend=-1))
    smaller[x == 0] = True
    direct = np.flatnonzero(use & smaller)
    # directly: by 8 symbols at a time, only ties go on; strings that end alike stay in order of place
    order = np.argsort(words[direct], kind="stable")
    key = words[direct][order]
    head = np.ones(len(order), bool)
    head[1:] = key[1:] != key[:-1]
    depth = 8
    while True:
        tied = ~head
        tied[:-1] |= ~head[1:]
        group = np.cumsum(head)
        slot = np.flatnonzero(tied)
        place = direct[order[slot]]
        on = rest[place] > depth  # those that ended are the first of their group and in order of place already
        if not on.any():
            break
        nxt = np.where(on, words[np.minimum(place + depth, len(x) - 1)], np.uint64(0))
        again = np.lexsort((nxt, group[slot]))
        order[slot] = order[slot][again]
        nxt, own = nxt[again], group[slot]
        head[slot[1:]] = (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])
        depth += 8
    sorted_direct = direct[order]
    # induced: a scan over buckets of the first symbol, smallest first; the larger predecessors of what is scanned
    # come in that order to the front part of their buckets
    begin = np.searchsorted(x[sorted_direct], np.arange(258))
    front: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []

    def induce(block: np.ndarray) -> None:
        before = block[block > 0] - 1
        before = before[use[before] & ~smaller[before]]
        symbol = x[before]
        by = np.argsort(symbol, kind="stable")
        cut = np.flatnonzero(np.diff(symbol[by])) + 1
        for part in np.split(before[by], cut):
            if len(part):
                front[int(x[part[0]])].append(part)

    for c in range(257):
        while front[c]:
            block = np.concatenate(front[c])
            front[c] = []
            out.append(block)
            induce(block)
        block = sorted_direct[begin[c] : begin[c + 1]]
        if len(block):
            out.append(block)
            induce(block)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeated_windows(docs: np.ndarray, length: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the windows of LENGTH bytes that a string of a smaller document also has."""
    n = len(length)
    end = np.cumsum(length + 1)
    begin = end - length - 1
    x = np.zeros(int(end[-1]) if n else 0, np.uint8)
    of = np.repeat(np.arange(n), length + 1)
    rest = np.repeat(end - 1, length + 1) - np.arange(len(x))
    x[rest > 0] = data + 1  # bytes over 0xF4 are not found in UTF-8, so 0 is left for the ends
    words = _words(x, rest)
    window = rest >= LENGTH
    # a window's place, and what its induction needs: from the last window on to the first suffix that is sorted directly
    use = window.copy()
    change = np.flatnonzero(np.diff(x.astype(np.int16)))
    up = np.append(x[change] < x[change + 1], True)
    smaller = np.repeat(up, np.diff(np.append(change, len(x) - 1), prepend=-1)) | (x == 0)
    if len(x):
        place = np.arange(len(x))
        next_direct = np.minimum.accumulate(np.where(smaller, place, len(x) - 1)[::-1])[::-1]
        reach = np.where(length >= LENGTH, next_direct[np.clip(begin + length - LENGTH, 0, len(x) - 1)], -1)
        use |= (place >= begin[of]) & (place <= reach[of])
    sa = suffix_array(x, words, rest, use)
    sa = sa[window[sa]]
    # adjacent common prefixes of LENGTH or more; its last 8 bytes overlap those before
    same = np.zeros(len(sa), bool)
    if len(sa) > 1:
        same[1:] = True
        for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            w = words[sa + k]
            same[1:] &= w[1:] == w[:-1]
    if not len(sa):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(~same)
    owner = np.minimum.reduceat(docs[of[sa]], first)
    hit = sa[docs[of[sa]] > owner[np.cumsum(~same) - 1]]
    return of[hit], hit - begin[of[hit]]


def _sort(labels: list[int]):
    parts = len(labels)

    def settled(held):
        ids, texts, begin, end, _, data = held
        string, offset = repeated_windows(ids, end - begin, data)
        if not len(string):
            return None
        order = np.lexsort((offset, string))
        string, offset = string[order], offset[order]
        new = np.ones(len(string), bool)
        new[1:] = (string[1:] != string[:-1]) | (offset[1:] > offset[:-1] + LENGTH)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(string)) - 1
        s = string[first]
        return ids[s], texts[s], begin[s] + offset[first], begin[s] + offset[last] + LENGTH, np.zeros(len(s), np.uint64)

    def run(batches):
        held = []
        for batch in batches:
            yield batch.filter(pc.equal(batch.column(1), INFO))  # known to repeat already
            held += [unpack(blob.as_py()) for blob in batch.filter(pc.equal(batch.column(1), TEXT)).column(2)]
        if not held:
            return
        data = np.concatenate([x[5] for x in held])
        ids, texts, begin, end, group = (np.concatenate(x) for x in zip(*[x[:5] for x in held], strict=True))
        held.clear()
        at = np.cumsum(end - begin) - (end - begin)
        order = np.lexsort((ids, group))
        ids, texts, begin, end, group, at = (a[order] for a in (ids, texts, begin, end, group, at))
        done = np.cumsum(end - begin)
        new = np.append(np.flatnonzero(np.diff(group, prepend=group[:1] ^ np.uint64(1))), len(group))
        out, i = [], 0
        while i < len(group):
            j = int(new[max(np.searchsorted(new, np.searchsorted(done, (done[i - 1] if i else 0) + SORT_BYTES), "right") - 1, np.searchsorted(new, i, "right"))])
            n = (end - begin)[i:j]
            own = data[np.repeat(at[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            if found := settled((ids[i:j], texts[i:j], begin[i:j], end[i:j], None, own)):
                out.append(found)
            i = j
        if out:
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield rows_of(((p, pack(*a)) for p, a in by_part(home(cols[0], cols[1], parts), *cols)), INFO, labels)

    return run


def _union(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of what the spans, sorted by begin, cover."""
    reach = np.maximum.accumulate(end)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return list(zip(begin[first].tolist(), reach[np.append(first[1:], len(begin)) - 1].tolist(), strict=True))


def _cut(batches):
    for table, (ids, nulls, texts, length, data) in _meet(batches):
        at = np.cumsum(length) - length
        raw = data.tobytes()
        spans, kept = [[] for _ in ids], [raw[a : a + n] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
        for k, b, e in _about(table, ids, texts):
            settled = table[4][b:e] == 0
            if settled.any():
                own = _union(table[2][b:e][settled], table[3][b:e][settled])
                text = kept[k]
                edges = [0, *(x for s in own for x in s), len(text)]
                spans[k] = [{"start": s, "end": t} for s, t in own]
                kept[k] = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(length.astype(np.int64)), pa.array(spans, _RESULT.field("spans").type), pa.array(kept, pa.binary())], schema=_RESULT)


def even_labels(spark: SparkSession, parts: int) -> list[int]:
    """A number for each partition that Spark's hash partitioning sends there, so that no two share a task."""
    tries = int(parts * (math.log(parts) + 12)) + 1
    rows = spark.range(tries).select(F.col("id").cast("int").alias("label")).groupBy(F.pmod(F.hash("label"), F.lit(parts)).alias("slot")).agg(F.min("label").alias("label")).collect()
    found = {r.slot: r.label for r in rows}
    return [found.get(k, k) for k in range(parts)]


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes) and kept (the bytes that stay) of each row of docs."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    # every task sends a blob to every partition: as many as the bytes need, and at most what the session says
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(LEAST_PARTS, -(-size // PART_BYTES)))
    labels = even_labels(spark, parts)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "part").sortWithinPartitions("kind")

    found = materialize(dealt(rows.mapInArrow(_send_anchors(labels), ROWS)).mapInArrow(_settle(labels), ROWS), "found")
    texts = rows.mapInArrow(_send_texts(labels), ROWS)
    near = dealt(found.unionByName(texts)).mapInArrow(_send_neighbourhoods(labels), ROWS)
    windows = dealt(near).mapInArrow(_sort(labels), ROWS)
    return dealt(found.unionByName(windows).unionByName(texts)).mapInArrow(_cut, RESULT)
