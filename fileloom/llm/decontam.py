"""Benchmark decontamination: a BM25 index of the test items, which every passage of the training texts queries.

Words are runs of letters, digits and non-ASCII characters, in lower case. A text is cut into passages of ``span``
words, half overlapping, where half a span is at least as long as the longest item: whatever is copied whole lies
whole in some passage. A passage's distinct words query the items; scores are shares of the item's score against
itself, so one threshold serves all items.

Block-max WAND: items stand in blocks and the index holds each word's greatest impact in each block. The sum of these
over a passage's words bounds what any item of the block can score; only blocks whose bound reaches the threshold are
opened, and in them every item is scored exactly. All passages of an Arrow batch are bounded and scored at once in
numpy; nothing above the threshold is lost.

The pivot of WAND, which moves one cursor a word from item to item, is taken over blocks: bounds of all blocks stand side
by side, so that a block is skipped by one comparison and no passage waits for another.

What is retrieved is verified: the share of the question's and of the answer's pairs of adjacent words that the passage
holds (of parts of under ``SHORT`` words, of the words), which one edit does not sink as it would longer shingles. The
answer is the item's last line or sentence, the question what stands before (all of it, if there is one sentence). An
item is found if the question's share reaches ``OVERLAP`` and that of the answer, if there is one, ``ANSWER_OVERLAP``.

Benchmarks are stated sets; one index holds at most ``MAX_ITEMS`` items and ``MAX_WORDS`` words (or one item) and is
broadcast, a larger benchmark is dealt to several by hash, which are queried in turn and have their own word weights.

Edge cases: null and empty texts, and items without words, are never found; items of equal text are each found; a null
item_id or doc_id stays null; repeated documents each give their rows, an item that is repeated with its id counts once; an empty table gives an empty result; extra columns
are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileloom.llm.common import chunks, mix64, slice_hashes

K1, B = 1.2, 0.75
#: Share of an item's score against itself from which it is retrieved.
THRESHOLD = 0.5
OVERLAP, ANSWER_OVERLAP = 0.7, 0.5
#: Parts of fewer words are compared word by word.
SHORT = 4
#: Of one index: an item weighs some 100 bytes, a word at most 8 * BLOCKS and some 50 bytes.
MAX_ITEMS, MAX_WORDS = 20_000, 200_000
BLOCKS, LEAST_BLOCK = 64, 4
#: Most indexes; a benchmark that needs more is no stated set.
MAX_PARTS = 1 << 12
#: Fewest words of a passage.
LEAST_SPAN = 128

FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"

#: Words of the index, as a pattern.
INDEXED = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first word number of each row (one more entry at the end)."""
    ink = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(ink & (edge[:-1] | ~np.concatenate([[False], ink[:-1]])[: len(ink)]))
    ends = np.flatnonzero(ink & (edge[1:] | ~np.concatenate([ink[1:], [False]])[: len(ink)])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def pairs(words: np.ndarray) -> np.ndarray:
    """Hashes of the distinct pairs of adjacent words."""
    with np.errstate(over="ignore"):
        return np.unique(mix64(mix64(words[:-1]) * np.uint64(31) + words[1:]))


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(pc.utf8_lower(pa.scalar(text)).as_py().encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return slice_hashes(data, starts, ends)


def _part(words: np.ndarray) -> tuple[bool, np.ndarray]:
    """Whether a part is compared word by word, and the hashes of its words or pairs."""
    return (True, np.unique(words)) if len(words) < SHORT else (False, pairs(words))


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last line or sentence is the answer, if there is another before."""
    parts = [m.end() for m in _SENTENCE.finditer(text.rstrip())]
    return (text[: parts[-1]], text[parts[-1] :]) if parts else (text, "")


def index(items: list[tuple[int | None, str | None]]) -> dict | None:
    """The inverted index with its block maxima, and each item's parts."""
    own = []
    for i, text in items:
        question, answer = split_item(text or "")
        q, a = _words(question), _words(answer)
        if len(q) + len(a):
            own.append((i, np.concatenate([q, a]), _part(q), _part(a)))
    if not own:
        return None
    vocabulary, term = np.unique(np.concatenate([w for _, w, _, _ in own]), return_inverse=True)
    length = np.array([len(w) for _, w, _, _ in own])
    item = np.repeat(np.arange(len(own)), length)
    pair, tf = np.unique(term.astype(np.int64) * len(own) + item, return_counts=True)
    term, item = pair // len(own), pair % len(own)
    df = np.bincount(term, minlength=len(vocabulary))
    idf = np.log1p((len(own) - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / length.mean()))
    impact /= np.bincount(item, impact, minlength=len(own))[item]
    per_block = max(LEAST_BLOCK, -(-len(own) // BLOCKS))
    block = item // per_block
    maxima = np.zeros((len(vocabulary), int(block.max()) + 1), np.float32)
    # rounded up, so that the bound in single precision stays a bound
    np.maximum.at(maxima, (term, block), np.nextafter(impact.astype(np.float32), np.float32(2)))
    slots = np.zeros(1 << 20, bool)
    slots[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
    key = term * maxima.shape[1] + block
    return {
        "ids": [i for i, *_ in own], "vocabulary": vocabulary, "slots": slots, "maxima": maxima, "key": key, "item": item, "impact": impact,
        "question": [q for _, _, q, _ in own], "answer": [a for *_, a in own],
        "stride": max(LEAST_SPAN // 2, int(length.max())),
    }


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after another, and which range each is of."""
    n = end - begin
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + begin[of], of


def retrieve(own: dict, words: np.ndarray, first: np.ndarray):
    """(row, first word, end, item, score) of each passage and item that reach THRESHOLD."""
    stride, blocks = own["stride"], own["maxima"].shape[1]
    known = np.flatnonzero(own["slots"][(words >> np.uint64(44)).astype(np.int64)])
    at = np.searchsorted(own["vocabulary"], words[known])
    hit = own["vocabulary"][np.minimum(at, len(own["vocabulary"]) - 1)] == words[known]
    known, term = known[hit], at[hit]
    n = np.diff(first)
    passages = np.maximum(-(-n // stride) - 1, 1)  # passage j: words from j * stride to (j + 2) * stride
    base = np.cumsum(passages) - passages
    row = np.searchsorted(first, known, "right") - 1
    half = (known - first[row]) // stride
    here = half < passages[row]
    before = half > 0
    passage = np.concatenate([(base[row] + half)[here], (base[row] + half - 1)[before]])
    pair = np.unique(passage * len(own["vocabulary"]) + np.concatenate([term[here], term[before]]))
    if not len(pair):
        return
    passage, term = pair // len(own["vocabulary"]), pair % len(own["vocabulary"])
    start = np.flatnonzero(np.diff(passage, prepend=-1))
    stop = np.append(start[1:], len(passage))
    bound = np.add.reduceat(own["maxima"][term], start, axis=0)
    p, block = np.nonzero(bound >= THRESHOLD * (1 - 1e-4))
    if not len(p):
        return
    # the opened blocks' items, scored exactly
    entry, opened = _ranges(start[p], stop[p])
    wanted = term[entry] * blocks + block[opened]
    low, high = np.searchsorted(own["key"], wanted), np.searchsorted(own["key"], wanted, "right")
    posting, of = _ranges(low, high)
    opened = opened[of]
    pair, inverse = np.unique(opened * len(own["ids"]) + own["item"][posting], return_inverse=True)
    score = np.bincount(inverse, own["impact"][posting])
    for k in np.flatnonzero(score >= THRESHOLD - 1e-9):
        j = int(passage[start[p[pair[k] // len(own["ids"])]]])
        r = int(np.searchsorted(base, j, "right")) - 1
        begin = int(first[r]) + (j - int(base[r])) * stride
        yield r, begin, min(begin + 2 * stride, int(first[r + 1])), int(pair[k] % len(own["ids"])), float(score[k])


def _share(part: tuple[bool, np.ndarray], words: np.ndarray, held: np.ndarray) -> float:
    short, own = part
    return float(np.isin(own, words if short else held).mean()) if len(own) else 1.0


def matches(own: dict | None, column: pa.Array):
    """(row, item, score, question's share, answer's share) of what is found, the best passage of each row and item."""
    if own is None:
        return
    column = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    for i, _, data, offsets in chunks(column):
        starts, ends, first = word_spans(data, offsets)
        words = slice_hashes(data, starts, ends)
        best = {}
        for r, begin, end, item, score in retrieve(own, words, first):
            passage = words[begin:end]
            held = pairs(passage)
            q, a = _share(own["question"][item], passage, held), _share(own["answer"][item], passage, held)
            if q >= OVERLAP and a >= ANSWER_OVERLAP:
                best[r, item] = max(best.get((r, item), (0, 0, 0)), (score, q, a))
        for (r, item), found in sorted(best.items()):
            yield i + r, item, *found


def _find(shared):
    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for r, item, score, q, a in matches(shared.value, batch.column(1)):
                rows.append((ids[r], shared.value["ids"][item], score, q, a))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                names = [x.split()[0] for x in FOUND.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _clean(shared, text: int):
    def run(batches):
        for batch in batches:
            stays = np.ones(batch.num_rows, bool)
            stays[[m[0] for m in matches(shared.value, batch.column(text))]] = False
            yield batch.filter(pa.array(stays))

    return run


def indexes(items: DataFrame):
    """Broadcast indexes of items (item_id, text), each of at most MAX_ITEMS of them and MAX_WORDS words, or of one item."""
    rows = items.select("item_id", "text").distinct()
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(INDEXED))
    parts = 1
    while True:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
        held = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum(words).alias("words")).orderBy("part").collect()  # a row for each index
        if all(h.n == 1 or (h.n <= MAX_ITEMS and h.words <= MAX_WORDS) for h in held) or parts >= MAX_PARTS:
            break
        parts *= 2
    for h in held:
        own = dealt.where(F.col("part") == h.part).select("item_id", "text").collect()
        yield rows.sparkSession.sparkContext.broadcast(index(_sorted(own)))
    if not held:
        yield rows.sparkSession.sparkContext.broadcast(None)


def _sorted(rows):
    return sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score and overlaps of each document and test item found in it."""
    rows, out = docs.select("doc_id", "text"), None
    for shared in indexes(items):
        found = rows.mapInArrow(_find(shared), FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs in which no test item is found, with all their columns."""
    for shared in indexes(items):
        docs = docs.mapInArrow(_clean(shared, docs.columns.index("text")), docs.schema)
    return docs
