"""Quality rules: counted rules first, then a calibrated logistic regression on hashed word and character n-grams.

Training reads labelled rows (1 good, 0 bad), at most ``max_train`` of them (half of each class, those with the
smallest hash of their id) and at most ``MAX_TRAIN_BYTES`` of their features, which is what the task that fits them
holds; rows whose labels contradict each other or are null are not used. A quarter is held out to calibrate the scores
(Platt's sigmoid). Scoring runs in Arrow batches over whole texts; a document is kept if no counted rule fails and its
calibrated probability reaches the fixed ``threshold``.

Edge cases: a null text counts as empty; an empty text has all counts 0 and fails the rule on words. Without labels
of both classes there is no model: the counted rules alone decide and ``probability`` is null. Repeated rows are
judged one by one, extra columns are not looked at, an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fileloom.llm.common import chunks, mix64, slice_hashes, sums, words_of

BITS = 16
DIM = 1 << BITS
#: A document is kept from this calibrated probability of being good.
THRESHOLD = 0.45
MAX_TRAIN = 2000
#: Bytes of the features of labelled rows, 8 for each distinct n-gram of a row; rows beyond them are not used.
MAX_TRAIN_BYTES = 96 << 20
#: Features whose gradient is summed at a time.
STEP = 1 << 20
#: Counted rules: fewest words, and the most of 100 words that lie in repeated windows of three.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A mean over thousands of n-grams is small; this factor brings its gradient to a useful size.
SCALE = 16.0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _repeats(keys: np.ndarray) -> np.ndarray:
    """True where a key is found twice or more."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


class Kernel:
    """Counts and hashed features of a run of rows."""

    def read(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.first = words_of(data, offsets)
        self.words = slice_hashes(data, self.starts, self.ends)

    def counts(self) -> list[np.ndarray]:
        data, offsets, first = self.data, self.offsets, self.first
        rows = len(offsets) - 1
        chars = sums(((data & 0xC0) != 0x80) & ~_SPACE[data], offsets)
        symbols = sums(_SYMBOL[data], offsets)
        # lines: cut at \n and at the ends of rows
        cut = np.union1d(np.flatnonzero(data == 0x0A) + 1, offsets)
        begin, end = cut[:-1], cut[1:]
        if len(begin):
            end = end - (data[end - 1] == 0x0A)
        has = np.searchsorted(self.starts, end) > np.searchsorted(self.starts, begin)
        begin, end = begin[has], end[has]
        row = np.searchsorted(offsets, begin, "right") - 1
        with np.errstate(over="ignore"):
            keys = slice_hashes(data, begin, end) + mix64(row.astype(np.uint64) + np.uint64(1))
        _, at = np.unique(keys, return_index=True)
        dup = np.bincount(row, minlength=rows) - np.bincount(row[at], minlength=rows)
        # windows of three words
        h, n = self.words, len(self.words)
        in_window = np.zeros(n + 2, bool)
        if n > 2:
            of = np.repeat(np.arange(rows), np.diff(first))
            inside = of[:-2] == of[2:]
            with np.errstate(over="ignore"):
                keys = mix64(mix64(mix64(h[:-2]) * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:])
                keys = (keys + mix64(of[:-2].astype(np.uint64) + np.uint64(7)))[inside]
            hit = np.flatnonzero(inside)[_repeats(keys)]
            for k in range(3):
                in_window[hit + k] = True
        return [np.diff(first), chars, symbols, dup, sums(in_window[:n], first)]

    def features(self):
        """(bucket of each n-gram, start and end of each row's own) for words, 3 and 4 bytes."""
        yield (self.words >> np.uint64(64 - BITS)).astype(np.int64), self.first[:-1], self.first[1:]
        d = self.data.astype(np.uint32)
        gram = np.zeros(0, np.uint32)
        for n in (3, 4):
            if len(d) >= n:
                gram = d[: len(d) - n + 1] << np.uint32(8 * (n - 1))
                for k in range(1, n):
                    gram |= d[k : len(d) - n + 1 + k] << np.uint32(8 * (n - 1 - k))
                with np.errstate(over="ignore"):
                    bucket = (gram * np.uint32(2654435761)) >> np.uint32(32 - BITS)
            else:
                bucket = gram[:0]
            yield bucket, np.minimum(self.offsets[:-1], len(bucket)), np.clip(self.offsets[1:] - n + 1, self.offsets[:-1], None).clip(max=len(bucket))


def logits(kernel: Kernel, weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(kernel.offsets) - 1, bias)
    for family, (bucket, begin, end) in zip(weights, kernel.features(), strict=True):
        begin = np.minimum(begin, end)
        total = np.zeros(len(bucket) + 1)
        np.cumsum(family[bucket], out=total[1:])
        out += SCALE * (total[end] - total[begin]) / np.maximum(end - begin, 1)
    return out


def _sparse(batches):
    """(doc_id, label, indices, values) of labelled rows; int32 and float32 as bytes."""
    kernel = Kernel()
    for batch in batches:
        found = []
        for i, j, data, offsets in chunks(batch.column(2)):
            kernel.read(data, offsets)
            parts = [[] for _ in range(i, j)]
            for f, (bucket, begin, end) in enumerate(kernel.features()):
                for k, (b, e) in enumerate(zip(begin, end, strict=True)):
                    if e > b:
                        at, n = np.unique(bucket[b:e], return_counts=True)
                        parts[k].append((at.astype(np.int32) + f * DIM, (SCALE * n / (e - b)).astype(np.float32)))
            found += [(np.concatenate([p[0] for p in x]).tobytes(), np.concatenate([p[1] for p in x]).tobytes()) if x else (b"", b"") for x in parts]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], ["doc_id", "label", "at", "value"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(rows: list[tuple[int, int, pa.Buffer, pa.Buffer]], steps: int = 80, rate: float = 0.15, decay: float = 1e-4) -> dict | None:
    """Logistic regression by Adam over all rows at a time, then Platt's sigmoid on the quarter that is held out.

    rows: label, id, columns and values of each; their order does not matter.
    """
    rows = sorted((r for r in rows if len(r[2])), key=lambda r: r[:2])  # a text without words or grams teaches nothing
    if len({r[0] for r in rows}) < 2:
        return None
    held = np.zeros(len(rows), bool)
    for label in (0, 1):
        held[[i for i, r in enumerate(rows) if r[0] == label][3::4]] = True
    y = np.array([r[0] for r in rows], float)

    def stacked(mask):
        """Runs of rows with about STEP features: their columns and values one after another, where each begins, how long it is."""
        pick = np.flatnonzero(mask)
        ends, runs, i = np.cumsum([len(rows[k][2]) // 4 for k in pick]), [], 0
        while i < len(pick):
            j = max(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP, "right")), i + 1)
            own = [rows[k] for k in pick[i:j]]
            length = np.array([len(r[2]) // 4 for r in own])
            runs.append((np.concatenate([np.frombuffer(r[2], np.int32) for r in own]), np.concatenate([np.frombuffer(r[3], np.float32) for r in own]), np.cumsum(length) - length, length))
            i = j
        return runs, y[pick]

    def scores(runs):
        light = w.astype(np.float32)
        return np.concatenate([np.add.reduceat(light[col] * val, first) for col, val, first, _ in runs]).astype(float) + bias

    def gradient(runs, g):
        out, at = np.zeros(3 * DIM), 0
        for col, val, first, length in runs:
            out += np.bincount(col, np.repeat(g[at : at + len(first)].astype(np.float32), length) * val, minlength=3 * DIM)
            at += len(first)
        return out

    runs, t = stacked(~held)
    check, held_t = stacked(held)
    rows.clear()
    balance = np.where(t == 1, 0.5 / max(t.sum(), 1), 0.5 / max((1 - t).sum(), 1))
    w, bias = np.zeros(3 * DIM), 0.0
    m, v, mb, vb = np.zeros(3 * DIM), np.zeros(3 * DIM), 0.0, 0.0
    for k in range(1, steps + 1):
        g = (_sigmoid(scores(runs)) - t) * balance
        gw, gb = gradient(runs, g) + decay * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**k, 1 - 0.99**k
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        bias -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    a, b = 1.0, 0.0
    t = held_t
    if 0 < t.sum() < len(t):
        z = scores(check)
        n1, n0 = t.sum(), len(t) - t.sum()
        target = np.where(t == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        # each class counts the same: the share of bad rows among the labelled ones is no prior for the corpus
        share = np.where(t == 1, 0.5 / n1, 0.5 / n0)
        a = 0.1
        for _ in range(50):  # Newton's method for slope and offset, damped
            p = _sigmoid(a * z + b)
            e, s = (p - target) * share, np.maximum(p * (1 - p) * share, 1e-12)
            grad = np.array([(e * z).sum(), e.sum()])
            hess = np.array([[(s * z * z).sum() + 1e-6, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
            step = np.linalg.solve(hess, grad)
            step /= max(1.0, np.abs(step).max())
            a, b = a - step[0], b - step[1]
        if a <= 0:
            a, b = 1.0, 0.0
    return {"weights": w.reshape(3, DIM).astype(np.float32), "bias": float(bias), "slope": float(a), "offset": float(b)}


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict | None:
    """docs (doc_id, text) and labels (doc_id, quality); the features of at most max_train rows are held in one task."""
    own = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most")).where("label = most")
    picked = None
    for label in (0, 1):
        some = own.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train // 2).select("doc_id", F.col("label").cast("int").alias("label"))
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # max_train pairs of numbers
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # rows that share an id count once
    rows = texts.select("doc_id", "label", "text").mapInArrow(_sparse, "doc_id long, label int, at binary, value binary")
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over max_train rows
    rows = rows.withColumn("held", F.sum(F.octet_length("at") + F.octet_length("value")).over(so_far)).where(F.col("held") <= MAX_TRAIN_BYTES)
    # the task that sums the bytes also fits; only the weights come to the driver
    found = rows.select("label", "doc_id", "at", "value").mapInArrow(_fitted, "model binary").collect()
    return pickle.loads(found[0].model) if found else None


def _fitted(batches):
    rows = [(x.as_py(), i.as_py(), a.as_buffer(), v.as_buffer()) for batch in batches for x, i, a, v in zip(*batch.columns, strict=True)]
    model = pickle.dumps(fit(rows))
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks
    yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])


def judge(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, kept and probability of each row."""
    return docs.select("doc_id", "text").mapInArrow(_judge(docs, model, threshold, False), SCHEMA)


def keep(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    return docs.mapInArrow(_judge(docs, model, threshold, True), docs.schema)


def _judge(docs: DataFrame, model: dict | None, threshold: float, whole: bool):
    shared = docs.sparkSession.sparkContext.broadcast(model)  # three tables of 65,536 floats
    text = docs.columns.index("text") if whole else 1

    def run(batches):
        kernel, own = Kernel(), shared.value
        for batch in batches:
            out = [[] for _ in range(6)]
            for _, _, data, offsets in chunks(batch.column(text)):
                kernel.read(data, offsets)
                counts = kernel.counts()
                if own is None:
                    p = np.full(len(offsets) - 1, np.nan)
                else:
                    p = _sigmoid(own["slope"] * logits(kernel, own["weights"], own["bias"]) + own["offset"])
                for a, x in zip(out, [*counts, p], strict=True):
                    a.append(x)
            if not out[0]:
                continue
            cols = [np.concatenate(x) for x in out]
            n_words, p = cols[0], cols[5]
            failed = (n_words < MIN_WORDS) | (100 * cols[4] > MAX_REPEAT_PERCENT * n_words)
            kept = ~failed & (np.isnan(p) | (p >= threshold))
            if whole:
                yield batch.filter(pa.array(kept))
            else:
                ids = batch.column(0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c.astype(np.int64)) for c in cols[:5]), pa.array(failed), pa.array(kept), pa.array(p, mask=np.isnan(p))], ["doc_id", *COUNTS, "base_failed", "kept", "probability"])

    return run
