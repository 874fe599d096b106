"""What the operators of this subpackage share: materialising, and vectorised word and line hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a kernel works on at a time; temporaries are some 100 bytes for each.
CHUNK_BYTES = 1 << 19
#: Longer slices are hashed one by one.
LONG_SLICE = 256

#: For a shared folder that is mounted: Hadoop's usual local file system starts two processes (chmod) for each file that it
#: writes, one of them for the file of checksums beside it; the plain one starts one. Until such a process has its own
#: program it shares the executor's memory, and tools that add up processes count that twice.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session, as in tests, gets one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="fileloom-checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it again. The table goes when it is dropped, or when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/fileloom-{name}-{uuid.uuid4().hex}"
    df.write.options(**PLAIN_FILES).parquet(path)
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._fileloom_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes materialized tables that nothing reads any more."""
    for t in tables:
        own = next(x for x in _written if x[1] == t._fileloom_path)
        _remove(*own)
        _written.remove(own)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def _remove_all() -> None:
    for own in _written:
        try:
            _remove(*own)
        except Exception:  # noqa: BLE001  the session may be gone by then
            return


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


# --- vectorised text kernels -------------------------------------------------------------------------------------

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k, step = 1, base
    while k < n:
        m = min(k, n - k)
        with np.errstate(over="ignore"):
            out[k : k + m] = out[:m] * np.uint64(step)
        step = step * step % (1 << 64)
        k *= 2
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser in the manner of SplitMix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


class Hasher:
    """Hashes of any slices of a byte array, from one prefix sum. A polynomial modulo 2^64: only for slices of under 256 bytes,
    as longer ones can be made to collide (a Thue-Morse string and its complement)."""

    def __init__(self) -> None:
        self._pw = self._inv = np.ones(0, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self._pw) < n:
            size = max(n, CHUNK_BYTES + CHUNK_BYTES // 4)
            self._pw, self._inv = _powers(_P, size), _powers(_P_INV, size)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data] * self._pw[: n - 1], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((prefix[end] - prefix[start]) * self._inv[start] + (end - start).astype(np.uint64))


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of slices of any length: of up to LONG_SLICE bytes by rounds of 8 bytes, of longer ones XXH64."""
    n = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        out = mix64(n.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
        todo = np.flatnonzero((n > 0) & (n <= LONG_SLICE))
        at = 0
        while len(todo):
            block, rest = eight[start[todo] + at], n[todo] - at
            short = rest < 8
            block[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
            out[todo] = mix64(out[todo] ^ mix64(block + np.uint64(at + 1)))
            at += 8
            todo = todo[rest > 8]
    for k in np.flatnonzero(n > LONG_SLICE).tolist():
        out[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]].tobytes())
    return out


def chunks(col: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, row after the last, bytes, offsets from 0) of runs of rows with about limit bytes; null counts as ''."""
    if pa.types.is_string_view(col.type) or not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    buffers = col.buffers()
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(buffers[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first word number of each row (one more entry at the end)."""
    ink = ~_WS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = True
        np.logical_not(ink[:-1], out=before[1:])
    starts = np.flatnonzero(ink & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = True
        np.logical_not(ink[1:], out=after[:-1])
    ends = np.flatnonzero(ink & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i] : first[i + 1]]."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
