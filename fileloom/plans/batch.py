"""Batches of files: ingest, retarget, convert, summarise, archive. A file is a row, a batch is a DataFrame.

Rows: id, name, content, extension ('' if unknown), size, target, status (pending, done or error), output, error.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fileloom.functions import formats as fm
from fileloom.operators import archives
from fileloom.plans.registry import converted

PENDING, DONE, ERROR = "pending", "done", "error"
#: Bytes of outputs that one archive holds at most, about; a larger batch is packed into several.
VOLUME_BYTES = 64 << 20
#: Bytes that an entry counts beside its data: a header in a tar.
ENTRY_BYTES = 512


def ingest(files: DataFrame, id_col: str | None = None) -> DataFrame:
    """files (name, content) as pending rows. Without an id column, ids follow the order of the scan; nothing is shuffled.

    Files that the scan could not read (their error is not null) are error rows from the start.
    """
    ext = F.coalesce(fm.detect_format("name"), F.lit(""))
    error = F.col("error").cast("string") if "error" in files.columns else F.lit(None).cast("string")
    return files.select(
        (F.col(id_col) if id_col else F.monotonically_increasing_id()).cast("long").alias("id"),
        "name",
        "content",
        ext.alias("extension"),
        (F.coalesce(F.octet_length("content"), F.col("length")) if "length" in files.columns else F.octet_length("content")).cast("long").alias("size"),
        fm.default_target(ext).alias("target"),
        F.when(error.isNull(), PENDING).otherwise(ERROR).alias("status"),
        F.lit(None).cast("binary").alias("output"),
        error.alias("error"),
    )


def remove_file(batch: DataFrame, file_id: int) -> DataFrame:
    return batch.where(F.col("id") != file_id)


def set_target(batch: DataFrame, file_id: int, target: str) -> DataFrame:
    """A new target for one row; a row that was converted or failed is pending again."""
    own = F.col("id") == file_id
    again = own & F.col("status").isin(DONE, ERROR)
    return (
        batch.withColumn("target", F.when(own, target).otherwise(F.col("target")))
        .withColumn("output", F.when(~again, F.col("output")))
        .withColumn("error", F.when(~again, F.col("error")))
        .withColumn("status", F.when(again, PENDING).otherwise(F.col("status")))
    )


def convert_all(batch: DataFrame) -> DataFrame:
    """Converts pending rows that have a target; a failure is its row's error."""
    due = F.col("target").isNotNull() & (F.col("status") == PENDING)
    done = converted(batch, F.when(due, F.col("content")), F.col("extension"), F.col("target"))
    new = lambda name: F.when(due, F.col(f"__{name}")).otherwise(F.col(name)).alias(name)
    status = F.when(~due, F.col("status")).when(F.col("__error").isNull(), DONE).otherwise(ERROR)
    return done.select("id", "name", "content", "extension", "size", "target", status.alias("status"), new("output"), new("error"))


def summary(batch: DataFrame) -> DataFrame:
    """One row: has_files, all_done, can_convert, done_count, pending_count."""
    ended = F.col("status").isin(DONE, ERROR)
    return batch.agg(
        (F.count("*") > 0).alias("has_files"),
        ((F.count("*") > 0) & F.coalesce(F.bool_and(ended), F.lit(False))).alias("all_done"),
        F.coalesce(F.bool_or(F.col("target").isNotNull() & (F.col("status") == PENDING)), F.lit(False)).alias("can_convert"),
        F.count_if(F.col("status") == DONE).alias("done_count"),
        F.count_if(F.col("status") == PENDING).alias("pending_count"),
    )


def entries(batch: DataFrame) -> DataFrame:
    """id, name and data of what an archive of the batch holds: outputs of rows that are done, under their new names."""
    name = fm.output_name("name", F.coalesce("target", F.lit("bin")))
    return batch.where(F.col("status") == DONE).select("id", name.alias("name"), F.col("output").alias("data"))


def manifest(batch: DataFrame) -> DataFrame:
    """id, name, size and SHA-256 of the entries, without making an archive."""
    return entries(batch).select("id", "name", F.octet_length("data").cast("long").alias("size"), F.sha2("data", 256).alias("sha256"))


def _told_apart(batches):
    """(row, volume, position, name) of rows (row, volume, position, name, root) sorted by root and position: names get (n) as in one archive."""
    at, seen, tried = None, set(), {}
    for b in batches:
        names = []
        for name, root in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            if root != at:
                at, seen, tried = root, set(), {}
            names.append(archives.unique_name(name, seen, tried))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(names, pa.string())], ["row", "volume", "position", "name"])


def placed(own: DataFrame, volume_bytes: int) -> DataFrame:
    """row, volume, position and name of each of own's entries (row, id, name, data) in one sequence by id, cut into volumes.

    Data is not sorted, only its size. Rows are dealt to ranges of the order and numbered there; the ranges' totals, a row
    for each, say where they begin. Ties in id go by name and data, rows without an id come last.
    """
    order = [F.col("id").asc_nulls_last(), F.col("name"), F.col("digest"), F.col("row")]
    size = F.coalesce(F.octet_length("data"), F.lit(0)).cast("long") + ENTRY_BYTES
    rows = own.select("row", "id", "name", F.xxhash64("data").alias("digest"), size.alias("size"))
    rows = rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(ahead(w)), F.lit(0))
    totals = rows.groupBy("range").agg(F.count("*").alias("held"), F.sum("size").alias("bytes"))
    starts = totals.select("range", before("held", Window.orderBy("range")).alias("first"), before("bytes", Window.orderBy("range")).alias("begin"))
    within = Window.partitionBy("range").orderBy(*order)
    position = F.col("first") + F.row_number().over(within) - 1
    volume = F.floor((F.col("begin") + before("size", within)) / volume_bytes).cast("int")
    rows = rows.join(F.broadcast(starts), "range").select("row", volume.alias("volume"), position.alias("position"), "name").persist(StorageLevel.DISK_ONLY)
    # a name without its numbers and all names that are made of it have the same root
    ext = F.regexp_extract("name", r"\.[^.]*\z", 0)
    stem = F.substring("name", F.lit(1), F.length("name") - F.length(ext))
    rows = rows.withColumn("root", F.concat(F.regexp_replace(stem, r"( \([0-9]+\))+\z", ""), ext))
    tangled = rows.where("name <> root").select("root").distinct()
    plain = rows.join(tangled, "root", "left_anti")
    n = F.row_number().over(Window.partitionBy("name").orderBy("position")) - 1
    told = F.when(n == 0, F.col("name")).otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), ext))
    plain = plain.select("row", "volume", "position", told.alias("name"))
    others = rows.join(tangled, "root", "left_semi").select("row", "volume", "position", "name", "root")
    others = others.repartition("root").sortWithinPartitions("root", "position")
    return plain.unionByName(others.mapInArrow(_told_apart, "row long, volume int, position long, name string"))


def pack(batch: DataFrame, fmt: str, volume_bytes: int = VOLUME_BYTES) -> DataFrame:
    """volume, archive, mime, n_entries, first: archives of the batch's outputs in order of id; none of nothing or an unknown format.

    One archive, unless the outputs are larger than volume_bytes: then each volume goes on where the one before ends (first
    is the position of its first entry in the batch), and a name is told apart from those of all volumes, so that volumes
    unpacked to one folder are the batch. Volumes ascend, with gaps behind entries that are larger. No task gathers the
    batch. Outputs are kept on the executors' disks between numbering and packing them, so that each conversion runs once
    (again where an executor is lost); they stay until the session's cache is cleared.
    """
    out = "volume int, archive binary, mime string, n_entries long, first long"
    if fmt not in archives.FORMATS:
        return batch.sparkSession.createDataFrame([], out)
    own = entries(batch).withColumn("row", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        volume, first = table.column("volume")[0].as_py(), table.column("position")[0].as_py()
        packed = archives.create(fmt, [(n.as_py(), d.as_py() or b"") for n, d in zip(table.column("name"), table.column("data"), strict=True)])
        return pa.table({"volume": pa.array([volume], pa.int32()), "archive": pa.array([packed], pa.binary()), "mime": [archives.FORMATS[fmt]], "n_entries": pa.array([table.num_rows], pa.int64()), "first": pa.array([first], pa.int64())})

    return own.select("row", "data").join(placed(own, volume_bytes).hint("shuffle_hash"), "row").groupBy("volume").applyInArrow(make, out)


def unpack(packed: DataFrame, fmt: str) -> DataFrame:
    """volume, position in the batch, name and data of the entries of archives."""

    def read(batches):
        for b in batches:
            for v, first, archive in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                rows = [(v, first + k, n, d) for k, (n, d) in enumerate(archives.manifest(fmt, archive.as_py()))]
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["volume", "position", "name", "data"])

    return packed.select("volume", "first", "archive").mapInArrow(read, "volume int, position int, name string, data binary")
