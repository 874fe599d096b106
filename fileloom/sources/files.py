"""Reading folders of files as rows, and writing outputs as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileloom.functions.formats import INPUTS

#: Content of larger files is not read, as a row must fit in memory; they are error rows.
MAX_FILE_BYTES = 1 << 30
#: Names that Hadoop and Arrow have for the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "gcs": "gs"}
SAVED = "id long, file string, bytes long"


def scan(spark: SparkSession, path: str, recursive: bool = True, any_format: bool = False) -> DataFrame:
    """name, content, path, length and error of the files under a path; of known formats, unless any_format.

    Endings count in any case. A file of over MAX_FILE_BYTES has no content but an error; a file that goes or breaks while
    it is read is skipped. Selections that leave content out do not read it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    if not any_format:
        either = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in sorted(INPUTS)]
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(either) + "}")
    files = reader.load(path).withColumn("name", F.substring_index("path", "/", -1))
    small = files.where(F.col("length") <= MAX_FILE_BYTES).select("name", "content", "path", "length", F.lit(None).cast("string").alias("error"))
    problem = F.concat(F.lit("File too large: "), F.col("length").cast("string"), F.lit(" bytes"))
    large = files.where(F.col("length") > MAX_FILE_BYTES).select("name", F.lit(None).cast("binary").alias("content"), "path", "length", problem.alias("error"))
    return small.unionByName(large)


def arrow_uri(folder: str) -> str:
    """A folder's URI as Arrow knows it."""
    scheme, found, rest = folder.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}://{rest}" if found else folder


def save(batch: DataFrame, folder: str) -> int:
    """Writes each output of a batch that is done to folder/id-name, through a file system that all executors share.

    A folder without a scheme is one of Spark's default file system. A file appears under its name only when it is whole,
    so a task that runs twice leaves the same files. Returns how many there are.
    """
    from fileloom.plans.batch import entries

    spark = batch.sparkSession
    if "://" not in folder:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        folder = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toString()
    uri = arrow_uri(folder) if "://" in folder else "file://" + folder.removeprefix("file:")

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        for b in batches:
            files = []
            for i, name, data in zip(*(c for c in b.columns), strict=True):
                part = f"{base}/.{uuid.uuid4().hex}"
                file = f"{i.as_py()}-{name.as_py().replace('/', '_')}"
                with store.open_output_stream(part) as out:
                    out.write(data.as_buffer())
                store.move(part, f"{base}/{file}")
                files.append(file)
            sizes = [len(x.as_buffer()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(files, pa.string()), pa.array(sizes, pa.int64())], ["id", "file", "bytes"])

    return entries(batch).mapInArrow(write, SAVED).count()
