"""Mixing sources to target weights by systematic sampling, in DataFrame expressions only.

Sources in order of code point (null last) weigh ``WEIGHTS`` in turn. They share all words by weight; a target stops
at ``MOST`` = 3 times its source's size and the excess is shared again by weight, which is water filling: with
ratio 3 * size / weight in ascending order, sources are full up to the first whose ratio exceeds the level
(what is left) / (weight that is left); that level times its weight is each other source's target.

Within a source every document expects target / size copies. Documents are laid end to end in an order by size, so
that what is taken comes within one document of the target; a prefix sum of the expected copies plus one random offset of
the source gives as many copies as integer boundaries are crossed. The offset is drawn from the source's name, so reruns
agree. The prefix sum is distributed: rows are numbered in chunks (a band of sizes of a tenth at most, and one of
``LANES`` residues of a digest of the id), and the chunks' counts give where each begins. More than ``TASK_SOURCES`` sources are
ranked likewise, in ranges of their order, so that however many there are none of this runs in one task.

Edge cases: a null text has size 0; a source of size 0 has target 0 and takes nothing; null is a source of its own;
a null id comes first in the order of its size and is spread by its text; repeated rows are each sampled; an empty table
gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fileloom.llm.common import WORD, materialize

WEIGHTS = (5, 2, 1)
MOST = 3
LANES = 128
#: Sources that one task numbers, some 100 bytes each.
TASK_SOURCES = 100_000


def numbered(df: DataFrame, order: list[str], sums: dict[str, str], few: bool) -> DataFrame:
    """df with rank (from 1) in an order without ties, and for each name of sums the sum of a column over the rows before.

    Few rows are numbered in one task. More go to ranges of the order; a range's rows are numbered by themselves and begin
    where the ranges before end, and only the ranges' totals, a row for each, are summed in one task.
    """
    rows, base = df, {k: F.lit(0) for k in ("rank", *sums)}
    own = Window.orderBy(*order)
    if not few:
        rows = materialize(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
        totals = rows.groupBy("range").agg(F.count("*").alias("rank_0"), *[F.sum(c).alias(f"{k}_0") for k, c in sums.items()])
        ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select("range", *[F.coalesce(F.sum(f"{k}_0").over(ahead), F.lit(0)).alias(f"{k}_0") for k in ("rank", *sums)])
        rows, base, own = rows.join(F.broadcast(totals), "range"), {k: F.col(f"{k}_0") for k in ("rank", *sums)}, Window.partitionBy("range").orderBy(*order)
    out = rows.withColumn("rank", F.row_number().over(own) + base["rank"])
    for k, c in sums.items():
        out = out.withColumn(k, F.coalesce(F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + base[k])
    return out.drop("range", *[f"{k}_0" for k in ("rank", *sums)])


def targets(sizes: DataFrame) -> DataFrame:
    """(src, nul, source_size) of each source -> with target and rate, the copies that each document expects."""
    few = sizes.count() <= TASK_SOURCES
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    s = numbered(sizes, ["nul", "src"], {}, few).withColumn("weight", weight).withColumn("full", F.col("source_size").cast("double") * MOST)
    s = s.withColumn("ratio", F.col("full") / F.col("weight")).drop("rank")
    s = materialize(numbered(s, ["ratio", "nul", "src"], {"filled": "full", "weighed": "weight"}, few), "levels")
    every = s.agg(F.sum("source_size").cast("double").alias("words"), F.sum("weight").alias("weights")).first()
    level = (F.lit(every.words) - F.col("filled")) / (F.lit(every.weights) - F.col("weighed"))
    first = s.where(F.col("ratio") > level).agg(F.min(F.struct("ratio", "nul", "src", level.alias("level")))["level"].alias("level")).first()
    # without a level all sources are full
    target = F.col("full") if first.level is None else F.least("full", F.lit(first.level) * F.col("weight"))
    s = s.withColumn("target", target)
    return s.select("src", "nul", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0).alias("rate"))


def offset(src: str = "src") -> Column:
    """The source's offset, 20 bits of its name's digest."""
    return F.conv(F.substring(F.md5(F.col(src)), 1, 5), 16, 10).cast("double") / float(1 << 20)


def copies() -> Column:
    """Integer boundaries that the row's stretch of the prefix sum crosses."""
    upper, lower = F.floor(offset() + F.col("n") * F.col("rate")), F.floor(offset() + (F.col("n") - 1) * F.col("rate"))
    return F.least(upper - lower, F.lit(MOST).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (copies times size) and text_hash of each row of docs."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    lane = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce("text", F.lit(""))))), 1, 4), 16, 10).cast("int") % LANES
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().cast("int").alias("nul"), size.alias("size"), lane.alias("lane"), F.xxhash64("text").alias("text_hash"))
    rows = materialize(rows, "sizes")
    digits = F.col("size").cast("string")
    keys = ["nul", "src", "band", "lane"]
    rows = rows.withColumn("band", F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int"))
    chunks = materialize(rows.groupBy(*keys).agg(F.count("*").alias("held"), F.sum("size").alias("words")), "chunks")
    goal = targets(chunks.groupBy("src", "nul").agg(F.sum("words").alias("source_size")))
    # where a chunk begins: what the bands before hold, then the lanes before; no window sees all chunks of a source
    before = lambda w: F.coalesce(F.sum("held").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = chunks.groupBy("nul", "src", "band").agg(F.sum("held").alias("held"))
    bands = bands.withColumn("above", before(Window.partitionBy("nul", "src").orderBy("band"))).drop("held").join(goal, ["nul", "src"])
    chunks = chunks.withColumn("within", before(Window.partitionBy("nul", "src", "band").orderBy("lane"))).join(bands, ["nul", "src", "band"])
    chunks = chunks.withColumn("first", F.col("above") + F.col("within")).drop("held", "words", "above", "within")
    own = F.row_number().over(Window.partitionBy(*keys).orderBy("size", "doc_id", "text_hash")).cast("long")
    placed = rows.withColumn("own", own).join(chunks, keys).withColumn("n", F.col("first") + F.col("own"))
    chosen = placed.withColumn("copies", copies())
    return chosen.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_hash")


def expand(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; rows of the same doc_id and text are one document.

    Rows meet their copies by id and text, so those without an id are spread; texts are dealt once and not sorted.
    """
    i, text, times, k = (next(f"{'_' * n}{c}" for n in range(len(docs.columns) + 1) if f"{'_' * n}{c}" not in docs.columns) for c in ("id", "text_hash", "copies", "copy"))
    taken = mix(docs).groupBy(F.col("doc_id").alias(i), F.col("text_hash").alias(text)).agg(F.max("copies").cast("int").alias(times)).where(F.col(times) > 0)
    met = docs.join(taken.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(text)))
    return met.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)
