"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly, bytes first.

Equal texts go together. What is packed are groups of equal texts: each group that holds over 1 / ``GRAIN`` of a shard's
fair share of bytes, tokens or rows by itself (at most 3 * shards * GRAIN such groups can exist), the smaller ones
gathered whole by the hash of their text in ``PARCELS`` parcels, a fixed number whatever the input, so that what is
packed on the driver is bounded. Parcels and groups, largest first, go each to the shard where the dot product of its
(bytes, tokens, rows) and the shard's residual capacity is highest. One exit: a group with more bytes than a shard's fair
share fits in no shard of near-equal bytes; it is cut by the hash of the id into as many pieces as it fills shares. A
group that exceeds a share in rows or tokens only stays whole.

Slots number a shard's rows without gaps: rows are numbered within (shard, lane) and lanes begin where the counts of
those before end, so no task sees a whole shard.

Edge cases: a null text is a group of its own with no bytes; a size is bytes plus ``OVERHEAD``; repeated rows go
together; rows without an id are spread by their texts; an empty table gives an empty result; extra columns are not
looked at.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fileloom.llm.common import WORD, materialize, text_of

SHARDS = 40
OVERHEAD = 16
PARCELS = 8192
GRAIN = 16
LANES = 64
#: Weight of bytes, tokens and rows in the dot product: the law is near-equal bytes.
DIMENSIONS = ("size", "tokens", "n")
WEIGHTS = (4.0, 1.0, 1.0)
#: Packed items change places until no shard has this share more bytes than another, or so many times for each shard.
EVEN, SWAPS = 0.001, 16
#: What tells equal texts: two hashes and the size.
GROUP = "of long, text_crc32 long, size long"


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of vectors (items x dimensions)."""
    total = vectors.sum(0)
    share = vectors / np.where(total > 0, total, 1) * np.sqrt(WEIGHTS)
    residual = np.tile(share.sum(0) / shards, (shards, 1))
    out = np.zeros(len(share), np.int64)
    for i in np.lexsort((np.arange(len(share)), -share.sum(1), -share[:, 0])):  # largest in bytes first, as they are the law
        k = int(np.argmax(residual @ share[i]))
        out[i] = k
        residual[k] -= share[i]
    return settle(vectors[:, 0], out, shards)


def settle(size: np.ndarray, place: np.ndarray, shards: int) -> np.ndarray:
    """Evens the bytes out: items of the fullest and of the emptiest shard change places, one for one, while that helps."""
    place, fill = place.copy(), np.bincount(place, size, shards)
    for _ in range(SWAPS * shards):
        high, low = int(fill.argmax()), int(fill.argmin())
        gap = fill[high] - fill[low]
        a, b = np.flatnonzero(place == high), np.flatnonzero(place == low)
        if gap <= EVEN * fill.mean() or not len(b):
            break
        b = b[np.argsort(size[b], kind="stable")]
        at = np.searchsorted(size[b], size[a] - gap / 2).clip(0, len(b) - 1)
        x = np.concatenate([a, a])
        y = np.concatenate([b[at], b[np.maximum(at - 1, 0)]])
        moved = size[x] - size[y]
        k = int(np.argmin(np.abs(moved - gap / 2)))
        if not 0 < moved[k] < gap:
            break
        place[x[k]], place[y[k]] = low, high
        fill[high] -= moved[k]
        fill[low] += moved[k]
    return place


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard and slot of each row of docs."""
    spark = docs.sparkSession
    text = text_of("text")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64("text").alias("of"),
    )
    rows = materialize(rows, "sizes").withColumn("spread", F.xxhash64("doc_id", "of"))
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    parcel = F.pmod("of", F.lit(PARCELS))
    by_parcel = rows.groupBy(parcel.alias("parcel")).agg(*sums).collect()  # PARCELS rows at most
    total = {k: sum(r[k] for r in by_parcel) or 1 for k in DIMENSIONS}
    limit = {k: total[k] / (shards * GRAIN) for k in DIMENSIONS}
    heavy = [r.parcel for r in by_parcel if any(r[k] > limit[k] for k in DIMENSIONS)]
    own = []
    if heavy:
        # only a heavy parcel can hold a heavy group; there are 3 * shards * GRAIN of those at most
        over = F.lit(False)
        for k in DIMENSIONS:
            over |= F.col(f"all_{k}") > limit[k]
        of_group = [F.col(c.split(" ")[0]) for c in GROUP.split(", ")]
        groups = rows.where(parcel.isin(heavy)).groupBy(*of_group).agg(*[F.sum(k).alias(f"all_{k}") for k in ("size", "tokens")], F.count("*").alias("all_n")).where(over).collect()
        share = total["size"] / shards
        begin = PARCELS
        for g in sorted(groups, key=lambda g: (g.of, g.text_crc32, g.size)):
            own.append((g.of, g.text_crc32, g.size, pieces := max(1, math.ceil(g.all_size / share)), begin))
            begin += pieces
    if own:
        pieces = F.broadcast(spark.createDataFrame(own, f"{GROUP}, pieces int, begin int"))
        rows = rows.join(pieces, [c.split(" ")[0] for c in GROUP.split(", ")], "left").withColumn("parcel", F.coalesce(F.col("begin") + F.pmod("spread", "pieces"), parcel)).drop("pieces", "begin")
        by_parcel = rows.groupBy("parcel").agg(*sums).collect()  # PARCELS, the heavy groups, and at most shards more for those that are cut
    else:
        rows = rows.withColumn("parcel", parcel)
    by_parcel = sorted(by_parcel, key=lambda r: r.parcel)
    place = pack(np.array([[r[k] for k in DIMENSIONS] for r in by_parcel], float).reshape(-1, len(DIMENSIONS)), shards)
    shard_of = spark.createDataFrame([(int(r.parcel), int(s)) for r, s in zip(by_parcel, place, strict=True)], "parcel long, shard int")
    rows = rows.join(F.broadcast(shard_of), "parcel").withColumn("lane", F.pmod("spread", F.lit(LANES)))
    counts = rows.groupBy("shard", "lane").agg(F.count("*").alias("n"))  # shards * LANES rows
    ahead = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "lane", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    number = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("own", number).join(F.broadcast(counts), ["shard", "lane"])
    return placed.select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("ahead") + F.col("own") - 1).alias("slot"))
