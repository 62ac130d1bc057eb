"""Sharding by sampled splitters, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.llm.storage import written

#: Bytes that one range is meant to hold, and the most ranges whatever the input's size.
RANGE_BYTES, MOST_RANGES = 8 << 20, 4096
#: Sampled keys for each range; so at most 131,072 keys of 8 bytes reach the driver.
SAMPLES = 32


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``key``, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = F.lit(bounds)
    return F.aggregate(
        F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) <= key), at + step).otherwise(at)
    )


def splitters(df: DataFrame, key: str, size: str, total: int, ranges: int) -> list[int]:
    """Quantile boundaries of a size-weighted sample of keys.

    A row is drawn when a hash of its key and id, read as a uniform number, lies under size * samples / total.
    """
    chance = F.col(size) * F.lit(ranges * SAMPLES / max(total, 1))
    uniform = F.pmod(F.xxhash64(F.lit(17), *[F.col(c) for c in df.columns]), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = sorted(r[0] for r in df.where(uniform < chance).select(key).collect())
    return sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []


def shard_by_splitters(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal records into ``shards`` of nearly equal bytes.

    The key is a hash of the text, so equal texts lie next to each other and a group of them is cut only where a shard ends.
    A sample of keys, weighted by size, gives quantile boundaries; ranges that come out over twice their share (one text may
    hold a third of all rows) are subdivided by a hash of the id; running sums inside ranges then place the shard ends, so that
    a shard is off its equal share by one record at most.

    Returns id, size (UTF-8 bytes plus 1), text_crc32, shard, slot (0, 1, ... in each shard).
    Null and empty texts have size 1 and checksum 0; repeated rows each get a slot; an empty table gives no rows. Only the id
    and the text are read, so other columns may have any name.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key")
    )
    base = written(base, "shard-keys")
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = min(MOST_RANGES, max(8 * shards, math.ceil(total / RANGE_BYTES)))
    share = max(1, total // ranges)
    ranged = base.withColumn("range", range_of(F.col("key"), splitters(base, "key", "size", total, ranges)))

    # at most MOST_RANGES rows, so they may be broadcast at any input size
    parts = ranged.groupBy("range").agg(F.sum("size").alias("bytes")).select(
        "range", F.when(F.col("bytes") > 2 * share, F.ceil(F.col("bytes") / share)).otherwise(1).cast("int").alias("parts")
    )
    celled = ranged.join(F.broadcast(parts), "range").withColumn("cell", F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int")).drop("parts")

    # cells: at most MOST_RANGES and one more for each share, so under 3 * MOST_RANGES rows
    cells = celled.groupBy("range", "cell").agg(F.sum("size").alias("bytes"))
    ends = cells.select("range", "cell", (F.sum("bytes").over(Window.orderBy("range", "cell")) - F.col("bytes")).alias("before"))
    inside = Window.partitionBy("range", "cell").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = celled.join(F.broadcast(ends), ["range", "cell"]).withColumn("middle", F.col("before") + F.sum("size").over(inside) - F.col("size") / 2)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / F.lit(max(total, 1)))).cast("int"))
    placed = placed.withColumn("nth", F.row_number().over(Window.partitionBy("range", "cell", "shard").orderBy("key", "id", "size")))

    counts = placed.groupBy("range", "cell", "shard").agg(F.count(F.lit(1)).alias("n"))
    begin = counts.select("range", "cell", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("range", "cell")) - F.col("n")).alias("begin"))
    return placed.join(F.broadcast(begin), ["range", "cell", "shard"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("begin") + F.col("nth") - 1).cast("long").alias("slot")
    )


def op6_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of nearly equal bytes."""
    out = shard_by_splitters(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
