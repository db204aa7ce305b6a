"""Sharding by sampled splitters, with DataFrame functions only.

Records are ordered by (hash of the text, doc_id), so copies of a text are neighbours.  Keys are
sampled with a chance in proportion to their size; quantiles of the sample are the splitters of
many ranges, whose true bytes are then counted.  A range beyond its share is subdivided by a
hash of doc_id and of a number that each row has, so copies of one text, and of one row, are parted.  Shards are cut at equal
shares of the running total of bytes over the units (ranges or their parts), and within a unit
between texts, so that copies stay together unless there are too many of them.

There is a range for about every ``range_rows`` rows, 512 at least and ``most_ranges`` at most, which
bounds what the driver sees: the splitters and one row per unit.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.llm.common import durable


def sizes(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = F.encode(text, "UTF-8")
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(text).alias("_key"))


def _table(spark: SparkSession, rows: list[tuple], kind: str) -> DataFrame:
    """A small table as a constant of the plan."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([[str(x) for x in r] for r in rows])), "array<array<string>>")).alias("r")).select(*[F.col("r")[i].cast(k).alias(n) for i, (n, k) in enumerate(x.split() for x in kind.split(", "))])


def _ranged(keyed: DataFrame, cuts: list[int]) -> DataFrame:
    """Adds ``_range``, the number of splitters below or equal to the key.

    Ranges are looked up by the key's upper bits: a range is listed under each value of them that it reaches into.
    """
    shift = 64 - max(4, len(cuts).bit_length() + 2)
    ends = [-(1 << 63), *cuts, (1 << 63) - 1]
    ranges = _table(keyed.sparkSession, [(i, a, b) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:]))], "_range int, _lo bigint, _hi bigint")
    listed = ranges.withColumn("_top", F.explode(F.sequence(F.shiftright("_lo", shift), F.shiftright("_hi", shift))))
    last = F.col("_range") == len(cuts)
    inside = (F.col("_key") >= F.col("_lo")) & ((F.col("_key") < F.col("_hi")) | last)
    # At most five rows for each range, whose number is bounded.
    return keyed.withColumn("_top", F.shiftright("_key", shift)).join(F.broadcast(listed), "_top").where(inside).drop("_top", "_lo", "_hi")


def splitters(keyed: DataFrame, total: int, ranges: int, sample: int) -> list[int]:
    """Quantiles of a sample of about ``sample`` keys, drawn with a chance in proportion to size."""
    chance = F.col("size") * F.lit(sample / max(total, 1))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = keyed.where(draw < chance).select("_key", F.greatest(chance, F.lit(1.0)).alias("w")).collect()
    rows = sorted((r["_key"], r["w"]) for r in drawn)
    out, run, share = [], 0.0, sum(w for _, w in rows) / ranges
    for key, w in rows:
        if run >= share * (len(out) + 1) and (not out or out[-1] < key) and len(out) < ranges - 1:
            out.append(key)
        run += w
    return out


def shard(docs: DataFrame, shards: int = 8, *, range_rows: int = 1_000_000, most_ranges: int = 1 << 15, keys_a_range: int = 16) -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Shards hold near equal bytes (text and one more for each record): a cut misses an equal share by
    half the bytes of one text's copies in a unit at most, and so by half a unit at most.  Null texts count as empty.  Slots number a shard's rows from 0 in the order of
    (text hash, doc_id), without gaps, so copies of a text are neighbours; repeated rows each get a slot.
    No rows give no rows.  Other columns are dropped.
    """
    spark = docs.sparkSession
    keyed = durable(sizes(docs).withColumn("_number", F.monotonically_increasing_id()))  # a row's number is fixed once written
    whole = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    total, ranges = whole["n"], min(most_ranges, max(512, -(-whole["rows"] // range_rows)))
    ranged = _ranged(keyed, splitters(keyed, total, ranges, keys_a_range * ranges))
    # Ranges beyond twice their share are subdivided.
    share = max(1, total // ranges)
    heavy = [(r["_range"], -(-r["bytes"] // share)) for r in ranged.groupBy("_range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > 2 * share).collect()]
    parts = F.broadcast(_table(spark, heavy or [(-1, 1)], "_range int, _parts bigint"))
    part = F.pmod(F.xxhash64("doc_id", "_number", F.lit("part")), F.coalesce("_parts", F.lit(1).cast("long")))
    ranged = ranged.join(parts, "_range", "left").withColumn("_part", part.cast("int")).drop("_parts")
    units = sorted((r["_range"], r["_part"], r["bytes"], r["rows"]) for r in ranged.groupBy("_range", "_part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect())
    # Where each unit begins, in bytes and in rows; one row for each unit: bounded by `ranges`.
    placed, at, row = [], 0, 0
    for r, p, n_bytes, n_rows in units:
        placed.append((r, p, at, row))
        at, row = at + n_bytes, row + n_rows
    where = _table(spark, placed or [(-1, 0, 0, 0)], "_range int, _part int, _bytes bigint, _first bigint")
    unit = Window.partitionBy("_range", "_part")
    numbered = ranged.withColumns({"_row": F.row_number().over(unit.orderBy("_key", "doc_id", "_number")), "_end": F.sum("size").over(unit.orderBy("_key")), "_group": F.sum("size").over(Window.partitionBy("_range", "_part", "_key"))})
    numbered = numbered.join(F.broadcast(where), ["_range", "_part"])
    # A text's copies in a unit go where the middle of their bytes lies.
    middle = F.col("_bytes") + F.col("_end") - F.col("_group") / 2
    numbered = numbered.withColumn("shard", F.least(F.floor(middle * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int")).withColumn("_index", F.col("_first") + F.col("_row") - 1)
    numbered = durable(numbered.select("doc_id", "size", "text_crc32", "shard", "_index"))
    first = numbered.groupBy("shard").agg(F.min("_index").alias("_shard_first"))
    slotted = numbered.join(F.broadcast(first), "shard")  # a row for each shard
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_index") - F.col("_shard_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
