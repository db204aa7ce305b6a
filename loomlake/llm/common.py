"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.storage import durable, new_folder

__all__ = ["BitSet", "bit_set", "bounded", "durable", "fresh", "new_folder", "packs", "partitions", "ranked", "ship_code", "stored", "table", "tidy", "utf8"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts in an Arrow batch: the default of 10,000 can be tens of MB in the JVM and again in Python, and large buffers
#: that come and go leave holes in the memory of both.
BATCH_ROWS = 256


#: Settings of Python workers, which Spark uses again for task after task.  Arrays of 8 MB or more go back to the
#: system when they are freed, and so does what is free at the end of the heap; by glibc's defaults workers keep most of it.
MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(8 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


#: Applications that have the package.
_SHIPPED: set[str] = set()


def archive() -> str:
    """The package's modules in a zip file in a folder of the driver's own."""
    package = Path(__file__).resolve().parents[1]
    path = f"{tempfile.mkdtemp(prefix='loomlake-')}/{package.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, str(module.relative_to(package.parent)))
    return path


def ship_code(spark: SparkSession, lean: bool = False) -> None:
    """Prepares the session: workers get this package, and Arrow batches of texts are small.

    The package goes to the executors as an archive that the driver serves, so they need no copy of this folder.  A batch size
    that is already smaller stays.  ``lean`` workers start with ``MEMORY``, which costs up to a quarter
    more CPU time where many small objects come and go (as in tokenizing).
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context, env = spark.sparkContext, spark.sparkContext.environment
    if context.applicationId not in _SHIPPED:
        context.addPyFile(archive())
        _SHIPPED.add(context.applicationId)
    if lean:
        for name, value in MEMORY.items():
            env.setdefault(name, value)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives freed memory back to the system at the end of its task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def packs(texts: list[bytes | None], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Slices of consecutive texts of about ``most`` bytes, so that arrays made for a slice stay small."""
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t or b"")
        if total >= most:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Fewest and most places of a bit set that stands for a set of keys: 8 MB when packed, 2 million rows on the driver.
FEWEST_PLACES, MOST_PLACES = 1 << 16, 1 << 26


@dataclass
class BitSet:
    """A set of keys as bits at hashed places: every key is in, and of others about the share of places that are set.

    There are 16 places for each key or more, up to ``MOST_PLACES``; beyond about 10**7 keys the set lets more and more
    of the others pass.  It only spares a shuffle what surely isn't wanted; the joins behind it decide.
    """

    bits: np.ndarray
    places: int

    def place(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.places))

    def has(self, places: pa.Array) -> np.ndarray:
        x = places.to_numpy(zero_copy_only=False).astype(np.int64)
        return self.bits[x >> 3] >> (x & 7).astype(np.uint8) & 1


def bit_set(keys: DataFrame, key: str) -> BitSet:
    wanted = 16 * keys.count()
    places = FEWEST_PLACES
    while places < min(wanted, MOST_PLACES):
        places *= 2
    h = keys.select(F.pmod(F.xxhash64(key), F.lit(places)).alias("h")).selectExpr("h div 32 as w", "shiftleft(1L, cast(h % 32 as int)) as b")
    rows = h.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    words = np.zeros(places // 32, np.uint32)
    words[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).astype(np.uint32)
    return BitSet(words.view(np.uint8), places)


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written as Parquet to the shared folder and read again: its lineage is cut and columns are read as needed."""
    spark = df.sparkSession
    df.write.parquet(path := new_folder(spark, name))
    return spark.read.parquet(path)


#: Rows of a table that is broadcast at most, where nothing else bounds it.
MOST_BROADCAST = 4096


def bounded(df: DataFrame, rows: int, most: int = MOST_BROADCAST) -> DataFrame:
    """A table with so many (short) rows, marked for broadcast if they are few; otherwise its joins shuffle."""
    return F.broadcast(df) if rows <= most else df


def ranked(df: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """Adds the rows' places (from 0) in an order over the whole table, which no single task has to see.

    Rows are range-partitioned and sorted within parts; a part's rows go on where those before it end.  Of equal rows any
    may come first, but the table is written once, so places don't change.
    """
    # The id has the part in its upper bits and the place within the part in the lower 33.
    dealt = stored(df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order).withColumn(rank, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(rank, 33).alias("_part")
    # One row for each part.
    ends = dealt.groupBy(part).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    placed = dealt.withColumn("_part", F.shiftright(rank, 33)).join(F.broadcast(ends), "_part")
    return placed.withColumn(rank, F.col("_before") + F.col(rank).bitwiseAND((1 << 33) - 1)).drop("_part", "_before")
