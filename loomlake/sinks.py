"""Tables that batches are written into by key, each batch once however often it is sent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from loomlake.storage import discard, make_folder, move, names

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """A Parquet table in ``buckets`` folders by a hash of the key; a batch rewrites the folders of its keys and no others.

    A batch is first written whole to a folder of its own, then its buckets take the old ones' places, and last it is noted
    in the ledger.  A batch that is noted does nothing when it is sent again; one that was cut off while its buckets
    were put in place is finished from what it had written; before that, it has changed nothing.  Batch numbers of a ``source``
    (a stream, a job) have to grow, and a table has one writer at a time.  The number of buckets bounds what the driver
    sees; it stays as it was when the table was made.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        make_folder(spark, f"{path}/data")

    def rows(self) -> DataFrame:
        return self._all().select(*self.schema.names)

    def _all(self) -> DataFrame:
        whole = StructType([*self.schema.fields]).add("_bucket", LongType()).add("_batch", LongType())
        return self.spark.read.schema(whole).parquet(f"{self.path}/data")

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets))

    def applied(self, source: str = "main") -> int:
        """The last batch of a source that is noted, -1 if there is none."""
        return max(map(int, names(self.spark, f"{self.path}/ledger/{source}")), default=-1)

    def upsert(self, batch: int, changes: DataFrame, merge: Merge, source: str = "main") -> bool:
        """Rewrites the buckets of the changes' keys: ``merge`` gives their rows after, from those before and the changes.

        False if the batch had been applied before.
        """
        return self._write(batch, changes, merge, source, False)

    def insert(self, batch: int, rows: DataFrame, source: str = "main") -> bool:
        """Adds the rows whose key is new, one for each key, beside what the buckets hold; nothing is rewritten."""
        once = rows.select(*self.schema.names).dropDuplicates(self.key)
        return self._write(batch, once, lambda old, new: new.join(old.select(*self.key), self.key, "left_anti"), source, True)

    def _write(self, batch: int, changes: DataFrame, merge: Merge, source: str, beside: bool) -> bool:
        self._finish()
        if batch <= self.applied(source):
            return False
        keyed = changes.withColumn("_bucket", self._bucket()).persist()
        try:
            touched = sorted(r["_bucket"] for r in keyed.select("_bucket").distinct().collect())
            old = self._all().where(F.col("_bucket").isin(touched) if touched else F.lit(False)).select(*self.schema.names)
            after = merge(old, keyed.drop("_bucket")).select(*self.schema.names).withColumn("_bucket", self._bucket())
            whole = f"{self.path}/staged/{source}/{batch}"
            discard(self.spark, f"{self.path}/staged/{source}")
            after.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{whole}/data")
        finally:
            keyed.unpersist()
        if not beside:
            # Buckets that the batch has emptied.
            filled = names(self.spark, f"{whole}/data")
            for b in touched:
                if f"_bucket={b}" not in filled:
                    make_folder(self.spark, f"{whole}/gone/_bucket={b}")
        make_folder(self.spark, f"{whole}/{'beside' if beside else 'instead'}")  # from here on the batch is complete
        self._finish()
        return True

    def _finish(self) -> None:
        """Puts complete batches in place.  Every step may be done again, and so may the whole."""
        for source in names(self.spark, f"{self.path}/staged"):
            for batch in names(self.spark, f"{self.path}/staged/{source}"):
                whole = f"{self.path}/staged/{source}/{batch}"
                kinds = names(self.spark, whole)
                if "beside" not in kinds and "instead" not in kinds:
                    continue
                for bucket in names(self.spark, f"{whole}/gone"):
                    discard(self.spark, f"{self.path}/data/{bucket}")
                for bucket in names(self.spark, f"{whole}/data"):
                    if bucket.startswith("_bucket="):
                        place = f"{self.path}/data/{bucket}" + (f"/_batch={batch}" if "beside" in kinds else "")
                        discard(self.spark, place)
                        move(self.spark, f"{whole}/data/{bucket}", place if "beside" in kinds else f"{place}/_batch={batch}")
                make_folder(self.spark, f"{self.path}/ledger/{source}/{batch}")
                for done in names(self.spark, f"{self.path}/ledger/{source}"):
                    if int(done) < int(batch):
                        discard(self.spark, f"{self.path}/ledger/{source}/{done}")
                discard(self.spark, f"{self.path}/staged/{source}")


def newest(key: list[str], order: list[str]) -> Merge:
    """Of each key the row with the largest ``order`` stays, be it old or new; a change wins over an old row of equal order."""

    def merge(old: DataFrame, changes: DataFrame) -> DataFrame:
        both = old.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
        n = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order], F.desc("_new")))
        return both.withColumn("_n", n).where("_n = 1").drop("_n", "_new")

    return merge


def newest_set(key: list[str], order: str) -> Merge:
    """All rows of a key are one set: of each key those with the largest ``order`` stay; sets sent again take the old ones' place."""

    def merge(old: DataFrame, changes: DataFrame) -> DataFrame:
        both = old.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
        last = both.groupBy(*key).agg(F.max(F.struct(order, "_new")).alias("_last"))
        named = both.join(last, key)
        return named.where((F.col(order).eqNullSafe(F.col(f"_last.{order}"))) & (F.col("_new") == F.col("_last._new"))).drop("_last", "_new")

    return merge


def summed(key: list[str], totals: dict[str, str]) -> Merge:
    """Rows of a key become one; ``totals`` names the aggregate function of each other column."""

    def merge(old: DataFrame, changes: DataFrame) -> DataFrame:
        both = old.unionByName(changes.select(*old.columns))
        return both.groupBy(*key).agg(*[F.expr(f"{f}({c})").alias(c) for c, f in totals.items()])

    return merge
