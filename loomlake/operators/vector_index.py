"""An index of vectors by cells: k-means centres, items by the cell of their nearest centre, and searches of near cells only."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlake.operators.retrieval import dot, top_k, unit
from loomlake.storage import durable, new_folder

#: Rows that the centres are fitted on at most; every row is in the index.
SAMPLE = 16_384
#: Cells at most; beyond some million items they grow larger instead of more.
MOST_CELLS = 1024
#: Items of a tenant that are searched for exactly, to see how many of its cells a search needs, and the share of their results that it has to find.
TRIALS, WANTED = 64, 0.95


@dataclass
class CellIndex:
    """``items``: tenant columns, ``cell``, key and unit vector ``_x``; ``sizes``: of each tenant's cells the items, the farthest one's distance
    from the centre, and the share of the tenant that a search reads; ``centres`` by cell."""

    items: DataFrame
    sizes: DataFrame
    centres: list[list[float]]
    tenant: list[str]
    key: str

    def search(self, queries: DataFrame, k: int = 5, share: float | None = None, least: int = 128, digits: int = 6) -> DataFrame:
        """The nearest items of the same tenant among those in the nearest cells: the queries' columns, key, score = (1 + cos) / 2, rank.

        Cells are taken in the order of their centres until they hold ``share`` of the tenant's items (unless given, as many as trials
        needed when the index was built), ``least`` at least.
        ``queries``: query_id, the tenant's columns, embedding.  Queries with a null or zero vector find nothing.
        """
        probes = self.probes(queries, share, least)
        scored = probes.join(self.items, [*self.tenant, "cell"]).withColumn("score", F.round((F.lit(1.0) + dot(F.col("_q"), F.col("_x"))) / 2, digits))
        n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), self.key))
        return scored.drop("_q", "_x", "cell").withColumn("rank", n).where(F.col("rank") <= k)

    def search_exactly(self, queries: DataFrame, k: int = 5, share: float | None = 0.1, least: int = 128, digits: int = 6) -> DataFrame:
        """``search``, and what its cells leave open searched whole: the result is exact.

        A query is done if no cell that it passed over reaches near enough (by its centre and farthest item) for a place among the first ``k``;
        the others meet all items of their tenant.
        """
        found = durable(self.search(queries, k, share, least, digits))
        had = found.groupBy("query_id").agg(F.count("*").alias("_had"), F.min("score").alias("_least"))
        away = F.greatest(F.lit(0.0), F.sqrt(F.greatest(F.lit(0.0), 1 - 2 * F.col("_near"))) - F.col("_radius"))
        passed = self._looked(queries, share, least).where("not _read").groupBy("query_id").agg(F.max(1 - away * away / 4).alias("_most"))
        # The bound is of unrounded scores.
        unsure = (F.coalesce("_had", F.lit(0)) < k) | (F.col("_most") + 2 * 10.0**-digits >= F.col("_least"))
        left = durable(passed.join(had, "query_id", "left").where(unsure).select("query_id"))
        whole = top_k(queries.join(left, "query_id", "left_semi"), self.items.drop("cell").withColumnRenamed("_x", "embedding"), self.tenant, k, self.key, digits)
        return found.join(left, "query_id", "left_anti").unionByName(whole)

    def _looked(self, queries: DataFrame, share: float | None, least: int) -> DataFrame:
        """A row for each query and cell of its tenant, of which there are at most so many as centres, and whether the cell is read."""
        centres = literal(self.centres)
        q = queries.withColumn("_q", unit(F.col("embedding"))).where("_q is not null").drop("embedding")
        near = q.withColumn("_near", F.transform(centres, lambda c: dot(F.col("_q"), c) - dot(c, c) / 2))
        cells = near.join(self.sizes, self.tenant).withColumn("_near", F.get("_near", F.col("cell")))
        mine = Window.partitionBy("query_id")
        nearer = mine.orderBy(F.desc("_near"), "cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumns({"_before": F.coalesce(F.sum("_n").over(nearer), F.lit(0)), "_all": F.sum("_n").over(mine)})
        return cells.withColumn("_read", F.col("_before") < F.greatest(F.lit(least), F.col("_all") * (F.col("_share") if share is None else F.lit(share))))

    def probes(self, queries: DataFrame, share: float | None, least: int) -> DataFrame:
        """The cells that each query looks into: its columns with the unit vector ``_q``, and ``cell``."""
        return self._looked(queries, share, least).where("_read").drop("_near", "_n", "_before", "_all", "_radius", "_share", "_read")

    def read_share(self, queries: DataFrame, share: float | None = None, least: int = 128) -> DataFrame:
        """Of each tenant, the share of its (query, item) pairs whose vectors a search reads: tenant columns, scored_share."""
        sizes = self.probes(queries, share, least).join(self.sizes, [*self.tenant, "cell"]).groupBy(*self.tenant).agg(F.sum("_n").alias("_read"), F.countDistinct("query_id").alias("_q"))
        whole = self.sizes.groupBy(*self.tenant).agg(F.sum("_n").alias("_items"))
        return sizes.join(whole, self.tenant).select(*self.tenant, (F.col("_read") / (F.col("_q") * F.col("_items"))).alias("scored_share"))

    def _needed(self, k: int = 5) -> DataFrame:
        """Of each tenant, the share of its items in the cells that ``WANTED`` of the nearest neighbours of ``TRIALS`` items lie in: tenant columns, _share."""
        nth = F.row_number().over(Window.partitionBy(*self.tenant).orderBy(F.xxhash64(self.key), self.key))
        drawn = durable(self.items.withColumn("_nth", nth).where(F.col("_nth") <= TRIALS).select(*self.tenant, F.col(self.key).alias("query_id"), F.col("_x").alias("embedding")))
        near = top_k(drawn, self.items.drop("cell").withColumnRenamed("_x", "embedding"), self.tenant, k + 1, self.key).where(F.col(self.key) != F.col("query_id"))
        there = near.select(*self.tenant, "query_id", self.key).join(self.items.select(*self.tenant, self.key, "cell"), [*self.tenant, self.key])
        looked = self._looked(drawn, 1.0, 1).select(*self.tenant, "query_id", "cell", ((F.col("_before") + 1) / F.col("_all")).alias("_part"))
        return there.join(looked, [*self.tenant, "query_id", "cell"]).groupBy(*self.tenant).agg(F.percentile("_part", F.lit(WANTED)).alias("_share"))


def literal(centres: list[list[float]]):
    return F.from_json(F.lit(json.dumps([[round(x, 6) for x in c] for c in centres])), "array<array<double>>")


def build_index(items: DataFrame, tenant: list[str], key: str = "id", path: str | None = None, cells: int | None = None, seed: int = 1) -> CellIndex:
    """Fits centres on at most ``SAMPLE`` rows, and writes every item with its cell.

    There is a cell for every eight items, up to ``MOST_CELLS``, unless a number is given.  Null and zero
    vectors, and those of another length than the longest, are left out, as no search could find them.
    """
    spark = items.sparkSession
    x = items.select(*tenant, key, unit(F.col("embedding")).alias("_x")).where("_x is not null")
    seen = x.agg(F.count("*").alias("n"), F.max(F.size("_x")).alias("d")).first()
    n, d = seen["n"], seen["d"] or 1
    path = path or new_folder(spark, "vector-index")
    x = x.where(F.size("_x") == d).withColumn("_v", array_to_vector("_x"))
    k = max(1, min(cells or n // 8, MOST_CELLS, n))
    if k > 1:
        drawn = x.orderBy(F.xxhash64(key, F.lit(seed))).limit(SAMPLE) if n > SAMPLE else x
        fitted = KMeans(k=k, featuresCol="_v", predictionCol="cell", initMode="random", maxIter=5, seed=seed).fit(drawn.select("_v"))
        centres, placed = [c.tolist() for c in fitted.clusterCenters()], fitted.transform(x)
    else:
        centres, placed = [[0.0] * d], x.withColumn("cell", F.lit(0))
    placed.drop("_v").repartition(*tenant, "cell").sortWithinPartitions(*tenant, "cell").write.mode("overwrite").parquet(f"{path}/items")
    stored = spark.read.parquet(f"{path}/items")
    mids = spark.createDataFrame(list(enumerate([[round(x, 6) for x in c] for c in centres])), "cell int, _mid array<double>")
    mid = F.col("_mid")
    apart = F.sqrt(F.greatest(F.lit(0.0), 1 - 2 * dot(F.col("_x"), mid) + dot(mid, mid)))
    stored.join(mids, "cell").groupBy(*tenant, "cell").agg(F.count("*").alias("_n"), F.max(apart).alias("_radius")).write.mode("overwrite").parquet(f"{path}/sizes")
    index = CellIndex(stored, spark.read.parquet(f"{path}/sizes").withColumn("_share", F.lit(1.0)), centres, tenant, key)
    index._needed().write.mode("overwrite").parquet(f"{path}/shares")
    sizes = index.sizes.drop("_share").join(spark.read.parquet(f"{path}/shares"), tenant, "left").withColumn("_share", F.coalesce("_share", F.lit(1.0)))
    return CellIndex(stored, sizes, centres, tenant, key)
