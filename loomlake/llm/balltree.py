"""Exact top-k inner-product search by ball trees.

Vectors are dealt into shards by locality, on two levels: each goes to the nearest of a bounded number of centres, which
come from a bounded sample of all rows, and where such a cell holds many rows, to the nearest of the cell's own centres, which
tasks make from a sample of the cell.  Neighbouring parts of a cell fill shards of bounded size.
One task builds a ball tree for each shard.  The stated queries are dealt into blocks in the same way.

A block first searches one shard of its own place, and so has k-th scores to start with.  A block and a ball can meet at most
in the inner product that both balls allow.  So blocks are held against the balls of whole cells, and meet the shards only of
cells whose bound reaches the least k-th score of the block; no table of all blocks by all shards is made.
The shards that reach it are ordered by their bounds and searched in waves, the most promising first.  Each wave begins with
the k-th scores that all waves before it have found: (block, shard) pairs whose bound is below the least of them
are dropped before a tree moves, and within a tree a node is opened only while its upper bound q.c + |q| r reaches the
query's current k-th score, best bound first.

Of equal vectors only the k + 1 with the smallest ids can be in a result, so only they are indexed.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm.common import durable, partitions, tidy
from loomlake.operators.retrieval import dot

_EXACT = 1 << 53


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, dim and v = floor(scale * x) of each vector without a null or non-finite component."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(~bad).select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def build(ids: np.ndarray, v: np.ndarray, leaf: int) -> dict:
    """A ball tree: nodes in an array, children of inner nodes, and rows in the order of the leaves."""
    order = np.arange(len(ids))
    points = v.astype(float)
    centre, radius, left, lo, hi = [], [], [], [], []
    todo = [(0, len(ids))]
    nodes = []
    while todo:  # breadth first, so both children of a node are neighbours
        nxt = []
        for a, b in todo:
            rows = order[a:b]
            c = points[rows].mean(0) if b > a else np.zeros(points.shape[1])
            away = np.sqrt(((points[rows] - c) ** 2).sum(1))
            r = float(away.max()) if b > a else 0.0
            nodes.append((a, b))
            centre.append(c), radius.append(r), lo.append(a), hi.append(b)
            if b - a <= leaf or r == 0:
                left.append(-1)
                continue
            # Split at the median of the direction between two far points.
            p = points[rows[int(away.argmax())]]
            q = points[rows[int(((points[rows] - p) ** 2).sum(1).argmax())]]
            m = (b - a) // 2
            order[a:b] = rows[np.argpartition(points[rows] @ (q - p), m)]
            left.append(-2)
            nxt += [(a, a + m), (a + m, b)]
        todo = nxt
    left = np.array(left)
    inner = np.flatnonzero(left == -2)
    left[inner] = 1 + 2 * np.arange(len(inner))
    return {"ids": ids[order], "v": v[order], "c": np.array(centre), "r": np.array(radius), "left": left, "lo": np.array(lo), "hi": np.array(hi)}


#: Scores are cut to this range; the lowest number of 64 bits stands for "none".
_LAST = (1 << 63) - 1


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    fa, fb = a.astype(float), b.astype(float)
    if float(np.abs(fa).max(initial=0)) * float(np.abs(fb).max(initial=0)) * a.shape[1] < _EXACT:
        return (fa @ fb.T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -_LAST, _LAST).astype(np.int64)


_NONE = np.iinfo(np.int64).min


def search(tree: dict, qid: np.ndarray, q: np.ndarray, bar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) of each query with scores of at least ``bar``; empty places have the lowest score."""
    n = len(qid)
    score, ids = np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max)
    bar = bar.astype(float).copy()
    qf = q.astype(float)
    norm = np.sqrt((qf**2).sum(1))
    slack = 1e-9 * (1 + norm)

    def bound(i, node):
        raw = np.einsum("ij,ij->i", qf[i], tree["c"][node]) + norm[i] * tree["r"][node]
        return np.maximum(raw + slack[i] * (1 + np.abs(tree["c"][node]).max(1) + tree["r"][node]), -_LAST)

    # Down the tree, only through nodes whose bound reaches the bar.
    at, node = np.arange(n), np.zeros(n, np.int64)
    leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(at):
        ub = bound(at, node)
        ok = ub >= bar[at]
        at, node, ub = at[ok], node[ok], ub[ok]
        end = tree["left"][node] < 0
        leaves.append((at[end], node[end], ub[end]))
        at, node = np.tile(at[~end], 2), np.concatenate([tree["left"][node[~end]], tree["left"][node[~end]] + 1])
    at, node, ub = (np.concatenate([x[j] for x in leaves]) for j in range(3))
    order = np.lexsort((-ub, at))
    at, node, ub = at[order], node[order], ub[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)  # the leaf's place in its query's order
    for r in range(int(rank.max(initial=-1)) + 1):
        now = np.flatnonzero((rank == r) & (ub >= bar[at]))
        for leaf in np.unique(node[now]):
            mine = at[now[node[now] == leaf]]
            rows = slice(tree["lo"][leaf], tree["hi"][leaf])
            s = _product(q[mine], tree["v"][rows])
            s[tree["ids"][rows][None, :] == qid[mine][:, None]] = _NONE
            use = (s > _NONE) & (s >= bar[mine][:, None])
            better = use.any(1)
            if not better.any():
                continue
            mine, s = mine[better], np.where(use, s, _NONE)[better]
            both = np.concatenate([score[mine], s], 1)
            them = np.concatenate([ids[mine], np.broadcast_to(tree["ids"][rows], s.shape)], 1)
            best = np.lexsort((them, -both.astype(float) if _in_float(both) else _descending(both)), axis=-1)[:, :k]
            score[mine], ids[mine] = np.take_along_axis(both, best, 1), np.take_along_axis(them, best, 1)
            full = score[mine, k - 1]
            bar[mine] = np.where(full > _NONE, np.maximum(bar[mine], full.astype(float)), bar[mine])
    return score, ids


def _in_float(x: np.ndarray) -> bool:
    return bool((np.abs(np.where(x == _NONE, 0, x)) < _EXACT).all())


def _descending(x: np.ndarray) -> np.ndarray:
    return ~x  # order-reversing on int64, without overflow


def centres(sample: np.ndarray, most: int) -> np.ndarray:
    """About ``most`` centres of balls that hold equally many rows of a sample."""
    tree = build(np.arange(len(sample)), sample, max(1, -(-len(sample) // most)))
    return tree["c"][tree["left"] < 0]


def nearest(v: np.ndarray, middles: np.ndarray) -> np.ndarray:
    """The index of each vector's nearest centre, the first of several."""
    return ((middles**2).sum(1)[None, :] - 2 * v.astype(float) @ middles.T).argmin(1)


def _matrix(column: pa.Array) -> np.ndarray:
    """The lists of one length of an Arrow column as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _located(rows: DataFrame, middles: dict[int, np.ndarray]) -> DataFrame:
    """Adds ``cell``, the nearest centre of the row's dimension; 0 where the dimension has no centres."""
    if not middles:
        return rows.withColumn("cell", F.lit(0))
    shared = rows.sparkSession.sparkContext.broadcast(middles)
    names = [*rows.columns, "cell"]

    def run(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            cell = np.zeros(len(dims), np.int32)
            for d, c in shared.value.items():
                at = np.flatnonzero(dims == d)
                if len(at):
                    cell[at] = nearest(_matrix(batch.column(2).take(pa.array(at))), c)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names)

    return rows.mapInArrow(tidy(run), "vec_id long, dim int, v array<long>, cell int")


def _vectors(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(x, np.int64) for x in pdf["v"]])


def _inner_centres(rows: DataFrame, size: int, sample_rows: int, most: int) -> DataFrame:
    """dim, cell, inner: centres of their own for cells of more than twice ``size`` rows, from a bounded sample of each."""
    large = rows.groupBy("dim", "cell").agg(F.count("*").alias("n")).where(F.col("n") > 2 * size)
    low = F.xxhash64("vec_id", "v", F.lit("inner")) / F.lit(float(1 << 64)) + 0.5 < F.lit(float(sample_rows)) / F.col("n")

    def make(key, pdf):
        parts = int(min(most, -(-pdf["n"].iloc[0] // size)))
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "inner": [pickle.dumps(centres(_vectors(pdf.sort_values("vec_id")), parts), 5)]})

    return rows.join(large, ["dim", "cell"]).where(low).groupBy("dim", "cell").applyInPandas(make, "dim int, cell int, inner binary")


def _divided(rows: DataFrame, inner: DataFrame, size: int) -> DataFrame:
    """Adds ``sub``, the nearest of the own centres of the row's cell; 0 in cells without.

    Rows of a cell meet its centres in slices of about ``size`` rows, so neither a cell nor the centres go through one task.
    """
    keys = inner.select("dim", "cell")
    slices = rows.join(keys, ["dim", "cell"], "left_semi").groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(size)).alias("slices"))
    left = rows.join(slices, ["dim", "cell"]).withColumn("slice", F.pmod(F.xxhash64("vec_id", "v", F.lit("slice")), F.col("slices")))
    right = inner.join(slices, ["dim", "cell"]).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    right = right.select(F.col("dim").alias("d"), F.col("cell").alias("c"), F.col("slice").alias("s"), "inner")

    def place(mine, theirs):
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"vec_id": [], "dim": [], "v": [], "cell": [], "sub": []})
        return mine[["vec_id", "dim", "v", "cell"]].assign(sub=nearest(_vectors(mine), pickle.loads(theirs["inner"].iloc[0])))

    placed = left.groupBy("dim", "cell", "slice").cogroup(right.groupBy("d", "c", "s")).applyInPandas(place, "vec_id long, dim int, v array<long>, cell int, sub int")
    plain = rows.join(keys, ["dim", "cell"], "left_anti").select("vec_id", "dim", "v", "cell", F.lit(0).alias("sub"))
    return placed.unionByName(plain)


def _number(part) -> Column:
    """A shard's or block's number: its cell, the run of parts of the cell, and the part of a large one."""
    return F.shiftleft(F.col("cell").cast("long"), 48).bitwiseOR(F.shiftleft(F.col("run"), 24)).bitwiseOR(part)


def _runs(rows: DataFrame, size: int) -> DataFrame:
    """dim, cell, sub, run, parts: neighbouring parts of a cell make runs of about ``size`` rows, and one of over twice that is dealt further."""
    before = Window.partitionBy("dim", "cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)  # a row for each of a cell's centres
    counted = rows.groupBy("dim", "cell", "sub").agg(F.count("*").alias("n"))
    run = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / F.lit(size))
    return counted.select("dim", "cell", "sub", run.alias("run"), F.when(F.col("n") <= 2 * size, F.lit(1)).otherwise(F.ceil(F.col("n") / F.lit(size))).alias("parts"))


def _dealt(rows: DataFrame, runs: DataFrame, name: str) -> DataFrame:
    part = F.pmod(F.xxhash64("vec_id", "v", F.lit(name)), F.col("parts"))
    return rows.join(runs, ["dim", "cell", "sub"]).withColumn(name, _number(part)).drop("run", "parts")


def _bound() -> Column:
    """The highest inner product of a point in the ball (qc, qr) with one in the ball (c, r); the last term is for rounding."""
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    reach = dot(F.col("qc"), F.col("c")) + norm("qc") * F.col("r") + norm("c") * F.col("qr") + F.col("qr") * F.col("r")
    return F.greatest(reach + F.lit(1e-9) * (1 + (norm("qc") + F.col("qr")) * (norm("c") + F.col("r"))), F.lit(-float(_LAST)))


#: Cells go to all tasks only if their centres have fewer numbers than this (32 MB).
_BROADCAST_NUMBERS = 1 << 22
#: Shards of a cell that meet a block under one key.
_SHARDS_A_KEY = 256


def cell_balls(shards: DataFrame) -> DataFrame:
    """dim, cell, c, r, keys: the ball around a cell's centre that holds all its rows, and the keys its shards are dealt to."""
    return shards.groupBy("dim", "cell").agg(F.first("middle").alias("c"), F.max("far").alias("r"), F.ceil(F.count("*") / F.lit(_SHARDS_A_KEY)).alias("keys"))


def near_cells(blocks: DataFrame, cells: DataFrame, spread: int) -> DataFrame:
    """Blocks (dim, block, qc, qr, least) with each cell whose bound reaches ``least``; a null reaches everything."""
    numbers = cells.agg(F.coalesce(F.sum("dim"), F.lit(0))).first()[0]
    if numbers <= _BROADCAST_NUMBERS:
        met = blocks.join(F.broadcast(cells), "dim")
    else:  # every task of a dimension gets its cells, and a share of its blocks
        dealt = cells.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
        met = blocks.withColumn("_at", F.pmod(F.xxhash64("block"), F.lit(spread))).join(dealt, ["dim", "_at"]).drop("_at")
    return met.where(F.col("least").isNull() | (_bound() >= F.col("least"))).drop("c", "r")


def near_shards(near: DataFrame, shards: DataFrame, cells: DataFrame) -> DataFrame:
    """dim, block, shard, bound: of the cells that blocks reach, the shards that they reach."""
    dealt = shards.join(cells.select("dim", "cell", "keys"), ["dim", "cell"]).withColumn("key", F.pmod(F.xxhash64("shard"), F.col("keys"))).select("dim", "cell", "key", "shard", "c", "r")
    asked = near.withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("keys") - 1))).drop("keys")
    met = asked.join(dealt, ["dim", "cell", "key"]).select("dim", "block", "shard", "least", _bound().alias("bound"))
    return met.where("least is null or bound >= least").drop("least")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, shard_rows: int = 8192, block_rows: int = 1024, leaf: int = 128, sample_rows: int = 16_384, most_cells: int = 1024, bundle: int = 16, counts: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with other rows.

    Both inputs come from ``quantised``.  A query never meets a row with its own id; ties go to the smaller
    vec_id; a query with fewer than k other rows of its dimension gets all of them; rows of other
    dimensions have no inner product with it.  No rows or no queries give no rows.  Repeated rows (of one id and one
    vector) are one row; rows of one id with different vectors are candidates each, and as a query the id asks
    once, with the least of them.  Scores beyond 64 bits count as the highest or lowest such number.

    ``sample_rows`` bounds the rows from which the centres of all rows, and those of each large cell, are made,
    ``most_cells`` the centres of a dimension and of a cell; neither bounds what is indexed or searched.
    ``counts``, if given, is filled with the numbers of blocks, shards and cells, and of the pairs that were looked at.
    """
    kept = vectors.where("dim > 0 and vec_id is not null").select("vec_id", "dim", "v")
    same = Window.partitionBy("dim", "v").orderBy("vec_id")
    kept = kept.withColumn("_n", F.dense_rank().over(same)).where(F.col("_n") <= k + 1).drop("_n").dropDuplicates(["dim", "v", "vec_id"])
    kept = durable(kept.select("vec_id", "dim", "v"))
    asked = queries.where("dim > 0 and vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.dim", "q.v")
    n_rows = kept.count()

    # A row is in the sample if its hash is low, about sample_rows in all.
    low = F.xxhash64("vec_id", "v", F.lit("sample")) / F.lit(float(1 << 64)) + 0.5 < F.lit(sample_rows / max(n_rows, 1))
    cells = min(most_cells, -(-n_rows // shard_rows))
    sample: dict[int, list] = {}
    if cells > 1:
        for r in kept.where(low).select("dim", "v").limit(2 * sample_rows).collect():
            sample.setdefault(r["dim"], []).append(r["v"])
    middles = {d: centres(np.array(v, np.int64), cells) for d, v in sample.items()}
    shared = kept.sparkSession.sparkContext.broadcast(middles)

    def ball(v: np.ndarray) -> tuple[list[float], float]:
        c = v.astype(float).mean(0)
        return c.tolist(), float(np.sqrt(((v - c) ** 2).sum(1)).max())

    def small(v: np.ndarray) -> np.ndarray:
        return v.astype(np.int32) if np.abs(v.astype(float)).max(initial=0) < 1 << 31 else v

    def grow(key, pdf):
        pdf = pdf.sort_values("vec_id", ignore_index=True)
        v, cell = _vectors(pdf), int(pdf["cell"].iloc[0])
        tree = build(pdf["vec_id"].to_numpy(np.int64), v, leaf)
        c, r = ball(v)
        middle = shared.value[key[0]][cell] if key[0] in shared.value else np.zeros(v.shape[1])
        far = float(np.sqrt(((v - middle) ** 2).sum(1)).max())
        return pd.DataFrame({"dim": [key[0]], "cell": [cell], "shard": [key[1]], "tree": [pickle.dumps(tree | {"v": small(tree["v"])}, 5)], "c": [c], "r": [r], "middle": [middle.tolist()], "far": [far]})

    def gather(key, pdf):
        v = _vectors(pdf)
        c, r = ball(v)
        place = {"cell": [int(pdf["cell"].iloc[0])], "sub": [int(pdf["sub"].mode().iloc[0])]}
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], **place, "queries": [pickle.dumps((pdf["vec_id"].to_numpy(np.int64), small(v)), 5)], "qc": [c], "qr": [r], "asking": [len(v)]})

    kept, asked = (durable(_located(rows, middles)) for rows in (kept, asked))
    inner = durable(_inner_centres(kept, shard_rows, sample_rows, most_cells))
    if inner.isEmpty():
        kept, asked = (rows.withColumn("sub", F.lit(0)) for rows in (kept, asked))
    else:
        kept, asked = (durable(_divided(rows, inner, 2 * shard_rows)) for rows in (kept, asked))
    homes = durable(_runs(kept, shard_rows))
    trees = durable(_dealt(kept, homes, "shard").groupBy("dim", "shard").applyInPandas(grow, "dim int, cell int, shard long, tree binary, c array<double>, r double, middle array<double>, far double"))
    blocks = durable(_dealt(asked, _runs(asked, block_rows), "block").groupBy("dim", "block").applyInPandas(gather, "dim int, block long, cell int, sub int, queries binary, qc array<double>, qr double, asking long"))
    n_blocks = blocks.count()
    bundles = max(1, -(-n_blocks // bundle))
    found = "dim int, block long, query_id long, vec_id long, score long"

    def meet(tree_side, block_side):
        parts = []
        if len(tree_side) and len(block_side):
            tree = pickle.loads(tree_side["tree"].iloc[0])
            for d, b, asked_, bars in zip(block_side["d"], block_side["b"], block_side["queries"], block_side["bars"]):
                qid, q = pickle.loads(asked_)
                kth = {} if bars is None else dict(zip(*pickle.loads(bars)))
                bar = np.array([kth.get(i, -np.inf) for i in qid.tolist()], float)
                score, ids = search(tree, qid, q.astype(np.int64), bar, k)
                i, j = np.nonzero(score > _NONE)
                parts.append(pd.DataFrame({"dim": int(d), "block": int(b), "query_id": qid[i], "vec_id": ids[i, j], "score": score[i, j]}))
        return pd.concat(parts) if parts else pd.DataFrame({"dim": [], "block": [], "query_id": [], "vec_id": [], "score": []})

    def wave(now: DataFrame, bars: DataFrame | None) -> DataFrame:
        """Searches (dim, block, shard) pairs; a group is one tree and a bundle of blocks, so queries move and trees hardly do."""
        now = now.withColumn("bundle", F.pmod(F.xxhash64("block"), F.lit(bundles)))
        right = now.join(blocks.select("dim", "block", "queries"), ["dim", "block"])
        right = right.join(bars, ["dim", "block"], "left") if bars is not None else right.withColumn("bars", F.lit(None).cast("binary"))
        right = right.select(F.col("dim").alias("d"), F.col("shard").alias("s"), F.col("bundle").alias("u"), F.col("block").alias("b"), "queries", "bars")
        left = now.select("dim", "shard", "bundle").distinct().join(trees.select("dim", "shard", "tree"), ["dim", "shard"])
        return left.groupBy("dim", "shard", "bundle").cogroup(right.groupBy("d", "s", "u")).applyInPandas(meet, found)

    def bar(key, pdf):
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "bars": [pickle.dumps((pdf["query_id"].tolist(), pdf["score"].tolist()), 5)]})

    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def best_of(every: DataFrame) -> DataFrame:
        return durable(every.withColumn("rank", ranked).where(F.col("rank") <= k))

    def standing() -> DataFrame:
        """The least k-th score of each block whose queries all have k scores; only such a block can pass over a shard."""
        full = best.where(F.col("rank") == k).groupBy("dim", "block").agg(F.count("*").alias("full"), F.min("score").alias("least"))
        return full.join(blocks.select("dim", "block", "asking"), ["dim", "block"]).where("full = asking").select("dim", "block", "least")

    # Each block first searches a shard of its own place.
    own = durable(blocks.join(homes, ["dim", "cell", "sub"]).select("dim", "block", _number(F.pmod(F.xxhash64("block"), F.col("parts"))).alias("shard")))
    best = best_of(wave(own, None))
    shards = trees.drop("tree")
    balls = durable(cell_balls(shards))
    near = near_cells(blocks.select("dim", "block", "qc", "qr").join(standing(), ["dim", "block"], "left"), balls, partitions(blocks))
    if counts is not None:
        counts |= {"blocks": n_blocks, "shards": shards.count(), "cells": balls.count(), "block_cell_pairs": near.count(), "searched": own.count()}
    pairs = near_shards(near, shards, balls).join(own, ["dim", "block", "shard"], "left_anti")
    pairs = durable(pairs.withColumn("n", F.row_number().over(Window.partitionBy("dim", "block").orderBy(F.desc("bound"), "shard"))))
    most = pairs.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    if counts is not None:
        counts["block_shard_pairs"] = pairs.count()

    at, step = 0, 4
    while at < most:
        bars = durable(best.where(F.col("rank") == k).groupBy("dim", "block").applyInPandas(bar, "dim int, block long, bars binary"))
        now = pairs.where((F.col("n") > at) & (F.col("n") <= at + step)).join(standing(), ["dim", "block"], "left").where("least is null or bound >= least").drop("least")
        if counts is not None:
            counts["searched"] += now.count()
        best = best_of(wave(now.select("dim", "block", "shard"), bars).unionByName(best.drop("rank")))
        at, step = at + step, step * 4
    return best.select("query_id", "rank", "vec_id", "score")
