"""Best-fit packing of token sequences, bulk-synchronously.

Documents and the gaps of open sequences are range-sorted by size.  As sizes are whole numbers up
to the capacity, both are kept as runs (size, first rank, count): a size that a third of all
documents have is one run, and the state is at most a few thousand rows per round whatever the
corpus.  In a round every range of sizes is swept by a task of its own: each gap meets its
predecessor, the largest free document that fits (so each document meets the smallest gap that is
its successor).  Where several documents want the gaps of one run, the k-th of them by rank gets the
k-th gap; then the range's gaps are updated and it is swept again, until nothing in it fits any more.  What
the ranges leave over is swept in the same way together.  When nothing fits at all, as many sequences open as
the remaining tokens need at least, and the next round starts.  Each round's result is checkpointed.

Documents themselves are ranked within their length (salted by their number, so a common length is many
window groups of bounded size) and joined with the runs by (length, block of ranks).
"""

from __future__ import annotations

import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm.common import durable, packs, partitions, tidy, utf8
from loomlake.llm.tokens import word_ends

ITEM, GAP, UPDATED, PLACED = 0, 1, 2, 3
#: kind; size of items or gaps; first rank or sequence; how many; only for placed: items a sequence, first sequence, offset.
_STATE = "kind int, size int, lo long, n long, copies int, seq long, offset int"
_NAMES = ["kind", "size", "lo", "n", "copies", "seq", "offset"]


def sweep(rows: list[tuple], capacity: int) -> list[tuple]:
    """One sweep over runs of items and gaps, smallest first; returns placed runs, updated gaps and what is left."""
    free: list[list[int]] = []  # runs of items without a gap, the largest last
    out: list[tuple] = []
    for size, kind, lo, n in sorted((r[1], r[0], r[2], r[3]) for r in rows if r[0] in (ITEM, GAP)):
        if kind == ITEM:
            free.append([size, lo, n])
            continue
        while n and free:
            item = free[-1]
            copies = max(1, min(size // item[0], item[2] // n))
            used = min(n, item[2] // copies)
            out.append((PLACED, item[0], item[1], used * copies, copies, lo, capacity - size))
            if size > copies * item[0]:
                out.append((UPDATED, size - copies * item[0], lo, used, None, None, None))
            item[1] += used * copies
            item[2] -= used * copies
            lo, n = lo + used, n - used
            if not item[2]:
                free.pop()
        if n:
            out.append((GAP, size, lo, n, None, None, None))
    return out + [(ITEM, *r, None, None, None) for r in free]


def settled(rows: list[tuple], capacity: int) -> list[tuple]:
    """Sweeps until no gap takes an item any more; an updated gap takes part in the next sweep."""
    out: list[tuple] = []
    while True:
        swept = sweep(rows, capacity)
        placed = [r for r in swept if r[0] == PLACED]
        out += placed
        rows = [(GAP, *r[1:]) if r[0] == UPDATED else r for r in swept if r[0] != PLACED]
        if not placed:
            return out + rows


def _swept(state: DataFrame, key, capacity: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(*(pdf[c].tolist() for c in ("kind", "size", "lo", "n"))))
        return pd.DataFrame(settled(rows, capacity), columns=_NAMES).astype({"copies": "Int32", "seq": "Int64", "offset": "Int32"})

    todo = state.where(F.col("kind") <= GAP)
    return todo.groupBy(key.alias("_range")).applyInPandas(run, _STATE).unionAll(state.where(F.col("kind") > GAP))


def plan_runs(counts: DataFrame, capacity: int, ranges: int = 8) -> DataFrame:
    """Placed runs for ``counts(size, n)``: items lo .. lo+n-1 of a size go to sequences from seq on, ``copies`` each."""
    items = counts.select(F.lit(ITEM).alias("kind"), F.col("size").cast("int"), F.lit(0).cast("long").alias("lo"), F.col("n").cast("long"), F.lit(None).cast("int").alias("copies"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("int").alias("offset"))
    spark, opened, before = counts.sparkSession, 0, None
    state = durable(items)
    while True:
        left = state.where(F.col("kind") == ITEM).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("tokens"), F.min("size").alias("least"), F.coalesce(F.sum(F.when(F.col("size") * 2 > capacity, F.col("n"))), F.lit(0)).alias("large")).first()
        if not left["n"]:
            return state.where(F.col("kind") == PLACED).drop("kind")
        state = state.where((F.col("kind") != GAP) | (F.col("size") >= left["least"]))
        if before in (None, left["n"]):  # nothing fits: open what the rest needs at least
            more = max(-(-left["tokens"] // capacity), left["large"])
            gap = [F.lit(GAP), F.lit(capacity), F.lit(opened).cast("long"), F.lit(more).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("int")]
            state = state.unionAll(spark.range(1).select(*[c.alias(n) for c, n in zip(gap, _NAMES)]))
            opened += more
        before = left["n"]
        local = _swept(state, F.floor(F.col("size") * ranges / (capacity + 1)), capacity)
        whole = _swept(local, F.lit(0), capacity)
        state = durable(whole.coalesce(1))


def best_fit(pieces: DataFrame, capacity: int, *, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), group_rows: int = 1_000_000, block: int = 4096) -> DataFrame:
    """Adds sequence_id and offset: pieces of lengths 1 .. capacity in as few sequences as found, each gapless from 0.

    Sequence ids are 0, 1, ... without gaps, but for sequences opened and never used (none in practice).
    Rows with a null length or one out of range get nulls.  Equal rows are packed apart.  Columns of the
    input named sequence_id or offset are replaced.  No rows give no rows.
    """
    pieces = pieces.drop("sequence_id", "offset")
    ok = F.col(length).between(1, capacity)
    # Were all pieces of one length, a group would hold about group_rows of them.
    salts = max(32, -(-pieces.count() // group_rows))
    salted = pieces.withColumn("_salt", F.pmod(F.hash(*order), F.lit(salts)))
    by_salt = salted.where(ok).groupBy(F.col(length).alias("_len"), "_salt").agg(F.count("*").alias("_n"))
    by_salt = durable(by_salt)
    plan = plan_runs(by_salt.groupBy(F.col("_len").alias("size")).agg(F.sum("_n").alias("n")), capacity)
    ahead = Window.partitionBy("_len").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_salt.select(F.col("_len"), F.col("_salt"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    ranked = salted.withColumn("_row", F.row_number().over(Window.partitionBy(length, "_salt").orderBy(*order)))
    ranked = ranked.join(offsets, (F.col(length) == F.col("_len")) & (salted["_salt"] == offsets["_salt"]), "left").drop(offsets["_salt"]).withColumn("_rank", F.col("_ahead") + F.col("_row") - 1).drop("_ahead", "_len")
    runs = plan.select(F.col("size").alias("_size"), F.col("lo").alias("_lo"), (F.col("lo") + F.col("n")).alias("_hi"), F.col("copies").alias("_copies"), F.col("seq").alias("_seq"), F.col("offset").alias("_offset"))
    runs = runs.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_lo") / block), F.floor((F.col("_hi") - 1) / block))))
    on = (F.col(length) == F.col("_size")) & (F.floor(F.col("_rank") / block) == F.col("_block")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    x = F.col("_rank") - F.col("_lo")
    placed = ranked.join(runs, on, "left")
    return placed.withColumns({"sequence_id": F.col("_seq") + F.floor(x / F.col("_copies")), "offset": F.col("_offset").cast("long") + F.pmod(x, F.col("_copies").cast("long")) * F.col(length)}).drop("_salt", "_row", "_rank", "_size", "_lo", "_hi", "_copies", "_seq", "_offset", "_block")


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_KIND = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int = 0, keep_words: int = 1_000_000) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each whole text (null: empty) and its end id: only longer documents are cut.

    A worker keeps the ids of up to ``keep_words`` words (about 200 bytes each).
    """
    close = int(end).to_bytes(4, "little")

    def cut(batches):
        encode = word_ends(tokenizer, keep_words).ids
        for batch in batches:
            docs, texts, out = batch.column(0).to_pylist(), utf8(batch.column(1)), []
            for lo, hi in packs(texts):
                for doc, ids in zip(docs[lo:hi], encode([(t or b"").decode() for t in texts[lo:hi]])):
                    ids += close
                    for k in range(0, len(ids), 4 * capacity):
                        piece = ids[k : k + 4 * capacity]
                        out.append((doc, k // (4 * capacity), k // 4, len(piece) // 4, zlib.crc32(piece)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, _KIND)], schema=_KIND)

    return docs.select("doc_id", "text").mapInArrow(tidy(cut), _PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, keep_words: int = 1_000_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: see ``token_pieces`` and ``best_fit``.  Other columns are dropped."""
    pieces = durable(token_pieces(docs, tokenizer, capacity, end, keep_words).repartition(partitions(docs)))
    return best_fit(pieces, capacity)
