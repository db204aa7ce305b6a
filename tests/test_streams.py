"""Streams that get their input in several micro-batches give what one batch, and a plain reading, gives."""

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from loomlake import sources
from loomlake.plans import streams
from loomlake.registry import QUERIES
from loomlake.streaming import drain, folds
from tests.conftest import DATA

SMALL = f"{DATA}/sf0.001"


@pytest.fixture
def split(spark, tmp_path, monkeypatch):
    """A copy of the small tables, one of them in several files in the order of a column; a micro-batch reads one."""

    def make(name: str, order: str, files: int = 3) -> str:
        for t in os.listdir(SMALL):
            if t != f"{name}.parquet":
                os.symlink(f"{SMALL}/{t}", tmp_path / t)
        rows = spark.read.parquet(f"{SMALL}/{name}.parquet")
        ranges = rows.withColumn("_f", F.expr(f"ntile({files}) over (order by {order})")).cache()
        os.makedirs(tmp_path / f"{name}.parquet")
        for i in range(1, files + 1):
            ranges.where(F.col("_f") == i).drop("_f").coalesce(1).write.parquet(str(tmp_path / "part"))
            part = next(x for x in os.listdir(tmp_path / "part") if x.endswith(".parquet"))
            target = tmp_path / f"{name}.parquet" / f"{i}.parquet"
            shutil.move(tmp_path / "part" / part, target)
            shutil.rmtree(tmp_path / "part")
            os.utime(target, (time.time() - 1000 + 10 * i,) * 2)
        monkeypatch.setattr(sources, "FILES_PER_BATCH", 1)
        return str(tmp_path)

    return make


def result(df):
    columns = sorted(df.columns)
    return sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


#: Splits of the tables: by the order of events, by another one, and backwards.
SPLITS = [
    ("s1_message_source", "documents", "doc_id"), ("s2_routed_sinks", "documents", "text"), ("t2_delivery_stream", "events", "value"), ("t3_chat_fold_stream", "events", "event_id"), ("t4_throttle_stream", "events", "ts, event_id"),
    ("t5_windowed_metrics", "events", "value"), ("t7_admission_stream", "lineitem", "l_shipdate desc"),
]


@pytest.mark.parametrize(("query", "table", "order"), SPLITS)
def test_several_batches_give_the_same(spark, split, query, table, order):
    assert result(QUERIES[query](spark, split(table, order))) == result(QUERIES[query](spark, SMALL))


def test_admissions_are_all_there(spark, split):
    """None is lost however far back a batch reaches."""
    small = spark.read.parquet(f"{SMALL}/lineitem.parquet").selectExpr("l_orderkey + 3 as id").distinct()
    want = small.join(spark.read.parquet(f"{SMALL}/orders.parquet").where("o_orderstatus = 'O'").selectExpr("o_orderkey as id"), "id").count()
    assert QUERIES["t7_admission_stream"](spark, split("lineitem", "l_orderkey")).count() == want > 400


def chat_stream(spark, tmp_path, batches, idle=600, timers=True):
    """Folds batches of chat events, a file each; the rows by request."""
    kind = "request_id long, seq long, event string, data string, tool_use_id string"
    for i, rows in enumerate(batches):
        target = tmp_path / "in" / f"{i}"
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(target))
        for f in os.listdir(target):
            os.utime(target / f, (time.time() - 1000 + 10 * i,) * 2)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    rows = drain(folds.fold_chat(folds.with_rocksdb(stream), idle), str(tmp_path / "state"), "update", timers)
    return sorted((r.request_id, r.first_seq, r.last_seq, r.ended, r.answer, [tuple(c) for c in r.calls], r.batch_id) for r in rows.collect())


def test_chats_end_by_done_error_and_timeout(spark, tmp_path):
    first = [(1, 1, "message", "Let me see. ", None), (1, 2, "toolCall", "find", "a"), (2, 1, "message", "Part", None), (2, 2, "toolCall", "find", "x"), (3, 1, "message", "slow", None), (3, 2, "toolCall", "wait", "z")]
    second = [(1, 4, "message", "It ", None), (1, 3, "toolCallResult", "found", "a"), (1, 5, "message", "is.", None), (2, 3, "message", "ial", None), (2, 4, "error", "gone", None), (2, 5, "toolCallResult", "late", "x")]
    third = [(1, 6, "done", None, None), (1, 7, "message", "again", None), (1, 8, "done", None, None), (4, 1, "done", None, None)]
    got = chat_stream(spark, tmp_path / "hasty", [first, second, third], idle=0.001)
    # With next to no patience a request that a batch brings nothing of is given out by its timer; others go on.
    assert [g[:6] for g in got if g[0] == 3] == [(3, 1, 2, "timeout", "", [("z", 1, "slow", "wait", None)])]
    assert [g[3] for g in got if g[0] == 1] == ["done", "done"] and [g[1:4] for g in got if g[0] == 2] == [(1, 4, "error"), (5, 5, "timeout")]
    patient = chat_stream(spark, tmp_path / "patient", [first, second, third])
    assert [g[:6] for g in patient] == [
        (1, 1, 6, "done", "It is.", [("a", 1, "Let me see. ", "find", "found")]), (1, 7, 8, "done", "again", []),
        (2, 1, 4, "error", "ial", [("x", 1, "Part", "find", None)]), (4, 1, 1, "done", "", []),
    ]
    assert [g[6] for g in patient] == [2, 2, 1, 2]  # each in the batch that it ended in; 3 and the late result of 2 are open still


def test_deliveries_by_the_clock(spark, tmp_path):
    """An attempt of just now is pending; old ones are reclaimable or dropped; an acknowledgement ends all that."""
    kind = "message_id long, attempt_ts timestamp, acked boolean"
    now = spark.sql("select current_timestamp() as t").first().t
    old = now.replace(year=2020)
    files = [[(1, now, False), (2, old, False), (3, old, False), (4, old, False)], [(3, old, False)] * 4 + [(4, old, True), (5, now, False)], [(5, now, True), (4, old, False)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        for f in os.listdir(tmp_path / "in" / f"{i}"):
            os.utime(tmp_path / "in" / f"{i}" / f, (time.time() - 1000 + 10 * i,) * 2)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    rows = drain(folds.fold_deliveries(folds.with_rocksdb(stream)), str(tmp_path / "state"), "update", timers=True).collect()
    last = {r.message_id: (r.attempts, r.state) for r in sorted(rows, key=lambda r: r.version)}
    assert last == {1: (1, "pending"), 2: (1, "reclaimable"), 3: (5, "dropped"), 4: (3, "done"), 5: (2, "done")}
    assert len({(r.message_id, r.version) for r in rows}) == len(rows)


def test_ingest_in_batches(spark, split):
    """One space for all batches, deletes before and after their documents, and messages in another order than they were sent."""
    def chunks(folder):
        return {(r.document_id, r.chunk_index): (r.text, tuple(r.embedding)) for r in streams.ingest(spark, folder).chunks.collect()}

    one = chunks(SMALL)
    assert one == chunks(split("documents", "text")) and len(one) > 100
    deletes = [k for k in range(200) if k % 29 == 0 and k % 11 and k % 13 and k % 17]
    before, after = [k + 1 for k in deletes if k % 2], [k - 1 for k in deletes if k % 2 == 0]
    ids = {int(d) for d, _ in one}
    good = lambda k: all(k % n for n in (3, 11, 13, 17, 19, 23, 29, 31))
    assert not ids & set(after) and {k for k in before if good(k)} <= ids
