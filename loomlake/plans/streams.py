"""Streaming queries, run over all that is there; oracles are their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.operators import logs as lg
from loomlake.operators import retrieval as rt
from loomlake.plans.tables import cte, load
from loomlake.registry import ORACLES, query
from loomlake.sinks import KeyedTable, newest, summed
from loomlake.sources import messages, table_stream
from loomlake.streaming import drain, folder, run_batches
from loomlake.streaming.folds import DELIVERY, fold_chat, fold_deliveries, throttle, with_rocksdb
from loomlake.streaming.ingest import Ingest


_KIND = """CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 = 0 THEN 'other' WHEN doc_id % 29 = 0 THEN 'delete_agent_document' WHEN doc_id % 31 = 0 THEN 'delete_kb_document' WHEN doc_id % 3 = 0 THEN 'kb_context' ELSE 'agent_rag' END"""


def _lines(documents: DataFrame) -> DataFrame:
    """Documents as message lines, numbered in the order they were sent, with broken ones, blank texts, bad payloads, unknown types and deletes among them.

    A delete names the document sent just before it, or the one that is sent right after it.
    """
    k = F.col("doc_id")
    content = F.when(k % 19 == 0, "%%%").when(k % 23 == 0, F.base64(F.encode(F.lit(" "), "UTF-8"))).otherwise(F.base64(F.encode("text", "UTF-8")))
    kind = F.expr(_KIND)
    about = F.when(~kind.startswith("delete"), k).when(k % 2 == 0, k - 1).otherwise(k + 1)
    fields = F.struct(kind.alias("type"), (k % 5).cast("string").alias("user_id"), (about % 12).cast("string").alias("kb_id"), (about % 10).cast("string").alias("agent_id"), about.cast("string").alias("document_id"), F.col("source").alias("filename"), content.alias("content"))
    body = F.to_json(fields)
    return documents.select(k.alias("message_id"), F.when(k % 17 == 0, F.substring(body, 1, 30)).otherwise(body).alias("value"))


@query("s1_message_source", "SELECT doc_id % 17 <> 0 AS ok, count(*) AS n FROM documents GROUP BY 1")
def s1(spark, sf_dir):
    parsed = messages(_lines(table_stream(spark, sf_dir, "documents"))).select("ok", "m.document_id")
    return drain(parsed, folder(spark, "s1")).groupBy("ok").agg(F.count("*").alias("n"))


# The messages as SQL sees them: what each is, and whether a later one deletes it.
_SENT = f"""m AS (SELECT *, {_KIND} AS kind, doc_id % 17 = 0 AS broken, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents),
    x AS (SELECT doc_id - 1 AS gone, kind FROM m WHERE kind LIKE 'delete%' AND doc_id % 2 = 0 AND NOT broken),
    j AS (SELECT *, CASE WHEN broken THEN 'broken line' WHEN kind = 'other' THEN 'unknown type' WHEN kind LIKE 'delete%' THEN NULL WHEN doc_id % 19 = 0 THEN 'not base64' WHEN doc_id % 23 = 0 OR t = '' THEN 'blank text' END AS reason FROM m),
    g AS (SELECT * FROM j WHERE reason IS NULL AND kind IN ('agent_rag', 'kb_context', '')),
    w AS (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t) <= 1000 THEN 1 ELSE CAST(ceil((length(t) - 1000) / 850.0) AS BIGINT) + 1 END)) AS i FROM g WHERE kind = 'agent_rag' AND doc_id NOT IN (SELECT gone FROM x WHERE kind = 'delete_agent_document')),
    c AS (SELECT doc_id, i, regexp_replace(substring(t, i * 850 + 1, 1000), '^\\s+|\\s+$', '', 'g') AS text FROM w)"""


@query("t1_ingest_stream", f"WITH {_SENT} SELECT doc_id AS document_id, count(*) AS chunks, md5(string_agg(text, '|' ORDER BY i)) AS texts_md5 FROM c WHERE text <> '' GROUP BY doc_id")
def t1(spark, sf_dir):
    """Messages to chunks with embeddings, and the chunks of the agents' documents that are there at the end, by document."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "|")
    return ingest(spark, sf_dir).chunks.groupBy(F.col("document_id").cast("long").alias("document_id")).agg(F.count("*").alias("chunks"), F.md5(texts).alias("texts_md5"))


@query("s2_routed_sinks", f"""WITH {_SENT} SELECT 'rag_chunks' AS written, doc_id AS id, CAST(count(*) AS VARCHAR) AS detail FROM c WHERE text <> '' GROUP BY doc_id
    UNION ALL SELECT 'kb_documents', doc_id, md5(text) FROM g WHERE kind IN ('kb_context', '') AND doc_id NOT IN (SELECT gone FROM x WHERE kind = 'delete_kb_document')
    UNION ALL SELECT 'quarantine', doc_id, reason FROM j WHERE reason IS NOT NULL""")
def s2_sinks(spark, sf_dir):
    """What one stream of messages leaves in each of the tables that its batches are written to."""
    done = ingest(spark, sf_dir)
    chunks = done.chunks.groupBy("document_id").agg(F.count("*").cast("string").alias("detail")).select(F.lit("rag_chunks").alias("written"), F.col("document_id").cast("long").alias("id"), "detail")
    kept = done.documents.select(F.lit("kb_documents"), F.col("document_id").cast("long"), F.md5("text"))
    return chunks.unionAll(kept).unionAll(done.quarantine.select(F.lit("quarantine"), "message_id", "reason"))


def ingest(spark, sf_dir) -> Ingest:
    """The tables after all messages; one embedder, fitted once on the corpus, serves every batch, so all vectors share a space."""
    corpus = load(spark, sf_dir, "documents").select("text")
    done = Ingest(spark, folder(spark, "ingest"), rt.fit_embedder(rt.chunk_table(corpus), dim=64))
    done.run(_lines(table_stream(spark, sf_dir, "documents")))
    return done


# A request's part ends with an error, or with the last event; parts and turns in SQL by running sums.
@query("t3_chat_fold_stream", cte("chat_events") + """, e AS (SELECT *, coalesce(sum(CASE WHEN event = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM chat_events),
    l AS (SELECT *, max(CASE WHEN event = 'toolCall' THEN seq END) OVER p AS last_call, CASE WHEN event = 'message' AND lag(event) OVER o = 'toolCall' THEN 1 ELSE 0 END AS opens FROM (SELECT * FROM e WHERE event IN ('message', 'toolCall')) x WINDOW p AS (PARTITION BY request_id, part), o AS (PARTITION BY request_id, part ORDER BY seq)),
    t AS (SELECT *, 1 + sum(opens) OVER (PARTITION BY request_id, part ORDER BY seq) AS turn FROM l),
    a AS (SELECT request_id, part, string_agg(data, '' ORDER BY seq) AS answer FROM t WHERE event = 'message' AND seq > coalesce(last_call, -1) GROUP BY 1, 2),
    c AS (SELECT request_id, part, tool_use_id, max(turn) AS turn, max_by(data, seq) AS called FROM t WHERE event = 'toolCall' GROUP BY 1, 2, 3),
    r AS (SELECT request_id, part, tool_use_id, max_by(data, seq) AS result FROM e WHERE event = 'toolCallResult' GROUP BY 1, 2, 3),
    k AS (SELECT request_id, part, tool_use_id || ':' || coalesce(CAST(turn AS BIGINT)::VARCHAR, '-') || ':' || coalesce(called, '-') || ':' || coalesce(result, '-') AS said FROM c FULL OUTER JOIN r USING (request_id, part, tool_use_id)),
    b AS (SELECT request_id, part, string_agg(said, ',' ORDER BY said) AS calls FROM k GROUP BY 1, 2)
    SELECT g.request_id, g.first_seq, g.last_seq + CASE WHEN g.failed THEN 0 ELSE 1 END AS last_seq, CASE WHEN g.failed THEN 'error' ELSE 'done' END AS ended, coalesce(a.answer, '') AS answer, coalesce(b.calls, '') AS calls
    FROM (SELECT request_id, part, min(seq) AS first_seq, max(seq) AS last_seq, bool_or(event = 'error') AS failed FROM e GROUP BY 1, 2) g LEFT JOIN a USING (request_id, part) LEFT JOIN b USING (request_id, part)""")
def t3(spark, sf_dir):
    """Answers and calls of each request up to an error, or to the end (a ``done`` event after the last one)."""
    e = table_stream(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "message").when(F.col("event_type") == "purchase", "toolCall").when(F.col("event_type") == "signup", "toolCallResult").otherwise("error")
    events = e.select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), kind.alias("event"), F.concat_ws("-", "event_type", "event_id").alias("data"), F.concat(F.lit("u"), (F.col("event_id") % 20).cast("string")).alias("tool_use_id"))
    last = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("request_id")).agg(F.max("event_id").alias("_end"))
    here = events.join(last, "request_id").where(F.col("event").isNotNull())
    ends = (F.col("seq") == F.col("_end")) & (F.col("event") != "error")
    more = F.when(ends, F.array("event", F.lit("done"))).otherwise(F.array("event"))
    rows = drain(fold_chat(with_rocksdb(here.withColumn("event", F.explode(more)).withColumn("seq", F.col("seq") + F.when(F.col("event") == "done", 1).otherwise(0)).drop("_end"))), folder(spark, "t3"), "update", timers=True)
    said = F.transform("calls", lambda c: F.concat_ws(":", c["tool_use_id"], *[F.coalesce(c[x].cast("string"), F.lit("-")) for x in ("turn", "call", "result")]))
    return rows.select("request_id", "first_seq", "last_seq", "ended", "answer", F.array_join(F.array_sort(said), ",").alias("calls"))


@query("t2_delivery_stream", cte("delivery_log") + """SELECT message_id, count(*) AS attempts, CASE WHEN bool_or(acked) THEN 'done' WHEN count(*) >= 5 THEN 'dropped' ELSE 'reclaimable' END AS state, NOT bool_or(acked) AND count(*) >= 5 AS dead_letter FROM delivery_log GROUP BY message_id""")
def t2_stream(spark, sf_dir):
    """States of messages, and the table of those given up, once all have been idle (their attempts are long ago)."""
    e = table_stream(spark, sf_dir, "events")
    times = F.when(F.col("event_id") % 2500 % 50 == 0, F.array(F.col("event_type") == "signup", F.lit(False))).otherwise(F.array(F.col("event_type") == "signup"))
    log = e.select((F.col("event_id") % 2500).alias("message_id"), F.col("ts").cast("timestamp").alias("attempt_ts"), F.explode(times).alias("acked"))
    at = folder(spark, "t2")
    states = KeyedTable(spark, f"{at}/states", DELIVERY, ["message_id"], 16)
    dead = KeyedTable(spark, f"{at}/dead", DELIVERY, ["message_id"], 16)
    by_version = newest(["message_id"], ["version"])

    def sink(batch: DataFrame, batch_id: int) -> None:
        states.upsert(batch_id, batch, by_version)
        dead.upsert(batch_id, batch.where("state = 'dropped'"), by_version)

    run_batches(fold_deliveries(with_rocksdb(log)), at, sink, "update", timers=True)
    letters = dead.rows().select("message_id", F.lit(True).alias("_dead"))
    return states.rows().join(letters, "message_id", "left").select("message_id", "attempts", "state", F.coalesce("_dead", F.lit(False)).alias("dead_letter"))


@query("t4_throttle_stream", ORACLES["w10_usage_throttle"].replace("SELECT user_id, ts FROM k WHERE keep", "SELECT user_id, epoch_us(ts) AS micros FROM k WHERE keep"))
def t4(spark, sf_dir):
    e = table_stream(spark, sf_dir, "events")
    uses = e.select("user_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("micros"))
    return drain(throttle(uses), folder(spark, "t4")).drop("batch_id")


@query("t5_windowed_metrics", cte("request_log") + """SELECT epoch_us(time_bucket(INTERVAL 15 SECOND, ts)) // 1000000 AS window_start, method, route, status, count(*) AS requests, count(*) FILTER (WHERE status >= 500) AS errors,
    quantile_disc(duration_s, 0.5) AS p50, quantile_disc(duration_s, 0.95) AS p95 FROM request_log GROUP BY 1, 2, 3, 4""")
def t5(spark, sf_dir):
    """Metrics of 15-second windows, kept in a table by window: a batch adds to the windows that its rows belong to, however late they are."""
    e = table_stream(spark, sf_dir, "events")
    start = F.expr("timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 15000000 * 15")
    method = F.when(F.col("event_type").isin("purchase", "signup"), "POST").when(F.col("event_id") % 5 == 0, "HEAD").otherwise("GET")
    log = e.select(start.alias("window_start"), method.alias("method"), F.col("event_type").alias("route"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), (F.col("value") / 100).alias("duration_s"))
    key = ["window_start", "method", "route", "status"]
    at = folder(spark, "t5")
    kept = KeyedTable(spark, f"{at}/metrics", f"window_start long, method string, route string, status int, {lg.SKETCHED}", key, 16)
    run_batches(log, at, lambda batch, batch_id: kept.upsert(batch_id, lg.duration_sketches(batch, key), summed(key, lg.MERGED)))
    return lg.quantiles(kept.rows(), {"p50": 0.5, "p95": 0.95}).select(*key, "requests", "errors", "p50", "p95")


@query("t7_admission_stream", ORACLES["f9_admission"])
def t7(spark, sf_dir):
    """Requests to run, once each, in whatever order and however often they come: what was admitted stays in a table by id."""
    sent = table_stream(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 3).alias("id"))
    queued = load(spark, sf_dir, "executions").where("status = 'queued'").select("id", "workflow_id")
    at = folder(spark, "t7")
    admitted = KeyedTable(spark, f"{at}/admitted", "id long, workflow_id long", ["id"], 16)
    run_batches(sent.join(queued, "id").select("id", "workflow_id"), at, lambda batch, batch_id: admitted.insert(batch_id, batch))
    return admitted.rows()
