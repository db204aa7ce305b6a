"""Queries on conversations and chat events."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlake.functions import text as tx
from loomlake.operators import chats as op
from loomlake.operators.retrieval import last_user_message
from loomlake.plans.tables import cte, load
from loomlake.registry import query


@query("w3_last_user_message", "SELECT conv_id, coalesce(max_by(text, turn) FILTER (WHERE role = 'user'), max_by(text, turn)) AS text FROM conversations GROUP BY conv_id")
def w3(spark, sf_dir):
    return last_user_message(load(spark, sf_dir, "conversations"))


_TURNS = "SELECT request_id, seq, event, data, tool_use_id, value, (seq // 700) % 3 AS turn FROM chat_events"


def _events(spark, sf_dir):
    e = load(spark, sf_dir, "chat_events")
    return e.withColumn("turn", F.floor(F.col("seq") / 700) % 3)


@query("w4_tool_rounds", cte("chat_events") + f""", e AS ({_TURNS}), c AS (SELECT *, CASE WHEN turn = lag(turn) OVER (PARTITION BY request_id ORDER BY seq) THEN 0 ELSE 1 END AS s FROM e WHERE event = 'toolCall')
    SELECT request_id, seq, CAST(sum(s) OVER (PARTITION BY request_id ORDER BY seq) AS INTEGER) AS round FROM c""")
def w4(spark, sf_dir):
    return op.rounds(_events(spark, sf_dir).where("event = 'toolCall'"), ["request_id"], ["seq"]).select("request_id", "seq", "round")


@query("w5_text_by_round", cte("chat_events") + """, e AS (SELECT *, CASE WHEN event = 'message' AND lag(event) OVER (PARTITION BY request_id ORDER BY seq) = 'toolCall' THEN 1 ELSE 0 END AS s FROM chat_events WHERE event IN ('toolCall', 'message')),
    p AS (SELECT *, sum(s) OVER (PARTITION BY request_id ORDER BY seq) AS part FROM e)
    SELECT request_id, CAST(part AS INTEGER) AS part, count(*) FILTER (WHERE event = 'toolCall') = 0 AS is_answer, coalesce(string_agg(data, '' ORDER BY seq) FILTER (WHERE event = 'message'), '') AS text FROM p GROUP BY request_id, part""")
def w5(spark, sf_dir):
    return op.split_text(load(spark, sf_dir, "chat_events"))


@query("j11_call_result_correlation", cte("chat_events") + """, c AS (SELECT request_id, tool_use_id, count(*) AS calls FROM chat_events WHERE event = 'toolCall' GROUP BY 1, 2),
    r AS (SELECT request_id, tool_use_id, count(*) AS results FROM chat_events WHERE event = 'toolCallResult' GROUP BY 1, 2) SELECT * FROM c FULL OUTER JOIN r USING (request_id, tool_use_id)""")
def j11(spark, sf_dir):
    e = load(spark, sf_dir, "chat_events")
    of = lambda kind, name: e.where(F.col("event") == kind).groupBy("request_id", "tool_use_id").agg(F.count("*").alias(name))
    return op.correlate(of("toolCall", "calls"), of("toolCallResult", "results"), ["request_id", "tool_use_id"])


@query("a6_token_usage", cte("chat_events") + "SELECT request_id, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS input_tokens, CAST(sum(CAST(floor(value * 2) AS BIGINT)) AS BIGINT) AS output_tokens, max_by(event, seq) AS stop_reason FROM chat_events GROUP BY request_id")
def a6(spark, sf_dir):
    e = load(spark, sf_dir, "chat_events")
    return op.usage(e.select("request_id", "seq", F.floor("value").alias("input_tokens"), F.floor(F.col("value") * 2).alias("output_tokens"), F.col("event").alias("stop_reason")))


@query("w9_grounding_audit", cte("chat_messages") + """, m AS (SELECT *, last_value(CASE WHEN role = 'user' THEN CASE WHEN attachment IS NULL THEN 0 ELSE 1 END END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM chat_messages)
    SELECT conv_id, position, coalesce(a, 0) = 1 AS grounded FROM m WHERE role = 'assistant'""")
def w9(spark, sf_dir):
    return op.grounded(load(spark, sf_dir, "chat_messages")).select("conv_id", "position", "grounded")


@query("w10_usage_throttle", """WITH RECURSIVE u AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    k AS (SELECT user_id, ts, n, ts AS kept, true AS keep FROM u WHERE n = 1 UNION ALL SELECT u.user_id, u.ts, u.n, CASE WHEN u.ts >= k.kept + INTERVAL 5 MINUTE THEN u.ts ELSE k.kept END, u.ts >= k.kept + INTERVAL 5 MINUTE FROM k JOIN u ON u.user_id = k.user_id AND u.n = k.n + 1)
    SELECT user_id, ts FROM k WHERE keep""")
def w10(spark, sf_dir):
    return op.throttle(load(spark, sf_dir, "events"), "user_id", "ts")


@query("w11_conversation_counts", "SELECT conv_id, count(*) AS message_count, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def w11(spark, sf_dir):
    return op.counts(load(spark, sf_dir, "conversations"))


@query("w12_titles", r"""WITH f AS (SELECT conv_id, count(*) AS message_count, trim(regexp_replace(min_by(text, turn) FILTER (WHERE role = 'user'), '\s+', ' ', 'g'), ' ') AS t FROM conversations GROUP BY conv_id)
    SELECT conv_id, message_count, CASE WHEN length(t) > 60 THEN substring(t, 1, 60) || '…' ELSE t END AS title FROM f""")
def w12(spark, sf_dir):
    return op.summaries(load(spark, sf_dir, "chat_messages"), tx.title(F.col("_first")))


def _calls(spark, sf_dir):
    """Up to three tool calls for each assistant message, in turns 1, 2, 1."""
    replies = load(spark, sf_dir, "chat_messages").where("role = 'assistant'")
    n = (F.col("conv_id") % 4).cast("int")
    each = replies.where(n > 0).withColumn("ordinal", F.explode(F.sequence(F.lit(1), n)))
    return each.select(
        "conv_id", "position", "ordinal", F.concat(F.lit("s"), (F.col("ordinal") % 2).cast("string")).alias("server_id"),
        F.when((F.col("conv_id") + F.col("ordinal")) % 3 == 0, "gone").otherwise("find").alias("tool"),
        F.concat_ws("-", F.lit("t"), "conv_id", "position", "ordinal").alias("tool_use_id"), F.when(F.col("ordinal") == 2, "").otherwise('{"q":1}').alias("arguments"),
        F.lit("result").alias("content"), (F.col("ordinal") == 3).alias("is_error"), F.when(F.col("ordinal") == 2, 2).otherwise(1).alias("turn"), F.lit("").alias("text"),
    )


# Turns 1, 2, 1 are three rounds of one call each; calls of the tool that is gone drop out.
@query("w6_history_replay", cte("chat_messages") + """, c AS (SELECT conv_id, position, o FROM chat_messages, range(1, 4) t(o) WHERE role = 'assistant' AND o <= conv_id % 4 AND (conv_id + o) % 3 <> 0),
    j AS (SELECT *, '[{"ordinal":' || o || ',"tool_use_id":"t-' || conv_id || '-' || position || '-' || o || '","name":"' AS head FROM c)
    SELECT conv_id, position, CAST(o AS INTEGER) AS round, 0 AS part, 'assistant' AS role, '' AS content, head || 's' || (o % 2) || '__find","arguments":"' || CASE WHEN o = 2 THEN '{}' ELSE '{\\"q\\":1}' END || '"}]' AS tools FROM j
    UNION ALL SELECT conv_id, position, CAST(o AS INTEGER), 1, 'user', '', head || 'result","arguments":"' || CASE WHEN o = 3 THEN 'true' ELSE 'false' END || '"}]' FROM j
    UNION ALL SELECT conv_id, position, 1073741824, 0, role, content, NULL FROM chat_messages m WHERE content <> '' OR NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = m.conv_id AND c.position = m.position)""")
def w6(spark, sf_dir):
    bindings = spark.sql("select server_id, 'find' as tool, server_id || '__find' as advertised from values ('s0'), ('s1') v(server_id)")
    return op.replay(load(spark, sf_dir, "chat_messages"), _calls(spark, sf_dir), bindings)


@query("c4_attachment_admission", cte("chat_messages") + """, f AS (SELECT conv_id, position, attachment AS filename, content FROM chat_messages WHERE attachment IS NOT NULL
      UNION ALL SELECT conv_id, position, CASE WHEN position = 1 THEN 'x.exe' WHEN conv_id % 3 = 0 THEN 'y.TXT' ELSE 'z.md' END, CASE WHEN position = 3 THEN '' ELSE content END FROM chat_messages WHERE role = 'assistant'),
    n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS files FROM f), u AS (SELECT conv_id, bool_or(role = 'user') AS has_user FROM chat_messages GROUP BY conv_id),
    e AS (SELECT n.conv_id, n.position, CASE WHEN files > 5 THEN '0 too many files' WHEN NOT has_user THEN '1 no user message' WHEN lower(regexp_extract(filename, '(\\.[^./]*)$', 1)) NOT IN ('.pdf','.csv','.doc','.docx','.xls','.xlsx','.html','.htm','.txt','.md') THEN '2 unsupported type'
      WHEN content = '' THEN '4 empty' WHEN strlen(content) > 4500000 THEN '5 too large' END AS reason FROM n JOIN u USING (conv_id))
    SELECT conv_id, min_by(reason, position) FILTER (WHERE reason IS NOT NULL) AS reason FROM e GROUP BY conv_id""".replace("\\\\", "\\"))
def c4(spark, sf_dir):
    return op.refused_attachments(*_attachments(spark, sf_dir))


def _attachments(spark, sf_dir):
    m = load(spark, sf_dir, "chat_messages")
    extra = m.where("role = 'assistant'").select("conv_id", "position", F.when(F.col("position") == 1, "x.exe").when(F.col("conv_id") % 3 == 0, "y.TXT").otherwise("z.md").alias("filename"), F.base64(F.encode(F.when(F.col("position") == 3, "").otherwise(F.col("content")), "UTF-8")).alias("data"))
    files = m.where("attachment is not null").select("conv_id", "position", F.col("attachment").alias("filename"), F.base64(F.encode("content", "UTF-8")).alias("data")).unionAll(extra)
    return files, m


@query("c4_admitted_documents", cte("chat_messages") + """, f AS (SELECT conv_id, position, '/up/' || CASE conv_id % 4 WHEN 0 THEN '..' WHEN 1 THEN 'a__b. c(' || position || ')é' WHEN 2 THEN '_' ELSE 'file-' || conv_id END || '.pdf' AS filename, content,
      row_number() OVER (PARTITION BY conv_id ORDER BY position) AS place FROM chat_messages WHERE attachment IS NOT NULL AND content <> '')
    SELECT conv_id, position, CASE conv_id % 4 WHEN 1 THEN 'a b c(' || position || ')' WHEN 3 THEN 'file-' || conv_id ELSE 'document-' || place END AS name, 'pdf' AS format, strlen(content) AS bytes FROM f
    WHERE conv_id NOT IN (SELECT conv_id FROM f GROUP BY conv_id HAVING count(*) > 5 OR max(strlen(content)) > 4500000)""")
def c4_documents(spark, sf_dir):
    """Files that come through, with the names and formats that they go on with."""
    m = load(spark, sf_dir, "chat_messages")
    k = F.col("conv_id") % 4
    name = F.when(k == 0, "..").when(k == 1, F.concat(F.lit("a__b. c("), F.col("position").cast("string"), F.lit(")é"))).when(k == 2, "_").otherwise(F.concat(F.lit("file-"), F.col("conv_id").cast("string")))
    files = m.where("attachment is not null and content <> ''").select("conv_id", "position", F.concat(F.lit("/up/"), name, F.lit(".pdf")).alias("filename"), F.base64(F.encode("content", "UTF-8")).alias("data"))
    return op.admitted_documents(files, op.refused_attachments(files, m))


@query("c5_reply_normalization", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'json' ELSE 'text' END AS kind, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '"' || user_id || '"' WHEN 2 THEN '"' || replace(props, '"', '\\"') || ' x"' WHEN 3 THEN '"[' || event_type || '"' ELSE '"' || event_type || '."' END AS value FROM events""")
def c5(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    n = F.col("event_id") % 5
    reply = F.when(n == 0, F.concat(F.lit("  "), F.col("props"), F.lit(" "))).when(n == 1, F.col("user_id").cast("string")).when(n == 2, F.concat(F.col("props"), F.lit(" x"))).when(n == 3, F.concat(F.lit("["), F.col("event_type"))).otherwise(F.concat(F.col("event_type"), F.lit(".")))
    return e.select("event_id", tx.normalized_reply(reply).alias("r")).select("event_id", "r.kind", "r.value")


@query("q6_message_checks", """SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'blank content' WHEN role NOT IN ('user', 'assistant') THEN 'role' WHEN strlen(text) > 262144 THEN 'too large'
    WHEN (conv_id + turn) % 4 = 3 THEN 'no agent or model' WHEN (conv_id + turn) % 4 = 0 THEN 'agent and model' WHEN (conv_id * 3 + turn) % 8 > 5 THEN 'too many files' ELSE 'ok' END AS verdict FROM conversations""")
def q6(spark, sf_dir):
    """Requests with an agent, a model, both or neither, and up to seven files."""
    n = (F.col("conv_id") + F.col("turn")) % 4
    asked = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"), F.when(n.isin(0, 1), "a1").otherwise("").alias("agent"), F.when(n.isin(0, 2), "small").alias("model"), ((F.col("conv_id") * 3 + F.col("turn")) % 8).alias("files"))
    return asked.select("conv_id", "turn", op.request_verdict(asked).alias("verdict"))
