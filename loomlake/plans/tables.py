"""Platform tables, derived from the driver's tables by SQL that Spark and DuckDB both run.

``load`` gives a table to an operator; ``cte`` gives its text to an oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

TABLES: dict[str, str] = {
    "memberships": "SELECT c_custkey AS user_id, c_nationkey AS organization_id, c_custkey % 50 = 0 AS owner, c_custkey * 10 AS created_at FROM customer WHERE c_custkey % 97 <> 0",
    # Roles: one for each nation and segment; what its members may do. Every customer has a hidden one for what they own.
    "role_members": """SELECT c_nationkey AS organization_id, 'seg ' || lower(c_mktsegment) AS name, c_custkey AS user_id FROM customer
        UNION ALL SELECT (c_nationkey + 1) % 25, 'seg ' || lower(c_mktsegment), c_custkey FROM customer WHERE c_custkey % 40 = 0
        UNION ALL SELECT c_nationkey, 'own ' || cast(c_custkey AS varchar(20)), c_custkey FROM customer""",
    "role_rules": """SELECT DISTINCT c_nationkey AS organization_id, 'seg ' || lower(c_mktsegment) AS name, false AS hidden, cast(NULL AS bigint) AS resource_id,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'plat:kb:view:*' WHEN 'AUTOMOBILE' THEN 'plat:*:view' WHEN 'MACHINERY' THEN 'plat:agent'
        WHEN 'HOUSEHOLD' THEN 'plat:workflow:*:*' ELSE 'plat:mcp-server:use:*' END AS rule FROM customer
        UNION ALL SELECT c_nationkey, 'own ' || cast(c_custkey AS varchar(20)), true, o_orderkey, 'plat:' || CASE o_orderkey % 4 WHEN 0 THEN 'kb' WHEN 1 THEN 'agent' WHEN 2 THEN 'workflow' ELSE 'mcp-server' END || ':*:' || cast(o_orderkey AS varchar(20))
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "resources": """SELECT CASE o_orderkey % 4 WHEN 0 THEN 'kb' WHEN 1 THEN 'agent' WHEN 2 THEN 'workflow' ELSE 'mcp-server' END AS resource, o_orderkey AS id, c_nationkey AS organization_id,
        o_custkey AS user_id, o_orderdate AS created_at FROM orders JOIN customer ON o_custkey = c_custkey""",
    # Who asks for what: the owner, and the customer 25 further, who is often of the same organization or another.
    "asks": """SELECT o_custkey AS caller, o_orderkey AS id FROM orders UNION ALL SELECT o_custkey + 25, o_orderkey FROM orders UNION ALL SELECT o_custkey + 1, o_orderkey FROM orders""",
    "kb_documents": "SELECT doc_id % 12 % 5 AS user_id, doc_id % 12 AS kb_id, doc_id AS document_id, source || '.' || lang AS filename, text, doc_id AS uploaded_at FROM documents",
    "agents": """SELECT s_suppkey AS id, s_nationkey AS organization_id, CASE s_suppkey % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'large' WHEN 2 THEN 'medium' ELSE 'unknown' END AS model,
        CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'You are ' || s_name END AS system_prompt, s_name AS name,
        CASE s_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN '{}' WHEN 2 THEN '{"type":"object"}' WHEN 3 THEN '[1]' WHEN 4 THEN '{"a":' ELSE '{"b":[1,2]}' END AS output_schema FROM supplier""",
    "agent_kbs": """SELECT s_suppkey AS agent_id, 0 AS position, s_suppkey % 12 AS kb_id FROM supplier UNION ALL SELECT s_suppkey, 1, (s_suppkey + 1) % 12 FROM supplier
        UNION ALL SELECT s_suppkey, 2, 99 FROM supplier""",
    "chat_messages": """SELECT conv_id, turn AS position, role, text AS content, CASE WHEN role = 'user' AND (conv_id + turn) % 4 = 0 THEN 'file-' || cast(conv_id AS varchar(20)) || '.pdf' END AS attachment FROM conversations""",
    "chat_events": """SELECT user_id AS request_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'message' WHEN 'view' THEN 'message' WHEN 'purchase' THEN 'toolCall' WHEN 'signup' THEN 'toolCallResult' ELSE 'error' END AS event,
        event_type || '-' || cast(event_id AS varchar(20)) AS data, 'u' || cast(event_id % 20 AS varchar(20)) AS tool_use_id, event_id / 500 AS turn_raw, value FROM events""",
    "delivery_log": "SELECT event_id % 2500 AS message_id, ts AS attempt_ts, event_type = 'signup' AS acked FROM events UNION ALL SELECT event_id % 2500, ts, false FROM events WHERE event_id % 2500 % 50 = 0",
    "executions": "SELECT o_orderkey AS id, o_orderkey % 200 AS workflow_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'succeeded' ELSE 'failed' END AS status, o_orderdate AS queued_at FROM orders",
    "step_runs": """SELECT l_orderkey AS execution_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS position,
        CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'failed' ELSE 'succeeded' END AS status, 'out-' || cast(l_partkey AS varchar(20)) AS output,
        CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'part ' || cast(l_partkey AS varchar(20)) || ' returned' END AS error FROM lineitem""",
    "identities": """SELECT user_id, provider, organization_id, expires_at, refreshable, status, refresh_failures, scopes FROM (SELECT o_custkey AS user_id,
        CASE o_orderkey % 3 WHEN 0 THEN 'google' WHEN 1 THEN 'github' ELSE 'jira' END AS provider, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE c_nationkey END AS organization_id,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS expires_at, o_orderstatus <> 'P' AS refreshable,
        CASE o_orderkey % 5 WHEN 0 THEN 'revoked' WHEN 1 THEN NULL WHEN 2 THEN 'refresh_failed' ELSE 'active' END AS status, o_orderkey % 3 AS refresh_failures,
        CASE o_orderkey % 4 WHEN 0 THEN 'repo' WHEN 1 THEN 'repo,user' WHEN 2 THEN '' ELSE 'read:org,repo:status' END AS scopes,
        row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders JOIN customer ON o_custkey = c_custkey) x WHERE n = 1""",
    "identity_providers": """SELECT n_nationkey AS organization_id, 'google' AS name FROM nation UNION ALL SELECT n_nationkey, 'github' FROM nation
        UNION ALL SELECT n_nationkey, 'jira' FROM nation WHERE n_nationkey % 5 <> 0""",
    # A tool's requirements: the wildcard of each server, own entries of some tools.
    "tools": """SELECT s_nationkey AS organization_id, s_suppkey AS server_id, p_partkey AS tool_id, p_name || ' ' || cast(p_partkey % 7 AS varchar(20)) AS name, p_brand, p_type, p_size, p_retailprice FROM part JOIN supplier ON p_partkey % 100 = s_suppkey""",
    "users": """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '  User' || cast(c_custkey / 2 AS varchar(20)) || '@Mail.org ' ELSE 'user' || cast(c_custkey AS varchar(20)) || '@mail.org' END AS email, c_name AS display_name, c_custkey % 6 <> 0 AS email_verified FROM customer""",
    "request_log": "SELECT event_id, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' WHEN event_id % 5 = 0 THEN 'HEAD' ELSE 'GET' END AS method, event_type AS route, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value / 100 AS duration_s, user_id AS trace_id FROM events",
}
TABLES["users"] = TABLES["users"].replace("c_custkey / 2", "(c_custkey - c_custkey % 2)")
TABLES["chat_events"] = TABLES["chat_events"].replace("event_id / 500 AS turn_raw, ", "")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a platform table derived from them."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = TABLES[name]
    used = [b for b in BASE if re.search(rf"\b{b}\b", text)]
    text = text.replace("{", "{{").replace("}", "}}")
    for b in used:
        text = re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{{b}}}", text)
    return spark.sql(text, **{b: load(spark, sf_dir, b) for b in used if f"{{{b}}}" in text})


def cte(*names: str) -> str:
    """WITH clauses of platform tables, for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n]})" for n in names) + " "
