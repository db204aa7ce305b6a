"""Queries on workflows and executions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlake.operators import workflows as op
from loomlake.plans.tables import cte, load
from loomlake.registry import query

_SKIPPED = """s AS (SELECT *, coalesce(max(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY execution_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS skip FROM step_runs),
    k AS (SELECT execution_id, position, 'step_' || CAST(position AS VARCHAR) AS name, CASE WHEN skip THEN 'skipped' ELSE status END AS status, CASE WHEN skip THEN NULL ELSE output END AS output, error FROM s)"""


def _runs(spark, sf_dir):
    runs = load(spark, sf_dir, "step_runs").withColumn("name", F.concat(F.lit("step_"), F.col("position").cast("string")))
    return op.propagate_skips(runs)


@query("w7_skip_propagation", cte("step_runs") + f", {_SKIPPED} SELECT execution_id, CAST(position AS INTEGER) AS position, status, output FROM k")
def w7(spark, sf_dir):
    return _runs(spark, sf_dir).select("execution_id", "position", "status", "output")


@query("w8_step_context", cte("step_runs") + f""", {_SKIPPED} SELECT execution_id, CAST(position AS INTEGER) AS position,
    last_value(CASE WHEN status = 'succeeded' THEN output END IGNORE NULLS) OVER w AS previous, coalesce(array_to_string(list_sort(list(name || '=' || output) FILTER (WHERE status = 'succeeded') OVER w), ','), '') AS earlier
    FROM k WINDOW w AS (PARTITION BY execution_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def w8(spark, sf_dir):
    seen = op.contexts(_runs(spark, sf_dir))
    said = F.array_join(F.array_sort(F.transform(F.map_entries("earlier"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return seen.select("execution_id", "position", "previous", said.alias("earlier"))


@query("a11_execution_roll_up", cte("step_runs") + f""", {_SKIPPED}, f AS (SELECT execution_id, min(position) AS p FROM k WHERE status = 'failed' GROUP BY 1)
    SELECT k.execution_id, count(*) AS steps, CASE WHEN p IS NOT NULL THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN p IS NULL THEN max_by(output, position) END AS output,
    CASE WHEN p IS NOT NULL THEN 'step "' || max(name) FILTER (WHERE position = p) || '" failed: ' || max(error) FILTER (WHERE position = p) END AS error FROM k LEFT JOIN f ON f.execution_id = k.execution_id GROUP BY k.execution_id, p""")
def a11(spark, sf_dir):
    return op.roll_up(_runs(spark, sf_dir))


# Steps of workflows with planted mistakes.
_STEPS = """SELECT l_orderkey AS workflow_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS integer) AS position,
    CASE WHEN l_partkey % 97 = 0 THEN '' WHEN l_partkey % 89 = 0 THEN 'bad name' ELSE 'step_' || cast(l_partkey % 50 AS varchar(20)) END AS name,
    CASE WHEN l_suppkey % 41 = 0 THEN 'other' WHEN l_suppkey % 2 = 0 THEN 'agent' ELSE 'code' END AS type,
    CASE WHEN l_suppkey % 2 = 0 AND l_partkey % 31 <> 0 THEN 'a' || cast(l_suppkey % 7 AS varchar(20)) ELSE '' END AS agent_id,
    CASE WHEN l_suppkey % 2 = 0 AND l_partkey % 29 <> 0 THEN 'do it' ELSE '' END AS prompt,
    CASE WHEN (l_suppkey % 2 = 1 AND l_partkey % 37 <> 0) OR l_partkey % 61 = 0 THEN 'return 1' ELSE '' END AS code FROM lineitem"""


def _steps(spark, sf_dir):
    return spark.sql(_STEPS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=load(spark, sf_dir, "lineitem"))


@query("q1_workflow_checks", f"""WITH s AS ({_STEPS}), e AS (SELECT workflow_id, position, CASE WHEN count(*) OVER (PARTITION BY workflow_id) > 25 THEN 'too many steps' WHEN name = '' THEN 'no name'
    WHEN NOT regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*') THEN 'bad name' WHEN row_number() OVER (PARTITION BY workflow_id, name ORDER BY position) > 1 THEN 'name used twice'
    WHEN type = 'agent' AND agent_id = '' THEN 'no agent' WHEN type = 'agent' AND code <> '' THEN 'agent step with code' WHEN type = 'agent' AND prompt = '' THEN 'no prompt'
    WHEN type = 'code' AND code = '' THEN 'no code' WHEN type = 'code' AND strlen(code) > 65536 THEN 'too much code' WHEN type = 'code' AND (agent_id <> '' OR prompt <> '') THEN 'code step with agent'
    WHEN type NOT IN ('agent', 'code') THEN 'unknown type' END AS error FROM s),
    f AS (SELECT workflow_id, min_by(error, position) FILTER (WHERE error IS NOT NULL) AS error FROM e GROUP BY workflow_id),
    w AS (SELECT o_orderkey AS workflow_id FROM orders UNION SELECT l_orderkey FROM lineitem UNION SELECT -c_custkey FROM customer)
    SELECT w.workflow_id, CASE WHEN f.workflow_id IS NULL THEN 'no steps' ELSE f.error END AS error FROM w LEFT JOIN f USING (workflow_id)""")
def q1(spark, sf_dir):
    """Workflows with planted mistakes, and some (a customer's each) that were never given a step."""
    steps = _steps(spark, sf_dir)
    known = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("workflow_id")).unionAll(steps.select("workflow_id")).unionAll(load(spark, sf_dir, "customer").select(-F.col("c_custkey")))
    return op.step_errors(steps, known)


@query("a13_agents_of_workflow", f"""WITH s AS ({_STEPS}), f AS (SELECT workflow_id, agent_id, min(position) AS p FROM s WHERE type = 'agent' AND agent_id <> '' GROUP BY 1, 2)
    SELECT w.workflow_id, coalesce((SELECT string_agg(agent_id, ',' ORDER BY p) FROM f WHERE f.workflow_id = w.workflow_id), '') AS agents FROM (SELECT DISTINCT workflow_id FROM s) w""")
def a13(spark, sf_dir):
    stored = _steps(spark, sf_dir).groupBy("workflow_id").agg(F.array_sort(F.collect_list(F.struct("position", "type", "agent_id"))).alias("steps"))
    return stored.select("workflow_id", F.array_join(op.agent_ids(F.col("steps")), ",").alias("agents"))


@query("f9_admission", cte("executions") + "SELECT DISTINCT e.id, e.workflow_id FROM executions e JOIN lineitem ON l_orderkey + 3 = e.id WHERE e.status = 'queued'")
def f9(spark, sf_dir):
    messages = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 3).alias("id"))
    return op.admit(messages, load(spark, sf_dir, "executions")).select("id", "workflow_id")


@query("c6_prompt_rendering", """SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN 'Event ' || CASE WHEN event_id % 4 = 2 THEN 'null' ELSE event_type END || ' of ' || user_id || '.' END AS prompt, CASE WHEN event_id % 4 = 3 THEN 'missing Input.kind' END AS error FROM events""")
def c6(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    n = F.col("event_id") % 4
    kind = F.when(n == 3, "").when(n == 2, '"kind":null,').otherwise(F.concat(F.lit('"kind":"'), F.col("event_type"), F.lit('",')))
    context = F.parse_json(F.concat(F.lit('{"Input":{'), kind, F.lit('"user":'), F.col("user_id").cast("string"), F.lit("}}")))
    prompt, error = op.render("Event {{ .Input.kind }} of {{ .Input.user }}.", context)
    return e.select("event_id", prompt.alias("prompt"), error.alias("error"))


@query("u1_batch_step_pipeline", """WITH r AS (SELECT o_orderkey AS id, o_totalprice AS x, o_orderstatus AS st FROM orders)
    SELECT id, 1 AS position, 'double' AS name, 'succeeded' AS status, CAST(id * 2 AS VARCHAR) AS output, NULL AS error FROM r
    UNION ALL SELECT id, 2, 'check', CASE WHEN st = 'P' THEN 'failed' ELSE 'succeeded' END, CASE WHEN st <> 'P' THEN CAST(id * 2 + 1 AS VARCHAR) END, CASE WHEN st = 'P' THEN 'pending' END FROM r
    UNION ALL SELECT id, 3, 'total', CASE WHEN st = 'P' THEN 'skipped' ELSE 'succeeded' END, CASE WHEN st <> 'P' THEN CAST(id * 4 + 1 AS VARCHAR) END, NULL FROM r""")
def u1(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.struct("o_orderkey", "o_orderstatus").alias("input"))
    none = F.lit(None).cast("string")
    return op.run_steps(orders, [
        ("double", lambda x, previous, steps: (x["o_orderkey"] * 2, none)),
        ("check", lambda x, previous, steps: (previous.try_cast("long") + 1, F.when(x["o_orderstatus"] == "P", "pending"))),
        ("total", lambda x, previous, steps: (steps["double"].try_cast("long") + previous.try_cast("long"), none)),
    ])
