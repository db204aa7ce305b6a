"""Queries on logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlake.operators import logs as op
from loomlake.plans.tables import cte, load
from loomlake.registry import query


@query("a10_request_metrics", cte("request_log") + "SELECT method, route, status, count(*) AS requests, count(*) FILTER (WHERE status >= 500) AS errors, " + ", ".join(f"quantile_disc(duration_s, {q}) AS {n}" for n, q in op.PERCENTILES.items()) + ", " + ", ".join(f"count(*) FILTER (WHERE duration_s <= {b}) AS le_{str(b).replace('.', '_')}" for b in op.BOUNDS) + " FROM request_log GROUP BY method, route, status")
def a10(spark, sf_dir):
    return op.request_metrics(load(spark, sf_dir, "request_log"), ["method", "route", "status"])


@query("a10_duration_sketches", cte("request_log") + "SELECT method, route, status, count(*) AS requests, count(*) FILTER (WHERE status >= 500) AS errors, true AS close FROM request_log GROUP BY 1, 2, 3")
def a10_sketches(spark, sf_dir):
    """Sketches of every day put together: whether the share of requests below each percentile drawn from them is off by less than 2 %."""
    log, key = load(spark, sf_dir, "request_log"), ["method", "route", "status"]
    days = op.duration_sketches(log.withColumn("day", F.to_date("ts")), [*key, "day"])
    found = op.quantiles(op.merge_sketches(days, key), op.PERCENTILES)
    near = [(F.avg((F.col("duration_s") < F.col(n)).cast("double")) - 0.02 <= q) & (F.avg((F.col("duration_s") <= F.col(n)).cast("double")) + 0.02 >= q) for n, q in op.PERCENTILES.items()]
    close = log.join(found.select(*key, *op.PERCENTILES), key).groupBy(*key).agg((near[0] & near[1] & near[2]).alias("close"))
    return found.select(*key, "requests", "errors").join(close, key)


_NOW = "2024-01-30 12:00:00"


@query("t2_delivery_states", cte("delivery_log") + f"""SELECT message_id, attempts, CASE WHEN acked THEN 'done' WHEN NOT last <= TIMESTAMP '{_NOW}' - INTERVAL 120 SECOND THEN 'pending' WHEN attempts >= 5 THEN 'dropped' ELSE 'reclaimable' END AS state
    FROM (SELECT message_id, count(*) AS attempts, max(attempt_ts) AS last, bool_or(acked) AS acked FROM delivery_log GROUP BY message_id) x""")
def t2(spark, sf_dir):
    return op.deliveries(load(spark, sf_dir, "delivery_log"), F.lit(_NOW).cast("timestamp_ntz"))


@query("c8_log_parsing", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 't' || user_id AS trace_id, 'user ' || user_id || ' said "' || event_type || '"' AS msg FROM events WHERE event_id % 3 <> 0""")
def c8(spark, sf_dir):
    """Lines as a service writes them (debug ones are every third), parsed and filtered by level."""
    return _said(spark, sf_dir)


@query("c8_trace_correlation", """WITH l AS (SELECT 't' || user_id AS trace_id, count(*) AS lines, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events WHERE event_id % 3 <> 0 GROUP BY 1),
    r AS (SELECT 't' || (user_id + 3) AS trace_id, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS failed, max(value / 100) AS slowest FROM events GROUP BY 1)
    SELECT trace_id, coalesce(lines, 0) AS lines, coalesce(errors, 0) AS errors, coalesce(requests, 0) AS requests, coalesce(failed, 0) AS failed, slowest FROM l FULL OUTER JOIN r USING (trace_id)""")
def c8_traces(spark, sf_dir):
    """Log lines and requests by trace; some traces are of one side only."""
    requests = load(spark, sf_dir, "request_log").withColumn("trace_id", F.concat(F.lit("t"), (F.col("trace_id") + 3).cast("string")))
    return op.by_trace(_said(spark, sf_dir), requests)


def _said(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    level = F.when(F.col("event_id") % 3 == 0, "DEBUG").when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = F.concat(F.lit("["), F.col("ts").cast("string"), F.lit("] ("), level, F.lit(") trace_id=t"), F.col("user_id").cast("string"), F.lit(' note="a b=c" empty="" msg="user '), F.col("user_id").cast("string"), F.lit(' said \\"'), F.col("event_type"), F.lit('\\""'))
    parsed = e.select("event_id", line.alias("line")).select("event_id", *[c.alias(n) for n, c in op.parse_line(F.col("line")).items()])
    return parsed.where(op.at_least(F.col("level"), "INFO")).select("event_id", "level", F.col("fields")["trace_id"].alias("trace_id"), F.col("fields")["msg"].alias("msg"))
