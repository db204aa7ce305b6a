"""Request, delivery and structured text logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of duration classes, in seconds.
BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5)
PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
#: Levels, most severe first.
LEVELS = ("ERROR", "WARN", "INFO", "DEBUG")


def request_metrics(log: DataFrame, key: list[str]) -> DataFrame:
    """Requests, errors (status of 500 or more), percentiles of durations (off by a ten-thousandth of the ranks at most) and a histogram (counts up to each bound)."""
    d = F.col("duration_s")
    percentiles = [F.percentile_approx(d, q, 10_000).alias(name) for name, q in PERCENTILES.items()]
    return log.groupBy(*key).agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"), *percentiles, *[F.count_if(d <= b).alias(f"le_{str(b).replace('.', '_')}") for b in BOUNDS])


#: Columns of sketched metrics, and how two rows of one key become one.
SKETCHED = "requests long, errors long, sketch binary"
MERGED = {"requests": "sum", "errors": "sum", "sketch": "kll_merge_agg_double"}


def duration_sketches(log: DataFrame, key: list[str]) -> DataFrame:
    """Requests, errors, and a quantile sketch of the durations of each key; such rows can be put together again and again.

    A sketch has some KB at most however many requests it stands for; quantiles drawn from it are off by less than 2 % of the ranks
    (none, up to about 200 requests).  Null durations aren't in it.
    """
    return log.groupBy(*key).agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"), F.kll_sketch_agg_double(F.col("duration_s").cast("double")).alias("sketch"))


def merge_sketches(rows: DataFrame, key: list[str]) -> DataFrame:
    """Sketched metrics of a coarser key."""
    return rows.groupBy(*key).agg(*[F.expr(f"{f}({c})").alias(c) for c, f in MERGED.items()])


def quantiles(rows: DataFrame, of: dict[str, float]) -> DataFrame:
    """Adds quantiles by name (null where there is no duration)."""
    some = F.kll_sketch_get_n_double("sketch") > 0
    return rows.withColumns({name: F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(q))) for name, q in of.items()}).drop("sketch")


def deliveries(log: DataFrame, now: Column, idle_seconds: int = 120, most: int = 5) -> DataFrame:
    """State of each message: done / dropped (attempts used up) / reclaimable (idle long enough) / pending."""
    g = log.groupBy("message_id").agg(F.count("*").alias("attempts"), F.max("attempt_ts").alias("last_attempt"), F.bool_or("acked").alias("_acked"))
    idle = F.col("last_attempt") <= now - F.expr(f"interval {idle_seconds} seconds")
    state = F.when(F.col("_acked"), "done").when(~idle, "pending").when(F.col("attempts") >= most, "dropped").otherwise("reclaimable")
    return g.select("message_id", "attempts", state.alias("state"))


def parse_line(line: Column) -> dict[str, Column]:
    """Timestamp, level and fields of a line ``[ts] (LEVEL) k=v ... msg="..."``."""
    pairs = F.regexp_extract_all(line, F.lit(r'([A-Za-z_][\w.]*)=("(?:[^"\\]|\\.)*"|[^\s"]+)'), F.lit(0))
    entry = lambda p: F.struct(F.regexp_extract(p, r"^([^=]+)=", 1), F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"^[^=]+=", ""), r'^"|"$', ""), r"\\(.)", "$1"))
    return {"at": F.regexp_extract(line, r"^\[([^\]]*)\]", 1), "level": F.regexp_extract(line, r"\] \((\w+)\)", 1), "fields": F.map_from_entries(F.transform(pairs, entry))}


def by_trace(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """Each trace with what was logged and asked under it: trace_id, lines, errors, requests, failed, slowest (null where there is no request).

    ``lines``: trace_id, level.  ``requests``: trace_id, status, duration_s.  Either side is summed up before they meet, so a busy trace stays one
    row; traces of one side alone are there, lines and requests without a trace aren't.
    """
    said = lines.where("trace_id <> ''").groupBy("trace_id").agg(F.count("*").alias("lines"), F.count_if(F.col("level") == "ERROR").alias("errors"))
    asked = requests.where("trace_id <> ''").groupBy("trace_id").agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("failed"), F.max("duration_s").alias("slowest"))
    none = F.lit(0).cast("long")
    return said.join(asked, "trace_id", "full_outer").select("trace_id", *[F.coalesce(c, none).alias(c) for c in ("lines", "errors", "requests", "failed")], "slowest")


def at_least(level: Column, least: str) -> Column:
    return level.isin(*LEVELS[: LEVELS.index(least) + 1])
