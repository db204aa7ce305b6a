"""Workflow steps, runs and executions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def propagate_skips(runs: DataFrame, key: str = "execution_id", order: str = "position") -> DataFrame:
    """After a failed step every later one is 'skipped', without output."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    skipped = F.coalesce(F.max(F.col("status") == "failed").over(before), F.lit(False))
    return runs.withColumn("_skip", skipped).withColumns({"status": F.when(F.col("_skip"), "skipped").otherwise(F.col("status")), "output": F.when(F.col("_skip"), None).otherwise(F.col("output"))}).drop("_skip")


def contexts(runs: DataFrame, key: str = "execution_id", order: str = "position", name: str = "name") -> DataFrame:
    """Adds what a step sees: ``previous``, the last output that succeeded before it, and ``earlier``, a map of name to output of all that did.

    Of two earlier steps with one name the later counts.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    good = F.col("status") == "succeeded"
    pairs = F.collect_list(F.when(good, F.struct(F.col(order).alias("p"), F.col(name).alias("k"), F.col("output").alias("v")))).over(before)
    last = F.transform(F.array_distinct(F.transform("_pairs", lambda x: x["k"])), lambda k: F.struct(k.alias("k"), F.element_at(F.filter("_pairs", lambda x: x["k"] == k), -1)["v"].alias("v")))
    return runs.withColumns({"previous": F.last(F.when(good, F.col("output")), ignorenulls=True).over(before), "_pairs": pairs}).withColumn("earlier", F.map_from_entries(last)).drop("_pairs")


def roll_up(runs: DataFrame, key: str = "execution_id", order: str = "position", name: str = "name") -> DataFrame:
    """Status, output and error of each execution from its step runs; the error names the first step that failed, and why."""
    failed = F.col("status") == "failed"
    g = runs.groupBy(key).agg(F.bool_or(failed).alias("_failed"), F.max_by("output", order).alias("_last"), F.min(F.when(failed, F.struct(order, name, "error"))).alias("_at"), F.count("*").alias("steps"))
    error = F.concat(F.lit('step "'), F.col("_at")[name], F.lit('" failed: '), F.coalesce(F.col("_at")["error"], F.lit("")))
    return g.select(key, "steps", F.when(F.col("_failed"), "failed").otherwise("succeeded").alias("status"), F.when(~F.col("_failed"), F.col("_last")).alias("output"), F.when(F.col("_failed"), error).alias("error"))


def admit(messages: DataFrame, records: DataFrame) -> DataFrame:
    """Executions to run: asked for at least once, recorded and still queued."""
    return messages.select("id").dropDuplicates(["id"]).join(records.where("status = 'queued'"), "id")


def agent_ids(steps: Column) -> Column:
    """Distinct agents of an array of steps, in the order of first use."""
    return F.array_distinct(F.transform(F.filter(steps, lambda s: (s["type"] == "agent") & (s["agent_id"] != "")), lambda s: s["agent_id"]))


def step_errors(steps: DataFrame, workflows: DataFrame | None = None, max_steps: int = 25, max_code: int = 64 * 1024) -> DataFrame:
    """The first thing wrong with each workflow (null: nothing): workflow_id, error.

    ``steps``: workflow_id, position (from 1), name, type, agent_id, prompt, code; blanks are empty strings.  ``workflows``
    (workflow_id) names those that there are, so that one without steps is found.
    """
    w = Window.partitionBy("workflow_id")
    same = Window.partitionBy("workflow_id", "name").orderBy("position")
    name, kind = F.col("name"), F.col("type")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    error = (
        F.when(F.count("*").over(w) > max_steps, "too many steps")
        .when(blank("name"), "no name")
        .when(~name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), "bad name")
        .when(F.row_number().over(same) > 1, "name used twice")
        .when((kind == "agent") & blank("agent_id"), "no agent")
        .when((kind == "agent") & ~blank("code"), "agent step with code")
        .when((kind == "agent") & blank("prompt"), "no prompt")
        .when((kind == "code") & blank("code"), "no code")
        .when((kind == "code") & (F.octet_length("code") > max_code), "too much code")
        .when((kind == "code") & (~blank("agent_id") | ~blank("prompt")), "code step with agent")
        .when(~F.coalesce(kind, F.lit("")).isin("agent", "code"), "unknown type")
    )
    found = steps.withColumn("error", error).groupBy("workflow_id").agg(F.min(F.when(F.col("error").isNotNull(), F.struct("position", "error")))["error"].alias("error"))
    if workflows is None:
        return found
    some = found.withColumn("_some", F.lit(True))
    return workflows.select("workflow_id").distinct().join(some, "workflow_id", "left").select("workflow_id", F.when(F.col("_some").isNull(), "no steps").otherwise(F.col("error")).alias("error"))


def render(template: str, context: Column) -> tuple[Column, Column]:
    """A prompt from a template with ``{{ .Path.of.keys }}`` places, and the error if a key is missing.

    The context is a variant.  A place is its value as text; a JSON null is 'null'.
    """
    parts, missing = [], F.lit(None).cast("string")
    at = 0
    for m in re.finditer(r"\{\{\s*\.([A-Za-z_][\w.]*)\s*\}\}", template):
        path = "$." + m[1]
        value = F.try_variant_get(context, path, "variant")
        parts += [F.lit(template[at : m.start()]), F.coalesce(F.try_variant_get(context, path, "string"), F.when(F.is_variant_null(value), "null"), F.lit(""))]
        missing = F.coalesce(missing, F.when(value.isNull(), F.lit(f"missing {m[1]}")))
        at = m.end()
    text = F.concat(*parts, F.lit(template[at:]))
    error = F.coalesce(missing, F.when(F.octet_length(text) > 262_144, "prompt too large"))
    return F.when(error.isNull(), text), error


def run_steps(inputs: DataFrame, steps: list[tuple[str, Callable[[Column, Column, Column], tuple[Column, Column]]]]) -> DataFrame:
    """Runs named steps over a table of (id, input): each is a function of input, previous and earlier outputs.

    A step gives (output, error); a row with an error skips the rest.  Returns the run log: id, position,
    name, status, output, error.
    """
    df = inputs.withColumns({"_previous": F.lit(None).cast("string"), "_steps": F.expr("cast(map() as map<string,string>)"), "_failed": F.lit(False), "_log": F.expr("cast(array() as array<struct<position:int,name:string,status:string,output:string,error:string>>)")})
    for i, (name, step) in enumerate(steps, 1):
        output, error = step(F.col("input"), F.col("_previous"), F.col("_steps"))
        df = df.withColumns({"_o": output.cast("string"), "_e": error.cast("string")})
        bad = F.col("_e").isNotNull()
        status = F.when(F.col("_failed"), "skipped").when(bad, "failed").otherwise("succeeded")
        good = status == "succeeded"
        df = df.withColumn("_entry", F.struct(F.lit(i).alias("position"), F.lit(name).alias("name"), status.alias("status"), F.when(good, F.col("_o")).alias("output"), F.when(status == "failed", F.col("_e")).alias("error")))
        df = df.withColumns({"_log": F.array_append("_log", F.col("_entry")), "_previous": F.when(good, F.col("_o")).otherwise(F.col("_previous")), "_steps": F.when(good, F.map_concat("_steps", F.create_map(F.lit(name), F.col("_o")))).otherwise(F.col("_steps")), "_failed": F.col("_failed") | bad})
    return df.select("id", F.explode("_log").alias("_l")).select("id", "_l.*")
