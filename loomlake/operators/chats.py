"""Conversations, chat events and tool calls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions.text import file_format, trimmed


def rounds(calls: DataFrame, key: list[str], order: list[str], turn: str = "turn") -> DataFrame:
    """Adds ``round``: runs of consecutive calls with equal turn (islands), from 1; a missing turn is 0."""
    w = Window.partitionBy(*key).orderBy(*order)
    t = F.coalesce(F.col(turn), F.lit(0))
    starts = F.when(t.eqNullSafe(F.lag(t).over(w)), 0).otherwise(1)
    return calls.withColumn("_start", starts).withColumn("round", F.sum("_start").over(w).cast("int")).drop("_start")


def split_text(events: DataFrame, key: str = "request_id", order: str = "seq") -> DataFrame:
    """Text of each request by the tool round that follows it; the last part, before no round, is the answer.

    A round begins with the first tool call after text.  Rows: key, part (from 0), is_answer, text.
    """
    w = Window.partitionBy(key).orderBy(order)
    call = F.col("event") == "toolCall"
    talk = F.col("event") == "message"
    kept = events.where(call | talk)
    prev = F.lag("event").over(w)
    marked = kept.withColumn("_new", F.when(talk & (prev == "toolCall"), 1).otherwise(0)).withColumn("part", F.sum("_new").over(w))
    parts = marked.groupBy(key, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(talk, F.struct(order, "data")))), lambda x: x["data"]), "").alias("text"), F.bool_or(call).alias("_called"))
    return parts.select(key, F.col("part").cast("int").alias("part"), (~F.col("_called")).alias("is_answer"), "text")


def correlate(calls: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Calls with their results; calls without one and results without a call stay."""
    return calls.join(results, key, "full_outer")


def grounded(messages: DataFrame, key: str = "conv_id", order: str = "position") -> DataFrame:
    """Assistant replies, and whether the user message that each answers carried attachments."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.struct(F.col("attachment").isNotNull().alias("a"))), ignorenulls=True).over(before)
    return messages.withColumn("grounded", F.coalesce(asked["a"], F.lit(False))).where("role = 'assistant'")


#: Uses of a key beyond which its walk is cut into runs.
LONG_WALK = 1_000_000


def throttle(uses: DataFrame, key: str, at: str, seconds: int = 300, long_walk: int = LONG_WALK) -> DataFrame:
    """(key, at) of the uses that are kept of each key: at least so long after the last kept one.

    One shuffle brings a key's uses together in order, and a task walks through them with the last kept use alone in memory.
    A key with more than ``long_walk`` uses is cut into runs first, which are walked through apart: a use that comes ``seconds`` or more after
    the one before it is kept in any case, so it doesn't depend on earlier ones.  Uses at one moment are one; rows with a null
    key or moment drop out.
    """
    micros = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', cast({at} as timestamp_ntz))")
    gap = seconds * 1_000_000
    rows = uses.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, micros.alias("_us"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = last = None
        for batch in batches:
            keys = pa.chunked_array([batch.column(0)]).combine_chunks()
            us, run = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            n, keep = len(us), np.zeros(len(us), bool)
            codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cut = np.append(np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (run[1:] != run[:-1]))), n) if n else []
            for a, b in zip(cut[:-1], cut[1:]):
                if (mine := (keys[int(a)].as_py(), int(run[a]))) != current:
                    current, last = mine, None
                i = int(a) if last is None else int(a + np.searchsorted(us[a:b], last + gap))
                while i < b:
                    keep[i], last = True, int(us[i])
                    i = int(a + np.searchsorted(us[a:b], last + gap))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in (0, 1)], names=[key, at])

    def walked(runs: DataFrame, *by: str) -> DataFrame:
        return runs.select(key, at, "_us", "_run").repartition(key, *by).sortWithinPartitions(key, *by, "_us").mapInArrow(walk, uses.select(key, at).schema)

    long = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > long_walk).select("_key")
    if long.isEmpty():
        return walked(rows.withColumn("_run", F.lit(0).cast("long")))
    same = F.col(key) == F.col("_key")
    short = walked(rows.join(long, same, "left_anti").withColumn("_run", F.lit(0).cast("long")))
    return short.unionAll(walked(_runs(rows.join(long, same, "left_semi"), key, gap), "_run"))


def _runs(rows: DataFrame, key: str, gap: int, block: int = 86_400) -> DataFrame:
    """Adds ``_run``, the first use of the run that a use belongs to.

    The uses before are found in blocks of ``block`` seconds, and only one row a block meets its key's others.
    """
    rows = rows.withColumn("_block", F.floor(F.col("_us") / (block * 1_000_000)))
    own = Window.partitionBy(key, "_block").orderBy("_us")
    rows = rows.withColumn("_far", F.col("_us") - F.lag("_us").over(own) >= gap)
    blocks = rows.groupBy(key, "_block").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.max(F.when(F.col("_far"), F.col("_us"))).alias("_inner"))
    of_key = Window.partitionBy(key).orderBy("_block")
    before = F.lag("_last").over(of_key)
    blocks = blocks.withColumn("_opens", before.isNull() | (F.col("_first") - before >= gap))
    # A run goes by its first use: the last that begins one in the block so far, or else in the blocks before.
    start = F.coalesce("_inner", F.when(F.col("_opens"), F.col("_first")))
    blocks = blocks.withColumn("_carried", F.last(start, ignorenulls=True).over(of_key.rowsBetween(Window.unboundedPreceding, -1)))
    begins = F.col("_far") | (F.col("_opens") & (F.col("_us") == F.col("_first")))
    here = F.last(F.when(begins, F.col("_us")), ignorenulls=True).over(own)
    return rows.join(blocks, [key, "_block"]).withColumn("_run", F.coalesce(here, "_carried"))


def replay(messages: DataFrame, calls: DataFrame, bindings: DataFrame) -> DataFrame:
    """Messages with past tool rounds played back: conv_id, position, round, part, role, content, tool_uses.

    For each message with calls: per round an assistant message with the uses (part 0) and a user message with
    the results (part 1), then the answer (a round after the last).  Calls of tools that aren't bound drop out;
    with none left the message stays whole.  Blank arguments are ``{}``.
    """
    key = ["conv_id", "position"]
    numbered = rounds(calls, key, ["ordinal"])
    known = numbered.join(bindings, ["server_id", "tool"], "left")
    bound = F.col("advertised").isNotNull()
    use = F.struct("ordinal", "tool_use_id", F.col("advertised").alias("name"), F.when(F.coalesce("arguments", F.lit("")) == "", "{}").otherwise(F.col("arguments")).alias("arguments"))
    result = F.struct("ordinal", "tool_use_id", F.col("content").alias("name"), F.coalesce(F.col("is_error").cast("string"), F.lit("false")).alias("arguments"))
    by_round = known.groupBy(*key, "round").agg(
        F.array_sort(F.collect_list(F.when(bound, use))).alias("uses"),
        F.array_sort(F.collect_list(F.when(bound, result))).alias("results"),
        F.max(F.when(F.coalesce("text", F.lit("")) != "", F.struct("ordinal", "text")))["text"].alias("said"),
    ).where(F.size("uses") > 0)
    plain = F.lit("").cast("string")
    uses = by_round.join(messages.select(*key, "role"), key).select(*key, "round", F.lit(0).alias("part"), "role", F.coalesce("said", plain).alias("content"), F.to_json("uses").alias("tools"))
    results = by_round.select(*key, "round", F.lit(1).alias("part"), F.lit("user").alias("role"), plain.alias("content"), F.to_json("results").alias("tools"))
    replayed = by_round.select(*key).distinct().withColumn("_some", F.lit(True))
    rest = messages.join(replayed, key, "left").where((F.coalesce("content", plain) != "") | F.col("_some").isNull())
    answer = rest.select(*key, F.lit(1 << 30).alias("round"), F.lit(0).alias("part"), "role", "content", F.lit(None).cast("string").alias("tools"))
    return uses.unionAll(results).unionAll(answer)


def summaries(messages: DataFrame, title: Column) -> DataFrame:
    """Messages of each conversation, and a title from its first user message."""
    first = F.min(F.when(F.col("role") == "user", F.struct("position", "content")))["content"]
    return messages.groupBy("conv_id").agg(F.count("*").alias("message_count"), first.alias("_first")).withColumn("title", title).drop("_first")


def counts(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Messages of each conversation and its last turn."""
    return messages.groupBy(key).agg(F.count("*").alias("message_count"), F.max(order).alias("last_turn"))


def usage(replies: DataFrame, key: str = "request_id", order: str = "seq") -> DataFrame:
    """Tokens of each request over all of its replies, and why the last one stopped."""
    return replies.groupBy(key).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.max_by("stop_reason", order).alias("stop_reason"))


def refused_attachments(files: DataFrame, messages: DataFrame, key: str = "conv_id", order: str = "position", most: int = 5, most_bytes: int = 4_500_000) -> DataFrame:
    """Conversations with files, and the first reason against them (null: admitted).

    ``files``: key, order, filename, data (base64).  Reasons: too many files, no user message, and of each file in
    order an unsupported type, data that isn't base64, is empty or too large.
    """
    users = messages.groupBy(key).agg(F.bool_or(F.col("role") == "user").alias("_user"))
    numbers = files.groupBy(key).agg(F.count("*").alias("_files"))
    raw = F.try_to_binary("data", F.lit("base64"))
    reason = (
        F.when(F.col("_files") > most, "0 too many files").when(~F.coalesce("_user", F.lit(False)), "1 no user message").when(file_format(F.col("filename")).isNull(), "2 unsupported type")
        .when(raw.isNull(), "3 not base64").when(F.octet_length(raw) == 0, "4 empty").when(F.octet_length(raw) > most_bytes, "5 too large")
    )
    judged = files.join(numbers, key).join(users, key, "left").withColumn("reason", reason)
    return judged.groupBy(key).agg(F.min(F.when(F.col("reason").isNotNull(), F.struct(order, "reason")))["reason"].alias("reason"))


def document_name(filename: Column, place: Column) -> Column:
    """The name that a file gets as a document of a request: its own without folder and extension, made of ASCII letters and digits, dashes, brackets
    and single blanks (for blanks, dots and underscores), ``document-n`` by its place if nothing is left; other characters go.
    """
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(filename, F.lit("")), "^.*/", ""), r"\.[^.]*$", "")
    clean = F.trim(F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9\-()\[\] _.]", ""), "[ _.]+", " "))
    return F.when(clean == "", F.concat(F.lit("document-"), place.cast("string"))).otherwise(clean)


def admitted_documents(files: DataFrame, refusals: DataFrame, key: str = "conv_id", order: str = "position") -> DataFrame:
    """The files of the conversations that ``refused_attachments`` has nothing against: key, order, name, format, bytes."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    good = files.join(refusals.where("reason is null").select(key), key, "left_semi").withColumn("_place", place)
    return good.select(key, order, document_name(F.col("filename"), F.col("_place")).alias("name"), file_format(F.col("filename")).alias("format"), F.octet_length(F.unbase64("data")).cast("long").alias("bytes"))


def request_verdict(requests: DataFrame, most_bytes: int = 262_144, most_files: int = 5) -> Column:
    """'ok' or the first thing wrong with a request: role, content, agent, model (blank or null: none) and number of files."""
    have = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return (
        F.when(F.coalesce(trimmed(F.col("content")), F.lit("")) == "", "blank content").when(~F.coalesce("role", F.lit("")).isin("user", "assistant"), "role").when(F.octet_length("content") > most_bytes, "too large")
        .when(~have("agent") & ~have("model"), "no agent or model").when(have("agent") & have("model"), "agent and model").when(F.coalesce("files", F.lit(0)) > most_files, "too many files").otherwise("ok")
    )
