"""Preference formatting with DataFrame functions only.

Chosen and rejected are conversations, each an array of (role, text) turns.  Their longest common
prefix of turns is rendered once, as the prompt; what follows in each is a completion, with the
spans of its assistant turns (content and end mark) as the mask that the loss is taken over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def render_turn(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render_turn), "")


def _mask(turns: Column, learn: str) -> Column:
    """Spans start:end, in characters of the rendered turns, of what turns of the role ``learn`` say."""

    def add(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(turn["role"]) + F.lit(len(OPEN) + 1)
        end = start + F.length(turn["text"]) + F.lit(len(CLOSE) - 1)
        span = F.struct(start.alias("start"), end.alias("end"))
        spans = F.when(turn["role"] == learn, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    empty = F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int>>))")
    return F.reduce(turns, empty, add, lambda s: s["spans"])


def format_pairs(pairs: DataFrame, *, chosen: str = "chosen", rejected: str = "rejected", learn: str = "assistant") -> DataFrame:
    """Replaces the two turn arrays by n_common, prompt, two completions and two masks.

    A null role is 'user', a null text is empty, a null array is a conversation without turns.  Equal
    conversations are all prompt, with two empty completions.  Other columns stay, but for ones that are
    named as a result.
    """
    plain = lambda c: F.transform(F.coalesce(F.col(c), F.expr("cast(array() as array<struct<role:string,text:string>>)")), lambda t: F.struct(F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    out = ["n_common", "prompt", "chosen_completion", "rejected_completion", "chosen_mask", "rejected_mask"]
    df = pairs.withColumns({"_chosen": plain(chosen), "_rejected": plain(rejected)}).drop(chosen, rejected, *out)
    a, b = F.col("_chosen"), F.col("_rejected")
    first_other = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    df = df.withColumn("n_common", F.when(first_other > 0, first_other - 1).otherwise(F.size(a)).cast("int"))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    return df.withColumns({"prompt": _render(F.slice(a, 1, F.col("n_common"))), "chosen_completion": _render(rest(a)), "rejected_completion": _render(rest(b)), "chosen_mask": _mask(rest(a), learn), "rejected_mask": _mask(rest(b), learn)}).drop("_chosen", "_rejected")


def _until_reply(conversations: DataFrame, learn: str) -> DataFrame:
    """conv_id and chosen, the turns up to the last one of the role ``learn``; conversations without one drop out."""
    turns = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    size = F.size("turns")
    from_end = F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), learn)
    return turns.where(from_end > 0).select("conv_id", F.transform(F.slice("turns", F.lit(1), (size - from_end + 1).cast("int")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("chosen"))


def swapped_replies(conversations: DataFrame, learn: str = "assistant") -> DataFrame:
    """Pairs from single conversations: each up to its last assistant turn, and the same with another's reply.

    The rejected reply is the last assistant turn of the conversation with the id's lowest bit flipped; without
    one, the rejected conversation ends before the reply.  Conversations without an assistant turn, and rows
    with a null conv_id, make no pair.  Turns are in the order of (turn, role, text), nulls first.
    """
    kept = _until_reply(conversations, learn)
    reply = kept.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.element_at("chosen", -1).alias("_reply"))
    before = F.slice("chosen", F.lit(1), F.size("chosen") - 1)
    return kept.join(reply, "conv_id", "left").select("conv_id", "chosen", F.when(F.col("_reply").isNull(), before).otherwise(F.concat(before, F.array("_reply"))).alias("rejected"))


def swapped_endings(conversations: DataFrame, keep: int = 2, learn: str = "assistant") -> DataFrame:
    """Pairs that part early: each conversation as above, and its first ``keep`` turns with the later turns of the other.

    Without the other, the rejected conversation is the first turns alone.
    """
    kept = _until_reply(conversations, learn)
    other = kept.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.slice("chosen", keep + 1, F.greatest(F.size("chosen") - keep, F.lit(0))).alias("_later"))
    none = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    return kept.join(other, "conv_id", "left").select("conv_id", "chosen", F.concat(F.slice("chosen", 1, keep), F.coalesce("_later", none)).alias("rejected"))


def mask_text(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Both kinds of pairs; the common prefix is counted turn by turn.
ORACLE = """
WITH latest AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
k AS (SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS i, c.role, c.text FROM conversations c JOIN latest l ON c.conv_id = l.conv_id AND c.turn <= l.turn),
n AS (SELECT conv_id, max(i) AS n FROM k GROUP BY conv_id),
rejected AS (SELECT 'reply' AS pair, k.conv_id, k.i, k.role, k.text FROM k JOIN n USING (conv_id) WHERE i < n
   UNION ALL SELECT 'reply', n.conv_id, n.n, o.role, o.text FROM n JOIN n m ON m.conv_id = xor(n.conv_id, 1) JOIN k o ON o.conv_id = m.conv_id AND o.i = m.n
   UNION ALL SELECT 'ending', conv_id, i, role, text FROM k WHERE i <= 2
   UNION ALL SELECT 'ending', xor(conv_id, 1), i, role, text FROM k WHERE i > 2 AND xor(conv_id, 1) IN (SELECT conv_id FROM n)),
numbered AS (SELECT pair, conv_id, row_number() OVER (PARTITION BY pair, conv_id ORDER BY i) AS i, role, text FROM rejected),
chosen AS (SELECT p.pair, k.* FROM k, (VALUES ('reply'), ('ending')) p(pair)),
part AS (SELECT c.pair, c.conv_id, min(c.i) - 1 AS common FROM chosen c LEFT JOIN numbered r ON r.pair = c.pair AND r.conv_id = c.conv_id AND r.i = c.i WHERE r.i IS NULL OR r.role <> c.role OR r.text <> c.text GROUP BY 1, 2),
p AS (SELECT q.pair, n.conv_id, coalesce(part.common, n.n) AS common FROM n CROSS JOIN (VALUES ('reply'), ('ending')) q(pair) LEFT JOIN part ON part.pair = q.pair AND part.conv_id = n.conv_id),
said AS (SELECT 'c' AS side, pair, conv_id, i, role, text, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS said FROM chosen UNION ALL SELECT 'r', pair, conv_id, i, role, text, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) FROM numbered),
late AS (SELECT side, s.pair, s.conv_id, i, role, text, said, sum(length(said)) OVER (PARTITION BY side, s.pair, s.conv_id ORDER BY i) - length(said) + 13 + length(role) AS start FROM said s JOIN p ON p.pair = s.pair AND p.conv_id = s.conv_id WHERE i > common),
done AS (SELECT side, pair, conv_id, string_agg(said, '' ORDER BY i) AS text, string_agg(start || ':' || (start + length(text) + 10), ',' ORDER BY i) FILTER (WHERE role = 'assistant') AS mask FROM late GROUP BY 1, 2, 3)
SELECT p.pair, p.conv_id, CAST(common AS INTEGER) AS n_common, coalesce((SELECT string_agg(said, '' ORDER BY i) FROM said s WHERE s.side = 'c' AND s.pair = p.pair AND s.conv_id = p.conv_id AND s.i <= common), '') AS prompt,
   coalesce(c.text, '') AS chosen_completion, coalesce(r.text, '') AS rejected_completion, coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM p LEFT JOIN done c ON c.side = 'c' AND c.pair = p.pair AND c.conv_id = p.conv_id LEFT JOIN done r ON r.side = 'r' AND r.pair = p.pair AND r.conv_id = p.conv_id
"""
