"""Token counts of fields or sections, from one encoding of each whole document.

A document is encoded once; the running sum of its tokens' byte lengths gives every token's span.
The sorted token spans and the sorted section spans are interval-joined by binary search, and a
token that crosses a boundary goes by an explicit rule:

* ``start``: to the section that holds its first byte;
* ``majority``: to the section that holds most of its bytes, the earlier one if equal;
* ``split``: to each section in proportion to its bytes there.

Documents are independent: one pass, no shuffle.  Memory is in proportion to one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomlake.llm.common import tidy, utf8
from loomlake.llm.tokens import byte_ranks

RULES = ("start", "majority", "split")
_KIND = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("tokens", pa.float64()), ("crossing", pa.int64())])
_ROWS = "doc_id long, section int, byte_start long, byte_end long, char_start long, char_end long, tokens double, crossing long"


def line_starts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sections that are lines, each with its line end."""
    at = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x0A) + 1
    starts = np.concatenate([[0], at[at < len(data)]]).astype(np.int64)
    return starts, np.append(starts[1:], len(data))


def attribute(token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of its bytes' tokens begin there and end beyond it.

    Sections are disjoint, sorted and not empty; bytes between them belong to none.  Tokens cover the text.
    """
    token_starts = np.concatenate([[0], token_ends[:-1]]).astype(np.int64)
    n = len(starts)
    first = np.searchsorted(starts, token_starts, "right") - 1  # the last section that begins at or before the token
    inside = (first >= 0) & (token_starts < ends[np.maximum(first, 0)])
    crosses = inside & (token_ends > ends[np.maximum(first, 0)])
    counts = np.bincount(first[inside & ~crosses], minlength=n).astype(float) if n else np.zeros(0)
    crossing = np.bincount(first[crosses], minlength=n) if n else np.zeros(0, np.int64)
    # Tokens that begin in no section may still reach into one.
    late = np.flatnonzero(~inside & (np.searchsorted(starts, token_ends, "left") - 1 > first)) if n else np.zeros(0, np.int64)
    for t in np.concatenate([np.flatnonzero(crosses), late]).tolist():
        a, b = int(token_starts[t]), int(token_ends[t])
        s = max(int(first[t]), 0)
        shares = {}
        while s < n and starts[s] < b:
            if (size := min(b, int(ends[s])) - max(a, int(starts[s]))) > 0:
                shares[s] = size
            s += 1
        if rule == "start":
            if inside[t]:
                counts[first[t]] += 1
        elif rule == "majority":
            best = max(shares, key=lambda s: (shares[s], -s))
            if shares[best] >= (b - a) - sum(shares.values()):
                counts[best] += 1
        else:
            for s, size in shares.items():
                counts[s] += size / (b - a)
    return counts, crossing


def count_tokens(docs: DataFrame, ranks: str, pattern: str, rule: str = "start", sections: str | None = None) -> DataFrame:
    """A row for each section of each document: its place, its tokens and how many tokens cross its end.

    ``sections`` names a column of ``array<struct<start,end>>`` in bytes of the UTF-8 text, disjoint and
    sorted; without one, sections are lines.  Sections are numbered by their places in the list, from 0.  A null or
    empty text has no lines and so no rows; with given sections those count 0 tokens.  A null section list gives no
    rows, nor does a section that is null or has a null end; an empty section counts 0 tokens, and what lies beyond the
    text's end holds nothing.  Repeated documents give repeated rows; other columns are dropped.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches):
        encoding, sizes = byte_ranks(ranks, pattern)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            given = batch.column(2).to_pylist() if sections else None
            parts = []
            for k, data in enumerate(texts):
                data = data or b""
                if given is not None:
                    spans = [(n, s["start"], s["end"]) for n, s in enumerate(given[k] or []) if s is not None and s["start"] is not None and s["end"] is not None]
                    numbers, starts, ends = (np.array([x[j] for x in spans], np.int64) for j in range(3))
                elif data:
                    starts, ends = line_starts(data)
                    numbers = np.arange(len(starts))
                else:
                    continue
                if not len(starts):
                    continue
                token_ends = np.cumsum(sizes[np.array(encoding.encode_ordinary(data.decode()), np.int64)]) if data else np.zeros(0, np.int64)
                tokens, crossing = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
                full = starts < ends
                if len(token_ends) and full.any():
                    tokens[full], crossing[full] = attribute(token_ends, starts[full], ends[full], rule)
                goes_on = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80)  # bytes that begin no character
                at = lambda x: (y := np.clip(x, 0, len(data))) - np.searchsorted(goes_on, y)
                parts.append((np.full(len(starts), ids[k]) if ids[k] is not None else None, numbers, starts, ends, at(starts), at(ends), tokens, crossing))
            columns = []
            for j, f in enumerate(_KIND):
                pieces = [pa.array(p[j]).cast(f.type) if p[j] is not None else pa.nulls(len(p[1]), f.type) for p in parts]
                columns.append(pa.chunked_array(pieces, f.type).combine_chunks() if pieces else pa.array([], f.type))
            yield pa.RecordBatch.from_arrays(columns, schema=_KIND)

    columns = ["doc_id", "text", sections] if sections else ["doc_id", "text"]
    return docs.select(*columns).mapInArrow(tidy(count), _ROWS)
