"""Removal of repeated byte strings, by bucket-pointer refinement over sampled suffixes.

A string of ``length`` bytes is repeated if it starts at two places.  Each window of ``length`` bytes is
looked after by one suffix inside it, the one whose ``gram``-byte prefix has the least hash of all in the
window (the rightmost, of equal ones).  Equal windows choose alike, so only chosen suffixes, about two in
every ``length - gram`` bytes, need buckets.

The initial bucket of a suffix is named by the hash of its ``gram`` bytes.  A bucket of twice the depth is
named by the pair of bucket names at p and p + depth; the names of one depth give those of the next
(32, 64, 128, 256 bytes and from those any depth between), recursively.  Names are hashes, so equal
strings have equal names in all tasks and no global renumbering is needed.

Windows of a suffix fall in two families, those that hold a fixed core to its right and those that
hold one to its left.  The refined buckets of cores are sorted: a singleton has no repeated window and is
dropped.  In a bucket, families whose whole reach (all their windows together) is equal are repeated
throughout, and one of them goes on for all.  Those that go on are refined down to ``length`` bytes, one
name for each window; buckets with two or more places are repeated.

Postings travel as packed arrays by hash range.  Before they do, a task puts together the places of a part (100,000
postings) that have one core or one name: what is settled by places within the part needs no meeting, and two
places of a core or one of a name, at most, go to meet those of other parts.  So a string that a third of all
documents share meets in one group with a place or two for each part, not for each document.  A copy of a text within a task is looked at once, and
copies of whole texts are known from their hash; texts travel only if a repeated place is in them.

Passages of so many words are found in the same way: the places of a text are then its words, named by
their hashes, instead of its bytes.

Long texts are looked at in overlapping pieces.  A cut through a family makes two of it, whose windows then go
on by their own names.

Strings and texts are told apart by 64 bits of hash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import bit_set, durable, tidy
from loomlake.llm.mixing import words as count_words
from loomlake.llm.words import U, Words, mix, words

_POST = np.dtype([("core", "<u8"), ("reach", "<u8"), ("text", "<i8"), ("at", "<i8"), ("kind", "<i4"), ("hi", "<i4")])
_NAME = np.dtype([("name", "<u8"), ("text", "<i8"), ("at", "<i8")])
#: A place by itself; one for several of its part; one that shows that its core has gone on already; and places that
#: are settled: repeated, or to go on.
PLAIN, SEVERAL, SHOWN, DONE, TODO = range(5)


#: Postings in a packed part on its way to the shuffle (4 MB at most), and in a bucket range on average.
_PART, _RANGE = 100_000, 200_000

#: Words between ASCII white space, as they are written.
_AS_WRITTEN = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
#: First words of a passage that name its initial bucket.
_WORD_GRAM = 8


def _words(texts: list[bytes]) -> Words:
    return words(texts, _AS_WRITTEN)


#: Bytes of texts that are looked at together, so that arrays made for them stay in the processor's caches.
_SLICE = 1 << 16


#: Bytes of a long text that are looked at together; it is cut into such pieces, which overlap by a string less one place.
_PIECE = 1 << 18


@dataclass
class Piece:
    """A part of a text: the text's index, the part's first place and byte, the place at which no string of it begins any more, and its bytes."""

    text: int
    base: int
    at: int
    stop: int
    data: bytes


def pieces(texts: list[bytes], length: int, in_words: bool = False) -> Iterator[Piece]:
    """The texts, the long ones cut so that each string of ``length`` places begins in one piece and lies in it whole."""
    for i, t in enumerate(texts):
        if len(t) <= 2 * _PIECE:
            yield Piece(i, 0, 0, 1 << 62, t)
        elif not in_words:
            for a in range(0, len(t) - length + 1, _PIECE):
                yield Piece(i, a, a, a + _PIECE, t[a : a + _PIECE + length - 1])
        else:
            yield from _pieces_of_words(i, t, length)


def _pieces_of_words(i: int, t: bytes, length: int) -> Iterator[Piece]:
    at, base, size = 0, 0, _PIECE
    while True:
        blank = _BLANK.search(t, at + size)
        data = t[at : blank.start()] if blank else t[at:]
        starts = _words([data]).starts
        if blank and len(starts) < 2 * length:
            size *= 2  # words are long here
            continue
        more = len(starts) - length + 1
        yield Piece(i, base, at, base + more if blank else 1 << 62, data)
        if not blank:
            return
        at, base, size = at + int(starts[more]) if more < len(starts) else blank.start(), base + more, _PIECE


def slices(texts: list[bytes], length: int, in_words: bool = False) -> Iterator[list[Piece]]:
    """Pieces of about ``_SLICE`` bytes together."""
    now, total = [], 0
    for piece in pieces(texts, length, in_words):
        now.append(piece)
        total += len(piece.data)
        if total >= _SLICE:
            yield now
            now, total = [], 0
    if now:
        yield now


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket name of a string from the names of its two parts."""
    return mix(a * U(0x9E3779B97F4A7C15) + b)


class Ladder:
    """Bucket names of strings of a slice of texts: of all places at depth ``gram`` (32), and deeper where asked.

    Places count through the slice; names that go over a text's end mean nothing.  With ``in_words`` places,
    depths and sizes are words instead of bytes.
    """

    def __init__(self, texts: list[bytes], gram: int, in_words: bool = False):
        if in_words:
            w = _words(texts)
            h, d, self.bounds = w.hashes, 1, w.bounds.astype(np.int64)
        else:
            data = b"".join(texts)
            self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            n = len(data)
            h, d = np.zeros(max(n - 7, 0), U), 8
            for o in range(min(8, len(h))):  # eight bytes are their own name
                h[o::8] = np.frombuffer(data, "<u8", (n - o) // 8, o)
        with np.errstate(over="ignore"):
            while d < gram:
                h, d = _pair(h[: max(len(h) - d, 0)], h[d:]), d * 2
        self.h, self.gram = h, gram

    def deep(self, p: np.ndarray, depth: int) -> np.ndarray:
        """Names at a depth of gram, 2 gram, 4 gram ...: the pair of the names of half that depth."""
        if depth == self.gram:
            return self.h[p]
        return _pair(self.deep(p, depth // 2), self.deep(p + depth // 2, depth // 2))

    def names(self, p: np.ndarray, size: int) -> np.ndarray:
        """Names of the strings of ``size`` bytes: the pair of the deepest names that fit at their two ends."""
        depth = self.gram
        while depth * 2 <= size:
            depth *= 2
        return _pair(self.deep(p, depth), self.deep(p + size - depth, depth))


def chosen(h: np.ndarray, window: int) -> np.ndarray:
    """For each window of so many places, the place of the least hash, the rightmost of equal ones."""
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64)
    key = (h | U(0xFFFFFFFF)) ^ np.arange(n, dtype=U)  # the upper 32 bits of the hash, then later places first
    blocks = -(-n // window)
    padded = np.full(blocks * window, np.iinfo(np.uint64).max, U)
    padded[:n] = key
    grid = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    least = np.minimum(ahead[: n - window + 1], behind[window - 1 : n])
    return ((least & U(0xFFFFFFFF)) ^ U(0xFFFFFFFF)).astype(np.int64)


class Refinement:
    def __init__(self, length: int = 400, gram: int = 32, in_words: bool = False):
        if gram < 8 or gram & (gram - 1) or length < 2 * gram:
            raise ValueError("gram must be a power of two from 8 and at most half the length")
        self.length, self.gram, self.window, self.in_words = length, gram, length - gram + 1, in_words
        self.half = self.window // 2  # windows that begin up to so far before their suffix are its right family

    def families(self, texts: list[bytes]):
        """The text (index), core and reach names, and first and last window (within it) of each family of the texts' windows."""
        ladder = Ladder(texts, self.gram, self.in_words)
        at, bounds = chosen(ladder.h, self.window), ladder.bounds
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        i = np.flatnonzero(text[: len(at)] == text[self.length - 1 :][: len(at)])  # windows within one text
        if not len(i):
            return i, np.zeros(0, U), np.zeros(0, U), i, i
        at = at[i]
        left = at - i > self.half
        new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (left[1:] != left[:-1]) | (i[1:] != i[:-1] + 1)))
        first, last = i[new], i[np.append(new[1:], len(i)) - 1]
        p, left, text = at[new], left[new], text[first]
        with np.errstate(over="ignore"):
            # Right cores begin at the suffix, left cores end with its gram.
            core = np.zeros(len(p), U)
            core[~left] = ladder.names(p[~left], self.length - self.half)
            core[left] = ladder.names(p[left] - self.half - 1, self.half + 1 + self.gram) + U(1)
            # The reach: all windows of the family, and where they lie around the suffix.
            reach = _pair(_pair(ladder.names(first, self.length), ladder.names(last, self.length)), _pair((p - first).astype(U), (p - last).astype(U)))
        return text, core, reach, first - bounds[text], last - bounds[text]


def _unseen(batch: pa.RecordBatch, seen: set[int]) -> list[int]:
    """Rows of a batch whose names (its first column) are new to the task."""
    new = []
    for k, name in enumerate(batch.column(0).to_pylist()):
        if name not in seen:
            seen.add(name)
            new.append(k)
    return new


def _table(rows: np.ndarray, key: str, bits: int, kind: int = PLAIN) -> pa.RecordBatch:
    """Rows by hash range of a key; settled ones, which meet no others, all in one of as many ranges below 0."""
    if kind < DONE:
        bucket = (rows[key] >> U(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
    else:
        bucket = np.full(len(rows), -1 - (int(rows["text"][0]) & ((1 << bits) - 1)) if len(rows) else 0)
    cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(rows)) if len(rows) else np.zeros(1, np.int64)
    pairs = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
    columns = [pa.array([int(bucket[a]) for a, _ in pairs], pa.int64()), pa.array([kind] * len(pairs), pa.int32()), pa.array([rows[a:b].tobytes() for a, b in pairs], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "rows"])


_PACKED = "bucket long, kind int, rows binary"


def _firsts(rows: np.ndarray, *keys: str) -> np.ndarray:
    """Which sorted rows are the first with their values of the keys."""
    new = np.ones(len(rows), bool)
    if len(rows) > 1:
        new[1:] = np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in keys])
    return new


def _part_of_cores(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Postings of a part that have to meet others, and settled ones."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows["at"], rows["text"], rows["reach"], rows["core"]))]
    new_core, new_reach = _firsts(rows, "core"), _firsts(rows, "core", "reach")
    core, reach = np.cumsum(new_core) - 1, np.cumsum(new_reach) - 1
    in_reach = np.bincount(reach)[reach] if len(rows) else reach
    reaches = np.bincount(core[new_reach])[core] if len(rows) else core
    done, one = rows[in_reach > 1].copy(), rows[new_reach].copy()
    done["kind"] = DONE
    # A core with three reaches or more goes on in all of them, and one place shows that to the other parts.
    many = reaches[new_reach] > 2
    one["kind"] = np.where(in_reach[new_reach] > 1, SEVERAL, PLAIN)
    todo, shown = one[many].copy(), rows[new_core & (reaches > 2)].copy()
    todo["kind"], shown["kind"] = TODO, SHOWN
    return np.concatenate([one[~many], shown]), np.concatenate([done, todo])


def _windows(rows: np.ndarray, length: int) -> np.ndarray:
    """Spans (text, at, and the end as name) of windows; neighbouring ones of a text are one."""
    rows = rows[np.lexsort((rows["at"], rows["text"]))]
    new = _firsts(rows, "text")
    new[1:] |= rows["at"][1:] > rows["at"][:-1] + length
    first = np.flatnonzero(new)
    out = rows[first].copy()
    out["name"] = (rows["at"][np.append(first[1:], len(rows)) - 1] + length).astype(U) if len(rows) else 0
    return out


def _part_of_names(parts: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the names of a part: those with one place, one place of those with several, and the spans of the latter."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows["at"], rows["text"], rows["name"]))]
    new = _firsts(rows, "name")
    name = np.cumsum(new) - 1
    several = np.bincount(name)[name] > 1 if len(rows) else new
    return rows[~several], rows[new & several], _windows(rows[several], length)


_SPANS = "text long, s long, e long, todo boolean"


def _spans(text, s, e, todo) -> pd.DataFrame:
    return pd.DataFrame({"text": text, "s": s, "e": e, "todo": todo})


def repeated_spans(named: DataFrame, total_bytes: int, length: int = 400, gram: int = 32, in_words: bool = False) -> DataFrame:
    """(text, s, e): byte spans of repeated strings, of distinct texts; ``named`` has text (its name) and data.

    With ``in_words`` length, gram and spans are words.
    """
    r = Refinement(length, gram, in_words)
    # Bucket ranges hold about so many postings, whatever the corpus, and are many times the partitions of a small one.
    bits = max(9, ceil(log(total_bytes / r.window * 4 / _RANGE + 1, 2)))
    long_enough = named.where(F.octet_length("data") >= (2 * length - 1 if in_words else length))

    def cores(batches):
        def packed():
            open_, settled = _part_of_cores(parts)
            yield _table(open_, "core", bits)
            yield _table(settled, "core", bits, DONE)

        seen, parts, size = set(), [], 0
        for batch in batches:
            new = pa.array(_unseen(batch, seen), pa.int64())
            names, texts = batch.column(0).take(new).to_numpy(), batch.column(1).take(new).to_pylist()
            for group in slices(texts, length, in_words):
                text, core, reach, first, last = r.families([x.data for x in group])
                rows = np.zeros(len(core), _POST)
                rows["core"], rows["reach"], rows["text"] = core, reach, names[[x.text for x in group]][text]
                rows["at"] = first + np.array([x.base for x in group])[text]
                rows["hi"] = last - first
                parts.append(rows)
                size += len(rows)
                if size > _PART:
                    yield from packed()
                    parts, size = [], 0
        if parts:
            yield from packed()

    def refine(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([np.frombuffer(x, _POST) for x in pdf["rows"]])
        settled, shown, rows = rows[rows["kind"] >= DONE], rows["core"][rows["kind"] == SHOWN], rows[rows["kind"] < SHOWN]
        rows = rows[np.lexsort((-rows["kind"], rows["at"], rows["text"], rows["reach"], rows["core"]))]
        # A text that two tasks saw is one place here: its copies are known from the text's name.
        rows = rows[_firsts(rows, "core", "reach", "text", "at")]
        new_core, new_reach = _firsts(rows, "core"), _firsts(rows, "core", "reach")
        core, reach = np.cumsum(new_core) - 1, np.cumsum(new_reach) - 1
        in_reach = (np.bincount(reach) + np.bincount(reach, rows["kind"] == SEVERAL))[reach] if len(rows) else reach
        reaches = np.bincount(core[new_reach])[core] + np.isin(rows["core"], shown) if len(rows) else core
        done = in_reach > 1
        todo = new_reach & (reaches > 1)
        # Families that go on are flagged; their span is of windows' first bytes.
        a = np.concatenate([rows[done], settled[settled["kind"] == DONE]])
        b = np.concatenate([rows[todo], settled[settled["kind"] == TODO]])
        return pd.concat([_spans(a["text"], a["at"], a["at"] + a["hi"] + length, False), _spans(b["text"], b["at"], b["at"] + b["hi"], True)])

    found = durable(long_enough.select("text", "data").mapInArrow(tidy(cores), _PACKED).groupBy("bucket").applyInPandas(refine, _SPANS))
    done = found.where("not todo").select("text", "s", "e")
    todo = found.where("todo").groupBy("text").agg(F.collect_list(F.struct("s", "e")).alias("windows"))
    todo = durable(todo)

    def names(batches):
        def packed():
            single, several, spans = _part_of_names(parts, length)
            yield _table(single, "name", bits)
            yield _table(several, "name", bits, SEVERAL)
            yield _table(spans, "name", bits, DONE)

        seen, parts, size = set(), [], 0
        for batch in batches:
            new = pa.array(_unseen(batch, seen), pa.int64())
            ids, texts, windows = batch.column(0).take(new).to_numpy(), batch.column(1).take(new).to_pylist(), batch.column(2).take(new).to_pylist()
            for group in slices(texts, length, in_words):
                ladder = Ladder([x.data for x in group], gram, in_words)
                places = [np.unique(np.concatenate([np.zeros(0, np.int64), *(np.arange(max(w["s"], x.base), min(w["e"] + 1, x.stop)) for w in windows[x.text])])) for x in group]
                text = np.repeat(np.arange(len(group)), [len(x) for x in places])
                at = np.concatenate(places)
                rows = np.zeros(len(at), _NAME)
                with np.errstate(over="ignore"):
                    rows["name"] = ladder.names(at - np.array([x.base for x in group])[text] + ladder.bounds[text], length)
                rows["text"], rows["at"] = ids[[x.text for x in group]][text], at
                parts.append(rows)
                size += len(rows)
                if size > _PART:
                    yield from packed()
                    parts, size = [], 0
        if parts:
            yield from packed()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        every = [np.concatenate([np.zeros(0, _NAME), *(np.frombuffer(x, _NAME) for x in pdf["rows"][pdf["kind"] == k])]) for k in (PLAIN, SEVERAL, DONE)]
        rows, several = np.concatenate(every[:2]), np.repeat([False, True], [len(every[0]), len(every[1])])
        order = np.lexsort((~several, rows["at"], rows["text"], rows["name"]))
        rows, several = rows[order], several[order]
        once = _firsts(rows, "name", "text", "at")
        rows, several = rows[once], several[once]
        group = np.cumsum(_firsts(rows, "name")) - 1
        if len(rows):
            rows = rows[(np.bincount(group) + np.bincount(group, several))[group] > 1]
        spans = np.concatenate([_windows(rows, length), every[2]])
        return pd.DataFrame({"text": spans["text"], "s": spans["at"], "e": spans["name"].astype(np.int64)})

    again = _among(long_enough.withColumnRenamed("text", "_name"), todo.withColumnRenamed("text", "_name")).withColumnRenamed("_name", "text").join(todo, "text").select("text", "data", "windows")
    last = again.mapInArrow(tidy(names), _PACKED).groupBy("bucket").applyInPandas(meet, "text long, s long, e long")
    return durable(done.unionAll(last))


def _among(named: DataFrame, texts: DataFrame, both: bool = False):
    """The rows of ``named`` whose name may be in ``texts``, by a bit set before any shuffle.

    With ``both``, also the rows whose name surely isn't.
    """
    bits = bit_set(texts, "_name")
    place, shared = bits.place("_name"), named.sparkSession.sparkContext.broadcast(bits)

    def rows_with(bit: int) -> DataFrame:
        def run(batches):
            for batch in batches:
                take = pa.array(np.flatnonzero(shared.value.has(batch.column(batch.num_columns - 1)) == bit))
                yield pa.RecordBatch.from_arrays([c.take(take) for c in batch.columns[:-1]], batch.schema.names[:-1])

        return named.withColumn("_place", place).mapInArrow(tidy(run), named.schema)

    return (rows_with(1), rows_with(0)) if both else rows_with(1)


def _named(docs: DataFrame) -> DataFrame:
    """Adds _data (the UTF-8 bytes) and name (64 bits of hash) of each row's text."""
    return docs.withColumn("_data", F.encode(F.coalesce("text", F.lit("")), "UTF-8")).withColumn("_name", F.xxhash64("_data"))


def merged(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Disjoint spans in order; touching ones are one."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], min(x["e"], size)) for x in spans or []):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _found(light: DataFrame, named: DataFrame, length: int, gram: int, passage: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Names of texts that are repeated in whole, and the spans (a list for each name) of other texts.

    With ``passage``, also the spans of repeated passages of so many words; ``light`` has n_words then.
    """
    total = light.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    texts = named.select(F.col("_name").alias("text"), F.col("_data").alias("data"))
    spans = repeated_spans(texts, total, length, gram).withColumn("in_words", F.lit(False))
    enough = F.col("n_bytes") >= length
    if passage is not None:
        # A word and its blank have about six bytes; that only sets the number of bucket ranges.
        spans = spans.unionAll(repeated_spans(texts, total // 6, passage, _WORD_GRAM, in_words=True).withColumn("in_words", F.lit(True)))
        enough = enough | (F.col("n_words") >= passage)
    whole = durable(light.where(enough).groupBy("sha").agg(F.count("*").alias("m"), F.first("_name").alias("_name")).where("m > 1").select("_name").distinct())
    part = spans.withColumnRenamed("text", "_name").join(whole, "_name", "left_anti")
    return whole, durable(part.groupBy("_name").agg(F.collect_list(F.struct("s", "e", "in_words")).alias("_spans")))


def _total(spans: Column) -> Column:
    """The number of places that spans cover together."""
    step = lambda x, y: F.struct(F.greatest(x["e"], y["e"]).alias("e"), (x["n"] + F.greatest(y["e"] - F.greatest(x["e"], y["s"]), F.lit(0).cast("long"))).alias("n"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("n")), step, lambda x: x["n"])


def digest(docs: DataFrame, length: int = 400, gram: int = 32, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, and with ``passage`` n_passage_words.

    A null text is empty; texts shorter than ``length`` bytes keep everything.  Copies of a text (repeated
    rows too) repeat each other, so all of them lose everything.  Other columns are dropped.
    With ``passage``, n_passage_words counts the words (between ASCII white space) in runs of so many words that
    start anywhere else too, however few bytes those have; it says nothing of what is removed.
    """
    named = _named(docs.select("doc_id", "text"))
    n_words = count_words(F.col("text")) if passage is not None else F.lit(0).cast("long")
    light = durable(named.select("doc_id", "_name", F.sha2("_data", 256).alias("sha"), F.octet_length("_data").cast("long").alias("n_bytes"), n_words.alias("n_words")))
    whole, spans = _found(light, named, length, gram, passage)
    of_bytes = durable(spans.withColumn("_spans", F.filter("_spans", lambda x: ~x["in_words"])).where(F.size("_spans") > 0))
    of_words = spans.select("_name", _total(F.filter("_spans", lambda x: x["in_words"])).alias("_words"))
    sides = light.join(whole.withColumn("whole", F.lit(True)), "_name", "left").join(of_words, "_name", "left")
    copied = F.coalesce("whole", F.lit(False))
    words = F.when(copied & (F.col("n_words") >= (passage or 0)), F.col("n_words")).otherwise(F.coalesce("_words", F.lit(0).cast("long")))
    sides = sides.withColumns({"n_passage_words": words, "_gone": copied & (F.col("n_bytes") >= length)})
    sides = sides.join(of_bytes.select("_name", F.lit(True).alias("part")), "_name", "left")
    w = F.col("_gone")
    rest = sides.where("part is null").select(
        "doc_id",
        "n_bytes",
        F.when(w, F.col("n_bytes")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(w, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(w, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha")).alias("kept_sha256"),
        "n_passage_words",
    )

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, data, spans, words in zip(*(c.to_pylist() for c in batch.columns)):
                gone = merged(spans, len(data))
                rows.append((doc, len(data), sum(e - s for s, e in gone), len(gone), hashlib.sha256(kept(data, gone)).hexdigest(), words))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])

    changed = _among(named, of_bytes).join(of_bytes, "_name").join(of_words, "_name", "left").select("doc_id", "_data", "_spans", F.coalesce("_words", F.lit(0).cast("long")).alias("_words"))
    out = rest.unionAll(changed.mapInArrow(tidy(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long"))
    return out if passage is not None else out.drop("n_passage_words")


def in_bytes(data: bytes, spans: list[dict] | None) -> list[dict]:
    """Spans of bytes, from those of bytes and of words; the blanks between words of a span go with them."""
    passages = merged([x for x in spans or [] if x["in_words"]], 1 << 62)
    if not passages:
        return spans or []
    # The places of the first words and of the ends of passages, piece by piece.
    wanted = sorted({s for s, _ in passages} | {e - 1 for _, e in passages})
    begin, end, n = {}, {}, 0
    for piece in pieces([data], 1, in_words=True):
        w = _words([piece.data])
        stop = min(piece.stop, piece.base + len(w.starts))
        while n < len(wanted) and wanted[n] < stop:
            k = wanted[n] - piece.base
            begin[wanted[n]], end[wanted[n]], n = piece.at + int(w.starts[k]), piece.at + int(w.ends[k]), n + 1
    found = [{"s": begin[s], "e": end[e - 1]} for s, e in passages]
    return [x for x in spans if not x["in_words"]] + found


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 32, passage: int | None = None) -> DataFrame:
    """All rows and columns of ``docs``, the text without the bytes of repeated strings.

    With ``passage``, a run of so many words (between ASCII white space, whichever) that occurs more than
    once goes too, however few bytes it has; a text of so many words that is repeated in whole loses all.
    Every occurrence goes, as in ``digest``; a character of which a byte goes is left out.  Rows without
    repeats, and null texts, stay as they are.  An ``n_chars`` column follows the new text.  Other columns may
    have any names.
    """
    own = docs.columns
    columns = ["text" if c == "text" else f"c{i}" for i, c in enumerate(own)]  # none that the helpers below use
    docs = docs.toDF(*columns)
    named = _named(docs)
    size = F.octet_length("_data").cast("long")
    # Only texts that are too short as bytes are asked for their words.
    n_words = F.when(size < length, count_words(F.col("text"))).otherwise(F.lit(0)) if passage is not None else F.lit(0)
    light = durable(named.select("_name", F.sha2("_data", 256).alias("sha"), size.alias("n_bytes"), n_words.alias("n_words")))
    whole, spans = _found(light, named, length, gram, passage)
    every = durable(spans.unionAll(whole.select("_name", F.expr("array(named_struct('s', 0L, 'e', 1099511627776L, 'in_words', false))"))))
    touched, plain = _among(named, every, both=True)
    hit = touched.join(every, "_name", "left").drop("_data", "_name")

    def cut(batches):
        for batch in batches:
            texts = [t if spans is None or t is None else kept(d := t.encode(), merged(in_bytes(d, spans), len(d))).decode(errors="ignore") for t, spans in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns], columns)

    out = plain.drop("_data", "_name").unionAll(hit.mapInArrow(tidy(cut), docs.schema)).toDF(*own)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in own else out


def kept(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for s, e in gone:
        parts.append(data[at:s])
        at = e
    return b"".join([*parts, data[at:]])
