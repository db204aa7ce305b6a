"""Benchmark decontamination by winnowed fingerprints.

Benchmark items are cut into blocks of bounded bytes.  A block's winnowed k-gram hashes are
a sorted array, small by construction, that every task joins its documents' winnowed
fingerprints with; each joined pair of places is extended word by word in both directions,
and the words themselves are compared before a span counts.  With k-grams of ``gram`` words
and windows of ``span - gram + 1`` grams, every shared run of ``span`` words holds a common
fingerprint at the same place in both, so none is missed.  Items with fewer than ``span``
words are one window of all their words, looked up by the hash of that many words.

Documents are read once for each block and never shuffled.  With one block (up to
``block_bytes`` of benchmark texts) that is one pass; a larger benchmark takes more passes,
never a larger broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.llm.common import durable, fresh, packs, tidy, utf8
from loomlake.llm.words import ALNUM, Words, found, grams, winnow, within, words

_HITS = "struct<n_words:bigint,spans:array<struct<s:bigint,e:bigint>>,items:array<string>>"


class Index:
    """The fingerprints of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], span: int, gram: int):
        self.ids, self.span, self.gram, self.window = [i for i, _ in items], span, gram, span - gram + 1
        w = words([t for _, t in items], ALNUM)
        self.words, size = w, np.diff(w.bounds)
        at = winnow(grams(w.hashes, gram), w.text, gram, self.window)
        keys = grams(w.hashes, gram)[at] if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], at[order]
        self.short = {}
        for n in sorted(set(size[(size > 0) & (size < span)].tolist())):
            first = w.bounds[:-1][size == n]
            keys = grams(w.hashes, n)[first]
            order = np.argsort(keys, kind="stable")
            self.short[n] = keys[order], first[order]

    def _pairs(self, keys, places, probe, positions) -> Iterator[tuple[int, int]]:
        """Places of documents and of items whose fingerprints are equal."""
        hit, first = found(keys, probe)
        last = np.searchsorted(keys, probe[hit], side="right")
        for p, a, b in zip(positions[hit].tolist(), first.tolist(), last.tolist()):
            for q in places[a:b].tolist():
                yield p, q

    def spans(self, doc: Words) -> dict[int, list[tuple[int, int, int]]]:
        """(first word, end, item) of shared spans, by text of the slice; words count from the slice's first."""
        item, out = self.words, defaultdict(list)
        g = grams(doc.hashes, self.gram)
        at = winnow(g, doc.text, self.gram, self.window)
        reached: dict[tuple[int, int], int] = {}  # the end of the last span of a text and an item's diagonal
        for p, q in self._pairs(self.keys, self.places, g[at] if len(at) else g[:0], at):
            t, i = int(doc.text[p]), int(item.text[q])
            if reached.get((p - q, i), -1) > p:
                continue
            back = min(p - doc.bounds[t], q - item.bounds[i])
            ahead = min(doc.bounds[t + 1] - p, item.bounds[i + 1] - q)
            left = doc.hashes[p - back : p][::-1] != item.hashes[q - back : q][::-1]
            right = doc.hashes[p : p + ahead] != item.hashes[q : q + ahead]
            a = p - (int(left.argmax()) if left.any() else back)
            b = p + (int(right.argmax()) if right.any() else ahead)
            reached[p - q, i] = b
            if b - a >= self.span and doc.span(a, b) == item.span(a - p + q, b - p + q):
                out[t].append((a, b, i))
        for n, (keys, places) in self.short.items():
            ok = np.flatnonzero(within(doc.text, n))
            for p, q in self._pairs(keys, places, grams(doc.hashes, n)[ok] if len(ok) else doc.hashes[:0], ok):
                if doc.span(p, p + n) == item.span(q, q + n):
                    out[int(doc.text[p])].append((p, p + n, int(item.text[q])))
        return out


def _union(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["e"]:
            out[-1]["e"] = max(out[-1]["e"], b)
        else:
            out.append({"s": a, "e": b})
    return out


def _scan(docs: DataFrame, index: Index, text: str, name: str) -> DataFrame:
    """Adds the column ``name``: the number of words, the hit word spans and the items, by row."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("items", pa.list_(pa.string()))])
    at = docs.columns.index(text)
    names = [*docs.columns, name]

    def scan(batches):
        ix = shared.value
        for batch in batches:
            texts, rows = utf8(batch.column(at)), []
            for lo, hi in packs(texts):
                w = words(texts[lo:hi], ALNUM)
                hits = ix.spans(w)
                for t in range(hi - lo):
                    first, mine = int(w.bounds[t]), hits.get(t, [])
                    rows.append({"n_words": int(w.bounds[t + 1]) - first, "spans": _union([(a - first, b - first) for a, b, _ in mine]), "items": sorted({ix.ids[i] for *_, i in mine})})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names)

    return docs.mapInArrow(tidy(scan), T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(_HITS))]))


def hit_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", span: int = 10, gram: int = 5, block_bytes: int = 4 << 20, name: str = "_hits") -> DataFrame:
    """All rows and columns of ``docs`` with a column ``name`` of (n_words, spans, items); one of the input with that name is replaced.

    Spans are word ranges, disjoint and in order.  A null or empty text has no words.  Repeated
    rows are judged alike, each on its own.  Items with a null id or text are left out, copies of
    an item count once, and an empty benchmark hits nothing.
    """
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text if item_text is None else item_text).alias("t")).where("i is not null and t is not null").distinct()
    n = 1 + int(items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]) // block_bytes
    block = lambda k: Index(sorted((r["i"], r["t"].encode()) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()), span, gram)
    docs = docs.drop(name)
    if n == 1:
        return _scan(docs, block(0), text, name)
    # Several blocks: what each finds in the distinct texts is put together by text.  Those are written once.
    texts = durable(docs.select(F.sha2(F.coalesce(text, F.lit("")), 256).alias("id"), F.col(text).alias("text")).dropDuplicates(["id"]))
    each = [_scan(texts, block(k), "text", "hits").where("size(hits.items) > 0").select("id", "hits") for k in range(n)]
    all_hits = each[0]
    for more in each[1:]:
        all_hits = all_hits.unionAll(more)
    key, spans, found_items = fresh("_id", docs), fresh("_spans", docs), fresh("_items", docs)
    merged = all_hits.groupBy(F.col("id").alias(key)).agg(F.array_sort(F.flatten(F.collect_list("hits.spans"))).alias(spans), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits.items")))).alias(found_items))
    base = _scan(docs, Index([], span, gram), text, name).withColumn(key, F.sha2(F.coalesce(text, F.lit("")), 256))
    disjoint = F.reduce(
        spans,
        F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)"),
        lambda out, x: F.when((F.size(out) > 0) & (F.get(out, F.size(out) - 1)["e"] >= x["s"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.get(out, F.size(out) - 1)["s"].alias("s"), F.greatest(F.get(out, F.size(out) - 1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(out, F.array(x))),
    )
    found_any = base.join(merged, key, "left").withColumn(name, F.when(F.col(found_items).isNull(), F.col(name)).otherwise(F.struct(F.col(f"{name}.n_words").alias("n_words"), disjoint.alias("spans"), F.col(found_items).alias("items"))))
    return found_any.drop(key, spans, found_items)


def hit_words(name: str = "_hits") -> Column:
    """The number of words in a row's hit spans."""
    return F.reduce(F.col(name)["spans"], F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])


def clean(docs: DataFrame, benchmark: DataFrame, *, most: float = 0.0, **how) -> DataFrame:
    """The rows of ``docs``, whole, of whose words at most the fraction ``most`` is in hit spans; other columns may have any names."""
    name = fresh("_hits", docs)
    return hit_spans(docs, benchmark, name=name, **how).where(hit_words(name) <= F.lit(most) * F.col(name)["n_words"]).drop(name)


def digest(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """A row for each document: how many words are hit, and the items with occurring windows."""
    return hit_spans(docs.select("doc_id", "text"), benchmark, **how).select(
        "doc_id",
        F.col("_hits.n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("_hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_hits.items", ","), 256).alias("items_sha256"),
        (hit_words() > 0).alias("contaminated"),
    )
