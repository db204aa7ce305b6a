"""Jaccard self-join of documents on word n-grams, by vertical partitioning.

A document's set is its distinct word shingles, as 64-bit hashes.  Documents with equal sets are one
class from the start; a class is known by a digest of its set.

1. Shingles are counted over all classes in packed blocks (a hash range a block), which gives the global
   order: ordinary shingles by hash, then frequent ones by count.  Any total order is right; the
   frequent list is bounded because it is broadcast, and shingles beyond it merely sort as ordinary.
   Blocks are many times the partitions, so that they spread evenly whatever the corpus.
2. Candidates share a shingle of their prefixes in that order (a linked pair must).  Length, position and
   a parity signature (differing bits never exceed differing shingles) drop pairs that can't link.  The members
   of a shingle with many of them are dealt into blocks, and every two blocks meet in a task, which gives
   out only pairs that pass: rows are blocks and candidates, never all pairs of a group.
3. Verification cuts that order at pivots into fragments: the ordinary shingles into equal hash ranges, and
   the frequent ones, which are its end, into the last.  Each candidate pair's overlap is counted for each
   fragment apart and summed for each pair; whole sets never meet in one row.
4. As the result is components, pairs are verified in two rounds: first each member of a shared shingle
   with that group's least member, which joins up large groups of near copies with linearly many
   pairs; then all candidate pairs whose ends are still in different components.  No link between
   components is left out.

Texts are never shuffled: each step reads them in place, and sees a set once for each task at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import MOST_BROADCAST, bit_set, durable, packs, tidy, utf8
from loomlake.llm.words import SPACED, U, grams, mix, words

_SIGN = 512  # bits of a parity signature
#: Entries in a packed part on its way to the shuffle: 2 to 4 MB, so that neither side holds large buffers.
_PART = 500_000
#: Entries of a block, on average; a corpus has 2**9 blocks or more.
_BLOCK, _LEAST_BITS = 200_000, 9
#: Members of a shingle whose pairs Spark joins as rows, and of a block where there are more.
_FEW, _MEMBERS = 32, 1024


def sets(texts: list[bytes | None], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of each text that has words."""
    for lo, hi in packs(texts):
        w = words(texts[lo:hi], SPACED)
        g = grams(w.hashes, k)
        for t in range(hi - lo):
            a, b = int(w.bounds[t]), int(w.bounds[t + 1])
            if b - a >= k:
                yield lo + t, np.unique(g[a : b - k + 1])
            elif b > a:
                yield lo + t, grams(w.hashes[a:b], b - a) ^ U((b - a) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def digest(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) + U(len(s))]))[0].astype(np.int64))


class Frequent:
    """The frequent list: sorted keys, which are a hash's upper 32 + ``bits`` bits, and their counts."""

    def __init__(self, bits: int, keys: np.ndarray, counts: np.ndarray):
        self.drop, self.keys, self.counts = U(32 - bits), keys, counts
        # Most shingles aren't on the list; a look at one place tells so without a search.
        self.mask = U((1 << max(10, min(23, (8 * len(keys)).bit_length()))) - 1)
        self.maybe = np.zeros(int(self.mask) + 1, bool)
        self.maybe[keys & self.mask] = True

    def count(self, s: np.ndarray) -> np.ndarray:
        """How often each shingle occurs if it is on the list, else 0."""
        short, out = s >> self.drop, np.zeros(len(s), np.int64)
        ask = np.flatnonzero(self.maybe[short & self.mask])
        if len(ask):
            at = np.minimum(np.searchsorted(self.keys, short[ask]), len(self.keys) - 1)
            out[ask] = np.where(self.keys[at] == short[ask], self.counts[at], 0)
        return out


def least_overlap(n: Column, t: int) -> Column:
    """The least overlap of two sets with n members together that reach t percent."""
    return F.ceil(F.lit(t) * n / F.lit(100 + t))


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


class Join:
    """The steps of one join; ``docs`` has doc_id and text."""

    def __init__(self, docs: DataFrame, k: int = 4, percent: int = 85, *, frequent: int = 8, most_frequent: int = 1 << 20, fragments: int = 4):
        self.docs, self.k, self.t, self.frequent, self.most, self.fragments = docs.select("doc_id", "text"), k, percent, frequent, most_frequent, fragments
        self.context = docs.sparkSession.sparkContext
        self.sized = durable(self._sized())
        self.classes = durable(self.sized.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sign").alias("sign")))
        self.total = self.classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        self.bits, keys, counts = self._frequencies()
        self.order = self.context.broadcast((keys, counts))

    def _sized(self) -> DataFrame:
        k = self.k
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sign", pa.list_(pa.int64()))])

        def run(batches):
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
                rows = [(d, 0, None, None) for d in ids]
                for i, s in sets(texts, k):
                    sign = np.packbits((np.bincount((s & U(_SIGN - 1)).astype(np.int64), minlength=_SIGN) & 1).astype(np.uint8)).view(np.int64)
                    rows[i] = (ids[i], len(s), digest(s), sign.tolist())
                yield _batches(rows, schema)

        return self.docs.mapInArrow(tidy(run), "doc_id long, n long, node long, sign array<long>")

    def _frequencies(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Bits of a key, and the keys and counts of the most frequent shingles, sorted by key."""
        k, least = self.k, self.frequent
        bits = max(_LEAST_BITS, ceil(log(max(self.total, 1) / _BLOCK + 1, 2)))
        schema = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

        def packed(parts):
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            bucket = keys >> U(32)
            cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(keys))
            rest, counts = (keys & U(0xFFFFFFFF)).astype("<u4"), counts.astype("<u4")
            return _batches([(int(bucket[a]), rest[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])], schema)

        def count(batches):
            seen, parts, size = set(), [], 0
            for batch in batches:
                for _, s in sets(utf8(batch.column(0)), k):
                    if (name := digest(s)) not in seen:
                        seen.add(name)
                        parts.append(s >> U(64 - 32 - bits))
                        size += len(s)
                        if size > _PART:
                            yield packed(parts)
                            parts, size = [], 0
            if parts:
                yield packed(parts)

        def add(key, pdf):
            keys = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["keys"]])
            n = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["counts"]]).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            n = np.add.reduceat(n, first)
            return pd.DataFrame({"key": (int(key[0]) << 32) + keys[first][n >= least].astype(np.int64), "n": n[n >= least]})

        counted = durable(self.docs.select("text").mapInArrow(tidy(count), "bucket long, keys binary, counts binary").groupBy("bucket").applyInPandas(add, "key long, n long"))
        # The list is broadcast, so its length is bounded: the least count is raised until it fits.
        hist = sorted(((r["e"], r["m"]) for r in counted.groupBy(F.floor(F.log2("n")).alias("e")).agg(F.count("*").alias("m")).collect()), reverse=True)
        room, floor = self.most, None
        for e, m in hist:
            if m > room:
                break
            room, floor = room - m, e
        rows = counted.where(F.floor(F.log2("n")) >= floor).toPandas() if floor is not None else pd.DataFrame({"key": [], "n": []})
        rows = rows.sort_values("key")
        return bits, rows["key"].to_numpy(np.uint64), rows["n"].to_numpy(np.int64)

    def postings(self) -> DataFrame:
        """(shingle, node, n, pos) of prefixes, of shingles that several nodes have there."""
        k, t, bits, shared = self.k, self.t, self.bits, self.order
        deal = max(_LEAST_BITS, ceil(log(self.total * (100 - t) / 100 / _BLOCK + 1, 2)))
        kind = np.dtype([("s", "<u8"), ("node", "<i8"), ("n", "<i4"), ("pos", "<i4")])
        schema = pa.schema([("bucket", pa.int64()), ("rows", pa.binary())])

        def packed(parts, bucket):
            rows, bucket = np.concatenate(parts), np.concatenate(bucket)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(rows))
            return _batches([(int(bucket[a]), rows[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])], schema)

        def prefixes(batches):
            frequent = Frequent(bits, *shared.value)
            seen, parts, buckets, size, turn = set(), [], [], 0, 0
            for batch in batches:
                for _, s in sets(utf8(batch.column(0)), k):
                    if (name := digest(s)) in seen:
                        continue
                    seen.add(name)
                    n, often = len(s), frequent.count(s)
                    pl = n - (t * n + 99) // 100 + 1
                    order = np.flatnonzero(often == 0)[:pl]  # s is sorted by hash
                    if len(order) < pl:
                        order = np.argsort(often, kind="stable")[:pl]
                    rows = np.zeros(pl, kind)
                    rows["s"], rows["node"], rows["n"], rows["pos"] = s[order], name, n, np.arange(pl)
                    turn = turn % (1 << deal) + 1
                    parts.append(rows)
                    # Frequent shingles need no search for partners; they are dealt evenly.
                    buckets.append(np.where(often[order] > 0, -turn, (rows["s"] >> U(64 - deal)).astype(np.int64)))
                    size += pl
                    if size > _PART // 5:
                        yield packed(parts, buckets)
                        parts, buckets, size = [], [], 0
            if parts:
                yield packed(parts, buckets)

        def several(key, pdf):
            rows = np.concatenate([np.frombuffer(x, kind) for x in pdf["rows"]])
            if key[0] >= 0:
                rows = rows[np.lexsort((rows["node"], rows["s"]))]
                same = (rows["s"][1:] == rows["s"][:-1]) & (rows["node"][1:] == rows["node"][:-1])
                rows = rows[np.append(True, ~same)]
                again = np.append(False, rows["s"][1:] == rows["s"][:-1])
                rows = rows[again | np.append(again[1:], False)]
            return pd.DataFrame({"shingle": rows["s"].astype(np.int64), "node": rows["node"], "n": rows["n"], "pos": rows["pos"]})

        rows = self.docs.select("text").mapInArrow(tidy(prefixes), "bucket long, rows binary").groupBy("bucket").applyInPandas(several, "shingle long, node long, n int, pos int")
        return durable(rows.distinct())

    def could_link(self, a: str, b: str, place: bool = True) -> Column:
        """Length and, for a shared prefix shingle, position."""
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        ok = 100 * F.least(na, nb) >= self.t * F.greatest(na, nb)
        return ok & (F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos")) >= least_overlap(na + nb, self.t)) if place else ok

    def signs_allow(self, a: str, b: str, na: Column, nb: Column) -> Column:
        differ = F.reduce(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
        return differ <= na + nb - 2 * least_overlap(na + nb, self.t)

    def segments(self, nodes: DataFrame) -> DataFrame:
        """(node, fragment, set members of that fragment) of the nodes, perhaps of some others, perhaps twice."""
        reps = nodes.join(self.classes.select("node", "rep"), "node").select(F.col("rep").alias("doc_id"))
        docs, few = self.docs.where("doc_id is not null"), nodes.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
        if few:  # the other texts don't go to Python
            docs, wanted = docs.join(F.broadcast(reps), "doc_id", "left_semi").select("text", F.lit(0).alias("place")), None
        else:
            wanted = bit_set(reps, "doc_id")
            docs, wanted = docs.select("text", wanted.place("doc_id").alias("place")), self.context.broadcast(wanted)
        k, bits, last, shared = self.k, self.bits, self.fragments - 1, self.order
        schema = pa.schema([("node", pa.int64()), ("fragment", pa.int64()), ("members", pa.binary())])

        def run(batches):
            seen, frequent = set(), Frequent(bits, *shared.value)
            for batch in batches:
                texts, rows = batch.column(0), []
                if wanted is not None:
                    texts = texts.take(pa.array(np.flatnonzero(wanted.value.has(batch.column(1)))))
                for _, s in sets(utf8(texts), k):
                    if (name := digest(s)) in seen:
                        continue
                    seen.add(name)
                    # Pivots: equal hash ranges of the ordinary shingles, then the frequent ones.
                    part = np.where(frequent.count(s) > 0, last, ((s >> U(32)) * U(last) >> U(32)).astype(np.int64))
                    for f in np.unique(part).tolist():
                        rows.append((name, f, s[part == f].tobytes()))
                yield _batches(rows, schema)

        return docs.mapInArrow(tidy(run), "node long, fragment long, members binary")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, na, nb) that link, by partial overlaps of fragments summed for each pair."""
        side = lambda end: self.segments(pairs.select(F.col(end).alias("node")).distinct()).select(F.col("node").alias(end), "fragment", F.col("members").alias(f"m{end}"))
        both = pairs.join(side("b"), "b").join(side("a"), ["a", "fragment"])
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("fragment", pa.int64()), ("common", pa.int64())])

        def overlap(batches):
            for batch in batches:
                common = [len(np.intersect1d(np.frombuffer(x, U), np.frombuffer(y, U), assume_unique=True)) for x, y in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist())]
                yield pa.RecordBatch.from_arrays([*(c.cast(pa.int64()) for c in batch.columns[:5]), pa.array(common, pa.int64())], schema=schema)

        partial = both.select("a", "b", "na", "nb", "fragment", "ma", "mb").mapInArrow(tidy(overlap), "a long, b long, na long, nb long, fragment long, common long")
        # A set that two tasks saw makes equal rows for a fragment: one of them counts.
        once = partial.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("common").alias("common"))
        o = F.col("common")
        return once.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common")).where(100 * o >= self.t * (F.col("na") + F.col("nb") - o)).select("a", "b")

    def links(self) -> DataFrame:
        """Pairs of nodes that link, enough of them to give the components of all links."""
        posts = self.postings()
        band = F.floor(F.log(F.col("n")) / F.lit(log(100 / self.t)))
        banded = posts.withColumn("band", band)
        # Round 1: everyone with one of its shingle and length band, that with the fewest rarer shingles,
        # which is nearest to what the group has in common.
        heads = durable(banded.groupBy("shingle", "band").agg(F.min(F.struct("pos", "node", "n")).alias("head"), F.count("*").alias("m")).where("m > 1").select("shingle", "band", "head.*"))
        star = banded.alias("y").join(heads.alias("x"), ["shingle", "band"]).where(F.col("x.node") != F.col("y.node")).where(self.could_link("x", "y"))
        first = durable(self.plausible(star.select(*self.ends("x", "y"))))
        edges = durable(self.verify(first))
        label = components(edges)
        # Round 2: across the components that are left.
        second = durable(self.across(posts, label).join(first, ["a", "b"], "left_anti"))
        return durable(edges.unionAll(self.verify(second)))

    def across(self, posts: DataFrame, label: DataFrame) -> DataFrame:
        """Candidate pairs (a, b, na, nb) whose ends are in different components."""
        posts = durable(posts.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")))
        mixed = posts.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("shingle")
        posts = durable(posts.join(mixed, "shingle", "left_semi").join(self.classes.select("node", "sign"), "node"))
        size = posts.groupBy("shingle").agg(F.count("*").alias("m"))
        few = posts.join(size.where(F.col("m") <= _FEW), "shingle", "left_semi")
        apart = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
        on = apart & self.could_link("x", "y") & self.signs_allow("x.sign", "y.sign", F.col("x.n"), F.col("y.n"))
        pairs = few.alias("x").join(few.alias("y"), on).select(*self.ends("x", "y"))
        return pairs.unionAll(self.in_blocks(posts.join(size.where(F.col("m") > _FEW), "shingle"))).distinct()

    def in_blocks(self, posts: DataFrame) -> DataFrame:
        """Candidate pairs (a, b, na, nb) of members of a shingle in different components; ``posts`` have m, its members."""
        t = self.t
        posts = posts.withColumn("blocks", F.ceil(F.col("m") / _MEMBERS)).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        blocks = durable(posts.groupBy("shingle", "block", "blocks").agg(F.collect_list(F.struct("node", "component", "n", "pos", "sign")).alias("rows")))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        place = ["shingle", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
        met = blocks.withColumn("other", every).select(*place, "block", "rows")
        left, right = met.where("block = i").select("shingle", "i", "j", F.col("rows").alias("x")), met.where("block = j").select("shingle", "i", "j", F.col("rows").alias("y"))
        schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "na", "nb")])

        def members(column: pa.ListArray, r: int) -> list[np.ndarray]:
            rows = column[r].values
            node, component, n, pos = (rows.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("node", "component", "n", "pos"))
            return [node, component, n, pos, rows.field("sign").flatten().to_numpy(zero_copy_only=False).view(U).reshape(len(node), -1)]

        def meet(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    x, y = members(batch.column(1), r), members(batch.column(2), r)
                    found = [np.zeros((0, 4), np.int64)]
                    for lo in range(0, len(x[0]), 128):
                        node, component, n, pos, sign = (c[lo : lo + 128, None] for c in x)
                        # As in could_link and signs_allow.
                        least = -(-t * (n + y[2]) // (100 + t))
                        ok = (component != y[1]) & (100 * np.minimum(n, y[2]) >= t * np.maximum(n, y[2])) & (np.minimum(n - pos, y[2] - y[3]) >= least)
                        if batch.column(0)[r].as_py():  # a block with itself
                            ok &= node < y[0]
                        i, j = np.nonzero(ok)
                        differ = np.bitwise_count(sign[i, 0] ^ y[4][j]).sum(axis=1, dtype=np.int64)
                        near = differ <= n[i, 0] + y[2][j] - 2 * least[i, j]
                        i, j = i[near], j[near]
                        ends = np.stack([node[i, 0], y[0][j], n[i, 0], y[2][j]], axis=1)
                        found.append(np.where((ends[:, 0] < ends[:, 1])[:, None], ends, ends[:, [1, 0, 3, 2]]))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(np.concatenate(found), axis=0).T], schema=schema)

        both = left.join(right, ["shingle", "i", "j"]).select((F.col("i") == F.col("j")).alias("same"), "x", "y")
        return both.mapInArrow(tidy(meet), "a long, b long, na long, nb long")

    def ends(self, x: str, y: str) -> list[Column]:
        """Both ends in order, with their sizes."""
        lower = F.col(f"{x}.node") < F.col(f"{y}.node")
        pick = lambda p, q: F.when(lower, F.col(p)).otherwise(F.col(q))
        return [pick(f"{x}.node", f"{y}.node").alias("a"), pick(f"{y}.node", f"{x}.node").alias("b"), pick(f"{x}.n", f"{y}.n").alias("na"), pick(f"{y}.n", f"{x}.n").alias("nb")]

    def plausible(self, pairs: DataFrame) -> DataFrame:
        sign = lambda end: self.classes.select(F.col("node").alias(end), F.col("sign").alias(f"s{end}"))
        signed = pairs.distinct().join(sign("a"), "a").join(sign("b"), "b")
        return signed.where(self.signs_allow("sa", "sb", F.col("na"), F.col("nb"))).select("a", "b", "na", "nb")

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id for each row of ``docs``."""
        label = components(self.links())
        named = self.classes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        root = durable(named.groupBy("component").agg(F.min("rep").alias("component_id")))
        of_node = durable(named.join(root, "component").select("node", "component_id"))
        rows = self.sized.select("doc_id", F.col("n").alias("n_shingles"), "node").join(of_node, "node", "left")
        return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every end of the edges (a, b): the least node reachable.

    Labels spread to neighbours and are then looked up in themselves, so long chains close quickly;
    each round is checkpointed and the driver sees one count.
    """
    both = durable(edges.unionAll(edges.select(F.col("b"), F.col("a"))).where("a != b").distinct())
    label = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("near"))
        spread = label.join(near, label["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        of_label = label.select(F.col("node").alias("c"), F.col("component").alias("up"))
        new = durable(spread.join(of_label, "c", "left").select("node", "old", F.least("c", F.coalesce("up", "c")).alias("component")))
        if not new.where("component < old").limit(1).count():
            return new.select("node", "component")
        label = new.select("node", "component")


def jaccard_components(docs: DataFrame, **how) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id.

    Null and empty texts, and texts without words, have no shingles and link with nothing: they are
    their own component.  Equal sets link.  Repeated rows give repeated results; a row with a null doc_id
    gets the component of its set, which other rows name, else null.  Other columns are dropped.
    """
    return Join(docs, **how).result()


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that have their component's smallest doc_id; repeated rows of it all stay, and so do null ids."""
    dropped = jaccard_components(docs, **how).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti")
