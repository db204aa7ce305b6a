"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Each source gets a share of all words by its weight, and so a ratio of its target to its size.  A document is
taken as often as the ratio's whole part says; the rest is a chance of one more copy.  Two documents of a source pair their
chances: words of chance move at random from one to the other, as many as leave both within 0 and 1, so that one of
them is settled; chances stay right on average, and the words of the source stay what they were.  Pairing goes on in a
reduction tree: groups of some hundred documents each leave one open chance, these form the next level's
groups, and the last one of a source goes to the nearer side.  So a source misses its target by half a document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions.text import bound
from loomlake.llm.common import bounded, ranked, stored

#: Weights of the sources in order, again and again.
WEIGHTS = (5, 2, 1)
#: Times a document is taken at most, and so its source.
MOST = 3
#: Documents or open chances that one group of the tree pairs, on average.
FAN = 256


def words(text: Column) -> Column:
    """Number of runs of characters other than blanks and the ASCII controls from tab to carriage return; null has none."""
    # Every word becomes one letter, and what is between them goes.
    letters = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "w"), " \t\n\x0b\f\r", "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def chance(*parts: Column | str) -> Column:
    """A whole number below 2**52, by the hash of some values; the same in every run."""
    named = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("-")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *named)), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds each source's target to (source, source_size, ...), and its number ``_source`` in the order of code points, null last.

    Sources share all words by weight; one whose share is over ``most`` times its size stops there, and the excess goes
    to the others by weight until none is above.
    """
    numbered = ranked(sizes, [F.asc_nulls_last("source")], "_source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_source") % len(weights) + 1).cast("int"))
    weighed = stored(numbered.withColumns({"_weight": weight.cast("long"), "_cap": most * F.col("source_size")}), "weighed")
    total = weighed.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, stopped = 0.0, -1
    while True:
        # A share only grows when another one stops, so those that have stopped stay so.
        over = F.col("_weight") * F.lit(level) > F.col("_cap")
        row = weighed.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("_cap"))).alias("cap"), F.sum(F.when(~over, F.col("_weight"))).alias("weight")).first()
        if row["n"] == stopped or not row["weight"]:
            break
        stopped, level = row["n"], (total - (row["cap"] or 0)) / row["weight"]
    return weighed.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_weight") * F.lit(level))).drop("_weight", "_cap")


_ITEM = ("doc_id", "size", "rows", "base", "extra", "open")


def _pair(level: int):
    """One step of a group's fold: the open document so far meets the next one, and one of them is settled."""

    def meet(state: Column, b: Column) -> Column:
        a = state["rest"]
        up = F.least(a["size"] * (1 - a["open"]), b["size"] * b["open"])  # words of chance that b can give to a
        down = F.least(a["size"] * a["open"], b["size"] * (1 - b["open"]))
        draw = chance("pair", F.lit(level), a["doc_id"], a["size"], b["doc_id"], b["size"]) / F.lit(float(1 << 52))

        def settle(m: Column) -> Column:
            first = m["draw"] * (m["up"] + m["down"]) < m["down"]
            moved = F.when(first, m["up"]).otherwise(-m["down"])
            gone = F.when(first, m["up"] == a["size"] * (1 - a["open"])).otherwise(m["down"] == a["size"] * a["open"])
            return bound(F.struct(first.alias("first"), moved.alias("moved"), gone.alias("gone")), outcome)

        def outcome(x: Column) -> Column:
            item = lambda d, q: F.struct(*[(q if c == "open" else d[c]).alias(c) for c in _ITEM])
            settled = F.when(x["first"] == x["gone"], 1.0).otherwise(0.0)
            done = F.when(x["gone"], item(a, settled)).otherwise(item(b, settled))
            rest = F.when(x["gone"], item(b, b["open"] - x["moved"] / b["size"])).otherwise(item(a, a["open"] + x["moved"] / a["size"]))
            return F.struct(F.array_append(state["done"], done).alias("done"), rest.alias("rest"))

        return bound(F.struct(up.alias("up"), down.alias("down"), draw.alias("draw")), settle)

    return meet


def settle(pool: DataFrame, most_leaves: int, fan: int = FAN) -> DataFrame:
    """Settles open chances: (_source, _leaves, doc_id, size, rows, base, extra, open) to the same with ``open`` 0 or 1.

    ``_leaves`` is the number of groups that a source's documents are dealt out to.
    """
    kind = "array<struct<doc_id:{d},size:bigint,rows:bigint,base:bigint,extra:bigint,open:double>>".format(d=dict(pool.dtypes)["doc_id"])
    settled, level = [], 0
    while True:
        leaf = F.pmod(chance("leaf", F.lit(level), F.col("doc_id"), F.col("size")), F.col("_leaves"))
        # Large documents first, so that what stays open is rather a small one.
        entry = F.struct((-F.col("size")).alias("_order"), *_ITEM)
        groups = pool.groupBy("_source", "_leaves", leaf.alias("_leaf")).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
        item = lambda x: F.struct(*[x[c].alias(c) for c in _ITEM])
        start = F.struct(F.expr(f"cast(array() as {kind})").alias("done"), item(F.get("_all", F.lit(0))).alias("rest"))
        folded = groups.select("_source", "_leaves", F.aggregate(F.transform(F.slice("_all", 2, F.size("_all")), item), start, _pair(level)).alias("_f"))
        folded = stored(folded.select("_source", "_leaves", "_f.done", "_f.rest"), f"mixing-{level}")
        settled.append(folded.select("_source", F.inline("done")))
        pool = folded.select("_source", F.ceil(F.col("_leaves") / fan).alias("_leaves"), "rest.*")
        if most_leaves <= 1:
            break
        # A source that had one group has one open document left, which waits for the others.
        most_leaves, level = -(-most_leaves // fan), level + 1
    # The last one of a source has no partner: it goes where the source's words come nearer to the target.
    last = pool.withColumn("open", F.when(F.col("open") >= 0.5, 1.0).otherwise(0.0)).select("_source", *_ITEM)
    for more in settled:
        last = last.unionAll(more)
    return last


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, fan: int = FAN) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target (its source's), taken (words, repeats counted).

    Null texts have size 0 and are taken for 0 words, null sources are one source, the last.  A document is taken
    up to ``most`` times, as are equal rows each; which of equal rows gets the odd copy is of no matter, so they are
    rounded as one.  Sources without words, and an empty table, have targets of 0 and no rows.  Runs agree: chances come of hashes
    of doc_id and size.  Other columns are dropped.
    """
    items = docs.select("doc_id", "source", words(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    items = stored(items, "mixing-items")
    sizes = items.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count_if(F.col("size") > 0).alias("_items"))
    shares = stored(targets(sizes, weights, most).withColumn("_leaves", F.greatest(F.ceil(F.col("_items") / fan), F.lit(1))), "mixing-shares")
    seen = shares.agg(F.count("*").alias("n"), F.max("_leaves").alias("leaves")).first()
    of = bounded(shares.withColumnRenamed("source", "_of"), seen["n"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor("_ratio")
    open_ = F.col("rows") * (F.col("_ratio") - F.col("base"))
    joined = items.join(of, F.col("source").eqNullSafe(F.col("_of"))).withColumn("_ratio", ratio).withColumn("base", base).withColumn("_open", open_).withColumn("extra", F.floor("_open"))
    joined = joined.withColumn("open", F.col("_open") - F.col("extra")).select("_source", "_leaves", *_ITEM)
    undecided = (F.col("size") > 0) & (F.col("open") > 0)
    plain = joined.where(~undecided).select("_source", "doc_id", "size", "rows", "base", "extra", F.lit(0.0).alias("open"))
    rounded = plain.unionAll(settle(joined.where(undecided), seen["leaves"] or 1, fan))
    each = rounded.join(bounded(shares.select("_source", "source_size", "target"), seen["n"]), "_source").withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = F.col("base") + F.when(F.col("_row") <= F.col("extra") + F.col("open"), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def _level(k: int) -> str:
    """A level of the tree in SQL: its groups, walked through by recursion, what is settled, and what stays open."""
    return f""",
    p{k} AS (SELECT *, row_number() OVER (PARTITION BY s, leaf ORDER BY size DESC, doc_id) AS i FROM (SELECT *, ('0x' || substr(md5('leaf|{k}|' || doc_id || '|' || size), 1, 13))::BIGINT % leaves AS leaf FROM o{k}) x),
    f{k} AS (SELECT s, leaf, leaves, i, doc_id, size, base, q, NULL::BIGINT AS d, NULL::BIGINT AS d_size, NULL::BIGINT AS d_base, NULL::INTEGER AS d_up FROM p{k} WHERE i = 1
      UNION ALL SELECT s, leaf, leaves, i, CASE WHEN gone THEN b ELSE doc_id END, CASE WHEN gone THEN b_size ELSE size END, CASE WHEN gone THEN b_base ELSE base END, CASE WHEN gone THEN bq - moved / b_size ELSE q + moved / size END,
        CASE WHEN gone THEN doc_id ELSE b END, CASE WHEN gone THEN size ELSE b_size END, CASE WHEN gone THEN base ELSE b_base END, CASE WHEN fst = gone THEN 1 ELSE 0 END
      FROM (SELECT *, CASE WHEN fst THEN up ELSE -down END AS moved, CASE WHEN fst THEN up = size * (1 - q) ELSE down = size * q END AS gone
        FROM (SELECT *, ('0x' || substr(md5('pair|{k}|' || doc_id || '|' || size || '|' || b || '|' || b_size), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * (up + down) < down AS fst
          FROM (SELECT f.s, f.leaf, f.leaves, p.i, f.doc_id, f.size, f.base, f.q, p.doc_id AS b, p.size AS b_size, p.base AS b_base, p.q AS bq, least(f.size * (1 - f.q), p.size * p.q) AS up, least(f.size * f.q, p.size * (1 - p.q)) AS down
            FROM f{k} f JOIN p{k} p ON p.s = f.s AND p.leaf = f.leaf AND p.i = f.i + 1) x) y) z),
    o{k + 1} AS (SELECT s, CAST(ceil(leaves / {FAN}.0) AS BIGINT) AS leaves, doc_id, size, base, q FROM f{k} QUALIFY row_number() OVER (PARTITION BY s, leaf ORDER BY i DESC) = 1)"""


#: Three levels serve sources of up to 256**3 documents.  doc_id has to be unique here.
ORACLE = f"""WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
    w AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (WHERE size > 0) AS items, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM d GROUP BY source),
    v AS (SELECT *, CASE s % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM w),
    l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lv FROM v WINDOW b AS (ORDER BY cap::DOUBLE / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT s, source, source_size, items, least(cap::DOUBLE, weight * (SELECT min_by(lv, cap::DOUBLE / weight) FROM l WHERE weight * lv <= cap)) AS target FROM v),
    r AS (SELECT d.doc_id, d.size, t.s, t.source_size, t.target, greatest(CAST(ceil(t.items / {FAN}.0) AS BIGINT), 1) AS leaves, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
    o0 AS (SELECT s, leaves, doc_id, size, CAST(floor(ratio) AS BIGINT) AS base, ratio - floor(ratio) AS q FROM r WHERE size > 0 AND ratio > floor(ratio)){"".join(_level(k) for k in range(3))},
    u AS (SELECT d AS doc_id, d_up AS up FROM f0 WHERE d IS NOT NULL UNION ALL SELECT d, d_up FROM f1 WHERE d IS NOT NULL UNION ALL SELECT d, d_up FROM f2 WHERE d IS NOT NULL
      UNION ALL SELECT doc_id, CASE WHEN q >= 0.5 THEN 1 ELSE 0 END FROM o3)
    SELECT r.doc_id, r.size, r.source_size, r.target, CAST(r.size * (floor(r.ratio) + coalesce(u.up, 0)) AS BIGINT) AS taken FROM r LEFT JOIN u ON u.doc_id = r.doc_id"""
