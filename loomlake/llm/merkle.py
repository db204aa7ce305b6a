"""A Merkle manifest of a dataset, and proofs of its rows by a recursive query.

A row's leaf is a hash of its fields.  The leaves of a tree (here, of a language) stand in order; every eight
neighbours make a node above, until one is left, and the trees' roots form a last tree.  A node is stored as a row with its
own children and a link to its parent.  A recursive query starts at every leaf, goes up along the links, notes
the siblings on its way, and folds a (perhaps tampered) leaf with them to the root that it would have.

High nodes are met by very many leaves, so they are no join keys: low levels are climbed with joins by node, and the
levels from where on there are few nodes in all with a broadcast of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import MOST_BROADCAST, bounded, ranked, stored

#: Children of a node at most.
FAN = 8
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the trees' roots.
TOP = -1
#: A node's number has its level above, its place in the level below.
_LEVEL = 56


def field(value: Column) -> Column:
    """A value as it goes into a hash: its length in bytes and itself, or a dash for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields.values()]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hex_of(digests: Column) -> Column:
    """An array of digests as one text."""
    return F.lower(F.array_join(F.transform(digests, F.hex), ""))


def _node(level: Column | int, place: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.shiftleft(level.cast("long"), _LEVEL).bitwiseOR(place)


def finished(runs: DataFrame, level: int, trees: int, depth: int, fan: int) -> DataFrame:
    """Nodes of a level from their runs (tree, place, n, run): these and digest, node, and links up; written to the shared folder."""
    made = runs.withColumns({"digest": F.unhex(F.sha2(hex_of(F.col("run")), 256)), "node": _node(level, F.col("place")), **up(level, trees, depth, fan)})
    return stored(made, f"merkle-level-{level}")


def grouped(now: DataFrame, fan: int) -> DataFrame:
    """Runs of the trees that have more than one node: tree, place, n, run."""
    runs = now.where("n > 1").groupBy("tree", F.expr(f"place div {fan}").alias("place"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n"))
    return runs.agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("_run")).withColumn("run", F.transform("_run", lambda x: x["digest"])).drop("_run")


def up(level: int, trees: int, depth: int, fan: int) -> dict[str, Column]:
    """up_tree, up_node, up_place: the parent of a node (tree, place, n) at a level, and its place there; null for the root."""
    tree, place = F.col("tree"), F.col("place")
    own, top = F.col("n") > 1, (tree != TOP) & F.lit(trees > 1)
    return {
        "up_tree": F.when(own, tree).when(top, F.lit(TOP).cast("long")),
        "up_node": F.when(own, _node(level + 1, F.expr(f"place div {fan}"))).when(top, _node(depth + 1, F.expr(f"tree div {fan}"))),
        "up_place": F.when(own, place % fan).when(top, tree % fan).cast("int"),
    }


def build(runs: DataFrame, trees: int, depth: int, fan: int = FAN) -> tuple[DataFrame | None, DataFrame, list[int]]:
    """Node rows (tree, node, run, up_tree, up_node, up_place), the trees' roots (tree, digest), and how many nodes each level has.

    ``runs``: tree and place (from 0) of each run of leaves, n (leaves of the tree), members (array of structs with ``leaf``).
    ``depth`` is the number of levels above the leaves of the largest tree.  The levels of the top tree go on from
    there; its root is the last node.
    """
    roots, levels = runs.where("n = 1").select("tree", F.get("members", F.lit(0))["leaf"].alias("digest")), []
    for level in range(1, depth + 1):
        first = runs.where("n > 1").select("tree", "place", F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), F.transform("members", lambda m: m["leaf"]).alias("run")) if level == 1 else grouped(now, fan)
        levels.append(now := finished(first, level, trees, depth, fan))
        roots = roots.unionAll(now.where("n = 1").select("tree", "digest"))
    roots = stored(roots, "merkle-roots")
    now, left = roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(trees).cast("long").alias("n"), "digest"), trees
    while left > 1:
        levels.append(now := finished(grouped(now, fan), len(levels) + 1, trees, depth, fan))
        left = -(-left // fan)
    nodes = None
    for made in levels:
        rows = made.select("tree", "node", "run", "up_tree", "up_node", "up_place")
        nodes = rows if nodes is None else nodes.unionAll(rows)
    return nodes, roots, [made.count() for made in levels]


def _folded(run: str, place: str, digest: str) -> str:
    """The digest of a run in which one child has another digest, in SQL."""
    return f"unhex(sha2(lower(array_join(transform({run}, (d, i) -> hex(if(i = {place}, {digest}, d))), '')), 256))"


# Every round of the recursion is dealt out anew by Spark, so a row holds little: the leaves of a run have their siblings above in
# common and go up together, each with a fold of its own.
_CLIMB = f"""
WITH RECURSIVE climb (tree, place, up_tree, up_node, up_place, folds, siblings) AS (
  SELECT tree, place, up_tree, up_node, up_place, folds, siblings FROM {{start}}
  UNION ALL
  SELECT c.tree, c.place, n.up_tree, n.up_node, n.up_place,
    transform(c.folds, f -> {_folded("n.run", "c.up_place", "f")}),
    unhex(concat(hex(c.siblings), array_join(transform(filter(n.run, (d, i) -> i <> c.up_place), d -> hex(d)), '')))
  FROM climb c JOIN {{nodes}} n ON n.tree = c.up_tree AND n.node = c.up_node
)
SELECT tree, place, up_tree, up_node, up_place, folds, siblings FROM climb WHERE up_node IS NULL OR shiftright(up_node, {_LEVEL}) >= {{end}}"""

#: Settings that would stop a recursive query: the climb ends at the root by itself.
_LIMITS = ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit")


def climb(start: DataFrame, nodes: DataFrame | None, counts: list[int], most: int = MOST_BROADCAST) -> DataFrame:
    """tree, place, folds, siblings at the root: what each leaf of a run folds to, and the digests met on the way, put together.

    ``start``: tree, place, up_tree, up_node, up_place, folds (digests to start with).
    """
    spark = start.sparkSession
    # The levels from `high` on have so few nodes in all that they are broadcast.
    high = len(counts) + 1
    while high > 1 and sum(counts[high - 2 :]) <= most:
        high -= 1
    at = F.shiftright("node", _LEVEL)
    now = start.withColumn("siblings", F.lit(b""))
    before = {k: spark.conf.get(k) for k in _LIMITS}
    for k in _LIMITS:
        spark.conf.set(k, "-1")
    try:
        if high > 2:  # the leaves' own runs, the first level, are behind them already
            now = stored(spark.sql(_CLIMB, start=now, nodes=nodes.where(at < high), end=high), "merkle-low")
        if high <= len(counts):
            now = stored(spark.sql(_CLIMB, start=now, nodes=F.broadcast(nodes.where(at >= high)), end=len(counts) + 1), "merkle-high")
        return now
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def verify(docs: DataFrame, changed: dict[str, Column] | None = None, *, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, fan: int = FAN, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Proofs of all rows, held against the root: doc_id (the key), leaf, subroot, root, proof_sha256, folded_root, verified.

    ``changed`` gives the fields as they are now where they differ from when the manifest was made; each row is folded with
    those.  Trees are ordered by group (null first, by bytes), leaves by key (null first); of rows with one key the
    smaller digest is first, and equal rows are leaves of their own.  A dataset of one row is its own root, and its proof that of
    no siblings.  An empty table has no rows.  Other columns, whatever their names, are dropped.
    """
    then = {f: F.col(f) for f in fields}
    now = leaf_hash({**then, **(changed or {})})
    hashed = docs.select(F.col(key).alias("key"), F.col(group).alias("group"), F.unhex(leaf_hash(then)).alias("leaf"), F.unhex(now).alias("fold"), F.monotonically_increasing_id().alias("tie"))
    hashed = stored(hashed, "merkle-leaves")
    # Equal rows have a number each, so that they can lie in several parts.
    placed = ranked(hashed, [F.asc_nulls_first("group"), F.asc_nulls_first("key"), F.col("leaf"), F.col("tie")], "rank")
    trees = stored(placed.groupBy("group").agg(F.min("rank").alias("first"), F.count("*").alias("n")), "merkle-trees")
    trees = stored(ranked(trees, [F.asc_nulls_first("group")], "tree").withColumnRenamed("group", "of"), "merkle-trees")
    seen = trees.agg(F.count("*").alias("trees"), F.max("n").alias("n")).first()
    depth, n = 0, seen["n"] or 0
    while n > 1:
        depth, n = depth + 1, -(-n // fan)
    leaves = placed.join(bounded(trees, seen["trees"]), F.col("group").eqNullSafe(F.col("of"))).withColumn("at", F.col("rank") - F.col("first"))
    runs = leaves.groupBy("tree", F.expr(f"at div {fan}").alias("place"), "n").agg(F.array_sort(F.collect_list(F.struct("at", "key", "leaf", "fold"))).alias("members"))
    runs = stored(runs, "merkle-runs")
    nodes, roots, counts = build(runs, seen["trees"], depth, fan)
    # The first step up is within a run; a lone leaf makes none.
    own = F.expr(f"if(n > 1, transform(members, (m, j) -> {_folded('transform(members, x -> x.leaf)', 'j', 'm.fold')}), transform(members, m -> m.fold))")
    start = runs.withColumns({"folds": own, "n": F.expr(f"(n + {fan - 1}) div {fan}")}).withColumns(up(1, seen["trees"], depth, fan))
    met = climb(start.select("tree", "place", "up_tree", "up_node", "up_place", "folds"), nodes, counts, most_broadcast)
    hexed = lambda c: F.lower(F.hex(c))
    each = met.join(runs, ["tree", "place"]).select("tree", "folds", "siblings", F.transform("members", lambda m: m["leaf"]).alias("run"), F.posexplode("members").alias("i", "m"))
    beside = F.when(F.size("run") > 1, hex_of(F.filter("run", lambda d, j: j != F.col("i")))).otherwise("")
    fold = hexed(F.get("folds", F.col("i")))
    last = (roots if nodes is None else nodes.where("up_node is null").select(F.unhex(F.sha2(hex_of(F.col("run")), 256)).alias("digest"))).select(hexed("digest").alias("d")).first()
    root = F.lit(last["d"] if last else None).cast("string")
    out = each.join(bounded(roots, seen["trees"]), "tree")
    return out.select(F.col("m.key").alias(key), hexed("m.leaf").alias("leaf"), hexed("digest").alias("subroot"), root.alias("root"), F.sha2(F.concat(beside, hexed("siblings")), 256).alias("proof_sha256"), fold.alias("folded_root"), (fold == root).alias("verified"))


def tampered(key: str = "doc_id", text: str = "text", every: int = 3) -> Column:
    """The text, with A-Z lower-cased where ``every`` divides the CRC-32 of the key's digits."""
    return F.when(F.crc32(F.col(key).cast("string").cast("binary")) % every == 0, lower_ascii(F.col(text))).otherwise(F.col(text))


def _sql() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in (*FIELDS[:-1], text)) + ")"
    # CRC-32 by its table of 256 entries, which eight shifts of each make.
    entry = "n"
    for _ in range(8):
        entry = f"list_transform({entry if entry != 'n' else 'range(256)'}, lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 1 + strlen(k)), lambda i: CAST(ord(k[i]) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"
    out = f"""WITH RECURSIVE crc AS (SELECT {entry} AS t), d AS (SELECT *, CAST(doc_id AS VARCHAR) AS k FROM documents),
    e AS (SELECT d.*, {leaf("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS text_now FROM d, crc),
    l0 AS (SELECT doc_id, lang AS g, leaf, {leaf("text_now")} AS fold, '' AS sibs, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS place FROM e),
    n0 AS (SELECT g, place, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM l0)"""
    step = """,
    r{b} AS (SELECT g, place // 8 AS place, list(digest ORDER BY place) AS ds, (n + 7) // 8 AS n FROM n{a} WHERE n > 1 GROUP BY g, place // 8, n),
    n{b} AS (SELECT g, place, sha256(array_to_string(ds, '')) AS digest, n FROM r{b} UNION ALL SELECT g, place, digest, n FROM n{a} WHERE n = 1),
    l{b} AS (SELECT l.doc_id, l.g, l.leaf, CASE WHEN ds IS NULL THEN fold ELSE sha256(array_to_string(ds[: l.place % 8] || [fold] || ds[l.place % 8 + 2 :], '')) END AS fold,
      CASE WHEN ds IS NULL THEN sibs ELSE sibs || array_to_string(ds[: l.place % 8] || ds[l.place % 8 + 2 :], '') END AS sibs, CASE WHEN ds IS NULL THEN l.place ELSE l.place // 8 END AS place{more} FROM l{a} l LEFT JOIN r{b} r ON r.g IS NOT DISTINCT FROM l.g AND r.place = l.place // 8)"""
    # Trees of up to 8**7 leaves, and up to 8**3 of them.
    for k in range(7):
        out += step.format(a=k, b=k + 1, more="")
    out += """,
    n10 AS (SELECT 'top' AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS place, digest, count(*) OVER () AS n, g AS lang FROM n7),
    l10 AS (SELECT doc_id, 'top' AS g, leaf, fold, sibs, t.place, t.digest AS subroot FROM l7 JOIN n10 t ON t.lang IS NOT DISTINCT FROM l7.g)"""
    for k in range(10, 13):
        out += step.format(a=k, b=k + 1, more=", subroot")
    return out + " SELECT doc_id, leaf, subroot, n13.digest AS root, sha256(sibs) AS proof_sha256, fold AS folded_root, fold = n13.digest AS verified FROM l13, n13"


ORACLE = _sql()
