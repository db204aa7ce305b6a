"""Chunks, embeddings, nearest neighbours and prompt context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from loomlake.functions.text import chunks
from loomlake.sources import write_joined
from loomlake.storage import durable

FILES = "These are the files that belong to this assistant. Rely on them where the question is about them, and add nothing that they don't say."
CONTEXT = "These passages were found for the question. Rely on them where they help, and add nothing that they don't say."

#: Results that a query may ask for.
MOST_RESULTS = 50
#: Vectors of a block that one task holds, about, and scores that it computes at a time.
BLOCK, SCORES = 8192, 1 << 22
#: Bytes of repeated texts that rows of one share hold, about (one row if its text alone is longer).
SHARE_BYTES = 32 << 20
#: Links that meet a document at a time (a multiple of eight, as Parquet packs so many values together), and pairs of a task from which on a collection is dealt out.
LINKS, PAIRS = 256, 1 << 20


def chunk_table(documents: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """A row for each chunk, numbered among a document's kept chunks; null and blank texts have none."""
    keep = [c for c in documents.columns if c != "text"]
    return documents.select(*keep, F.posexplode(chunks(F.col("text"), size, overlap)).alias("chunk_index", "text"))


def documents_of_collection(documents: DataFrame, collection: str, document: str = "document_id", name: str = "filename", size: int = 1000, overlap: int = 150) -> DataFrame:
    """The documents of each collection that have chunks, with their number of chunks and (first) name.

    Chunks are counted row by row and never moved; a document that occurs twice has the chunks of both.
    """
    n = F.size(chunks(F.col("text"), size, overlap)).cast("long")
    # The filter stands behind the sum: pushed below it, it would cut every text a second time.
    return documents.groupBy(collection, document).agg(F.sum(n).alias("chunks"), F.min(name).alias(name)).where("chunks > 0")


def fit_embedder(texts: DataFrame, column: str = "text", dim: int = 256) -> Callable[[DataFrame], DataFrame]:
    """An offline embedder, fitted once: hashed word counts, weighted by inverse document frequency, of length 1.

    It adds ``embedding`` (array of double) to any table with that column; tables that one embedder was applied
    to, such as the batches of a stream, share one space.  Rows without a word have a zero vector.
    """

    def counted(rows: DataFrame) -> DataFrame:
        filled = rows.withColumn("_text", F.coalesce(column, F.lit("")))
        words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"(?U)\W+").transform(filled)
        return HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim).transform(words)

    weights = IDF(inputCol="_counts", outputCol="_weighted").fit(counted(texts.select(column)))

    def embedder(rows: DataFrame) -> DataFrame:
        unit = Normalizer(inputCol="_weighted", outputCol="_unit").transform(weights.transform(counted(rows)))
        return unit.withColumn("embedding", vector_to_array("_unit")).drop("_text", "_words", "_counts", "_weighted", "_unit")

    return embedder


def batch_embedder(model: Callable[[list[str]], list[list[float]]], column: str = "text", batch: int = 64, tries: int = 3, wait_seconds: float = 0.5) -> Callable[[DataFrame], DataFrame]:
    """An embedder that asks a model, a batch of texts at a time: adds ``embedding`` (array of double) and ``embedding_error``.

    ``model`` is called in tasks with a list of texts and gives a vector for each; it has to be picklable and may call a remote service.
    A batch that fails is tried ``tries`` times in all, with a longer wait each time; then its texts are asked for one by one,
    so that one bad text fails alone.  An empty vector is an error, as is a number of vectors that isn't the texts'.  Rows with an error have a
    null embedding.  Null texts aren't asked for and have neither.
    """
    import time

    def ask(texts: list[str], left: int) -> list[list[float]]:
        for n in range(left):
            try:
                vectors = model(texts)
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
                return vectors
            except Exception:
                if n == left - 1:
                    raise
                time.sleep(wait_seconds * 2**n)
        return []

    def each(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            vectors = ask(texts, tries)
        except Exception as error:
            if len(texts) > 1:
                return [x for t in texts for x in each([t])]
            return [(None, f"{type(error).__name__}: {error}"[:500])]
        return [([float(x) for x in v], None) if len(v) else (None, "empty vector") for v in vectors]

    def embedder(rows: DataFrame) -> DataFrame:
        schema = StructType([f for f in rows.schema if f.name not in ("embedding", "embedding_error")]).add("embedding", ArrayType(DoubleType())).add("embedding_error", StringType())
        place = schema.names.index(column)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, batch):
                    part = whole.slice(start, batch)
                    texts = part.column(place).to_pylist()
                    known = iter(each([t for t in texts if t is not None]) if any(t is not None for t in texts) else [])
                    found = [(None, None) if t is None else next(known) for t in texts]
                    columns = [pa.array([v for v, _ in found], pa.list_(pa.float64())), pa.array([e for _, e in found], pa.string())]
                    yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=schema.names)

        return rows.select(*schema.names[:-2]).mapInArrow(run, schema)

    return embedder


def embed(texts: DataFrame, column: str = "text", dim: int = 256, embedder: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``embedding``, by an embedder that is plugged in, or else by one that is fitted on these texts."""
    return (embedder or fit_embedder(texts, column, dim))(texts)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """A vector of length 1 in double; null for a zero or null vector."""
    # The norm is bound to a lambda's variable: written inside the inner lambda, it would be computed for each element.
    both = F.array(F.struct(vector.alias("v"), F.sqrt(dot(vector, vector)).alias("norm")))
    return F.get(F.transform(both, lambda s: F.when(s["norm"] > 0, F.transform(s["v"], lambda x: x.cast("double") / s["norm"]))), F.lit(0))


def top_k(queries: DataFrame, items: DataFrame, tenant: list[str], k: int | str = 5, key: str = "id", digits: int = 6) -> DataFrame:
    """The nearest items of the same tenant by cosine: the queries' columns, the item's key, score = (1 + cos) / 2, rank.

    Both sides are dealt into blocks of about ``BLOCK`` rows of a tenant; every block of queries meets every
    block of items, as a product of two matrices, and only a query's best go on.  ``k`` may be a column of the queries, up to
    ``MOST_RESULTS``.  Ties in the rounded score go to the smaller key; zero vectors take no part, and vectors of different length don't meet.
    """
    # No condition on the vectors stands here: it would be pushed below an embedder, and every text be embedded once more for it.
    q = queries.withColumnRenamed("embedding", "_q")
    x = items.select(*tenant, key, F.col("embedding").alias("_x"))
    # Rows are counted without their vectors.
    blocks = lambda rows, name: rows.groupBy(*tenant).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    dealt = blocks(queries, "_queries").join(blocks(items, "_items"), tenant)
    place = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = q.join(dealt, tenant).withColumn("_a", place("query_id", "_queries")).withColumn("_b", each("_items")).drop("_queries", "_items")
    held = x.join(dealt, tenant).withColumn("_b", place(key, "_items")).withColumn("_a", each("_queries")).drop("_queries", "_items")
    kept = [c for c in q.columns if c != "_q"]
    schema = StructType([q.schema[c] for c in kept]).add(key, x.schema[key].dataType).add("_dot", DoubleType())
    meet = block_best(kept, key, MOST_RESULTS if isinstance(k, str) else k, digits)
    pair = [*tenant, "_a", "_b"]
    # Queries and items may come of one table: new columns can't be mistaken for it.
    held = held.select(*[F.col(c).alias(c) for c in held.columns])
    best = asked.groupBy(*pair).cogroup(held.groupBy(*pair)).applyInArrow(meet, schema)
    scored = best.withColumn("score", F.round((F.lit(1.0) + F.col("_dot")) / 2, digits)).drop("_dot")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
    # A constant bound lets every task keep that many rows of a query before the shuffle.
    return ranked.where((F.col("rank") <= MOST_RESULTS) & (F.col("rank") <= F.col(k))) if isinstance(k, str) else ranked.where(F.col("rank") <= k)


def block_best(kept: list[str], key: str, k: int, digits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a block of queries (``kept``, ``_q``) and one of items (key, ``_x``): whatever may be among a query's first ``k`` by rounded score and key."""

    def vectors(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Rows and matrix of the unit vectors of each length; null and zero vectors, and those that hold a null, are left out."""
        flat = column.combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(flat), 0).to_numpy(zero_copy_only=False)
        out = {}
        for d in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == d)
            entries = flat.take(pa.array(rows)).flatten()
            whole = ~np.asarray(entries.is_null()).reshape(-1, d).any(axis=1)
            matrix = entries.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            norm = np.sqrt((matrix * matrix).sum(axis=1))
            good = whole & (norm != 0)
            if good.any():
                out[int(d)] = rows[good], matrix[good] / norm[good, None]
        return out

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, held = [], []
        dots = [np.empty(0)]
        if left.num_rows and right.num_rows and k > 0:
            # Items in the order of their keys, so that of equal ones the first come first.
            right = right.take(pc.sort_indices(right, sort_keys=[(key, "ascending")]))
            x = vectors(right.column("_x"))
            for d, (rows, q) in vectors(left.column("_q")).items():
                if d in x:
                    places, matrix = x[d]
                    step = max(1, SCORES // len(places))
                    for start in range(0, len(rows), step):
                        for row, dot in zip(rows[start : start + step], q[start : start + step] @ matrix.T):
                            size = np.where(np.isnan(dot), np.inf, dot)
                            # All that the rounding of (1 + dot) / 2 may put level with the k-th one.
                            least = np.partition(size, len(size) - k)[len(size) - k] - 4 * 10.0**-digits if len(size) > k else -np.inf
                            at = np.flatnonzero(size >= least)
                            at = at[np.argsort(-size[at], kind="stable")]
                            # Of copies of one vector only the first k.
                            fresh = np.append(True, size[at][1:] != size[at][:-1])
                            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                            at = at[nth < k]
                            asked.append(np.full(len(at), row))
                            held.append(places[at])
                            dots.append(dot[at])
        a, h = (np.concatenate(p) if p else np.empty(0, np.int64) for p in (asked, held))
        columns = [*left.select(kept).take(pa.array(a, pa.int64())).columns, right.column(key).take(pa.array(h, pa.int64())), pa.array(np.concatenate(dots))]
        return pa.table(columns, names=[*kept, key, "_dot"])

    return meet


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``n``, from 1 within each group."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def numbered_of_lists(links: DataFrame, documents: DataFrame, parent: str, place: str, collection: str, order: list[str]) -> DataFrame:
    """Links with the documents of their collections, and ``n``: from 1 for each parent, by place in its list, then by ``order``.

    Documents are numbered in their collection once, and a parent adds the sizes of the collections before: there are far more pairs of
    a parent and a document than either, and they aren't sorted or moved.  Only where two collections share a place are its pairs numbered one by one.
    Links meet documents in blocks of ``LINKS``, so that pairs come in runs of one document and the same links come again with the next one: in that
    order Parquet took a sixth of a byte for each (of 1.28 billion), and five link by link.
    """
    ranked = numbered(documents, [collection], order)
    sizes = documents.groupBy(collection).agg(F.count("*").alias("_size"))
    mine = Window.partitionBy(parent)
    before = mine.orderBy(place).rangeBetween(Window.unboundedPreceding, -1)
    held = links.join(sizes, collection).withColumn("_at", F.count("*").over(Window.partitionBy(parent, place)))
    held = held.withColumns({"_mixed": F.max("_at").over(mine) > 1, "_before": F.coalesce(F.sum("_size").over(before), F.lit(0))}).drop("_at", "_size")
    mixed = numbered(held.where("_mixed").drop("_mixed", "_before").join(documents, collection), [parent], [place, *order])
    # Every collection is dealt over shares, each of which meets its links: few collections would else be few tasks.
    most = 4 * documents.sparkSession.sparkContext.defaultParallelism
    pairs = links.groupBy(collection).agg(F.count("*").alias("_links")).join(sizes, collection)
    dealt = pairs.select(collection, F.least(F.lit(most), F.ceil(F.col("_links") * F.col("_size") / PAIRS)).cast("int").alias("_shares"))
    total = max(1, dealt.agg(F.sum("_shares")).first()[0] or 0)
    own = [c for c in links.columns if c != collection]
    block = F.floor((F.row_number().over(Window.partitionBy(collection).orderBy("_before", place, parent)) - 1) / LINKS)
    blocks = held.where("not _mixed").withColumn("_block", block).groupBy(collection, "_block").agg(F.array_sort(F.collect_list(F.struct("_before", place, parent, *[c for c in own if c not in (place, parent)]))).alias("_list"))
    here = blocks.join(dealt, collection).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_block", "_shares")
    there = ranked.join(dealt, collection).withColumn("_share", F.pmod(F.xxhash64(*order), F.col("_shares")).cast("int")).drop("_shares")
    there = there.repartition(total, collection, "_share").hint("merge")  # blocks are gone through, and for each of them the documents of its share
    met = here.repartition(total, collection, "_share").join(there, [collection, "_share"]).withColumn("_link", F.explode("_list"))
    plain = met.select(collection, *[F.col("_link")[c].alias(c) for c in own], *[c for c in documents.columns if c != collection], (F.col("n") + F.col("_link._before")).cast("int").alias("n"))
    return plain.unionByName(mixed)


def listed(rows: DataFrame, group: list[str], block: Column, order: list[str], intro: str, out: str) -> DataFrame:
    """One text for each group: an introduction and the rows' blocks in order, parted by blank lines."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, block.alias("_block")))), lambda x: x["_block"])
    return rows.groupBy(*group).agg(F.rtrim(F.concat(F.lit(intro + "\n\n"), F.array_join(parts, "\n\n")), F.lit("\n")).alias(out))


def with_long_text(rows: DataFrame, texts: DataFrame, sizes: DataFrame, key: str, order: str) -> DataFrame:
    """Each row with the (long) text of its key, where there is one.

    A text is repeated in every row, so rows of a key are dealt into shares of about ``SHARE_BYTES``, each of which gets the text once: a task that
    had all rows of a key would hold their texts together, as a Parquet writer keeps a hundred rows before it looks at their size.
    ``sizes``: key, n (rows of the key, at most) and bytes (of its text, about).
    """
    each = F.greatest(F.lit(1), F.floor(F.lit(SHARE_BYTES) / F.greatest("bytes", F.lit(1))))
    dealt = sizes.select(key, each.alias("_each"), F.ceil(F.col("n") / each).cast("int").alias("_shares"))
    total = max(1, dealt.agg(F.sum("_shares")).first()[0] or 0)
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    left = rows.join(dealt.drop("_shares"), key, "left").withColumn("_share", F.floor(n / F.coalesce("_each", F.lit(1))).cast("int")).drop("_each")
    right = texts.join(dealt.drop("_each"), key).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    both = [key, "_share"]
    return left.repartition(total, *both).join(right.repartition(total, *both), both, "left").drop("_share")


def listed_in_files(rows: DataFrame, key: str, order: list[str], block: Callable[[Column], Column], at: str) -> DataFrame:
    """As ``listed``, for long texts: a key's blocks (of the number of a row, from 1, and its columns), each with a blank line behind it, lie in a file of their own below ``at``.

    Gives the key, ``path`` and ``bytes``; rows are written as they come, so no text is held whole.
    """
    rows = rows.where(F.col(key).isNotNull())
    # Rows of a key are in one partition and in order, as they were numbered there.
    blocks = numbered(rows, [key], order).sortWithinPartitions(key, *order).select(key, F.concat(block(F.col("n")), F.lit("\n\n")).alias("content"))
    name = F.concat(F.sha1(F.col(key).cast("string")), F.lit(".txt"))
    files = write_joined(blocks.select(name.alias("name"), "content"), at)
    return rows.select(key).distinct().withColumn("name", name).join(files, "name").drop("name")


def with_listed(rows: DataFrame, files: DataFrame, key: str, order: str, intro: str, own: str, out: str, kept: list[str] | None = None) -> DataFrame:
    """Each row (its columns ``kept``, or all but ``own``) with ``out``: the intro and its key's file of ``listed_in_files``, where there is one, and then its own text, parted by a blank line.

    Such texts are far longer than the rows, and each is made once, where the row is given out: rows are dealt into tasks by the bytes of their files,
    ``SHARE_BYTES`` each or one row with a longer file, and only then is the file read.  A task so holds one text; a Parquet writer
    keeps a hundred rows before it looks at their size, and a shuffle would hold all copies.
    """
    rows, kept = durable(rows), kept or [c for c in rows.columns if c != own]
    sized = files.join(rows.groupBy(key).agg(F.count("*").alias("_n"), F.max(F.octet_length(own)).alias("_own")), key)
    sized = sized.withColumn("_weight", F.least(F.lit(SHARE_BYTES), F.col("bytes") + F.coalesce("_own", F.lit(0)) + 1))
    # A row for each key: the weight of all rows of the keys before.
    before = F.coalesce(F.sum(F.col("_n") * F.col("_weight")).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = durable(sized.withColumn("_before", before))
    shares = sized.agg(F.max(F.floor((F.col("_before") + F.col("_n") * F.col("_weight")) / SHARE_BYTES))).first()[0]
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    place = F.floor((F.col("_before") + n * F.col("_weight")) / SHARE_BYTES).cast("int")
    bare = rows.join(sized.select(key), key, "left_anti").withColumn(out, F.coalesce(own, F.lit("")))
    if shares is None:
        return bare.select(*kept, out)
    held = rows.join(sized.select(key, F.col("path").alias("_path"), F.col("bytes").alias("_bytes"), "_before", "_weight"), key).withColumn("_place", place)
    held = held.repartitionById(int(shares) + 1, "_place").sortWithinPartitions("_path").withColumn("_own", F.coalesce(own, F.lit("")).cast("binary"))
    schema = StructType([rows.schema[c] for c in kept]).add(out, StringType())
    return held.select(*kept, "_path", "_bytes", "_own").mapInArrow(text_maker(kept, intro, schema), schema).unionByName(bare.select(*kept, out))


def text_maker(kept: list[str], intro: str, schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (``kept``, ``_path``, ``_bytes``, ``_own``), those of a file next to each other, to rows with their texts, each in a batch of its own."""
    first = f"{intro}\n\n".encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, end, now = np.empty(0, np.uint8), 0, None
        for batch in batches:
            longest = max((len(x.as_buffer()) for x in batch.column("_own")), default=0) + 2
            for i, (path, size, own) in enumerate(zip(batch.column("_path").to_pylist(), batch.column("_bytes").to_pylist(), batch.column("_own"))):
                if path != now:
                    room = np.empty(len(first) + size + longest, np.uint8)
                    room[: len(first)] = np.frombuffer(first, np.uint8)
                    end, now = read_whole(path, room, len(first), size), path
                    while end and room[end - 1] == 10:
                        end -= 1
                elif len(room) < end + longest:
                    room = np.concatenate([room[:end], np.empty(longest, np.uint8)])
                more = own.as_buffer()
                more = b"\n\n" + more.to_pybytes() if len(more) else b""
                # The row before was sent when this one is asked for, so one text is in memory and not one for each row.
                room[end : end + len(more)] = np.frombuffer(more, np.uint8)
                text = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, end + len(more)], np.int32)), pa.py_buffer(room))
                yield pa.RecordBatch.from_arrays([*batch.select(kept).slice(i, 1).columns, text], names=schema.names)

    return run


def read_whole(path: str, room: np.ndarray, start: int, size: int) -> int:
    """Reads a file of so many bytes into an array from ``start`` on, and returns where it ends there."""
    store, where = fs.FileSystem.from_uri(path)
    view, got = memoryview(room)[start : start + size], 0
    with store.open_input_stream(where) as source:
        while got < size:
            if not (n := source.readinto(view[got:])):
                raise EOFError(f"{path} has {got} bytes, not {size}")
            got += n
    return start + size


def context_block(number: Column, text: Column) -> Column:
    return F.concat(F.lit("[Context "), number.cast("string"), F.lit("]\n"), text)


def file_block(number: Column, name: Column, text: Column) -> Column:
    named = F.when(F.coalesce(name, F.lit("")) == "", F.concat(F.lit("file-"), number.cast("string"))).otherwise(name)
    return F.concat(F.lit("[File: "), named, F.lit("]\n"), text)


def prompt(*blocks: Column) -> Column:
    """Non-empty blocks, parted by blank lines."""
    return F.concat_ws("\n\n", *[F.nullif(b, F.lit("")) for b in blocks])


def context_sizes(links: DataFrame, documents: DataFrame, parent: str, collection: str) -> DataFrame:
    """Files, characters and bytes of each parent's (an agent's) collections, and of each collection: parent, collection, files, ...

    Rows with a null collection are the parent's totals.  Texts are measured in place; parents join sums only.
    """
    of_one = documents.groupBy(collection).agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("characters"), F.sum(F.octet_length("text")).alias("bytes"))
    each = links.select(parent, collection).join(of_one, collection)
    return each.rollup(parent, collection).agg(*[F.sum(c).alias(c) for c in ("files", "characters", "bytes")]).where(F.col(parent).isNotNull())


def last_user_message(conversations: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last user message of each conversation, or its last message if it has none."""
    said = F.when(F.col("role") == "user", F.struct(order, "text"))
    return conversations.groupBy(key).agg(F.coalesce(F.max(said)["text"], F.max_by("text", order)).alias("text"))


def excerpt(text: Column, most: int) -> tuple[Column, Column]:
    """'binary' (a NUL occurs) or 'text', and the first ``most`` bytes with a note of the size if there are more.

    A character that the cut would split goes as a whole.  Null stays null.
    """
    data = F.encode(text, "UTF-8")
    n = F.octet_length(text)
    # Bytes 0x80 to 0xBF go on with a character: the cut moves back to where one begins (three bytes at most).
    goes_on = lambda back: F.conv(F.hex(F.substring(data, most + 1 - back, 1)), 16, 10).cast("int").between(0x80, 0xBF)
    cut = F.decode(F.substr(data, F.lit(1), F.when(~goes_on(0), F.lit(most)).when(~goes_on(1), F.lit(most - 1)).when(~goes_on(2), F.lit(most - 2)).otherwise(F.lit(most - 3))), "UTF-8")
    note = F.concat(F.lit("\n(cut; "), n.cast("string"), F.lit(" bytes in all)"))
    return F.when(F.instr(text, "\0") > 0, "binary").when(text.isNotNull(), "text"), F.when(n > most, F.concat(cut, note)).otherwise(text)


def schema_errors(df: DataFrame, wanted: dict[str, str]) -> list[str]:
    """What a table lacks of its declared columns and types; more columns are fine."""
    have = dict(df.dtypes)
    return [f"{c}: {have.get(c, 'missing')}, not {t}" for c, t in wanted.items() if have.get(c) != t]


def require_schema(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    if errors := schema_errors(df, wanted):
        raise ValueError("; ".join(errors))
    return df


def dimensions(vectors: DataFrame, wanted: int, column: str = "embedding") -> DataFrame:
    """How many vectors have each dimension, and how many of them not the wanted one."""
    return vectors.groupBy(F.size(column).alias("dim")).agg(F.count("*").alias("n"), F.count_if(F.size(column) != wanted).alias("bad"))
