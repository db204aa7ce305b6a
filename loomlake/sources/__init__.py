"""Sources: message envelopes and uploaded files."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.storage import durable

#: Files of a table that one micro-batch reads at most.
FILES_PER_BATCH = 256
#: Uploaded files and their bytes that a task reads, about, and that it gives out at a time.
TASK_FILES, TASK_BYTES = 10_000, 128 << 20
READ_ROWS, READ_BYTES = 1000, 16 << 20

ENVELOPE = "type string, user_id string, kb_id string, agent_id string, document_id string, filename string, content string, trace map<string,string>"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; the table may be one file or a folder, so the path is given as a pattern."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(f"{sf_dir}/{name}.parque[t]")


def messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """Envelopes of JSON lines: ``m`` and whether the line is ``ok`` (an object that parses); bad ones are for quarantine."""
    kind = f"{ENVELOPE}, _bad string"
    m = F.from_json(column, kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("m", m).withColumn("ok", F.col("m").isNotNull() & F.col("m._bad").isNull())


def uploads(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """Files in a folder and those below it, with names of a pattern (``*``, ``?``, ``[...]``), as (path, length, content); those without a byte are passed over.

    Folders are listed in tasks, level by level, and the lists stay there: Spark's own reader gathers the state of every file in the driver.
    A folder's own list is held by one task.  Names that begin with a dot or an underscore are left out, as by Spark's readers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        for batch in batches:
            for start in range(0, batch.num_rows, READ_ROWS):
                held, size = [], 0
                for name in batch.column("path").slice(start, READ_ROWS).to_pylist():
                    with store.open_input_stream(f"{root}{name}") as source:
                        held.append((f"{path.rstrip('/')}{name}", source.read()))
                    size += len(held[-1][1])
                    if size > READ_BYTES:
                        yield _contents(held)
                        held, size = [], 0
                yield _contents(held)

    files = _files_below(spark, path, names)
    n, total = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(min(n, spark.sparkContext.defaultParallelism), -(-n // TASK_FILES), -(-total // TASK_BYTES), 1)
    return files.repartition(tasks, "path").mapInArrow(read, "path string, length long, content binary")


def _contents(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
    paths, contents = [p for p, _ in held], [c for _, c in held]
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([len(c) for c in contents], pa.int64()), pa.array(contents, pa.binary())], names=["path", "length", "content"])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(path)
    return store, root.rstrip("/")


def _files_below(spark: SparkSession, path: str, names: str) -> DataFrame:
    """(path below the folder, length) of its files, at any depth."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                shown = [x for x in store.get_file_info(fs.FileSelector(f"{root}{folder}")) if x.base_name[0] != "." and (x.base_name[0] != "_" or "=" in x.base_name)]
                kept = [x for x in shown if x.type == fs.FileType.Directory or x.size and fnmatchcase(x.base_name, names)]
                for start in range(0, len(kept), READ_ROWS):
                    part = kept[start : start + READ_ROWS]
                    lengths = [None if x.type == fs.FileType.Directory else x.size for x in part]
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x.base_name}" for x in part], pa.string()), pa.array(lengths, pa.int64())], names=["path", "length"])

    out, folders = None, spark.range(1).select(F.lit("").alias("path"))
    while True:
        level = durable(folders.mapInArrow(look, "path string, length long"))
        found = level.where("length is not null")
        out = found if out is None else out.unionByName(found)
        below = level.where("length is null").select("path")
        if below.isEmpty():
            return out
        folders = below.repartition(4 * spark.sparkContext.defaultParallelism, "path")


def write_files(rows: DataFrame, at: str) -> int:
    """Writes a file for each row (name, content) into a folder that exists for driver and executors, and returns their number.

    Tasks write through Arrow's file systems (local, HDFS, S3, GCS), as Spark's writers rename and chmod every single file, which takes many times as long.
    ``name`` may begin with folders; a task that is run again writes the same files.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(at)
        made = set()
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                folder = f"{root}/{name}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("name", F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content")).mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_joined(rows: DataFrame, at: str) -> DataFrame:
    """Writes a file for each ``name`` into a folder that exists for driver and executors: its contents one after another, as its rows come.

    Rows of a name have to be in one partition and next to each other; a task holds a batch of them, and no file whole.  Null contents are passed
    over, and a name without others has no file.  Gives name, path and bytes of each file, once they are written.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(at)
        store.create_dir(root, recursive=True)
        now, out, done = None, None, []
        try:
            for batch in batches:
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                    if out is None or name != now:
                        if out is not None:
                            out.close()
                        now, out = name, store.open_output_stream(f"{root}/{name}")
                        done.append([name, 0])
                    out.write(content.as_buffer())
                    done[-1][1] += len(content.as_buffer())
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([f"{at}/{n}" for n, _ in done], pa.string()), pa.array([b for _, b in done], pa.int64())], names=["name", "path", "bytes"])

    return durable(rows.where("content is not null").select("name", F.col("content").cast("binary").alias("content")).mapInArrow(put, "name string, path string, bytes long"))
