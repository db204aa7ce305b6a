"""From message lines to keyed tables: documents, chunks with embeddings, and what could not be used."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.functions.text import trimmed
from loomlake.operators import retrieval as rt
from loomlake.operators.maintenance import route
from loomlake.sinks import KeyedTable, newest, newest_set
from loomlake.sources import messages
from loomlake.streaming import run_batches

Embedder = Callable[[DataFrame], DataFrame]

DOCUMENTS = "kb_id string, document_id string, user_id string, filename string, text string, message_id long, deleted boolean"
CHUNKS = "agent_id string, document_id string, chunk_index int, user_id string, filename string, text string, embedding array<double>, message_id long, deleted boolean"


@dataclass
class Ingest:
    """The tables that messages are written to.

    ``documents`` are keyed by (kb_id, document_id), ``chunks`` by (agent_id, document_id), all chunks of a document being one set;
    deletes are scoped in the same way.  Of each key the message with the largest ``message_id`` counts, in whatever order and however often they
    come; a delete stays as a mark, so an upload that was sent before it doesn't come back.  Lines that don't parse, types that
    aren't known, bad payloads and blank texts go to ``quarantine`` with the reason.
    """

    spark: SparkSession
    at: str
    embedder: Embedder
    buckets: int = 16

    def __post_init__(self) -> None:
        self._documents = KeyedTable(self.spark, f"{self.at}/documents", DOCUMENTS, ["kb_id", "document_id"], self.buckets)
        self._chunks = KeyedTable(self.spark, f"{self.at}/chunks", CHUNKS, ["agent_id", "document_id"], self.buckets)

    @property
    def documents(self) -> DataFrame:
        return self._documents.rows().where("not deleted").drop("deleted")

    @property
    def chunks(self) -> DataFrame:
        return self._chunks.rows().where("not deleted").drop("deleted")

    @property
    def quarantine(self) -> DataFrame:
        """message_id, reason, value of the lines that were not used; a batch's are overwritten if it comes again."""
        return self.spark.read.schema("message_id long, reason string, value string, batch_id long").parquet(f"{self.at}/quarantine")

    def run(self, lines: DataFrame) -> None:
        """Takes in a stream of (message_id, value), as far as it goes now."""
        run_batches(judged(lines), self.at, self.write)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.where("reason is not null").select("message_id", "reason", "value").write.mode("overwrite").parquet(f"{self.at}/quarantine/batch_id={batch_id}")
        good = batch.where("reason is null")
        kb = good.where("route in ('kb_context', 'delete_kb_document')").withColumn("deleted", F.col("route") != "kb_context")
        self._documents.upsert(batch_id, kb.select(*self._documents.schema.names), newest(["kb_id", "document_id"], ["message_id"]))
        key = ["agent_id", "document_id"]
        # Only the last message of a document is cut and embedded.
        n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("message_id")))
        last = good.where("route in ('agent_rag', 'delete_agent_document')").withColumn("_n", n).where("_n = 1").withColumn("deleted", F.col("route") != "agent_rag")
        keep = ["user_id", *key, "filename", "message_id", "deleted"]
        put = self.embedder(rt.chunk_table(last.where("not deleted").select(*keep, "text")))
        sets = put.unionByName(last.where("deleted").select(*keep), allowMissingColumns=True)
        self._chunks.upsert(batch_id, sets.select(*self._chunks.schema.names), newest_set(key, "message_id"))


def judged(lines: DataFrame) -> DataFrame:
    """Lines (message_id, value) with their fields, route, text, and the reason if they can't be used."""
    parsed = messages(lines).select("message_id", "value", "ok", "m.type", "m.user_id", "m.kb_id", "m.agent_id", "m.document_id", "m.filename", F.try_to_binary("m.content", F.lit("base64")).alias("_raw"))
    read = parsed.withColumns({"route": route(F.col("type")), "text": F.decode("_raw", "UTF-8")}).drop("_raw", "type")
    put = F.col("route").isin("kb_context", "agent_rag")
    reason = F.when(~F.col("ok"), "broken line").when(F.col("route") == "skip", "unknown type").when(put & F.col("text").isNull(), "not base64").when(put & (trimmed(F.col("text")) == ""), "blank text")
    return read.withColumn("reason", reason).drop("ok")
