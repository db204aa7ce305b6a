"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.llm import decontaminate, jaccard, language, packing, suffixes
from loomlake.llm.common import fresh, ship_code, table
from loomlake.storage import discard, new_folder

#: Passages of so many words that occur more than once are cut, as strings of 400 bytes are.
PASSAGE_WORDS = 51
#: Documents with more than this fraction of words in benchmark windows are rejected.
MOST_HIT = 0.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter; a low score alone doesn't, as clean short texts are in doubt too."""
    ship_code(spark, lean=True)
    model = language.fit(docs.where(~language.held_out()))
    label, score = fresh("_lang", docs), fresh("_score", docs)
    return language.predict(docs, model, label, score).where(F.col(label) != language.NONE).drop(label, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: five-word shingles, similarity of 0.8 or more."""
    ship_code(spark, lean=True)
    return jaccard.keep_one(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 400 bytes, and passages of over 50 words, that occur more than once out of the texts."""
    ship_code(spark, lean=True)
    return suffixes.remove_repeats(docs, length=400, passage=PASSAGE_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item."""
    ship_code(spark, lean=True)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), most=MOST_HIT)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, each with its sequence and place."""
    ship_code(spark, lean=True)
    import public_tokenizers

    # Workers that earlier stages have used keep fewer words in memory.
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, keep_words=150_000)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: No stage but decontamination can be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; between them tables are written to the cluster's shared folder.

    A table goes when the next one is written; the last one stays, as the result reads it.
    """
    folder = new_folder(spark, "corpus-pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{i}")
            docs = spark.read.parquet(path)
            if before is not None:
                discard(spark, before)
            before = path
    return docs
