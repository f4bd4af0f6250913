"""A training corpus from raw documents: clean, deduplicated, mixed and packed.

Each stage takes what its predecessor kept, as columns of ``documents``; the last one gives the pieces of
the packed sequences. Stages are deterministic, so one can be run again after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, mixing, packing, simhash, toxicity
from tidemark.llm.common import stored, table, word_count
from tidemark.llm.queries import vocabulary
from tidemark.session import configure


def _measured(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns of documents, with lengths of the texts as they are now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of confirmed toxic and unlabelled texts doesn't reject."""
    configure(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of three-line windows; documents of which nothing is left go."""
    configure(spark)
    cleaned = line_dedup.remove_repeats(docs)
    return _measured(cleaned.where("ld_removed = 0 OR ld_removed < ld_lines"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    configure(spark)
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row per time a document is taken, with the words taken."""
    configure(spark)
    size = "words"
    while size in docs.columns:
        size += "_"
    mixed = mixing.mix(docs.withColumn(size, word_count(F.col("text"))), size)
    return _measured(mixing.take(mixed), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in cost-balanced sequences."""
    configure(spark)
    return packing.cost_balanced_pieces(docs, vocabulary(), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

# A trained model, 64-bit shingle hashes and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
