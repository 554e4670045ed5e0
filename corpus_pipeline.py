"""A training corpus from raw documents: five stages, each over all that the one before has kept.

All stages take documents as they come: null and empty texts, texts of any length, repeated rows
and ids, further columns whatever their names, and empty tables, which give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import BROADCAST_ROWS, table, written
from gleanery.llm.decontaminate import find_benchmark
from gleanery.llm.line_dedup import line_dedup
from gleanery.llm.minhash_dedup import near_duplicates
from gleanery.llm.packing import pack
from gleanery.llm.toxicity import toxicity, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not call toxic. Null and empty texts stay;
    where no labels of both classes are there, all do."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model).where("toxic = 0").select(docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more share; ``n_chars`` follows the text. Null texts come back empty; a
    row that repeats is a document of its own, also where lines are counted."""
    return line_dedup(docs).select([F.char_length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, a similarity of 0.85) the document with the least id. Documents
    without words are in no group; all rows of an id stay or go together, and rows without an id stay."""
    gone = written(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs. Null and empty texts stay."""
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens, the sources mixed evenly. Every row is packed, one without
    text as its end id; a null source is a source like any other."""
    out = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can't express the compression distances of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the whole table; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
