"""From raw documents to packed training sequences: one stage for each decision.

Each stage takes all documents that the one before kept and returns documents with the
same columns; the last returns packed pieces. Between stages documents are written as
Parquet into the shared folder, so an executor that is lost costs one stage's work at
most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendframe.llm import mixing, near_dups, packing, repeats, toxicity
from spendframe.llm.common import documents, keep

SHINGLE_WORDS = 5  # of the near-duplicate stage


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the rejection score of a grammar learned from the labels.

    Null and empty texts have no match and stay; repeated rows stay or go together, row by
    row. Labels without doc_id, label or document are left out; without any, fixed insults
    decide. Very long texts are scored whole. An empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~toxicity.held_out())
    return toxicity.clean(docs, toxicity.train(docs, labels))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least doc_id in each component, once.

    Rows are told apart by number: of repeated rows and of copies without doc_id one stays,
    and null ids come last in the choice; ties go to the least hash of the row. Null, empty
    and blank texts are like nothing and all stay. Very long texts are compared whole.
    """
    return near_dups.one_of_each(docs, width=SHINGLE_WORDS)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that stand anywhere else.

    Null texts come out empty, and texts under 200 bytes as they are. Equal rows repeat one
    another and lose both copies; the stage before leaves one. A character that loses some
    of its bytes goes whole. ``n_chars`` follows the new text.
    """
    columns = docs.columns
    cut = repeats.remove_repeats(docs, [c for c in columns if c not in ("doc_id", "text")])
    kind = dict(docs.dtypes)
    return cut.select(*[
        F.col("kept_text").alias("text") if c == "text" else F.length("kept_text").cast(kind[c]).alias(c) if c == "n_chars" else F.col(c) for c in columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated until the sources have their weights.

    A null source is one of its own. Texts without words, null ones too, take no part and
    go. Rows are told apart by number, so repeated rows and null ids meet their own
    decision; ties of the seeded order are broken by it. ``n_chars`` follows a cut text.
    """
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens, with their ids.

    Null and empty texts are the end id alone. Repeated rows and copies of the mix are
    packed one by one, ties by doc_id, null last. Long texts are cut into whole sequences.
    """
    return packing.pack(docs, "word_bpe_49k.json", end_id=2)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeated_strings", cut_repeated_strings),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # learned scores, banding and packing are beyond SQL; tests/llm compares the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
