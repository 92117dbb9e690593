"""From raw documents to token files, in stages that each read what the one before has written.

1. quality: documents below the learned quality threshold go.
2. near_duplicates: of each class of near-duplicates one document stays, of those with the least doc_id.
3. decontamination: documents with a passage of the benchmark go.
4. mixture: sources come near their target weights; a document stands as often as the mix takes it, rounded (from
   0 to 3 times), with its whole text.
5. token_files: token ids in files; the rows are those of the files, read back.

All stages but the last return the columns of documents, whatever other columns there are. ``doc_id`` of a document
that the mix repeats is repeated.

Null and empty texts are scored as empty texts by stage 1, are no duplicates of each other, match nothing, and have no
words, so that the mix never takes them. Unrelated documents with null or equal doc_id all stay where they would with
ids of their own; equal rows are one document from stage 2 on. Ties go by hashes of texts. An empty table gives no rows
at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import decontamination, mixture, near_duplicates, quality_ranker, token_files
from ravelin.llm.shared import packed, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold that the labels give; all labels are learned from."""
    ranker = quality_ranker.train(docs, table(spark, sf_dir, "labels"))
    rows = quality_ranker.scored(docs.select(packed(docs), "text"), ranker)
    return rows.where(F.col("quality_score") >= ranker.cut).select("row.*")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.read_files(token_files.write_files(docs, tokenizer=token_files.public_tokenizer()), with_ids=False)


STAGES = [
    ("quality", quality),
    ("near_duplicates", dedup),
    ("decontamination", decontaminate),
    ("mixture", mix),
    ("token_files", tokens),
]

#: SQL has no expression for these stages; tests compare them with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
