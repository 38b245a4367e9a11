"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that its
predecessor kept. Its result is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.

Null and empty texts are documents like others: clean, one empty line, near
copies of each other only, one token to pack. Repeated rows are documents of
their own until the near-dedup, which leaves one. A null id is a document, and
names its class only if no other does. Extra columns stay under any names.
Empty tables go through all stages; without labels nothing counts as toxic,
without benchmark items nothing as contaminated.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterlake.llm import common, decontam, jaccard, lines, packing, simhash, toxicity
from scatterlake.session import ship


def _shipped(fn):
    """The stage with the package sent ahead. What it stages stays until its result is written, or ``common.release()``."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, docs, sf_dir)

    return run_stage


def _recount(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a text that has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


@_shipped
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the threshold or above go; the labels teach the model."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    if not model.trained:
        return docs
    score = common.fresh_name(docs, "__score")
    return toxicity.score(docs, model, out_col=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


@_shipped
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; every document stays."""
    out = lines.drop_common_lines(docs)
    return _recount(out.drop(*out.columns[-2:]))


@_shipped
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word similarity 0.8 or more stays, that of the smallest id; SimHash proposes pairs, whole sets verify them, a lossless join finds the rest."""
    return simhash.one_of_each(docs, words=jaccard.WORDS, classes_of=jaccard.near_classes)


@_shipped
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_items(docs, common.table(spark, sf_dir, "benchmark"))


@_shipped
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The classifier and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and read again.

    A stage's scratch tables and input go once its result is written; those
    that the returned rows read stay until ``common.release()``. Runs don't
    touch each other's tables.
    """
    docs = common.table(spark, sf_dir, "documents")
    with common.scope() as made:
        for number, (_, fn) in enumerate(STAGES):
            docs = fn(spark, docs, sf_dir)
            if number < len(STAGES) - 1:
                docs = common.stage(docs, f"pipeline-{number}")
                common.keep_only(made, docs)
    return docs
