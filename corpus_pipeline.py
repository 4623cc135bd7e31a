"""The corpus pipeline: five operators, each on all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the
columns of ``documents``.  :func:`run` writes each result to the shared folder and reads
it again, so a lost executor costs no more than its stage.  A stage called alone leaves the
session with small batches to Python, as its frame is run later; :func:`run` puts back what
was set before.

Defined cases: null texts, and texts without a letter, go in the first stage; an empty
table gives an empty result of the same columns; very long texts go through whole; of rows
that repeat in id and text one is left after the near duplicates, and of equal texts the
one of smallest id; null ids stay; columns other than those of ``documents`` are left out
at the first stage, so none can clash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.llm.bpe import encode_decode
from hashloom.llm.decontam import contamination
from hashloom.llm.jaccard import jaccard_components
from hashloom.llm.langid import fit, held_out, identify
from hashloom.llm.linededup import dedup_lines
from hashloom.llm.shared import forget, table, written

#: A text stays if its language is known with at least this mean marginal.
MIN_SCORE = 0.4
#: Bytes of a batch sent to Python: both sides hold it, for each core of an executor.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, whose frame is run in batches of BATCH_BYTES whoever runs it."""

    @wraps(stage)
    def out(spark: SparkSession, *args, **kwargs) -> DataFrame:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
        return stage(spark, *args, **kwargs)

    return out


@small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str, min_score: float = MIN_SCORE) -> DataFrame:
    """Texts of a known language; null texts and texts without letters go."""
    crf = fit(docs.filter(~held_out()))
    found = identify(docs.select(*COLUMNS), crf, keep_text=True)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return kept.select(*COLUMNS)


@small_batches
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated windows of lines go; so does a text that was nothing else."""
    cut = dedup_lines(docs.select(*COLUMNS), window=3).filter((F.col("n_removed") < F.col("n_lines")) | (F.col("n_lines") == 0))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


@small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the smallest id stays, of rows that
    repeat in id and text one; null ids stay."""
    groups = jaccard_components(docs.select("doc_id", "text"), words=5, share=(80, 100)).filter("doc_id is not null")
    # An id goes as a duplicate of a smaller one, or has several rows.
    told = groups.groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("stays"), F.count(F.lit(1)).alias("n"))
    marked = written(told.filter("n > 1 or not stays").select("doc_id", "stays"), "marked")
    whole = docs.select(*COLUMNS)
    # Only those rows travel, and all if ids of such rows are too many to be sent to the others.
    one = whole.join(marked.filter("stays").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return whole.join(marked.select("doc_id"), "doc_id", "left_anti").unionByName(one)


@small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of which a twentieth or more is benchmark go."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = contamination(docs.select(*COLUMNS), items, words=13, share=(1, 20), keep_text=True)
    return found.filter(~F.col("contaminated")).select(*COLUMNS)


@small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Token counts, digests of ids and of the decoded text."""
    import public_tokenizers

    return encode_decode(docs.select(*COLUMNS), model_path or public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = spark.conf.get(BATCH_KEY, None)
    try:
        for k, (name, stage) in enumerate(STAGES):
            before_it, docs = docs, written(stage(spark, docs, sf_dir), name)
            if k:  # what a stage has written is not read after the next one
                forget(before_it)
    finally:
        spark.conf.unset(BATCH_KEY) if before is None else spark.conf.set(BATCH_KEY, before)
    return docs


__all__ = ["COLUMNS", "MIN_SCORE", "ORACLE_SQL", "STAGES", "run"]
