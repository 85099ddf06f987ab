"""The corpus pipeline: five stages over documents, each written as Parquet before the next reads it.

1. quality classifier: documents whose score is under REJECT_BELOW go;
2. MinHash near-dedup (five-word shingles, similarity 0.8): of each group the smallest doc_id stays;
3. substring dedup (13 words): repeated passages leave all documents but the one with the smallest
   doc_id; a document of which nothing is left stays as an empty text;
4. benchmark decontamination (10 words): hit spans are cut out, and documents of which more than
   MAX_COVERAGE of the words are hit go;
5. best-fit packing of the tokens into sequences of 2048.

A stage's rows have the columns of documents, but for the last stage's pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import compression_classifier, decontamination, near_dedup, packing, substring_dedup
from blockloom.llm.queries import tokenizer_path
from blockloom.llm.shared import NULL_ID, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REJECT_BELOW = 0.5
MAX_COVERAGE = 0.5
BROADCAST_IDS = 500_000
"""Ids that near-dedup drops, at most, which are broadcast; more are joined by shuffle."""


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches REJECT_BELOW.  Null and empty texts score like a text that tells
    nothing; repeated rows score alike; without labels of both classes all score 0.5 and stay."""
    model = compression_classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = compression_classifier.score(docs, model, carry=("lang", "source", "n_chars"), keep_text=True)
    return scored.where(F.col("score") >= REJECT_BELOW).select(*COLUMNS)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of one number a document, ordered as doc_id is: doc_id itself unless it repeats.

    Where it does, rows equal in id and text become one, and the others are numbered anew."""
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        return docs, "doc_id"
    order = F.coalesce("doc_id", F.lit(NULL_ID))
    ordered = docs.dropDuplicates(["doc_id", "text"]).repartitionByRange(order, F.sha2("text", 256)).sortWithinPartitions(order, F.sha2("text", 256))
    return written(ordered.withColumn("number", F.monotonically_increasing_id()), "pipeline-numbered"), "number"


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.  Null and empty texts have
    no copies and stay, null ids stay unless their id's column repeats ids (then they are numbered
    last).  Of rows equal in id and text one stays; rows with one id and different texts are judged
    one by one."""
    docs, number = _numbered(docs)
    dropped = written(near_dedup.near_dedup(docs, id_col=number, shingle=5, percent=80).where("not kept").select(number).distinct(), "pipeline-copies")
    few = dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.select(*dict.fromkeys((number, *COLUMNS))).join(F.broadcast(dropped) if few else dropped, number, "left_anti").select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has; a null text stays null, rows
    with one id don't remove each other's words, and a null id counts as the largest."""
    done = substring_dedup.substring_dedup(docs, window=13, carry=("lang", "source", "n_chars"))
    return done.select("doc_id", F.col("full_text").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.char_length("full_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages, and without documents that are mostly such passages.  Null
    texts stay null; repeated rows are judged alike; without items nothing changes."""
    done = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, max_coverage=MAX_COVERAGE, carry=("lang", "source", "n_chars"))
    return done.where("not rejected").select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.when(F.col("contaminated"), F.char_length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's tokens in sequences of 2048, as often as it comes; null and empty texts are an end id."""
    return packing.pack(docs, tokenizer_path(), capacity=2048, end_id=0, ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None
"""Tokens and compressed sizes are beyond SQL; tests/llm holds the stages against plain Python."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
