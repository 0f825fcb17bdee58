"""From documents to packed training sequences: STAGES in order, each reading what the last one wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch
from tessera.llm.components import sized
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.language_id import accepted_languages, fit
from tessera.llm.ngram_join import ngram_components
from tessera.llm.packing import pack_documents
from tessera.llm.secrets import redact_live
from tessera.llm.word_pieces import word_ids

#: A document goes if its main language has less than this share of its words.
LEAST_SHARE = 0.4
TOKENIZER = "word_bpe_49k.json"
#: Rows of an Arrow batch: whole texts can be long, and executors hold a few batches for each task.
BATCH_ROWS = 200


def few_rows(spark: SparkSession) -> None:
    """Bounds the Arrow batches of what the session writes from now on, after memory of the stage before is given back."""
    give_back(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def give_back(spark: SparkSession) -> None:
    """Lets the executors collect their garbage, in twice as many tasks as run at a time: a full collection
    shrinks the heap and frees buffers outside it, which would stay beside the workers of the next stage."""
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts, texts without letters, and mixtures in which no
    language has LEAST_SHARE of the words."""
    few_rows(spark)
    return accepted_languages(docs, fit(docs), LEAST_SHARE)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text, white space aside, of equal ones that of the least identifier (null ranks
    last); null and empty texts are one text."""
    few_rows(spark)
    return exact_dedup(docs, carry=True).where("kept").select("row.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least identifier of each group of near copies (five words, 0.8).

    Null texts, texts without words and rows with a null identifier stay; all rows of a dropped identifier
    go, so identifiers should be unique."""
    few_rows(spark)
    gone = ngram_components(docs, n=5, percent=80).where("doc_id <> component_id").select("doc_id")
    return docs.join(sized(Scratch(spark).keep(gone, "gone")), "doc_id", "left_anti").select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blanks live-looking credentials; every document stays, and n_chars follows its text (null for
    null texts)."""
    few_rows(spark)
    return redact_live(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs token pieces into sequences of 2048; rows count one by one, null texts as empty."""
    few_rows(spark)
    import public_tokenizers

    return pack_documents(docs, word_ids(public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: Learned and hashed stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
