"""A corpus pipeline of five stages over ``documents``, each written as Parquet and read again by the next.

1. language ID: documents without a letter, whose language can't be told, go; all others stay.
2. near-dedup: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked: pairs that
   SimHash's BK-trees propose are verified, and the pairs that SimHash misses come from an exact prefix filter; of
   each class the document with the smallest id stays.
3. benchmark decontamination: documents that hold a window of a benchmark item go.
4. PII: personal data and secrets become ``<KIND>`` in the text, and n_chars follows.
5. BPE: each document's token ids and their number.

Defined results: null, empty and blank texts have no letter and go in stage 1; texts of any length are processed whole;
documents with a null id are never dropped as copies; of documents that share an id, unlike texts all stay and of
equal ones one stays; an empty table gives an empty result; extra columns, whatever their names, pass through stages 1
to 4 and are left out by the last.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, langid, nearcopies, pii
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.shared import materialise, small_batches


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told."""
    small_batches(spark)
    return langid.keep_identified(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class; shingles of five words, as near-duplicate stages take."""
    small_batches(spark)
    return nearcopies.keep_one(docs, width=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redact personal data and secrets."""
    small_batches(spark)
    redacted = pii.redact_documents(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts; batches are smaller here, since an encoder's tables lie beside them in each worker."""
    small_batches(spark, 250, "4m")
    path = tokenizer_path()
    encoded = docs.select("doc_id", bpe.encoded_column(F.col("text"), path).alias("ids"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", encoding_stage),
]

#: SQL can express neither the language model nor the near copies' classes; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result but the last is written to the shared folder first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
