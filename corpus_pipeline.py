"""The corpus pipeline: language ID, near-dedup, suffix-array dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of docs. Between stages the rows are
written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bagminhash, langid_cnn, packing, secrets_forest, suffix_dedup
from tideline.llm.common import apart, forget, materialize, mod_of_id
from tideline.llm.queries import byte_bpe

#: A document goes if its text has no letter or no language reaches this score (four even chances give 0.25).
LEAST_LANGUAGE_SCORE = 0.35


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or of no language that was learned, go; null ids and repeated rows are judged like others."""
    net = langid_cnn.fit(docs, mod_of_id("doc_id", 5) != 0)
    own, back = apart(docs, "text")
    found = langid_cnn.identify(own, net)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*back)


def _counted(rows: DataFrame) -> DataFrame:
    """n_chars after texts have changed, where there is such a column."""
    if "n_chars" not in rows.columns:
        return rows
    return rows.withColumn("n_chars", F.char_length("text").cast(rows.schema["n_chars"].dataType))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the least id stays, once; rows without an id stay."""
    classes = bagminhash.classes(docs.select("doc_id", "text"), least=0.8, size=5)
    first = classes.where("doc_id = class_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null")).select(*docs.columns)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every occurrence of a passage that occurs twice goes, of 400 bytes or of 50 words; null texts stay null, no row goes."""
    return _counted(suffix_dedup.without_repeats(docs, length=400, words=50))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Accepted findings are replaced by a mark wherever they stand in the text; no row goes."""
    found = materialize(secrets_forest.findings(docs), "findings")
    labelled = materialize(secrets_forest.examples(spark), "examples")
    return _counted(secrets_forest.redact(docs, secrets_forest.secrets(found, labelled=labelled)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, byte_bpe(), window=2048, end_id=1)


STAGES = [
    ("language ID", known_language),
    ("near-dedup", one_of_each_group),
    ("suffix-array dedup", no_repeated_passages),
    ("secret scan", no_secrets),
    ("packing", packed),
]

#: No SQL: a trained network, a trained forest and a tokenizer decide. tests/llm/ hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(before)  # what a stage wrote goes once the next has written
    return STAGES[-1][1](spark, docs, sf_dir)
