"""A corpus pipeline of five stages; each stage's rows are written as Parquet and read again by the next.

Cases, for all stages: a null or empty text stays as it is until it is packed as an end id alone (the suffix stage drops
a document only if it loses all of a text that it had); a very long text is handled whole; rows with one id are judged
together where a document is dropped by its id, and rows with a null id are kept; ties go to the smallest id; an empty
table gives an empty result; other columns, whatever their names, are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punchdeck.llm import decontaminate, order_minhash, packing, quality, suffix_dedup
from punchdeck.llm.common import written
from punchdeck.llm.queries import CAPACITY, table, tokenizer

#: Passages of over 50 words are to go; in bytes their length differs by language.
REPEATED_WORDS = 51


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    rows = quality.judged(docs, table(spark, sf_dir, "labels")).filter("kept")
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    out = written(order_minhash.near_duplicates(docs).filter("not kept").select("doc_id"), "copies")
    return docs.join(out, "doc_id", "left_anti").select(*docs.columns)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of ``REPEATED_WORDS`` words or 400 bytes that repeat; a document that loses all its text goes."""
    rows = docs.select(F.struct("*").alias("doc"), "text")
    cut = suffix_dedup.without_repeats(rows, words=REPEATED_WORDS)
    cut = cut.filter((F.coalesce(F.length("doc.text"), F.lit(0)) == 0) | (F.length("text") > 0))
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return cut.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of sequences."""
    return packing.pack(packing.pieces(docs, tokenizer("byte_bpe_50k.json"), CAPACITY, end_id=0, room=250_000), CAPACITY)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("suffix_dedup", suffix_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: SQL expresses neither the fitted classifier nor alignment nor tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
