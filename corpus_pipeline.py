"""The corpus pipeline: quality rules, toxicity, line dedup, near-dedup and packing, each on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausegrid.llm import line_dedup, packing, quality, registry, simhash, toxicity
from clausegrid.llm.common import cut, table

#: Near duplicates: words of a shingle, and the least Jaccard similarity of two texts' shingles.
SHINGLE_WORDS, LEAST_SIMILARITY = 5, 0.8



def set_aside(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, so that no name of theirs meets one of a stage."""
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(0)]).alias("rest"))


def brought_back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, in their order."""
    return rows.select(*(c if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are.

    Null and empty texts have no words and go. Rows are judged one by one: repeated rows, ties and null ids change nothing; very long texts
    are judged whole. Other columns stay, whatever their names. An empty table gives an empty table.
    """
    return brought_back(quality.assess(set_aside(docs)).where("kept"), docs)


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, as they are; the models are fitted on the labelled ones among them.

    Null and empty texts have no features and stay unless the base rate itself is above the threshold. Rows are judged one by one: repeated rows and
    null ids change nothing, but a repeated doc_id is fitted once; very long texts are judged whole. Without labelled documents all stay. Other
    columns stay, whatever their names. An empty table gives an empty table.
    """
    rows = set_aside(docs)
    model = toxicity.train(rows, table(spark, sf_dir, "labels"))
    return brought_back(toxicity.score(rows, model).where(~F.col("is_toxic")), docs)


def by_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share, but for those of the largest doc_id; n_chars, if it is there, follows the text.

    Null texts count as one empty line and come back empty. Rows that repeat a doc_id are one document for the count and each loses its lines; rows with a
    null doc_id keep theirs. Very long texts are rewritten whole. Other columns stay, whatever their names. An empty table gives an empty table.
    """
    kept = brought_back(line_dedup.dedup_lines(set_aside(docs)), docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def by_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates: five-word shingles, Jaccard similarity 0.8 or more.

    Null and empty texts are one group. Rows with a null doc_id stay, and rows that repeat the smallest doc_id all stay. Very long texts are compared
    whole. Other columns stay, whatever their names. An empty table gives an empty table.
    """
    return brought_back(simhash.keep_one(set_aside(docs), width=SHINGLE_WORDS, least=LEAST_SIMILARITY), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in training sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows and rows with a null doc_id are packed like all others; only very long texts are
    cut. Other columns are not returned. An empty table gives an empty table.
    """
    return packing.pack_documents(docs, registry.word_tokenizer_path())


STAGES = [("quality", by_quality), ("toxicity", by_toxicity), ("line_dedup", by_lines), ("near_dedup", by_near_duplicates), ("packing", packed)]

#: SQL cannot express the classifier chain, the fingerprints' links or the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages; every stage's result is stored once before the next one reads it, as several pass over it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
