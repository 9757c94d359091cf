"""The corpus pipeline: documents through the stages in order, each written as Parquet and read again."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, nearcopies, sentencepieces, substrings, toxicity
from palimpsest.llm.common import stored

#: near copies: five-word shingles of similarity 0.8 and more; texts are compared if one of 24 bands of 5 minima is equal, or
#: if the fingerprints of their distinct words are within 4 of 64 bits and those of their shingles within 14
NEAR = {"words": 5, "distance": 4, "count": 3, "check_distance": 14, "bands": 24, "rows": 5}
#: words of a passage that is cut where an earlier document has it too
PASSAGE = 50


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plain(docs: DataFrame) -> DataFrame:
    """The same columns, all but doc_id and text under names that no operator uses; ``toDF`` gives the names back."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(docs.columns)])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    labels, plain = toxicity.chain_labels(_table(spark, sf_dir, "labels")), _plain(docs)
    return toxicity.scored(plain, labels).where(~F.col("rejected")).select(*plain.columns).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id, and of different texts with this doc_id that
    with the smallest hash. Of rows that repeat doc_id and text the first by a hash of all columns stays; rows without a
    doc_id all stay."""
    # texts move once more: the join and the choice among repeated rows are dealt by the same keys
    plain = _plain(docs)
    heads = stored(nearcopies.heads(plain, **NEAR).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_head")), "heads")
    keyed = plain.where("doc_id is not null").withColumn("_text", nearcopies.text_hash())
    turn = F.row_number().over(Window.partitionBy("doc_id", "_text").orderBy(F.xxhash64(*plain.columns)))
    once = keyed.join(heads, (F.col("doc_id") == F.col("_id")) & (F.col("_text") == F.col("_head"))).select(
        *plain.columns, turn.alias("_turn")).where("_turn = 1")
    return once.drop("_turn").unionByName(plain.where("doc_id is null")).toDF(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has too; where words go, the others are joined by one space, and
    ``n_chars`` is counted anew where the table has it."""
    plain = _plain(docs)
    made, cut = substrings.deduplicated(plain, PASSAGE), F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        size = plain.columns[docs.columns.index("n_chars")]
        new[size] = F.when(cut, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(size))
    return made.withColumns(new).select(*plain.columns).toDF(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids, their number and digest, and whether decoding gives the text back."""
    return sentencepieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: neither the classifier nor the pieces can be expressed in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for the table documents of ``sf_dir``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
