"""From documents to packed training sequences: five stages, each one operator of ``fieldloom.llm``.

Each stage's rows are written as Parquet and read again by the next. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm import mixing, near_dup, packing, quality, substring
from fieldloom.llm.common import numbered, save
from fieldloom.session import ship

#: Words of a passage that is removed where it repeats.
PASSAGE = 50


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows that the ordinal classifier takes for toxic or poor.

    Every row is judged by its own text: null and empty texts have the score of no words, equal rows the
    same score, long texts are read whole, and ids play no part. An empty table stays empty."""
    ship(spark)
    rated = quality.rate(docs, quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")), carried=tuple(docs.columns))
    return rated.where("kept").select("rest.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, 0.8 or more): that of the
    smallest id, and of several texts of one id the one of the least hash; a null id comes first.

    Equal rows of one id are one document, of which one row stays; different texts of one id are documents
    of their own. Null texts and those without words are like no other. Other columns aren't read."""
    ship(spark)
    rows, twice = numbered(docs, "__row")
    copies = near_dup.near_duplicates(rows, shingle=5, threshold=0.8, id_col="__row").where(~F.col("kept")).select(F.col("doc_id").alias("__row")).distinct()
    rows = rows.join(copies, "__row", "left_anti")
    if twice:
        nth = F.row_number().over(Window.partitionBy("__row").orderBy(F.xxhash64(*[c for c in docs.columns if dict(docs.dtypes)[c][:3] != "map"])))
        rows = rows.withColumn("__nth", nth).where("__nth = 1")
    return rows.select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of PASSAGE words or more that occur earlier; what is left empty by that goes.

    Earlier is a smaller id (null first), of several texts of one id the lesser hash, or an earlier place.
    Equal rows of one id are one document and keep the same words; null texts and short ones stay as they
    are; ``n_chars`` is counted anew."""
    ship(spark)
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = substring.remove_repeats(docs, window=PASSAGE, carried=rest).where("n_removed = 0 or n_removed < n_words")
    fresh = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*[(fresh[c] if c in fresh else F.col(f"rest.{c}")).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each row as often as its source's target asks for, at most twice.

    Null and empty texts have no words and aren't taken; a null source is a source of its own; rows that
    repeat an id or are equal are taken each by its own chance."""
    ship(spark)
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all rows into sequences of 4096 tokens, one row a piece.

    Every row is packed, copies as often as they come; a null or empty text is its end token alone."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("substring_removal", without_repeats), ("mixing", mixed), ("packing", packed)]

#: Classifying, hashing and rounding are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
