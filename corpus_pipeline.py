"""Corpus pipeline of the training-data operators (part of subpackage llm): from documents to token ids.

Each stage works on all rows its predecessor kept; all but the last return the columns of documents. Rows that share a
doc_id stay or go together in the duplicate stages, and equal rows among them are made one; a row with a null doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliq.llm import exact_dedup, mixing, ngram_join, quality, sentence_pieces
from ampliq.llm.common import bounded, table, written

#: Mixture: no source is passed over more often than this, and each at least once, so no document is lost.
MAX_REPEATS = 2.0


def _spare(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def _kept(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` but for the ids none of whose ``decisions`` (doc_id, kept) is to keep."""
    ids = written(decisions.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "decisions")
    gone = ids.where("not kept").select("doc_id")
    out = docs.join(bounded(gone), "doc_id", "left_anti").select(docs.columns)
    again = ids.where("kept and n > 1").select("doc_id")
    if again.limit(1).count():
        again = bounded(again)
        out = out.join(again, "doc_id", "left_anti").unionByName(out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(docs.columns)
    return out


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality; fitted on the labelled documents that are not held out."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = _spare(docs, "llm_score")
    return quality.scored(docs, model, out=score).where(F.col(score) >= 0.5).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _kept(docs, exact_dedup.dedup(docs).select("doc_id", "kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group joined by Jaccard similarities of 0.8 or more."""
    return _kept(docs, ngram_join.join(docs).select("doc_id", (F.col("doc_id") == F.col("class_id")).alias("kept")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mixture draws them: whole passes of their source and its partial last one."""
    draws = mixing.mix(docs, max_repeats=MAX_REPEATS).where("doc_id is not null").groupBy("doc_id").agg(F.countDistinct("pass").alias("draws"))
    n, turn = _spare(docs, "llm_draws"), _spare(docs, "llm_turn")
    draws = bounded(written(draws.withColumnRenamed("draws", n), "draws"))
    return (docs.join(draws, "doc_id", "left").withColumn(turn, F.explode(F.sequence(F.lit(1), F.coalesce(F.col(n).cast("int"), F.lit(1)))))
            .select(docs.columns))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip of every draw."""
    return sentence_pieces.encode(docs)


STAGES = [("quality classifier", quality_classifier), ("exact dedup", exact), ("n-gram Jaccard join", near),
          ("mixing sources to target weights", mixture), ("SentencePiece encoding and decoding", pieces)]
#: SQL can express neither the classifier nor the encoding; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
