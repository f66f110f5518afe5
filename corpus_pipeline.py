"""From raw documents to token ids: a stage for each operator, each on all rows that the one before it kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of docs, extra ones with whatever names included, with nulls in any of them.

Whole texts of any length are read, by stretches where that bounds memory. An empty table gives an empty result in every stage. The stages tell what they
make of null and empty texts, null ids, ties and repeated rows (equal in all columns).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lonepoint.llm import bpe, common, line_dedup, mixing, ngram_join, quality


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null or empty text is one empty line, and is judged as such. Repeated rows stay or go together. Null ids are never labelled, and judged like
    others. A score equal to the threshold stays. Without labels of both kinds all stay.
    """
    return quality.keep_good(docs, common.read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and near lines one occurrence stays; documents stay, with the lines that they keep.

    Null texts stay null, lines without letters or digits stay as they are, and a text that loses all its lines is empty. The occurrence in the
    document with the smallest id stays (null ids come last), there the first. Rows with equal id and text keep the same lines.
    """
    return line_dedup.dedup_lines(docs)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays.

    That with the smallest id (null ids come last). Texts without words, as null and empty ones, are no duplicates of anything and stay. Of rows with
    equal id and text one stays, that with the smallest hash of its columns.
    """
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times, the rows of an output shard together and in its random order.

    Texts without words, as null and empty ones, have no size and are never taken. Null is a source of its own. Repeated rows are documents of
    their own. Ties in the order drawn are settled by id and text.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, checked by decoding: doc_id, source, n_tokens, ids, and digests of ids and decoded bytes.

    A row for each row; null and empty texts have no ids.
    """
    return bpe.transcode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "ids", "ids_sha256", "decoded_sha256"), keep=("doc_id", "source"))


STAGES = [("quality", classify), ("line dedup", dedup_lines), ("n-gram join", join_ngrams), ("mix", mix_sources), ("encode", encode)]

#: SimHash, the trained classifier and the draws of the mix have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
