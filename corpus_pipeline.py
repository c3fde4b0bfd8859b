"""The corpus pipeline: quality rules, SimHash near-dedup, mixing to target weights, SentencePiece encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soukspark.llm import common, mixing, quality, sentencepieces, simhash
from soukspark.llm.queries import MIX_SEED, SP_ALPHA, SP_SEED, TARGETS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep, with their columns, whatever those are called.

    Null and empty texts have no words and go. Texts of any length are judged whole and each by itself, so rows that
    repeat stay or go alike. An empty table gives an empty table.
    """
    name = common.free_name(docs, "quality")
    return quality.quality(docs, name=name).where(F.col(f"{name}.kept")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts of similarity 0.8 or more over five-word shingles, the document of smallest id.

    Texts without a word, null ones included, are alike. Rows with a null id stay and stand for no other; rows that repeat
    an id stay or go together. Columns of any name pass through. An empty table gives an empty table.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample raked to the target shares of source, language and topic: seven tenths of the tokens, or as many as hold
    the shares without a document coming twice.

    Null sources and languages and null texts count with values that have no target; documents without words are drawn
    by their cell's chance. Rows that repeat an id and its cell are drawn together. Columns of any name pass through. An
    empty table gives an empty table.
    """
    topic, size = (common.free_name(docs, x) for x in ("topic", "n_tokens"))
    names = tuple(common.free_name(docs, x) for x in ("mix_weight", "mix_expected", "mix_copies"))
    rows = docs.withColumns({topic: mixing.topic("text"), size: mixing.tokens("text")})
    out = mixing.mix(rows, ["source", "lang", topic], TARGETS, size, rate=0.7, seed=MIX_SEED, names=names)
    return out.where(F.col(names[2]) > 0).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, lang, sp_ids, sp_lossless``: sampled segmentations, seeded by doc_id; other columns end here.

    A null text has null ids, an empty one the mark alone. Whole texts are encoded. Rows that repeat an id and text get
    equal ids; a null id is one too. An empty table gives an empty table.
    """
    rows = docs.select("doc_id", "source", "lang", "text")
    out = sentencepieces.encoded(rows, public_tokenizers.path("piece_bpe_32k.model"), alpha=SP_ALPHA, seed=SP_SEED)
    return out.select("doc_id", "source", "lang", "sp_ids", "sp_lossless")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode_pieces", encode_pieces)]
#: SQL has no SimHash, and its engine no sampler of segmentations; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
