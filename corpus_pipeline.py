"""From raw documents to token ids: a corpus pipeline of five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents;
the last one returns token ids. Extra columns of the input are dropped at the first stage.

Defined results: null ids stay through the filters (an id is needed to be a copy of something); a text that is null or
has no letter is rejected by the first stage; repeated rows become one in the second; in the fourth a row may come
twice or not at all, as the weights ask; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import block_naming, byte_bpe, language_id, mixing, order_minhash
from foliospark.llm.common import Scratch, crc_mod, documents, materialise
from foliospark.llm.queries import bpe_files
from foliospark.llm.shingles import without

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if its language has at least this share of the probability.
LEAST_SCORE = 0.4
#: Pieces that a tokenizing worker remembers, twice: fewer than by default, beside what earlier stages hold.
MEMO = 1 << 15


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those of no clear language."""
    docs = docs.select(*COLUMNS)
    model = language_id.train(docs.where(crc_mod(F.col("doc_id"), 3) != 1), "text", "lang")
    scored = language_id.predict(docs, model, carry=tuple(F.col(c) for c in COLUMNS))
    return scored.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return block_naming.keep_one(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    docs = docs.select(*COLUMNS)
    gone = materialise(order_minhash.near_dedup(docs).where("not kept").select("doc_id").distinct())
    return without(docs, "doc_id", gone)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs.select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to."""
    path, pattern = bpe_files()
    back = byte_bpe.encode(docs.select(*COLUMNS), path, pattern, decoded="decoded", memo=MEMO)
    return back.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("bpe", tokenize),
]

#: SQL can't say the learned and sketched stages; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote on the way goes when its result is written."""
    docs = documents(spark, sf_dir)
    scratch = Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
            scratch.end(docs)
    return docs
