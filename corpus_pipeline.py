"""A corpus pipeline: language ID, near-duplicate removal, source mixing, BPE encoding.

Each stage works on all that the one before kept and, but for the last, returns the columns of
``documents``. Rows whose text is null, empty or without a letter are rejected by the first stage;
an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.bpe import encode_documents
from codeweft.llm.common import written
from codeweft.llm.langid import UNKNOWN, identify, train
from codeweft.llm.minhash import without_duplicates
from codeweft.llm.mixing import mix_sources

#: How often the mix may repeat a source; every document is taken at least once.
MAX_REPEAT = 2.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language (null, or without a letter) and writes the predicted one to ``lang``.

    Where the model knows nothing of a text (score 0) a given ``lang`` stays. Repeated rows stay, as do columns with names
    of our own (``lang_pred``, ``score``).
    """
    model = train(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    own = docs.columns
    found = identify(docs, model, own, names=("__lang", "__score"))
    if not model.languages:  # nothing to learn from: what has letters stays
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    lang = F.when(F.col("__score") > 0, F.col("__lang")).otherwise(F.coalesce("lang", "__lang")).alias("lang")
    return found.where(F.col("__lang") != UNKNOWN).select(*[lang if c == "lang" else F.col(c) for c in own])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, similarity 0.8. Of rows that repeat an id
    one stays; rows without an id all stay."""
    return without_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, up to MAX_REPEAT times, towards even weights; nothing is dropped. Rows come in the order of the mix."""
    return mix_sources(docs, max_repeat=MAX_REPEAT, columns=docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids; a row a row."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "source", "lang"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: The stages learn models and hash documents; tests/llm holds them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
