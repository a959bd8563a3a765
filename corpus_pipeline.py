"""Corpus preparation: STAGES over documents, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm.langid import identify, learn, with_letter
from gapwise.llm.lines import dedup_lines
from gapwise.llm.minhash import drop_near_duplicates
from gapwise.llm.packing import pack_documents
from gapwise.llm.suffixes import kept_texts
from gapwise.shared import remove_later, shared_folder

WORD = r"[^\x20\x09-\x0D]"


def _again(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names``, with n_chars that fits the new text."""
    if "n_chars" in names:
        docs = docs.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return docs.select(*names)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter (``und``) go. Nulls of lang are filled in.

    If nothing can be learned (no labelled document has a letter), the documents
    with a letter stay as they are, with a null lang where it was null.
    """
    apart = docs.select(*[F.col(f"`{c}`").alias(c if c in ("text", "doc_id") else f"c{k}") for k, c in enumerate(docs.columns)])
    samples = learn(docs)
    if samples:
        found = identify(apart, samples).where("lang_pred <> 'und'")
    else:
        found = with_letter(apart).withColumn("lang_pred", F.lit(None).cast("string"))
    own = [F.col(c if c in ("text", "doc_id") else f"c{k}") for k, c in enumerate(docs.columns)]
    return found.select(*[(F.coalesce(x, "lang_pred") if c == "lang" else x).alias(c) for x, c in zip(own, docs.columns)])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without near repeats of earlier lines; documents that have no word left go.

    A null text counts as empty and loses nothing, so its row stays, with an
    empty text. Rows that repeat id and text have one result. No rows give none.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    x = dedup_lines(docs, carry=rest).where((F.col("n_removed") == 0) | F.col("kept_text").rlike(WORD))
    x = x.withColumnRenamed("kept_text", "text")
    return _again(x.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else x, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8.

    Texts without a word are near to none and stay. Of rows that repeat id and
    text one stays. Null ids come last. No rows give none.
    """
    return drop_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes that occur earlier; documents that lose bytes and have no word left go.

    A character of which some bytes go goes whole. A null text counts as empty.
    No rows give none.
    """
    x = kept_texts(docs)
    return _again(x.where(~F.col("__cut") | F.col("text").rlike(WORD)), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in windows of 1024 ids; a null or empty text is one closing id. No rows give none."""
    import public_tokenizers as P

    return pack_documents(docs, P.path("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", repeats), ("packing", packing)]

#: Automata, suffix arrays and tokenizers are beyond SQL; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result goes to Parquet in the shared folder and is read again.

    The folder goes when the application ends, since the result is read from it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    remove_later(spark, folder)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        to = f"{folder}/{i}-{name.replace(' ', '_')}"
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
    return docs
