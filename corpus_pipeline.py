"""A corpus pipeline of five stages, each a table of documents from its predecessor's: language ID, SimHash near-dedup, substring dedup, mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm import bpe, langid, mixing, simhash, substring
from sylvan.llm.entry import tokenizer_path
from sylvan.llm.shared import crc_mod, cut, documents

#: Cosine below which a text is in no known language: letters drawn without a language's habits stay under it.
REJECT = 0.1
#: Distinct trigrams from which so low a cosine says something. Beginnings of a quarter of sf0.1's texts had 0.34 at least from 100 on; shorter ones in a learned language can have 0.02.
GRAMS = 100


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without letters (null and empty texts too) go, and those far from every prototype if they have enough trigrams to tell.

    Rows are judged one by one: repeated rows and rows without an id fare as their texts do. An empty table gives an empty one.
    """
    model = langid.train(docs.where(crc_mod("doc_id", 5) != 0))
    found = langid.predict(docs.select(F.struct(*docs.columns).alias("row")), model, ["row"], nested=True)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & ((F.col("score") >= REJECT) | (F.col("n_grams") < GRAMS))).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that with the smallest doc_id; null and empty texts are one component.

    Of rows that share this id one stays. Rows without an id all stay. An empty table gives an empty one.
    """
    return simhash.representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller doc_id has; the others' texts stay as they are, a null one becomes empty.

    Every row stays, if need be with an empty text; n_chars follows the text. Rows without an id lose nothing. An empty table gives an empty one.
    """
    found = substring.remove_repeats(docs, tuple(c for c in docs.columns if c != "text"), layout=True)
    own = {"text": F.col("kept_text")} | ({"n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return found.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates say, so that domains' expected tokens meet the target weights.

    Null and empty texts have a rate like any other. Rows that share an id get the largest of their rates; rows without an id stay once. An empty table gives an empty one.
    """
    return mixing.dealt(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row's text; null and empty texts have none. An empty table gives an empty one."""
    return bpe.encode_decode(docs, tokenizer_path(), ["doc_id"])


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix_sources", mix_sources), ("tokenize", tokenize)]
#: SimHash, the fitted model and BPE have no SQL twin; no test holds the whole pipeline against a brute-force version yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
