"""A corpus from raw documents to tokens: five stages, each on all that the one before kept.

Rows are judged by their texts.  Null ids and ids that repeat change nothing: no stage
joins or drops rows by doc_id.  Null, empty and wordless texts have no language and go in
the first stage; of equal rows the near-duplicate stage keeps one.  Empty tables give an
empty result, and columns besides those of documents are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import bpe, decontam, langid, secrets, setsketch
from starloom.llm.common import written
from starloom.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language is less likely than this is rejected, as one without letters is.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language; the others get the predicted one."""
    known = langid.language_id(docs, keep=("text", "source", "n_chars")).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return known.withColumnRenamed("lang_pred", "lang").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays (five words, 0.8): that of the smallest id.

    Five words are the rule for near-duplicates; op9's own contract asks for four.
    """
    return setsketch.one_of_each(docs.select(COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; all documents stay."""
    found = secrets.find_secrets(docs, keep=COLUMNS)
    clean = found.withColumn("text", secrets.redacted("text", "all_spans"))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (uint32, little-endian) of each text, and whether they decode to it."""
    out = bpe.encode_documents(docs, tokenizer_path(), keep=["text", "lang", "source", "n_chars"])
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "bpe_ids", same.alias("round_trip"))


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("secret_scan", secret_spans), ("bpe", tokens)]

#: Trained language and randomness models are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one stage returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
