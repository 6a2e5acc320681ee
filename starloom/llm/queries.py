"""The registered queries of the text operators: thin, whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, langid, lm, secrets, setsketch, sharding, tokencount
from . import quality as rules
from .common import shared_path


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary files of this machine are."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Edits of the token-count query: runs of junk characters go, runs of blanks become one.
EDITS = [(r"([#*$%&|<>])\1\1+", ""), (r"[ \t]{2,}", " ")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.edited_counts(table(spark, sf_dir, "documents"), tokenizer_path(), EDITS)


#: A conversation whose text is made of control strings, besides the table's.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.segments(turns.unionByName(probe)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "n_tokens", F.sha2("bpe_ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def _kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", _kind("base_spans", 0).alias("n_assign"), _kind("base_spans", 1).alias("n_access"), _kind("base_spans", 2).alias("n_hex"),
        F.sha2(secrets.joined("base_spans"), 256).alias("base_sha256"), secrets.joined("all_spans").alias("spans"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Arrivals of the sharding query: documents by id modulo this.
ARRIVALS = 8


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in ARRIVALS batches; the result is read from the compacted store."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, shared_path(spark, "shards"), target_bytes=64 << 20, small_bytes=1 << 20)
    arrival = F.coalesce(F.pmod("doc_id", F.lit(ARRIVALS)), F.lit(0)).cast("bigint")
    store.append(docs.select("doc_id", "text", "lang", "source", "n_chars", arrival.alias("arrival"), arrival.alias("batch")), "batch")
    store.compact(expire=1)
    return store.read().select("doc_id", "arrival", "source", "n_chars", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    own = (op1_token_counts, op2_chat_format, op3_language_id, op4_bpe, op5_secret_scan, op6_quality_rules, op7_sharding, op8_lm_score, op9_near_duplicates, op10_decontaminate)
    return {f.__name__: f for f in own}
