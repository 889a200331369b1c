"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.session import materialize, work_dir

from . import (
    chat, decontamination, embeddings, language, lexical, lines, mixing, pii, simhash, token_counts, token_output, toxicity, whitening,
)
from .common import share, table

TOKENIZER = "word_bpe_49k.json"
COUNTED = "byte_bpe_50k.json"
END_ID = 2
TOXIC = 0.7


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def folder(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/threadlens/{label}-{uuid.uuid4().hex}"


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, radius=2)


def toxicity_machine(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Machine:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.train(docs.select("doc_id", "text"), labels, share(F.col("doc_id"), 3) != 1)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_machine(spark, docs, sf_dir))
    return scored.select(
        "doc_id", F.coalesce(share(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rates = mixing.rates(docs, mixing.smoothed(docs))
    return mixing.mix(docs.select("doc_id", "source", "text"), rates, columns=("__copy",)).withColumnRenamed("__copy", "copy")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "tokens")
    token_output.write(table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    return token_output.read(spark, path)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = share(F.col("doc_id"), 4)
    model = language.train(docs.where(fold != 2))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *(pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    made = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema)
    parts = turns.unionByName(made).withColumn("parts", chat.text_parts(F.col("text")))
    return chat.digests(materialize(chat.format_turns(parts), "chat"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path(COUNTED)).drop("text")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=8)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_language_id, op3_token_output, op4_embedding_near_dedup, op5_benchmark_decontamination,
        op6_personal_data, op7_line_dedup, op8_chat_formatting, op9_toxicity, op10_source_mixing, op11_token_counts,
        op12_embedding_whitening, op13_lexical_search,
    )
}

SQL = {
    name: (Path(__file__).parent / "sql" / f"{name}.sql").read_text()
    for name in (
        "op4_embedding_near_dedup", "op5_benchmark_decontamination", "op7_line_dedup", "op8_chat_formatting", "op10_source_mixing",
        "op13_lexical_search",
    )
}
