"""The registered queries of the text operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridewise.llm import chat, decontam, divergence, langid, packing, passages, pii, quality, sharding, simhash, toxicity, warc, whitening
from stridewise.llm.common import id_remainder, table

#: Shards of op12, components of op13.
SHARDS, COMPONENTS = 40, 8


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", (id_remainder(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(chat.PROBE).alias("text"))
    turns = turns.unionByName(probe)
    return chat.digests(chat.format_conversations(turns))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.detect(docs, pii.learn(docs), redacted=False).drop("text")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = langid.learn(docs)
    found = langid.predict(docs.select("doc_id", "text"), network)
    return found.select("doc_id", (id_remainder(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = quality.measure(docs, quality.REPORTED)
    found = quality.judge(measured, quality.plan(docs, have=quality.REPORTED), have=quality.REPORTED)
    return found.select("doc_id", *quality.REPORTED, "base_failed", "kept")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.shared_passages(table(spark, sf_dir, "documents"))
    return passages.by_document(found)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return found.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows, COMPONENTS)
    found = whitening.whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]) if model is not None and len(model.values) else F.array(F.lit(0.0))
    n, error = (model.n, model.identity_error) if model is not None else (0, 0.0)
    return found.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, "at").alias("explained"), F.lit(error).alias("identity_error"))


def queries() -> dict:
    found = (op1_toxicity, op2_chat, op3_warc, op4_packing, op5_pii, op6_language, op7_quality, op8_simhash, op9_passages, op10_decontamination, op11_divergence, op12_sharding, op13_whitening)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": chat.ORACLE, "op3_warc": warc.ORACLE, "op7_quality": quality.ORACLE, "op10_decontamination": decontam.ORACLE, "op11_divergence": divergence.ORACLE}
