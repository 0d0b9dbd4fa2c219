"""The queries opN_<name> and the pipeline, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fingerprint, html_text, jaccard_join, line_dedup, packing, pii, quality, sql, subword, warc
from .common import prepare, table


def word_tokenizer() -> str:
    """The public tokenizer of the packing query, as JSON; read on the driver and broadcast from there."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~quality.in_training("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations: their length, a checksum of the ids, and whether the ids decode to the text."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    out = subword.round_trip(table(spark, sf_dir, "documents"), model, seed=17, dropout=0.1)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"),
        (F.col("text") == F.coalesce("source", F.lit(""))).alias("lossless"),
    )


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email to n_phone count the base spans, as base_sha256 does; n_added counts those that the field adds."""
    found = pii.pii_spans(table(spark, sf_dir, "documents"))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in pii.KINDS],
        F.sha2(told(F.col("base")), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.fingerprints(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        fingerprint.to_text(F.col("sketch")).alias("fingerprint"),
        fingerprint.to_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = [op1_quality, op2_line_dedup, op3_sentencepiece, op4_html_text, op5_warc, op6_pii, op7_fingerprint, op8_jaccard_join, op9_exact_dedup, op10_packing, pipeline]


def queries() -> dict:
    return {f.__name__: (lambda spark, sf_dir, f=f: f(prepare(spark), sf_dir)) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
