"""The queries ``opN_<name>``: each operator over its whole table, with production parameters."""

from __future__ import annotations

from . import (alignment, byte_bpe, chat, html_text, merkle, mixing, neural_lm, pii, quality_mil,
               quality_rules, simhash, toxicity, winnowing)
from .common import table


def op1_html_extraction(spark, sf_dir):
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op2_lm_scoring(spark, sf_dir):
    return neural_lm.score_documents(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_mil.score(docs, quality_mil.fit(docs, table(spark, sf_dir, "labels")))


def op4_simhash_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_winnowing(spark, sf_dir):
    return winnowing.fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark, sf_dir):
    return chat.repair(table(spark, sf_dir, "conversations"))


def op8_mixing(spark, sf_dir):
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_byte_bpe(spark, sf_dir):
    tokenizers = byte_bpe.public_tokenizers()
    return byte_bpe.encode_documents(
        table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"),
        tokenizers.PATTERN, digests=True)


def op10_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark, sf_dir):
    return alignment.align_public(table(spark, sf_dir, "documents"))


def op13_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def registry():
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    """DuckDB twins of the queries that SQL can express."""
    return {"op11_merkle_manifest": merkle.ORACLE_SQL}
