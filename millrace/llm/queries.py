"""The operators' queries over the whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chunk_dedup, exact_dedup, languages, licenses, line_quality, mixing, prob_minhash, secrets, toxicity
from .common import load


def op1_mixture(spark, sf_dir):
    return mixing.mixture(load(spark, sf_dir, "documents"))


def op2_secrets(spark, sf_dir):
    return secrets.secret_scan(load(spark, sf_dir, "documents"))


def op3_licenses(spark, sf_dir):
    return licenses.license_scan(load(spark, sf_dir, "documents"))


def op4_exact_duplicates(spark, sf_dir):
    return exact_dedup.exact_duplicates(load(spark, sf_dir, "documents"))


def op5_near_duplicates(spark, sf_dir):
    return prob_minhash.near_duplicates(load(spark, sf_dir, "documents"))


def op6_line_quality(spark, sf_dir):
    return line_quality.line_quality(load(spark, sf_dir, "documents"))


def op7_bpe(spark, sf_dir):
    return bpe.bpe_encode(load(spark, sf_dir, "documents"))


def op8_language(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return languages.identify(docs, languages.train(docs))


def op9_toxic(spark, sf_dir):
    return toxicity.toxic_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_repeated_spans(spark, sf_dir):
    return chunk_dedup.repeated_spans(load(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixture, op2_secrets, op3_licenses, op4_exact_duplicates, op5_near_duplicates, op6_line_quality, op7_bpe,
        op8_language, op9_toxic, op10_repeated_spans, pipeline,
    )
}

ORACLE_SQL = {"op1_mixture": mixing.SQL, "op4_exact_duplicates": exact_dedup.SQL, "op6_line_quality": line_quality.SQL}
