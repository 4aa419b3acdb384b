"""Registered queries of this package: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from . import (bitpack, compression, counting, credentials, exact_dedup, fingerprints, langid, licenses, minhash, mixing,
               packing, pii, spelling)
from .common import documents, tokenizer_file


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op2_pii(spark, sf_dir):
    return pii.digest(pii.find_personal_data(documents(spark, sf_dir)))


def op3_minhash(spark, sf_dir):
    return minhash.near_duplicates(documents(spark, sf_dir)).drop("text_sha256")


def op4_langid(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir))


def op5_bitpack(spark, sf_dir):
    return bitpack.digest(bitpack.stored_tokens(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json")))


def op6_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op7_packing(spark, sf_dir):
    return packing.digest(packing.pack(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json")))


def op8_counting(spark, sf_dir):
    return counting.count_tokens(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op9_secrets(spark, sf_dir):
    return credentials.digest(credentials.find_secrets(documents(spark, sf_dir)))


def op10_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_vector_codes(spark, sf_dir):
    return compression.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_spelling(spark, sf_dir):
    return spelling.variants(documents(spark, sf_dir))


def op13_licenses(spark, sf_dir):
    return licenses.digest(licenses.scan(documents(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_pii, op3_minhash, op4_langid, op5_bitpack, op6_fingerprints,
                                   op7_packing, op8_counting, op9_secrets, op10_mixing, op11_vector_codes, op12_spelling,
                                   op13_licenses)}
