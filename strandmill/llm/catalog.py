"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from strandmill.llm import bpe, infill, language, licenses, mixing, ngram_join, packing, quality, resample, secrets, sharding, vectors, warc


def queries():
    found = [
        quality.op1_quality_rules, licenses.op2_license_scans, language.op3_language_id, ngram_join.op4_ngram_jaccard_join, sharding.op5_hilbert_sharding,
        packing.op6_first_fit_packing, mixing.op7_mix_sources, secrets.op8_secret_scans, warc.op9_warc_round_trip, vectors.op10_multi_index_hashing,
        infill.op11_fill_in_middle, resample.op12_importance_resampling, bpe.op13_bpe,
    ]
    return {f.__name__: f for f in found}


def oracle_sql():
    return {
        "op1_quality_rules": quality.oracle_sql(), "op4_ngram_jaccard_join": ngram_join.oracle_sql(),
        "op7_mix_sources": mixing.oracle_sql(), "op9_warc_round_trip": warc.oracle_sql(),
        "op11_fill_in_middle": infill.oracle_sql(), "op12_importance_resampling": resample.oracle_sql(),
    }
