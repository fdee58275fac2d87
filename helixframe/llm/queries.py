"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import fingerprint, host_rules, language_id, manifest, mixing, near_dup, packing, pii, quality, resampling, simhash, token_file, warc

QUERIES = {
    f.__name__: f
    for f in (
        packing.op1_best_fit_packing,
        language_id.op2_language_crf,
        quality.op3_quality_trees,
        host_rules.op4_host_rules,
        pii.op5_pii_bilstm,
        warc.op6_warc_dictionary,
        near_dup.op7_minhash_forest,
        fingerprint.op8_merkle_fingerprint,
        mixing.op9_temperature_mix,
        token_file.op10_token_file,
        simhash.op11_simhash_variants,
        manifest.op12_merkle_manifest,
        resampling.op13_importance_resample,
    )
}

SQL = {
    "op4_host_rules": host_rules.SQL,
    "op6_warc_dictionary": warc.SQL,
    "op9_temperature_mix": mixing.SQL,
    "op12_merkle_manifest": manifest.SQL,
    "op13_importance_resample": resampling.SQL,
}
