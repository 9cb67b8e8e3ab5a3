"""The queries of this package, and DuckDB statements for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, langid, line_dedup, merkle, mixing, pii, quality, secrets, sharding, simhash, substring_dedup, url_filter, vector_codes

QUERIES = {
    "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_extendible_sharding": sharding.op3_extendible_sharding,
    "op4_fuzzy_line_dedup": line_dedup.op4_fuzzy_line_dedup,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_personal_data": pii.op7_personal_data,
    "op8_language_id": langid.op8_language_id,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_mixing": mixing.op10_mixing,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_url_filter": url_filter.op12_url_filter,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE = {
    "op1_benchmark_decontamination": decontaminate.ORACLE,
    "op3_extendible_sharding": sharding.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_url_filter": url_filter.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
