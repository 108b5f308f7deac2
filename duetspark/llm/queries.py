"""The corpus queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import chat, decontam, embed_dup, lang_id, lexical, licenses, line_dedup, merkle, mixing, near_dup, pii, quality, url_filter

QUERIES = {
    "op1_benchmark_decontamination": decontam.op1_benchmark_decontamination,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_quality_votes": quality.op3_quality_votes,
    "op4_bilstm_crf_pii": pii.op4_bilstm_crf_pii,
    "op5_fp_growth_url_filter": url_filter.op5_fp_growth_url_filter,
    "op6_preference_formatting": chat.op6_preference_formatting,
    "op7_minhash_near_dedup": near_dup.op7_minhash_near_dedup,
    "op8_compression_language_id": lang_id.op8_compression_language_id,
    "op9_itq_embedding_near_dedup": embed_dup.op9_itq_embedding_near_dedup,
    "op10_poisson_mixing": mixing.op10_poisson_mixing,
    "op11_two_level_search": lexical.op11_two_level_search,
    "op12_cuckoo_line_dedup": line_dedup.op12_cuckoo_line_dedup,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

SQL = {
    "op1_benchmark_decontamination": decontam.OP1_SQL,
    "op2_license_scan": licenses.OP2_SQL,
    "op6_preference_formatting": chat.OP6_SQL,
    "op7_minhash_near_dedup": near_dup.OP7_SQL,
    "op9_itq_embedding_near_dedup": embed_dup.OP9_SQL,
    "op10_poisson_mixing": mixing.OP10_SQL,
    "op11_two_level_search": lexical.OP11_SQL,
    "op12_cuckoo_line_dedup": line_dedup.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
