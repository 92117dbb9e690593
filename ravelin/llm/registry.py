"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from ravelin.llm import decontamination, divergence_rules, language_id, lm_scoring, mixture, near_duplicates, one_bit_search, quality_ranker, secrets, source_audit, token_files, vector_codes, warc


def queries() -> dict:
    return {
        "op1_quality_ranking": quality_ranker.op1_quality_ranking,
        "op2_loss_difference": lm_scoring.op2_loss_difference,
        "op3_warc_dictionary": warc.op3_warc_dictionary,
        "op4_language_id": language_id.op4_language_id,
        "op5_markov_secrets": secrets.op5_markov_secrets,
        "op6_latent_decontamination": decontamination.op6_latent_decontamination,
        "op7_divergence_rules": divergence_rules.op7_divergence_rules,
        "op8_token_files": token_files.op8_token_files,
        "op9_near_duplicates": near_duplicates.op9_near_duplicates,
        "op10_mixture": mixture.op10_mixture,
        "op11_one_bit_neighbours": one_bit_search.op11_one_bit_neighbours,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_source_audit": source_audit.op13_source_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_dictionary": warc.OP3_SQL, "op10_mixture": mixture.OP10_SQL, "op11_one_bit_neighbours": one_bit_search.OP11_SQL, "op12_vector_codes": vector_codes.OP12_SQL, "op13_source_audit": source_audit.OP13_SQL}
