"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline

from . import chat, ctw, decontaminate, fingerprint, langid, line_dedup, minhash_dedup, mixing, resample, simhash_dedup, substring_dedup, vector_codes, warc


def queries() -> dict:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_format_chats": chat.op2_format_chats,
        "op3_ctw_scores": ctw.op3_ctw_scores,
        "op4_warc_round_trip": warc.op4_warc_round_trip,
        "op5_fingerprints": fingerprint.op5_fingerprints,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_simhash_dedup": simhash_dedup.op9_simhash_dedup,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op11_resample": resample.op11_resample,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_minhash_dedup": minhash_dedup.op13_minhash_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_format_chats": chat.OP2_SQL, "op4_warc_round_trip": warc.OP4_SQL, "op7_substring_dedup": substring_dedup.OP7_SQL, "op11_resample": resample.OP11_SQL, "op12_vector_codes": vector_codes.OP12_SQL, "op13_minhash_dedup": minhash_dedup.OP13_SQL}
