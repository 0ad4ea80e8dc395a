"""Queries of this subpackage, by name, and DuckDB SQL where it can express them."""

from __future__ import annotations

from . import decontaminate, langid, licenses, linededup, mixing, ordermh, passages, permindex, pii, toxicity


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_substring_dedup": passages.op1_substring_dedup,
        "op10_license_scan": licenses.op10_license_scan,
        "op2_language_mixture": langid.op2_language_mixture,
        "op3_permutation_index": permindex.op3_permutation_index,
        "op4_order_minhash": ordermh.op4_order_minhash,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_line_dedup": linededup.op6_line_dedup,
        "op7_pii_crf": pii.op7_pii_crf,
        "op8_mixing": mixing.op8_mixing,
        "op9_decontaminate": decontaminate.op9_decontaminate,
    }


def oracle_sql() -> dict:
    return {"op10_license_scan": licenses.ORACLE, "op6_line_dedup": linededup.ORACLE, "op8_mixing": mixing.ORACLE, "op9_decontaminate": decontaminate.ORACLE}
