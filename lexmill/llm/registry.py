"""Queries of this subpackage, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from lexmill.llm import ann, bpe, licenses, linedup, neardup, packing, quality, rules, secrets, suffix


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix.query,
        "op2_rule_ensemble": quality.query,
        "op3_secret_scan": secrets.query,
        "op4_nnls_packing": packing.query,
        "op5_adaptive_rules": rules.query,
        "op6_bpe_codec": bpe.query,
        "op7_permutation_index": ann.query,
        "op8_license_scan": licenses.query,
        "op9_minmax_neardup": neardup.query,
        "op10_line_runs": linedup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_line_runs": linedup.ORACLE,
    }
