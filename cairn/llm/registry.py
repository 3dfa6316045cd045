"""Queries of the training-data operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import ann, bpe, decontaminate, html_text, jaccard, licenses, pii, quality, secrets, warc


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_bpe": bpe.op2_bpe,
        "op3_quality": quality.op3_quality,
        "op4_ann": ann.op4_ann,
        "op5_warc": warc.op5_warc,
        "op6_jaccard": jaccard.op6_jaccard,
        "op7_secrets": secrets.op7_secrets,
        "op8_pii": pii.op8_pii,
        "op9_html": html_text.op9_html,
        "op10_licenses": licenses.op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.OP1_SQL,
        "op5_warc": warc.OP5_SQL,
        "op6_jaccard": jaccard.OP6_SQL,
    }
