"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import centroids, decontaminate, divergence, html, langid, lines, mixing, packing, simhash, substring, topk, toxicity, warc


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_exact_topk": topk.op3_exact_topk,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_language_id": langid.op5_language_id,
        "op6_substring_dedup": substring.op6_substring_dedup,
        "op7_html_extraction": html.op7_html_extraction,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_simhash": simhash.op9_simhash,
        "op10_line_dedup": lines.op10_line_dedup,
        "op11_centroid_clustering": centroids.op11_centroid_clustering,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_source_mixing": mixing.op13_source_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_decontamination": decontaminate.ORACLE_SQL,
        "op11_centroid_clustering": centroids.ORACLE_SQL,
        "op12_source_divergence": divergence.ORACLE_SQL,
        "op13_source_mixing": mixing.ORACLE_SQL,
    }
