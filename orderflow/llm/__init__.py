"""Operators for training-data pipelines; nothing else in the library imports this subpackage."""

from __future__ import annotations

from orderflow.llm import collocations, decontaminate, html_extract, jaccard_join, knn_quality, licenses, pieces, quality_rules, secret_scan, simhash, url_lists, warc, whitening


def queries() -> dict:
    """The numbered queries by name."""
    return {
        "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_sentencepiece": pieces.op3_sentencepiece,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_secret_scan": secret_scan.op5_secret_scan,
        "op6_warc": warc.op6_warc,
        "op7_html_extraction": html_extract.op7_html_extraction,
        "op8_knn_quality": knn_quality.op8_knn_quality,
        "op9_url_filter": url_lists.op9_url_filter,
        "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
        "op11_collocations": collocations.op11_collocations,
        "op12_whitening": whitening.op12_whitening,
        "op13_jaccard_join": jaccard_join.op13_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that SQL can express."""
    return {
        "op2_license_scan": licenses.op2_oracle(),
        "op4_quality_rules": quality_rules.op4_oracle(),
        "op5_secret_scan": secret_scan.op5_oracle(),
        "op6_warc": warc.op6_oracle(),
        "op9_url_filter": url_lists.op9_oracle(),
        "op10_benchmark_decontamination": decontaminate.op10_oracle(),
        "op11_collocations": collocations.op11_oracle(),
    }
